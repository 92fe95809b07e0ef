"""Column functions for text. All are built-in expressions (no Python in the hot path) but ``nfc``."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space of the Unicode standard, as a class both Java and RE2 read.
SPACE = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The same characters one by one.
SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Line boundaries beyond the line feed.
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


#: Characters that may decompose or compose; texts without one are in NFC form.
MAY_COMPOSE = r"[\x{300}-\x{36F}\x{1100}-\x{11FF}\x{3099}\x{309A}\x{F900}-\x{FAFF}\x{1E00}-\x{1FFF}\x{2126}\x{212A}\x{212B}\x{340}-\x{344}]"


def nfc(c: Column) -> Column:
    """NFC form. The value is right for every text, but all rows pass through Python; tables take ``composed``."""
    return F.when(c.rlike(MAY_COMPOSE), _nfc(c)).otherwise(c)


def composed(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``column`` in NFC form: only rows whose text may change leave the JVM."""
    may = F.coalesce(F.col(column).rlike(MAY_COMPOSE), F.lit(False))
    return df.where(~may).unionByName(df.where(may).withColumn(column, _nfc(F.col(column))))


def casefold(c: Column) -> Column:
    """Case folding as far as the corpora need it: dotted capital I, sharp s, final sigma."""
    return F.replace(F.replace(F.lower(F.replace(c, F.lit("İ"), F.lit("i̇"))), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def squeeze(c: Column) -> Column:
    """Runs of white space to one space, trimmed; null becomes the empty text."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), SPACE + "+", " "))


def content_key(c: Column) -> Column:
    """NFC, case-folded, white space squeezed."""
    return composed_key(nfc(c))


def composed_key(c: Column) -> Column:
    """The content key of a text that is in NFC form."""
    return squeeze(casefold(c))


def content_hash(c: Column) -> Column:
    return F.sha2(content_key(c), 256)


def lines(c: Column) -> Column:
    """Lines of a text; the break at its end makes no empty line."""
    return F.split(F.regexp_replace(c, f"(?:{LINE_BREAK})$", ""), LINE_BREAK)


def stripped_lines(c: Column) -> Column:
    """Trimmed lines that are not blank."""
    return F.filter(F.transform(lines(c), squeeze_ends), lambda x: x != "")


def squeeze_ends(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def count_class(c: Column, keep: str) -> Column:
    """How many characters of ``c`` belong to a character class given as its complement-ready body, e.g. ``\\p{L}``."""
    return F.length(F.regexp_replace(c, f"[^{keep}]+", ""))


def words(c: Column, pattern: str = r"[\p{L}\p{N}_]+") -> Column:
    return F.regexp_extract_all(casefold(c), F.lit(pattern), F.lit(0))


def shingles(tokens: Column, k: int) -> Column:
    """Joined runs of ``k`` tokens; of fewer tokens one run of all, of none an empty array."""

    def runs(t: Column) -> Column:
        n = F.size(t)
        joined = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(t, i, k), " "))
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(joined)

    return let(tokens, runs)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def first_reason(*checks: tuple[str, Column]) -> Column:
    """Name of the first check that holds, null if none: the order of the checks is part of the result."""
    return F.coalesce(*[F.when(condition, F.lit(name)) for name, condition in checks])


def hash_bucket(text: Column, buckets: int) -> Column:
    """Unsigned first 64 bits of the SHA-256 of a text, modulo ``buckets``."""
    return (F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(buckets)).cast("int")
