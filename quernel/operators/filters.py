"""Filters that name the first reason for which a document is refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.language import b_judged, b_scores, b_words, language_c, language_d
from ..functions.text import LINE_BREAK, SPACE, casefold, composed, count_class, first_reason, nfc, squeeze_ends, stripped_lines

# Fixed values of the filters.
MOJIBAKE_MARKERS = ("�", "Ã", "Â", "Ä", "Å", "â€", "ï¿½")
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
EXEMPT_DOMAINS = ("example.com", "example.org", "example.net", "invalid")
IDENTITY_NUMBER = r"(?:^|[^0-9])[1-9][0-9]{10}(?:[^0-9]|$)"
PHONE = r"(?:^|[^0-9])(?:\+?[0-9][\t\n\r ().-]*){10,15}(?:[^0-9]|$)"
IPV4 = r"(?:^|[^0-9])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?:[^0-9]|$)"
IDENTITY_CUES = ("tc kimlik", "t.c. kimlik", "identity number")
PHONE_CUES = ("phone number", "telephone number", "telefon numarası", "contact number")
IP_CUES = ("personal ip", "user ip address", "kullanıcı ip adresi")
MARKUP = r"(?i)\{\{|\}\}|\[\[(?:Category|Kategori|File|Dosya):"
PILOT_PII = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+|(?:\+?[0-9][0-9 ()-]{7,}[0-9])|https?://|www\."
V1_URL = r"(?i)https?://|www\."
V1_EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+"
V1_PHONE = r"\+?[0-9][0-9\t\n\r ().-]{7,}[0-9]"
V1_SECRET = r"(?i)api[_-]?key|secret|password|passwd|token|credential|private[_-]?key"
V1_PUNCTUATION = r".,;:!?()\[\]{}'\"`_/\\+*=<>#%&|@$€₺\n \-"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{80}-\x{9F}]"


def mojibake(c: Column) -> Column:
    found = F.lit(False)
    for m in MOJIBAKE_MARKERS:
        found = found | F.contains(c, F.lit(m))
    return found


def _any(c: Column, terms: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for t in terms:
        found = found | F.contains(c, F.lit(t))
    return found


def normalized(c: Column) -> Column:
    """Of a text in NFC form: unified line ends, lines without trailing space, at most one blank line in a row, trimmed."""
    unified = F.regexp_replace(c, LINE_BREAK, "\n")
    return F.regexp_replace(squeeze_ends(F.regexp_replace(unified, r"[\t \x1F\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]+(?=\n)", "")), r"\n{3,}", "\n\n")


def material_pii(c: Column) -> Column:
    """Kind of personal data that needs a context word to count (an address outside example domains needs none)."""
    domains = F.transform(F.regexp_extract_all(c, F.lit(EMAIL), F.lit(0)), lambda e: F.lower(F.substring_index(e, "@", -1)))
    folded = casefold(c)
    return first_reason(
        ("email", F.contains(c, F.lit("@")) & F.exists(domains, lambda d: ~d.isin(*EXEMPT_DOMAINS))),
        ("turkish_identity_number", _any(folded, IDENTITY_CUES) & c.rlike(IDENTITY_NUMBER)),
        ("phone", _any(folded, PHONE_CUES) & c.rlike(PHONE)),
        ("ipv4", _any(folded, IP_CUES) & c.rlike(IPV4)),
    )


def with_quality_reason(df: DataFrame, text: str = "text", expected: str = "lang", name: str = "reason", low: int = 120, high: int = 100_000, confidence: float = 0.55, keep: str | None = None) -> DataFrame:
    """``df`` with ``name``: the first reason of the corpus filter, null if none. A null text counts as empty. ``keep``:
    a column that gets the text in NFC form.

    What several tests share (normal form, counts, lines, words) are columns of their own, each computed once a row by
    generated code; only texts that may not be in NFC form pass through Python. Strings of Spark hold no surrogates, so
    the test for malformed ones can't apply.
    """
    raw, c, n = F.col("_raw"), F.col("_c"), F.col("_n")
    d = composed(df.withColumn("_raw", F.coalesce(F.col(text), F.lit(""))).withColumn("_nfc", F.col("_raw")), "_nfc")
    d = d.withColumn("_c", normalized(F.col("_nfc")))
    d = d.withColumns({"_solid": F.regexp_replace(c, SPACE + "+", ""), "_k": stripped_lines(c), "_w": b_words(c), "_pii": material_pii(c)})
    tr, en = b_scores(c, F.col("_w"))
    d = d.withColumns({"_n": F.greatest(F.length("_solid"), F.lit(1)), "_p": count_class(F.col("_solid"), r"\p{P}"), "_a": count_class(F.col("_solid"), r"\p{L}\p{N}"), "_tr": tr, "_en": en})
    label, sure = b_judged(c, F.col("_tr"), F.col("_en"))
    d = d.withColumns({"_label": label, "_sure": sure})
    reason = F.coalesce(
        first_reason(
            ("replacement_character", F.contains(raw, F.lit("�"))), ("control_character", raw.rlike(CONTROL)), ("mojibake", mojibake(raw)),
            ("too_short", F.length(c) < low), ("too_long", F.length(c) > high), ("repeated_character", c.rlike(r"([^\t\n\x0B\f\r ])\1{39,}")),
            ("excessive_punctuation", F.col("_p") / n > 0.35), ("low_information", F.col("_a") / n < 0.25),
            ("repeated_lines", (F.size("_k") >= 5) & (1 - F.size(F.array_distinct("_k")) / F.size("_k") > 0.30)), ("markup_leakage", c.rlike(MARKUP)),
        ),
        F.concat(F.lit("material_pii_"), F.col("_pii")),
        first_reason(("wrong_or_uncertain_language", ~c.rlike(r"\p{L}") | (F.col("_label") != F.coalesce(F.col(expected), F.lit(""))) | (F.col("_sure") < confidence))),
    )
    own = [F.col(f"`{x}`") for x in df.columns]
    return d.select(*own, reason.alias(name), *([F.col("_nfc").alias(keep)] if keep else []))


def pilot_reason(text: Column, language: Column, low: int = 40, high: int = 20_000) -> Column:
    c = F.coalesce(text, F.lit(""))
    size = F.length(squeeze_ends(nfc(c)))
    return first_reason(
        ("pii_or_url", c.rlike("(?i)" + PILOT_PII)),
        ("replacement_character", F.contains(c, F.lit("�"))),
        ("mojibake", mojibake(c)),
        ("unsafe_control_character", c.rlike(CONTROL)),
        ("document_length", (size < low) | (size > high)),
        ("language_mismatch", language_c(c) != F.coalesce(language, F.lit(""))),
    )


def pretraining_reason(text: Column, language: Column, low: int = 200, urls: int = 3, allowed: tuple[str, ...] = ("tr", "en")) -> Column:
    """The first-generation filter, without its duplicate check (see ``first_by_hash``)."""
    c = F.coalesce(text, F.lit(""))
    odd = F.length(F.regexp_replace(c, r"[\p{L}\p{N}" + V1_PUNCTUATION + SPACE[1:-1] + "]", ""))
    found = language_d(c, F.coalesce(language, F.lit("unknown")))
    return first_reason(
        ("too_short", F.length(c) < low),
        ("too_many_urls", F.regexp_count(c, F.lit(V1_URL)) > urls),
        ("private_or_secret_pattern", c.rlike(V1_EMAIL) | c.rlike(V1_PHONE) | c.rlike(V1_SECRET)),
        ("too_many_non_text_chars", odd / F.greatest(F.length(c), F.lit(1)) > 0.20),
        ("language", ~found.isin(*allowed, "code")),
    )


__all__ = ["material_pii", "mojibake", "normalized", "with_quality_reason", "pilot_reason", "pretraining_reason"]
