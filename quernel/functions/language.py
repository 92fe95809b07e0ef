"""The two-language heuristics of the corpus project, as expressions. They answer tr, en or unknown only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import casefold, let

# Fixed values of the heuristics.
A_CHARS = "çğıİöşüÇĞIıÖŞÜ"
A_TR = ("bir", "ve", "ile", "için", "kullanıcı", "veritabanı", "bugün", "türkiye", "yapay", "zeka", "sunucu")
A_EN = ("the", "and", "with", "for", "user", "database", "today", "turkey", "artificial", "intelligence", "server")
B_CHARS = "çÇğĞıİöÖşŞüÜ"
B_TR = ("ve", "bir", "bu", "icin", "için", "ile", "olarak", "olan", "daha", "gibi", "ya", "da", "de", "tarafindan", "tarafından", "sonra", "kadar", "ancak", "veya", "ise", "cok", "çok", "uzere", "üzere")
B_EN = ("the", "and", "of", "to", "in", "is", "for", "that", "with", "as", "on", "by", "from", "or", "an", "this", "are", "be", "it", "was", "can", "which", "at", "not", "has", "have")
C_TR = ("bir", "ve", "ile", "için", "bu", "şu", "python", "işlev", "sınıf")
C_EN = ("the", "and", "with", "for", "this", "that", "python", "function", "class")
D_CHARS = "çğıöşüÇĞİÖŞÜ"
D_TR = ("bir", "ve", "için", "nasıl", "nedir", "değil", "olarak", "olan", "çok")
D_EN = ("the", "and", "for", "that", "with", "this", "from", "are", "language")


def _chars(c: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(c, f"[^{chars}]+", ""))


def _lower(c: Column) -> Column:
    """Case-folded text in which a dotted capital I, which no listed word holds, stays one letter."""
    return casefold(F.replace(c, F.lit("İ"), F.lit("ɨ")))


def _split(lowered: Column, letters: str) -> Column:
    return F.split(lowered, f"[^{letters}]+")


def _hits(words: Column, wanted: tuple[str, ...]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*wanted)))


def _winner(tr: Column, en: Column) -> Column:
    return F.when(tr > en, "tr").when(en > tr, "en")


_A_LETTERS, _LETTERS, _WORD = "A-Za-zÇĞİÖŞÜçğıöşüɨ", r"\p{L}", r"\p{L}\p{N}_"


def language_a(c: Column) -> Column:
    """Two points per Turkish letter (plain capital I counts) and one per known word."""

    def judge(s: Column) -> Column:
        en = s["en"] + F.when((s["ascii"] > 0) & (s["special"] == 0), 1).otherwise(0)
        return F.coalesce(_winner(2 * s["special"] + s["tr"], en), F.lit("unknown"))

    scores = let(_split(_lower(c), _A_LETTERS), lambda w: F.struct(_chars(c, A_CHARS).alias("special"), _chars(c, "A-Za-z").alias("ascii"), _hits(w, A_TR).alias("tr"), _hits(w, A_EN).alias("en")))
    return F.when(~c.rlike("[A-Za-zÇĞİÖŞÜçğıöşü]"), "unknown").otherwise(let(scores, judge))


def language_b(c: Column) -> Column:
    """struct(label, confidence): two points per stop word, one per Turkish letter up to twenty."""
    scores = let(b_words(c), lambda w: F.struct(b_scores(c, w)[0].alias("tr"), b_scores(c, w)[1].alias("en")))
    return F.when(~c.rlike(r"\p{L}"), F.struct(F.lit("unknown").alias("label"), F.lit(0.0).alias("confidence"))).otherwise(let(scores, lambda s: F.struct(*[x.alias(n) for n, x in zip(("label", "confidence"), b_judged(c, s["tr"], s["en"]), strict=True)])))


def b_words(c: Column) -> Column:
    return _split(_lower(c), _LETTERS)


def b_scores(c: Column, words: Column) -> tuple[Column, Column]:
    return 2 * _hits(words, B_TR) + F.least(F.lit(20), _chars(c, B_CHARS)), 2 * _hits(words, B_EN)


def b_judged(c: Column, tr: Column, en: Column) -> tuple[Column, Column]:
    """Label and confidence of a text with letters."""
    none = (tr == 0) & (en == 0)
    plain = _chars(c, "A-Za-z") / _chars(c, _LETTERS) >= 0.97
    label = F.when(none, F.when(plain, "en").otherwise("unknown")).otherwise(F.coalesce(_winner(tr, en), F.lit("unknown")))
    return label, F.when(none, F.when(plain, 0.55).otherwise(0.0)).when(tr == en, 0.5).otherwise(F.greatest(tr, en) / (tr + en))


def language_c(c: Column) -> Column:
    scores = let(_split(_lower(c), _WORD), lambda w: F.struct((2 * _chars(c, A_CHARS) + _hits(w, C_TR)).alias("tr"), _hits(w, C_EN).alias("en")))
    winner = let(scores, lambda s: _winner(s["tr"], s["en"]))
    blank = ~c.rlike(r"[^\x00-\x20]")
    return F.when(blank, "unknown").otherwise(F.coalesce(winner, F.when(~c.rlike(r"[^\x00-\x7F]"), "en").otherwise("unknown")))


def language_d(c: Column, fallback: Column) -> Column:
    """Turkish letters or two known words decide; else the language the source claims."""
    different = let(F.array_distinct(_split(_lower(c), _WORD)), lambda w: F.struct(_hits(w, D_TR).alias("tr"), _hits(w, D_EN).alias("en")))
    known = let(different, lambda s: F.when((_chars(c, D_CHARS) > 0) | (s["tr"] >= 2), "tr").when(s["en"] >= 2, "en"))
    return F.when(fallback == "code", "code").otherwise(F.coalesce(known, fallback))
