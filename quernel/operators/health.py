"""Health of generated texts: findings, which of them fail at a stage, flags and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import shingles, squeeze_ends, words

# Scripts that the two languages don't use, special tokens, and which findings are failures at a stage.
SCRIPTS = {"cyrillic": r"[\x{400}-\x{4FF}]", "arabic": r"[\x{600}-\x{6FF}]", "hebrew": r"[\x{590}-\x{5FF}]", "greek": r"[\x{370}-\x{3FF}]", "cjk": r"[\x{3400}-\x{9FFF}]"}
SPECIAL = r"<(?:pad|unk|s|/s)>|<\|(?:system|user|assistant|end)\|>"
BROKEN = "Ã.|Â.|Ä.|Å.|â€|ï¿½"
HARD = ("decoder_defect", "confirmed_text_mojibake")
PROMOTED = ("unexpected_script", "mixed_script", "repetition", "empty_output", "special_token_leakage")
REPETITION = 0.35


def findings(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, findings, hard_early, hard_release): what is wrong with each text, and how many findings are failures at an
    early stage (broken characters) and for a release (everything). A null text counts as empty; ids are unique."""
    r = F.coalesce(F.col(text_col), F.lit(""))
    d = df.select(id_col, r.alias("_r"), words(r).alias("_w"))
    top = d.select(id_col, F.explode("_w").alias("w")).groupBy(id_col, "w").agg(F.count("*").alias("c")).groupBy(id_col).agg((F.max("c") / F.sum("c")).alias("_top"))
    d = d.join(top, id_col, "left").withColumn("_f", sum((F.col("_r").rlike(p).cast("int") for p in SCRIPTS.values()), F.lit(0)))
    checks = (
        ("empty_output", squeeze_ends(F.col("_r")) == ""), ("decoder_defect", F.contains("_r", F.lit("�"))), ("confirmed_text_mojibake", F.col("_r").rlike(BROKEN)), ("unexpected_script", F.col("_f") > 0),
        ("mixed_script", (F.col("_f") > 1) | (F.col("_f") > 0) & F.col("_r").rlike(r"\p{IsLatin}")), ("repetition", F.coalesce("_top", F.lit(1.0)) > REPETITION), ("special_token_leakage", F.col("_r").rlike(SPECIAL)),
    )
    found = d.select(id_col, F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks])).alias("findings"))
    among = lambda names: F.size(F.array_intersect("findings", F.array(*[F.lit(n) for n in names]))).cast("long")
    return found.select(id_col, "findings", among(HARD).alias("hard_early"), among(HARD + PROMOTED).alias("hard_release"))


def summary(df: DataFrame, text_col: str) -> DataFrame:
    """One row: texts, empty ones, replacement characters, broken and leaking ones, words, closed ones."""
    r = F.col(text_col)
    n = F.size(words(r))
    count = lambda c: F.sum(c.cast("long"))
    return df.select(r.alias("_r"), n.alias("_n")).agg(
        F.count("*").alias("generations"), count(squeeze_ends(F.col("_r")) == "").alias("empty"), F.sum(F.length(F.regexp_replace("_r", "[^�]+", ""))).cast("long").alias("replacements"), count(F.col("_r").rlike(BROKEN)).alias("mojibake"), count(F.col("_r").rlike(SPECIAL)).alias("leaked"),
        F.round(F.avg("_n"), 6).alias("mean_words"), F.round(F.percentile("_n", 0.5), 4).alias("p50_words"), F.round(F.percentile("_n", 0.95), 4).alias("p95_words"), count(F.col("_r").rlike(r"[.!?]\s*\z")).alias("closed"),
    )


def student_flags(df: DataFrame) -> DataFrame:
    """(pair_id, empty_output, language_mismatch, repeated_text) of columns pair_id, p and o: fewer than ten characters;
    words of the other language; nine words or more with a run of three at least three times."""
    border = r"[^\p{L}\p{N}_]"
    whole = lambda x: rf"(?:^|{border})(?:{x})(?:{border}|$)"
    turkish = F.lower("p").rlike("[çğıöşü]")
    wrong = turkish & F.lower("o").rlike(whole("the|and|what is|docker is")) | ~turkish & F.lower("o").rlike(whole("nedir|değildir|geliştirilen"))
    runs = df.where(F.size(words(F.col("o"))) >= 9).select("pair_id", F.explode(shingles(words(F.col("o")), 3)).alias("g")).groupBy("pair_id", "g").agg(F.count("*").alias("c")).groupBy("pair_id").agg(F.max("c").alias("times"))
    return df.join(runs, "pair_id", "left").select("pair_id", (F.length(squeeze_ends(F.col("o"))) < 10).alias("empty_output"), wrong.alias("language_mismatch"), (F.coalesce("times", F.lit(0)) >= 3).alias("repeated_text"))
