"""Conversations to prompt and response pairs, encodings for tuning, and answers scored by keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import nfc, squeeze

# Names of roles.
USERS = ("user", "human", "instruction", "prompt")
ASSISTANTS = ("assistant", "gpt", "bot", "model", "response")


def turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, who, content): turns of users and assistants that hold text."""
    r = F.lower(F.coalesce(F.col(role), F.lit("")))
    who = F.when(r.isin(*USERS), "user").when(r.isin(*ASSISTANTS), "assistant")
    return df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), who.alias("who"), squeeze(F.col(text)).alias("content")).where(F.col("who").isNotNull() & (F.col("content") != ""))


def all_pairs(df: DataFrame, **names) -> DataFrame:
    """(conv, turn, prompt, response): each assistant turn right after a user turn, among the turns that count; of
    several user turns in a row the last is the prompt."""
    w = Window.partitionBy("conv").orderBy("turn")
    before = turns(df, **names).withColumn("_w", F.lag("who").over(w)).withColumn("_c", F.lag("content").over(w))
    return before.where((F.col("who") == "assistant") & (F.col("_w") == "user")).select("conv", "turn", F.col("_c").alias("prompt"), F.col("content").alias("response"))


def first_pairs(df: DataFrame, **names) -> DataFrame:
    """The first pair of each conversation."""
    p = all_pairs(df, **names)
    return p.groupBy("conv").agg(F.min_by(F.struct("turn", "prompt", "response"), "turn").alias("p")).select("conv", "p.*")


def merged(instruction: Column, given: Column) -> Column:
    """Prompt of a row with an instruction and an input: squeezed, the input on a line of its own where there is one."""
    i, g = squeeze(instruction), squeeze(given)
    return F.when(g != "", F.concat(i, F.lit("\n"), g)).otherwise(i)


def matchable(c: Column) -> Column:
    """Text for containment tests: lower case, composed, without combining dots."""
    return F.replace(F.lower(nfc(F.coalesce(c, F.lit("")))), F.lit("̇"), F.lit(""))


def scored(df: DataFrame, answer: str = "answer", keywords: str = "expected_keywords", phrases: str = "accepted_phrases", groups: str = "keyword_groups") -> DataFrame:
    """``df`` with matched_keywords, missing_keywords, matched_phrases, missing_groups and passed. An answer passes with
    all keywords (also when none is expected), or any phrase, or a term of each of the groups if there are any."""
    a = matchable(F.col(answer))
    has = lambda k: F.contains(F.col("_a"), F.replace(F.lower(k), F.lit("̇"), F.lit("")))
    kw = F.coalesce(F.col(keywords), F.array().cast("array<string>"))
    ph = F.coalesce(F.col(phrases), F.array().cast("array<string>"))
    gr = F.coalesce(F.col(groups), F.array().cast("array<array<string>>"))
    out = df.withColumn("_a", a).withColumns({
        "matched_keywords": F.filter(kw, has), "missing_keywords": F.filter(kw, lambda k: ~has(k)),
        "matched_phrases": F.filter(ph, has), "missing_groups": F.filter(gr, lambda g: ~F.exists(g, has)),
    })
    passed = (F.size("missing_keywords") == 0) | (F.size("matched_phrases") > 0) | ((F.size(gr) > 0) & (F.size("missing_groups") == 0))
    return out.withColumn("passed", passed).drop("_a")


def supervised(prompt_ids: Column, full_ids: Column, block: int, pad: int = 0) -> Column:
    """struct(input_ids, labels) of a fixed length: the sequence and its successor, with labels of the prompt and of the
    padding masked by -100; longer sequences are cut."""
    cut = F.slice(full_ids, 1, block + 1)
    x, y = F.slice(cut, 1, F.greatest(F.size(cut) - 1, F.lit(0))), F.slice(cut, 2, block)
    labels = F.transform(y, lambda t, i: F.when(i + 1 < F.size(prompt_ids), F.lit(-100)).otherwise(t))
    fill = lambda a, v: F.concat(a, F.array_repeat(F.lit(v), F.greatest(F.lit(block) - F.size(a), F.lit(0)).cast("int")))
    return F.struct(fill(x, pad).alias("input_ids"), fill(labels, -100).alias("labels"))
