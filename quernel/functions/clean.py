"""Cleaners of the older pipelines, answers of models, and keys without composition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import SPACE, casefold, lines, squeeze, squeeze_ends

# What a pilot cleaner of wiki markup replaces, in order.
WIKI_PILOT = (
    (r"(?is)<ref[^>]*>.*?</ref>", " "), (r"<[^>]+>", " "), (r"(?s)\{\|.*?\|\}", " "), (r"\{\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}\}", " "),
    (r"\[\[(?:[^|\]]+\|)?([^\]]+)\]\]", "$1"), (r"\[https?://[^\s\]]+\s*([^\]]*)\]", "$1"), (r"'{2,}", ""),
)
# What ends a model's answer, what starts the next turn, and what starts an example.
END_TOKENS = ("</s>", "<s>", "<pad>", "<unk>", "<mask>")
TURNS = ("\n\nKullanıcı:", "\nKullanıcı:", "\n\nSoru:", "\nSoru:", "\n\nSen:", "\nSen:")
ANSWER_LABEL = "Asistan:"
EXAMPLE_STARTS = ("# bucket:", "Kullanıcı:")


def simple_key(c: Column) -> Column:
    """Case-folded and squeezed, not composed."""
    return F.sha2(squeeze(casefold(c)), 256)


def corpus_clean(c: Column) -> Column:
    """At most one blank line in a row, runs of spaces and tabs to one space, trimmed."""
    return squeeze_ends(F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), r"\n{3,}", "\n\n"), r"[ \t]+", " "))


def wiki_pilot(c: Column) -> Column:
    """Wiki markup by patterns alone: references, tags, tables, templates go, links become their labels, blank lines go."""
    for pattern, by in WIKI_PILOT:
        c = F.regexp_replace(c, pattern, by)
    return F.array_join(F.filter(F.transform(lines(c), squeeze_ends), lambda x: x != ""), "\n")


def chunks(c: Column, least: int = 40) -> Column:
    """Squeezed chunks of at least ``least`` characters, cut at blank lines and where two spaces follow a full stop."""
    parts = F.split(F.regexp_replace(c, rf"\.{SPACE}{{2,}}", ".\n\n"), r"\n[\t\n\x0B\f\r ]*\n")
    return F.filter(F.transform(parts, squeeze), lambda x: F.length(x) >= least)


def answer_of(output: Column, prompt: Column) -> Column:
    """The answer in a model's output: up to the first end token, without the prompt it repeats, up to the next turn,
    without the label before it. Of several markers of a turn the first listed one that occurs cuts."""
    for t in END_TOKENS:
        output = F.substring_index(output, t, 1)
    output = squeeze_ends(output)
    answer = F.when(F.startswith(output, prompt), F.substr(output, F.length(prompt) + 1)).otherwise(output)
    cut = F.coalesce(*[F.when(F.contains(answer, F.lit(m)), F.substring_index(answer, m, 1)) for m in TURNS], answer)
    cut = squeeze_ends(cut)
    return F.when(F.startswith(cut, F.lit(ANSWER_LABEL)), squeeze_ends(F.substr(cut, F.lit(len(ANSWER_LABEL) + 1)))).otherwise(cut)


def dialogues(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, example): examples of a text of dialogues, numbered from 0. An example starts at a bucket or user line
    outside code fences; texts without one are one example. Null and blank texts give none."""
    per = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.regexp_replace(F.replace(F.col(text_col), F.lit("﻿"), F.lit("")), r"\r\n?", "\n"), "\n")).alias("pos", "line"))
    bare = squeeze_ends(F.col("line"))
    before = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)  # a text's own lines
    marked = per.withColumn("fence", bare.startswith("```").cast("int")).withColumn("inside", F.coalesce(F.sum("fence").over(before), F.lit(0)) % 2 == 1)
    starts = ~F.col("inside") & (bare.startswith(EXAMPLE_STARTS[0]) | bare.startswith(EXAMPLE_STARTS[1]))
    grouped = marked.withColumn("starts", starts.cast("int")).withColumn("g", F.sum("starts").over(Window.partitionBy("id").orderBy("pos")))
    texts = grouped.groupBy("id", "g").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l")).select("id", "g", squeeze_ends(F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("example")).where("example != ''")
    return texts.select("id", (F.row_number().over(Window.partitionBy("id").orderBy("g")) - 1).alias("n"), "example")
