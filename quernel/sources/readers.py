"""Readers of the corpus formats. All return DataFrames; archives are opened per file in Arrow batches, so files, not
members, are the unit of parallel work."""

from __future__ import annotations

import bz2
import io
import tarfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..functions.clean import chunks
from ..functions.markup import wiki_text
from ..functions.text import squeeze_ends
from ..operators.select import per_group

BOM = "﻿"


def jsonl(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """One JSON object per line. Strict: a malformed line stops the job. Else malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def rejected_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(line): the lines that a permissive read leaves out."""
    bad = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})["_bad"]
    return spark.read.text(path).where(F.trim("value") != "").where(bad.isNotNull()).select(F.col("value").alias("line"))


def files(spark: SparkSession, path: str, glob: str | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(path, length, content) of files below a folder, without those whose path holds a part of ``exclude``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    df = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    for part in exclude:
        df = df.where(~F.contains("path", F.lit(f"/{part}/")))
    return df


def texts(spark: SparkSession, path: str, glob: str | None = None, repair: bool = False, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(path, text, repaired): whole files as UTF-8, without a byte order mark. Invalid bytes stop the job unless
    ``repair``, which puts replacement characters and says so."""
    df = files(spark, path, glob, exclude)
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.make_valid_utf8(F.col("content").cast("string")) if repair else F.validate_utf8(F.col("content").cast("string"))
    return df.select("path", F.regexp_replace(text, f"^{BOM}", "").alias("text"), (~valid).alias("repaired"))


def blank_line_documents(df: DataFrame) -> DataFrame:
    """(path, idx, text): documents separated by blank lines."""
    unified = F.regexp_replace("text", r"\r\n?", "\n")
    parts = F.filter(F.transform(F.split(unified, r"\n[ \t]*\n(?:[ \t]*\n)*"), squeeze_ends), lambda x: x != "")
    return df.select("path", F.posexplode(parts).alias("idx", "text"))


def marked_documents(df: DataFrame) -> DataFrame:
    """(path, idx, text): blocks from a line ``<s>`` to a line ``</s>``; the last may be unterminated. A text without a
    block is one document."""
    unified = F.regexp_replace("text", r"\r\n?", "\n")
    blocks = F.regexp_extract_all(unified, F.lit(r"(?ms)^[ \t]*<s>[ \t]*$.*?(?:^[ \t]*</s>[ \t]*$|\z)"), F.lit(0))
    whole = F.filter(F.array(squeeze_ends(unified)), lambda x: x != "")
    return df.select("path", F.posexplode(F.when(F.size(blocks) > 0, F.transform(blocks, squeeze_ends)).otherwise(whole)).alias("idx", "text"))


def scored_examples(df: DataFrame) -> DataFrame:
    """(path, idx, text): examples separated by a line ``---``, without their score headers."""
    unified = F.regexp_replace("text", r"\r\n?", "\n")
    bare = lambda x: squeeze_ends(F.array_join(F.filter(F.split(x, "\n"), lambda y: ~y.rlike("^# (?:source|score|positives):")), "\n"))
    parts = F.filter(F.transform(F.split(unified, r"\n\s*---\s*\n"), bare), lambda x: x != "")
    return df.select("path", F.posexplode(parts).alias("idx", "text"))


def bucket_examples(df: DataFrame) -> DataFrame:
    """(path, idx, text): examples that each begin at a line ``# bucket:``."""
    parts = F.filter(F.transform(F.split("text", r"(?m)(?=^# bucket: )"), squeeze_ends), lambda x: x != "")
    return df.select("path", F.posexplode(parts).alias("idx", "text"))


def wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, title, text): articles of a MediaWiki dump, plain or bz2: main namespace, no redirect, with text."""
    schema = "title string, ns long, id long, redirect struct<_title: string>, revision struct<id: long, text: struct<_VALUE: string>>"
    pages = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    return pages.where("ns = 0 and redirect is null and revision.text._VALUE is not null").select(F.col("id").alias("page_id"), "title", wiki_text(F.col("revision.text._VALUE")).alias("text")).where("text != ''")


def wiki_paragraphs(spark: SparkSession, path: str, least: int = 40) -> DataFrame:
    """(page_id, revision_id, title, n, paragraph): paragraphs of at least ``least`` characters of the articles of a dump,
    numbered from 0 in page order, with the page and revision they are from. Other namespaces, redirects and pages
    without text are left out."""
    schema = "title string, ns long, id long, redirect struct<_title: string>, revision struct<id: long, text: struct<_VALUE: string>>"
    pages = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path).where("ns = 0 and redirect is null and revision.text._VALUE is not null")
    own = pages.select(F.col("id").alias("page_id"), F.col("revision.id").alias("revision_id"), "title", wiki_text(F.col("revision.text._VALUE")).alias("_t"))
    return own.select("page_id", "revision_id", "title", F.posexplode(chunks(F.col("_t"), least)).alias("n", "paragraph"))


def tar_members(df: DataFrame, suffixes: tuple[str, ...] = (), most: int = 2_000_000, skip: Callable[[str], bool] | None = None) -> DataFrame:
    """(path, member, text) of the regular files of tar archives (any compression): UTF-8, by name, of at most ``most``
    bytes and with one of ``suffixes``. Members that are no UTF-8 have a null text."""
    fields = pa.schema([("path", pa.string()), ("member", pa.string()), ("text", pa.string())])

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as archive:
                    for m in sorted(archive.getmembers(), key=lambda m: m.name):
                        parts = m.name.split("/")
                        if not m.isfile() or m.size > most or m.name.startswith("/") or ".." in parts or suffixes and not m.name.lower().endswith(suffixes) or skip and skip(m.name):
                            continue
                        data = archive.extractfile(m).read()
                        try:
                            rows.append((path, m.name, data.decode("utf-8").removeprefix(BOM)))
                        except UnicodeDecodeError:
                            rows.append((path, m.name, None))
                        if len(rows) >= 500:
                            yield pa.RecordBatch.from_pylist([dict(zip(fields.names, r, strict=True)) for r in rows], schema=fields)
                            rows = []
                yield pa.RecordBatch.from_pylist([dict(zip(fields.names, r, strict=True)) for r in rows], schema=fields)

    return df.select("path", "content").mapInArrow(run, "path string, member string, text string")


# Members of archives that hold text, paths of generated files, suffixes of code and of markup.
TEXT_SUFFIXES = (".md", ".markdown", ".rst", ".txt", ".html", ".htm", ".xml", ".go", ".js", ".mjs", ".cjs")
GENERATED = r"(?i)(?:^|/)(?:vendor|node_modules|third_party|generated|dist|build|testdata|fixtures?)(?:/|$)"
CODE_SUFFIXES, MARKUP_SUFFIXES = (".go", ".js", ".mjs", ".cjs"), (".html", ".htm", ".xml")


def member_sample(members: DataFrame, seed: str, most: int, source: str = "source_id", member: str = "member", within: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``members`` with ``category`` and ``rn``: of each source the ``most`` members that come first by the hash of seed and
    name, among those that hold text by their suffix and lie in no folder of generated files; ``within`` names, for a
    source, the parts of which a path must have one. Code is told from documents by the suffix. Rows with a null source
    or member are left out."""
    path = F.lower(F.replace(member, F.lit("\\"), F.lit("/")))
    suffix = F.regexp_extract(path, r"(\.[^./]*)$", 1)
    fit = suffix.isin(*TEXT_SUFFIXES) & ~path.rlike(GENERATED)
    for name, parts in (within or {}).items():
        inside = F.lit(False)
        for p in parts:
            inside = inside | F.contains(path, F.lit(p))
        fit = fit & ((F.col(source) != name) | inside)
    ranked = members.where(F.col(source).isNotNull() & F.col(member).isNotNull() & fit).withColumn("_k", F.sha2(F.concat(F.lit(seed + ":"), member), 256))
    return per_group(ranked, source, [F.col("_k"), F.col(member)], most).withColumn("category", F.when(suffix.isin(*CODE_SUFFIXES), "code_structured_text").otherwise("technical_documentation")).drop("_k")


def sentence_table(df: DataFrame, member: str = "sentences_detailed.csv") -> DataFrame:
    """(sentence_id, language, text, user) of tab-separated sentence archives: Turkish and English rows that name a
    user; rows of fewer than four fields are left out."""
    rows = tar_members(df, (member,), most=1 << 33).select(F.explode(F.split("text", "\n")).alias("row")).select(F.split("row", "\t").alias("f")).where(F.size("f") >= 4)
    language = F.when(F.get("f", 1) == "tur", "tr").when(F.get("f", 1) == "eng", "en")
    return rows.select(F.get("f", 0).alias("sentence_id"), language.alias("language"), F.get("f", 2).alias("text"), F.trim(F.regexp_replace(F.get("f", 3), "\r$", "")).alias("user")).where("language is not null and user != ''")


def pick_text(*names: str):
    """The first of several columns that holds text."""
    return F.coalesce(*[F.nullif(F.trim(F.col(n)), F.lit("")) for n in names])


def api_results(df: DataFrame, body: str = "body") -> DataFrame:
    """(title, text) of JSON answers: entries of ``results`` or ``response.docs`` with title, description or abstract."""
    entry = "array<struct<title: string, description: string, abstract: array<string>>>"
    parsed = F.from_json(F.col(body), f"struct<results: {entry}, response: struct<docs: {entry}>>")
    e = df.select(F.explode(F.coalesce(parsed["results"], parsed["response"]["docs"])).alias("e"))
    text = F.concat_ws("\n\n", "e.title", F.coalesce("e.description", F.concat_ws("\n", "e.abstract")))
    return e.select(F.col("e.title").alias("title"), text.alias("text")).where(F.trim("text") != "")


def xml_texts(df: DataFrame, body: str = "body") -> DataFrame:
    """``df`` with ``text``: character data of XML; null, and ``failed``, where it can't be parsed."""
    @F.pandas_udf(StringType())
    def inner(s: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            try:
                return " ".join(" ".join(ElementTree.fromstring(t).itertext()).split())
            except ElementTree.ParseError:
                return None

        return s.map(one)

    return df.withColumn("text", inner(F.col(body))).withColumn("failed", F.col("text").isNull() & F.col(body).isNotNull())


def decompressed(df: DataFrame) -> DataFrame:
    """(path, text) of bz2 files read as binary."""
    fields = pa.schema([("path", pa.string()), ("text", pa.string())])

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_pydict({"path": [path], "text": [bz2.decompress(content).decode("utf-8")]}, schema=fields)

    return df.select("path", "content").mapInArrow(run, "path string, text string")


#: Declared formats and how each is read from a session and a path.
READERS = {
    "jsonl": jsonl, "text": texts, "wiki": wiki_pages, "wiki_paragraphs": wiki_paragraphs,
    "blank_lines": lambda spark, path, **o: blank_line_documents(texts(spark, path, **o)), "marked": lambda spark, path, **o: marked_documents(texts(spark, path, **o)), "scored": lambda spark, path, **o: scored_examples(texts(spark, path, **o)), "buckets": lambda spark, path, **o: bucket_examples(texts(spark, path, **o)),
    "tar": lambda spark, path, **o: tar_members(files(spark, path), **o), "sentences": lambda spark, path, **o: sentence_table(files(spark, path), **o), "parquet": lambda spark, path: spark.read.parquet(path),
}


def read(spark: SparkSession, kind: str, path: str, **options) -> DataFrame:
    """Read by declared format; an unknown one is an error that names those there are."""
    if kind not in READERS:
        raise ValueError(f"unknown format {kind!r}: {', '.join(sorted(READERS))}")
    return READERS[kind](spark, path, **options)
