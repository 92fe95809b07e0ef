"""Sinks of the corpus formats. Spark's commit protocol writes beside the target and renames; an existing target is an
error unless the caller says otherwise."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import pack_uint16, unpack_uint16
from ..functions.text import content_hash
from ..operators.select import pack


def jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """One JSON object per line with sorted keys."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode("append" if append else "errorifexists").text(path)


def append_unseen(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Append the rows whose text the target doesn't hold yet, each text once; returns what was appended (lazily read
    before the write, so callers should count the target instead)."""
    spark = df.sparkSession
    fresh = df.withColumn("_h", content_hash(F.col(text_col))).dropDuplicates(["_h"])
    try:
        held = spark.read.parquet(path).select(content_hash(F.col(text_col)).alias("_h")).distinct()
        fresh = fresh.join(held, "_h", "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    fresh = fresh.drop("_h")
    fresh.write.mode("append").parquet(path)
    return fresh


def partitioned_text(df: DataFrame, path: str, by: str, text_col: str = "text", wrap: bool = False) -> None:
    """One folder of text files per value of ``by``; ``wrap`` puts each text between document marks."""
    value = F.concat(F.lit("<s>\n"), F.col(text_col), F.lit("\n</s>")) if wrap else F.col(text_col)
    df.select(by, value.alias("value")).write.partitionBy(by).text(path)


def token_shards(df: DataFrame, path: str, capacity: int = 5_000_000, split: str = "split", order: str = "doc_id", ids: str = "token_ids") -> DataFrame:
    """Write whole documents into shards of at most ``capacity`` 16-bit tokens and return the boundaries (split,
    doc_id, shard, start_offset, end_offset). The packing fold sees lengths only; token data are shuffled once, to the
    task of their shard, and laid end to end there. A shard is bounded by ``capacity``; a longer document is an error, and
    nothing is written."""
    bounds = pack(df.withColumn("n_tokens", F.size(ids)), capacity, split, order, oversize="raise")
    placed = df.select(F.col(split).cast("string").alias(split), F.col(order).cast("long").alias(order), pack_uint16(F.col(ids)).alias("data")).join(bounds, [split, order])
    fields = pa.schema([(split, pa.string()), ("shard", pa.int32()), ("tokens", pa.int64()), ("payload", pa.binary())])

    def lay(batches):
        at, parts = None, []

        def done():
            data = b"".join(parts)
            return pa.RecordBatch.from_pydict({split: [at[0]], "shard": [at[1]], "tokens": [len(data) // 2], "payload": [data]}, schema=fields)

        for b in batches:
            for r in b.to_pylist():
                own = (r[split], r["shard"])
                if own != at and at is not None:
                    yield done()
                    parts = []
                at = own
                parts.append(r["data"])
        if at is not None:
            yield done()

    shards = placed.repartition(split, "shard").sortWithinPartitions(split, "shard", "start_offset").select(split, "shard", "data").mapInArrow(lay, f"{split} string, shard int, tokens long, payload binary")
    shards.withColumn("sha256", F.sha2("payload", 256)).write.parquet(path)
    return bounds


def read_tokens(spark: SparkSession, path: str, split: str, shard: int, offset: int, count: int):
    """Tokens of a range of one shard."""
    row = spark.read.parquet(path).where((F.col("split") == split) & (F.col("shard") == shard)).select(F.slice(unpack_uint16("payload"), offset + 1, count).alias("ids")).first()
    return row.ids if row else []


def shard_faults(spark: SparkSession, path: str, bounds: DataFrame) -> DataFrame:
    """(split, shard, fault): shards whose hash, size or cover by documents is wrong. Empty when all is well."""
    s = spark.read.parquet(path)
    ends = bounds.groupBy("split", "shard").agg(F.max("end_offset").alias("end"), F.sum(F.col("end_offset") - F.col("start_offset")).alias("held"))
    fault = F.coalesce(
        F.when(F.col("tokens").isNull(), "missing"), F.when(F.sha2("payload", 256) != F.col("sha256"), "hash"), F.when(F.length("payload") != 2 * F.col("tokens"), "size"),
        F.when((F.col("end") != F.col("tokens")) | (F.col("held") != F.col("tokens")), "cover"),
    )
    return ends.join(s, ["split", "shard"], "full").select("split", "shard", fault.alias("fault")).where("fault is not null")
