"""Streams over tables that grow: deduplication with state that survives a restart, and windowed counts."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..session import ensure_checkpoint_dir


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files. A table that is a single file is watched through its folder and name."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    schema = spark.read.parquet(path).schema
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    single = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile()
    reader = spark.readStream.schema(schema)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if single else reader.parquet(path)


def _run(frame: DataFrame, mode: str, root: str | None) -> DataFrame:
    """Run a stream over what is there (available-now trigger) into a table in the shared folder and read that."""
    spark = frame.sparkSession
    root = root or f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    out = f"{root}/out"
    if mode == "append":
        frame.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").option("path", out).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    else:

        def replace(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(out)

        frame.writeStream.foreachBatch(replace).option("checkpointLocation", f"{root}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def deduplicated_stream(spark: SparkSession, sf_dir: str, name: str = "documents", id_col: str = "doc_id", root: str | None = None, within: tuple[str, str] | None = None) -> DataFrame:
    """(h): content hashes, each once over all runs that share ``root``: the state keeps what was seen, for good, as the
    operator promises (it grows with the number of different texts). A run with the same ``root`` appends unseen ones.

    ``within``: an event time column and a delay, such as ("ingested_at", "30 days"): a hash is forgotten once the stream
    is that far past it, which bounds the state; rows later than the delay are dropped by the watermark."""
    rows = _stream(spark, sf_dir, name)
    h = content_hash(F.coalesce("text", F.lit(""))).alias("h")
    if within:
        late = rows.withColumn("_at", F.col(within[0]).cast("timestamp")).withWatermark("_at", within[1])
        return _run(late.select(h, "_at").dropDuplicatesWithinWatermark(["h"]).select("h"), "append", root)
    return _run(rows.select(h).dropDuplicates(["h"]), "append", root)


def hourly_counts(spark: SparkSession, sf_dir: str, root: str | None = None) -> DataFrame:
    """(event_type, hour, n, total) of the events table as a stream."""
    events = _stream(spark, sf_dir, "events").select("event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h"), "value")
    counted = events.groupBy("event_type", "h").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return _run(counted, "complete", root).select("event_type", F.date_format("h", "yyyy-MM-dd HH:mm:ss").alias("hour"), "n", "total")
