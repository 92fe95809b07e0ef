"""Session helpers: defaults for local runs, the shared checkpoint folder, table loading."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine. On a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quernel")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: what ``spark.checkpoint.dir`` names. Only a session that runs in one
    machine (master ``local``) and names none gets a temporary folder of its own."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="quernel-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from there, so that a result used by several
    branches is computed once and survives the loss of an executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str, *columns) -> DataFrame:
    """One parquet table of a folder, pruned to ``columns`` when given."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*columns) if columns else df


#: Tables up to this size are spread over all cores before costly work on their texts.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table over all cores: its file may be one row group, which one task reads. Larger tables stay as they are,
    as they are read by enough tasks and a shuffle of their texts would cost more."""
    bytes_read = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if bytes_read <= SPREAD_BYTES else df


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` written once and, if it has at most ``rows`` rows, marked for broadcast; larger it joins by shuffle."""
    from pyspark.sql import functions as F

    held = cut_lineage(df)
    return F.broadcast(held) if held.limit(rows + 1).count() <= rows else held
