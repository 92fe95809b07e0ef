"""Joins that corpus tools do by hand: by position, by manifest, against a cached result."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .select import global_rank


def zip_by_position(left: DataFrame, right: DataFrame, left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """Rows of two tables side by side, first with first, in their orders: ``position``, struct ``l``, struct ``r``.
    Where one is longer the other side is null, which callers treat as a fault."""
    a = global_rank(left, left_order, "position").select("position", F.struct(*left.columns).alias("l"))
    b = global_rank(right, right_order, "position").select("position", F.struct(*right.columns).alias("r"))
    return a.join(b, "position", "full")


def manifest_faults(expected: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """(key, fault): what a manifest and the files disagree on: missing, unexpected or different."""
    e, a = expected.select(F.col(key).alias("k"), F.col(value).alias("e")), actual.select(F.col(key).alias("k"), F.col(value).alias("a"))
    fault = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "unexpected").when(F.col("e") != F.col("a"), "different")
    return e.join(a, "k", "full").select(F.col("k").alias(key), fault.alias("fault")).where("fault is not null")


def reused(df: DataFrame, name: str, config: dict, root: str | None = None) -> DataFrame:
    """``df`` computed once per configuration: written under the hash of ``config`` and read back wherever the same
    configuration asks for it again. The caller names in ``config`` all that the result depends on."""
    spark = df.sparkSession
    digest = hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:32]
    path = f"{(root or ensure_checkpoint_dir(spark)).rstrip('/')}/reused/{name}-{digest}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
