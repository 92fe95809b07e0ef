"""Ranks, running sums, budgets, splits and packing over whole tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def running(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """``df`` with ``name``: sum of ``value`` over all rows before, in a global order. The order is spread by range; each
    part sums its own rows and adds what the parts before it hold, so no task sees all rows."""
    parts = cut_lineage(df.withColumn("_v", value).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()))
    sums = parts.groupBy("_p").agg(F.sum("_v").alias("_s"))  # one row per part
    base = sums.select("_p", (F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_s")).alias("_b"))
    within = F.coalesce(F.sum("_v").over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("_w", within).join(F.broadcast(base), "_p").withColumn(name, F.col("_b") + F.col("_w")).drop("_p", "_v", "_w", "_b")


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with ``name``: position in a global order, from 0."""
    return running(df, order, F.lit(1).cast("long"), name)


def group_rank(df: DataFrame, group: str, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with ``name``: position within its group, from 0. The rows are ordered globally by group and order, so a
    large group is spread over many tasks; its own first position is taken off."""
    ranked = global_rank(df, [F.col(group), *order], "_g")
    first = ranked.groupBy(group).agg(F.min("_g").alias("_f")).withColumnRenamed(group, "_k")
    return ranked.join(first, F.col(group).eqNullSafe(F.col("_k"))).withColumn(name, F.col("_g") - F.col("_f")).drop("_g", "_f", "_k")


def rank_split(df: DataFrame, key: Column, shares: tuple[int, int] = (98, 1)) -> DataFrame:
    """``df`` with ``split``: train, validation and eval by rank of ``key`` (percent of the rows, rounded down)."""
    ranked = global_rank(df.withColumn("_key", key), [F.col("_key")], "_r")
    total = df.agg(F.count("*").alias("_n"))
    train, val = F.floor(F.col("_n") * shares[0] / 100), F.floor(F.col("_n") * (shares[0] + shares[1]) / 100)
    split = F.when(F.col("_r") < train, "train").when(F.col("_r") < val, "validation").otherwise("eval")
    return ranked.join(F.broadcast(total)).withColumn("split", split).drop("_key", "_r", "_n")


def per_group(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group with ``rn``; the window keeps ``n`` rows per group before the shuffle."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rn") <= n)


def quota_fill(df: DataFrame, group: str, id_col: str, counts: dict[str, int], total: int, no_fill: tuple[str, ...] = (), seed: str = "", fill_seed: str = "") -> DataFrame:
    """(id, group, part): up to ``counts`` rows of each group in seeded order (part quota), then, up to ``total`` rows in
    all, the first of the rest in another seeded order (fill), without the groups of ``no_fill``. Groups without a count
    only fill up. ``total`` bounds what is picked in one order, so it should be far below the table."""
    key = lambda s: F.sha2(F.concat(F.lit(s), F.col(id_col).cast("string")), 256)
    most = F.coalesce(F.create_map(*[F.lit(x) for kv in counts.items() for x in kv])[F.col(group)], F.lit(0))
    first = cut_lineage(per_group(df.select(id_col, group).withColumn("_k", key(seed)), group, [F.col("_k"), F.col(id_col)], max(counts.values())).where(F.col("rn") <= most).select(id_col, group))
    free = max(0, total - first.count())
    rest = df.select(id_col, group).where(~F.coalesce(F.col(group), F.lit("")).isin(*no_fill)).join(first.select(id_col), id_col, "left_anti")
    fill = rest.orderBy(key(fill_seed), id_col).limit(free)
    return first.withColumn("part", F.lit("quota")).union(fill.withColumn("part", F.lit("fill")))


def _folded(df: DataFrame, group: str, order: str, size: str, step, more: list[tuple[str, pa.DataType]], sort: list[str] | None = None) -> DataFrame:
    """Run a fold over the rows of each group in order: ``step(state, sizes)`` gets the sizes of the next rows as an array
    and returns the places of the rows that come out and their further columns. A fold depends on every row before, so
    one task walks a group; only its id, order and size are read, batch by batch, in arrays, and one state is held. Rows
    with a null size are left out. The order is that of ``order``, the id, or of the columns of ``sort`` before it."""
    fields = pa.schema([(group, pa.string()), (order, pa.int64()), *more])

    def run(batches):
        at, state = None, None
        for b in batches:
            names, ids, sizes = b.column(0), b.column(1), b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            codes = names.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)] if len(codes) else []
            for low, high in zip(edges, edges[1:], strict=False):
                name = (names[low].as_py(),)
                if name != at:
                    at, state = name, {}
                places, columns = step(state, sizes[low:high])
                if len(places):
                    taken = pa.array(places + low)
                    yield pa.RecordBatch.from_arrays([names.take(taken), ids.take(taken), *[pa.array(c, kind) for c, (_, kind) in zip(columns, more, strict=True)]], schema=fields)

    rows = df.select(F.col(group).cast("string").alias(group), F.col(order).cast("long").alias(order), F.col(size).cast("long").alias(size), *(sort or [])).where(F.col(size).isNotNull())
    kinds = {pa.int32(): "int", pa.int64(): "long"}
    return rows.repartition(group).sortWithinPartitions(group, *(sort or []), order).select(group, order, size).mapInArrow(run, f"`{group}` string, `{order}` long, " + ", ".join(f"{n} {kinds[k]}" for n, k in more))


def budget(df: DataFrame, target: int, maximum: int, group: str = "source", order: str = "doc_id", size: str = "n_tokens", sort: list[str] | None = None) -> DataFrame:
    """(group, id, running): rows picked per group in order until the sum reaches ``target``; a row that would pass
    ``maximum`` is skipped, later smaller ones may still fit. Null sizes are skipped. ``sort``: columns that order rows before the id."""

    def step(state: dict, sizes: np.ndarray):
        total, places, sums = state.get("total", 0), [], []
        left = np.arange(len(sizes))
        while total < target and len(left):
            left = left[sizes[left] <= maximum - total]  # what is too long now never fits
            run = total + np.cumsum(sizes[left])
            fit = int(np.searchsorted(run, maximum, "right"))
            fit = min(fit, int(np.searchsorted(run, target, "left")) + 1)
            if not fit:
                break
            places.append(left[:fit])
            sums.append(run[:fit])
            total, left = int(run[fit - 1]), left[fit:]
        state["total"] = total
        none = np.empty(0, np.int64)
        return (np.concatenate(places), [np.concatenate(sums)]) if places else (none, [none])

    return _folded(df, group, order, size, step, [("running", pa.int64())], sort)


def pack(df: DataFrame, capacity: int, group: str = "split", order: str = "doc_id", size: str = "n_tokens", oversize: str = "skip") -> DataFrame:
    """(group, id, shard, start_offset, end_offset): next-fit packing of whole documents into shards of at most
    ``capacity`` tokens; a document that doesn't fit the rest of a shard opens the next. A longer one than a shard gets
    one of its own that exceeds ``capacity`` (``oversize`` own), is an error that names the number of such documents
    (raise), or is left out and found by the caller in an anti-join (skip). Null sizes are left out."""
    if oversize not in ("own", "raise", "skip"):
        raise ValueError(f"oversize is own, raise or skip, not {oversize}")
    if oversize == "raise" and (n := df.where(F.col(size) > capacity).count()):
        raise ValueError(f"{n} documents are longer than a shard of {capacity}")

    def step(state: dict, sizes: np.ndarray):
        places = np.arange(len(sizes)) if oversize == "own" else np.flatnonzero(sizes <= capacity)
        own = sizes[places]
        ends = np.cumsum(own)
        shard, used = state.get("shard", 0), state.get("used", 0)
        shards, starts = np.empty(len(own), np.int32), np.empty(len(own), np.int64)
        at = 0
        while at < len(own):  # a jump per shard
            done = int(ends[at - 1]) if at else 0
            stop = int(np.searchsorted(ends, done + capacity - used, "right"))
            if stop <= at:
                if used:
                    shard, used = shard + 1, 0
                    continue
                stop = at + 1
            shards[at:stop] = shard
            starts[at:stop] = used + (ends[at:stop] - own[at:stop]) - done
            used += int(ends[stop - 1]) - done
            at = stop
        state["shard"], state["used"] = shard, used
        return places, [shards, starts, starts + own]

    return _folded(df, group, order, size, step, [("shard", pa.int32()), ("start_offset", pa.int64()), ("end_offset", pa.int64())])


def gaps(bounds: DataFrame, group: list[str], start: str = "start_offset", end: str = "end_offset") -> DataFrame:
    """Intervals that don't begin where the one before ends (the first at 0). Empty when the cover is complete."""
    before = F.lag(end, 1, 0).over(Window.partitionBy(*group).orderBy(start))
    return bounds.withColumn("expected", before).where(F.col("expected") != F.col(start))


def window_overlap(spans: DataFrame, width: int, keys: list[str], start: str = "start_offset", end: str = "end_offset") -> DataFrame:
    """(seq, keys..., overlap): how much of each fixed window the spans with equal keys cover. Spans are cut at window
    borders, which turns the range join into a plain aggregate."""
    s = spans.where(F.col(end) > F.col(start)).withColumn("seq", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    part = F.least(F.col(end), (F.col("seq") + 1) * width) - F.greatest(F.col(start), F.col("seq") * width)
    return s.groupBy("seq", *keys).agg(F.sum(part).alias("overlap"))


def dominant(overlaps: DataFrame, key: str) -> DataFrame:
    """(seq, key): the key with the largest overlap of each window, ties by name."""
    return overlaps.groupBy("seq").agg(F.min_by(key, F.struct(-F.col("overlap"), F.col(key))).alias(key))


def longest_runs(df: DataFrame, order: str, value: str) -> DataFrame:
    """(value, run): longest unbroken run of each value over dense integer positions. A run begins where the value
    differs from that one position before (an equi-join), and is named by the number of beginnings up to it."""
    pos = df.select(F.col(order).cast("long").alias("_o"), F.col(value).alias(value))
    prev = pos.select((F.col("_o") + 1).alias("_o"), F.col(value).alias("_prev"), F.lit(True).alias("_had"))
    begins = pos.join(prev, "_o", "left").withColumn("_begin", (F.col("_had").isNull() | ~F.col(value).eqNullSafe(F.col("_prev"))).cast("long"))
    named = running(begins, [F.col("_o")], F.col("_begin"), "_before").withColumn("_run", F.col("_before") + F.col("_begin"))
    return named.groupBy("_run", value).agg(F.count("*").alias("run")).groupBy(value).agg(F.max("run").alias("run"))
