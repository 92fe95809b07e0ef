"""Selection under budgets: refill after duplicates, allocation over sources, targets in several dimensions, orders."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .select import budget, per_group

MAX_SOURCES, MAX_GROUPS = 1_000, 10_000


def unique_budget(df: DataFrame, target: int, maximum: int, source: str = "source", id_col: str = "doc_id", size: str = "n_tokens", content: str = "h", order: str = "k") -> tuple[DataFrame, DataFrame]:
    """``(picked, refused)``. Sources are filled one after the other, by name, each up to ``target`` and never past
    ``maximum``, its rows in the order of ``order`` and id. A row whose content was picked before, in this source or an
    earlier one, is refused and takes nothing of the budget, so later rows fill up. ``picked``: (source, id, running);
    ``refused``: (source, id, representative_id) of all rows of filled sources whose content an earlier source's pick
    holds. Rows without a source, id or content are left out.

    A source depends on the picks of those before it, so there are as many rounds as sources (at most ``MAX_SOURCES``);
    within one, contents are told apart by an aggregate and only ids and sizes go through the ordered fold.
    """
    rows = df.where(F.col(source).isNotNull() & F.col(id_col).isNotNull() & F.col(content).isNotNull()).select(F.col(source).alias("s"), F.col(id_col).cast("long").alias("id"), F.col(size).cast("long").alias("n"), F.col(content).alias("h"), F.col(order).alias("k"))
    # of equal contents of a source the first in order is the one that may be picked: what doesn't fit then never fits later
    first = cut_lineage(rows.groupBy("s", "h").agg(F.min(F.struct("k", "id", "n")).alias("f")).select("s", "h", "f.*"))
    names = [r.s for r in first.select("s").distinct().orderBy("s").limit(MAX_SOURCES + 1).collect()]
    if len(names) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    picked = None
    for name in names:
        own = first.where(F.col("s") == name)
        if picked is not None:
            own = own.join(picked.select("h"), "h", "left_anti")
        got = cut_lineage(budget(own, target, maximum, group="s", order="id", size="n", sort=["k"]).join(own.select("id", "h"), "id").select("s", "id", "running", "h"))
        picked = got if picked is None else picked.union(got)
    if picked is None:
        picked = df.sparkSession.createDataFrame([], "s string, id long, running long, h string")
    # contents are picked once, so each names its pick; a source by a later name is refused what an earlier one has
    refused = rows.join(picked.select("h", F.col("s").alias("by"), F.col("id").alias("representative_id")), "h").where("by < s")
    return picked.select(F.col("s").alias(source), F.col("id").alias(id_col), "running"), refused.select(F.col("s").alias(source), F.col("id").alias(id_col), "representative_id")


def allocation(available: DataFrame, targets: dict[str, int], cap: int) -> DataFrame:
    """(source, lang, available, allocated) of columns source, lang, available, one row each: each language's target is
    filled from its dedicated sources (those with no other language) by name, then from mixed ones, none beyond ``cap``
    over all languages, languages in the order of ``targets``. A few rows: sources times languages."""
    names = list(targets)
    a = available.where(F.col("lang").isin(*names)).groupBy("source", "lang").agg(F.sum("available").alias("available"))
    wide = a.groupBy("source").pivot("lang", names).agg(F.first("available"))
    wide = wide.select("source", *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names], F.lit(0).cast("long").alias("used"))
    mixed = sum((F.when(F.col(n) > 0, 1).otherwise(0) for n in names), F.lit(0)) > 1
    wide = wide.withColumn("mixed", mixed)
    for n in names:
        most = F.least(F.col(n), F.lit(cap) - F.col("used"))
        before = F.coalesce(F.sum(F.col("most")).over(Window.partitionBy().orderBy("mixed", "source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per source
        wide = wide.withColumn("most", most).withColumn(f"got_{n}", F.greatest(F.lit(0), F.least(F.col("most"), F.lit(targets[n]) - before))).withColumn("used", F.col("used") + F.col(f"got_{n}")).drop("most")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("lang"), F.col(n).alias("available"), F.col(f"got_{n}").cast("long").alias("allocated")) for n in names]))
    return wide.select("source", each.alias("e")).select("source", "e.*").where("available > 0")


def target_counts(df: DataFrame, id_col: str, order: Column, targets: dict[str, dict[str, int]]) -> DataFrame:
    """(id, rank): rows taken in ``order`` (ties by id) while each of their values, one per column of ``targets``, is
    below its target; values without a target are never taken.

    Counts only grow, so of rows with the same values those taken are the first ones, at most as many as the least of
    their targets: only these go through the ordered walk, whatever the table's size.
    """
    columns = list(targets)
    most = F.least(*[F.create_map(*[F.lit(x) for kv in targets[c].items() for x in kv])[F.col(c)] for c in columns]) if len(columns) > 1 else F.create_map(*[F.lit(x) for kv in targets[columns[0]].items() for x in kv])[F.col(columns[0])]
    known = df.select(id_col, *columns, order.alias("_k"), most.alias("_m"))
    for c in columns:
        known = known.where(F.col(c).isin(*targets[c]))
    first = per_group(known.withColumn("_g", F.struct(*columns)), "_g", [F.col("_k"), F.col(id_col)], max(max(t.values(), default=0) for t in targets.values())).where(F.col("rn") <= F.col("_m"))
    fields = pa.schema([(id_col, pa.int64()), ("rank", pa.int64())])

    def walk(batches):
        left = {c: dict(t) for c, t in targets.items()}
        taken = 0
        for b in batches:
            out = []
            for row in zip(*[b.column(j).to_pylist() for j in range(b.num_columns)], strict=True):
                if all(left[c][v] > 0 for c, v in zip(columns, row[1:], strict=True)):
                    for c, v in zip(columns, row[1:], strict=True):
                        left[c][v] -= 1
                    out.append((row[0], taken))
                    taken += 1
            yield pa.RecordBatch.from_pydict({id_col: [o[0] for o in out], "rank": [o[1] for o in out]}, schema=fields)

    ordered = first.select(F.col(id_col).cast("long").alias(id_col), *columns, "_k").repartition(1).sortWithinPartitions("_k", id_col).select(id_col, *columns)
    return ordered.mapInArrow(walk, f"`{id_col}` long, rank long")


def interleaved(df: DataFrame, group: str, id_col: str, seed: str) -> DataFrame:
    """(position, group, id): rows of all groups in one order, at each place from the group that lags furthest behind its
    share so far, not the one before where groups tie, then by a hash of its name; within a group by a hash of the id.
    Null groups are named ''.

    Which group stands at a place depends on the groups' sizes alone: one task writes that column of places, holding a
    counter per group (at most ``MAX_GROUPS``), and the rows are joined to it by group and rank.
    """
    from .select import group_rank

    named = df.select(F.coalesce(F.col(group).cast("string"), F.lit("")).alias("g"), F.col(id_col).alias("id"))
    sizes = [(r.g, r.n) for r in named.groupBy("g").agg(F.count("*").alias("n"), F.first(F.sha2(F.concat(F.lit("tie|" + seed + "|"), "g"), 256)).alias("t")).orderBy("t").limit(MAX_GROUPS + 1).collect()]
    if len(sizes) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups")
    fields = pa.schema([("position", pa.int64()), ("g", pa.string()), ("rank", pa.int64())])

    def places(_):
        n = np.array([k for _, k in sizes], np.float64)
        used, total, last = np.zeros(len(n)), n.sum(), -1
        at, which, rank = [], [], []
        for position in range(int(total)):
            behind = np.where(used < n, (position + 1) * n / total - used, -np.inf)
            best = np.flatnonzero(behind == behind.max())
            pick = int(best[1]) if len(best) > 1 and best[0] == last else int(best[0])
            at.append(position)
            which.append(sizes[pick][0])
            rank.append(int(used[pick]))
            used[pick] += 1
            last = pick
            if len(at) == 10_000:
                yield pa.RecordBatch.from_pydict({"position": at, "g": which, "rank": rank}, schema=fields)
                at, which, rank = [], [], []
        yield pa.RecordBatch.from_pydict({"position": at, "g": which, "rank": rank}, schema=fields)

    column = df.sparkSession.range(1, numPartitions=1).mapInArrow(places, "position long, g string, rank long")
    ranked = group_rank(named.withColumn("k", F.sha2(F.concat(F.lit(seed + "|"), F.col("id").cast("string")), 256)), "g", [F.col("k"), F.col("id")], "rank")
    return column.join(ranked, ["g", "rank"]).select("position", F.col("g").alias(group), F.col("id").alias(id_col))
