"""Problem 8: fill mixes to their size with each source at its wanted share and within its repeats.

The tokens of each source are packed into blocks of fixed length (the texts laid end to end in order of ``doc_id``
hash). A mix has ``size / block`` slots, spread over output shards. The source counts of the whole mix are drawn from a
multinomial distribution; what passes a source's limit (blocks times repeats) is drawn again among the others. The counts
of each output shard follow by splitting those of all shards in two, again and again, without replacement, which gives
multinomial counts per shard and lets every task work out its own shards from the totals alone. The k-th slot of a
source, over all shards, takes block ``permutation_e(k mod n)`` of epoch ``e = k div n``, a keyed pseudorandom permutation
of that source's block indices, so a block is used at most once per epoch and a source at most ``max_repeats`` times.
Slots find their blocks by an equi-join on (source, block index).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tokens import count_tokens

#: The table of targets is collected; more rows than this are refused.
MAX_TARGETS = 100_000
#: Unless told otherwise, a mix has so many output shards at least, and so many that a shard has at most SHARD_SLOTS slots.
LEAST_SHARDS, SHARD_SLOTS = 32, 50_000
#: Shards that a task works out at once; documents of a source in one hash group; standard errors within which a drawn
#: count may still belong to a source that is used up; colours that the exact splitting takes.
CHUNK, GROUP_DOCS, DOUBT, EXACT = 16, 200_000, 6.0, 900_000_000


def unreachable(docs: DataFrame, pieces: DataFrame, targets: DataFrame, block: int = 512, seed: int = 17) -> DataFrame:
    """(mix_id, source, tokens, wanted, at_most): targets whose source can't reach its share within its repeats.

    The mix is drawn: sources whose drawn slots come near their limit of slots are candidates, and the exact numbers of
    tokens decide among these. ``docs`` needs source and text. Null texts count nothing. Rows with null ``source`` count
    in the total only. A target whose source has no document has 0 tokens. A null share, ratio or number of repeats
    counts as 0.
    """
    sized = count_tokens(docs.select("source", "text"), pieces)
    per_source = cut_lineage(sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens")))  # one row per source
    wanted, sizes, total = _sizes(per_source, targets)
    named = [t | {"mix_id": t["mix_id"] or "", "source": t["source"] or ""} for t in wanted]  # null names make a mix of their own
    plans = {(p["mix_id"], p["source"]): p for p in plan_draws(named, sizes, total, block, seed)}
    found = []
    for t, n in zip(wanted, named, strict=True):
        p = plans[n["mix_id"], n["source"]]
        share, ratio, repeats = t["target_share"] or 0.0, t["budget_ratio"] or 0.0, t["max_repeats"] or 0
        # how far below its limit the drawn count may lie by chance, by rounding to blocks and by shares that don't sum to 1
        slack = DOUBT * np.sqrt(p["at_most"] + 1) + repeats + 1 + max(0.0, share - p["chance"]) * p["slots"]
        if p["drawn"] >= p["at_most"] - slack:
            tokens = sizes.get(t["source"], 0)
            at_most, needed = tokens * repeats, share * ratio * total
            if at_most < needed:
                found.append((t["mix_id"], t["source"], tokens, needed, at_most))
    return docs.sparkSession.createDataFrame(found, "mix_id string, source string, tokens long, wanted double, at_most long")


def document_offsets(sized: DataFrame, id_col: str = "doc_id", groups: int | None = None) -> DataFrame:
    """``sized`` with ``start``: tokens of the same source before the document. A source of any size is spread over
    ``groups`` hash groups (their number grows with the table); the running sum is taken within each and shifted by the sums of the groups before it."""
    groups = groups or max(64, -(-sized.count() // GROUP_DOCS))
    salted = sized.where(F.col("source").isNotNull()).withColumn("_g", F.pmod(F.xxhash64(id_col), F.lit(groups)).cast("int"))
    sums = salted.groupBy("source", "_g").agg(F.sum("n_tokens").alias("_t"))
    before = Window.partitionBy("source").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)  # at most ``groups`` rows
    sums = sums.select("source", "_g", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("source", "_g").orderBy(F.xxhash64(id_col, F.lit(7)), id_col).rowsBetween(Window.unboundedPreceding, -1)
    return (
        salted.withColumn("_run", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
        .join(sums, ["source", "_g"])
        .withColumn("start", F.col("_base") + F.col("_run"))
        .drop("_g", "_base", "_run")
    )


def pack_blocks(sized: DataFrame, block: int = 512, groups: int | None = None) -> DataFrame:
    """(source, block_index, doc_id, from_token, to_token): which part of which document lies in which block; the part
    is the half-open range of the document's own tokens. The last block of a source may be short."""
    placed = document_offsets(sized.where("n_tokens > 0"), groups=groups)
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("n_tokens") - 1) / block)
    return placed.withColumn("block_index", F.explode(F.sequence(first, last))).select(
        "source", "block_index", "doc_id",
        F.greatest(F.col("block_index") * block - F.col("start"), F.lit(0)).alias("from_token"),
        F.least((F.col("block_index") + 1) * block - F.col("start"), F.col("n_tokens")).alias("to_token"),
    )


def _permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 without a table: a Feistel network on the next even power of two, walked
    until the value falls below ``n``."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(key).integers(1, 2**63, 4, dtype=np.uint64) | np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys:
            f = (right + np.uint64(1)) * k
            f ^= f >> np.uint64(31)
            f = (f * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
            left, right = right, left ^ (f & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = out >= n
    return out.astype(np.int64)


def plan_draws(targets: list[dict], sizes: dict[str, int], total: int, block: int, seed: int) -> list[dict]:
    """Of each mix and source: target share, chance (its part of all shares), slots of the mix, blocks and limit of slots
    of the source, ``drawn`` slots, and ``taken`` slots.

    ``drawn`` is multinomial over the target shares. Where it passes a source's limit (blocks times repeats), the surplus
    is drawn again among the sources with room, by their shares, until all slots are filled or no source has room; the
    mix then stays short. A repeated target counts once, with its largest share.
    """
    plans = []
    by_mix: dict[str, list[dict]] = {}
    for t in targets:
        if t["mix_id"] is not None and t["source"] is not None:
            by_mix.setdefault(t["mix_id"], []).append(t)
    for mix_id, rows in sorted(by_mix.items()):
        rows = sorted({r["source"]: r for r in sorted(rows, key=lambda r: (r["source"], r["target_share"] or 0))}.values(), key=lambda r: r["source"])
        ratio = max((r["budget_ratio"] or 0.0) for r in rows)
        slots = left = round(ratio * total / block)
        share = np.array([max(r["target_share"] or 0.0, 0.0) for r in rows])
        repeats = np.array([max(r["max_repeats"] or 0, 0) for r in rows], np.int64)
        blocks = np.array([-(-sizes.get(r["source"], 0) // block) for r in rows], np.int64)
        limit = blocks * repeats
        rng = np.random.default_rng([seed, *mix_id.encode()])
        first, taken = None, np.zeros(len(rows), np.int64)
        while left:
            p = share if first is None else np.where(limit > taken, share, 0.0)
            if p.sum() <= 0:
                break
            new = rng.multinomial(left, p / p.sum())
            first = new if first is None else first
            new = np.minimum(new, limit - taken)
            taken = taken + new
            left -= int(new.sum())
        first = np.zeros(len(rows), np.int64) if first is None else first
        for i, r in enumerate(rows):
            plans.append({
                "mix_id": mix_id, "source": r["source"], "target_share": float(share[i]), "budget_ratio": r["budget_ratio"] or 0.0, "max_repeats": int(repeats[i]), "chance": float(share[i] / max(share.sum(), 1e-300)),
                "slots": int(slots), "blocks": int(blocks[i]), "at_most": int(limit[i]), "drawn": int(first[i]), "taken": int(taken[i]),
            })
    return plans


def _split(counts: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """``n`` slots of ``counts`` drawn without replacement. Beyond what the exact draw takes, whole shares are dealt out
    first and the rest is drawn."""
    total = int(counts.sum())
    if total <= EXACT:
        return rng.multivariate_hypergeometric(counts, n, method="marginals")
    part = np.array([int(c) * n // total for c in counts.tolist()], np.int64)
    while (rest := n - int(part.sum())) > 0:  # at most one slot a source is left
        part += np.minimum(counts - part, rng.multinomial(rest, counts / total))
    return part


def shard_counts(counts: np.ndarray, shards: int, low: int, high: int, key: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each source in the shards from ``low`` up to ``high``, and in all shards before ``low``: the path from all
    shards down to these, each step seeded by ``key`` and its range, so that every task finds the same numbers."""
    total = int(counts.sum())
    before = lambda i: i * (total // shards) + min(i, total % shards)  # noqa: E731  slots of the first i shards
    out = np.zeros((high - low, len(counts)), np.int64)
    ahead = None
    waiting = [(0, shards, counts, np.zeros(len(counts), np.int64))]
    while waiting:
        a, b, own, earlier = waiting.pop()
        if b <= low or a >= high:
            continue
        if a == low and ahead is None:
            ahead = earlier
        if b - a == 1:
            out[a - low] = own
            continue
        mid = (a + b) // 2
        left = _split(own, before(mid) - before(a), np.random.default_rng([*key, a, b]))
        waiting += [(a, mid, left, earlier), (mid, b, own - left, earlier + left)]
    return out, np.zeros(len(counts), np.int64) if ahead is None else ahead


def _collected(targets: DataFrame) -> list[dict]:
    rows = targets.select("mix_id", "source", "target_share", "max_repeats", "budget_ratio").distinct().limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    return [r.asDict() for r in rows]


def _sizes(per_source: DataFrame, targets: DataFrame) -> tuple[list[dict], dict[str, int], int]:
    """Targets, tokens of their sources, tokens of all sources."""
    wanted = _collected(targets)
    total = per_source.agg(F.sum("tokens")).first()[0] or 0
    names = targets.select("source").distinct()
    return wanted, {r.source: r.tokens or 0 for r in per_source.join(names, "source", "left_semi").collect()}, total  # at most MAX_TARGETS rows


def _plans(sized: DataFrame, targets: DataFrame, block: int, shards: int | None, seed: int) -> tuple[list[dict], int]:
    wanted, sizes, total = _sizes(sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), targets)
    plans = plan_draws(wanted, sizes, total, block, seed)
    return plans, shards or max(LEAST_SHARDS, -(-max((p["slots"] for p in plans), default=0) // SHARD_SLOTS))


def mix_slots(sized: DataFrame, targets: DataFrame, block: int = 512, shards: int | None = None, seed: int = 17, planned: tuple[list[dict], int] | None = None) -> DataFrame:
    """(mix_id, shard, source, draw, repeat, block_index): every slot of every mix and the block it takes."""
    spark = sized.sparkSession
    plans, shards = planned or _plans(sized, targets, block, shards, seed)
    by_mix: dict[str, list[dict]] = {}
    for p in plans:
        by_mix.setdefault(p["mix_id"], []).append(p)
    shared = spark.sparkContext.broadcast(sorted(by_mix.items()))  # at most MAX_TARGETS plans
    chunks = -(-shards // CHUNK)
    fields = pa.schema([("mix_id", pa.string()), ("shard", pa.int32()), ("source", pa.string()), ("draw", pa.int64()), ("repeat", pa.int64()), ("block_index", pa.int64())])

    def slots(batches):
        for b in batches:
            for at in b.column(0).to_pylist():
                mix_id, own = shared.value[at // chunks]
                low = at % chunks * CHUNK
                high = min(shards, low + CHUNK)
                taken, first = shard_counts(np.array([p["taken"] for p in own], np.int64), shards, low, high, [seed, *mix_id.encode()])
                for shard in range(low, high):
                    for p, n, k in zip(own, taken[shard - low].tolist(), first.tolist(), strict=True):
                        if n:
                            yield _slots(mix_id, shard, p["source"], k, n, p["blocks"], seed, fields)
                    first = first + taken[shard - low]

    work = spark.range(len(by_mix) * chunks, numPartitions=max(1, min(len(by_mix) * chunks, 4096)))
    return work.mapInArrow(slots, "mix_id string, shard int, source string, draw long, repeat long, block_index long")


def _slots(mix_id: str, shard: int, source: str, first: int, n: int, blocks: int, seed: int, fields: pa.Schema) -> pa.RecordBatch:
    draw = np.arange(first, first + n)
    epoch, at = draw // blocks, draw % blocks
    index = np.empty(n, np.int64)
    for e in np.unique(epoch):
        key = int(np.random.SeedSequence([seed, int(e), *mix_id.encode(), 0, *source.encode()]).generate_state(1)[0])
        index[epoch == e] = _permute(at[epoch == e], blocks, key)
    return pa.RecordBatch.from_pydict({"mix_id": [mix_id] * n, "shard": [shard] * n, "source": [source] * n, "draw": draw, "repeat": epoch, "block_index": index}, schema=fields)


def fill_mixes(docs: DataFrame, pieces: DataFrame, targets: DataFrame, block: int = 512, shards: int | None = None, seed: int = 17) -> DataFrame:
    """(mix_id, shard, source, draw, repeat, block_index, doc_id, from_token, to_token): the mixes, one row per
    document part of each slot. Documents need doc_id, source, text; rows with a null source or text give nothing."""
    sized = cut_lineage(count_tokens(docs.select("doc_id", "source", "text"), pieces).where("n_tokens is not null"))
    return mix_slots(sized, targets, block, shards, seed).join(pack_blocks(sized, block), ["source", "block_index"]).select("mix_id", "shard", "source", "draw", "repeat", "block_index", "doc_id", "from_token", "to_token")


def mix_shares(docs: DataFrame, pieces: DataFrame, targets: DataFrame, block: int = 512, shards: int | None = None, seed: int = 17) -> DataFrame:
    """(mix_id, source, target_share, tokens, share, deviation, drawn_slots, redrawn_slots, most_repeats): tokens each
    source really contributes to each mix, its share of the mix's filled size and how far that is from the target; slots
    from the first draw and slots that fell to it because other sources were used up; how often its most used block is
    taken. A source without a slot has 0."""
    sized = cut_lineage(count_tokens(docs.select("doc_id", "source", "text"), pieces).where("n_tokens is not null"))
    plans, shards = _plans(sized, targets, block, shards, seed)
    filled = mix_slots(sized, targets, block, seed=seed, planned=(plans, shards)).join(pack_blocks(sized, block), ["source", "block_index"])
    got = filled.groupBy("mix_id", "source").agg(F.sum(F.col("to_token") - F.col("from_token")).alias("tokens"), (F.max("repeat") + 1).alias("most_repeats"))
    planned = [(p["mix_id"], p["source"], p["target_share"], min(p["drawn"], p["taken"]), max(0, p["taken"] - p["drawn"])) for p in plans]
    wanted = docs.sparkSession.createDataFrame(planned, "mix_id string, source string, target_share double, drawn_slots long, redrawn_slots long")
    out = wanted.join(got, ["mix_id", "source"], "left").fillna(0, ["tokens", "most_repeats"])
    whole = F.sum("tokens").over(Window.partitionBy("mix_id"))
    out = out.withColumn("share", F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0))
    return out.select("mix_id", "source", "target_share", "tokens", "share", (F.col("share") - F.col("target_share")).alias("deviation"), "drawn_slots", "redrawn_slots", "most_repeats")
