"""Similarity joins: exact Jaccard over shingles with a prefix filter, SimHash with band equi-joins, n-gram overlap."""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_key, shingles, words
from ..session import cut_lineage, small

TOKENS = "[A-Za-zÇĞİÖŞÜçğıöşü0-9]+"


def shingle_sets(df: DataFrame, id_col: str, text_col: str, k: int, pattern: str = TOKENS) -> DataFrame:
    """(id, s): distinct shingle hashes of each text, sorted; a text without a token has an empty set."""
    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.array_sort(F.array_distinct(F.transform(shingles(words(F.coalesce(F.col(text_col), F.lit("")), pattern), k), lambda x: F.xxhash64(x)))).alias("s"))


def jaccard_links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.85, pattern: str = TOKENS) -> DataFrame:
    """(kind, a, b, jaccard), a < b; nothing is approximate. ``copy``: b has the same shingles as a, the smallest such id;
    ``link``: two such smallest ids whose texts have a Jaccard index of at least ``threshold``. So n copies give n - 1
    rows, and texts without a token, similar by definition, are copies of the first of them.

    Only shingles that occur twice can be shared. Of those a text's prefix, what remains of its ``n - ceil(t * n) + 1``
    rarest shingles after those that occur once, must hold one that a similar text has too: only prefixes are joined.
    """
    sets = cut_lineage(shingle_sets(df, id_col, text_col, k, pattern).withColumns({"h1": F.xxhash64("s"), "h2": F.xxhash64("s", F.lit(7)), "n": F.size("s")}))
    classes = sets.groupBy("h1", "h2", "n").agg(F.min("id").alias("first"))
    member = sets.select("id", "h1", "h2", "n").join(classes, ["h1", "h2", "n"])
    copies = member.where("id != first").select(F.lit("copy").alias("kind"), F.col("first").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("jaccard")).distinct()
    own = sets.where("n > 0").join(classes.select(F.col("first").alias("id")), "id", "left_semi").dropDuplicates(["id"]).select("id", "n", F.explode("s").alias("s"))
    own = cut_lineage(own)
    shared = own.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    kept = own.join(shared, "s").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("o"))  # a text's own shingles
    size = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1 - (F.col("n") - F.size("o"))
    kept = cut_lineage(kept.withColumn("p", size.cast("int")).where("p > 0").select("id", "n", F.transform("o", lambda x: x["s"]).alias("all"), F.transform(F.slice("o", 1, F.col("p")), lambda x: x["s"]).alias("prefix")))
    keys = kept.select("id", "n", F.explode("prefix").alias("key"))
    a, b = keys.alias("a"), keys.alias("b")
    fit = (F.col("a.n") >= threshold * F.col("b.n") - 1e-9) & (F.col("b.n") >= threshold * F.col("a.n") - 1e-9)
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & fit).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    left = kept.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("all").alias("sa"))
    right = kept.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("all").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    exact = pairs.join(left, "a").join(right, "b").select(F.lit("link").alias("kind"), "a", "b", (common / (F.col("na") + F.col("nb") - common)).alias("jaccard")).where(F.col("jaccard") >= threshold)
    return exact.union(copies)


def _blake(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")


def _md5(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()[:8], "little")


#: 64-bit hashes of shingles. blake2b is the corpus project's own; md5 is what SQL has too.
HASHES = {"blake2b": _blake, "md5": _md5}


def simhash(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, hasher: str = "blake2b") -> DataFrame:
    """(id, h): SimHash of 64 bits over the word shingles of a text, each counted as often as it occurs; ties vote 1; no
    word gives 0."""
    sets = df.select(F.col(id_col).cast("long").alias("id"), shingles(words(F.coalesce(F.col(text_col), F.lit("")), r"\p{L}+"), k).alias("s"))
    fields = pa.schema([("id", pa.int64()), ("h", pa.int64())])

    def vote(batches):
        made: dict[str, int] = {}
        own = HASHES[hasher]
        for b in batches:
            ids, lists = b.column(0), b.column(1)
            flat, starts = lists.flatten().to_pylist(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
            if len(made) > 1_000_000:
                made.clear()
            values = np.fromiter((made[x] if x in made else made.setdefault(x, own(x)) for x in flat), np.uint64, len(flat))
            bits = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            out = np.zeros(len(ids), np.uint64)
            for i, (low, high) in enumerate(zip(starts, starts[1:], strict=False)):
                if high > low:
                    out[i] = np.packbits(2 * bits[low:high].sum(0, dtype=np.int64) >= high - low).view(">u8")[0]
            yield pa.RecordBatch.from_arrays([ids, pa.array(out.view(np.int64))], schema=fields)

    return sets.mapInArrow(vote, "id long, h long")


#: Six bands of the 64 bits; up to three flipped bits leave three bands untouched.
_BANDS = tuple(((1 << n) - 1) << at for n, at in ((11, 0), (11, 11), (11, 22), (11, 33), (10, 44), (10, 54)))
_MASKS = tuple(m - (1 << 64) if m >= 1 << 63 else m for m in (a | b | c for a, b, c in itertools.combinations(_BANDS, 3)))


def simhash_pairs(hashes: DataFrame, distance: int = 3) -> DataFrame:
    """(kind, a, b, distance), a < b: hashes at most three bits apart. ``copy``: equal hashes, each held against the first
    id that has it; ``link``: between such first ids. Twenty keys, three of six bands each and about 32 bits wide, of
    which two hashes up to three bits apart share one, so none is missed and few share one by chance."""
    if distance > 3:
        raise ValueError("six bands find up to three bits")
    groups = hashes.groupBy("h").agg(F.min("id").alias("id"))
    keys = groups.select("id", "h", F.posexplode(F.array(*[F.col("h").bitwiseAND(F.lit(m).cast("long")) for m in _MASKS])).alias("band", "v"))
    a, b = keys.alias("a"), keys.alias("b")
    apart = F.bit_count(F.col("a.h").bitwiseXOR(F.col("b.h")))
    near = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.v") == F.col("b.v")) & (F.col("a.id") < F.col("b.id"))).where(apart <= distance).select(F.lit("link").alias("kind"), F.col("a.id").alias("a"), F.col("b.id").alias("b"), apart.cast("int").alias("distance")).distinct()
    same = hashes.alias("x").join(groups.alias("g"), (F.col("x.h") == F.col("g.h")) & (F.col("g.id") < F.col("x.id"))).select(F.lit("copy").alias("kind"), F.col("g.id").alias("a"), F.col("x.id").alias("b"), F.lit(0).alias("distance")).distinct()
    return near.union(same)


def _near(left: DataFrame, right: DataFrame, distance: int) -> DataFrame:
    """(hx, hy, distance): different pairs of hashes of two tables at most three bits apart. Joined by merging, so that no
    table, however its size is guessed, goes through the driver."""
    if distance > 3:
        raise ValueError("six bands find up to three bits")
    keyed = lambda df: df.select("h").distinct().select("h", F.posexplode(F.array(*[F.col("h").bitwiseAND(F.lit(m).cast("long")) for m in _MASKS])).alias("band", "v"))
    x, y = keyed(left).alias("x"), keyed(right).alias("y").hint("merge")
    apart = F.bit_count(F.col("x.h").bitwiseXOR(F.col("y.h")))
    return x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.v") == F.col("y.v"))).where(apart <= distance).select(F.col("x.h").alias("hx"), F.col("y.h").alias("hy"), apart.cast("int").alias("distance")).distinct()


def simhash_matches(left: DataFrame, right: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b, distance): rows of two tables of hashes at most three bits apart. Equal hashes are joined as one first."""
    a = left.select(F.col("h").alias("hx"), F.col("id").alias("a"))
    b = right.select(F.col("h").alias("hy"), F.col("id").alias("b"))
    return _near(left, right, distance).join(a.hint("merge"), "hx").join(b.hint("merge"), "hy").select("a", "b", "distance")


def simhash_match_counts(left: DataFrame, right: DataFrame, distance: int = 3) -> DataFrame:
    """(a, matches): for the ids of ``left`` with any, how many rows of ``right`` have a hash at most three bits apart: the
    size of ``simhash_matches`` by a. Rows with equal hashes are counted, not paired. Both tables are hashed once."""
    left, right = cut_lineage(left), cut_lineage(right)
    rows = right.groupBy(F.col("h").alias("hy")).agg(F.count("*").alias("n"))
    of_hash = _near(left, right, distance).join(rows.hint("merge"), "hy").groupBy("hx").agg(F.sum("n").alias("n"))
    own = left.select(F.col("h").alias("hx"), F.col("id").alias("a"))
    return own.join(of_hash.hint("merge"), "hx").groupBy("a").agg(F.sum("n").alias("matches"))


def ngram_overlap(docs: DataFrame, items: DataFrame, n: int = 8, doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """(item_id, doc_id, hits): distinct runs of ``n`` words of an item that a document holds. An equi-join on the
    hash of the run, then on the run itself."""

    def runs(df: DataFrame, key: str) -> DataFrame:
        w = words(F.coalesce(F.col("text"), F.lit("")))
        return df.where(F.size(w) >= n).select(F.col(key), F.explode(F.array_distinct(shingles(w, n))).alias("run")).withColumn("h", F.xxhash64("run"))

    d, i = runs(docs, doc_id), small(runs(items, item_id), 500_000)  # else every run of every text is shuffled
    return d.join(i, ["h", "run"]).groupBy(item_id, doc_id).agg(F.count("*").alias("hits"))


def containing(docs: DataFrame, snippets: DataFrame, doc_id: str = "doc_id", text_col: str = "text", block: int = 200_000) -> DataFrame:
    """(snippet, id): literal snippets that texts contain. Snippets are read in blocks; each block becomes one automaton
    that every text is run through once, so the work is linear in the texts and in what is found. Null and empty
    snippets are left out; any number of snippets is fine."""
    fields = pa.schema([("snippet", pa.string()), ("id", pa.int64())])
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col(text_col).isNotNull())

    def search(words: list[str]) -> DataFrame:
        def run(batches):
            import ahocorasick

            machine = ahocorasick.Automaton()
            for w in words:
                machine.add_word(w, w)
            machine.make_automaton()
            for b in batches:
                found, ids = [], []
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    own = {w for _, w in machine.iter(t)}
                    found += own
                    ids += [i] * len(own)
                yield pa.RecordBatch.from_pydict({"snippet": found, "id": ids}, schema=fields)

        return texts.mapInArrow(run, "snippet string, id long")

    out, words = None, []
    for row in snippets.select("snippet").where("snippet is not null and snippet != ''").distinct().toLocalIterator():
        words.append(row.snippet)
        if len(words) >= block:
            part = search(words)
            out, words = part if out is None else out.union(part), []
    if words:
        out = search(words) if out is None else out.union(search(words))
    return out if out is not None else texts.limit(0).select(F.col("text").alias("snippet"), "id")


def contaminated(docs: DataFrame, items: DataFrame, fields: tuple[str, ...] = ("prompt", "text"), min_chars: int = 40, doc_id: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id): documents that contain a value of ``fields`` of ``items`` of at least ``min_chars`` characters; both sides
    are compared by their content key. ``fields`` that ``items`` doesn't have are passed over."""
    held = [f for f in fields if f in items.columns]
    snippets = items.select(F.explode(F.array(*[content_key(F.col(f)) for f in held])).alias("snippet")).where(F.length("snippet") >= min_chars)
    return containing(docs.select(doc_id, content_key(F.col(text_col)).alias(text_col)), snippets, doc_id, text_col).select("id").distinct()
