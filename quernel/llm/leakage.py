"""Problem 7: documents that hold passages of evaluation items, whole or in part.

A prefix-filtered set join of item and document shingles. The shingles of an item are ordered by rarity in the corpus
(counted over all documents). A document that holds the wanted share of an item keeps at least ``T`` of its ``n``
shingles, so it holds one of the item's ``n - T + 1`` rarest: only these are looked up. Candidates pass length and
positional bounds (the hits must lie in a window of the item's size) and are verified word by word in that window.

The items are a small table: it is read in blocks of at most ``BLOCK_SHINGLES`` shingles, and each block, not the
corpus, goes to the workers.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Cache, arrow_map, fold, fold_hash, shingle_hashes, words_of

BLOCK_SHINGLES = 1_000_000


def kept_shingles(words: int, size: int, breaks: int) -> int:
    """Shingles that survive among ``words`` consecutive words when every ``breaks`` words one is replaced or something
    is inserted: each break costs at most ``size`` shingles."""
    return max(1, words - size + 1 - size * (words // breaks))


class Items:
    """One block of items, ready for lookup."""

    def __init__(self, rows: list[tuple[int, str]], share: float, size: int, breaks: int):
        self.share, self.size = share, size
        self.words: dict[int, list[str]] = {}
        self.shingles: dict[int, np.ndarray] = {}
        self.least: dict[int, int] = {}
        for item, text in rows:
            words = [fold(w) for w in words_of(text)]
            if not words:
                continue
            hashes = np.array([fold_hash(w) for w in words], np.uint64)
            self.words[item] = words
            self.shingles[item] = shingle_hashes(hashes, min(size, len(words)))
            self.least[item] = kept_shingles(int(np.ceil(share * len(words))), size, breaks)
        every = [np.unique(s) for s in self.shingles.values()]
        self.all = np.unique(np.concatenate(every)) if every else np.empty(0, np.uint64)

    def order(self, frequency: np.ndarray) -> None:
        """Choose each item's necessary prefix by the corpus frequency of ``self.all``."""
        self.owners: dict[int, list[int]] = defaultdict(list)
        for item, s in self.shingles.items():
            distinct = np.unique(s)
            rank = np.lexsort((distinct, frequency[np.searchsorted(self.all, distinct)]))
            for key in distinct[rank[: max(1, len(distinct) - self.least[item] + 1)]].tolist():
                self.owners[key].append(item)
        self.prefix = np.array(sorted(self.owners), np.uint64)

    def short(self) -> int:
        return min((len(w) for w in self.words.values()), default=0)


def _member(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return table[at] == keys


def _document(text: str, size: int, hashes: Cache) -> tuple[list[str], np.ndarray]:
    words = words_of(text)
    return words, shingle_hashes(np.array([hashes[w] for w in words], np.uint64), size)


def _held(item: list[str], window: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence of words, as (item position, window position)."""
    at: dict[str, list[int]] = defaultdict(list)
    for j, w in enumerate(window):
        at[w].append(j)
    n, m = len(item), len(window)
    best = np.zeros((n + 1, m + 1), np.int32)
    for i in range(n - 1, -1, -1):
        row = best[i + 1].copy()
        hit = at.get(item[i])
        if hit:
            row[hit] = np.maximum(row[hit], best[i + 1][np.array(hit) + 1] + 1)
        best[i] = np.maximum.accumulate(row[::-1])[::-1]
    i = j = 0
    out = []
    while i < n and j < m:
        if item[i] == window[j] and best[i, j] == best[i + 1, j + 1] + 1:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def leaked_items(docs: DataFrame, items: DataFrame, share: float = 0.5, size: int = 3, breaks: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, held, words): the document holds the item's passage: at least ``share`` of its words, in
    order, within a window of one and a half times the item's size. Case, accents, punctuation and white space don't
    count; a replaced word counts as held if both its neighbours are. ``held`` is the number of words held.

    Rows with a null id or text, and texts or items without words, give nothing. Several rows with one id count as one
    document or item. Columns other than those named are not read.
    """
    wanted = items.select("item_id", "text").where("item_id is not null and text is not null").distinct().repartitionByRange(F.col("item_id")).sortWithinPartitions("item_id")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    out = None
    block: list[tuple[int, str]] = []
    room = BLOCK_SHINGLES
    for row in wanted.toLocalIterator():
        block.append((row.item_id, row.text))
        room -= len(row.text) // 2 + 1
        if room <= 0:
            found = _leaked(texts, Items(block, share, size, breaks))
            out, block, room = found if out is None else out.union(found), [], BLOCK_SHINGLES
    if block or out is None:
        found = _leaked(texts, Items(block, share, size, breaks))
        out = found if out is None else out.union(found)
    return out.groupBy("doc_id", "item_id").agg(F.max("held").alias("held"), F.max("words").alias("words"))


def _leaked(texts: DataFrame, items: Items) -> DataFrame:
    size, sc = items.size, texts.sparkSession.sparkContext
    every = sc.broadcast(items.all)  # at most BLOCK_SHINGLES hashes, and as many owners and words below

    def frequency(batches):
        known = every.value
        hashes, seen = Cache(fold_hash), np.zeros(len(known), np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                keys = np.unique(_document(t, size, hashes)[1])
                if len(keys) and len(known):
                    seen[np.searchsorted(known, keys[_member(keys, known)])] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at])], names=["at", "n"])

    counted = np.zeros(len(items.all), np.int64)
    for row in texts.select("text").mapInArrow(frequency, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # at most one row per item shingle
        counted[row["at"]] = row.n
    items.order(counted)
    shared = sc.broadcast(items)
    fields = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("held", pa.int32()), ("words", pa.int32())])

    def search(given: dict[str, list], hashes: Cache) -> dict[str, list]:
        items = shared.value
        out: dict[str, list] = {n: [] for n in fields.names}
        for doc, text in zip(given["doc_id"], given["text"], strict=True):
            words, keys = _document(text, size, hashes)
            if not len(items.prefix) or not words:
                continue
            hits = np.flatnonzero(_member(keys, items.prefix))
            candidates: dict[int, list[int]] = defaultdict(list)
            for p in hits.tolist():
                for item in items.owners[int(keys[p])]:
                    candidates[item].append(p)
            folded: list[str] = []
            for item, at in candidates.items():
                folded = folded or [fold(w) for w in words]
                held = _verify(items, item, folded, keys, at)
                if held:
                    for n, v in zip(fields.names, (doc, item, held, len(items.words[item])), strict=True):
                        out[n].append(v)
        return out

    return arrow_map(texts, search, "doc_id long, item_id long, held int, words int", fields, lambda: Cache(fold_hash))


def _verify(items: Items, item: int, words: list[str], keys: np.ndarray, hits: list[int]) -> int:
    """Words of the item that the document holds in one window, 0 if too few."""
    own, n = items.shingles[item], len(items.words[item])
    slack = n // 2
    need = int(np.ceil(items.share * n))
    if len(words) < need:
        return 0
    place: dict[int, list[int]] = defaultdict(list)
    for q, key in enumerate(own.tolist()):
        place[key].append(q)
    starts = Counter()
    for p in hits:
        for q in place[int(keys[p])]:
            starts[p - q] += 1
    best = 0
    done: list[int] = []
    for start, _ in starts.most_common():
        if any(abs(start - d) <= slack // 2 for d in done):
            continue
        done.append(start)
        low = max(0, start - slack // 2)
        window = words[low : start + n + slack]
        inside = keys[low : max(low, start + n + slack - items.size + 1)]
        if np.isin(np.unique(own), inside).sum() < items.least[item]:
            continue
        pairs = _held(items.words[item], window)
        held = len(pairs)
        for (i, j), (k, m) in zip(pairs, pairs[1:], strict=False):
            if k - i == m - j and 1 < k - i <= 3:  # replaced words between held ones
                held += k - i - 1
        best = max(best, held)
    return best if best >= need else 0
