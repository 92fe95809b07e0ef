"""Problem 2: size of every text in tokens of a frozen piece tokenizer, and totals by slice.

The tokenizer cuts a text at spaces, tabs, carriage returns and line feeds, puts a word mark before each word and
takes, from left to right, the longest piece that fits; a character that no piece fits costs its UTF-8 bytes; each
text ends with one more token.

Each *distinct* word is segmented once per worker: its characters form a linked symbol list, possible merges
(runs of symbols that are a piece) wait in a priority queue, leftmost and longest first, and what is popped joins its
symbols, which drops every waiting merge that overlaps it. The surviving symbols are counted and weighted by the word's
frequency. Counts are sums of integers, so the roll-up is exact.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Cache, arrow_map

#: Fixed values of the tokenizer: what separates words, and the mark put before each.
SEPARATORS = re.compile(r"[ \t\r\n]+")
WORD_MARK = "▁"

#: A vocabulary beyond this many pieces is refused: it is handed to every worker.
MAX_PIECES = 2_000_000


def load_pieces(pieces: DataFrame) -> frozenset[str]:
    """The pieces of kind ``normal``. The table is a frozen vocabulary; its size is checked before it is collected."""
    normal = pieces.where((F.col("kind") == "normal") & F.col("piece").isNotNull() & (F.col("piece") != "")).select("piece").distinct()
    rows = normal.limit(MAX_PIECES + 1).collect()
    if len(rows) > MAX_PIECES:
        raise ValueError(f"more than {MAX_PIECES} pieces")
    return frozenset(r.piece for r in rows)


class PieceCounter:
    """Counts the tokens of texts. Holds a bounded cache of words."""

    def __init__(self, pieces: frozenset[str], cache: int = 500_000):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=0)
        self.words = Cache(self.word, cache)

    def word(self, word: str) -> int:
        """Tokens of one word without its mark: surviving symbols, those outside the vocabulary by their bytes."""
        symbols = WORD_MARK + word
        n, pieces = len(symbols), self.pieces
        after = list(range(1, n + 1))  # the linked list: start of the next symbol
        alive = [True] * n
        waiting: list[tuple[int, int]] = []
        for start in range(n):
            for size in range(min(self.longest, n - start), 0, -1):
                if symbols[start : start + size] in pieces:
                    waiting.append((start, -size))
        heapq.heapify(waiting)
        tokens = settled = 0
        while waiting:
            start, size = heapq.heappop(waiting)
            end = start - size
            if start < settled or not alive[start]:
                continue
            tokens += self._bytes(symbols, settled, start)
            at = after[start]
            while at < end:  # the joined symbols leave the list
                alive[at] = False
                at = after[at]
            after[start] = end
            tokens += 1
            settled = end
        return tokens + self._bytes(symbols, settled, n)

    @staticmethod
    def _bytes(symbols: str, start: int, end: int) -> int:
        return len(symbols[start:end].encode("utf-8", "surrogatepass")) if end > start else 0

    def text(self, text: str | None) -> int | None:
        if text is None:
            return None
        words = self.words
        return sum(words[w] * k for w, k in Counter(SEPARATORS.split(text)).items() if w) + 1


def count_tokens(docs: DataFrame, pieces: DataFrame, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """``docs`` with ``out_col`` (long): tokens of ``text_col``. Other columns pass through unchanged.

    A null text has a null count; an empty or blank text has one token (the end mark). Raises when ``docs`` already
    has ``out_col``.
    """
    if out_col in docs.columns:
        raise ValueError(f"the table has a column {out_col} already")
    vocabulary = load_pieces(pieces)
    keep = [f.name for f in docs.schema.fields if f.name != text_col]

    def counts(given: dict[str, list], counter: PieceCounter) -> dict[str, list]:
        given[out_col] = [counter.text(t) for t in given.pop(text_col)]
        return given

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add(out_col, "long")
    fields: pa.Schema = to_arrow_schema(schema)
    return arrow_map(docs.select(*[F.col(f"`{c}`") for c in [*keep, text_col]]), counts, schema, fields, lambda: PieceCounter(vocabulary))


def stale_counts(docs: DataFrame, pieces: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """(doc_id, token_count, n_tokens) of documents whose ``token_count`` is null or off by more than ``tolerance``
    of the true count. A null text is a case if its ``token_count`` is null, as nothing shows that it is right."""
    sized = count_tokens(docs.select("doc_id", "token_count", "text"), pieces)
    off = F.abs(F.col("token_count").cast("long") - F.col("n_tokens")) > F.lit(tolerance) * F.col("n_tokens")
    return sized.where(F.col("token_count").isNull() | off).dropDuplicates(["doc_id"])


def token_totals(docs: DataFrame, extracted: DataFrame, pieces: DataFrame) -> DataFrame:
    """Documents and tokens by source, language and category, with subtotals (``level`` names the grouping).

    Source, language and category are those of ``extracted`` where ``ext_id`` leads there, else those of the document
    itself; of several deliveries of an ``ext_id`` the last loaded counts. Missing values form slices of their own
    (null); rows of a grouping set that leaves a column out carry null there too and are told apart by ``level``.
    """
    sized = count_tokens(docs.select("doc_id", "ext_id", "source", "lang", "category", "text"), pieces).withColumn("ext_id", F.col("ext_id").cast("long"))
    last = extracted.groupBy("ext_id").agg(F.max_by(F.struct("source_id", "language", "category"), F.struct("loaded_at", "language", "category")).alias("e")).where("ext_id is not null")
    joined = sized.join(last, "ext_id", "left")
    flat = joined.select(
        F.when(F.col("e").isNotNull(), F.col("e.source_id")).otherwise(F.col("source")).alias("source"),
        F.when(F.col("e").isNotNull(), F.col("e.language")).otherwise(F.col("lang")).alias("lang"),
        F.when(F.col("e").isNotNull(), F.col("e.category")).otherwise(F.col("category")).alias("category"),
        "n_tokens",
    )
    spark = docs.sparkSession
    return spark.sql(
        """
        SELECT CASE grouping_id(source, lang, category) WHEN 0 THEN 'slice' WHEN 3 THEN 'source' WHEN 5 THEN 'lang'
                    WHEN 6 THEN 'category' ELSE 'all' END AS level,
               source, lang, category, count(*) AS docs, sum(n_tokens) AS tokens
        FROM {flat}
        GROUP BY GROUPING SETS ((source, lang, category), (source), (lang), (category), ())
        """,
        flat=flat,
    )
