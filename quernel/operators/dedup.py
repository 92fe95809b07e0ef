"""Exact duplicates, paragraph and line duplicates, greedy resolution of duplicate edges."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import MAY_COMPOSE, casefold, composed_key, content_key, lines, squeeze, words
from ..session import cut_lineage


def first_by_key(df: DataFrame, key: str, order: list[str], id_col: str) -> DataFrame:
    """``df`` with ``representative_id``: id of the first row, by ``order``, that shares ``key``. The first of each key
    is found by a combined aggregate and joined back, so a key with very many rows is never held in one task. Null keys
    form a group of their own."""
    k = F.col(key)
    first = df.groupBy(k.alias("_k")).agg(F.min(F.struct(*order, F.col(id_col).alias("_id"))).alias("_f")).select("_k", F.col("_f._id").alias("representative_id"))
    return df.join(first, k.eqNullSafe(F.col("_k"))).drop("_k")


def paragraphs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, idx, paragraph): blank-line separated, trimmed, not empty, numbered from 0 in text order."""
    parts = F.filter(F.transform(F.split(F.col(text_col), r"\n[ \t\n\x0B\f\r]*\n"), lambda p: F.regexp_replace(p, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")), lambda p: p != "")
    return df.select(id_col, F.posexplode(parts).alias("idx", "paragraph"))


def paragraph_owners(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 80) -> DataFrame:
    """(id, idx, h, n_chars, first_in_doc, owner_id): whether a paragraph is the first of its kind within its document,
    and for those of at least ``min_chars`` characters the first document, by id, that has it (null for shorter)."""
    may = F.coalesce(F.col(text_col).rlike(MAY_COMPOSE), F.lit(False))  # only texts that may need composing pass through Python
    keyed = lambda part, key: paragraphs(part, id_col, text_col).withColumn("h", F.sha2(key(F.col("paragraph")), 256))
    p = keyed(df.where(~may), composed_key).union(keyed(df.where(may), content_key)).withColumn("n_chars", F.length("paragraph"))
    within = F.min("idx").over(Window.partitionBy(id_col, "h"))
    owner = p.where(F.col("n_chars") >= min_chars).groupBy("h").agg(F.min(id_col).alias("_owner"))
    return p.withColumn("first_in_doc", F.col("idx") == within).join(owner, "h", "left").select(id_col, "idx", "h", "n_chars", "first_in_doc", F.when(F.col("n_chars") >= min_chars, F.col("_owner")).alias("owner_id"))


def fenced_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lineno, line, in_code): lines with the parity of code fences before them."""
    per = df.select(id_col, F.posexplode(lines(F.col(text_col))).alias("lineno", "line"))
    fence = F.when(F.ltrim(F.col("line")).startswith("```"), 1).otherwise(0)
    before = Window.partitionBy(id_col).orderBy("lineno").rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumn("_fence", fence).select(id_col, "lineno", "line", (F.coalesce(F.sum("_fence").over(before), F.lit(0)) % 2 == 1).alias("in_code"), (F.col("_fence") == 1).alias("is_fence"))


def line_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20) -> DataFrame:
    """(id, lineno, keep): a line outside code of at least ``min_chars`` characters is kept only where it occurs first
    in the corpus, by id and line number; all other lines are kept. The lines are cut once and kept in the checkpoint."""
    per = cut_lineage(fenced_lines(df, id_col, text_col))
    checked = ~F.col("in_code") & ~F.col("is_fence") & (F.length(F.trim("line")) >= min_chars)
    first = per.where(checked).groupBy("line").agg(F.min(F.struct(id_col, "lineno")).alias("_first"))
    joined = per.where(checked).join(first, "line").select(id_col, "lineno", (F.struct(id_col, "lineno") == F.col("_first")).alias("keep"))
    return joined.union(per.where(~checked).select(id_col, "lineno", F.lit(True).alias("keep")))


def pair_key(prompt: Column, response: Column) -> Column:
    """Hash of a case-folded, squeezed pair."""
    return F.sha2(F.concat(squeeze(casefold(F.coalesce(prompt, F.lit("")))), F.lit("\n"), squeeze(casefold(F.coalesce(response, F.lit(""))))), 256)


def prefix_key(text: Column, n: int = 24) -> Column:
    """The first ``n`` case-folded words; a text without words has the empty key."""
    return F.array_join(F.slice(words(F.coalesce(text, F.lit("")), "[A-Za-zÇĞİÖŞÜçğıöşü0-9]+"), 1, n), " ")


#: Undecided edges up to this number are resolved in order by one task (16 bytes each, and a set of refused ids).
FOLD_EDGES = 1_000_000


def greedy(edges: DataFrame, fold_edges: int = FOLD_EDGES, max_rounds: int = 1_000) -> DataFrame:
    """Resolve duplicate edges (a, b), a before b, as one pass in order would: a node is kept unless an earlier kept
    node is its neighbour. Returns (id, kept, representative_id): nodes with an edge; the representative of a refused
    node is its first kept neighbour, of a kept node itself. Null ids and loops are left out.

    In rounds, nodes without an earlier undecided neighbour are kept, their later neighbours refused, and only edges
    between undecided nodes go on; once ``fold_edges`` or fewer are left, one task walks them in order, however long
    their chains. Each round is written to the shared checkpoint folder.
    """
    e = cut_lineage(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a < b").distinct())
    left, refused = e, None
    for _ in range(max_rounds):
        if left.limit(fold_edges + 1).count() <= fold_edges:
            break
        kept = left.select("a").distinct().join(left.select(F.col("b").alias("a")), "a", "left_anti")
        out = cut_lineage(left.join(kept, "a", "left_semi").select("b").distinct())
        refused = out if refused is None else refused.union(out)
        left = cut_lineage(left.join(kept, "a", "left_anti").join(out, "b", "left_anti").join(out.select(F.col("b").alias("a")), "a", "left_anti").select("a", "b"))
    else:
        raise RuntimeError("the edges did not resolve")

    def walk(batches):
        gone: set[int] = set()
        for batch in batches:
            new = []
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b not in gone and a not in gone:
                    gone.add(b)
                    new.append(b)
            yield pa.RecordBatch.from_pydict({"b": new}, schema=pa.schema([("b", pa.int64())]))

    last = left.repartition(1).sortWithinPartitions("b", "a").mapInArrow(walk, "b long")
    refused = cut_lineage(last if refused is None else refused.union(last))
    nodes = e.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(refused.select(F.col("b").alias("id"), F.lit(True).alias("gone")), "id", "left")
    first = e.join(refused.select(F.col("b").alias("a")), "a", "left_anti").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("r"))
    return nodes.join(first, "id", "left").select("id", F.col("gone").isNull().alias("kept"), F.when(F.col("gone").isNull(), F.col("id")).otherwise(F.col("r")).alias("representative_id"))


def greedy_links(links: DataFrame) -> DataFrame:
    """``greedy`` over (kind, a, b) as similarity joins give them: links between the first of each class of equal texts,
    and copies (b) of the first (a). A copy is always refused, for its class's first or for what that was refused for."""
    links = cut_lineage(links.select("kind", "a", "b"))
    done = cut_lineage(greedy(links.where("kind = 'link'")))
    copies = links.where("kind = 'copy'").join(done.select(F.col("id").alias("a"), F.col("representative_id").alias("r")), "a", "left").select(F.col("b").alias("id"), F.lit(False).alias("kept"), F.coalesce("r", "a").alias("representative_id"))
    alone = links.where("kind = 'copy'").select(F.col("a").alias("id")).distinct().join(done.select("id"), "id", "left_anti").select("id", F.lit(True).alias("kept"), F.col("id").alias("representative_id"))
    return done.union(copies).union(alone)
