"""The corpus inventory: filter, drop repeated paragraphs, filter again, drop evaluation texts, exact and near copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import composed, composed_key, content_hash
from ..operators import dedup, filters, similarity
from ..session import cut_lineage, spread


def inventory(docs: DataFrame, items: DataFrame, threshold: float = 0.85, min_chars: int = 80) -> DataFrame:
    """(doc_id, reason, representative_id, removed_paragraphs, n_chars): what becomes of every document, stage by stage
    over whole tables. A document is refused by the first stage that objects; paragraphs that an earlier passing
    document (by id) holds, or that repeat within a document, are cut before the second filter. Duplicates keep the
    first of their group. A document is contaminated if its text equals the text of an item or contains an item's text or prompt
    of at least 40 characters. ``docs`` needs doc_id, text, lang; ids are unique. ``items`` needs text and may have prompt."""
    d = docs.select("doc_id", "text", "lang")
    # written once: the stages below would run the filter anew for each of their branches; refused texts aren't needed again
    judged = cut_lineage(filters.with_quality_reason(spread(d)).withColumn("text", F.when(F.col("reason").isNull(), F.col("text"))))
    refused = judged.where("reason is not null").select("doc_id", "reason")
    passed = judged.where("reason is null").drop("reason")

    owners = dedup.paragraph_owners(passed, min_chars=min_chars)
    keep = F.col("first_in_doc") & (F.col("owner_id").isNull() | (F.col("owner_id") == F.col("doc_id")))
    marks = cut_lineage(owners.groupBy("doc_id").agg(F.sum((~keep).cast("int")).alias("removed_paragraphs"), F.collect_set(F.when(~keep, F.col("idx"))).alias("cut")))  # a document's own paragraphs
    parts = F.filter(F.transform(F.split("text", r"\n[ \t\n\x0B\f\r]*\n"), lambda p: F.regexp_replace(p, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")), lambda p: p != "")
    rebuilt = passed.join(marks, "doc_id", "left").select("doc_id", "lang", F.coalesce("removed_paragraphs", F.lit(0)).alias("removed_paragraphs"), F.array_join(F.filter(parts, lambda p, i: ~F.coalesce(F.array_contains(F.col("cut"), i), F.lit(False))), "\n\n").alias("text"))
    changed = filters.with_quality_reason(rebuilt.where("removed_paragraphs > 0"), name="again")
    again = changed.unionByName(rebuilt.where("removed_paragraphs = 0").withColumn("again", F.lit(None).cast("string")))
    second = cut_lineage(composed(again.withColumn("reason", F.concat(F.lit("post_dedup_"), "again")).drop("again"), "text").withColumn("h", F.sha2(composed_key(F.col("text")), 256)))

    leaked = items.select(content_hash(F.col("text")).alias("h")).distinct().withColumn("leaked", F.lit(True))
    holding = similarity.contaminated(second.where("reason is null"), items).select(F.col("id").alias("doc_id"), F.lit(True).alias("holds"))
    third = cut_lineage(second.where("reason is null").select("doc_id", "h").join(leaked, "h", "left").join(holding, "doc_id", "left").select("doc_id", "h", F.coalesce("leaked", "holds").alias("leaked")))
    exact = dedup.first_by_key(third.where("leaked is null").select("doc_id", "h"), "h", ["doc_id"], "doc_id")
    clean = cut_lineage(second.where("reason is null").join(exact.where("doc_id = representative_id").select("doc_id"), "doc_id", "left_semi").select("doc_id", "text"))
    near = dedup.greedy_links(similarity.jaccard_links(clean, threshold=threshold)).where("not kept")

    none = F.lit(None).cast("long")
    out = refused.select("doc_id", "reason", none.alias("representative_id")).union(second.where("reason is not null").select("doc_id", "reason", none)).union(third.where("leaked").select("doc_id", F.lit("evaluation_contamination"), none))
    out = out.union(exact.where("doc_id != representative_id").select("doc_id", F.lit("exact_duplicate"), "representative_id")).union(near.select("id", F.lit("near_duplicate"), "representative_id"))
    sizes = second.select("doc_id", "removed_paragraphs", F.length("text").alias("n_chars"))
    return d.select("doc_id").join(out, "doc_id", "left").join(sizes, "doc_id", "left").select("doc_id", F.coalesce("reason", F.lit("accepted")).alias("reason"), "representative_id", F.coalesce("removed_paragraphs", F.lit(0)).alias("removed_paragraphs"), "n_chars")


def report(stats: DataFrame, title: str, limit: int = 1000) -> str:
    """A small table as markdown; longer than ``limit`` rows is refused."""
    rows = stats.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    cell = lambda v: "" if v is None else f"{v:,}" if isinstance(v, int) else " ".join(str(v).split()).replace("|", "\\|")[:180]
    head = [f"# {title}", "", "| " + " | ".join(stats.columns) + " |", "|" + "---|" * len(stats.columns)]
    return "\n".join([*head, *("| " + " | ".join(cell(v) for v in r) + " |" for r in rows), ""])
