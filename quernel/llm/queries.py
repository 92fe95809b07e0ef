"""Queries of this subpackage, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import language, leakage, mixing, mojibake, neardup, pairs, pii, spam, tokens


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_segments(spark, sf_dir).where((F.col("segments") > 1) | F.col("label").isNull() | (F.col("label") != F.col("lang"))).select("ext_id", F.col("segment_no").cast("int").alias("segment_no"), "lang")


def p1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.document_languages(table(spark, sf_dir, "extracted_documents", "ext_id", "text", "language", "loaded_at"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.stale_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "tokenizer_pieces")).select("doc_id")


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return tokens.count_tokens(docs, table(spark, sf_dir, "tokenizer_pieces"))


def p2_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_totals(table(spark, sf_dir, "documents"), table(spark, sf_dir, "extracted_documents"), table(spark, sf_dir, "tokenizer_pieces"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_lines(spark, sf_dir).select("ext_id", "line_number")


def p3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.garbled_lines(table(spark, sf_dir, "extracted_documents", "ext_id", "text"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.similar_pairs(table(spark, sf_dir, "documents", "doc_id", "text"), threshold=0.6).select("doc_id_a", "doc_id_b")


def p4_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.class_links(table(spark, sf_dir, "documents", "doc_id", "text"), threshold=0.6)
    return found.withColumn("similarity", F.round("similarity", 6))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.duplicate_groups(table(spark, sf_dir, "documents", "doc_id", "text"), threshold=0.8)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.fit(table(spark, sf_dir, "extracted_documents", "ext_id", "text", "language"))
    return pairs.defects(table(spark, sf_dir, "instruct_seed", "pair_id", "prompt", "response", "loaded_at"), model)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_items(spark, sf_dir).select("ext_id", "start_char", "pii_type")


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "extracted_documents", "ext_id", "text"))


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redacted(table(spark, sf_dir, "extracted_documents", "ext_id", "text"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_passages(spark, sf_dir).select("doc_id", "item_id")


def p7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items", "item_id", "text"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.unreachable(table(spark, sf_dir, "documents", "source", "text"), table(spark, sf_dir, "tokenizer_pieces"), table(spark, sf_dir, "mix_targets")).select("mix_id", "source")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_shares(table(spark, sf_dir, "documents", "doc_id", "source", "text"), table(spark, sf_dir, "tokenizer_pieces"), table(spark, sf_dir, "mix_targets"))


def p8_mixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.fill_mixes(table(spark, sf_dir, "documents", "doc_id", "source", "text"), table(spark, sf_dir, "tokenizer_pieces"), table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_pages(spark, sf_dir).select("doc_id")


def p9_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.keyword_pages(table(spark, sf_dir, "documents", "doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}


_WORDS = r"list_transform(regexp_extract_all(nfc_normalize(text), '[\p{L}\p{N}]+'), lambda w: lower(replace(w, 'İ', 'i̇')))"
# word sequences, shingle sets, the smallest id of each word sequence, and the similarities of all pairs of such ids
_CLASSES = f"""w AS (SELECT doc_id, {_WORDS} AS w FROM documents), m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY w) AS rep, count(*) OVER (PARTITION BY w) AS copies, w FROM w WHERE len(w) > 0),
s AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' '))) AS s FROM m WHERE doc_id = rep)),
j AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*)::DOUBLE / (any_value(a.n) + any_value(b.n) - count(*)) AS similarity FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id)"""


# tokens of every text: from each place of a distinct word the longest piece that fits, else the bytes of a character
_TOKENS = r"""p AS (SELECT DISTINCT piece FROM tokenizer_pieces WHERE kind = 'normal' AND piece != ''), k AS (SELECT unnest(range(1, (SELECT max(length(piece)) FROM p) + 1)) AS k),
d AS (SELECT doc_id, ext_id, source, lang, category, token_count, string_split_regex(text, '[ \t\r\n]+') AS ws FROM documents), w AS (SELECT DISTINCT unnest(ws) AS word FROM d),
r(word, rest, n) AS (SELECT word, '▁' || word, 0 FROM w WHERE word != '' UNION ALL
SELECT word, substr(rest, coalesce(longest, 1) + 1), n + CASE WHEN longest IS NULL THEN strlen(substr(rest, 1, 1)) ELSE 1 END FROM (SELECT r.word, r.rest, r.n, max(CASE WHEN p.piece IS NOT NULL THEN k.k END) AS longest FROM r CROSS JOIN k LEFT JOIN p ON p.piece = substr(r.rest, 1, k.k) WHERE r.rest != '' GROUP BY ALL)),
c AS (SELECT word, n FROM r WHERE rest = ''), s AS (SELECT doc_id, sum(coalesce(n, 0))::BIGINT + 1 AS n_tokens FROM (SELECT doc_id, unnest(ws) AS word FROM d) LEFT JOIN c USING (word) GROUP BY doc_id)"""
_LAST = "l AS (SELECT ext_id, max_by(struct_pack(a := source_id, b := language, c := category), loaded_at) AS e FROM extracted_documents GROUP BY ext_id)"


def oracle_sql() -> dict[str, str]:
    # by definition, without the method: shared shingles of every pair; tokens one by one
    return {
        "p2_counts": f"WITH RECURSIVE {_TOKENS} SELECT doc_id, n_tokens FROM s",
        "p2_found": f"WITH RECURSIVE {_TOKENS} SELECT doc_id FROM s JOIN d USING (doc_id) WHERE token_count IS NULL OR abs(token_count - n_tokens) > 0.05 * n_tokens",
        "p2_totals": f"""WITH RECURSIVE {_TOKENS}, {_LAST}, f AS (SELECT CASE WHEN e IS NULL THEN source ELSE e.a END AS source, CASE WHEN e IS NULL THEN lang ELSE e.b END AS lang, CASE WHEN e IS NULL THEN category ELSE e.c END AS category, n_tokens FROM s JOIN d USING (doc_id) LEFT JOIN l ON l.ext_id = d.ext_id)
SELECT CASE grouping(source, lang, category) WHEN 0 THEN 'slice' WHEN 3 THEN 'source' WHEN 5 THEN 'lang' WHEN 6 THEN 'category' ELSE 'all' END AS level, source, lang, category, count(*) AS docs, sum(n_tokens)::BIGINT AS tokens FROM f GROUP BY GROUPING SETS ((source, lang, category), (source), (lang), (category), ())""",
        "p8_found": f"""WITH RECURSIVE {_TOKENS}, t AS (SELECT source, sum(n_tokens) AS n FROM s JOIN d USING (doc_id) GROUP BY source), a AS (SELECT sum(n) AS n FROM t)
SELECT m.mix_id, m.source FROM mix_targets m LEFT JOIN t ON t.source = m.source, a WHERE coalesce(t.n, 0) * m.max_repeats < m.target_share * m.budget_ratio * a.n""",
        "p4_found": f"""WITH {_CLASSES} SELECT x.doc_id AS doc_id_a, y.doc_id AS doc_id_b FROM m x JOIN m y ON x.rep = y.rep AND x.doc_id < y.doc_id
UNION SELECT least(x.doc_id, y.doc_id), greatest(x.doc_id, y.doc_id) FROM j JOIN m x ON x.rep = j.a JOIN m y ON y.rep = j.b WHERE similarity >= 0.6""",
        "p4_links": f"""WITH {_CLASSES} SELECT 'copy' AS kind, rep AS doc_id_a, doc_id AS doc_id_b, 1.0::DOUBLE AS similarity FROM m WHERE doc_id != rep UNION ALL SELECT 'link', a, b, round(similarity, 6) FROM j WHERE similarity >= 0.6""",
        "p4_groups": f"""WITH {_CLASSES} SELECT doc_id, rep AS class_id, copies, (SELECT count(*) FROM j WHERE similarity >= 0.8 AND (j.a = m.rep OR j.b = m.rep)) AS links FROM m""",
    }
