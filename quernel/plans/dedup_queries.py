"""Queries on duplicates, contamination and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup, similarity
from ..session import spread, table
from . import fragments as S
from .catalogue import query

TOKENS = similarity.TOKENS


def docs(spark, d, *columns):
    return table(spark, d, "documents", *columns)


@query(f"SELECT doc_id, first_value(doc_id) OVER (PARTITION BY k ORDER BY doc_id) AS representative_id FROM (SELECT doc_id, {S.key('text')} AS k FROM documents)")
def dedup_exact(spark, d):
    keyed = T.composed(spread(docs(spark, d, "doc_id", "text")), "text").select("doc_id", F.sha2(T.composed_key(F.col("text")), 256).alias("k"))
    return dedup.first_by_key(keyed, "k", ["doc_id"], "doc_id").select("doc_id", "representative_id")


@query(f"SELECT doc_id, first_value(doc_id) OVER (PARTITION BY k ORDER BY doc_id) AS representative_id FROM (SELECT doc_id, array_to_string(({S.words('text', TOKENS)})[1:24], ' ') AS k FROM documents)")
def dedup_prefix24(spark, d):
    return dedup.first_by_key(docs(spark, d, "doc_id", "text").select("doc_id", dedup.prefix_key(F.col("text")).alias("k")), "k", ["doc_id"], "doc_id").select("doc_id", "representative_id")


@query(f"SELECT DISTINCT pair_id, first_value(pair_id) OVER (PARTITION BY {S.squeeze(S.casefold('prompt'))}, {S.squeeze(S.casefold('response'))} ORDER BY pair_id) AS representative_id FROM instruct_seed")
def dedup_pairs(spark, d):
    k = table(spark, d, "instruct_seed", "pair_id", "prompt", "response").select("pair_id", dedup.pair_key(F.col("prompt"), F.col("response")).alias("k"))
    return dedup.first_by_key(k, "k", ["pair_id"], "pair_id").select("pair_id", "representative_id").distinct()


_PARA = r"list_filter(list_transform(string_split_regex(text, '\n[ \t\n\x0B\f\r]*\n'), lambda x: regexp_replace(x, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')), lambda x: x != '')"
_PARAS = f"SELECT doc_id, i - 1 AS idx, p[i] AS paragraph FROM (SELECT doc_id, {_PARA} AS p, unnest(range(1, len(p) + 1)) AS i FROM documents)"


@query(f"SELECT doc_id, idx::INTEGER AS idx, length(paragraph) AS n_chars, sha256(paragraph) AS h FROM ({_PARAS})")
def paragraphs(spark, d):
    return dedup.paragraphs(docs(spark, d, "doc_id", "text")).select("doc_id", "idx", F.length("paragraph").cast("long").alias("n_chars"), F.sha2("paragraph", 256).alias("h"))


@query(f"""SELECT doc_id, idx::INTEGER AS idx, idx = min(idx) OVER (PARTITION BY doc_id, h) AS first_in_doc, CASE WHEN n >= 80 THEN min(CASE WHEN n >= 80 THEN doc_id END) OVER (PARTITION BY h) END AS owner_id
FROM (SELECT doc_id, idx, length(paragraph) AS n, sha256({S.key('paragraph')}) AS h FROM ({_PARAS}))""")
def paragraph_owners(spark, d):
    return dedup.paragraph_owners(spread(docs(spark, d, "doc_id", "text"))).select("doc_id", "idx", "first_in_doc", "owner_id")


_LINES = f"SELECT doc_id, i - 1 AS lineno, l[i] AS line FROM (SELECT doc_id, {S.lines('text')} AS l, unnest(range(1, len(l) + 1)) AS i FROM documents)"
_FENCED = f"SELECT *, coalesce(sum(f) OVER (PARTITION BY doc_id ORDER BY lineno ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS in_code FROM (SELECT *, CASE WHEN starts_with(ltrim(line), '```') THEN 1 ELSE 0 END AS f FROM ({_LINES}))"


@query(f"""SELECT doc_id, lineno::INTEGER AS lineno, CASE WHEN in_code OR f = 1 OR length(trim(line)) < 20 THEN true ELSE row_number() OVER (PARTITION BY line, in_code OR f = 1 OR length(trim(line)) < 20 ORDER BY doc_id, lineno) = 1 END AS keep FROM ({_FENCED})""")
def line_dedup_global(spark, d):
    return dedup.line_duplicates(docs(spark, d, "doc_id", "text"))


@query(f"SELECT line, count(*) AS n, count(DISTINCT doc_id) AS docs FROM ({_LINES}) WHERE length(trim(line)) >= 20 GROUP BY line ORDER BY n DESC, line LIMIT 25")
def common_lines(spark, d):
    per = docs(spark, d, "doc_id", "text").select("doc_id", F.explode(T.lines(F.col("text"))).alias("line")).where(F.length(F.trim("line")) >= 20)
    return per.groupBy("line", "doc_id").agg(F.count("*").alias("k")).groupBy("line").agg(F.sum("k").alias("n"), F.count("*").alias("docs")).orderBy(F.desc("n"), "line").limit(25)


@query(f"""WITH r AS (SELECT doc_id, source, first_value(doc_id) OVER w AS rep, first_value(source) OVER w AS rep_source FROM (SELECT doc_id, source, {S.key('text')} AS k FROM documents) WINDOW w AS (PARTITION BY k ORDER BY doc_id))
SELECT rep_source, source AS duplicate_source, count(*) AS n FROM r WHERE doc_id != rep GROUP BY ALL""")
def dup_overlap_matrix(spark, d):
    per = docs(spark, d, "doc_id", "source", "text").select("doc_id", "source", T.content_hash(F.coalesce("text", F.lit(""))).alias("k"))
    first = per.groupBy("k").agg(F.min(F.struct("doc_id", "source")).alias("f"))
    return per.join(first, "k").where(F.col("doc_id") != F.col("f.doc_id")).groupBy(F.col("f.source").alias("rep_source"), F.col("source").alias("duplicate_source")).agg(F.count("*").alias("n"))


@query(f"SELECT h, count(*) AS n FROM (SELECT sha256({S.key('text')}) AS h FROM documents) GROUP BY h HAVING count(*) > 1")
def residual_duplicates(spark, d):
    return docs(spark, d, "text").groupBy(T.content_hash(F.coalesce("text", F.lit(""))).alias("h")).agg(F.count("*").alias("n")).where("n > 1")


# shingle sets, the first of each class of equal sets, and the links between these
_SETS = f"""x AS (SELECT doc_id, list_sort(list_distinct({S.shingled('w', 5)})) AS s FROM (SELECT doc_id, {S.words('text', TOKENS)} AS w FROM documents)), m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS first, s FROM x),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM m WHERE doc_id = first), j AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*)::DOUBLE / (any_value(a.n) + any_value(b.n) - count(*)) AS jaccard FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id)"""
_LINKS = "SELECT 'link' AS kind, a, b, round(jaccard, 9) AS jaccard FROM j WHERE jaccard >= 0.85 UNION ALL SELECT 'copy', first, doc_id, 1.0 FROM m WHERE doc_id != first"


def _greedy_sql(links: str, before: str) -> str:
    """Links (kind, a, b) resolved in order: one step per node with a link."""
    return f"""WITH RECURSIVE {before}, l AS ({links}), e AS (SELECT a, b FROM l WHERE kind = 'link'), v AS (SELECT id, row_number() OVER (ORDER BY id) AS i FROM (SELECT a AS id FROM e UNION SELECT b FROM e)),
n AS MATERIALIZED (SELECT v.i, v.id, coalesce(list(e.a) FILTER (e.a IS NOT NULL), []) AS earlier FROM v LEFT JOIN e ON e.b = v.id GROUP BY v.i, v.id),
g(i, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT n.i, CASE WHEN list_has_any(g.kept, n.earlier) THEN g.kept ELSE list_append(g.kept, n.id) END FROM g JOIN n ON n.i = g.i + 1),
k AS (SELECT kept FROM g ORDER BY i DESC LIMIT 1), d AS (SELECT id, list_contains(kept, id) AS kept, CASE WHEN list_contains(kept, id) THEN id ELSE list_min(list_intersect(kept, earlier)) END AS representative_id FROM n, k)
SELECT * FROM d UNION ALL SELECT l.b, false, coalesce(d.representative_id, l.a) FROM l LEFT JOIN d ON d.id = l.a WHERE l.kind = 'copy' UNION ALL SELECT DISTINCT a, true, a FROM l WHERE kind = 'copy' AND a NOT IN (SELECT id FROM d)"""


@query(f"WITH {_SETS} {_LINKS}")
def jaccard_pairs(spark, d):
    """Links between the first of each class of equal sets, and copies of these."""
    return similarity.jaccard_links(spread(docs(spark, d, "doc_id", "text"))).select("kind", "a", "b", F.round("jaccard", 9).alias("jaccard"))


@query(_greedy_sql(_LINKS, _SETS))
def dedup_jaccard_greedy(spark, d):
    return dedup.greedy_links(similarity.jaccard_links(spread(docs(spark, d, "doc_id", "text"))))


# SimHash over md5, as SQL has it
_SIM = rf"""q AS (SELECT doc_id, i, md5_number_upper(s[i]) AS h FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {S.shingled('w', 5)} AS s FROM (SELECT doc_id, {S.words('text', chr(92) + 'p{L}+')} AS w FROM documents)))),
t AS (SELECT doc_id, bit, 2 * sum(((h >> bit) & 1)::BIGINT) >= count(*) AS one FROM q, (SELECT unnest(range(64))::UBIGINT AS bit) GROUP BY doc_id, bit), z AS (SELECT doc_id, sum(CASE WHEN one THEN (1::UBIGINT << bit) ELSE 0 END)::UBIGINT AS h FROM t GROUP BY doc_id),
h AS (SELECT d.doc_id AS id, coalesce(z.h, 0) AS h FROM documents d LEFT JOIN z USING (doc_id)), f AS (SELECT h, min(id) AS id FROM h GROUP BY h)"""
_NEAR = "SELECT 'link' AS kind, a.id AS a, b.id AS b, bit_count(xor(a.h, b.h))::INTEGER AS distance FROM f a JOIN f b ON a.id < b.id AND bit_count(xor(a.h, b.h)) <= 3 UNION ALL SELECT 'copy', f.id, h.id, 0 FROM h JOIN f USING (h) WHERE f.id < h.id"


def _simhashes(spark, d):
    return similarity.simhash(spread(docs(spark, d, "doc_id", "text")), hasher="md5")


@query(f"WITH {_SIM} {_NEAR}")
def simhash_pairs(spark, d):
    return similarity.simhash_pairs(_simhashes(spark, d))


@query(_greedy_sql(f"SELECT kind, a, b FROM ({_NEAR})", _SIM))
def dedup_simhash_greedy(spark, d):
    return dedup.greedy_links(similarity.simhash_pairs(_simhashes(spark, d)))


@query(f"SELECT doc_id FROM documents WHERE {S.key('text')} IN (SELECT {S.key('text')} FROM eval_items UNION SELECT {S.key('text')} FROM documents WHERE doc_id IN (SELECT document_id FROM rejected_documents))")
def decontam_exact(spark, d):
    """Documents whose text is that of an evaluation item or of a document that an older run refused."""
    keyed = T.composed(spread(docs(spark, d, "doc_id", "text")), "text").select("doc_id", F.sha2(T.composed_key(F.col("text")), 256).alias("k"))
    refused = table(spark, d, "rejected_documents", F.col("document_id").alias("doc_id")).distinct()
    blocked = table(spark, d, "eval_items", "text").select(T.content_hash(F.col("text")).alias("k")).union(keyed.join(refused, "doc_id", "left_semi").select("k")).distinct()
    return keyed.join(blocked, "k", "left_semi").select("doc_id")


_LONG = f"SELECT k FROM (SELECT {S.key('text')} AS k FROM eval_items UNION SELECT {S.key('prompt')} FROM eval_items) WHERE length(k) >= 40"


@query(f"SELECT DISTINCT doc_id FROM (SELECT doc_id, {S.key('text')} AS t FROM documents) JOIN ({_LONG}) ON contains(t, k)")
def decontam_contains(spark, d):
    """Documents that contain an evaluation text or prompt of at least 40 characters."""
    return similarity.contaminated(docs(spark, d, "doc_id", "text"), table(spark, d, "eval_items", "prompt", "text")).select(F.col("id").alias("doc_id"))


_RUN8 = lambda t, k: f"SELECT {k}, unnest(list_distinct({S.shingled('w', 8)})) AS run FROM (SELECT {k}, {S.words('text')} AS w FROM {t}) WHERE len(w) >= 8"


@query(f"WITH d AS ({_RUN8('documents', 'doc_id')}), i AS ({_RUN8('eval_items', 'item_id')}) SELECT item_id, doc_id, count(*) AS hits FROM d JOIN i USING (run) GROUP BY ALL")
def ngram_overlap(spark, d):
    return similarity.ngram_overlap(spread(docs(spark, d, "doc_id", "text")), table(spark, d, "eval_items", "item_id", "text"))


_SNIP = "SELECT item_id, 'text' AS field, text AS snippet FROM eval_items UNION SELECT item_id, 'prompt', prompt FROM eval_items UNION SELECT item_id, 'keyword', unnest(expected_keywords) FROM eval_items"


@query(f"SELECT item_id, field, snippet, count(*) AS docs FROM ({_SNIP}) s JOIN documents d ON contains(d.text, s.snippet) WHERE (field = 'prompt' AND length(snippet) >= 1) OR length(snippet) >= 12 GROUP BY ALL")
def leakage_report(spark, d):
    """Literal containment by field of evaluation items in the corpus."""
    e = table(spark, d, "eval_items", "item_id", "prompt", "text", "expected_keywords")
    snips = e.select("item_id", F.lit("text").alias("field"), F.col("text").alias("snippet")).union(e.select("item_id", F.lit("prompt"), "prompt")).union(e.select("item_id", F.lit("keyword"), F.explode("expected_keywords"))).distinct()
    snips = snips.where(((F.col("field") == "prompt") & (F.length("snippet") >= 1)) | (F.length("snippet") >= 12))
    found = similarity.containing(docs(spark, d, "doc_id", "text"), snips).distinct().groupBy("snippet").agg(F.count("*").alias("docs"))
    return snips.join(found, "snippet").select("item_id", "field", "snippet", "docs")


@query("""SELECT item_id, len(expected_keywords) AS expected, len(list_filter(expected_keywords, lambda k: contains(lower(text), lower(k)))) AS matched, len(list_filter(expected_keywords, lambda k: NOT contains(lower(text), lower(k)))) = 0 AS passed FROM eval_items""")
def eval_keyword_score(spark, d):
    """Passes when every expected keyword occurs; without keywords an item passes."""
    k, t = F.col("expected_keywords"), F.lower("text")
    got = F.size(F.filter(k, lambda x: F.contains(t, F.lower(x))))
    return table(spark, d, "eval_items", "item_id", "text", "expected_keywords").select("item_id", F.size(k).cast("long").alias("expected"), got.cast("long").alias("matched"), (got == F.size(k)).alias("passed"))
