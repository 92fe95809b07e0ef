"""Queries on allocation, orders, token ids, inspection of samples, gates and comparisons."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import allocate, filters, instruct, mojibake, select, similarity, tokenizer
from ..session import cut_lineage, spread, table
from . import fragments as S
from .catalogue import query
from .instruct_queries import _KIND, _SCORE, _texts, pairs
from .select_queries import _ID, SEED, seeded


def docs(spark, d, *columns):
    return table(spark, d, "documents", *columns)


_K = f"sha256('{SEED}:' || {_ID})"
# rows in order of source and seeded hash, one after the other: what was picked, and the sum of the current source
_UNIQUE = f"""o AS MATERIALIZED (SELECT source, doc_id, n_chars, h, row_number() OVER (ORDER BY source, k, doc_id) AS i FROM (SELECT source, doc_id, n_chars, sha256({S.key('text')}) AS h, {_K} AS k FROM documents WHERE source IS NOT NULL)),
g(i, source, doc_id, total, seen, picked) AS (SELECT 0::BIGINT, ''::VARCHAR, 0::BIGINT, 0::BIGINT, []::VARCHAR[], false UNION ALL SELECT i, source, doc_id, CASE WHEN ok THEN t + n_chars ELSE t END, CASE WHEN ok THEN list_append(seen, h) ELSE seen END, ok FROM
(SELECT o.*, g.seen, CASE WHEN g.source = o.source THEN g.total ELSE 0 END AS t, NOT list_contains(g.seen, o.h) AND t < 20000 AND t + o.n_chars <= 21000 AS ok FROM g JOIN o ON o.i = g.i + 1))"""


@query(f"WITH RECURSIVE {_UNIQUE} SELECT source, doc_id, total AS running FROM g WHERE picked")
def unique_budget(spark, d):
    """Each source up to 20,000 characters in seeded order; contents picked before take nothing of the budget."""
    keyed = T.composed(spread(docs(spark, d, "source", "doc_id", "n_chars", "text")), "text")
    rows = keyed.select("source", "doc_id", "n_chars", F.sha2(T.composed_key(F.col("text")), 256).alias("h"), seeded().alias("k"))
    return allocate.unique_budget(rows, 20_000, 21_000, size="n_chars")[0]


@query("""WITH a AS (SELECT source, sum(n_chars) FILTER (lang = 'tr') AS tr, sum(n_chars) FILTER (lang = 'en') AS en FROM documents WHERE source IS NOT NULL AND lang IN ('tr', 'en') GROUP BY source), b AS (SELECT source, coalesce(tr, 0) AS tr, coalesce(en, 0) AS en, tr > 0 AND en > 0 AS mixed FROM a),
t AS (SELECT *, least(tr, 60000) AS mt, greatest(0, least(least(tr, 60000), 200000 - coalesce(sum(least(tr, 60000)) OVER w, 0))) AS gt FROM b WINDOW w AS (ORDER BY coalesce(mixed, false), source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT *, greatest(0, least(least(en, 60000 - gt), 150000 - coalesce(sum(least(en, 60000 - gt)) OVER w, 0))) AS ge FROM t WINDOW w AS (ORDER BY coalesce(mixed, false), source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT source, 'tr' AS lang, tr::BIGINT AS available, gt::BIGINT AS allocated FROM e WHERE tr > 0 UNION ALL SELECT source, 'en', en::BIGINT, ge::BIGINT FROM e WHERE en > 0""")
def source_allocation(spark, d):
    """200,000 Turkish and 150,000 English characters over the sources, at most 60,000 from each."""
    a = docs(spark, d, "source", "lang", "n_chars").where("source is not null").groupBy("source", "lang").agg(F.sum("n_chars").alias("available"))
    return allocate.allocation(a, {"tr": 200_000, "en": 150_000}, 60_000)


_DIM = {"lang": {"tr": 30, "en": 20, "de": 4}, "category": {"general_prose": 20, "technical_documentation": 15, "educational": 10, "web_crawl": 8}}
_LEFT = lambda c: "CASE " + c + " " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in _DIM[c].items()) + " ELSE 0 END"


@query(f"""WITH RECURSIVE o AS MATERIALIZED (SELECT doc_id, lang, category, row_number() OVER (ORDER BY {_K}, doc_id) AS i FROM documents WHERE {_LEFT('lang')} > 0 AND {_LEFT('category')} > 0),
g(i, doc_id, picked, langs, categories) AS (SELECT 0::BIGINT, 0::BIGINT, false, []::VARCHAR[], []::VARCHAR[] UNION ALL SELECT i, doc_id, ok, CASE WHEN ok THEN list_append(langs, lang) ELSE langs END, CASE WHEN ok THEN list_append(categories, category) ELSE categories END FROM
(SELECT o.*, g.langs, g.categories, len(list_filter(g.langs, lambda x: x = o.lang)) < {_LEFT('lang').replace('CASE lang', 'CASE o.lang')} AND len(list_filter(g.categories, lambda x: x = o.category)) < {_LEFT('category').replace('CASE category', 'CASE o.category')} AS ok FROM g JOIN o ON o.i = g.i + 1))
SELECT doc_id, row_number() OVER (ORDER BY i) - 1 AS rank FROM g WHERE picked""")
def dimension_targets(spark, d):
    """Documents in seeded order while both their language and their category are below target."""
    return allocate.target_counts(docs(spark, d, "doc_id", "lang", "category"), "doc_id", seeded(), _DIM)


@query(f"""WITH RECURSIVE s AS (SELECT g, n, row_number() OVER (ORDER BY sha256('tie|{SEED}|' || g)) AS j FROM (SELECT coalesce(category, '') AS g, count(*)::DOUBLE AS n FROM documents GROUP BY ALL)), l AS (SELECT list(n ORDER BY j) AS n, list(g ORDER BY j) AS g, sum(n) AS total FROM s),
p(pos, last, pick, used) AS (SELECT -1::BIGINT, -1::BIGINT, -1::BIGINT, list_transform(n, lambda x: 0::DOUBLE) FROM l UNION ALL SELECT pos + 1, k, k, list_transform(used, lambda u, i: CASE WHEN i = k THEN u + 1 ELSE u END) FROM
(SELECT pos, used, CASE WHEN len(best) > 1 AND best[1] = last THEN best[2] ELSE best[1] END AS k FROM (SELECT pos, last, used, list_filter(range(1, len(l.n) + 1), lambda i: b[i] = list_max(b)) AS best FROM (SELECT p.*, l.n, l.total, list_transform(l.n, lambda x, i: CASE WHEN p.used[i] < x THEN (p.pos + 2) * x / l.total - p.used[i] ELSE -1e9 END) AS b FROM p, l) q, l)) r, l WHERE pos + 1 < l.total),
m AS (SELECT pos, l.g[pick] AS g, row_number() OVER (PARTITION BY pick ORDER BY pos) AS k FROM p, l WHERE pos >= 0), d AS (SELECT doc_id, coalesce(category, '') AS g, row_number() OVER (PARTITION BY coalesce(category, '') ORDER BY sha256('{SEED}|' || {_ID}), doc_id) AS k FROM documents)
SELECT pos AS position, m.g AS category, doc_id FROM m JOIN d ON m.g = d.g AND m.k = d.k""")
def stratified_order(spark, d):
    """All documents in one order, at each place from the category furthest behind its share."""
    return allocate.interleaved(docs(spark, d, "doc_id", "category"), "category", "doc_id", SEED)


_ORDER = "CASE category WHEN 'general_prose' THEN 1 WHEN 'educational' THEN 2 WHEN 'technical_documentation' THEN 3 WHEN 'code_and_structured' THEN 4 ELSE 9 END"


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {_ORDER}, doc_id) - 1 AS position FROM documents")
def curriculum_positions(spark, d):
    """Every document's place when categories follow one another."""
    c = F.col("category")
    bucket = F.when(c == "general_prose", 1).when(c == "educational", 2).when(c == "technical_documentation", 3).when(c == "code_and_structured", 4).otherwise(9)
    return select.global_rank(docs(spark, d, "doc_id", "category").select("doc_id", bucket.alias("b")), [F.col("b"), F.col("doc_id")], "position").select("doc_id", "position")


@query("""WITH s AS (SELECT doc_id, text, coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s, length(text) AS n FROM documents), w AS (SELECT seq, greatest(s, seq * 512) AS a, substr(text, greatest(seq * 512 - s, 0) + 1, least(s + n, (seq + 1) * 512) - greatest(s, seq * 512)) AS part FROM (SELECT *, unnest(range(s // 512, (s + n - 1) // 512 + 1)) AS seq FROM s WHERE n > 0))
SELECT seq, count(*) AS docs, sha256(string_agg(part, '' ORDER BY a)) AS h FROM w GROUP BY seq HAVING sum(length(part)) = 512""")
def character_sequences(spark, d):
    """Sequences of 512 characters of the corpus laid end to end; the tail that doesn't fill one is dropped."""
    size = 512
    per = docs(spark, d, "doc_id", "text").withColumn("n", F.length("text").cast("long"))
    placed = select.running(per, [F.col("doc_id")], F.col("n"), "s").where("n > 0")
    cut = placed.withColumn("seq", F.explode(F.sequence(F.floor(F.col("s") / size), F.floor((F.col("s") + F.col("n") - 1) / size))))
    a, b = F.greatest(F.col("s"), F.col("seq") * size), F.least(F.col("s") + F.col("n"), (F.col("seq") + 1) * size)
    parts = cut.select("seq", a.alias("a"), F.substr("text", (a - F.col("s") + 1).cast("int"), (b - a).cast("int")).alias("part"))
    whole = parts.groupBy("seq").agg(F.count("*").alias("docs"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "part"))), lambda x: x["part"]), "").alias("t"))  # 512 characters
    return whole.where(F.length("t") == size).select("seq", "docs", F.sha2("t", 256).alias("h"))


# pieces of every distinct word from left to right; what no piece fits is its bytes
_IDS = r"""p AS (SELECT piece, min(piece_id) AS id FROM tokenizer_pieces WHERE kind = 'normal' AND piece != '' GROUP BY piece), k AS (SELECT unnest(range(1, (SELECT max(length(piece)) FROM p) + 1)) AS k), z AS (SELECT piece, piece_id AS id FROM tokenizer_pieces WHERE kind = 'byte'),
d AS (SELECT doc_id, lang, text, string_split_regex(text, '[ \t\r\n]+') AS ws FROM documents), w AS (SELECT DISTINCT unnest(ws) AS word FROM d),
r(word, rest, ids) AS (SELECT word, '▁' || word, []::INTEGER[] FROM w WHERE word != '' UNION ALL SELECT word, substr(rest, coalesce(longest, 1) + 1), list_concat(ids, CASE WHEN longest IS NULL THEN list_transform(range(0, strlen(substr(rest, 1, 1))), lambda j: -1) ELSE [best] END)
FROM (SELECT r.word, r.rest, r.ids, max(CASE WHEN p.piece IS NOT NULL THEN k.k END) AS longest, max_by(p.id, CASE WHEN p.piece IS NOT NULL THEN k.k END) AS best FROM r CROSS JOIN k LEFT JOIN p ON p.piece = substr(r.rest, 1, k.k) WHERE r.rest != '' GROUP BY ALL)), c AS (SELECT word, ids FROM r WHERE rest = '')"""


@query(f"""WITH RECURSIVE {_IDS}, x AS (SELECT doc_id, i, ws[i] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)), n AS (SELECT x.doc_id, sum(coalesce(len(c.ids), 0))::INTEGER + 1 AS n_tokens, sum(coalesce(len(list_filter(c.ids, lambda v: v = -1)), 0))::INTEGER AS byte_tokens FROM x LEFT JOIN c USING (word) GROUP BY x.doc_id)
SELECT doc_id, n_tokens, byte_tokens, 0 AS unknown, NOT contains(text, '▁') AS same FROM n JOIN d USING (doc_id)""")
def token_round_trip(spark, d):
    """Tokens, byte tokens and unknown ones of every text, and whether its ids spell it again."""
    return tokenizer.round_trip(spread(docs(spark, d, "doc_id", "text")), table(spark, d, "tokenizer_pieces"))


@query(f"""WITH RECURSIVE {_IDS}, x AS (SELECT doc_id, lang, unnest(ws) AS word FROM d), n AS (SELECT doc_id, lang, sum(coalesce(len(c.ids), 0)) + 1 AS n, sum(coalesce(len(list_filter(c.ids, lambda v: v = -1)), 0)) AS b FROM x LEFT JOIN c USING (word) GROUP BY ALL)
SELECT n.lang, count(*) AS docs, round(sum(n.n)::DOUBLE / sum(length(d.text)), 6) AS tokens_per_char, round(sum(n.b)::DOUBLE / sum(n.n), 6) AS byte_rate, 0.0::DOUBLE AS unknown_rate, count(*) FILTER (contains(d.text, '▁')) AS failures FROM n JOIN d ON n.doc_id = d.doc_id GROUP BY n.lang""")
def tokenizer_efficiency(spark, d):
    """Tokens a character, shares of byte and unknown tokens, and failed round trips by language."""
    own = docs(spark, d, "doc_id", "lang", "text")
    trip = tokenizer.round_trip(spread(own.select("doc_id", "text")), table(spark, d, "tokenizer_pieces"))
    j = own.select("doc_id", "lang", F.length("text").alias("chars")).join(trip, "doc_id")
    return j.groupBy("lang").agg(F.count("*").alias("docs"), F.round(F.sum("n_tokens") / F.sum("chars"), 6).alias("tokens_per_char"), F.round(F.sum("byte_tokens") / F.sum("n_tokens"), 6).alias("byte_rate"), F.round(F.sum("unknown") / F.sum("n_tokens"), 6).alias("unknown_rate"), F.sum((~F.col("same")).cast("long")).alias("failures"))


@query(rf"""WITH x AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS pos, CASE WHEN b < 90 THEN 'train' WHEN b < 95 THEN 'validation' WHEN b < 99 THEN 'eval' ELSE 'other' END AS split, lang, text, n_chars > 3000 AS large FROM (SELECT *, {S.hash_bucket(_ID, 100)} AS b FROM documents)),
y AS (SELECT *, CASE WHEN split = 'other' THEN 'invalid_split' WHEN coalesce(lang, '') NOT IN ('tr', 'en') THEN 'invalid_language' WHEN regexp_matches(text, '^\s*$') THEN 'empty_text' END AS own FROM x), f AS (SELECT text, min_by(split, pos) AS s, min(pos) AS p FROM y WHERE own IS NULL AND NOT large GROUP BY text)
SELECT doc_id, coalesce(own, CASE WHEN f.p < y.pos AND f.s != y.split THEN 'cross_split_duplicate_text' WHEN large THEN 'document_exceeds_shard_cap' END, 'admitted') AS reason FROM y LEFT JOIN f USING (text)""")
def token_admission(spark, d):
    """Who is tokenized: valid split and language, no text that another split has, at most 3,000 characters."""
    b = T.hash_bucket(F.col("doc_id").cast("string"), 100)
    split = F.when(b < 90, "train").when(b < 95, "validation").when(b < 99, "eval").otherwise("other")
    rows = docs(spark, d, "doc_id", "lang", "text", "n_chars").select("doc_id", F.col("doc_id").alias("pos"), split.alias("split"), "lang", "text", F.col("n_chars").alias("size"))
    return tokenizer.admission(rows, 3000).select("doc_id", F.coalesce("reason", F.lit("admitted")).alias("reason"))


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_LINES = "SELECT ext_id, i AS line_number, l[i] AS line FROM (SELECT ext_id, string_split(text, chr(10)) AS l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT DISTINCT ext_id, text FROM extracted_documents))"


@query(f"""WITH l AS ({_LINES}) SELECT ext_id, line_number::INTEGER AS line_number, substring FROM (SELECT DISTINCT ext_id, line_number, unnest(list_concat(CASE WHEN contains(line, '�') THEN ['�'] ELSE [] END, list_filter([{', '.join(map(_literal, mojibake.REPAIRS))}], lambda x: contains(line, x)),
regexp_extract_all(line, '{mojibake.REPEATED}'), regexp_extract_all(line, '{mojibake.CLUSTER}'))) AS substring FROM l)""")
def mojibake_findings(spark, d):
    """Broken substrings of every line."""
    return mojibake.findings(spread(table(spark, d, "extracted_documents", "ext_id", "text").distinct())).select("ext_id", "line_number", "substring")


@query()
def mojibake_severities(spark, d):
    """Findings by severity, and how many have a repair (the repair itself is no SQL)."""
    f = mojibake.findings(spread(table(spark, d, "extracted_documents", "ext_id", "text").distinct()))
    return f.groupBy("severity").agg(F.count("*").alias("findings"), F.sum(F.col("safe").cast("long")).alias("repaired"))


# Fixed values of the inspection of samples.
SAMPLE_SECRET = r"(?i)(?:api[_-]?key|secret|password|token)\s*[:=]\s*['\"]?[A-Za-z0-9_\-]{12,}|-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"
_QUALITY = r"""SELECT doc_id, source, text, n, alpha, greatest(0.0, least(1.0, 0.35 * least(1.0, n / 1000.0) + 0.35 * alpha + 0.15 * (1 - symbol) + 0.15 * (1 - rep))) AS score FROM (SELECT doc_id, source, text, length(text) AS n, length(regexp_replace(text, '[^\p{L}]', '', 'g'))::DOUBLE / greatest(length(text), 1) AS alpha,
1 - length(regexp_replace(text, '[^\p{L}\p{N}\p{Z}\s]', '', 'g'))::DOUBLE / greatest(length(text), 1) AS symbol, CASE WHEN len(k) = 0 THEN 0.0 ELSE 1 - len(list_distinct(k))::DOUBLE / len(k) END AS rep FROM (SELECT *, list_filter(""" + S.kept_lines(S.casefold("text")) + """, lambda x: length(x) >= 20) AS k FROM documents))"""


@query(f"""WITH q AS ({_QUALITY}), a AS (SELECT q.*, sha256({S.key('text')}) AS k, CASE WHEN n < 120 OR alpha < 0.35 OR contains(text, '�') OR score < 0.40 THEN 'quality' WHEN regexp_matches(text, '{SAMPLE_SECRET.replace(chr(39), chr(39) * 2)}') THEN 'secret' END AS early FROM q),
x AS (SELECT *, min(CASE WHEN early IS NULL THEN doc_id END) OVER (PARTITION BY k) AS first FROM a), o AS (SELECT DISTINCT ext_id, text, sha256({S.key('text')}) AS h FROM extracted_documents), b AS (SELECT x.*, x.k IN (SELECT h FROM o) AS old FROM x)
SELECT doc_id, source, coalesce(early, CASE WHEN doc_id != first THEN 'exact_duplicate' WHEN old THEN 'historical_exact' END, 'accepted') AS reason FROM b""")
def sample_inspection(spark, d):
    """What becomes of every document when the corpus is inspected as a sample against the extracted documents: quality,
    secrets, exact duplicates, texts that were there before."""
    return _inspected(spark, d).select("doc_id", "source", F.coalesce("reason", F.lit("accepted")).alias("reason"))


def _inspected(spark, d):
    own = T.composed(spread(docs(spark, d, "doc_id", "source", "text")).withColumn("c", F.col("text")), "c").withColumn("k", F.sha2(T.composed_key(F.col("c")), 256)).drop("c")
    n = F.greatest(F.length("text"), F.lit(1))
    alpha, symbol = T.count_class(F.col("text"), r"\p{L}") / n, 1 - T.count_class(F.col("text"), r"\p{L}\p{N}\p{Z}\s") / n
    lines = F.filter(T.stripped_lines(T.casefold(F.col("text"))), lambda x: F.length(x) >= 20)
    rep = F.when(F.size("lines") == 0, 0.0).otherwise(1 - F.size(F.array_distinct("lines")) / F.size("lines"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.35 * F.least(F.lit(1.0), F.length("text") / 1000.0) + 0.35 * F.col("alpha") + 0.15 * (1 - F.col("symbol")) + 0.15 * (1 - F.col("rep"))))
    m = own.withColumns({"alpha": alpha, "symbol": symbol, "lines": lines}).withColumn("rep", rep)
    poor = (F.length("text") < 120) | (F.col("alpha") < 0.35) | F.contains("text", F.lit("�")) | (score < 0.40)
    judged = cut_lineage(m.select("doc_id", "source", F.length("text").alias("n"), "k", F.when(poor, "quality").when(F.col("text").rlike(SAMPLE_SECRET), "secret").alias("early")))
    first = judged.where("early is null").groupBy("k").agg(F.min("doc_id").alias("first"))
    old = T.composed(spread(table(spark, d, "extracted_documents", "text")), "text").select(F.sha2(T.composed_key(F.col("text")), 256).alias("k")).distinct().withColumn("old", F.lit(True))
    reason = F.coalesce("early", F.when(F.col("doc_id") != F.col("first"), "exact_duplicate").when(F.col("old"), "historical_exact"))
    return judged.join(first, "k", "left").join(old, "k", "left").select("doc_id", "source", "n", reason.alias("reason"))


@query()
def historical_near(spark, d):
    """Documents whose SimHash is at most three bits from that of a sample, one in sixteen by content hash, of the
    extracted documents (md5 shingles), with the number of such."""
    old = T.composed(table(spark, d, "extracted_documents", "ext_id", "text").distinct(), "text").withColumn("h", F.sha2(T.composed_key(F.col("text")), 256)).where(F.conv(F.substring("h", 1, 2), 16, 10).cast("int") % 16 == 0)
    return similarity.simhash_match_counts(similarity.simhash(spread(docs(spark, d, "doc_id", "text"))), similarity.simhash(old.select(F.col("ext_id").alias("doc_id"), "text"))).select(F.col("a").alias("doc_id"), "matches")


@query(f"""WITH q AS ({_QUALITY}), a AS (SELECT q.*, sha256({S.key('text')}) AS k, CASE WHEN n < 120 OR alpha < 0.35 OR contains(text, '�') OR score < 0.40 THEN 1 WHEN regexp_matches(text, '{SAMPLE_SECRET.replace(chr(39), chr(39) * 2)}') THEN 2 END AS early FROM q), x AS (SELECT *, min(CASE WHEN early IS NULL THEN doc_id END) OVER (PARTITION BY k) AS first FROM a),
o AS (SELECT DISTINCT sha256({S.key('text')}) AS h FROM extracted_documents), s AS (SELECT source, n, coalesce(early, CASE WHEN doc_id != first THEN 3 WHEN k IN (SELECT h FROM o) THEN 4 END, 5) AS stage FROM x)
SELECT source, sum(n)::BIGINT AS chars, sum(CASE WHEN stage > 1 THEN n ELSE 0 END)::BIGINT AS post_quality, sum(CASE WHEN stage > 2 THEN n ELSE 0 END)::BIGINT AS post_secrets, sum(CASE WHEN stage > 3 THEN n ELSE 0 END)::BIGINT AS post_dedup, sum(CASE WHEN stage > 4 THEN n ELSE 0 END)::BIGINT AS post_overlap, round(1 - sum(CASE WHEN stage > 4 THEN n ELSE 0 END)::DOUBLE / sum(n), 6) AS loss,
floor(0.75 * sum(CASE WHEN stage > 4 THEN n ELSE 0 END))::BIGINT AS expected, floor(0.75 * floor(0.75 * sum(CASE WHEN stage > 4 THEN n ELSE 0 END)))::BIGINT AS conservative FROM s GROUP BY source""")
def sample_funnel(spark, d):
    """Characters of each source that pass each stage, the loss, and what a careful estimate leaves of the rest."""
    stage = F.when(F.col("reason") == "quality", 1).when(F.col("reason") == "secret", 2).when(F.col("reason") == "exact_duplicate", 3).when(F.col("reason") == "historical_exact", 4).otherwise(5)
    after = lambda k: F.sum(F.when(F.col("stage") > k, F.col("n")).otherwise(0))
    s = _inspected(spark, d).withColumn("stage", stage).groupBy("source").agg(F.sum("n").alias("chars"), after(1).alias("post_quality"), after(2).alias("post_secrets"), after(3).alias("post_dedup"), after(4).alias("post_overlap"))
    expected = F.floor(0.75 * F.col("post_overlap"))
    return s.select("*", F.round(1 - F.col("post_overlap") / F.col("chars"), 6).alias("loss"), expected.alias("expected"), F.floor(0.75 * expected).alias("conservative"))


@query("""WITH r AS (SELECT run_id, ext_id, max(CASE WHEN reason IS NULL THEN 1 ELSE 0 END) AS ok FROM quality_results GROUP BY ALL), a AS (SELECT * FROM r WHERE run_id = (SELECT min(run_id) FROM r)), b AS (SELECT * FROM r WHERE run_id = (SELECT max(run_id) FROM r))
SELECT CASE WHEN a.ok IS NULL THEN 'only_after' WHEN b.ok IS NULL THEN 'only_before' WHEN a.ok = 1 AND b.ok = 1 THEN 'still_passing' WHEN b.ok = 1 THEN 'newly_passed' WHEN a.ok = 1 THEN 'newly_failed' ELSE 'still_failing' END AS status, count(*) AS n FROM a FULL JOIN b ON a.ext_id = b.ext_id GROUP BY ALL""")
def run_transitions(spark, d):
    """Documents by what became of them between the first and the last run."""
    r = cut_lineage(table(spark, d, "quality_results", "run_id", "ext_id", "reason").groupBy("run_id", "ext_id").agg(F.max(F.col("reason").isNull().cast("int")).alias("ok")))
    ends = r.agg(F.min("run_id").alias("lo"), F.max("run_id").alias("hi"))
    one = lambda c: r.join(F.broadcast(ends)).where(F.col("run_id") == F.col(c))
    j = one("lo").select("ext_id", F.col("ok").alias("a")).join(one("hi").select("ext_id", F.col("ok").alias("b")), "ext_id", "full")
    status = F.when(F.col("a").isNull(), "only_after").when(F.col("b").isNull(), "only_before").when((F.col("a") == 1) & (F.col("b") == 1), "still_passing").when(F.col("b") == 1, "newly_passed").when(F.col("a") == 1, "newly_failed").otherwise("still_failing")
    return j.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("SELECT source_id, count(*) AS n, round(avg(CASE WHEN reason IS NULL THEN 1.0 ELSE 0.0 END), 6) AS rate, round(avg(round(language_confidence * 10000)), 4) AS mean, max(language_confidence) AS highest, round(exp(least(avg(-ln(greatest(language_confidence, 1e-9))), 20)), 4) AS perplexity FROM quality_results GROUP BY source_id")
def detector_summary(spark, d):
    """Rate, mean, maximum and perplexity of the detector's confidence by source (mean in ten-thousandths)."""
    c = F.col("language_confidence")
    return table(spark, d, "quality_results", "source_id", "reason", "language_confidence").groupBy("source_id").agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("reason").isNull().cast("double")), 6).alias("rate"), F.round(F.avg(F.round(c * 10000)), 4).alias("mean"), F.max(c).alias("highest"), F.round(F.exp(F.least(F.avg(-F.ln(F.greatest(c, F.lit(1e-9)))), F.lit(20.0))), 4).alias("perplexity")
    )


_CAPS = {"source": 15, "family": 20, "category": 40}


@query("WITH t AS (SELECT source, split_part(source, '_', 1) AS family, category, n_chars FROM documents), a AS (SELECT sum(n_chars) AS n FROM t) " + " UNION ALL ".join(f"SELECT '{k}' AS kind, {k} AS name, round(100.0 * sum(n_chars) / any_value(a.n), 6) AS percent, 100.0 * sum(n_chars) / any_value(a.n) > {cap} AS over FROM t, a WHERE {k} IS NOT NULL GROUP BY {k}" for k, cap in _CAPS.items()))
def concentration_caps(spark, d):
    """Share of each source, family of sources and category, and whether it passes its cap."""
    t = cut_lineage(docs(spark, d, "source", "category", "n_chars").groupBy("source", "category").agg(F.sum("n_chars").alias("n")).withColumn("family", F.substring_index("source", "_", 1)))
    total = t.agg(F.sum("n").alias("total"))
    parts = [t.where(F.col(k).isNotNull()).groupBy(F.lit(k).alias("kind"), F.col(k).alias("name")).agg(F.sum("n").alias("n"), F.lit(cap).alias("cap")) for k, cap in _CAPS.items()]
    each = parts[0].union(parts[1]).union(parts[2]).join(F.broadcast(total))
    percent = 100.0 * F.col("n") / F.col("total")
    return each.select("kind", "name", F.round(percent, 6).alias("percent"), (percent > F.col("cap")).alias("over"))


@query(rf"""SELECT (SELECT count(*) - count(DISTINCT doc_id) FROM documents) AS repeated_ids, (SELECT count(*) - count(DISTINCT sha256({S.key('text')})) FROM documents) AS duplicate_texts, (SELECT count(*) FROM documents WHERE regexp_matches(text, '^\s*$')) AS empty, (SELECT count(*) FROM documents WHERE contains(text, '�')) AS replacements,
(SELECT count(*) FROM documents WHERE n_chars != length(text)) AS wrong_sizes, (SELECT count(*) FROM documents WHERE ext_id IS NOT NULL AND ext_id NOT IN (SELECT ext_id FROM extracted_documents)) AS dangling""")
def hard_gates(spark, d):
    """Numbers that must be zero before a build is used."""
    own = docs(spark, d, "doc_id", "ext_id", "text", "n_chars")
    keyed = T.composed(spread(own).withColumn("c", F.col("text")), "c").select("doc_id", "ext_id", F.sha2(T.composed_key(F.col("c")), 256).alias("k"), F.col("text").rlike(r"^\s*\z").alias("e"), F.contains("text", F.lit("�")).alias("r"), (F.col("n_chars") != F.length("text")).alias("w"))
    count = lambda c: F.sum(F.coalesce(F.col(c).cast("long"), F.lit(0)))
    simple = keyed.agg(F.count("*").alias("n"), count("e").alias("empty"), count("r").alias("replacements"), count("w").alias("wrong_sizes"))
    ids, texts = keyed.select("doc_id").distinct().agg(F.count("*").alias("i")), keyed.select("k").distinct().agg(F.count("*").alias("t"))
    dangling = own.where("ext_id is not null").select(F.col("ext_id").cast("long").alias("ext_id")).join(table(spark, d, "extracted_documents", "ext_id"), "ext_id", "left_anti").agg(F.count("*").alias("dangling"))
    return simple.join(ids).join(texts).join(dangling).select((F.col("n") - F.col("i")).alias("repeated_ids"), (F.col("n") - F.col("t")).alias("duplicate_texts"), "empty", "replacements", "wrong_sizes", "dangling")  # one row each


@query("SELECT id AS ext_id FROM (SELECT unnest(range(1, (SELECT max(ext_id) FROM extracted_documents) + 1)) AS id) WHERE id NOT IN (SELECT ext_id FROM documents WHERE ext_id IS NOT NULL)")
def missing_coverage(spark, d):
    """Ids up to the largest extracted one that no document of the corpus names."""
    most = table(spark, d, "extracted_documents", "ext_id").agg(F.max("ext_id").alias("m")).first().m or 0
    return spark.range(1, most + 1).withColumnRenamed("id", "ext_id").join(docs(spark, d, "ext_id").where("ext_id is not null").select(F.col("ext_id").cast("long").alias("ext_id")), "ext_id", "left_anti")


_MARKS = ("http", "```", "cookie", "login", "©", "•")


@query("WITH x AS (SELECT lower(text) AS l FROM documents) SELECT marker, sum(n)::BIGINT AS hits, count(*) FILTER (n > 0) AS docs FROM (" + " UNION ALL ".join(f"SELECT '{m}' AS marker, (length(l) - length(replace(l, '{m}', ''))) // {len(m)} AS n FROM x" for m in _MARKS) + ") GROUP BY marker")
def marker_counts(spark, d):
    low = spread(docs(spark, d, "text")).select(F.lower("text").alias("l"))
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("marker"), ((F.length("l") - F.length(F.replace("l", F.lit(m), F.lit("")))) / len(m)).cast("long").alias("n")) for m in _MARKS]))
    return low.select(each.alias("e")).select("e.*").groupBy("marker").agg(F.sum("n").alias("hits"), F.sum((F.col("n") > 0).cast("long")).alias("docs"))


@query(f"""WITH x AS (SELECT pair_id, kind, {_SCORE} AS score, p FROM (SELECT *, {_KIND} AS kind FROM ({_texts()}))) SELECT kind, pair_id, score::INTEGER AS score FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, pair_id) AS k FROM x) WHERE k <= 10""")
def scored_quota(spark, d):
    """The ten pairs with the most programming signs of each category."""
    scored = pairs(spark, d).withColumn("kind", instruct.mix_category()).select("pair_id", "kind", instruct.programming_score().cast("int").alias("score"))
    return select.per_group(scored, "kind", [F.desc("score"), F.col("pair_id")], 10).select("kind", "pair_id", "score")


_HOURLY = "SELECT event_type, h, n, row_number() OVER (PARTITION BY event_type ORDER BY h) AS i, lag(n) OVER (PARTITION BY event_type ORDER BY h) AS prev FROM (SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS h, count(*) AS n FROM events GROUP BY ALL)"


@query(f"""WITH s AS ({_HOURLY}), r AS (SELECT event_type, max(c) AS longest FROM (SELECT event_type, g, count(*) AS c FROM (SELECT event_type, i - row_number() OVER (PARTITION BY event_type ORDER BY i) AS g FROM s WHERE n < prev) GROUP BY ALL) GROUP BY event_type)
SELECT s.event_type, coalesce(any_value(longest), 0) AS worst_run, round(100.0 * (max_by(n, i) - min(n)) / min(n), 6) AS rebound, round(100.0 * (min_by(n, i) - max_by(n, i)) / min_by(n, i), 6) AS improvement FROM s LEFT JOIN r USING (event_type) GROUP BY s.event_type""")
def series_changes(spark, d):
    """Longest run of falling hours, rise from the lowest to the last hour, and fall from the first to the last, percent."""
    h = table(spark, d, "events", "event_type", "ts").groupBy("event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("event_type").orderBy("h")  # hours of one type
    s = cut_lineage(h.withColumns({"i": F.row_number().over(w), "prev": F.lag("n").over(w)}))
    falls = s.where("n < prev").withColumn("g", F.col("i") - F.row_number().over(Window.partitionBy("event_type").orderBy("i"))).groupBy("event_type", "g").agg(F.count("*").alias("c")).groupBy("event_type").agg(F.max("c").alias("worst_run"))
    ends = s.groupBy("event_type").agg(F.max_by("n", "i").alias("last"), F.min_by("n", "i").alias("first"), F.min("n").alias("low"))
    return ends.join(falls, "event_type", "left").select("event_type", F.coalesce("worst_run", F.lit(0)).alias("worst_run"), F.round(100.0 * (F.col("last") - F.col("low")) / F.col("low"), 6).alias("rebound"), F.round(100.0 * (F.col("first") - F.col("last")) / F.col("first"), 6).alias("improvement"))


@query("SELECT ext_id, len(list_filter([regexp_matches(text, '\\p{Latin}'), regexp_matches(text, '\\p{Cyrillic}'), regexp_matches(text, '\\p{Greek}'), regexp_matches(text, '\\p{Arabic}'), regexp_matches(text, '\\p{Hebrew}'), regexp_matches(text, '\\p{Han}')], lambda x: x)) > 1 AS mixed FROM (SELECT DISTINCT ext_id, text FROM extracted_documents)")
def mixed_scripts(spark, d):
    kinds = [F.col("text").rlike(rf"\p{{Is{k}}}").cast("int") for k in ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Han")]
    return spread(table(spark, d, "extracted_documents", "ext_id", "text").distinct()).select("ext_id", (sum(kinds[1:], kinds[0]) > 1).alias("mixed"))


# Patterns that inspections count.
PATTERNS = {
    "emails": filters.EMAIL, "urls": filters.V1_URL, "phones": filters.V1_PHONE, "identity_numbers": r"[1-9][0-9]{10}", "addresses": r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}", "secrets": r"(?i)(?:api[_-]?key|secret|password|token)\s*[:=]\s*['\"]?[A-Za-z0-9_\-]{12,}",
    "private_keys": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", "streets": r"[0-9]{1,6}\s+[A-Za-z][A-Za-z .'-]{2,}\s(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln)", "benchmarks": r"(?i)HumanEval|MBPP|MMLU|GSM8K|benchmark answer|answer key|solution set", "boilerplate": r"(?i)cookie|privacy policy|terms of use|skip to main content|all rights reserved",
}


@query("SELECT ext_id, " + ", ".join(f"len(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}')) AS {n}" for n, p in PATTERNS.items()) + " FROM (SELECT DISTINCT ext_id, text FROM extracted_documents)")
def pattern_scan(spark, d):
    """How often each pattern of an inspection occurs in each text."""
    return spread(table(spark, d, "extracted_documents", "ext_id", "text").distinct()).select("ext_id", *[F.regexp_count("text", F.lit(p)).cast("long").alias(n) for n, p in PATTERNS.items()])


@query(f"WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY {_K}, doc_id) - 1 AS pos FROM documents) SELECT count(*) AS places, count(*) - count(DISTINCT pos) AS repeated, max(pos) + 1 - count(DISTINCT pos) AS missing, count(*) - count(DISTINCT doc_id) AS repeated_ids FROM o")
def order_manifest(spark, d):
    """Whether a seeded order is a complete permutation: places, repeated and missing ones."""
    o = cut_lineage(select.global_rank(docs(spark, d, "doc_id").withColumn("k", seeded()), [F.col("k"), F.col("doc_id")], "pos").select("pos", "doc_id"))
    whole = o.agg(F.count("*").alias("places"), (F.max("pos") + 1).alias("most"))
    places, ids = o.select("pos").distinct().agg(F.count("*").alias("p")), o.select("doc_id").distinct().agg(F.count("*").alias("i"))
    return whole.join(places).join(ids).select("places", (F.col("places") - F.col("p")).alias("repeated"), (F.col("most") - F.col("p")).alias("missing"), (F.col("places") - F.col("i")).alias("repeated_ids"))  # one row each


@query("""WITH s AS (SELECT source, count(*) AS docs, 100.0 * avg(CASE WHEN n_chars >= 500 THEN 1 ELSE 0 END) AS points FROM documents WHERE source IS NOT NULL GROUP BY source) SELECT source, docs, round(points, 6) AS points FROM s WHERE points >= (SELECT max(points) FROM s) - 2 ORDER BY docs, source LIMIT 1""")
def recommended_source(spark, d):
    """The source with the largest share of long texts; of those within two points the smallest."""
    s = docs(spark, d, "source", "n_chars").where("source is not null").groupBy("source").agg(F.count("*").alias("docs"), (100.0 * F.avg((F.col("n_chars") >= 500).cast("int"))).alias("points"))
    return s.withColumn("best", F.max("points").over(Window.partitionBy())).where("points >= best - 2").orderBy("docs", "source").limit(1).select("source", "docs", F.round("points", 6).alias("points"))  # one row per source
