"""Queries on selection, splits, packing, audits and comparisons."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup, select
from ..session import cut_lineage, spread, table
from . import fragments as S
from .catalogue import query

SEED = "corpus-2024"


def docs(spark, d, *columns):
    return table(spark, d, "documents", *columns)


_ID = "doc_id::VARCHAR"


def seeded(id_col="doc_id", sep=":"):
    return F.sha2(F.concat(F.lit(SEED + sep), F.col(id_col).cast("string")), 256)


_RANK = f"sha256('{SEED}:' || {_ID})"


@query(f"SELECT doc_id, CASE WHEN b < 9800 THEN 'train' WHEN b < 9900 THEN 'validation' ELSE 'eval' END AS split FROM (SELECT doc_id, {S.hash_bucket(f'{chr(39)}{SEED}{chr(39)} || chr(10) || c::VARCHAR', 10000)} AS b FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY {S.key('text')}) AS c FROM documents))")
def split_hash(spark, d):
    """Split by hash of the duplicate class, so copies never cross splits."""
    keyed = T.composed(spread(docs(spark, d, "doc_id", "text")), "text").select("doc_id", F.sha2(T.composed_key(F.col("text")), 256).alias("k"))
    rep = dedup.first_by_key(keyed, "k", ["doc_id"], "doc_id")
    b = T.hash_bucket(F.concat(F.lit(SEED + "\n"), F.col("representative_id").cast("string")), 10_000)
    return rep.select("doc_id", F.when(b < 9800, "train").when(b < 9900, "validation").otherwise("eval").alias("split"))


@query(f"SELECT doc_id, CASE WHEN r < floor(n * 0.98) THEN 'train' WHEN r < floor(n * 0.99) THEN 'validation' ELSE 'eval' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY {_RANK}) - 1 AS r, count(*) OVER () AS n FROM documents)")
def split_rank(spark, d):
    return select.rank_split(docs(spark, d, "doc_id"), seeded()).select("doc_id", "split")


@query(f"SELECT doc_id, CASE WHEN r < 0.90 * n THEN 'train' WHEN r < 0.95 * n THEN 'validation' ELSE 'eval' END AS split FROM (SELECT doc_id, coalesce(sum(length(text)) OVER (ORDER BY {_RANK} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r, sum(length(text)) OVER () AS n FROM documents)")
def split_chars(spark, d):
    per = docs(spark, d, "doc_id", "text").select("doc_id", F.length("text").cast("long").alias("n"), seeded().alias("k"))
    run = select.running(per, [F.col("k")], F.col("n"), "r")
    total = per.agg(F.sum("n").alias("total"))
    return run.join(F.broadcast(total)).select("doc_id", F.when(F.col("r") < 0.90 * F.col("total"), "train").when(F.col("r") < 0.95 * F.col("total"), "validation").otherwise("eval").alias("split"))


@query(f"SELECT h, count(DISTINCT split) AS splits FROM (SELECT sha256({S.key('text')}) AS h, CASE WHEN {S.hash_bucket(_ID, 100)} < 90 THEN 'train' ELSE 'eval' END AS split FROM documents) GROUP BY h HAVING count(DISTINCT split) > 1")
def split_leak_check(spark, d):
    """Texts that a split by plain id would put on both sides."""
    b = T.hash_bucket(F.col("doc_id").cast("string"), 100)
    per = docs(spark, d, "doc_id", "text").select(T.content_hash(F.coalesce("text", F.lit(""))).alias("h"), F.when(b < 90, "train").otherwise("eval").alias("split"))
    return per.groupBy("h").agg((F.max((F.col("split") == "train").cast("int")) + F.max((F.col("split") == "eval").cast("int"))).cast("long").alias("splits")).where("splits > 1")


@query(f"SELECT doc_id, {_RANK} AS rank_key FROM documents ORDER BY rank_key, doc_id LIMIT 50")
def sample_hash_topn(spark, d):
    return docs(spark, d, "doc_id").select("doc_id", seeded().alias("rank_key")).orderBy("rank_key", "doc_id").limit(50)


@query(f"SELECT source, doc_id, rn FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {_RANK}, doc_id) AS rn FROM documents) WHERE rn <= 5")
def sample_per_group(spark, d):
    return select.per_group(docs(spark, d, "source", "doc_id").withColumn("k", seeded()), "source", [F.col("k"), F.col("doc_id")], 5).select("source", "doc_id", F.col("rn").cast("long").alias("rn"))


@query(f"SELECT doc_id FROM documents WHERE ('0x' || substr(sha256({S.key('text')}), 1, 2))::INTEGER % 16 = 0")
def sample_1_16(spark, d):
    h = T.content_hash(F.coalesce("text", F.lit("")))
    return docs(spark, d, "doc_id", "text").where(F.conv(F.substring(h, 1, 2), 16, 10).cast("int") % 16 == 0).select("doc_id")


@query(f"SELECT row_number() OVER (ORDER BY rn, source) AS pos, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {_RANK}, doc_id) AS rn FROM documents WHERE source IS NOT NULL) WHERE rn <= 4 ORDER BY pos LIMIT 60")
def round_robin(spark, d):
    ranked = select.per_group(docs(spark, d, "source", "doc_id").where("source is not null").withColumn("k", seeded()), "source", [F.col("k"), F.col("doc_id")], 4)
    top = ranked.orderBy("rn", "source").limit(60)
    return top.select(F.row_number().over(Window.orderBy("rn", "source")).cast("long").alias("pos"), "doc_id")  # at most 60 rows


@query("""WITH RECURSIVE o AS MATERIALIZED (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
g(source, i, doc_id, total, picked) AS (SELECT DISTINCT source, 0::BIGINT, 0::BIGINT, 0::BIGINT, false FROM o UNION ALL
SELECT o.source, o.i, o.doc_id, CASE WHEN ok THEN total + n_chars ELSE total END, ok FROM (SELECT o.*, g.total, g.total < 20000 AND g.total + o.n_chars <= 21000 AS ok FROM g JOIN o ON g.source IS NOT DISTINCT FROM o.source AND o.i = g.i + 1) o)
SELECT source, doc_id, total AS running FROM g WHERE picked""")
def budget_skip(spark, d):
    return select.budget(docs(spark, d, "source", "doc_id", "n_chars"), 20_000, 21_000, size="n_chars")


@query("""WITH have AS (SELECT source, sum(n_chars)::BIGINT AS available FROM documents GROUP BY source), want AS (SELECT mix_id, source, target_share, max_repeats, budget_ratio FROM mix_targets), total AS (SELECT sum(n_chars)::BIGINT AS n FROM documents)
SELECT mix_id, w.source, coalesce(available, 0) AS available, ceil(target_share * budget_ratio * n)::BIGINT AS minimum, greatest(ceil(target_share * budget_ratio * n)::BIGINT - coalesce(available, 0), 0) AS shortfall, coalesce(available, 0) >= ceil(target_share * budget_ratio * n) AS pass
FROM want w LEFT JOIN have USING (source) CROSS JOIN total""")
def quota_gate(spark, d):
    have = cut_lineage(docs(spark, d, "source", "n_chars").groupBy("source").agg(F.sum("n_chars").alias("available")))
    total = have.agg(F.sum("available").alias("n"))
    need = F.ceil(F.col("target_share") * F.col("budget_ratio") * F.col("n"))
    got = F.coalesce("available", F.lit(0))
    return table(spark, d, "mix_targets").join(have, "source", "left").join(F.broadcast(total)).select("mix_id", "source", got.alias("available"), need.alias("minimum"), F.greatest(need - got, F.lit(0)).alias("shortfall"), (got >= need).alias("pass"))


@query("""WITH b AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source), q AS (SELECT source, floor(n * 100.0 / sum(n) OVER ())::BIGINT AS base, n * 100 % sum(n) OVER () AS rest FROM b),
r AS (SELECT *, row_number() OVER (ORDER BY rest DESC, source) AS k, 100 - sum(base) OVER () AS missing FROM q) SELECT source, (base + CASE WHEN k <= missing THEN 1 ELSE 0 END)::BIGINT AS quota FROM r""")
def quota_scale(spark, d):
    """A hundred places by largest remainder; one row per source by then."""
    b = docs(spark, d, "source").where("source is not null").groupBy("source").agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    q = b.withColumn("t", F.sum("n").over(every)).select("source", F.floor(F.col("n") * 100 / F.col("t")).alias("base"), (F.col("n") * 100 % F.col("t")).alias("rest"))
    k = F.row_number().over(Window.orderBy(F.desc("rest"), "source"))
    return q.withColumn("k", k).withColumn("missing", 100 - F.sum("base").over(every)).select("source", (F.col("base") + F.when(F.col("k") <= F.col("missing"), 1).otherwise(0)).alias("quota"))


_PACKED = f"""o AS MATERIALIZED (SELECT split, doc_id, n_chars, row_number() OVER (PARTITION BY split ORDER BY doc_id) AS i FROM (SELECT doc_id, n_chars, CASE WHEN b < 98 THEN 'train' WHEN b < 99 THEN 'validation' ELSE 'eval' END AS split FROM (SELECT doc_id, n_chars, {S.hash_bucket(_ID, 100)} AS b FROM documents))),
g(split, i, doc_id, shard, s, e) AS (SELECT split, i, doc_id, 0, 0::BIGINT, n_chars FROM o WHERE i = 1 UNION ALL SELECT o.split, o.i, o.doc_id, CASE WHEN g.e > 0 AND g.e + o.n_chars > 50000 THEN g.shard + 1 ELSE g.shard END, CASE WHEN g.e > 0 AND g.e + o.n_chars > 50000 THEN 0 ELSE g.e END, CASE WHEN g.e > 0 AND g.e + o.n_chars > 50000 THEN 0 ELSE g.e END + o.n_chars
FROM g JOIN o ON g.split = o.split AND o.i = g.i + 1)"""


@query(f"WITH RECURSIVE {_PACKED} SELECT split, doc_id, shard, s AS start_offset, e AS end_offset FROM g")
def pack_next_fit(spark, d):
    """Shards of 50,000 characters; a longer document has a shard of its own."""
    b = T.hash_bucket(F.col("doc_id").cast("string"), 100)
    sized = docs(spark, d, "doc_id", "n_chars").select(F.when(b < 98, "train").when(b < 99, "validation").otherwise("eval").alias("split"), "doc_id", "n_chars")
    return select.pack(sized, 50_000, size="n_chars", oversize="own")


@query(f"""WITH RECURSIVE {_PACKED}, f AS (SELECT split, doc_id, shard, s AS start_offset, e AS end_offset, coalesce(lag(e) OVER (PARTITION BY split, shard ORDER BY s), 0)::BIGINT AS expected FROM g) SELECT * FROM f WHERE expected != start_offset""")
def boundary_check(spark, d):
    """Gaps in the packing: none."""
    return select.gaps(pack_next_fit(spark, d), ["split", "shard"])


@query(f"""WITH RECURSIVE {_PACKED}, f AS (SELECT *, s != coalesce(lag(e) OVER (PARTITION BY split, shard ORDER BY s, e), 0) AS broken FROM g WHERE doc_id NOT IN (SELECT document_id FROM rejected_documents WHERE document_id IS NOT NULL))
SELECT split, shard, count(*) AS docs, max(e) AS tokens, count(*) FILTER (broken) AS gaps FROM f GROUP BY ALL""")
def boundary_report(spark, d):
    """Documents, size and gaps of each shard of a packing that lost the documents which an older run refused."""
    packed = pack_next_fit(spark, d).join(table(spark, d, "rejected_documents", F.col("document_id").alias("doc_id")).distinct(), "doc_id", "left_anti")
    gaps = select.gaps(packed, ["split", "shard"]).groupBy("split", "shard").agg(F.count("*").alias("gaps"))
    return packed.groupBy("split", "shard").agg(F.count("*").alias("docs"), F.max("end_offset").alias("tokens")).join(gaps, ["split", "shard"], "left").fillna(0, ["gaps"])


_SPANS = "SELECT lang, source, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s, sum(n_chars) OVER (ORDER BY doc_id)::BIGINT AS e FROM documents"


def spans(spark, d):
    per = docs(spark, d, "doc_id", "source", "lang", "n_chars")
    return select.running(per, [F.col("doc_id")], F.col("n_chars"), "start_offset").withColumn("end_offset", F.col("start_offset") + F.col("n_chars"))


_OVER = f"SELECT w AS seq, source, sum(least(e, (w + 1) * 512) - greatest(s, w * 512))::BIGINT AS overlap FROM (SELECT *, unnest(range(s // 512, (e - 1) // 512 + 1)) AS w FROM ({_SPANS}) WHERE e > s) GROUP BY ALL"


@query(f"SELECT seq, source, overlap FROM ({_OVER})")
def window_overlap(spark, d):
    return select.window_overlap(spans(spark, d), 512, ["source"])


@query(f"SELECT seq, source FROM (SELECT seq, source, row_number() OVER (PARTITION BY seq ORDER BY overlap DESC, source) AS k FROM ({_OVER}) WHERE source IS NOT NULL) WHERE k = 1")
def window_labels(spark, d):
    return select.dominant(select.window_overlap(spans(spark, d), 512, ["source"]).where("source is not null"), "source")


_H2 = f"SELECT source, (CASE WHEN {S.hash_bucket(_ID, 2)} = 0 THEN 'a' ELSE 'b' END) AS half FROM documents WHERE source IS NOT NULL"


@query(f"""WITH c AS (SELECT source, count(*) FILTER (half = 'a') AS a, count(*) FILTER (half = 'b') AS b FROM ({_H2}) GROUP BY source), p AS (SELECT source, a::DOUBLE / sum(a) OVER () AS p, b::DOUBLE / sum(b) OVER () AS q FROM c)
SELECT round(sum(CASE WHEN p > 0 THEN 0.5 * p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * log2(2 * q / (p + q)) ELSE 0 END), 6) AS divergence FROM p""")
def distribution_jsd(spark, d):
    """Jensen-Shannon divergence, in bits, of the sources of two hashed halves."""
    b = T.hash_bucket(F.col("doc_id").cast("string"), 2)
    c = docs(spark, d, "doc_id", "source").where("source is not null").groupBy("source").agg(F.sum((b == 0).cast("long")).alias("a"), F.sum((b == 1).cast("long")).alias("b"))
    every = Window.partitionBy()  # one row per source
    p, q = F.col("a") / F.sum("a").over(every), F.col("b") / F.sum("b").over(every)
    part = lambda x, y: F.when(x > 0, 0.5 * x * F.log2(2 * x / (x + y))).otherwise(0.0)
    return c.select(p.alias("p"), q.alias("q")).agg(F.round(F.sum(part(F.col("p"), F.col("q")) + part(F.col("q"), F.col("p"))), 6).alias("divergence"))


@query("""WITH o AS (SELECT source, row_number() OVER (ORDER BY doc_id) AS i FROM documents), g AS (SELECT source, i - row_number() OVER (PARTITION BY source ORDER BY i) AS k FROM o) SELECT source, max(n) AS run FROM (SELECT source, count(*) AS n FROM g GROUP BY source, k) GROUP BY source""")
def longest_source_run(spark, d):
    pos = select.global_rank(docs(spark, d, "doc_id", "source"), [F.col("doc_id")], "pos")
    return select.longest_runs(pos, "pos", "source")


@query("""SELECT coalesce(a.ext_id, b.ext_id) AS ext_id, CASE WHEN a.ext_id IS NULL THEN 'only_second' WHEN b.ext_id IS NULL THEN 'only_first' WHEN a.l = b.l THEN 'same' ELSE 'changed' END AS status
FROM (SELECT ext_id, coalesce(min(detected_language), '') AS l FROM quality_results WHERE run_id = (SELECT min(run_id) FROM quality_results) GROUP BY ext_id) a
FULL JOIN (SELECT ext_id, coalesce(min(detected_language), '') AS l FROM quality_results WHERE run_id = (SELECT max(run_id) FROM quality_results) GROUP BY ext_id) b ON a.ext_id = b.ext_id""")
def run_compare(spark, d):
    """The first and the last run of the older detector, document by document."""
    q = table(spark, d, "quality_results", "ext_id", "run_id", "detected_language")
    ends = q.agg(F.min("run_id").alias("lo"), F.max("run_id").alias("hi"))
    own = q.join(F.broadcast(ends))
    one = lambda c: own.where(F.col("run_id") == F.col(c)).groupBy("ext_id").agg(F.coalesce(F.min("detected_language"), F.lit("")).alias("l"))
    a, b = one("lo").alias("a"), one("hi").alias("b")
    status = F.when(F.col("a.ext_id").isNull(), "only_second").when(F.col("b.ext_id").isNull(), "only_first").when(F.col("a.l") == F.col("b.l"), "same").otherwise("changed")
    return a.join(b, F.col("a.ext_id") == F.col("b.ext_id"), "full").select(F.coalesce("a.ext_id", "b.ext_id").alias("ext_id"), status.alias("status"))


@query("SELECT run_id, source_id, count(*) AS n, round(100.0 * avg(CASE WHEN reason IS NULL THEN 1 ELSE 0 END), 6) AS pass_percent FROM (SELECT DISTINCT * FROM quality_results) GROUP BY ROLLUP (run_id, source_id)")
def pass_rate_rollup(spark, d):
    q = table(spark, d, "quality_results").distinct()
    return q.rollup("run_id", "source_id").agg(F.count("*").alias("n"), F.round(100.0 * F.avg(F.when(F.col("reason").isNull(), 1).otherwise(0)), 6).alias("pass_percent"))


@query("""SELECT q.source_id, coalesce(d.category, 'missing') AS category, count(*) AS n, sum(round(language_confidence * 10000)::BIGINT)::BIGINT AS confidence FROM (SELECT DISTINCT ext_id, run_id, source_id, language_confidence FROM quality_results) q
LEFT JOIN (SELECT DISTINCT ext_id, category FROM documents WHERE ext_id IS NOT NULL) d ON q.ext_id = d.ext_id GROUP BY ALL""")
def label_join_quality(spark, d):
    """Detector results by source and category of the corpus; ``confidence`` is a sum in ten-thousandths, exact."""
    q = table(spark, d, "quality_results", "ext_id", "run_id", "source_id", "language_confidence").distinct()
    c = docs(spark, d, "ext_id", "category").where("ext_id is not null").distinct()
    return q.join(c, "ext_id", "left").groupBy("source_id", F.coalesce("category", F.lit("missing")).alias("category")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("language_confidence") * 10000).cast("long")).alias("confidence"))


@query(f"""SELECT source, count(*) AS docs, sum(length(text))::BIGINT AS chars, sum(len({S.lines('text')}))::BIGINT AS n_lines, count(*) FILTER (length(text) < 500) AS short, count(*) FILTER (length(text) > 2000) AS long, count(*) FILTER (nfc_normalize(text) != text) AS not_nfc, count(*) FILTER (title IS NULL) AS no_title FROM documents GROUP BY source""")
def corpus_profile(spark, d):
    n = F.length("text")
    count = lambda c: F.sum(c.cast("long"))
    return docs(spark, d, "source", "text", "title").groupBy("source").agg(
        F.count("*").alias("docs"), F.sum(n).alias("chars"), F.sum(F.size(T.lines(F.col("text")))).alias("n_lines"), count(n < 500).alias("short"), count(n > 2000).alias("long"),
        count(T.nfc(F.col("text")) != F.col("text")).alias("not_nfc"), count(F.col("title").isNull()).alias("no_title"),
    )


@query("""SELECT CASE grouping(source, lang) WHEN 0 THEN 'both' WHEN 1 THEN 'source' WHEN 2 THEN 'lang' ELSE 'total' END AS level, source, lang, count(*) AS docs, sum(n_chars)::BIGINT AS chars, round(100.0 * count(*) / (SELECT count(*) FROM documents), 6) AS percent FROM documents GROUP BY CUBE (source, lang)""")
def share_cube(spark, d):
    per = cut_lineage(docs(spark, d, "source", "lang", "n_chars").groupBy("source", "lang").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars")))
    total = per.agg(F.sum("docs").alias("total"))
    cubed = spark.sql("SELECT CASE grouping_id(source, lang) WHEN 0 THEN 'both' WHEN 1 THEN 'source' WHEN 2 THEN 'lang' ELSE 'total' END AS level, source, lang, sum(docs) AS docs, sum(chars) AS chars FROM {per} GROUP BY CUBE (source, lang)", per=per)
    return cubed.join(F.broadcast(total)).select("level", "source", "lang", "docs", "chars", F.round(100.0 * F.col("docs") / F.col("total"), 6).alias("percent"))


@query("""WITH s AS (SELECT source, avg(n_chars) AS size, count(*) AS docs FROM documents WHERE source IS NOT NULL GROUP BY source) SELECT source, round((size - min(size) OVER ()) / nullif(max(size) OVER () - min(size) OVER (), 0), 6) AS size_score, round(docs::DOUBLE / max(docs) OVER (), 6) AS docs_ratio FROM s""")
def source_scores(spark, d):
    s = docs(spark, d, "source", "n_chars").where("source is not null").groupBy("source").agg(F.avg("n_chars").alias("size"), F.count("*").alias("docs"))
    every = Window.partitionBy()  # one row per source
    low, high = F.min("size").over(every), F.max("size").over(every)
    return s.select("source", F.round((F.col("size") - low) / F.nullif(high - low, F.lit(0.0)), 6).alias("size_score"), F.round(F.col("docs") / F.max("docs").over(every), 6).alias("docs_ratio"))


@query("""SELECT source, count(*) AS docs FROM documents WHERE source IN (SELECT source FROM mix_targets) GROUP BY source""")
def sources_in_mixes(spark, d):
    return docs(spark, d, "source").join(table(spark, d, "mix_targets", "source"), "source", "left_semi").groupBy("source").agg(F.count("*").alias("docs"))


@query("""SELECT ext_id, 'documents' AS only_in FROM (SELECT DISTINCT ext_id FROM documents WHERE ext_id IS NOT NULL EXCEPT SELECT ext_id FROM extracted_documents) UNION ALL SELECT ext_id, 'extracted' FROM (SELECT ext_id FROM extracted_documents EXCEPT SELECT ext_id FROM documents WHERE ext_id IS NOT NULL)""")
def id_set_difference(spark, d):
    a = docs(spark, d, "ext_id").where("ext_id is not null").select(F.col("ext_id").cast("long").alias("ext_id"))
    b = table(spark, d, "extracted_documents", "ext_id")
    return a.subtract(b).withColumn("only_in", F.lit("documents")).union(b.subtract(a).withColumn("only_in", F.lit("extracted")))


@query(f"SELECT count(*) AS groups, sha256(string_agg(h, ',' ORDER BY h)) AS manifest FROM (SELECT sum(('0x' || substr(sha256(doc_id::VARCHAR || ':' || text), 1, 13))::HUGEINT)::VARCHAR AS h FROM documents GROUP BY {S.hash_bucket(_ID, 256)})")
def corpus_manifest(spark, d):
    """Content hash of the corpus in two levels: sums of hashes in 256 groups by id, then one hash of the sums."""
    h = F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("text")), 256)
    g = T.hash_bucket(F.col("doc_id").cast("string"), 256)
    groups = docs(spark, d, "doc_id", "text").groupBy(g.alias("g")).agg(F.sum(F.conv(F.substring(h, 1, 13), 16, 10).cast("decimal(20,0)")).cast("string").alias("h"))
    return groups.agg(F.count("*").alias("groups"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256).alias("manifest"))  # 256 sums


@query("SELECT event_type, round(regr_slope(value, epoch(ts)), 9) AS slope, count(*) AS n FROM events GROUP BY event_type")
def event_slopes(spark, d):
    return table(spark, d, "events", "event_type", "ts", "value").groupBy("event_type").agg(F.round(F.regr_slope("value", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6), 9).alias("slope"), F.count("*").alias("n"))


@query("""WITH p AS (SELECT pair_id, max_by(coalesce(category, 'none'), loaded_at) AS category FROM instruct_seed GROUP BY pair_id) SELECT category, pair_id FROM (SELECT category, pair_id, row_number() OVER (PARTITION BY category ORDER BY sha256(pair_id::VARCHAR)) AS k FROM p) WHERE k <= 20""")
def chat_mix_quota(spark, d):
    """Twenty pairs per category in seeded order."""
    p = table(spark, d, "instruct_seed", "pair_id", "category", "loaded_at").groupBy("pair_id").agg(F.max_by(F.coalesce("category", F.lit("none")), "loaded_at").alias("category"))
    return select.per_group(p.withColumn("k", F.sha2(F.col("pair_id").cast("string"), 256)), "category", [F.col("k")], 20).select("category", "pair_id")


@query("""SELECT kind, count(*) AS pieces, max(length(piece)) AS longest, count(*) FILTER (contains(piece, '�')) AS broken, count(*) FILTER (starts_with(piece, '▁')) AS word_starts FROM tokenizer_pieces GROUP BY kind""")
def vocabulary_audit(spark, d):
    count = lambda c: F.sum(c.cast("long"))
    return table(spark, d, "tokenizer_pieces", "kind", "piece").groupBy("kind").agg(F.count("*").alias("pieces"), F.max(F.length("piece")).cast("long").alias("longest"), count(F.contains("piece", F.lit("�"))).alias("broken"), count(F.startswith("piece", F.lit("▁"))).alias("word_starts"))
