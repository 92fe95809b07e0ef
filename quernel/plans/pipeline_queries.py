"""Short pipelines and gates: normalisation with its log, the older text pipelines, manifests, shares of mixes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean as C
from ..functions import text as T
from ..operators import chat, dedup, filters, select, similarity
from ..session import cut_lineage, spread, table
from ..sources import readers
from . import fragments as S
from .catalogue import query
from .clean_queries import _CORPUS
from .instruct_queries import _LAST, last
from .select_queries import _ID, SEED
from .text_queries import _V1


def docs(spark, d, *columns):
    return table(spark, d, "documents", *columns)


CONTROLS = r"[\x01-\x08\x0B-\x1F\x7F-\x9F]"
_SQL_CONTROLS = r"[\x01-\x08\x0B-\x1F\x7F\x{80}-\x{9F}]"


@query(rf"""WITH t AS (SELECT DISTINCT ext_id, text FROM extracted_documents), u AS (SELECT ext_id, contains(text, chr(13)) AS endings, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS l FROM t), v AS (SELECT *, list_transform(l, lambda x: regexp_replace(replace(x, chr(0), ''), '{_SQL_CONTROLS}', '', 'g')) AS c FROM u)
SELECT ext_id, endings, len(list_filter(l, lambda x: contains(x, chr(0)))) AS nul_lines, len(list_filter(l, lambda x: regexp_matches(x, '{_SQL_CONTROLS}'))) AS control_lines, len(list_filter(c, lambda x: nfc_normalize(x) != x)) AS composed_lines, sha256(nfc_normalize(array_to_string(c, chr(10)))) AS h FROM v""")
def normalization_log(spark, d):
    """What normalising each text changes: line ends, lines with NUL or other control characters, lines not composed."""
    t = spread(table(spark, d, "extracted_documents", "ext_id", "text").distinct())
    u = t.select("ext_id", F.contains("text", F.lit("\r")).alias("endings"), F.regexp_replace("text", r"\r\n?", "\n").alias("u"))
    v = u.withColumn("c", F.regexp_replace("u", CONTROLS.replace(r"\x01", r"\x00"), "")).withColumn("n", F.col("c"))
    w = T.composed(v, "n")
    lines = lambda c, test: F.size(F.filter(F.split(c, "\n"), test)).cast("long")
    changed = F.size(F.filter(F.arrays_zip(F.split("c", "\n").alias("a"), F.split("n", "\n").alias("b")), lambda x: x["a"] != x["b"])).cast("long")
    return w.select("ext_id", "endings", lines("u", lambda x: F.contains(x, F.lit("\x00"))).alias("nul_lines"), lines("u", lambda x: x.rlike(CONTROLS)).alias("control_lines"), F.when(F.col("c") == F.col("n"), F.lit(0).cast("long")).otherwise(changed).alias("composed_lines"), F.sha2("n", 256).alias("h"))


_SHUFFLED = f"sha256('shuffle:' || {_ID})"


@query(f"SELECT doc_id, CASE WHEN r < floor(n * 0.9) THEN 'train' WHEN r < floor(n * 0.95) THEN 'validation' ELSE 'eval' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY {_SHUFFLED}) - 1 AS r, count(*) OVER () AS n FROM documents)")
def split_shuffled(spark, d):
    """Split 90, 5, 5 of the documents in a shuffled order, which is that of a seeded hash."""
    return select.rank_split(docs(spark, d, "doc_id"), F.sha2(F.concat(F.lit("shuffle:"), F.col("doc_id").cast("string")), 256), (90, 5)).select("doc_id", "split")


@query(f"""WITH p AS (SELECT pair_id, coalesce(l.s, 'none') AS source, coalesce(l.c, 'none') AS category, {S.squeeze(S.casefold("coalesce(l.a, '')"))} || chr(10) || {S.squeeze(S.casefold("coalesce(l.b, '')"))} AS k FROM ({_LAST})), n AS (SELECT count(*) AS n, count(*) - count(DISTINCT k) AS duplicates FROM p)
SELECT 'source' AS kind, source AS name, count(*) AS pairs, round(100.0 * count(*) / any_value(n.n), 6) AS percent, 100.0 * count(*) / any_value(n.n) <= 80 AS pass FROM p, n GROUP BY source UNION ALL SELECT 'category', category, count(*), round(100.0 * count(*) / any_value(n.n), 6), category != 'identity' OR 100.0 * count(*) / any_value(n.n) <= 12 FROM p, n GROUP BY category
UNION ALL SELECT 'gate', 'duplicates', duplicates, round(100.0 * duplicates / n, 6), duplicates = 0 FROM n""")
def mix_gates(spark, d):
    """Shares of sources (none above 80 percent), of categories (identity at most 12), and pairs that occur twice."""
    p = last(spark, d).select(F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("category", F.lit("none")).alias("category"), dedup.pair_key(F.col("prompt"), F.col("response")).alias("k"))
    p = cut_lineage(p.groupBy("source", "category", "k").agg(F.count("*").alias("c")))
    total = p.agg(F.sum("c").alias("n"))
    part = lambda kind: p.groupBy(F.lit(kind).alias("kind"), F.col(kind).alias("name")).agg(F.sum("c").alias("pairs"))
    percent = 100.0 * F.col("pairs") / F.col("n")
    shares = part("source").union(part("category")).join(F.broadcast(total)).select("kind", "name", "pairs", F.round(percent, 6).alias("percent"), F.when(F.col("kind") == "source", percent <= 80).otherwise((F.col("name") != "identity") | (percent <= 12)).alias("pass"))
    twice = total.join(p.select("k").distinct().agg(F.count("*").alias("d"))).select((F.col("n") - F.col("d")).alias("x"), "n")  # one row each
    return shares.union(twice.select(F.lit("gate"), F.lit("duplicates"), "x", F.round(100.0 * F.col("x") / F.col("n"), 6), F.col("x") == 0))


@query(f"SELECT pair_id, sha256({S.squeeze('l.a')} || CASE WHEN {S.squeeze('l.c')} != '' THEN chr(10) || {S.squeeze('l.c')} ELSE '' END) AS prompt FROM ({_LAST})")
def merged_prompts(spark, d):
    """Prompts of rows that have an instruction and an input (here the category): the input follows on a line of its own."""
    return last(spark, d).select("pair_id", F.sha2(chat.merged(F.col("prompt"), F.col("category")), 256).alias("prompt"))


@query(f"""WITH c AS (SELECT doc_id, {S.ends(_CORPUS)} AS t FROM documents), f AS (SELECT doc_id, t, row_number() OVER (PARTITION BY {S.squeeze(S.casefold('t'))} ORDER BY doc_id) AS k FROM c), u AS (SELECT doc_id, t, row_number() OVER (ORDER BY {_SHUFFLED}) - 1 AS r, count(*) OVER () AS n FROM f WHERE k = 1),
l AS (SELECT DISTINCT doc_id FROM u JOIN eval_items e ON length(e.text) >= 40 AND contains(u.t, e.text)) SELECT CASE WHEN r < floor(n * 0.9) THEN 'train' WHEN r < floor(n * 0.95) THEN 'validation' ELSE 'eval' END AS split, count(*) AS docs, sum(length(t))::BIGINT AS chars, count(*) FILTER (doc_id IN (SELECT doc_id FROM l)) AS leaked FROM u GROUP BY ALL""")
def text_pipeline(spark, d):
    """The oldest pipeline: cleaned texts, each once, split in shuffled order, with those that hold an evaluation text."""
    c = spread(docs(spark, d, "doc_id", "text")).select("doc_id", C.corpus_clean(F.col("text")).alias("t"))
    keyed = cut_lineage(c.withColumn("k", C.simple_key(F.col("t"))))
    once = keyed.join(keyed.groupBy("k").agg(F.min("doc_id").alias("doc_id")), ["k", "doc_id"], "left_semi")
    split = select.rank_split(once.select("doc_id", F.length("t").alias("n")), F.sha2(F.concat(F.lit("shuffle:"), F.col("doc_id").cast("string")), 256), (90, 5))
    items = table(spark, d, "eval_items", "text").where(F.length("text") >= 40).select(F.col("text").alias("snippet"))
    leaked = similarity.containing(once.select("doc_id", F.col("t").alias("text")), items).select(F.col("id").alias("doc_id")).distinct().withColumn("leaked", F.lit(1))
    return split.join(leaked, "doc_id", "left").groupBy("split").agg(F.count("*").alias("docs"), F.sum("n").cast("long").alias("chars"), F.count("leaked").alias("leaked"))


@query(f"""WITH t AS (SELECT doc_id, source, lang, substr(text, 1, 6000) AS text FROM documents), r AS (SELECT doc_id, source, text, {_V1} AS reason, {S.squeeze(S.casefold('text'))} AS k FROM t), f AS (SELECT *, min(CASE WHEN reason = 'accepted' THEN doc_id END) OVER (PARTITION BY k) AS first FROM r)
SELECT source, CASE WHEN reason = 'accepted' AND doc_id != first THEN 'duplicate_exact_text' ELSE reason END AS reason, count(*) AS docs, sum(length(text))::BIGINT AS chars FROM f GROUP BY ALL""")
def pretraining_pipeline(spark, d):
    """The first-generation filter over texts of at most 6,000 characters (longer ones are cut there), duplicates last."""
    t = spread(docs(spark, d, "doc_id", "source", "lang", "text")).withColumn("text", F.substring("text", 1, 6000))
    r = cut_lineage(t.select("doc_id", "source", F.length("text").alias("n"), filters.pretraining_reason(F.col("text"), F.col("lang")).alias("reason"), C.simple_key(F.col("text")).alias("k")))
    first = r.where("reason is null").groupBy("k").agg(F.min("doc_id").alias("first"))
    reason = F.coalesce("reason", F.when(F.col("doc_id") != F.col("first"), "duplicate_exact_text"), F.lit("accepted"))
    return r.join(first, "k", "left").groupBy("source", reason.alias("reason")).agg(F.count("*").alias("docs"), F.sum("n").alias("chars"))


@query("""WITH s AS (SELECT coalesce(source, 'none') AS source, count(*) AS docs, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ALL), j AS (SELECT '{"characters":' || sum(chars)::BIGINT || ',"documents":' || sum(docs)::BIGINT || ',"sources":{' || string_agg('"' || source || '":{"characters":' || chars || ',"documents":' || docs || '}', ',' ORDER BY source) || '}}' AS manifest FROM s) SELECT manifest, sha256(manifest) AS h FROM j""")
def canonical_manifest(spark, d):
    """A manifest of the corpus as JSON with sorted keys and without spaces or times, and its hash."""
    s = docs(spark, d, "source", "n_chars").groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.count("*").alias("documents"), F.sum("n_chars").alias("characters"))
    each = F.array_sort(F.collect_list(F.struct("source", F.to_json(F.struct("characters", "documents")).alias("j"))))  # one row per source
    one = s.agg(each.alias("e"), F.sum("characters").alias("c"), F.sum("documents").alias("n"))
    body = F.array_join(F.transform("e", lambda x: F.concat(F.lit('"'), x["source"], F.lit('":'), x["j"])), ",")
    m = one.select(F.concat(F.lit('{"characters":'), F.col("c").cast("string"), F.lit(',"documents":'), F.col("n").cast("string"), F.lit(',"sources":{'), body, F.lit("}}")).alias("manifest"))
    return m.select("manifest", F.sha2("manifest", 256).alias("h"))


@query("""WITH m AS (SELECT avg(n_chars) AS m FROM documents) (SELECT doc_id, 'best' AS band FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10) UNION ALL (SELECT doc_id, 'weak' FROM documents ORDER BY n_chars, doc_id LIMIT 10) UNION ALL (SELECT doc_id, 'average' FROM documents, m ORDER BY abs(n_chars - m), doc_id LIMIT 10)""")
def score_bands(spark, d):
    """The ten longest, the ten shortest and the ten documents nearest to the mean length."""
    per = docs(spark, d, "doc_id", "n_chars")
    near = per.join(F.broadcast(per.agg(F.avg("n_chars").alias("m")))).orderBy(F.abs(F.col("n_chars") - F.col("m")), "doc_id")
    band = lambda df, name: df.limit(10).select("doc_id", F.lit(name).alias("band"))
    return band(per.orderBy(F.desc("n_chars"), "doc_id"), "best").union(band(per.orderBy("n_chars", "doc_id"), "weak")).union(band(near, "average"))


@query("SELECT t.name, len(list_filter(['doc_id', 'text', 'source', 'lang'], lambda x: NOT list_contains(t.have, x))) AS missing FROM (SELECT 'documents' AS name, ['doc_id', 'ext_id', 'source', 'lang', 'category', 'title', 'text', 'n_chars', 'token_count', 'ingested_at'] AS have UNION ALL SELECT 'eval_items', ['item_id', 'prompt', 'text', 'lang', 'category', 'split', 'expected_keywords']) t")
def required_fields(spark, d):
    """How many of the fields that a corpus needs each table lacks."""
    wanted = F.array(*[F.lit(x) for x in ("doc_id", "text", "source", "lang")])
    rows = [(name, table(spark, d, name).columns) for name in ("documents", "eval_items")]
    return spark.createDataFrame(rows, "name string, have array<string>").select("name", F.size(F.array_except(wanted, "have")).cast("long").alias("missing"))


_PATHS = "SELECT DISTINCT source_id, CASE WHEN category = 'web_crawl' THEN 'node_modules/' ELSE 'doc/' END || native_id || CASE WHEN category = 'educational' THEN '.pdf' WHEN category = 'technical_documentation' THEN '.go' ELSE '.MD' END AS member FROM extracted_documents"


@query(f"""SELECT source_id, member, category, rn FROM (SELECT source_id, member, CASE WHEN ends_with(member, '.go') THEN 'code_structured_text' ELSE 'technical_documentation' END AS category, row_number() OVER (PARTITION BY source_id ORDER BY sha256('{SEED}:' || member), member) AS rn FROM ({_PATHS}) WHERE NOT ends_with(member, '.pdf') AND NOT starts_with(member, 'node_modules/')) WHERE rn <= 20""")
def archive_sample(spark, d):
    """Twenty members of each source, as paths of an archive, by seeded hash: text files outside generated folders."""
    c = F.col("category")
    folder = F.when(c == "web_crawl", "node_modules/").otherwise("doc/")
    suffix = F.when(c == "educational", ".pdf").when(c == "technical_documentation", ".go").otherwise(".MD")
    paths = table(spark, d, "extracted_documents", "source_id", "native_id", "category").select("source_id", F.concat(folder, "native_id", suffix).alias("member")).distinct()
    return readers.member_sample(paths, SEED, 20).select("source_id", "member", "category", F.col("rn").cast("long").alias("rn"))
