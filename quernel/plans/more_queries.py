"""Further queries on lines, keys, comparisons and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.language import B_EN
from ..operators import dedup, filters, select
from ..session import cut_lineage, table
from . import fragments as S
from .catalogue import query
from .select_queries import SEED, seeded, spans


def docs(spark, d, *columns):
    return table(spark, d, "documents", *columns)


BOILERPLATE_LINE = "(?i)cookie|privacy policy|gizlilik|login|sign in|subscribe|newsletter|advertisement|reklam|terms of service|kullanım şartları"
_CLEAN = rf"list_filter(list_transform(string_split(regexp_replace(replace(text, chr(65279), ''), '\r\n?', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), lambda x: x != '' AND NOT regexp_matches(x, '{BOILERPLATE_LINE}'))"


@query(f"""SELECT doc_id, sha256(coalesce(string_agg(line, chr(10) ORDER BY i), '')) AS h, count(line) AS n_lines FROM (SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id, {S.key('line')} ORDER BY i) AS k FROM
(SELECT doc_id, i, l[i] AS line FROM (SELECT doc_id, l, unnest(CASE WHEN len(l) = 0 THEN [0] ELSE range(1, len(l) + 1) END) AS i FROM (SELECT doc_id, {_CLEAN} AS l FROM documents)))) WHERE k = 1 GROUP BY doc_id""")
def clean_line_dedup(spark, d):
    """Squeezed lines without web furniture, each once per document by case-folded key, in order."""
    unified = F.regexp_replace(F.replace("text", F.lit("﻿"), F.lit("")), r"\r\n?", "\n")
    kept = F.filter(F.transform(F.split(unified, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " "))), lambda x: (x != "") & ~x.rlike(BOILERPLATE_LINE))
    keys = lambda a: F.transform(a, lambda x: T.squeeze(T.casefold(x)))

    def once(a):
        return T.let(keys(a), lambda k: F.filter(a, lambda x, i: F.array_position(k, F.get(k, i)) == i + 1))

    out = T.let(kept, once)
    return docs(spark, d, "doc_id", "text").select("doc_id", out.alias("o")).select("doc_id", F.sha2(F.array_join("o", "\n"), 256).alias("h"), F.size("o").cast("long").alias("n_lines"))


@query(f"""SELECT doc_id, max(c)::BIGINT AS times FROM (SELECT doc_id, g, count(*) AS c FROM (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(w[i : i + 2], ' '))) AS g FROM (SELECT doc_id, {S.words('text')} AS w FROM documents)) GROUP BY doc_id, g) GROUP BY doc_id HAVING max(c) >= 3""")
def repeated_trigrams(spark, d):
    """Texts with a run of three words at least three times."""
    w = T.words(F.col("text"))
    runs = docs(spark, d, "doc_id", "text").where(F.size(w) >= 3).select("doc_id", F.explode(T.shingles(w, 3)).alias("g"))
    return runs.groupBy("doc_id", "g").agg(F.count("*").alias("c")).groupBy("doc_id").agg(F.max("c").alias("times")).where("times >= 3")


@query(rf"""SELECT ext_id, count(*) AS phones FROM (SELECT ext_id, unnest({S.found('text', filters.V1_PHONE)}) AS p FROM (SELECT DISTINCT ext_id, text FROM extracted_documents)) WHERE length(regexp_replace(p, '[^0-9]', '', 'g')) BETWEEN 8 AND 15 AND len(list_distinct(string_split(regexp_replace(p, '[^0-9]', '', 'g'), ''))) >= 4 GROUP BY ext_id""")
def plausible_phones(spark, d):
    """Numbers of eight to fifteen digits, at least four of them different."""
    p = table(spark, d, "extracted_documents", "ext_id", "text").distinct().select("ext_id", F.explode(F.regexp_extract_all("text", F.lit(filters.V1_PHONE), F.lit(0))).alias("p"))
    digits = F.regexp_replace("p", "[^0-9]", "")
    return p.where(F.length(digits).between(8, 15) & (F.size(F.array_distinct(F.split(digits, ""))) >= 4)).groupBy("ext_id").agg(F.count("*").alias("phones"))


@query(rf"""SELECT doc_id, trim(regexp_replace(lower(replace(coalesce(title, ''), 'İ', 'i')), '[^a-z0-9]+', '-', 'g'), '-') AS slug, CASE WHEN length(o) <= 80 THEN o ELSE left(o, 77) || '...' END AS preview FROM (SELECT doc_id, title, {S.squeeze('text')} AS o FROM documents)""")
def slug_preview(spark, d):
    o = T.squeeze(F.col("text"))
    slug = F.btrim(F.regexp_replace(F.lower(F.replace(F.coalesce("title", F.lit("")), F.lit("İ"), F.lit("i"))), "[^a-z0-9]+", "-"), F.lit("-"))
    return docs(spark, d, "doc_id", "title", "text").select("doc_id", slug.alias("slug"), F.when(F.length(o) <= 80, o).otherwise(F.concat(F.left(o, F.lit(77)), F.lit("..."))).alias("preview"))


_PAIR = f"SELECT pair_id, max_by(struct_pack(p := prompt, r := coalesce(response, '')), loaded_at) AS s FROM instruct_seed GROUP BY pair_id"


_PARA = r"list_filter(list_transform(string_split_regex(text, '\n[ \t\n\x0B\f\r]*\n'), lambda x: regexp_replace(x, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')), lambda x: x != '')"


@query(f"""WITH h AS (SELECT DISTINCT {S.key('p')} AS k FROM (SELECT unnest({_PARA}) AS p FROM extracted_documents) WHERE length(p) >= 80)
SELECT doc_id, count(*) AS kept FROM (SELECT doc_id, {S.key('p')} AS k FROM (SELECT doc_id, unnest({_PARA}) AS p FROM documents) WHERE length(p) >= 80) WHERE k NOT IN (SELECT k FROM h) GROUP BY doc_id""")
def paragraphs_not_in_history(spark, d):
    """Long paragraphs that the extracted documents don't hold: an anti-join on their hashes."""
    long = lambda df, i: dedup.paragraphs(df, i).where(F.length("paragraph") >= 80).select(i, T.content_hash(F.col("paragraph")).alias("k"))
    history = long(table(spark, d, "extracted_documents", "ext_id", "text"), "ext_id").select("k").distinct()
    return long(docs(spark, d, "doc_id", "text"), "doc_id").join(history, "k", "left_anti").groupBy("doc_id").agg(F.count("*").alias("kept"))


@query("""SELECT coalesce(a.category, b.category) AS category, round(100 * (coalesce(a.p, 0) - coalesce(b.p, 0)), 6) AS points FROM (SELECT category, count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM documents GROUP BY category) a
FULL JOIN (SELECT category, count(DISTINCT ext_id)::DOUBLE / (SELECT sum(n) FROM (SELECT count(DISTINCT ext_id) AS n FROM extracted_documents WHERE category IS NOT NULL GROUP BY category)) AS p FROM extracted_documents WHERE category IS NOT NULL GROUP BY category) b ON a.category = b.category""")
def category_shift(spark, d):
    """Shares of the categories, corpus against extracted documents, in percentage points."""
    every = Window.partitionBy()  # one row per category
    a = docs(spark, d, "category").groupBy("category").agg(F.count("*").alias("n")).select("category", (F.col("n") / F.sum("n").over(every)).alias("pa"))
    b = table(spark, d, "extracted_documents", "category", "ext_id").where("category is not null").groupBy("category").agg(F.count_distinct("ext_id").alias("n")).select("category", (F.col("n") / F.sum("n").over(every)).alias("pb"))
    return a.join(b, "category", "full").select("category", F.round(100 * (F.coalesce("pa", F.lit(0.0)) - F.coalesce("pb", F.lit(0.0))), 6).alias("points"))


@query("SELECT lang, count(*) FILTER (category = 'general_prose') AS prose, count(*) FILTER (category = 'technical_documentation') AS technical, count(*) FILTER (category = 'web_crawl') AS web FROM documents GROUP BY lang")
def language_category_pivot(spark, d):
    p = docs(spark, d, "lang", "category").groupBy("lang").pivot("category", ["general_prose", "technical_documentation", "web_crawl"]).count()
    return p.select("lang", F.coalesce("general_prose", F.lit(0)).alias("prose"), F.coalesce("technical_documentation", F.lit(0)).alias("technical"), F.coalesce("web_crawl", F.lit(0)).alias("web"))


@query("SELECT lang, round(sum(token_count)::DOUBLE / sum(n_chars), 6) AS tokens_per_char, round(sum(token_count)::DOUBLE / sum(len(string_split(text, ' '))), 6) AS tokens_per_word, count(*) AS docs FROM documents WHERE token_count IS NOT NULL GROUP BY lang")
def token_efficiency(spark, d):
    return docs(spark, d, "lang", "token_count", "n_chars", "text").where("token_count is not null").groupBy("lang").agg(
        F.round(F.sum("token_count") / F.sum("n_chars"), 6).alias("tokens_per_char"), F.round(F.sum("token_count") / F.sum(F.size(F.split("text", " "))), 6).alias("tokens_per_word"), F.count("*").alias("docs")
    )


@query("SELECT source, round(100.0 * n / total, 6) AS percent FROM (SELECT source, count(*) AS n, sum(count(*)) OVER () AS total FROM documents GROUP BY source) WHERE 100.0 * n / total > 5")
def concentration(spark, d):
    """Sources with more than five percent of the documents."""
    n = docs(spark, d, "source").groupBy("source").agg(F.count("*").alias("n")).withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row per source
    return n.where("percent > 5").select("source", F.round("percent", 6).alias("percent"))


@query("SELECT doc_id, before FROM (SELECT doc_id, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM documents) WHERE before < 200000")
def running_cutoff(spark, d):
    """Documents in order until the sum passes a ceiling; the one that crosses it is kept."""
    return select.running(docs(spark, d, "doc_id", "n_chars"), [F.col("doc_id")], F.col("n_chars"), "before").where("before < 200000").select("doc_id", "before")


@query("""SELECT event_type, count(*) FILTER (n < prev) AS falls, count(*) AS hours FROM (SELECT event_type, n, lag(n) OVER (PARTITION BY event_type ORDER BY h) AS prev FROM (SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS h, count(*) AS n FROM events GROUP BY ALL)) GROUP BY event_type""")
def successive_falls(spark, d):
    h = table(spark, d, "events", "event_type", "ts").groupBy("event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h")).agg(F.count("*").alias("n"))
    before = F.lag("n").over(Window.partitionBy("event_type").orderBy("h"))  # hours of one type
    return h.withColumn("prev", before).groupBy("event_type").agg(F.sum(F.coalesce((F.col("n") < F.col("prev")).cast("long"), F.lit(0))).alias("falls"), F.count("*").alias("hours"))


_R = f"sha256('{SEED}:' || doc_id::VARCHAR)"


@query(f"""WITH r AS (SELECT doc_id, category, {_R} AS k, row_number() OVER (PARTITION BY category ORDER BY {_R}, doc_id) AS rn FROM documents), f AS (SELECT doc_id, k FROM r WHERE rn <= 3), m AS (SELECT doc_id, k FROM r WHERE rn > 3 ORDER BY k, doc_id LIMIT 15)
SELECT doc_id, 'stratum' AS part FROM f UNION ALL SELECT doc_id, 'fill' FROM m""")
def stratified_fill(spark, d):
    """Three of each category in seeded order, filled up with the next fifteen of all."""
    per = docs(spark, d, "doc_id", "category").withColumn("k", seeded())
    first = select.per_group(per, "category", [F.col("k"), F.col("doc_id")], 3).select("doc_id")
    fill = per.join(first, "doc_id", "left_anti").orderBy("k", "doc_id").limit(15).select("doc_id", F.lit("fill").alias("part"))
    return first.withColumn("part", F.lit("stratum")).union(fill)


@query(f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) WHERE i % 10 = 0 ORDER BY i LIMIT 40")
def stride_sample(spark, d):
    """Every tenth document in order, forty at most."""
    ranked = select.global_rank(docs(spark, d, "doc_id"), [F.col("doc_id")], "i")
    return ranked.where("i % 10 = 0").orderBy("i").limit(40).select("doc_id")


@query("SELECT source, min_by(doc_id, struct_pack(a := -n_chars, b := doc_id)) AS longest, max(n_chars) AS n_chars FROM documents GROUP BY source")
def longest_per_source(spark, d):
    return docs(spark, d, "source", "doc_id", "n_chars").groupBy("source").agg(F.min_by("doc_id", F.struct(-F.col("n_chars"), F.col("doc_id"))).alias("longest"), F.max("n_chars").alias("n_chars"))


@query("""(SELECT doc_id, 'long' AS band FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10) UNION ALL (SELECT doc_id, 'short' FROM documents ORDER BY n_chars, doc_id LIMIT 10)""")
def length_bands(spark, d):
    per = docs(spark, d, "doc_id", "n_chars")
    return per.orderBy(F.desc("n_chars"), "doc_id").limit(10).select("doc_id", F.lit("long").alias("band")).union(per.orderBy("n_chars", "doc_id").limit(10).select("doc_id", F.lit("short").alias("band")))


@query(f"""SELECT doc_id, round((rn - 0.5) / n, 9) AS place FROM (SELECT doc_id, row_number() OVER (PARTITION BY category ORDER BY {_R}, doc_id) AS rn, count(*) OVER (PARTITION BY category) AS n FROM documents)""")
def interleaved_order(spark, d):
    """Place of each document when every category is spread evenly over the whole order."""
    per = docs(spark, d, "doc_id", "category").withColumn("k", seeded())
    n = per.groupBy("category").agg(F.count("*").alias("n"))
    rn = select.group_rank(per, "category", [F.col("k"), F.col("doc_id")], "rn")
    return rn.join(F.broadcast(n), "category").select("doc_id", F.round((F.col("rn") + 0.5) / F.col("n"), 9).alias("place"))  # one row per category


@query("""WITH o AS (SELECT * FROM (VALUES ('general_prose', 1), ('educational', 2), ('technical_documentation', 3), ('code_and_structured', 4)) t(category, pos)) SELECT coalesce(pos, 9) AS pos, count(*) AS docs, min(doc_id) AS first FROM documents LEFT JOIN o USING (category) GROUP BY ALL""")
def curriculum_order(spark, d):
    order = spark.createDataFrame([("general_prose", 1), ("educational", 2), ("technical_documentation", 3), ("code_and_structured", 4)], "category string, pos int")
    return docs(spark, d, "doc_id", "category").join(F.broadcast(order), "category", "left").groupBy(F.coalesce("pos", F.lit(9)).alias("pos")).agg(F.count("*").alias("docs"), F.min("doc_id").alias("first"))


_CUT = "SELECT doc_id, n_chars, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s, sum(n_chars) OVER (ORDER BY doc_id)::BIGINT AS e FROM documents"


@query(f"SELECT seq, count(*) AS docs, min_by(doc_id, s) AS first_doc, max_by(doc_id, s) AS last_doc FROM (SELECT *, unnest(range(s // 512, (e - 1) // 512 + 1)) AS seq FROM ({_CUT}) WHERE n_chars > 0) GROUP BY seq HAVING sum(least(e, (seq + 1) * 512) - greatest(s, seq * 512)) = 512")
def fixed_sequences(spark, d):
    """Every full window of 512 characters of the corpus laid end to end: the documents in it, the first and the last."""
    s = spans(spark, d).where("n_chars > 0").withColumn("seq", F.explode(F.sequence(F.floor(F.col("start_offset") / 512), F.floor((F.col("end_offset") - 1) / 512))))
    part = F.least(F.col("end_offset"), (F.col("seq") + 1) * 512) - F.greatest(F.col("start_offset"), F.col("seq") * 512)
    w = s.groupBy("seq").agg(F.count("*").alias("docs"), F.min_by("doc_id", "start_offset").alias("first_doc"), F.max_by("doc_id", "start_offset").alias("last_doc"), F.sum(part).alias("n"))
    return w.where("n = 512").drop("n")


_SPAN = "SELECT doc_id, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s, sum(n_chars) OVER (ORDER BY doc_id)::BIGINT AS e FROM documents"


@query(f"SELECT p.pos, s.doc_id, p.pos - s.s AS inside FROM (SELECT unnest(range(0, (SELECT sum(n_chars)::BIGINT FROM documents), 10007)) AS pos) p JOIN ({_SPAN}) s ON p.pos >= s.s AND p.pos < s.e")
def offset_lookup(spark, d):
    """Which document a global offset falls into: offsets and spans meet in buckets, then the range is tested."""
    width = 4096
    s = cut_lineage(spans(spark, d))
    total = s.agg(F.max("end_offset").alias("t"))
    points = total.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("t") - 1, F.lit(10007).cast("long"))).alias("pos")).withColumn("b", F.floor(F.col("pos") / width))
    cut = s.where("end_offset > start_offset").withColumn("b", F.explode(F.sequence(F.floor(F.col("start_offset") / width), F.floor((F.col("end_offset") - 1) / width))))
    return points.join(cut, "b").where((F.col("pos") >= F.col("start_offset")) & (F.col("pos") < F.col("end_offset"))).select("pos", "doc_id", (F.col("pos") - F.col("start_offset")).alias("inside"))


@query("SELECT origin, count(*) AS n, sum(length(t))::BIGINT AS chars FROM (SELECT 'documents' AS origin, text AS t FROM documents UNION ALL SELECT 'extracted', text FROM extracted_documents UNION ALL SELECT 'items', text FROM eval_items) GROUP BY origin")
def union_inputs(spark, d):
    parts = [docs(spark, d, "text").withColumn("origin", F.lit("documents")), table(spark, d, "extracted_documents", "text").withColumn("origin", F.lit("extracted")), table(spark, d, "eval_items", "text").withColumn("origin", F.lit("items"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("origin").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


_BUILD = "SELECT source, sum(('0x' || substr(sha256(doc_id::VARCHAR || ':' || text), 1, 13))::HUGEINT) AS h FROM documents WHERE source IS NOT NULL"


@query(f"SELECT coalesce(a.source, b.source) AS source, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'missing' WHEN a.h = b.h THEN 'same' ELSE 'differs' END AS status FROM ({_BUILD} GROUP BY source) a FULL JOIN ({_BUILD} AND lang IS NOT NULL GROUP BY source) b ON a.source = b.source")
def build_compare(spark, d):
    """Two builds of the corpus compared by content hash per source (whole, and without unlabelled documents). The hash
    of a source is the sum of its documents' hashes, so it needs no order and combines before the shuffle."""

    def build(df):
        h = F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("text")), 256)
        return df.groupBy("source").agg(F.sum(F.conv(F.substring(h, 1, 13), 16, 10).cast("decimal(20,0)")).alias("h"))

    per = docs(spark, d, "source", "doc_id", "text", "lang").where("source is not null")
    a, b = build(per).alias("a"), build(per.where("lang is not null")).alias("b")
    status = F.when(F.col("a.h").isNull(), "added").when(F.col("b.h").isNull(), "missing").when(F.col("a.h") == F.col("b.h"), "same").otherwise("differs")
    return a.join(b, F.col("a.source") == F.col("b.source"), "full").select(F.coalesce("a.source", "b.source").alias("source"), status.alias("status"))


@query(f"SELECT doc_id, {S.hits(S.words('text'), B_EN)}::BIGINT AS hits, {S.any_of(S.casefold('text'), ('the ', 've '))} AS some FROM documents")
def term_counts(spark, d):
    w = T.words(F.col("text"))
    return docs(spark, d, "doc_id", "text").select("doc_id", F.size(F.filter(w, lambda x: x.isin(*B_EN))).cast("long").alias("hits"), filters._any(T.casefold(F.col("text")), ("the ", "ve ")).alias("some"))


@query("""SELECT item_id, 'In ' || ['one', 'two', 'three', 'four'][item_id % 4 + 1] || ' lines, ' || ['explain', 'sum up', 'translate'][item_id // 4 % 3 + 1] || ' for a ' || ['child', 'reader'][item_id // 12 % 2 + 1] || ': ' || prompt AS filled FROM eval_items""")
def mixed_radix_templates(spark, d):
    """Prompts in a template with three slots of four, three and two values, by division and remainder of the item's id."""
    i = F.col("item_id")
    slot = lambda n, values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(i / n) % len(values) + 1).cast("int"))
    filled = F.concat(F.lit("In "), slot(1, ("one", "two", "three", "four")), F.lit(" lines, "), slot(4, ("explain", "sum up", "translate")), F.lit(" for a "), slot(12, ("child", "reader")), F.lit(": "), "prompt")
    return table(spark, d, "eval_items", "item_id", "prompt").select("item_id", filled.alias("filled"))


@query()
def corpus_inventory(spark, d):
    """What becomes of every document of the corpus."""
    from .inventory import inventory

    return inventory(docs(spark, d, "doc_id", "text", "lang"), table(spark, d, "eval_items", "prompt", "text"))
