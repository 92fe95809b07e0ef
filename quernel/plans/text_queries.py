"""Queries on single texts: keys, measures, languages, filters and their roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import language
from ..functions import text as T
from ..operators import filters
from ..session import cut_lineage, spread, table
from . import fragments as S
from .catalogue import query


def docs(spark, d, *columns):
    return table(spark, d, "documents", *columns)


@query(f"SELECT doc_id, sha256({S.key('text')}) AS h FROM documents")
def content_hash(spark, d):
    return T.composed(spread(docs(spark, d, "doc_id", "text")), "text").select("doc_id", F.sha2(T.composed_key(F.col("text")), 256).alias("h"))


@query(f"SELECT ext_id, sha256(nfc_normalize(text)) AS h FROM (SELECT DISTINCT ext_id, text FROM extracted_documents)")
def norm_nfc(spark, d):
    return T.composed(spread(table(spark, d, "extracted_documents", "ext_id", "text")), "text").select("ext_id", F.sha2("text", 256).alias("h")).distinct()


@query(f"""SELECT doc_id, n_lines, filled, filled - len(list_distinct(k)) AS repeated, CASE WHEN filled = 0 THEN 0.0 ELSE round(1 - len(list_distinct(k))::DOUBLE / filled, 6) END AS ratio
FROM (SELECT doc_id, len({S.lines('text')}) AS n_lines, {S.kept_lines('text')} AS k, len(k) AS filled FROM documents)""")
def line_stats(spark, d):
    k = T.stripped_lines(F.col("text"))
    n = F.size(k)
    return docs(spark, d, "doc_id", "text").select(
        "doc_id", F.size(T.lines(F.col("text"))).cast("long").alias("n_lines"), n.cast("long").alias("filled"), (n - F.size(F.array_distinct(k))).cast("long").alias("repeated"),
        F.when(n == 0, 0.0).otherwise(F.round(1 - F.size(F.array_distinct(k)) / n, 6)).alias("ratio"),
    )


_L, _N, _P = r"\p{L}", r"\p{N}", r"\p{P}"


@query(f"""SELECT doc_id, round({S.count('s', _P)}::DOUBLE / n, 6) AS punctuation, round({S.count('s', _L + _N)}::DOUBLE / n, 6) AS alnum, round({S.count('s', _L)}::DOUBLE / n, 6) AS alpha,
round(1 - {S.count('s', _L + _N + _P)}::DOUBLE / n, 6) AS symbol FROM (SELECT doc_id, regexp_replace(text, '{S.SP}', '', 'g') AS s, greatest(length(s), 1) AS n FROM documents)""")
def char_ratios(spark, d):
    s = F.regexp_replace("text", T.SPACE, "")
    n = F.greatest(F.length(s), F.lit(1))
    share = lambda k: T.count_class(s, k) / n
    return docs(spark, d, "doc_id", "text").select("doc_id", F.round(share(_P), 6).alias("punctuation"), F.round(share(_L + _N), 6).alias("alnum"), F.round(share(_L), 6).alias("alpha"), F.round(1 - share(_L + _N + _P), 6).alias("symbol"))


# Phrases of web furniture.
BOILERPLATE = "cookie|privacy policy|terms of use|skip to main content|all rights reserved"
_BORDER = r"[^\p{L}\p{N}_]"


@query(f"""SELECT doc_id, floor(10000 * greatest(0.0, least(1.0, 0.35 * least(1.0, length(text) / 1000.0) + 0.35 * alpha + 0.15 * (1 - symbol) + 0.15 * (1 - rep) - least(0.25, 0.03 * boiler))) + 0.5000001) / 10000 AS score
FROM (SELECT doc_id, text, {S.count('text', _L)}::DOUBLE / greatest(length(text), 1) AS alpha, 1 - {S.count('text', _L + _N + _P + chr(92) + 's')}::DOUBLE / greatest(length(text), 1) AS symbol,
list_filter({S.kept_lines(S.casefold('text'))}, lambda x: length(x) >= 20) AS k, CASE WHEN len(k) = 0 THEN 0.0 ELSE 1 - len(list_distinct(k))::DOUBLE / len(k) END AS rep, len({S.found("regexp_replace(lower(text), '(" + _BORDER + ")', '" + chr(92) + "1" + chr(92) + "1', 'g')", "(?:^|" + _BORDER + ")(?:" + BOILERPLATE.replace(" ", "  ") + ")(?:" + _BORDER + "|$)")}) AS boiler FROM documents)""")
def quality_score(spark, d):
    n = F.greatest(F.length("text"), F.lit(1))
    k = F.filter(T.stripped_lines(T.casefold(F.col("text"))), lambda x: F.length(x) >= 20)
    rep = F.when(F.size(k) == 0, 0.0).otherwise(1 - F.size(F.array_distinct(k)) / F.size(k))
    alpha, symbol = T.count_class(F.col("text"), _L) / n, 1 - T.count_class(F.col("text"), _L + _N + _P + r"\s") / n
    boiler = F.regexp_count(F.lower("text"), F.lit(rf"(?<![\p{{L}}\p{{N}}_])(?:{BOILERPLATE})(?![\p{{L}}\p{{N}}_])"))
    score = 0.35 * F.least(F.lit(1.0), F.length("text") / 1000.0) + 0.35 * alpha + 0.15 * (1 - symbol) + 0.15 * (1 - rep) - F.least(F.lit(0.25), 0.03 * boiler)
    return docs(spark, d, "doc_id", "text").select("doc_id", (F.floor(10000 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)) + 0.5000001) / 10000).alias("score"))


def _count_sql(p):
    return f"len({S.found('text', p.replace(chr(39), chr(39) * 2))})"


@query(f"""SELECT ext_id, {_count_sql(filters.EMAIL)} AS emails, {_count_sql(filters.V1_URL)} AS urls, {_count_sql(filters.V1_PHONE)} AS phones, {_count_sql(filters.V1_SECRET)} AS secrets
FROM (SELECT DISTINCT ext_id, text FROM extracted_documents)""")
def pattern_counts(spark, d):
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return table(spark, d, "extracted_documents", "ext_id", "text").select("ext_id", n(filters.EMAIL).alias("emails"), n(filters.V1_URL).alias("urls"), n(filters.V1_PHONE).alias("phones"), n(filters.V1_SECRET).alias("secrets")).distinct()


def _pii_sql(c):
    f = S.casefold(c)
    exempt = ", ".join(f"'{x}'" for x in filters.EXEMPT_DOMAINS)
    return f"""CASE WHEN len(list_filter({S.found(c, filters.EMAIL)}, lambda e: lower(regexp_extract(e, '[^@]*$')) NOT IN ({exempt}))) > 0 THEN 'email'
WHEN regexp_matches({c}, '{filters.IDENTITY_NUMBER}') AND {S.any_of(f, filters.IDENTITY_CUES)} THEN 'turkish_identity_number'
WHEN regexp_matches({c}, '{filters.PHONE}') AND {S.any_of(f, filters.PHONE_CUES)} THEN 'phone'
WHEN regexp_matches({c}, '{filters.IPV4}') AND {S.any_of(f, filters.IP_CUES)} THEN 'ipv4' END"""


@query(f"SELECT DISTINCT ext_id, {_pii_sql('text')} AS kind FROM extracted_documents")
def material_pii(spark, d):
    return table(spark, d, "extracted_documents", "ext_id", "text").select("ext_id", filters.material_pii(F.col("text")).alias("kind")).distinct()


@query(f"SELECT doc_id, {S.language_a('text')} AS label FROM documents")
def lang_ref_a(spark, d):
    return docs(spark, d, "doc_id", "text").select("doc_id", language.language_a(F.col("text")).alias("label"))


@query(f"SELECT doc_id, {S.language_b('text')[0]} AS label, round({S.language_b('text')[1]}, 6) AS confidence FROM documents")
def lang_ref_b(spark, d):
    b = language.language_b(F.col("text"))
    return spread(docs(spark, d, "doc_id", "text")).select("doc_id", b["label"].alias("label"), F.round(b["confidence"], 6).alias("confidence"))


@query(f"SELECT doc_id, {S.language_c('text')} AS label FROM documents")
def lang_ref_c(spark, d):
    return docs(spark, d, "doc_id", "text").select("doc_id", language.language_c(F.col("text")).alias("label"))


@query(f"SELECT doc_id, {S.language_d('text', 'coalesce(lang, ' + chr(39) + 'unknown' + chr(39) + ')')} AS label FROM documents")
def lang_ref_d(spark, d):
    return docs(spark, d, "doc_id", "text", "lang").select("doc_id", language.language_d(F.col("text"), F.coalesce("lang", F.lit("unknown"))).alias("label"))


SCRIPTS = {"latin": r"\p{Latin}", "cyrillic": r"\p{Cyrillic}", "greek": r"\p{Greek}", "arabic": r"\p{Arabic}", "hebrew": r"\p{Hebrew}", "han": r"\p{Han}"}


@query("SELECT ext_id, script, chars FROM (" + " UNION ALL ".join(f"SELECT ext_id, '{k}' AS script, {S.count('text', v)} AS chars FROM (SELECT DISTINCT ext_id, text FROM extracted_documents)" for k, v in SCRIPTS.items()) + ") WHERE chars > 0")
def script_profile(spark, d):
    java = {k: v.replace("\\p{", "\\p{Is") for k, v in SCRIPTS.items()}
    per = F.array(*[F.struct(F.lit(k).alias("script"), T.count_class(F.col("text"), v).cast("long").alias("chars")) for k, v in java.items()])
    return table(spark, d, "extracted_documents", "ext_id", "text").select("ext_id", F.explode(per).alias("s")).select("ext_id", "s.*").where("chars > 0").distinct()


@query(f"""SELECT DISTINCT ext_id, (i - 1)::BIGINT AS line_number, length(l[i]) AS n_chars FROM (SELECT ext_id, string_split(text, chr(10)) AS l, unnest(range(1, len(l) + 1)) AS i FROM extracted_documents) WHERE {S.any_of('l[i]', filters.MOJIBAKE_MARKERS)}""")
def mojibake_lines(spark, d):
    per = table(spark, d, "extracted_documents", "ext_id", "text").select("ext_id", F.posexplode(F.split("text", "\n")).alias("line_number", "line"))
    return per.where(filters.mojibake(F.col("line"))).select("ext_id", F.col("line_number").cast("long").alias("line_number"), F.length("line").cast("long").alias("n_chars")).distinct()


def _normalized_sql(c):
    unified = rf"regexp_replace(nfc_normalize({c}), '\r\n?', chr(10), 'g')"
    joined = f"array_to_string(list_transform({S.lines(unified)}, lambda x: regexp_replace(x, '{S.SP}+$', '')), chr(10))"
    return rf"regexp_replace({S.ends(joined)}, '\n{{3,}}', chr(10) || chr(10), 'g')"


def _quality_sql():
    b, conf = S.language_b("c")
    return rf"""CASE WHEN contains(r, '�') THEN 'replacement_character' WHEN regexp_matches(r, '{filters.CONTROL}') THEN 'control_character' WHEN {S.any_of('r', filters.MOJIBAKE_MARKERS)} THEN 'mojibake'
WHEN length(c) < 120 THEN 'too_short' WHEN length(c) > 100000 THEN 'too_long'
WHEN len(list_filter(list_distinct(string_split(c, '')), lambda x: NOT regexp_matches(x, '[\t\n\x0B\f\r ]') AND contains(c, repeat(x, 40)))) > 0 THEN 'repeated_character'
WHEN {S.count('s', _P)}::DOUBLE / n > 0.35 THEN 'excessive_punctuation' WHEN {S.count('s', _L + _N)}::DOUBLE / n < 0.25 THEN 'low_information'
WHEN len(k) >= 5 AND 1 - len(list_distinct(k))::DOUBLE / len(k) > 0.30 THEN 'repeated_lines' WHEN regexp_matches(c, '{filters.MARKUP}') THEN 'markup_leakage'
WHEN pii IS NOT NULL THEN 'material_pii_' || pii WHEN NOT regexp_matches(c, '\p{{L}}') OR ({b}) != coalesce(lang, '') OR ({conf}) < 0.55 THEN 'wrong_or_uncertain_language' END"""


_FILTERED = rf"""SELECT *, {_quality_sql()} AS reason FROM (SELECT *, regexp_replace(c, '{S.SP}', '', 'g') AS s, greatest(length(s), 1) AS n, {S.kept_lines('c')} AS k, {_pii_sql('c')} AS pii
FROM (SELECT *, coalesce(text, '') AS r, {_normalized_sql("coalesce(text, '')")} AS c FROM documents))"""


@query(f"SELECT doc_id, coalesce(reason, 'accepted') AS reason FROM ({_FILTERED})")
def reject_reason_v2(spark, d):
    return filters.with_quality_reason(spread(docs(spark, d, "doc_id", "text", "lang"))).select("doc_id", F.coalesce("reason", F.lit("accepted")).alias("reason"))


_PILOT = rf"""CASE WHEN regexp_matches(text, '(?i){filters.PILOT_PII}') THEN 'pii_or_url' WHEN contains(text, '�') THEN 'replacement_character' WHEN {S.any_of('text', filters.MOJIBAKE_MARKERS)} THEN 'mojibake'
WHEN regexp_matches(text, '{filters.CONTROL}') THEN 'unsafe_control_character' WHEN length({S.ends('nfc_normalize(text)')}) NOT BETWEEN 40 AND 20000 THEN 'document_length'
WHEN ({S.language_c('text')}) != coalesce(lang, '') THEN 'language_mismatch' ELSE 'accepted' END"""


@query(f"SELECT doc_id, {_PILOT} AS reason FROM documents")
def reject_reason_pilot(spark, d):
    return docs(spark, d, "doc_id", "text", "lang").select("doc_id", F.coalesce(filters.pilot_reason(F.col("text"), F.col("lang")), F.lit("accepted")).alias("reason"))


def _v1_class():
    return (r"[\p{L}\p{N}" + filters.V1_PUNCTUATION + S.SP[1:-1] + "]").replace("'", "''")


_V1 = rf"""CASE WHEN length(text) < 200 THEN 'too_short' WHEN {_count_sql(filters.V1_URL)} > 3 THEN 'too_many_urls'
WHEN regexp_matches(text, '{filters.V1_EMAIL}') OR regexp_matches(text, '{filters.V1_PHONE}') OR regexp_matches(text, '{filters.V1_SECRET}') THEN 'private_or_secret_pattern'
WHEN length(regexp_replace(text, '{_v1_class()}', '', 'g'))::DOUBLE / length(text) > 0.20 THEN 'too_many_non_text_chars'
WHEN ({S.language_d('text', "coalesce(lang, 'unknown')")}) NOT IN ('tr', 'en', 'code') THEN 'language' ELSE 'accepted' END"""


@query(f"SELECT doc_id, {_V1} AS reason FROM documents")
def reject_reason_v1(spark, d):
    return docs(spark, d, "doc_id", "text", "lang").select("doc_id", F.coalesce(filters.pretraining_reason(F.col("text"), F.col("lang")), F.lit("accepted")).alias("reason"))


@query(f"""SELECT CASE grouping(source, lang, reason) WHEN 0 THEN 'all keys' WHEN 3 THEN 'source' WHEN 5 THEN 'lang' WHEN 6 THEN 'reason' ELSE 'total' END AS level, source, lang, reason, count(*) AS docs, sum(length(r))::BIGINT AS chars
FROM (SELECT source, lang, r, coalesce(reason, 'accepted') AS reason FROM ({_FILTERED})) GROUP BY GROUPING SETS ((source, lang, reason), (source), (lang), (reason), ())""")
def reason_rollup(spark, d):
    per = filters.with_quality_reason(spread(docs(spark, d, "source", "lang", "text"))).select("source", "lang", F.coalesce("reason", F.lit("accepted")).alias("reason"), F.length(F.coalesce("text", F.lit(""))).alias("n"))
    return spark.sql("""SELECT CASE grouping_id(source, lang, reason) WHEN 0 THEN 'all keys' WHEN 3 THEN 'source' WHEN 5 THEN 'lang' WHEN 6 THEN 'reason' ELSE 'total' END AS level, source, lang, reason, count(*) AS docs, sum(n) AS chars
FROM {per} GROUP BY GROUPING SETS ((source, lang, reason), (source), (lang), (reason), ())""", per=per)


_NORMS = f"SELECT DISTINCT {S.key('text')} AS k FROM eval_items"


@query(f"""WITH f AS ({_FILTERED}), h AS (SELECT doc_id, source, length(r) AS n, reason, {S.key('r')} AS k FROM f), g AS (SELECT *, min(CASE WHEN reason IS NULL THEN doc_id END) OVER (PARTITION BY k) AS first FROM h),
e AS ({_NORMS}) SELECT source, CASE WHEN reason IS NOT NULL THEN reason WHEN g.k IN (SELECT k FROM e) THEN 'evaluation_contamination' WHEN doc_id != first THEN 'exact_duplicate' ELSE 'accepted' END AS reason, count(*) AS docs, sum(n)::BIGINT AS chars FROM g GROUP BY ALL""")
def flagship_clean_funnel(spark, d):
    """Filter, contamination by equal text, exact duplicates (first kept), counted by source and reason. Texts that
    contain an evaluation text are no case here; ``clean_funnel_contains`` has them."""
    return _funnel(spark, d, contained=False)


_LONG = f"SELECT k FROM (SELECT {S.key('text')} AS k FROM eval_items UNION SELECT {S.key('prompt')} FROM eval_items) WHERE length(k) >= 40"


@query(f"""WITH f AS ({_FILTERED}), h AS (SELECT doc_id, source, length(r) AS n, reason, {S.key('r')} AS k FROM f), g AS (SELECT *, min(CASE WHEN reason IS NULL THEN doc_id END) OVER (PARTITION BY k) AS first FROM h),
e AS ({_NORMS}), c AS (SELECT DISTINCT h.k FROM h JOIN ({_LONG}) l ON contains(h.k, l.k))
SELECT source, CASE WHEN reason IS NOT NULL THEN reason WHEN g.k IN (SELECT k FROM e) OR g.k IN (SELECT k FROM c) THEN 'evaluation_contamination' WHEN doc_id != first THEN 'exact_duplicate' ELSE 'accepted' END AS reason, count(*) AS docs, sum(n)::BIGINT AS chars FROM g GROUP BY ALL""")
def clean_funnel_contains(spark, d):
    """The same funnel with contamination by equal text or by an evaluation text or prompt of at least 40 characters
    that the document contains."""
    return _funnel(spark, d, contained=True)


def _funnel(spark, d, contained: bool):
    from ..operators.dedup import first_by_key
    from ..operators.similarity import contaminated

    source = docs(spark, d, "doc_id", "source", "text", "lang")
    judged = filters.with_quality_reason(spread(source), keep="normal")
    h = cut_lineage(judged.select("doc_id", "source", F.length(F.coalesce("text", F.lit(""))).alias("n"), "reason", F.when(F.col("reason").isNull(), F.sha2(T.composed_key(F.col("normal")), 256)).alias("k")))
    items = table(spark, d, "eval_items", "prompt", "text")
    passed = first_by_key(h.where("reason is null"), "k", ["doc_id"], "doc_id").join(items.select(T.content_hash(F.col("text")).alias("k")).distinct().withColumn("leaked", F.lit(True)), "k", "left")
    if contained:
        holding = contaminated(source, items).select(F.col("id").alias("doc_id"), F.lit(True).alias("holds"))
        passed = passed.join(holding, "doc_id", "left").withColumn("leaked", F.coalesce("leaked", "holds"))
    judged = passed.select("source", "n", F.when(F.col("leaked"), "evaluation_contamination").when(F.col("doc_id") != F.col("representative_id"), "exact_duplicate").otherwise("accepted").alias("reason"))
    return judged.union(h.where("reason is not null").select("source", "n", "reason")).groupBy("source", "reason").agg(F.count("*").alias("docs"), F.sum("n").alias("chars"))


_W = S.words("text")


@query(f"""SELECT doc_id, round(max(c)::DOUBLE / max(total), 6) AS repetition, max(c)::BIGINT AS top FROM (SELECT doc_id, w, count(*) AS c, sum(count(*)) OVER (PARTITION BY doc_id) AS total FROM (SELECT doc_id, unnest({_W}) AS w FROM documents) GROUP BY doc_id, w) GROUP BY doc_id""")
def repetition_ratio(spark, d):
    per = docs(spark, d, "doc_id", "text").select("doc_id", F.explode(T.words(F.col("text"))).alias("w")).groupBy("doc_id", "w").agg(F.count("*").alias("c"))
    return per.groupBy("doc_id").agg(F.round(F.max("c") / F.sum("c"), 6).alias("repetition"), F.max("c").alias("top"))


@query(f"""SELECT doc_id, len(w) AS n_words, len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS doubled, len(list_filter(range(1, len(w) - 2), lambda i: w[i : i + 1] = w[i + 2 : i + 3])) AS loops
FROM (SELECT doc_id, {_W} AS w FROM documents)""")
def repeated_loops(spark, d):
    w = T.words(F.col("text"))
    at = lambda i, n: F.slice(F.col("w"), i, n)
    per = docs(spark, d, "doc_id", "text").select("doc_id", w.alias("w"))
    count = lambda n: F.when(F.size("w") >= 2 * n, F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size("w") - 2 * n + 1, F.lit(1))), lambda i: at(i, n) == at(i + n, n)))).otherwise(0).cast("long")
    return per.select("doc_id", F.size("w").cast("long").alias("n_words"), count(1).alias("doubled"), count(2).alias("loops"))


@query("""SELECT lang, count(*) AS docs, min(n) AS shortest, round(quantile_cont(n, 0.5), 4) AS p50, round(quantile_cont(n, 0.9), 4) AS p90, round(quantile_cont(n, 0.95), 4) AS p95, round(quantile_cont(n, 0.99), 4) AS p99, max(n) AS longest
FROM (SELECT lang, length(text) AS n FROM documents) GROUP BY lang""")
def length_percentiles(spark, d):
    p = lambda q: F.round(F.percentile("n", q), 4)
    return docs(spark, d, "lang", "text").select("lang", F.length("text").cast("long").alias("n")).groupBy("lang").agg(F.count("*").alias("docs"), F.min("n").alias("shortest"), p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.max("n").alias("longest"))


_HOST = r"^([a-z][a-z0-9+.-]*)://([^/?#]*)([^?#]*)"


@query(rf"""SELECT DISTINCT ext_id, lower(regexp_extract(u, '{_HOST}', 1)) AS scheme, lower(regexp_extract(u, '{_HOST}', 2)) AS host, CASE WHEN source_url IS NULL THEN 'missing' WHEN regexp_extract(u, '{_HOST}', 1) NOT IN ('http', 'https') THEN 'scheme'
WHEN NOT regexp_matches(lower(regexp_extract(u, '{_HOST}', 2)), '(^|\.)(test|example|invalid)$') THEN 'host' ELSE 'allowed' END AS verdict FROM (SELECT ext_id, source_url, coalesce(source_url, '') AS u FROM extracted_documents)""")
def url_policy(spark, d):
    u = F.coalesce("source_url", F.lit(""))
    scheme, host = F.regexp_extract(u, _HOST, 1), F.lower(F.regexp_extract(u, _HOST, 2))
    verdict = F.when(F.col("source_url").isNull(), "missing").when(~scheme.isin("http", "https"), "scheme").when(~host.rlike(r"(^|\.)(test|example|invalid)$"), "host").otherwise("allowed")
    return table(spark, d, "extracted_documents", "ext_id", "source_url").select("ext_id", F.lower(scheme).alias("scheme"), host.alias("host"), verdict.alias("verdict")).distinct()


# Keyword rules of the categories, first match wins.
CATEGORIES = (("code", ("```", "def ", "python", "import ")), ("howto", ("nasıl", "how do", "how to", "kurarım")), ("definition", ("nedir", "what is", "what does", "ne demektir")), ("reason", ("neden", "why ")))


@query("SELECT pair_id, " + "CASE " + " ".join(f"WHEN {S.any_of('p', terms)} THEN '{name}'" for name, terms in CATEGORIES) + f" ELSE 'other' END AS bucket FROM (SELECT DISTINCT pair_id, {S.casefold('prompt')} AS p FROM instruct_seed)")
def keyword_category(spark, d):
    p = T.casefold(F.col("prompt"))
    bucket = F.coalesce(*[F.when(filters._any(p, terms), name) for name, terms in CATEGORIES], F.lit("other"))
    return table(spark, d, "instruct_seed", "pair_id", "prompt").select("pair_id", bucket.alias("bucket")).distinct()


@query(rf"""SELECT doc_id, len(b) AS blocks, coalesce(list_sum(list_transform(b, lambda x: length(x))), 0)::BIGINT AS code_chars FROM (SELECT pair_id AS doc_id, regexp_extract_all(coalesce(response, ''), '(?s)```python\s*\n(.*?)```', 1) AS b FROM (SELECT DISTINCT pair_id, response FROM instruct_seed))""")
def code_blocks(spark, d):
    b = F.regexp_extract_all(F.coalesce("response", F.lit("")), F.lit(r"(?s)```python\s*\n(.*?)```"), F.lit(1))
    return table(spark, d, "instruct_seed", "pair_id", "response").distinct().select(F.col("pair_id").alias("doc_id"), F.size(b).cast("long").alias("blocks"), F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("code_chars"))
