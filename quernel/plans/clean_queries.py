"""Queries on cleaners, answers, conversations, repetition and health of generated texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import clean as C
from ..functions import markup
from ..functions import sequences as Q
from ..functions import text as T
from ..operators import chat, health, instruct
from ..operators.health import BROKEN, SCRIPTS, SPECIAL
from ..session import spread, table
from . import fragments as S
from .catalogue import query
from .instruct_queries import _LAST, _tidy, last


def docs(spark, d, *columns):
    return table(spark, d, "documents", *columns)


@query(f"SELECT doc_id, sha256({S.squeeze(S.casefold('text'))}) AS h FROM documents")
def simple_key(spark, d):
    return spread(docs(spark, d, "doc_id", "text")).select("doc_id", C.simple_key(F.col("text")).alias("h"))


_CORPUS = r"regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g')"


@query(f"SELECT doc_id, sha256({S.ends(_CORPUS)}) AS h FROM documents")
def corpus_clean(spark, d):
    return spread(docs(spark, d, "doc_id", "text")).select("doc_id", F.sha2(C.corpus_clean(F.col("text")), 256).alias("h"))


def _wiki_sql(c: str) -> str:
    for pattern, by in C.WIKI_PILOT:
        c = f"regexp_replace({c}, '{pattern.replace(chr(39), chr(39) * 2)}', '{by.replace('$', chr(92))}', 'g')"
    return f"array_to_string({S.kept_lines(c)}, chr(10))"


# every text in wiki markup: its title as a link and a heading, a reference, a template and a table around it
_MARKED = "chr(39) || chr(39) || coalesce(title, 'x') || chr(39) || chr(39) || '<ref name=a>' || source_id || '</ref> {{note|{a}|b}} [[Page|' || coalesce(category, 'none') || ']] [[' || source_id || ']] [https://x.test/a label] {| row' || chr(10) || '|}' || chr(10) || text"


@query(f"SELECT ext_id, sha256({_wiki_sql('m')}) AS h FROM (SELECT DISTINCT ext_id, {_MARKED} AS m FROM extracted_documents)")
def wiki_pilot(spark, d):
    """A pilot cleaner over every text wrapped in wiki markup."""
    m = F.concat(F.lit("''"), F.coalesce("title", F.lit("x")), F.lit("''<ref name=a>"), "source_id", F.lit("</ref> {{note|{a}|b}} [[Page|"), F.coalesce("category", F.lit("none")), F.lit("]] [["), "source_id", F.lit("]] [https://x.test/a label] {| row\n|}\n"), "text")
    return spread(table(spark, d, "extracted_documents", "ext_id", "title", "source_id", "category", "text")).select("ext_id", F.sha2(C.wiki_pilot(m), 256).alias("h")).distinct()


@query(f"""SELECT ext_id, sha256(array_to_string(list_filter(list_transform(string_split(coalesce(title, 'x') || chr(10) || text, chr(10)), lambda x: {S.ends("regexp_replace(x, '[ " + chr(92) + "t" + chr(92) + "r" + chr(92) + "f" + chr(92) + "x0B]+', ' ', 'g')")}), lambda x: x != ''), chr(10))) AS h FROM (SELECT DISTINCT ext_id, title, text FROM extracted_documents)""")
def html_text(spark, d):
    """Readable text of every document set in a page with a menu, scripts and a footer."""
    escaped = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page = F.concat(F.lit("<!DOCTYPE html><html><head><style>p > a { }</style></head><body><nav>menu <form>find</form></nav><h1 title='a > b'>"), escaped(F.coalesce("title", F.lit("x"))), F.lit("</h1><script>if (a < b) { }</script><p>"), escaped(F.col("text")), F.lit("</p><!-- note --><footer>end</footer></body></html>"))
    pages = spread(table(spark, d, "extracted_documents", "ext_id", "title", "text").distinct())
    return pages.select("ext_id", F.sha2(markup.html_text(page), 256).alias("h"))


@query(rf"SELECT doc_id, i - 1 AS n, sha256(c[i]) AS h FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '\.{S.SP}{{2,}}', '.' || chr(10) || chr(10), 'g'), '\n[\t\n\x0B\f\r ]*\n'), lambda x: {S.squeeze('x')}), lambda x: length(x) >= 40) AS c FROM documents))")
def paragraph_chunks(spark, d):
    return spread(docs(spark, d, "doc_id", "text")).select("doc_id", F.posexplode(C.chunks(F.col("text"))).alias("n", "c")).select("doc_id", F.col("n").cast("long").alias("n"), F.sha2("c", 256).alias("h"))


@query(f"SELECT pair_id, sha256({S.squeeze(_tidy('l.a'))}) AS prompt, sha256({S.squeeze(_tidy('l.b'))}) AS response FROM ({_LAST})")
def instruct_clean(spark, d):
    return last(spark, d).select("pair_id", F.sha2(instruct.tidy(F.col("prompt")), 256).alias("prompt"), F.sha2(instruct.tidy(F.col("response")), 256).alias("response"))


_FRAME = "'Kullanıcı: ' || coalesce(l.a, '') || chr(10) || 'Asistan:'"


@query(f"""SELECT pair_id, CASE WHEN starts_with(x, 'Asistan:') THEN {S.ends("substr(x, 9)")} ELSE x END AS answer FROM (SELECT pair_id, {S.ends("CASE WHEN contains(a, m1) THEN split_part(a, m1, 1) WHEN contains(a, m2) THEN split_part(a, m2, 1) ELSE a END")} AS x FROM
(SELECT pair_id, CASE WHEN starts_with(o, p) THEN substr(o, length(p) + 1) ELSE o END AS a, chr(10) || chr(10) || 'Kullanıcı:' AS m1, chr(10) || 'Kullanıcı:' AS m2 FROM (SELECT pair_id, {_FRAME} AS p, {S.ends(f"split_part({_FRAME} || ' ' || coalesce(l.b, '') || chr(10) || 'Kullanıcı: more</s> rest', '</s>', 1)")} AS o FROM ({_LAST}))))""")
def answer_extraction(spark, d):
    """Answers cut out of outputs that repeat the prompt and run on into the next turn."""
    frame = F.concat(F.lit("Kullanıcı: "), F.coalesce("prompt", F.lit("")), F.lit("\nAsistan:"))
    output = F.concat(frame, F.lit(" "), F.coalesce("response", F.lit("")), F.lit("\nKullanıcı: more</s> rest"))
    return last(spark, d).select("pair_id", C.answer_of(output, frame).alias("answer"))


_TALK = "'# bucket: ' || coalesce(l.c, 'none') || chr(10) || 'Kullanıcı: ' || coalesce(l.a, '') || chr(10) || 'Asistan: ' || coalesce(l.b, '') || chr(10) || 'Kullanıcı: ' || coalesce(l.a, '')"


@query(f"""WITH x AS (SELECT pair_id, string_split(regexp_replace({_TALK}, '\\r\\n?', chr(10), 'g'), chr(10)) AS l FROM ({_LAST})), y AS (SELECT pair_id, i, l[i] AS line, {S.ends('l[i]')} AS b FROM (SELECT pair_id, l, unnest(range(1, len(l) + 1)) AS i FROM x)),
z AS (SELECT *, coalesce(sum(starts_with(b, '```')::INTEGER) OVER (PARTITION BY pair_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM y), g AS (SELECT *, sum((NOT inside AND (starts_with(b, '# bucket:') OR starts_with(b, 'Kullanıcı:')))::INTEGER) OVER (PARTITION BY pair_id ORDER BY i) AS g FROM z),
e AS (SELECT pair_id, g, {S.ends('string_agg(line, chr(10) ORDER BY i)')} AS example FROM g GROUP BY pair_id, g) SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY g) - 1 AS n, sha256(example) AS h FROM e WHERE example != ''""")
def dialogue_examples(spark, d):
    """Examples of transcripts made of each pair: a bucket line, two turns and another question."""
    talk = F.concat(F.lit("# bucket: "), F.coalesce("category", F.lit("none")), F.lit("\nKullanıcı: "), F.coalesce("prompt", F.lit("")), F.lit("\nAsistan: "), F.coalesce("response", F.lit("")), F.lit("\nKullanıcı: "), F.coalesce("prompt", F.lit("")))
    return C.dialogues(last(spark, d).withColumn("talk", talk), "pair_id", "talk").select(F.col("id").alias("pair_id"), F.col("n").cast("long").alias("n"), F.sha2("example", 256).alias("h"))


# conversations of ten pairs each; blank turns are none
_CONV = f"SELECT conv, turn, who, content FROM (SELECT pair_id // 10 AS conv, 2 * pair_id AS turn, 'user' AS who, {S.squeeze('l.a')} AS content FROM ({_LAST}) UNION ALL SELECT pair_id // 10, 2 * pair_id + 1, 'assistant', {S.squeeze('l.b')} FROM ({_LAST})) WHERE content != ''"
_PAIRED = f"SELECT conv, turn, prompt, response FROM (SELECT conv, turn, who, content AS response, lag(who) OVER w AS pw, lag(content) OVER w AS prompt FROM ({_CONV}) WINDOW w AS (PARTITION BY conv ORDER BY turn)) WHERE who = 'assistant' AND pw = 'user'"


def _conversations(spark, d):
    p = last(spark, d)
    turn = lambda at, role, c: p.select(F.floor(F.col("pair_id") / 10).alias("conv_id"), (2 * F.col("pair_id") + at).alias("turn"), F.lit(role).alias("role"), F.col(c).alias("text"))
    return turn(0, "Human", "prompt").union(turn(1, "gpt", "response"))


@query(f"SELECT conv, turn, sha256(prompt) AS prompt, sha256(response) AS response FROM ({_PAIRED})")
def chat_all_pairs(spark, d):
    return chat.all_pairs(_conversations(spark, d)).select("conv", "turn", F.sha2("prompt", 256).alias("prompt"), F.sha2("response", 256).alias("response"))


@query(f"SELECT conv, min(turn) AS turn, sha256(min_by(prompt, turn)) AS prompt FROM ({_PAIRED}) GROUP BY conv")
def chat_first_pair(spark, d):
    return chat.first_pairs(_conversations(spark, d)).select("conv", "turn", F.sha2("prompt", 256).alias("prompt"))


_M = lambda c: f"replace(lower(nfc_normalize({c})), chr(775), '')"


@query(f"""SELECT item_id, list_filter(kw, lambda k: contains(a, {_M('k')})) AS matched, list_filter(kw, lambda k: NOT contains(a, {_M('k')})) AS missing, contains(a, {_M('prompt')}) AS phrase, len(list_filter(kw, lambda k: NOT contains(a, {_M('k')}))) = 0 OR contains(a, {_M('prompt')}) OR (len(kw) > 1 AND contains(a, {_M('kw[1]')})) AS passed
FROM (SELECT item_id, prompt, {_M('text')} AS a, coalesce(expected_keywords, []) AS kw FROM eval_items)""")
def eval_score(spark, d):
    """Texts of the items scored as answers: by keywords, by the prompt as an accepted phrase, by a group that the first
    keyword makes where there are several."""
    kw = F.coalesce("expected_keywords", F.array().cast("array<string>"))
    rows = table(spark, d, "eval_items", "item_id", "prompt", "text", "expected_keywords").select("item_id", F.col("text").alias("answer"), "expected_keywords", F.array("prompt").alias("accepted_phrases"), F.when(F.size(kw) > 1, F.array(F.array(kw[0]))).alias("keyword_groups"))
    return chat.scored(rows).select("item_id", F.col("matched_keywords").alias("matched"), F.col("missing_keywords").alias("missing"), (F.size("matched_phrases") > 0).alias("phrase"), "passed")


_W = S.words("text")
_AT = lambda n: f"len(w) >= {2 * n} AND len(list_filter(range(1, len(w) - {2 * n} + 2), lambda i: w[i : i + {n - 1}] = w[i + {n} : i + {2 * n - 1}])) > 0"


@query(f"""WITH x AS (SELECT doc_id, {_W} AS w FROM documents), y AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM x), r AS (SELECT doc_id, max(n) AS longest FROM (SELECT doc_id, g, v, count(*) AS n FROM (SELECT doc_id, w[i] AS v, i - row_number() OVER (PARTITION BY doc_id, w[i] ORDER BY i) AS g FROM y) GROUP BY ALL) GROUP BY doc_id)
SELECT doc_id, coalesce(r.longest, 0)::INTEGER AS longest_run, {_AT(2)} OR {_AT(3)} OR {_AT(4)} AS loops, CASE WHEN len(w) = 0 THEN 0.0 ELSE round(len(list_distinct(w))::DOUBLE / len(w), 6) END AS distinct_share FROM x LEFT JOIN r USING (doc_id)""")
def repetition_health(spark, d):
    """Longest run of a word, runs of two to four words that repeat at once, share of different words."""
    w = spread(docs(spark, d, "doc_id", "text")).select("doc_id", T.words(F.col("text")).alias("w"))
    codes = F.transform("w", lambda x: F.hash(x))
    n = F.size("w")
    return w.select("doc_id", Q.longest_run(codes).alias("longest_run"), Q.repeated_ngram(F.col("w")).alias("loops"), F.when(n == 0, 0.0).otherwise(F.round(F.size(F.array_distinct("w")) / n, 6)).alias("distinct_share"))


@query(f"""SELECT pair_id, CASE WHEN len(list_distinct(o)) = 0 THEN 0.0 ELSE round(len(list_intersect(list_distinct(p), list_distinct(o)))::DOUBLE / len(list_distinct(o)), 6) END AS overlap FROM (SELECT pair_id, {S.words("coalesce(l.a, '')")} AS p, {S.words("coalesce(l.b, '')")} AS o FROM ({_LAST}))""")
def prompt_overlap_ratio(spark, d):
    """Share of an answer's different words that its prompt holds."""
    p, o = T.words(F.coalesce("prompt", F.lit(""))), T.words(F.coalesce("response", F.lit("")))
    w = last(spark, d).select("pair_id", F.array_distinct(p).alias("p"), F.array_distinct(o).alias("o"))
    return w.select("pair_id", F.when(F.size("o") == 0, 0.0).otherwise(F.round(F.size(F.array_intersect("p", "o")) / F.size("o"), 6)).alias("overlap"))


@query("""WITH x AS (SELECT lang, length(text) AS n, row_number() OVER (PARTITION BY lang ORDER BY length(text), doc_id) AS i, count(*) OVER (PARTITION BY lang) AS k FROM documents)
SELECT lang, round(quantile_cont(n, 0.9), 4) AS linear, max(CASE WHEN i = 1 + round_even((k - 1) * 0.9, 0)::BIGINT THEN n END) AS rounded, quantile_disc(n, 0.9) AS nearest FROM x GROUP BY lang""")
def percentile_kinds(spark, d):
    """The 90th percentile of lengths by linear interpolation, at the rounded rank, and at the nearest rank above."""
    p = docs(spark, d, "lang", "text").select("lang", F.length("text").cast("long").alias("n"))
    # the place of a length among those of its language follows from how many are shorter and how many are equal
    per = p.groupBy("lang", "n").agg(F.count("*").alias("c"))
    upto = per.withColumn("hi", F.sum("c").over(Window.partitionBy("lang").orderBy("n"))).withColumn("k", F.sum("c").over(Window.partitionBy("lang")))  # one row per length
    place = 1 + F.bround((F.col("k") - 1) * 0.9, 0).cast("long")
    rounded = upto.where((F.col("hi") >= place) & (F.col("hi") - F.col("c") < place)).select(F.col("lang").alias("l"), F.col("n").alias("rounded"))
    near = upto.where((F.col("hi") >= F.ceil(F.col("k") * 0.9)) & (F.col("hi") - F.col("c") < F.ceil(F.col("k") * 0.9))).select(F.col("lang").alias("m"), F.col("n").alias("nearest"))
    linear = p.groupBy("lang").agg(F.round(F.percentile("n", 0.9), 4).alias("linear"))
    return linear.join(rounded, F.col("lang").eqNullSafe(F.col("l"))).join(near, F.col("lang").eqNullSafe(F.col("m"))).select("lang", "linear", "rounded", "nearest")


_RW = S.words("r")
_FOREIGN = "[" + ", ".join(f"regexp_matches(r, '{p}')" for p in SCRIPTS.values()) + "]"


@query(f"""WITH x AS (SELECT pair_id, coalesce(l.b, '') AS r FROM ({_LAST})), y AS (SELECT pair_id, r, {_RW} AS w, len(list_filter({_FOREIGN}, lambda b: b)) AS f FROM x), t AS (SELECT pair_id, max(c)::DOUBLE / sum(c) AS ratio FROM (SELECT pair_id, w, count(*) AS c FROM (SELECT pair_id, unnest(w) AS w FROM y) GROUP BY ALL) GROUP BY pair_id),
z AS (SELECT y.pair_id, list_filter([CASE WHEN {S.ends('r')} = '' THEN 'empty_output' END, CASE WHEN contains(r, '�') THEN 'decoder_defect' END, CASE WHEN regexp_matches(r, '{BROKEN}') THEN 'confirmed_text_mojibake' END, CASE WHEN f > 0 THEN 'unexpected_script' END, CASE WHEN f > 1 OR f > 0 AND regexp_matches(r, '\\p{{Latin}}') THEN 'mixed_script' END,
CASE WHEN coalesce(ratio, 1.0) > 0.35 THEN 'repetition' END, CASE WHEN regexp_matches(r, '{SPECIAL}') THEN 'special_token_leakage' END], lambda v: v IS NOT NULL) AS findings FROM y LEFT JOIN t USING (pair_id))
SELECT pair_id, findings, len(list_intersect(findings, ['decoder_defect', 'confirmed_text_mojibake'])) AS hard_early, len(list_intersect(findings, ['decoder_defect', 'confirmed_text_mojibake', 'unexpected_script', 'mixed_script', 'repetition', 'empty_output', 'special_token_leakage'])) AS hard_release FROM z""")
def generation_health(spark, d):
    """Findings on answers as generated texts, and how many are failures at an early stage and for a release."""
    return health.findings(last(spark, d).select("pair_id", F.coalesce("response", F.lit("")).alias("r")), "pair_id", "r")


@query(f"""WITH x AS (SELECT coalesce(l.b, '') AS r FROM ({_LAST})), y AS (SELECT r, {_RW} AS w FROM x) SELECT count(*) AS generations, count(*) FILTER ({S.ends('r')} = '') AS empty, sum({S.count('r', '�')})::BIGINT AS replacements, count(*) FILTER (regexp_matches(r, '{BROKEN}')) AS mojibake, count(*) FILTER (regexp_matches(r, '{SPECIAL}')) AS leaked,
round(avg(len(w)), 6) AS mean_words, round(quantile_cont(len(w), 0.5), 4) AS p50_words, round(quantile_cont(len(w), 0.95), 4) AS p95_words, count(*) FILTER (regexp_matches(r, '[.!?]\\s*$')) AS closed FROM y""")
def generation_summary(spark, d):
    """One row of measures over all answers."""
    return health.summary(last(spark, d).select(F.coalesce("response", F.lit("")).alias("r")), "r")


_TR, _EN_SIGN, _TR_SIGN = "regexp_matches(lower(p), '[çğıöşü]')", r"(?:^|[^\p{L}\p{N}_])(?:the|and|what is|docker is)(?:[^\p{L}\p{N}_]|$)", r"(?:^|[^\p{L}\p{N}_])(?:nedir|değildir|geliştirilen)(?:[^\p{L}\p{N}_]|$)"


@query(f"""SELECT x.pair_id, length({S.ends('o')}) < 10 AS empty_output, ({_TR} AND regexp_matches(lower(replace(o, 'İ', 'i̇')), '{_EN_SIGN}')) OR (NOT {_TR} AND regexp_matches(lower(replace(o, 'İ', 'i̇')), '{_TR_SIGN}')) AS language_mismatch, coalesce(t.times, 0) >= 3 AND len(w) >= 9 AS repeated_text FROM (SELECT pair_id, coalesce(l.a, '') AS p, coalesce(l.b, '') AS o, {S.words("coalesce(l.b, '')")} AS w FROM ({_LAST})) x
LEFT JOIN (SELECT pair_id, max(c) AS times FROM (SELECT pair_id, g, count(*) AS c FROM (SELECT pair_id, unnest(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(w[i : i + 2], ' '))) AS g FROM (SELECT pair_id, {S.words("coalesce(l.b, '')")} AS w FROM ({_LAST}))) GROUP BY ALL) GROUP BY pair_id) t ON t.pair_id = x.pair_id""")
def student_flags(spark, d):
    return health.student_flags(last(spark, d).select("pair_id", F.coalesce("prompt", F.lit("")).alias("p"), F.coalesce("response", F.lit("")).alias("o")))
