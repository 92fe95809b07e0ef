"""Queries on prompt and response pairs: filters, categories, relevance, scores and mixes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import instruct as I
from ..operators import select
from ..session import table
from . import fragments as S
from .catalogue import query

#: The name under which the model of these rows goes.
OWN = "quernel"

_PLAIN = "lower(translate({}, 'İIı', 'iii'))"
# the last delivery of each pair, and the texts that the filters read
_LAST = "SELECT pair_id, max_by(struct_pack(a := prompt, b := response, s := source, c := category), loaded_at) AS l FROM instruct_seed GROUP BY pair_id"


def _texts(prompt: str = "l.a", response: str = "l.b") -> str:
    inner = f"SELECT pair_id, l.s AS source, l.c AS category, {S.squeeze(prompt)} AS p, {S.squeeze(response)} AS r, {_PLAIN.format('concat_ws(chr(10), l.a, l.b, l.s, l.c)')} AS row FROM ({_LAST})"
    return f"SELECT *, p || chr(10) || r AS t, {_PLAIN.format('p')} AS fp, {_PLAIN.format('r')} AS fr, {_PLAIN.format('p')} || chr(10) || {_PLAIN.format('r')} AS ft FROM ({inner})"


def _tidy(c: str) -> str:
    c = f"coalesce({c}, '')"
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        c = f"replace({c}, '{entity}', '{sign}')"
    return f"replace(regexp_replace({c}, '<[^>]+>', ' ', 'g'), chr(8203), ' ')"


def has(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, '{pattern.replace(chr(39), chr(39) * 2)}')"


def first(*checks: tuple[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {condition} THEN '{name}'" for name, condition in checks) + " ELSE 'accepted' END"


def last(spark, d):
    p = table(spark, d, "instruct_seed", "pair_id", "prompt", "response", "source", "category", "loaded_at").groupBy("pair_id").agg(F.max_by(F.struct("prompt", "response", "source", "category"), "loaded_at").alias("l"))
    return p.select("pair_id", "l.*")


def pairs(spark, d):
    return I.with_texts(last(spark, d), more=("source", "category"))


def _sizes(least, most, prompt, prompt_first):
    own = [("prompt_too_long", f"length(p) > {prompt}")]
    return [("empty_prompt", "p = ''"), ("empty_response", "r = ''"), *(own * prompt_first), ("response_too_short", f"length(r) < {least}"), ("response_too_long", f"length(r) > {most}"), *(own * (not prompt_first))]


@query(f"""SELECT pair_id, {first(*_sizes(20, 800, 500, False), ('blocked_identity_phrase', has('row', I.IDENTITY)), ('url', has('ft', I.URL)), ('email', has('ft', I.EMAIL)), ('phone', has('ft', I.PHONE)), ('secret_or_api_key', has('ft', I.SECRET) + ' OR ' + has('t', I.KEY_LIKE)))} AS reason FROM ({_texts()})""")
def chat_reject_reason(spark, d):
    return pairs(spark, d).select("pair_id", F.coalesce(I.chat_reason(), F.lit("accepted")).alias("reason"))


_TURKISH = f"({has('t', I.TURKISH_LETTERS)} OR len(list_intersect(list_distinct(regexp_extract_all(lower(t), '[a-zçğıöşü]+')), [{', '.join(repr(w) for w in I.TURKISH_WORDS)}])) >= 3)"
_SPECIAL = r"length(regexp_replace({0}, '[\p{{L}}\p{{N}}\s.,:;!?\-_''\"()\[\]/%]+', '', 'g'))::DOUBLE / length({0}) > 0.18"


@query(f"""SELECT pair_id, {first(('empty', "p = '' OR r = ''"), ('prompt_too_long', 'length(p) > 500'), ('response_length', 'length(r) NOT BETWEEN 20 AND 800'), ('not_turkish', 'NOT ' + _TURKISH),
('blocked_content', S.any_of('lower(t)', I.BAD_IDENTITY) + ' OR ' + S.any_of('lower(t)', I.BAD_TOPICS) + ' OR ' + has('lower(t)', I.INSTRUCT_SECRETS)), ('special_characters', _SPECIAL.format('p') + ' OR ' + _SPECIAL.format('r')), ('few_words', "len(string_split(r, ' ')) < 3"))} AS reason FROM ({_texts(_tidy('l.a'), _tidy('l.b'))})""")
def instruct_reject_reason(spark, d):
    tidied = last(spark, d).withColumns({"prompt": I.tidy(F.col("prompt")), "response": I.tidy(F.col("response"))})
    return I.with_texts(tidied).select("pair_id", F.coalesce(I.instruct_reason(), F.lit("accepted")).alias("reason"))


@query(f"""SELECT pair_id, CASE {' '.join(f"WHEN {S.any_of('low', terms + ((OWN,) if name == 'identity' else ()))} THEN '{name}'" for name, terms in I.INSTRUCT_CATEGORIES)} ELSE 'other' END AS category, {_TURKISH} AS turkish FROM (SELECT *, lower(' ' || p || ' ' || r || ' ') AS low FROM ({_texts()}))""")
def instruct_categories(spark, d):
    return pairs(spark, d).select("pair_id", I.instruct_category((OWN,)).alias("category"), I.turkish().alias("turkish"))


def _names_sql(c):
    parts = f"list_filter(list_transform(string_split_regex({c}, '[,;\\n•]+'), lambda x: trim(x, ' -•*0123456789.)(')), lambda x: x != '')"
    return f"(trim({c}, ' -•*0123456789.,;:' || chr(10) || chr(9)) != '' AND length(regexp_replace({c}, '[^,;\\n•]', '', 'g')) >= 3 AND NOT {has(c, '[.!?]')} AND len({parts}) >= 4 AND len(list_filter({parts}, lambda x: len(string_split_regex(x, ' +')) <= 4)) >= 0.85 * len({parts}))"


_RELATED = f"(NOT {has('ft', I.SOFTWARE_FALSE)} AND ({has('ft', I.SOFTWARE_STRONG)} OR {has('ft', I.SOFTWARE_WEAK)} AND {has('ft', I.SOFTWARE_CONTEXT)}))"


@query(f"""SELECT pair_id, {first(*_sizes(20, 1000, 600, False), ('blocked_identity_phrase', has('row', I.IDENTITY)), ('url', has('row', I.URL)), ('email', has('row', I.EMAIL)), ('phone', has('row', I.PHONE)), ('secret_or_api_key', has('row', I.SECRET) + ' OR ' + has('t', I.KEY_LIKE)), ('adult_content', has('ft', I.ADULT)),
('hate_or_harassment', has('ft', I.HATE)), ('illegal_or_unsafe', has('ft', I.UNSAFE)), ('name_list', _names_sql('p') + ' OR ' + _names_sql('r')), ('broken_turkish', has('t', I.BROKEN)), ('not_software_related', 'NOT ' + _RELATED))} AS reason FROM ({_texts()})""")
def software_reject_reason(spark, d):
    return pairs(spark, d).select("pair_id", F.coalesce(I.software_reason(), F.lit("accepted")).alias("reason"))


def _support_sql(local):
    at = "ft" if local else "row"
    noise = [] if local else [("task_noise", has("fp", I.TASK_NOISE))]
    related = [] if local else [("not_support_related", f"NOT ({has('fp', I.SUPPORT_PROMPT)} AND {has('fr', I.SUPPORT_RESPONSE)})")]
    return first(*_sizes(20, 700, 500, True), ("blocked_identity_phrase", has(at, I.IDENTITY)), *noise, ("self_harm_skipped", has("ft", I.SELF_HARM)), ("violent_or_hate_context", has("ft", I.VIOLENCE)), ("medical_or_therapy_claim", has("ft", I.MEDICAL)), ("url", has(at, I.URL)), ("email", has(at, I.EMAIL)), ("phone", has(at, I.PHONE)), ("secret_or_api_key", has(at, I.SECRET)), ("broken_turkish", has("t", I.BROKEN)), *related)


@query(f"SELECT pair_id, {_support_sql(False)} AS reason, {_support_sql(True)} AS local_reason FROM ({_texts()})")
def support_reject_reason(spark, d):
    return pairs(spark, d).select("pair_id", F.coalesce(I.support_reason(), F.lit("accepted")).alias("reason"), F.coalesce(I.support_reason(True), F.lit("accepted")).alias("local_reason"))


_KIND = f"""CASE WHEN coalesce(category, 'general') = 'identity' OR coalesce(source, '') IN ('local_identity', 'local_identity_anchor') THEN 'identity' WHEN coalesce(category, 'general') = 'emotional_support' OR coalesce(source, '') = 'local_support_seed' THEN 'emotional_support'
WHEN coalesce(source, '') = 'local_ai_seed' AND {has('ft', I.MIX_LOCAL_AI)} THEN 'programming' WHEN coalesce(category, 'general') = 'ai' OR coalesce(source, '') = 'local_ai_seed' OR {has('ft', I.MIX_AI)} THEN 'ai' WHEN coalesce(category, 'general') = 'programming' OR {has('ft', I.MIX_SOFTWARE)} THEN 'programming' ELSE 'general' END"""
# every character that is no part of a word is doubled, so that neighbours may both use it
_DOUBLED = r"regexp_replace(ft, '([^\p{L}\p{N}_])', '\1\1', 'g')"
_COUNT = rf"len(regexp_extract_all({_DOUBLED}, '(?:^|[^\p{{L}}\p{{N}}_])(?:{I.PREFERRED.replace(' ', '  ').replace('.?', '.{0,2}')})(?:[^\p{{L}}\p{{N}}_]|$)'))"
_SCORE = f"(3 * {_COUNT} + 4 * {has('ft', I.CODE_SIGNS)}::INTEGER + 3 * {has('fp', I.PROMPT_ERRORS)}::INTEGER + 3 * {has('fp', I.PROMPT_TOOLS)}::INTEGER - 2 * {has('fp', I.PROMPT_FOOD)}::INTEGER)"
_EXCEPTED = f"(coalesce(source, '') IN ('local_identity', 'local_identity_anchor') AND {has('fp', 'chatgpt|openai|gpt')} AND {has('fr', 'hayir|değilim|degilim')} AND contains(fr, '{OWN}'))"
_CONTAMINATED = f"CASE WHEN {_EXCEPTED} THEN {has('fr', 'ben chatgpt|i am chatgpt')} ELSE {has('ft', I.MIX_IDENTITY)} END"
_SUPPORT = "kind = 'emotional_support' AND coalesce(source, '') != 'local_support_seed'"
_MIX = first(
    ("empty_prompt", "p = ''"), ("empty_response", "r = ''"), ("prompt_too_long", "length(p) > 700"), ("response_too_short", "length(r) < 20"), ("response_too_long", "length(r) > 1200"), ("broken_turkish", has("t", I.BROKEN)), ("blocked_identity_phrase", _CONTAMINATED), ("secret_or_private_data", has("ft", I.MIX_SECRETS) + " OR " + has("t", I.KEY_LIKE)),
    ("unsafe_content", has("ft", I.MIX_UNSAFE)), ("software_false_positive", f"kind = 'programming' AND ({has('ft', I.MIX_FALSE)} OR contains(ft, 'terminal') AND contains(ft, 'uçak'))"), ("software_task_noise", f"kind = 'programming' AND {has('fp', I.MIX_NOISE)}"), ("not_programming_related", f"kind = 'programming' AND NOT {has('ft', I.MIX_SOFTWARE)}"),
    ("weak_programming_signal", f"kind = 'programming' AND {_SCORE} <= 0"), ("support_task_noise", f"{_SUPPORT} AND {has('fp', I.MIX_SUPPORT_NOISE)}"), ("not_support_related", f"{_SUPPORT} AND NOT ({has('fp', I.MIX_SUPPORT_PROMPT)} AND {has('fr', I.MIX_SUPPORT_RESPONSE)})"),
)


@query(f"SELECT pair_id, kind, {_MIX} AS reason FROM (SELECT *, {_KIND} AS kind FROM ({_texts()}))")
def mix_reject_reason(spark, d):
    return pairs(spark, d).withColumn("kind", I.mix_category()).select("pair_id", "kind", F.coalesce(I.mix_reason(OWN), F.lit("accepted")).alias("reason"))


@query(f"SELECT pair_id, {_SCORE}::INTEGER AS score, {_RELATED} AS software, ({_CONTAMINATED}) AS other_identity FROM ({_texts()})")
def pair_relevance(spark, d):
    """Programming score, software relevance and claims of another identity."""
    return pairs(spark, d).select("pair_id", I.programming_score().cast("int").alias("score"), I.software_related().alias("software"), I.identity_contaminated(OWN).alias("other_identity"))


_OTHER = "coalesce(category, '') != 'identity'"


@query(f"""SELECT pair_id, {first(*_sizes(20, 900, 1 << 30, False), ('chatgpt_openai_contamination', has('ft', I.DISTILL_IDENTITY)), ('qwen_identity_contamination', has('ft', I.DISTILL_OTHER)), ('secret_or_token', has('ft', I.SECRET) + ' OR ' + has('t', I.KEY_LIKE)), ('private_data', has('ft', I.DISTILL_PRIVATE)), ('url_content', has('ft', I.URL)),
('unsafe_cyber', has('ft', I.DISTILL_CYBER)), ('illegal_instruction', has('ft', I.DISTILL_ILLEGAL)), ('medical_or_therapy_claim', has('ft', I.DISTILL_MEDICAL)), ('own_identity_leak', f"{_OTHER} AND starts_with(fr, 'ben {OWN}')"))} AS reason FROM ({_texts()})""")
def distill_reject_reason(spark, d):
    return pairs(spark, d).select("pair_id", F.coalesce(I.distill_reason(OWN), F.lit("accepted")).alias("reason"))


@query(f"WITH x AS (SELECT {_PLAIN.format(chr(99))} AS f FROM (SELECT coalesce(l.b, '') AS c FROM ({_LAST}))) SELECT label, count(*) AS pairs, sum(hits)::BIGINT AS hits FROM (" + " UNION ALL ".join(f"SELECT '{label}' AS label, len(regexp_extract_all(f, '{p}')) AS hits FROM x" for label, p in I.UNSAFE_CODE) + ") WHERE hits > 0 GROUP BY label")
def unsafe_code(spark, d):
    """What code in answers must not hold, counted over all pairs."""
    hits = last(spark, d).select(F.explode(I.unsafe_code(F.coalesce("response", F.lit("")))).alias("h")).select("h.*")
    return hits.groupBy("label").agg(F.count("*").alias("pairs"), F.sum("hits").cast("long").alias("hits"))


def _names_query(c):
    return f"SELECT pair_id, {_names_sql(c)} AS listed FROM ({_texts()})"


@query(_names_query("r"))
def name_lists(spark, d):
    return pairs(spark, d).select("pair_id", I.name_list("r").alias("listed"))


_RANKED = f"SELECT pair_id, kind, row_number() OVER (PARTITION BY kind ORDER BY sha256('mix:' || pair_id::VARCHAR), pair_id) AS k FROM (SELECT pair_id, {_KIND} AS kind, {_MIX} AS reason FROM (SELECT *, {_KIND} AS kind FROM ({_texts()}))) WHERE reason = 'accepted'"
# What each category gets of a mix of 1,000, and the most that identity may take of all.
MIX_COUNTS = {"programming": 400, "general": 200, "ai": 150, "emotional_support": 150, "identity": 100}
_MOST = "CASE kind " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in MIX_COUNTS.items()) + " ELSE 0 END"


@query(f"""WITH c AS ({_RANKED}), x AS (SELECT pair_id, kind, 'quota' AS part FROM c WHERE k <= {_MOST}), n AS (SELECT 1000 - count(*) AS free FROM x), f AS (SELECT pair_id, kind, row_number() OVER (ORDER BY sha256('fill:' || pair_id::VARCHAR), pair_id) AS k FROM c WHERE k > {_MOST} AND kind != 'identity')
SELECT * FROM x UNION ALL SELECT pair_id, kind, 'fill' FROM f, n WHERE f.k <= n.free""")
def mix_selection(spark, d):
    """A mix of 1,000 accepted pairs: each category's count in seeded order, filled up from the rest but for identity,
    whose share is capped."""
    judged = pairs(spark, d).withColumn("kind", I.mix_category()).withColumn("reason", I.mix_reason(OWN)).where("reason is null").select("pair_id", "kind")
    return select.quota_fill(judged, "kind", "pair_id", MIX_COUNTS, 1000, ("identity",), "mix:", "fill:")


_EXAMPLE = "'Kullanıcı: ' || coalesce(l.a, '') || chr(10) || 'Asistan: ' || coalesce(l.b, '')"
_TERMS = lambda terms: "(" + " + ".join(f"contains(f, '{t}')::INTEGER" for t in terms) + ")"
_NEGATIVES = f"""list_filter([CASE WHEN length(e) < 20 THEN 'too short' END, CASE WHEN length(e) > 4000 THEN 'too long' END, CASE WHEN len(regexp_extract_all(e, '```')) % 2 != 0 THEN 'broken code fences' END, CASE WHEN len(regexp_extract_all(e, '(?i)https?://|www\\.')) > 2 THEN 'too many URLs' END,
CASE WHEN {S.any_of('f', I.SCORE_FURNITURE)} THEN 'web boilerplate' END, CASE WHEN ends_with({S.ends('e')}, 'Kullanıcı:') OR ends_with({S.ends('e')}, 'Asistan:') THEN 'unfinished dialogue' END, CASE WHEN len(k) - len(list_distinct(k)) >= 3 THEN 'repeated lines' END, CASE WHEN len(regexp_extract_all(e, 'Kullanıcı:')) > 1 THEN 'multiple user markers inside example' END,
CASE WHEN a = '' THEN 'empty answer' END, CASE WHEN q != '' AND fa != '' AND starts_with(fa, q) AND length(fa) < length(q) + 20 THEN 'answer repeats question' END], lambda x: x IS NOT NULL)"""
_TURKISH_E = f"({has('e', I.TURKISH_LETTERS)} OR len(list_intersect(regexp_extract_all(f, '[\\p{{L}}\\p{{N}}_]+'), [{', '.join(repr(w) for w in I.SCORE_WORDS)}])) > 0)"


@query(f"""WITH x AS (SELECT pair_id, {_EXAMPLE} AS e, {S.ends("substr(e, instr(e, 'Asistan:') + 8)")} AS a, {S.ends("split_part(substr(e, instr(e, 'Kullanıcı:') + 10), chr(10), 1)")} AS q0 FROM ({_LAST})), y AS (SELECT *, {S.casefold('e')} AS f, list_transform({S.kept_lines('e')}, lambda x: {S.squeeze('x')}) AS k, {S.squeeze(S.casefold('q0'))} AS q, {S.squeeze(S.casefold('a'))} AS fa, {S.squeeze(S.casefold('e'))} AS key FROM x),
n AS (SELECT pair_id, key, {_NEGATIVES} AS negatives, (2 * {_TURKISH_E}::INTEGER + least({_TERMS(I.SCORE_TECHNICAL)}, 3) + 2 + (length(a) >= 20)::INTEGER + least({_TERMS(I.SCORE_PROJECT + (OWN,))}, 2) - 2 * len({_NEGATIVES}))::BIGINT AS score FROM y), g AS (SELECT *, score >= 2 AND len(list_intersect(negatives, [{', '.join(repr(x) for x in I.HARD_NEGATIVES)}])) = 0 AS ok FROM n),
h AS (SELECT *, coalesce(pair_id > min(CASE WHEN ok THEN pair_id END) OVER (PARTITION BY key), false) AS again FROM g) SELECT pair_id, CASE WHEN again THEN 0 ELSE score END AS score, CASE WHEN again THEN ['duplicated exact example'] ELSE negatives END AS negatives, ok AND NOT again AS accepted FROM h""")
def scored_gate(spark, d):
    """Score and verdict of every pair as a dialogue example."""
    e = F.concat(F.lit("Kullanıcı: "), F.coalesce("prompt", F.lit("")), F.lit("\nAsistan: "), F.coalesce("response", F.lit("")))
    return I.scored_examples(last(spark, d).withColumn("e", e), "pair_id", "e", own=(OWN,)).withColumnRenamed("id", "pair_id")
