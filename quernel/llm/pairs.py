"""Problem 5: prompt and response pairs that are unfit for tuning, with the kind of defect.

Shortened answers show across pairs: sorted by text, a shortened answer stands right before a longer one whose common
prefix with it is the whole answer, and answers cut at a length limit pile up at one length. The ending is a weaker sign:
no closing mark, weighed against how often the last word closes sentences in all answers. ``truncated`` is their sum:

====================================================================  ==
a neighbour goes on in the midst of the sentence (MIN_SHARED words)   +2
a neighbour goes on, and the answer has no closing mark               +2
no closing mark                                                       +2
at a length where open answers pile up, and no closing mark           +2
last line of fewer than MIN_LINE words (a name, a value, an item)     -1
the last word closes sentences mostly (CLOSES of CLOSES_LEAST times)  -2
====================================================================  ==

From 2 on the answer is truncated. A closed answer that a longer one continues with a new sentence is a sound short one.
Rules on the pair itself decide the other kinds:

* ``empty``: nothing is left without mark-up, labels and placeholders;
* ``copy``: the answer has no word beyond the prompt's and repeats most of it;
* ``refusal``: outside quotations it declines to answer;
* ``wrong_language``: its language is another than the prompt's, and the prompt names no language that it is in.
"""

from __future__ import annotations

import math
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, small
from .language import LANGUAGES, Languages, letters, sentences
from .text import CODE, MAYBE_CODE, WORD, arrow_map, fold

# Contents that stand for no answer, and labels before an answer or a repeated question.
PLACEHOLDERS = frozenset("n/a na none null nil nan undefined empty yok bos tbd todo ... - -- — ### # {} [] () [empty] [null] [none] <empty> <null>".split())
LABELS = frozenset("answer cevap yanit response a r antwort reponse question soru q frage".split())
ASKED = re.compile(r"^\W*(?:you asked|your question(?: is| was)?|sorunuz(?: su| soyle)?|sordugunuz(?: soru)?|question|soru|q|answer|cevap|yanit|frage|antwort|reponse)\s*[:\-]\s*")

# Refusing phrases, on text without accents and quotations.
REFUSAL = re.compile(
    r"""
      \byardimci\ olam(?:am|iyorum|ayacagim|ayiz) | \b(?:yanit|cevap|karsilik|bilgi)\ (?:verem(?:em|iyorum|eyecegim)|veremeyiz) | \b(?:cevap|yanit)layam(?:am|iyorum)
    | \byerine\ getirem(?:em|iyorum) | \bgeri\ cevirmek\ (?:zorunda|durumunda) | \breddetmek\ (?:zorunda|durumunda)(?:yim|yiz) | \breddediyorum\b | \b(?:yetkim|iznim)\ yok\b
    | \b(?:gorus\ bildirmemeyi|yorum\ yapmamayi|yanitlamamayi|cevaplamamayi)\ tercih | \bkonusmam\ (?:mumkun|uygun)\ degil | \b(?:cevaplamak|yanitlamak)\ benim\ icin\ uygun
    | \btur\ (?:bir\ )?icerik(?:ler)?\ uret(?:miyorum|emem|emiyorum) | \bpaylasam(?:am|iyorum) | \bbunu\ yapam(?:am|iyorum)
    | \b(?:i|we)(?:'m|'re)?\ (?:\w+\ ){0,2}(?:can(?:'|no)?t|can\ not|won'?t|will\ not|(?:not\ able|unable)\ to|not\ in\ a\ position\ to)\ (?:\w+\ )?(?:help|assist|answer|fulfil|fulfill|comply|provide|discuss|comment|respond|share|do\ that|support\ (?:you|that))
    | \b(?:have|need)\ to\ decline\b | \bmust\ (?:decline|refuse)\b | \bi\ (?:decline|refuse)\b | \bprefer\ not\ to\ (?:comment|answer|say|discuss|respond) | \bdon'?t\ have\ (?:the\ )?permission\b
    | \bnot\ something\ i\ (?:do|can|will)\b | \bnot\ be\ appropriate\ for\ me\b | \boutside\ what\ i\ (?:produce|do|can)\b | \bagainst\ my\ (?:guidelines|policy)\b
    | \b(?:kann|darf|mochte)\ (?:ich\ )?(?:\w+\ ){0,4}nicht\ (?:\w+\ )?(?:beantworten|helfen|antworten) | \bich\ muss\ (?:\w+\ )?ablehnen\b
    | \bje\ ne\ (?:peux|suis)\ pas\ (?:\w+\ ){0,3}(?:aider|repondre) | \bje\ dois\ (?:refuser|decliner)
    """,
    re.VERBOSE,
)
QUOTED = re.compile(r"“[^”]*”|„[^“”]*[“”]|«[^»]*»|\"[^\"\n]*\"|`[^`\n]*`")

# Stems by which a prompt names a language.
NAMED = {"tr": r"turkce|turkish|turkisch\w*|turc\b|en turc", "en": r"ingilizce|english|englisch\w*|anglais", "de": r"almanca|german\b|deutsch\w*|allemand", "fr": r"fransizca|french|franzosisch\w*|francais"}
NAMED_RE = {k: re.compile(rf"\b(?:{v})") for k, v in NAMED.items()}

# Short answers and words of questions, by language.
SHORT = {
    "tr": "evet hayir her zaman degil gerekmez bir tabii elbette bazen belki nedir nasil neden nerededir hakkinda bilgi ver icin ile ne ise yarar demektir mi kullanirken anlat yaz oneri arasindaki fark ornek kisa ve".split(),
    "en": "yes no not always that is needed sure sometimes maybe a an the what how why where tell me about does with from should do when i for of to and".split(),
    "de": "ja nein nicht immer ein eine das der die ist was wie warum wo und nie".split(),
    "fr": "oui non pas toujours un une le la les est que comment pourquoi ou et".split(),
}
SHORT_SETS = {k: frozenset(v) for k, v in SHORT.items()}

#: Words that a closed answer needs to count as the shortened form of a neighbour; words of a last line that is a sentence.
MIN_SHARED, MIN_LINE = 5, 4
#: Share of its occurrences at which a word closes sentences for one that mostly does, and occurrences needed.
CLOSES, CLOSES_LEAST = 0.75, 5
#: Occurrences from which a prompt's word tells a language; words and lengths up to so many are broadcast.
TELLS, BROADCAST_ROWS = 10, 200_000

FENCE = re.compile(r"```.*?(?:```|\Z)", re.DOTALL)
ITEM = re.compile(r"^\s*(?:[-*•–]|\d{1,3}[.)])(?:\s+|$)")
ENDED = re.compile(r"[.!?…:;][\"'”“’»)\]*_`]*$|[”\"»)\]}`>]$")


def is_empty(response: str | None) -> bool:
    if response is None:
        return True
    text = re.sub(r"<[^>]*>", " ", response)
    text = re.sub(r"[​‌‍⁠﻿\s]+", " ", text).strip()
    bare = fold(text).strip()
    if not bare or bare in PLACEHOLDERS or bare.strip("[]<>(){}. ") in PLACEHOLDERS and not bare.endswith("."):
        return True
    words = WORD.findall(bare)
    return not words or all(w in LABELS for w in words) and bare[-1] in ":-"


def is_copy(prompt: str, response: str) -> bool:
    asked = set(WORD.findall(fold(prompt)))
    words = WORD.findall(ASKED.sub("", fold(response)))
    if not words or not asked:
        return False
    return all(w in asked for w in words) and len(set(words)) >= 0.75 * len(asked) and len(words) >= min(2, len(asked))


def is_refusal(response: str) -> bool:
    return bool(REFUSAL.search(QUOTED.sub(" ", fold(response.replace("’", "'")))))


def ends_open(response: str) -> tuple[bool, int]:
    """Whether an answer breaks off, and the words of its last line."""
    text = response.rstrip()
    if text.count("```") % 2:
        return True, 99
    last = text.rsplit("\n", 1)[-1]
    words = len(WORD.findall(last))
    if ITEM.match(last):
        rest = ITEM.sub("", last).strip()
        if not rest:
            return True, 99
        # items without a full stop are complete unless the ones before have one
        before = [x for x in text.split("\n")[:-1] if ITEM.match(x)]
        closed = bool(before) and all(ENDED.search(x.rstrip()) for x in before)
        return (closed or len(WORD.findall(rest)) > 8) and not ENDED.search(rest), words
    if MAYBE_CODE.search(last) and CODE.search(last):
        return False, words
    if text[-1:] in "“„«([{":
        return True, 99
    # an opening quotation mark that nothing closes
    return not ENDED.search(text) or text[-1] in ".!?" and last.count("“") > last.count("”") and last.count("„") == 0, words


def prose(text: str) -> str:
    return QUOTED.sub(lambda m: m.group() if m.group()[0] != "`" else " ", FENCE.sub(" ", text))


def language_of(text: str, model: Languages) -> tuple[str | None, float]:
    """Language of most of a text's words and its share, null where nothing is sure."""
    votes: dict[str, int] = {}
    total = 0
    for s in sentences(prose(text)):
        if MAYBE_CODE.search(s) and CODE.search(s):
            continue
        plain = letters(s)
        words = plain.split()
        if not words:
            continue
        short = {k: sum(w in v for w in words) for k, v in SHORT_SETS.items()}
        language = model.decide(plain)[0] if len(words) >= 5 else None
        top = max(short, key=lambda k: short[k])
        if language is None and short[top] > sorted(short.values())[-2] and short[top] >= 0.3 * len(words):
            language = top
        total += len(words)
        if language:
            votes[language] = votes.get(language, 0) + len(words)
    if not votes:
        return None, 0.0
    best = max(votes, key=lambda k: (votes[k], k))
    # the text as a whole must agree
    whole, confidence, guess = model.decide(letters(prose(text)))
    if total >= 5 and guess != best:
        return None, 0.0
    return best, votes[best] / total


def answer_key(response):
    """The answer without closing marks, by which neighbours are compared."""
    return F.regexp_replace(response, r"(?U)[\s.!?…]+$", "")


def shortened(answers: DataFrame) -> DataFrame:
    """(h, size, within): distinct answers (by ``answer_key``, as hash and length) that are a whole common prefix with
    their neighbour in sorted order; ``within``: the neighbour goes on within the sentence. The order is global: keys are
    spread by range, and the last of each part is held against the first of the parts after it."""
    keys = answers.select(answer_key(F.col("response")).alias("key")).where("key != ''").distinct()
    ordered = cut_lineage(keys.repartitionByRange(F.col("key")).sortWithinPartitions("key"))
    firsts = dict((r.part, r.first) for r in ordered.groupBy(F.spark_partition_id().alias("part")).agg(F.min("key").alias("first")).collect())  # one row per part
    after = {p: min((t for q, t in firsts.items() if q > p), default="") for p in firsts}
    fields = pa.schema([("key", pa.string()), ("within", pa.bool_())])

    def compare(batches):
        from pyspark import TaskContext

        own = TaskContext.get().partitionId()
        held = None
        for b in batches:
            texts = [held] * (held is not None) + b.column(0).to_pylist()
            held = texts.pop() if texts else None
            yield _continued(texts, [*texts[1:], held], fields)
        if held is not None:
            yield _continued([held], [after.get(own, "")], fields)

    found = ordered.mapInArrow(compare, "key string, within boolean")
    return found.select(F.xxhash64("key").alias("h"), F.length("key").alias("size"), "within")


def _continued(texts: list[str], follow: list[str], fields: pa.Schema) -> pa.RecordBatch:
    found = [(x, y[len(x)] not in ".!?…") for x, y in zip(texts, follow, strict=True) if len(os.path.commonprefix((x, y))) == len(x) < len(y)]
    return pa.RecordBatch.from_pydict({"key": [x for x, _ in found], "within": [w for _, w in found]}, schema=fields)


def length_limits(answers: DataFrame) -> DataFrame:
    """(n): lengths at which answers that break off pile up: at least ten, and five times the mean of the ten lengths
    around."""
    counts = answers.where("open").groupBy(F.length("response").alias("n")).agg(F.count("*").alias("k"))
    near = counts.select("k", F.explode(F.array(*[F.col("n") + d for d in range(-5, 6)])).alias("at"), "n")
    around = near.groupBy("at").agg(F.sum(F.when(F.col("at") == F.col("n"), F.col("k")).otherwise(0)).alias("k"), (F.sum(F.when(F.col("at") != F.col("n"), F.col("k")).otherwise(0)) / 10).alias("mean"))
    return around.where("k >= 10 and k >= 5 * greatest(mean, 1)").select(F.col("at").alias("n"))


_WORD, _CLOSED = r"[\p{L}\p{N}]+(?:[.!?…](?=\s|$))?", r"[.!?…]$"


def closing_words(answers: DataFrame) -> DataFrame:
    """(last): words that mostly close sentences, counted over all answers."""
    tokens = answers.select(F.explode(F.regexp_extract_all(F.lower("response"), F.lit(_WORD), F.lit(0))).alias("t"))
    counts = tokens.groupBy(F.regexp_replace("t", _CLOSED, "").alias("last")).agg(F.count("*").alias("n"), F.sum(F.col("t").rlike(_CLOSED).cast("long")).alias("closing"))
    return counts.where((F.col("n") >= CLOSES_LEAST) & (F.col("closing") >= CLOSES * F.col("n"))).select("last")


def truncated(rest: DataFrame) -> DataFrame:
    """``rest`` (pair_id, response, open, words) with ``truncated``."""
    evidence = small(shortened(rest), BROADCAST_ROWS)
    limits = small(length_limits(rest).withColumn("limit", F.lit(2)), BROADCAST_ROWS)
    last = F.regexp_extract(F.lower("response"), r"(?U)([\p{L}\p{N}]+)[\s*_`\"'”’»)]*$", 1)
    closing = small(closing_words(rest).withColumn("closes", F.lit(-2)), BROADCAST_ROWS)
    key = answer_key(F.col("response"))
    marked = rest.withColumns({"h": F.xxhash64(key), "size": F.length(key), "n": F.length("response"), "last": F.when(F.col("open") & (F.col("words") < 99), last)})
    joined = marked.join(evidence, ["h", "size"], "left").join(limits, "n", "left").join(closing, "last", "left")
    opened = F.col("open").cast("int")
    several = F.size(F.regexp_extract_all(key, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    neighbour = F.when(F.col("open") & (F.col("words") >= 2) & F.col("within").isNotNull() | ~F.col("open") & F.col("within") & (several >= MIN_SHARED), 2).otherwise(0)
    signs = 2 * opened + neighbour + F.when(F.col("open") & (F.col("words") >= 2), F.coalesce("limit", F.lit(0))).otherwise(0) - F.when(F.col("open") & (F.col("words") < MIN_LINE), 1).otherwise(0) + F.coalesce("closes", F.lit(0))
    return joined.withColumn("truncated", signs >= 2).drop("h", "size", "n", "last", "within", "limit", "closes")


def prompt_scores(rest: DataFrame) -> DataFrame:
    """(pair_id, scores): per language the summed logs of its share among the answers to prompts with a word, over the
    words of the pair's prompt: most answers are in the language of their prompt, so a word's language shows in the
    answers to prompts that hold it."""
    words = rest.select("pair_id", "got", F.explode("asked").alias("word"))
    by = words.groupBy("word").agg(*[F.sum((F.col("got") == n).cast("long")).alias(n) for n in LANGUAGES], F.count("*").alias("total")).where(F.col("total") >= TELLS)
    logs = by.select("word", *[F.log((F.col(n) + 1) / (F.col("total") + len(LANGUAGES))).alias(n) for n in LANGUAGES])
    return words.select("pair_id", "word").join(small(logs, BROADCAST_ROWS), "word").groupBy("pair_id").agg(F.array(*[F.sum(n) for n in LANGUAGES]).alias("scores"))


def prompt_language(scores: list[float] | None, words: list[str], model: Languages) -> str | None:
    if scores:
        first, second = sorted(zip(scores, LANGUAGES, strict=True), reverse=True)[:2]
        if first[0] - second[0] >= math.log(3):
            return first[1]
    return language_of(" ".join(words), model)[0]


def defects(pairs: DataFrame, model: Languages) -> DataFrame:
    """(pair_id, defect): each defective pair once, with one kind: of several the first of empty, copy, refusal,
    truncated, wrong_language.

    Of several deliveries of a ``pair_id`` the last loaded counts. A null or blank response is empty; a null prompt is
    taken as blank (nothing can copy it, and it has no language). Rows with a null ``pair_id`` are left out. ``pairs``
    needs pair_id, prompt, response, loaded_at; other columns are not read.
    """
    last = pairs.where("pair_id is not null").groupBy("pair_id").agg(F.max_by(F.struct("prompt", "response"), F.struct("loaded_at", "response", "prompt")).alias("p")).select("pair_id", "p.*")
    source = model.source
    fields = pa.schema([("pair_id", pa.int64()), ("response", pa.string()), ("defect", pa.string()), ("open", pa.bool_()), ("words", pa.int32()), ("got", pa.string()), ("named", pa.bool_()), ("asked", pa.list_(pa.string()))])

    def rules(given: dict[str, list], model: Languages) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in fields.names}
        for i, p, r in zip(given["pair_id"], given["prompt"], given["response"], strict=True):
            p = p or ""
            defect = "empty" if is_empty(r) else "copy" if is_copy(p, r) else "refusal" if is_refusal(r) else None
            opened, words, got, named, asked = False, 0, None, False, []
            if defect is None:
                opened, words = ends_open(r)
                got, share = language_of(r, model)
                got = got if share >= 0.6 else None
                named = got is not None and bool(NAMED_RE[got].search(fold(p)))
                asked = sorted(set(letters(p).split()))
            for n, v in zip(fields.names, (i, r, defect, opened, words, got, named, asked), strict=True):
                out[n].append(v)
        return out

    schema = "pair_id long, response string, defect string, open boolean, words int, got string, named boolean, asked array<string>"
    judged = cut_lineage(arrow_map(last.select(F.col("pair_id").cast("long").alias("pair_id"), "prompt", "response"), rules, schema, fields, lambda: Languages(source)))
    rest = judged.where("defect is null")

    other_fields = pa.schema([("pair_id", pa.int64()), ("other", pa.bool_())])

    def languages(given: dict[str, list], model: Languages) -> dict[str, list]:
        own = [prompt_language(s, a, model) for s, a in zip(given["scores"], given["asked"], strict=True)]
        return {"pair_id": given["pair_id"], "other": [o is not None and o != g for o, g in zip(own, given["got"], strict=True)]}

    told = rest.where("got is not null and not named").select("pair_id", "got", "asked")
    scored = told.join(prompt_scores(told), "pair_id", "left")
    other = arrow_map(scored, languages, "pair_id long, other boolean", other_fields, lambda: Languages(source)).where("other")

    cut = truncated(rest).where("truncated").select("pair_id", F.lit("truncated").alias("defect"))
    foreign = other.join(cut, "pair_id", "left_anti").select("pair_id", F.lit("wrong_language").alias("defect"))
    return judged.where("defect is not null").select("pair_id", "defect").union(cut).union(foreign)
