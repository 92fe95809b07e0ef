"""Problem 1: language of each text and of each segment of a mixed text, with a confidence.

Compression classification: every language has a zstandard raw-content dictionary of sample text; a sentence belongs to
the language whose dictionary makes it smallest, unless the margin to the next is narrow, in which case it says nothing
and goes with its neighbours; a text of which not even the whole is clear is ``unknown``. Runs of sentences in one language are segments; a run of fewer than ``MIN_WORDS`` words
(names, titles, quotations, terms) is none. A run of fewer than one and a half times as many sure words that isn't a very
clear case is judged again as a whole, with its narrow sentences and without what is quoted inside its sentences.

The dictionaries are fitted on a bounded sample: at most ``sample`` labelled texts per language, chosen by hash over all
rows, of which ``dictionary`` bytes per language are kept. Labels may be wrong: the sample is split in two halves, each
classified by dictionaries of the other, again and again; texts that another language compresses better are dropped, in
the end sentences too.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import CODE, MAYBE_CODE, Cache, arrow_map, fold

# Labels that name a language, in lower case; what precedes a hyphen or underscore is looked up.
LABELS = {
    "tr": "tr", "tur": "tr", "turkish": "tr", "türkçe": "tr", "turkce": "tr", "türkisch": "tr", "turc": "tr",
    "en": "en", "eng": "en", "english": "en", "ingilizce": "en", "i̇ngilizce": "en", "englisch": "en", "anglais": "en",
    "de": "de", "deu": "de", "ger": "de", "german": "de", "deutsch": "de", "almanca": "de", "allemand": "de",
    "fr": "fr", "fra": "fr", "fre": "fr", "french": "fr", "français": "fr", "francais": "fr", "fransızca": "fr", "französisch": "fr",
    "unknown": "unknown", "und": "unknown", "zxx": "unknown",
}
STAND_INS = ("", "n/a", "na", "null", "none", "?", "-", "--", "nan", "nil", "tbd", "missing", "not set", "undefined")
LANGUAGES = ("tr", "en", "de", "fr")

MIN_WORDS = 10

SENTENCE = re.compile(r"[^\n]*?[.!?…][\"'”“’»)\]]*(?=\s|$)|[^\n]+")
_NOISE = re.compile(r"[`@/\\_=<>{}|#\d]")
_LETTERS = re.compile(r"[a-z]+")
#: What is quoted inside a sentence: terms and titles of other languages.
_QUOTED = re.compile(r"(?<=\w)\s+(?:“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|\"[^\"\n]*\")|(?:“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|\"[^\"\n]*\")(?=,?\s+\w)")


def label_language(column):
    """The language that a label names: one of the four, ``unknown``, null for a missing label, ``other`` else."""
    text = F.lower(F.trim(F.regexp_replace(column, r"(?U)^\s+|\s+$", "")))
    named = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    found = F.coalesce(named[text], named[F.regexp_extract(text, r"^([a-z]{2,3})[-_]", 1)])
    return F.when(text.isNull() | text.isin(*STAND_INS), F.lit(None)).otherwise(F.coalesce(found, F.lit("other")))


def _token(token: str) -> str:
    return "" if _NOISE.search(token) else " ".join(_LETTERS.findall(fold(token)))


#: Letters of white-space separated tokens, per worker.
_TOKENS = Cache(_token)


def letters(sentence: str) -> str:
    """What is compressed: words in lower case without accents, digits, code and addresses."""
    return " ".join([t for t in map(_TOKENS.__getitem__, sentence.split()) if t])


def sentences(text: str) -> list[str]:
    out = []
    for m in SENTENCE.finditer(text):
        s = m.group().strip()
        if s:
            out.append(s)
    return out


def wordy(units: list[tuple]) -> bool:
    """Whether there are words of a language: runs of three letters or more, and not just among shorter ones."""
    words = [w for u in units for w in u[4].split(" ")]
    long = sum(len(w) >= 3 for w in words)
    return long >= 1 and long >= 0.25 * len(words)


class Languages:
    """Dictionaries of several languages and the decision between them."""

    def __init__(self, texts: dict[str, bytes], level: int = 3, margin: float = 0.08):
        self.source = texts
        self.names = sorted(texts)
        self.margin = margin
        self.coders = []
        for n in self.names:
            if len(texts[n]) < 8:
                self.coders.append(None)
                continue
            d = zstandard.ZstdCompressionDict(texts[n], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.coders.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def sizes(self, plain: str) -> list[tuple[int, str]]:
        data = (" " + plain + " ").encode()
        return sorted((len(c(data)) - 6, n) for c, n in zip(self.coders, self.names, strict=True) if c)

    def decide(self, plain: str) -> tuple[str | None, float, str | None]:
        """(language, confidence, best guess): language is null where the margin is narrow."""
        if len(plain) < 2:
            return None, 0.0, None
        sizes = self.sizes(plain)
        if len(sizes) < 2:
            return (sizes[0][1], 0.5, sizes[0][1]) if sizes else (None, 0.0, None)
        (a, best), (b, _) = sizes[:2]
        confidence = min(1.0, 0.5 + (b - a) / max(b, 1))
        return (best if b - a >= max(2, self.margin * b) else None), confidence, best

    def holds(self, language: str, parts: list[str], min_words: int) -> bool:
        """Whether sentences, without what is quoted inside them, are together ``min_words`` words of a language."""
        own = [_QUOTED.sub(" ", p) for p in parts]
        return sum(bool(_TOKENS[t]) for p in own for t in p.split()) >= min_words and self.decide(" ".join(map(letters, own)))[0] == language

    def segments(self, text: str, min_words: int = MIN_WORDS) -> list[tuple[str, int, float]]:
        """(language, words, confidence) of each segment in text order; a text without words has one of ``unknown``."""
        units = []  # language or None, words, confidence, guess
        for s in sentences(text):
            if MAYBE_CODE.search(s) and CODE.search(s):
                continue
            plain = letters(s)
            n = plain.count(" ") + 1 if plain else 0
            if n:
                units.append((*self.decide(plain), n, plain, s))
        if not wordy(units):
            return [("unknown", 0, 1.0)]
        runs: list[list] = []  # language, words, weighted confidence
        held = 0  # words that say nothing, before the first that do
        early: list[tuple] = []  # their best guesses and sentences
        for language, confidence, guess, n, _, s in units:
            if language is None:
                if runs:
                    runs[-1][1] += n
                    runs[-1][4] += [s] * (guess == runs[-1][0])
                else:
                    held += n
                    early.append((guess, s))
            elif runs and runs[-1][0] == language:
                runs[-1][1] += n
                runs[-1][2] += n * confidence
                runs[-1][3] += n
                runs[-1][4].append(s)
            else:
                runs.append([language, n, n * confidence, n, [x for g, x in early if g == language] * (not runs) + [s]])
        if not runs:  # no sentence is sure: the whole may be, else the text is in none of the languages
            language, confidence, _ = self.decide(" ".join(letters(s) for s in sentences(text)))
            return [(language, held, confidence) if language else ("unknown", held, 1.0 - confidence)]
        runs[0][1] += held
        return [(r[0], r[1], r[2] / r[3]) for r in self._settled(runs, min_words)]

    def _settled(self, runs: list[list], min_words: int) -> list[list]:
        """Runs without the weak ones: from the weakest on, a run of few words that isn't a clear case, by its sentences
        or as a whole, goes with the run before it (the first with the one after), and neighbours in one language are
        joined. Each run is judged again only when it has grown."""
        before, after = list(range(-1, len(runs) - 1)), [*range(1, len(runs)), -1]
        weak: list[tuple[int, int, int]] = []
        version = [0] * len(runs)

        def judge(i: int) -> None:
            r = runs[i]
            version[i] += 1
            sure = r[3] if r[3] >= 1.5 * min_words or r[2] >= 0.8 * r[3] else 0
            if sure < min_words and not self.holds(r[0], r[4], min_words):
                heapq.heappush(weak, (sure, i, version[i]))

        def unlink(i: int) -> None:
            version[i] = -1
            if before[i] >= 0:
                after[before[i]] = after[i]
            if after[i] >= 0:
                before[after[i]] = before[i]

        for i in range(len(runs)):
            judge(i)
        left = len(runs)
        while weak and left > 1:
            _, i, at = heapq.heappop(weak)
            if version[i] != at:
                continue
            into = before[i] if before[i] >= 0 else after[i]
            runs[into][1] += runs[i][1]
            unlink(i)
            left -= 1
            beside = after[into] if into < i else -1
            if beside >= 0 and runs[into][0] == runs[beside][0]:
                for k in (1, 2, 3, 4):
                    runs[into][k] += runs[beside][k]
                unlink(beside)
                left -= 1
                judge(into)
        return [r for r, v in zip(runs, version, strict=True) if v >= 0]


def fit(docs: DataFrame, sample: int = 300, dictionary: int = 96_000, text_col: str = "text", label_col: str = "language", id_col: str = "ext_id") -> Languages:
    """Fit the dictionaries on at most ``sample`` labelled texts per language, chosen by hash over all rows."""
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), label_language(F.col(label_col)).alias("lang")).where(F.col("lang").isin(*LANGUAGES) & F.col("text").isNotNull())
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    rows = labelled.withColumn("rank", rank).where(F.col("rank") <= sample).collect()  # at most 4 * sample rows
    return fit_rows([(r.lang, r.text) for r in sorted(rows, key=lambda r: (r.lang, r["rank"]))], dictionary)


def fit_rows(rows: list[tuple[str, str]], dictionary: int = 96_000) -> Languages:
    texts = {n: [[], []] for n in LANGUAGES}
    for i, (lang, text) in enumerate(dict.fromkeys(rows)):  # a copy in the other half would speak for itself
        texts[lang][i % 2].append([p for s in sentences(text) if not (MAYBE_CODE.search(s) and CODE.search(s)) and len(p := letters(s)) >= 12])
    for last in (False, False, False, True):
        halves = [Languages({n: _content([s for t in texts[n][h] for s in t], dictionary) for n in LANGUAGES}) for h in (0, 1)]
        if last:  # what is left of other languages: segments of mixed texts
            texts = {n: [[[s for s in t if halves[1 - h].decide(s)[0] in (n, None)] for t in texts[n][h]] for h in (0, 1)] for n in LANGUAGES}
        else:
            texts = {n: [[t for t in texts[n][h] if halves[1 - h].decide(" ".join(t))[2] in (n, None)] for h in (0, 1)] for n in LANGUAGES}
    found = {n: Counter(s for h in (0, 1) for t in texts[n][h] for s in t) for n in LANGUAGES}
    owner = {s: max(LANGUAGES, key=lambda n: found[n][s]) for n in LANGUAGES for s in found[n]}
    return Languages({n: _content([s for s in found[n] if owner[s] == n], dictionary) for n in LANGUAGES})


def _content(parts: list[str], size: int) -> bytes:
    """Whole sentences, each once, up to ``size`` bytes."""
    out, length = [], 0
    for p in dict.fromkeys(parts):
        if length + len(p) + 1 > size:
            break
        out.append(p)
        length += len(p) + 1
    return (" " + " ".join(out) + " ").encode()


def document_languages(docs: DataFrame, model: Languages | None = None, min_words: int = MIN_WORDS) -> DataFrame:
    """(ext_id, segment_no, lang, confidence, words, segments, label): every document's segments, numbered from 1 in
    text order; ``label`` is the language its own label names (null if missing, ``other`` if none of the four).

    A null text, or one without words, has one segment of ``unknown``. Of several deliveries of an ``ext_id`` the last
    loaded counts; rows with a null ``ext_id`` are left out. ``docs`` needs ext_id, text, language, loaded_at.
    """
    model = model or fit(docs)
    schema = "ext_id long, loaded_at long, label string, found array<struct<lang:string,words:int,confidence:double>>"
    fields = pa.schema([("ext_id", pa.int64()), ("loaded_at", pa.int64()), ("label", pa.string()), ("found", pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int32()), ("confidence", pa.float64())])))])
    source = model.source

    def work(given: dict[str, list], model: Languages) -> dict[str, list]:
        found = [[{"lang": a, "words": b, "confidence": c} for a, b, c in model.segments(t or "", min_words)] for t in given.pop("text")]
        return given | {"found": found}

    rows = docs.select(F.col("ext_id").cast("long").alias("ext_id"), F.unix_micros("loaded_at").alias("loaded_at"), label_language(F.col("language")).alias("label"), "text").where("ext_id is not null")
    each = arrow_map(rows, work, schema, fields, lambda: Languages(source))
    last = each.groupBy("ext_id").agg(F.max_by(F.struct("label", "found"), F.struct("loaded_at", "label")).alias("d"))
    return last.select("ext_id", F.col("d.label").alias("label"), F.size("d.found").alias("segments"), F.posexplode("d.found").alias("no", "s")).select("ext_id", (F.col("no") + 1).alias("segment_no"), "s.lang", "s.confidence", "s.words", "segments", "label")


def mislabelled(docs: DataFrame, **options) -> DataFrame:
    """The segments of documents in several languages, and of documents in one language (or ``unknown``) whose own label
    is missing or names another."""
    return document_languages(docs, **options).where((F.col("segments") > 1) | F.col("label").isNull() | (F.col("label") != F.col("lang")))
