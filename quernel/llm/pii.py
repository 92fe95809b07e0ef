"""Problem 6: personal data in free text, with place and type, and the text with typed placeholders in its stead.

Information-theoretic sanitisation. What has a form of its own (addresses of mail, most telephone and identity numbers,
postal addresses) is found by its form. The rest, names and numbers that could be anything, is judged by how strongly
its terms reveal protected entities in this corpus: over all documents it is counted how often a term stands near an
entity found by form and how often it occurs at all. The disclosure of a term is the pointwise mutual information of
the two, in bits; terms over a threshold disclose:

* the first word of a capitalised pair that stands near entities far more often than capitalised words do, with many
  different second words, is a given name, so the pair is a person's name;
* a plain number is an identity number if the words around it are those around identity numbers of unmistakable form.

Spans found are replaced by placeholders naming their type; the town after a street is generalised away with it.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .spam import FUNCTION_WORDS
from .text import arrow_map, fold

_UP = "A-ZÇĞİÖŞÜÂÎÛÄÀÁÉÈÊËÏÔÙŒÑ"
_CAP = rf"[{_UP}][\w’'-]*\w"

# Domains that are placeholders, and how mail addresses are disguised.
PLACEHOLDER_DOMAINS = ("example.com", "example.org", "example.net")
_AT = r"(?:[ \t]*[@＠][ \t]*|[ \t]*[\[({<]\s*(?:at|AT|ät|et|kuyruklua)\s*[\])}>][ \t]*|[ \t]+AT[ \t]+)"
_DOT = r"(?:[ \t]*\.[ \t]*(?=[\w])|[ \t]*[\[({<]\s*(?:dot|DOT|nokta|NOKTA|punkt|point)\s*[\])}>][ \t]*|[ \t]+(?:DOT|NOKTA)[ \t]+)"
EMAIL = re.compile(rf"(?<![\w.+-])[\w][\w.+-]*{_AT}[\w-]+(?:{_DOT}[\w-]+)*?{_DOT}[A-Za-z]{{2,24}}(?![\w-])")
_TIGHT = re.compile(r"(?<![\w.+-])[\w][\w.+-]*[@＠][\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,24}(?![\w-])")
_MAYBE_EMAIL = re.compile(r"[@＠]|[\[({<]\s*(?:at|AT|ät|et|kuyruklua)\s*[\])}>]|\sAT\s")

NUMBER = re.compile(r"(?<![\w.,/@#&=-])(?:\+ ?)?(?:\d{1,4} ?)?(?:\(\d{1,5}\) ?)?\d+(?:[ ./-]\d+){0,7}(?![\w@])")
# Forms of identity numbers (grouped eleven digits, social security and insurance numbers, cards).
ID_FORMS = re.compile(r"\b(?:\d{3} \d{3} \d{3} \d{2}|\d{5}-\d{6}|\d{3}-\d{2}-\d{4}|[A-Z]\d{8}|[A-Z]{2}\d{7}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D])(?![\w-])")
_PLAIN = re.compile(r"\d{11}")
# Words before numbers of orders, books, builds, hosts; and before identity numbers.
OTHER_NUMBERS = frozenset("siparis order bestellnummer bestellung commande isbn issn build derleme surum version sayac counter zahler compteur host sunucu server fatura invoice rechnung seri serial sku stok ticket port".split())
ID_CUES = frozenset("kimlik tc t.c identity id ausweisnummer ausweis personalausweis passport pasaport ssn nino identite".split())

# Words that make a street, quarter or building; of institutions and buildings.
_TR = re.compile(r"[ \t](Mahallesi|Mah\.|Mh\.|Caddesi|Cad\.|Cd\.|Soka[ğg][ıi]|Sokak|Sok\.|Sk\.|Bulvar[ıi]|Blv\.)")
_TR_REST = re.compile(rf"(?:[ ,]+(?:{_CAP}|\d+\.)[ ](?:Mahallesi|Mah\.|Mh\.|Caddesi|Cad\.|Cd\.|Soka[ğg][ıi]|Sokak|Sok\.|Sk\.|Bulvar[ıi]|Blv\.|Apartman[ıi]|Apt\.?|Sitesi))*(?:[ ,]*(?:(?:No|NO|no|Numara|Kat|Daire|D|K)[ ]?[:.]?[ ]?\d+\w?(?:/\d+\w?)?|\d+(?:/\d+)?\w?(?![\w.]|[ ]?[:%])))+")
_EN = re.compile(rf"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Room) \d+\w?,? )?(?<![\w.,-])\d{{1,5}}[A-Za-z]?,? {_CAP}(?: {_CAP})? (?:Street|St\b\.?|Road|Rd\b\.?|Lane|Ln\b\.?|Avenue|Ave\b\.?|Drive|Close|Court|Way|Place|Square|Terrace|Crescent|Boulevard|Blvd\b\.?)(?:,? (?:Flat|Apt\.?|Apartment|Unit|Suite) \d+\w?)?")
_EN_WORD = re.compile(r" (?:Street|St\b|Road|Rd\b|Lane|Ln\b|Avenue|Ave\b|Drive|Close|Court|Way|Place|Square|Terrace|Crescent|Boulevard|Blvd\b)")
_DE = re.compile(rf"(?<![\w-])[{_UP}][\w-]*(?:weg|straße|strasse|str\.|gasse|platz|allee|ring|ufer|damm)[ ]\d{{1,4}}[a-z]?(?![\w%])")
_FR = re.compile(rf"(?<![\w.,-])\d{{1,4}}(?: bis| ter)?,? (?:rue|avenue|av\.|boulevard|bd|place|chemin|impasse|allée|quai|route) (?:(?:de la|de l’|du|des|de|d’)[ ]?)?{_CAP}")
_TOWN = re.compile(rf",?[ ](?:\d{{4,5}} )?{_CAP}")
INSTITUTIONS = re.compile(rf"[ ’'-]{{1,2}}(?:Vakf[ıi]|Köprüsü|Koprusu|Okulu|Lisesi|Üniversitesi|Hastanesi|Müzesi|Kütüphanesi|Camii|Derneği|Kurumu|Merkezi|Stadı|Parkı|Meydanı|Sokağı|Caddesi|Mahallesi|Apartmanı|Enstitüsü|Foundation|Bridge|School|Library|University|Hospital|Museum|Institute|Society|Trust|Centre|Center|College|Hall|Park|Street|Road|Lane|Avenue|Square|House|Stiftung|Brücke|Schule|Bibliothek|Krankenhaus|Museum|Institut|Straße|Platz|Fondation|Pont|École)\b")

PAIR = re.compile(rf"(?=(?<![\w’'@.-])({_CAP})(,)? (?:([{_UP}]\.) )?({_CAP}))")
_START = re.compile(r"(?:^|[.!?…\n\r“„«])\s*$")

#: Sentence border between words.
_BREAK = re.compile(rf"\n|[.!?…]\s+(?=[{_UP}])")

TYPES = ("email", "phone", "id_number", "address", "person_name")
NEAR = 120
#: Disclosure, in bits, from which a term counts; occurrences and different companions it needs.
THRESHOLD, LEAST, COMPANIONS = 2.0, 3, 3
#: Few occurrences must be clear ones, however large the table is: lowered by so many standard errors, a disclosure
#: must still be so many bits.
DOUBT, SURE = 1.645, 0.0
MAX_TERMS = 2_000_000
#: Pairs counted in a task before their counts are handed on.
MAX_HELD = 300_000
MAX_RATE = 0.1


def _emails(text: str) -> list[tuple[int, int, str]]:
    out = []
    if _MAYBE_EMAIL.search(text):
        for m in EMAIL.finditer(text):
            whole = m.group()
            tight = _TIGHT.match(text, m.start())
            end = tight.end() if tight else m.end()
            plain = re.sub(_DOT, ".", re.sub(_AT, "@", tight.group() if tight else whole)).lower()
            domain = plain.rpartition("@")[2]
            if not any(domain == d or domain.endswith("." + d) for d in PLACEHOLDER_DOMAINS):
                out.append((m.start(), end, "email"))
            else:
                out.append((m.start(), end, ""))  # known to be none
    return out


def _phone(form: str, before: str, after: str) -> bool:
    digits = re.sub(r"\D", "", form)
    groups = re.findall(r"\d+", form)
    if form.startswith("+"):
        return 8 <= len(digits) <= 15 and len(form) <= 26
    if before[-2:-1].isalnum() and re.search(r"(?:^|[ :])[0-9a-f]{2} $", before) and all(len(g) == 2 for g in groups):
        return False  # a dump of bytes
    if re.match(r" [0-9a-f]{2}\b", after) and all(len(g) == 2 for g in groups):
        return False
    if digits.startswith("00"):
        return 10 <= len(digits) <= 16 and len(groups[0]) in (4, 5, len(digits)) and not form.startswith("000")
    if digits.startswith("0"):
        if len(groups) == 1:
            return bool(re.fullmatch(r"0[2-5]\d{9}", digits))
        return 9 <= len(digits) <= 12 and len(groups[0]) <= 5 and len(groups) <= 6 and "  " not in form and (len(groups[0]) > 1 or len(digits) == 11)
    shape = [len(g) for g in groups]
    return shape == [3, 3, 4] and (form[0] == "(" or re.fullmatch(r"\d{3}([ .-])\d{3}\1\d{4}", form) is not None)


def context(text: str, start: int, end: int) -> list[str]:
    """Folded words around a span in its sentence: two before, two after."""
    before = _BREAK.split(text[max(0, start - 40) : start])[-1]
    after = _BREAK.split(text[end : end + 40], maxsplit=1)[0]
    left = [fold(w) for w in re.findall(r"[^\W\d_]+(?:\.[^\W\d_]+)*", before)[-2:]]
    right = [fold(w) for w in re.findall(r"[^\W\d_]+", after)[:2]]
    return ["<" + w for w in left] + [">" + w for w in right]


class Spans:
    """Spans (start, end, type) that don't overlap, in text order."""

    def __init__(self, spans=()):
        self.spans = sorted(spans)

    def __iter__(self):
        return iter(self.spans)

    def free(self, start: int, end: int) -> bool:
        at = bisect.bisect_left(self.spans, (end,))
        return at == 0 or self.spans[at - 1][1] <= start

    def append(self, span: tuple[int, int, str]) -> None:
        bisect.insort(self.spans, span)

    def near(self, place: int, distance: int) -> bool:
        at = bisect.bisect_right(self.spans, (place + distance + 1,))
        return at > 0 and self.spans[at - 1][1] + distance >= place


def by_form(text: str) -> tuple[Spans, list[tuple[int, int]]]:
    """Spans that their form gives away, and plain numbers that could be identity numbers."""
    found = Spans(_emails(text))
    for m in ID_FORMS.finditer(text):
        before = context(text, m.start(), m.end())[:2]
        if found.free(m.start(), m.end()) and not any(w.startswith("<") and w[1:] in OTHER_NUMBERS for w in before) and not re.search(r"[\w./-]$", text[max(0, m.start() - 1) : m.start()]) and not re.match(r"[ -]\d", text[m.end() : m.end() + 2]):
            found.append((m.start(), m.end(), "id_number"))
    plain = []
    for m in NUMBER.finditer(text):
        form, (start, end) = m.group(), m.span()
        if len(form) < 9 or not found.free(start, end):
            continue
        words = context(text, start, end)
        if any(w[0] == "<" and w[1:] in OTHER_NUMBERS for w in words):
            continue
        if _PLAIN.fullmatch(form) and form[0] != "0":
            plain.append((start, end))
        elif _phone(form, text[max(0, start - 4) : start], text[end : end + 4]):
            found.append((start, end, "phone"))
    return _addresses(text, found), plain


def _addresses(text: str, found: Spans) -> Spans:
    spans = []
    until = 0
    for m in _TR.finditer(text):
        if m.start() < until:
            continue
        head = re.search(rf"(?:(?<![\w’'-]){_CAP}|(?<!\w)\d+\.)$", text[max(0, m.start() - 40) : m.start()])
        if not head:
            continue
        start = m.start() - len(head.group())
        rest = _TR_REST.match(text, m.end())
        if rest:
            spans.append((start, rest.end()))
            until = rest.end()
    if _EN_WORD.search(text):
        spans += [m.span() for m in _EN.finditer(text)]
    spans += [m.span() for m in _DE.finditer(text)]
    spans += [m.span() for m in _FR.finditer(text)]
    for start, end in spans:
        if found.free(start, end):
            found.append((start, end, "address"))
    return found


def pairs_of(text: str, found: Spans):
    """Capitalised pairs outside the spans: (match start, first, comma, second, end, at the start of a sentence)."""
    for m in PAIR.finditer(text):
        start, end = m.start(1), m.end(4)
        if found.free(start, end):
            yield start, m.group(1), bool(m.group(2)), m.group(4), end, m.start(4), bool(_START.search(text[max(0, start - 6) : start])) if start else True


class Disclosure:
    """What the corpus says about terms: given names, surnames, and words around identity numbers."""

    def __init__(self, given: frozenset[str], surnames: frozenset[str], cues: frozenset[str]):
        self.given, self.surnames, self.cues = given, surnames, cues


def items(text: str, model: Disclosure) -> list[tuple[int, int, str]]:
    """Spans (start, end, type) of personal data, in text order."""
    found, plain = by_form(text)
    for start, end in plain:
        words = context(text, start, end)
        if any(w in model.cues or w[1:] in ID_CUES for w in words):
            found.append((start, end, "id_number"))
    taken = Spans(found)
    names = []
    chain = list(pairs_of(text, found))
    firsts = {p[0]: p for p in chain}
    done = -1
    for start, a, comma, b, end, second, opening in chain:
        if start < done:
            continue
        first, last = fold(a), fold(b)
        if INSTITUTIONS.match(text, end):
            continue
        if comma:
            # surname first: the given name must not begin a pair of its own
            after = firsts.get(second)
            own = after is not None and not after[2] and after[4] > end and (fold(after[3]) in model.surnames or first not in model.surnames)
            if last in model.given and first not in model.given and not own and not (opening and first not in model.surnames and len(text[max(0, start - 3) : start].strip()) == 0):
                names.append((start, end, "person_name"))
                done = end
            continue
        known = first in model.given
        unknown = not known and last in model.surnames and last not in model.given and not opening and first not in model.surnames
        if known and INSTITUTIONS.match(" " + b + " "):
            continue
        if known or unknown:
            stop = end
            after = firsts.get(second)
            if known and last in model.given and after is not None and not after[2]:
                stop = after[4]  # two given names
            names.append((start, stop, "person_name"))
            done = stop
    for s, e, kind in names:
        if taken.free(s, e):
            found.append((s, e, kind))
    return sorted(f for f in found if f[2])


def learn(docs: DataFrame, text_col: str = "text") -> Disclosure:
    """Count, over all documents, how often terms stand near entities found by form, and keep those that disclose."""
    fields = pa.schema([("kind", pa.string()), ("term", pa.string()), ("other", pa.string()), ("n", pa.int64()), ("near", pa.int64()), ("inside", pa.int64())])

    def rows_of(counts: dict) -> pa.RecordBatch:
        keys, values = list(counts), list(counts.values())
        counts.clear()
        return pa.RecordBatch.from_pydict({name: [k[j] for k in keys] for j, name in enumerate(("kind", "term", "other"))} | {name: [v[j] for v in values] for j, name in enumerate(("n", "near", "inside"))}, schema=fields)

    def run(batches):
        counts: dict[tuple[str, str, str], list[int]] = defaultdict(lambda: [0, 0, 0])
        cap = re.compile(rf"(?<![\w’'])[{_UP}][a-zçğıöşüâîäéèê]+")
        for b in batches:
            for t in b.column(0).to_pylist():
                if not t:
                    continue
                found, plain = by_form(t)
                spots = Spans((s, e, k) for s, e, k in found if k and k != "address")
                total = counts["words", "", ""]
                total[0] += len(cap.findall(t))
                if spots.spans or plain:
                    total[1] += sum(len(cap.findall(t[max(0, s - NEAR) : e + NEAR])) for s, e, _ in spots)
                    for s, e, k in found:
                        if k == "id_number":
                            for w in context(t, s, e):
                                counts["cue", w, ""][1] += 1
                    for s, e in plain:
                        for w in context(t, s, e):
                            counts["cue", w, ""][0] += 1
                for start, a, comma, b2, end, _, opening in pairs_of(t, found):
                    close = spots.near(start, NEAR)
                    if comma:
                        continue
                    c = counts["pair", fold(a), fold(b2)]
                    c[0] += 1
                    c[1] += close
                    c[2] += not opening
            if len(counts) > MAX_HELD:
                yield rows_of(counts)
        yield rows_of(counts)

    rows = docs.select(text_col).mapInArrow(run, "kind string, term string, other string, n long, near long, inside long").groupBy("kind", "term", "other").agg(F.sum("n").alias("n"), F.sum("near").alias("near"), F.sum("inside").alias("inside"))
    rows = cut_lineage(rows)
    base = rows.where("kind = 'words'").agg(F.sum("n"), F.sum("near")).first()
    # how often any capitalised word stands near an entity; a text full of entities must not hide what they share
    rate = min(max((base[1] or 0) / max(base[0] or 0, 1), 1e-4), MAX_RATE)
    share, z2 = F.col("near") / F.col("n"), DOUBT**2
    # lower bound of the share (Wilson)
    low = (share + z2 / (2 * F.col("n")) - DOUBT * F.sqrt(share * (1 - share) / F.col("n") + z2 / (4 * F.col("n") ** 2))) / (1 + z2 / F.col("n"))
    bits, least = F.log2(share / F.lit(rate)), F.log2(low / F.lit(rate))
    pairs = rows.where("kind = 'pair'")
    terms = pairs.groupBy("term").agg(F.sum("n").alias("n"), F.sum("near").alias("near"), F.sum("inside").alias("inside"), F.count("*").alias("companions"))
    # words that mostly open sentences are no names
    likely = terms.where((F.col("n") >= LEAST) & (F.col("companions") >= COMPANIONS) & (F.col("inside") >= 0.3 * F.col("n")) & (F.col("near") > 0) & (bits >= THRESHOLD) & (least >= SURE))
    second = pairs.join(likely.select("term"), "term", "left_semi").groupBy(F.col("other").alias("term")).agg(F.count("*").alias("firsts"), F.sum("n").alias("after"))
    # what follows several given names is a surname
    given = likely.join(second, "term", "left").where(F.coalesce("firsts", F.lit(0)) < 0.5 * F.col("companions"))
    names = _collect(given.select("term"))
    # and mostly follows them
    anywhere = pairs.groupBy(F.col("other").alias("term")).agg(F.sum("n").alias("every"))
    surnames = _collect(second.where("firsts >= 2").join(anywhere, "term").where("after >= 0.5 * every").select("term")) - names
    cue = rows.where("kind = 'cue'").groupBy("term").agg(F.sum("n").alias("plain"), F.sum("near").alias("sure"))
    sums = cue.agg(F.sum("plain"), F.sum("sure")).first()
    ratio = F.log2(((F.col("sure") + 0.5) / F.lit((sums[1] or 0) + 1.0)) / ((F.col("plain") + 0.5) / F.lit((sums[0] or 0) + 1.0)))
    lowest = ratio - DOUBT / math.log(2) * F.sqrt(1 / (F.col("sure") + 0.5) + 1 / (F.col("plain") + 0.5))
    cues = _collect(cue.where(~F.substring("term", 2, 100).isin(*FUNCTION_WORDS)).where((F.col("sure") >= LEAST) & (lowest >= -THRESHOLD) & ~F.substring("term", 2, 100).isin(*OTHER_NUMBERS, "no", "nummer", "number", "numero", "dun")).select("term"))
    return Disclosure(names, surnames, frozenset(c for c in cues if c[1:] not in names))


def _collect(terms: DataFrame) -> frozenset[str]:
    """Terms over the threshold; their number grows with vocabulary, not with documents, and is checked."""
    rows = terms.limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms")
    return frozenset(r.term for r in rows)


def personal_data(docs: DataFrame, model: Disclosure | None = None, id_col: str = "ext_id", text_col: str = "text") -> DataFrame:
    """(ext_id, start_char, end_char, pii_type, item): every item of personal data; positions are code points from 1.

    Null ids and texts give nothing; several deliveries of an id give each item once. Other columns are not read.
    """
    model = model or learn(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast((model.given, model.surnames, model.cues))
    fields = pa.schema([("ext_id", pa.int64()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("pii_type", pa.string()), ("item", pa.string())])

    def find(rows: dict[str, list], model: Disclosure) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in fields.names}
        for i, t in zip(rows["ext_id"], rows["text"], strict=True):
            if i is None or not t:
                continue
            for s, e, kind in items(t, model):
                for n, v in zip(fields.names, (i, s + 1, e, kind, t[s:e]), strict=True):
                    out[n].append(v)
        return out

    found = arrow_map(docs.select(F.col(id_col).cast("long").alias("ext_id"), F.col(text_col).alias("text")), find, "ext_id long, start_char int, end_char int, pii_type string, item string", fields, lambda: Disclosure(*shared.value))
    return found.dropDuplicates(["ext_id", "start_char", "pii_type"])


def redact(text: str, model: Disclosure) -> tuple[str, int]:
    """The text with placeholders, and how many."""
    out, at, n = [], 0, 0
    for s, e, kind in items(text, model):
        if s < at:
            continue
        out += [text[at:s], f"[{kind.upper()}]"]
        at, n = e, n + 1
        if kind == "address" and (m := _TOWN.match(text, e)) and not re.search(r"[.!?]\s*$", text[:e][-2:]):
            at = m.end()
    return "".join([*out, text[at:]]), n


def redacted(docs: DataFrame, model: Disclosure | None = None, id_col: str = "ext_id", text_col: str = "text") -> DataFrame:
    """(ext_id, redacted, items): every row's text with placeholders. A null text stays null; rows are not merged."""
    model = model or learn(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast((model.given, model.surnames, model.cues))
    fields = pa.schema([("ext_id", pa.int64()), ("redacted", pa.string()), ("items", pa.int32())])

    def work(rows: dict[str, list], model: Disclosure) -> dict[str, list]:
        done = [(None, 0) if t is None else redact(t, model) for t in rows["text"]]
        return {"ext_id": rows["ext_id"], "redacted": [d[0] for d in done], "items": [d[1] for d in done]}

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("ext_id"), F.col(text_col).alias("text")), work, "ext_id long, redacted string, items int", fields, lambda: Disclosure(*shared.value))
