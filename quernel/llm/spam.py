"""Problem 9: pages of repeated keywords, links, tags or stock lists in place of sentences.

Each text is cut into units (lines and sentences); up to ``spare`` units that read like sentences are set aside. The rest
is a sequence of words and symbols (a link or tag, a label before a colon, a number, the end of a unit). Decided is by

* *recurrence gaps* of its words: share of content words whose last occurrence lies at most ``WINDOW`` words back, and
  *lag*, the largest share that recur after exactly the same distance;
* *cover*: share of the sequence that lies in gaps of at most ``LINK_GAP`` between one link and the next;
* *regular*: positional autocorrelation, the largest share of places that hold the same word or symbol as the place k
  before, over lags k up to ``WINDOW``, beyond what the frequencies of the words give by chance;
* *density*: share of the words taken by the most frequent pair of neighbouring content words, and *top* by the most
  frequent content word;
* *function words* and sentence ends: lists of nouns, however distinct, have none.

A refrain or a formula repeats too, but between sentences with function words, and code is left out as no list of
nouns. Everything is computed within one document, so the operator is one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import CODE, MAYBE_CODE, WORD, Cache, arrow_map, fold

# Frequent function words of the four languages, without accents.
FUNCTION_WORDS = frozenset(
    """
    ve bir ile icin bu su o da de ki mi ama fakat ancak veya ya hem ne en cok daha gibi kadar gore sonra once olarak olan
    oldu olur icinde uzerinde arasinda ardindan her kendi ise diye var yok degil
    kimse
    the a an of and or in on at to for with without from by as is are was were be been it its this that these those if
    when while since because before after not no nobody but into than then he she they his her their you your we our
    which who whose there
    der die das den dem des ein eine einer eines einem einen und oder im am an auf bei mit von vom zu zum zur nach aus
    fur als ist war wurde wurden wird gilt liegt sich nicht kein aber doch wie wenn dass da weil um bis er sie es ihr
    le la les un une du et ou au aux dans par pour sur avec sans est sont etait ont il elle ils elles ce
    cette ces qui que se ne pas plus mais comme parce depuis entre jusqu
    """.split()
)

LINK = re.compile(r"(?:https?://|www\.)\S+|#\w+", re.IGNORECASE)
UNIT = re.compile(r"\n+|(?<=[.!?…])[\"'”“’»)\]]*\s+")
SYMBOL = re.compile(r"(?:https?://|www\.)\S+|#\w+|[^\W_]+:?", re.IGNORECASE)

WINDOW, LINK_GAP = 48, 16


def symbols(units: list[tuple], words: Cache) -> list[str]:
    """Folded words of the units' texts, with symbols for links and tags, labels, numbers and ends of units."""
    out = []
    for u in units:
        for w in SYMBOL.findall(u[4]):
            if w[0] == "#" or w[:4].lower() in ("http", "www."):
                out.append("<link>")
            elif w[-1] == ":":
                out.append("<number>" if w[:-1].isdigit() else "<label>")
            else:
                out.append("<number>" if w.isdigit() else words[w])
        out.append("<end>")
    return out


def autocorrelation(sequence: list[str], window: int = WINDOW) -> float:
    """Largest share of places equal to the place k before, for k up to ``window``, beyond chance (0) and up to 1."""
    n = len(sequence)
    if n < 8:
        return 0.0
    number = {w: i for i, w in enumerate(dict.fromkeys(sequence))}
    at = np.array([number[w] for w in sequence])
    chance = float(((np.bincount(at) / n) ** 2).sum())
    most = max(float((at[k:] == at[:-k]).mean()) for k in range(1, min(window, n // 2) + 1))
    return max(0.0, (most - chance) / (1 - chance)) if chance < 1 else 1.0


class Page:
    """Measures of one text. ``words`` caches folded words."""

    def __init__(self, text: str, words: Cache, spare: int = 2):
        linked_text = "#" in text or "www." in text or "http" in text
        units = []
        for u in UNIT.split(text):
            u = u.strip()
            if not u or MAYBE_CODE.search(u) and CODE.search(u):
                continue
            links = len(LINK.findall(u)) if linked_text else 0
            letters = [f for w in WORD.findall(LINK.sub(" ", u) if links else u) if not (f := words[w]).isdigit()]
            function = len([1 for w in letters if w in FUNCTION_WORDS])
            units.append((letters, function, links, u[-1] in ".!?…”“\"»" and not links, u))
        prose = sorted((i for i, u in enumerate(units) if u[3] and u[1] and len(u[0]) <= 60), key=lambda i: (-units[i][1], i))[:spare]
        kept = [u for i, u in enumerate(units) if i not in prose]
        self.kept = kept
        self.words = [w for u in kept for w in u[0]]
        n = self.n = max(1, len(self.words))
        self.units = len(kept)
        self.links = sum(u[2] for u in kept)
        self.function = sum(u[1] for u in kept) / n
        # words in what ends like a sentence; a long run without function words isn't one
        self.ended = sum(len(u[0]) for u in kept if u[3] and (len(u[0]) <= 30 or u[1] >= 0.04 * len(u[0]))) / n
        count = Counter(w for w in self.words if len(w) > 2 and w not in FUNCTION_WORDS)
        self.top = max(count.values(), default=0) / n
        self.recurrence = self.lag = self.density = self.cover = self.labels = self.regular = 0.0
        self.length = 0
        self.folded = words

    def regularity(self) -> None:
        """The costlier measures."""
        content = [w if len(w) > 2 and w not in FUNCTION_WORDS else "" for w in self.words]
        last: dict[str, int] = {}
        gaps: Counter = Counter()
        used = 0
        for i, w in enumerate(content):
            if w:
                used += 1
                if w in last:
                    gaps[i - last[w]] += 1
                last[w] = i
        used = max(1, used)
        self.recurrence = sum(k for g, k in gaps.items() if g <= WINDOW) / used
        self.lag = max((k for g, k in gaps.items() if g <= WINDOW), default=0) / used
        pairs = Counter((a, b) for a, b in zip(content, content[1:], strict=False) if a and b)
        self.density = 2 * max(pairs.values(), default=0) / self.n
        sequence = symbols(self.kept, self.folded)
        self.length = len(sequence)
        self.labels = sequence.count("<label>") / max(1, len(sequence))
        self.regular = autocorrelation(sequence)
        places = [i for i, w in enumerate(sequence) if w == "<link>"]
        near = [b - a for a, b in zip(places, places[1:], strict=False) if b - a <= LINK_GAP]
        self.cover = sum(near) / max(1, len(sequence)) if len(near) >= 3 else 0.0

    def kind(self) -> str | None:
        """What kind of spam the page is, null if none."""
        if self.n < 20 and self.links < 4 or self.function >= 0.1 and self.top < 0.08:
            return None
        self.regularity()
        listed = self.function < 0.1 and self.ended < 0.5
        # few words beside the links say nothing about sentences: their share is that of the whole sequence
        if self.function < 0.1 and self.cover >= 0.65 and self.ended * self.n < 0.5 * self.length:
            return "links"
        if self.n < 20:
            return None
        if listed and self.regular >= 0.2 and self.labels >= 0.05:
            return "stock"
        if listed and self.regular >= 0.3 or self.recurrence >= 0.55 and (self.function < 0.1 and (self.top >= 0.05 or self.lag >= 0.1) or self.density >= 0.15 and self.top >= 0.08):
            return "repeated"
        if self.function < 0.1 and self.ended < 0.2:  # prose may lack full stops in part
            return "list"
        return None


MEASURES = ("units", "links", "cover", "labels", "regular", "function", "ended", "recurrence", "lag", "density", "top")


def keyword_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spare: int = 2) -> DataFrame:
    """(doc_id, kind, words, ...): spam pages with their kind (links, stock, repeated, list) and measures, which are
    those of the text without the sentences set aside.

    Null texts and texts without words or links are no case. Several rows with one id are looked at together: the id is
    reported once. Columns other than the two named are not read.
    """
    schema = f"{id_col} long, kind string, words int, " + ", ".join(f"{m} double" for m in MEASURES)
    fields = pa.schema([(id_col, pa.int64()), ("kind", pa.string()), ("words", pa.int32()), *[(m, pa.float64()) for m in MEASURES]])

    def measure(given: dict[str, list], words: Cache) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in fields.names}
        for i, t in zip(given[id_col], given[text_col], strict=True):
            if not t or i is None:
                continue
            page = Page(t, words, spare)
            kind = page.kind()
            if kind:
                for n, v in zip(fields.names, (i, kind, len(page.words), *[float(getattr(page, m)) for m in MEASURES]), strict=True):
                    out[n].append(v)
        return out

    return arrow_map(docs.select(F.col(id_col).cast("long").alias(id_col), text_col), measure, schema, fields, lambda: Cache(fold)).dropDuplicates([id_col])
