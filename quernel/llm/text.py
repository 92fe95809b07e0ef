"""Text helpers shared by the operators of this subpackage (they run inside Arrow-batched Python workers)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

#: A word is a longest run of letters and digits.
WORD = re.compile(r"[^\W_]+")

#: Sentence end: closing punctuation (with a closing quote or bracket), then white space; or a line end.
SENTENCE_END = re.compile(r"(?<=[.!?…])[\"'”“’»)\]]*\s+|\n+")

#: A line of program code; MAYBE_CODE is a cheap necessary condition for most of them.
CODE = re.compile(r"^\s*(?:def |for |while |if |else\b|elif |return |yield |with |import |from \w+ import|print\(|class |@\w|[\w.]+ ?[-+*/]?= ?\S|[{}();]+\s*$)|\w\(.*\):?\s*$")
MAYBE_CODE = re.compile(r"[=(@:{}]|^\s*(?:return|yield|import|else|try|pass|break|continue)\b")

_MARKS = {c: None for c in range(0x300, 0x370)}

# Letters that Unicode decomposition doesn't reduce to a base letter.
_BASE = str.maketrans({"ı": "i", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l"})


def fold(text: str) -> str:
    """Lower case without accents."""
    text = text.lower()
    if text.isascii():
        return text
    return unicodedata.normalize("NFD", text).translate(_MARKS).translate(_BASE)


def words_of(text: str) -> list[str]:
    """Words of the NFC form, as written. Case is folded per word (``lower_hash``, ``fold_hash``), as lower-casing a
    whole text may break words (dotted capital I)."""
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return WORD.findall(text)


class Cache(dict):
    """A dict that computes what is missing, emptied when it exceeds ``limit`` entries."""

    def __init__(self, make: Callable, limit: int = 500_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


def lower_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.lower())


def fold_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(fold(word))


#: Odd multipliers for sequences of words, from a fixed seed.
_STEPS = (np.random.default_rng(20_240_501).integers(1, 2**63, 64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def shingle_hashes(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of each run of ``size`` consecutive word hashes."""
    n = len(word_hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = word_hashes[:n] * _STEPS[0]
    for j in range(1, size):
        total = total + word_hashes[j : j + n] * _STEPS[j]
    return mix(total)


def arrow_map(df: DataFrame, batch: Callable[[dict[str, list]], dict[str, list]], schema: str, fields: pa.Schema, setup: Callable | None = None) -> DataFrame:
    """``mapInArrow`` over Python lists: ``batch`` gets the columns of a record batch and returns the columns of
    the result. ``setup`` runs once per task and its result is handed to ``batch`` as second argument."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for b in batches:
            if not b.num_rows:
                continue
            given = {name: b.column(i).to_pylist() for i, name in enumerate(b.schema.names)}
            out = batch(given, state) if setup else batch(given)
            yield pa.RecordBatch.from_pydict(out, schema=fields)

    return df.mapInArrow(run, schema)
