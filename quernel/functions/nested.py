"""JSON values of any shape, and runs of byte tokens."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Keys under which prompts stand.
PROMPT_KEYS = ("prompt", "text", "content", "instruction", "input")


def _tidy(text: str) -> str:
    kept = "".join(c for c in text.replace("\r\n", "\n").replace("\r", "\n") if c in "\n\t" or unicodedata.category(c) != "Cc")
    return unicodedata.normalize("NFC", kept)


def _walk(value, change):
    if isinstance(value, str):
        return change(value)
    if isinstance(value, list):
        return [_walk(v, change) for v in value]
    if isinstance(value, dict):
        return {k: _walk(v, change) for k, v in value.items()}
    return value


@F.pandas_udf(StringType())
def normalized_json(s: pd.Series) -> pd.Series:
    """A JSON text with every string in it normalised (line ends, control characters, NFC) and sorted keys; null where
    it is no JSON."""

    def one(t):
        if t is None:
            return None
        try:
            return json.dumps(_walk(json.loads(t), _tidy), ensure_ascii=False, sort_keys=True)
        except ValueError:
            return None

    return s.map(one)


def strings_under(c: Column, keys: tuple[str, ...] = PROMPT_KEYS) -> Column:
    """All strings that stand under one of ``keys`` anywhere in a JSON text, in order."""

    @F.pandas_udf(ArrayType(StringType()))
    def harvest(s: pd.Series) -> pd.Series:
        def under(value, out, taken):
            if isinstance(value, str):
                if taken:
                    out.append(value)
            elif isinstance(value, list):
                for v in value:
                    under(v, out, taken)
            elif isinstance(value, dict):
                for k, v in value.items():
                    under(v, out, k in keys)

        def one(t):
            if t is None:
                return None
            out: list[str] = []
            try:
                under(json.loads(t), out, False)
            except ValueError:
                return None
            return out

        return s.map(one)

    return harvest(c)


def byte_runs(tokens: DataFrame, keys: list[str], pos: str = "pos", piece: str = "piece") -> DataFrame:
    """(keys, start, length, text): unbroken runs of byte pieces (``<0x41>``) of each sequence, and the text that their
    bytes spell, null where they are no UTF-8."""
    order = Window.partitionBy(*keys).orderBy(pos)
    byte = tokens.where(F.col(piece).rlike("^<0x[0-9A-Fa-f]{2}>$")).withColumn("_i", F.col(pos) - F.row_number().over(order))
    runs = byte.groupBy(*keys, "_i").agg(F.min(pos).alias("start"), F.count("*").alias("length"), F.array_sort(F.collect_list(F.struct(pos, F.substring(piece, 4, 2).alias("b")))).alias("p"))  # one run
    data = F.unhex(F.array_join(F.transform("p", lambda x: x["b"]), ""))
    return runs.select(*keys, "start", "length", F.when(F.is_valid_utf8(data.cast("string")), data.cast("string")).alias("text"))
