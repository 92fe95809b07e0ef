"""Functions on token sequences."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, IntegerType

from .text import let


def repetition_ratio(ids: Column) -> Column:
    """Share of the most frequent element; 1 for an empty sequence."""
    top = let(ids, lambda a: F.array_max(F.transform(F.array_distinct(a), lambda x: F.size(F.filter(a, lambda y: y == x)))))
    return F.when(F.size(ids) == 0, 1.0).otherwise(top / F.size(ids))


def repeated_ngram(ids: Column, low: int = 2, high: int = 4) -> Column:
    """Whether some run of ``low`` to ``high`` elements repeats at once."""

    def at_once(a: Column, n: int) -> Column:
        spots = F.sequence(F.lit(1), F.greatest(F.size(a) - 2 * n + 1, F.lit(1)))
        return (F.size(a) >= 2 * n) & F.exists(spots, lambda i: F.slice(a, i, n) == F.slice(a, i + n, n))

    def any_of(a: Column) -> Column:
        hit = F.lit(False)
        for n in range(low, high + 1):
            hit = hit | at_once(a, n)
        return hit

    return let(ids, any_of)


def longest_run(ids: Column) -> Column:
    """Length of the longest run of equal elements, 0 for an empty sequence."""
    start = F.struct(F.lit(None).cast("int").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(s["last"].eqNullSafe(x), s["run"] + 1).otherwise(1)
        return F.struct(x.cast("int").alias("last"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(ids, start, step, lambda s: s["best"])


def common_prefix(a: Column, b: Column) -> Column:
    """Number of equal elements at the start."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    at = F.array_position(same, False)
    return F.when(at == 0, F.size(same)).otherwise(at - 1).cast("int")


def prompt_overlap(prompt: Column, output: Column, most: int = 12) -> Column:
    """The largest n up to ``most`` for which some run of n elements of ``prompt`` stands in ``output``, else 0."""

    def runs(a: Column, n: int) -> Column:
        return F.when(F.size(a) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(a) - n + 1, F.lit(1))), lambda i: F.slice(a, i, n)))

    return F.coalesce(*[F.when(F.arrays_overlap(runs(prompt, n), runs(output, n)), F.lit(n)) for n in range(most, 0, -1)], F.lit(0))


@F.pandas_udf(IntegerType())
def longest_common_span(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common contiguous run."""

    def one(x, y):
        if x is None or y is None or not len(x) or not len(y):
            return 0
        y = np.asarray(y)
        best, row = 0, np.zeros(len(y) + 1, np.int64)
        for v in x:
            row[1:] = np.where(y == v, row[:-1] + 1, 0)
            best = max(best, int(row.max()))
        return best

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


@F.pandas_udf(DoubleType())
def match_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two texts."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b, strict=True)])


@F.pandas_udf(BinaryType())
def pack_uint16(ids: pd.Series) -> pd.Series:
    """Little-endian 16-bit words; an id out of range is an error."""

    def one(x):
        if x is None:
            return None
        v = np.asarray(x, np.int64)
        if len(v) and (v.min() < 0 or v.max() > 65_535):
            raise ValueError("token id out of range")
        return v.astype("<u2").tobytes()

    return ids.map(one)


@F.pandas_udf(ArrayType(IntegerType()))
def unpack_uint16(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else np.frombuffer(b, "<u2").astype("int32").tolist())


@F.pandas_udf(BooleanType())
def parses_as_python(code: pd.Series) -> pd.Series:
    """Whether a text is valid Python; it is parsed, never run."""
    import ast

    def one(t):
        if t is None:
            return None
        try:
            ast.parse(t)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False
        return True

    return code.map(one)


def balanced(c: Column) -> Column:
    """Whether brackets of a text close in order."""
    only = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^()\[\]{}]+", "")
    start = F.struct(F.lit("").alias("stack"), F.lit(True).alias("ok"))

    def step(s: Column, x: Column) -> Column:
        opens = x.isin("(", "[", "{")
        want = F.when(x == ")", "(").when(x == "]", "[").otherwise("{")
        top = F.substring(s["stack"], -1, 1)
        return F.struct(
            F.when(opens, F.concat(s["stack"], x)).otherwise(F.substring(s["stack"], F.lit(1), F.greatest(F.length(s["stack"]) - 1, F.lit(0)))).alias("stack"),
            (s["ok"] & (opens | (top == want))).alias("ok"),
        )

    return F.aggregate(F.filter(F.split(only, ""), lambda x: x != ""), start, step, lambda s: s["ok"] & (s["stack"] == ""))
