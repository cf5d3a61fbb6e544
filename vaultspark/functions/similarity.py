"""Sequence similarity: an exact ratio as a pandas UDF, and native bounds that keep most pairs away from it.

The ratio is the Ratcliff/Obershelp one of the standard library, junk heuristic included. It depends on the order of its
arguments, so pairs are never sorted before it is taken.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    out, matcher, last = [], difflib.SequenceMatcher(None), None
    for x, y in zip(a, b, strict=True):
        if x is None or y is None:
            out.append(None)
            continue
        if y != last:  # the second text is the one that is indexed
            matcher.set_seq2(y)
            last = y
        matcher.set_seq1(x)
        out.append(matcher.ratio())
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.DoubleType())
def window_ratio(title: pd.Series, text: pd.Series) -> pd.Series:
    """Best ratio of a title with a window of its length and ten more, moved by half its length; stops at 0.9."""
    out = []
    for t, b in zip(title, text, strict=True):
        best, n = 0.0, len(t or "")
        for i in range(0, max(1, len(b or "") - n + 1), max(1, n // 2)):
            best = max(best, difflib.SequenceMatcher(None, t or "", (b or "")[i : i + n + 10]).ratio())
            if best >= 0.9:
                break
        out.append(best)
    return pd.Series(out, dtype="float64")


def window_match(title: Column, text: Column, least: float, gate: float) -> Column:
    """Whether window_ratio(title, text) is `least` at least and, as the gate, the ratio of common characters `gate` at least.

    A ratio's matching blocks are a common subsequence; where the longest is too short, nothing else is tried.
    """

    @F.pandas_udf(T.BooleanType())
    def run(title: pd.Series, text: pd.Series) -> pd.Series:
        out, last, masks = [], None, {}
        for t, b in zip(title, text, strict=True):
            if b != last:
                last, masks = b, {}
                for k, c in enumerate(b):
                    masks[c] = masks.get(c, 0) | 1 << k
            n = len(t)

            def common(lo: int, hi: int, t=t, masks=masks) -> int:
                v = full = (1 << hi - lo) - 1
                for c in t:
                    u = v & (masks.get(c, 0) >> lo)
                    v = ((v + u) | (v - u)) & full
                return hi - lo - v.bit_count()

            ok = 2.0 * common(0, len(b)) / (n + min(n, len(b))) >= least
            out.append(ok and any(
                2.0 * common(i, min(len(b), i + n + 10)) / (n + min(len(b) - i, n + 10)) >= least and difflib.SequenceMatcher(None, t, b[i : i + n + 10]).ratio() >= least
                for i in range(0, max(1, len(b) - n + 1), max(1, n // 2))
            ) and difflib.SequenceMatcher(None, t, b).quick_ratio() >= gate)
        return pd.Series(out, dtype="bool")

    return run(title, text)


def bag(c: Column) -> Column:
    """How often each character occurs: entries (character, count), by character."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    return F.transform(F.array_sort(F.array_distinct(chars)), lambda x: F.struct(x.alias("c"), F.size(F.filter(chars, lambda y: y == x)).alias("n")))


def bag_bound(a: Column, b: Column, bag_a: Column, bag_b: Column) -> Column:
    """2 * common characters / both lengths: never below the ratio, whatever the order of characters."""
    common = F.aggregate(
        bag_a,
        F.lit(0),
        lambda acc, x: acc + F.coalesce(F.aggregate(F.filter(bag_b, lambda y: y["c"] == x["c"]), F.lit(0), lambda s, y: s + F.least(x["n"], y["n"])), F.lit(0)),
    )
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * common / total)


def length_bound(la: Column, lb: Column, threshold: float) -> Column:
    """Whether lengths allow a ratio of the threshold."""
    return F.least(la, lb) >= threshold / (2 - threshold) * F.greatest(la, lb)
