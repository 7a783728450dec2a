"""String ratios on *pairs of names or blocked candidates* (Arrow batches, small helpers)."""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

# Workers need not have this package installed: the helpers travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, one bit per character of ``a`` (whole strings)."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - bin(row).count("1")


def indel_ratio(a: str, b: str) -> float:
    """100 minus the share of characters inserted or deleted; 100 for equal strings."""
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * lcs_length(a, b) / total


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string against any window of the longer one."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    n = len(short)
    best = 0.0
    for start in range(1 - n, len(long)):
        best = max(best, indel_ratio(short, long[max(0, start): start + n]))
    if len(a) == len(b):
        for start in range(1 - n, n):
            best = max(best, indel_ratio(long, short[max(0, start): start + n]))
    return best


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def _token_set(a: str, b: str) -> tuple[str, str, str]:
    left, right = set(a.split()), set(b.split())
    return tuple(" ".join(sorted(x)) for x in (left & right, left - right, right - left))


def token_set_ratio(a: str, b: str) -> float:
    if not a.split() or not b.split():
        return 0.0
    common, only_a, only_b = _token_set(a, b)
    if common and (not only_a or not only_b):
        return 100.0
    join = lambda x: f"{common} {x}".strip()
    best = indel_ratio(join(only_a), join(only_b))
    if common:
        best = max(best, indel_ratio(common, join(only_a)), indel_ratio(common, join(only_b)))
    return best


def partial_token_ratio(a: str, b: str) -> float:
    left, right = a.split(), b.split()
    if set(left) & set(right):
        return 100.0
    return max(
        partial_ratio(" ".join(sorted(left)), " ".join(sorted(right))),
        partial_ratio(" ".join(sorted(set(left))), " ".join(sorted(set(right)))),
    )


def weighted_ratio(a: str, b: str) -> float:
    """The usual blend: plain ratio, scaled token ratios, scaled partials when lengths differ."""
    if not a or not b:
        return 0.0
    length = max(len(a), len(b)) / min(len(a), len(b))
    best = indel_ratio(a, b)
    if length < 1.5:
        return max(best, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.9 if length <= 8.0 else 0.6
    return max(best, scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))


def lexical_similarity_of(a: str, b: str) -> float:
    return (weighted_ratio(a, b) + token_sort_ratio(a, b)) / 200.0


def _pairwise(measure: Callable[[str, str], float], left: Column, right: Column) -> Column:
    def batch(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((measure(x, y) for x, y in zip(a, b)), float, len(a)))

    batch.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(batch, "double")(left, right)


def lexical_similarity(left: Column, right: Column) -> Column:
    """Mean of the weighted and the token-sort ratio, 0 to 1 (for pairs of names)."""
    return _pairwise(lexical_similarity_of, left, right)


def indel_similarity(left: Column, right: Column) -> Column:
    """Ratio 0 to 100 (for pairs that a join has already brought together)."""
    return _pairwise(indel_ratio, left, right)
