"""String similarities that Spark lacks, as Arrow functions over pairs; equal strings are answered in the JVM."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row at a time in the bits of an integer."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel(a: str, b: str) -> float:
    """2 LCS / (|a| + |b|); two empty strings are equal."""
    return 2 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_sort(a: str, b: str) -> float:
    return indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """The best of: common words against each side, and the sides with the common words first. 0 without words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 1.0
    one, other = f"{both} {left}".strip(), f"{both} {right}".strip()
    return max([indel(one, other), *([indel(both, one), indel(both, other)] if both else [])])


def partial(a: str, b: str) -> float:
    """The best match of the shorter string with a window of the longer, windows over the ends included."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 1.0 if not b else 0.0
    n = len(a)
    return max(indel(a, b[max(0, i) : i + n]) for i in range(1 - n, len(b)))


def jaro_winkler(a: str, b: str) -> float:
    """Jaro with a bonus for up to four equal first characters, given above 0.7. Empty strings score 0."""
    if a == b:
        return 1.0 if a else 0.0
    n, m = len(a), len(b)
    reach = max(max(n, m) // 2 - 1, 0)
    taken, found = [False] * m, []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(m, i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                found.append(c)
                break
    if not found:
        return 0.0
    k = len(found)
    turned = sum(x != y for x, y in zip(found, (b[j] for j in range(m) if taken[j]), strict=True)) // 2
    jaro = (k / n + k / m + (k - turned) / k) / 3
    if jaro <= 0.7:
        return jaro
    head = 0
    while head < min(4, n, m) and a[head] == b[head]:
        head += 1
    return jaro + head * 0.1 * (1 - jaro)


def _arrow(f):
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}
        out = []
        for x, y in zip(a, b, strict=True):
            if x is None or y is None:
                out.append(None)
                continue
            if (x, y) not in known:
                known[x, y] = f(x, y)
            out.append(known[x, y])
        return pd.Series(out, dtype="float64")

    return run


_INDEL, _SORT, _SET, _PARTIAL, _JARO = (_arrow(f) for f in (indel, token_sort, token_set, partial, jaro_winkler))


def _kernel(f, a: Column, b: Column, equal: float = 1.0) -> Column:
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    same = a == b
    return F.when(same & (a != ""), F.lit(equal)).otherwise(f(F.when(~same | (a == ""), a), F.when(~same | (a == ""), b)))


def ratio(a: Column, b: Column) -> Column:
    return _kernel(_INDEL, a, b)


def token_sort_ratio(a: Column, b: Column) -> Column:
    return _kernel(_SORT, a, b)


def token_set_ratio(a: Column, b: Column) -> Column:
    return _kernel(_SET, a, b)


def partial_ratio(a: Column, b: Column) -> Column:
    return _kernel(_PARTIAL, a, b)


def jaro_winkler_ratio(a: Column, b: Column) -> Column:
    return _kernel(_JARO, a, b)


def token_similarity(a: Column, b: Column) -> Column:
    """1 for equal words, 0 beside a number, 0.9 for an abbreviation of two letters or more, else Jaro-Winkler."""
    from .tokens import is_abbreviation

    number = a.rlike(r"(?U)^\d+$") | b.rlike(r"(?U)^\d+$")
    short = ((F.length(a) >= 2) & is_abbreviation(a, b)) | ((F.length(b) >= 2) & is_abbreviation(b, a))
    return F.when(a == b, F.lit(1.0)).when(number, F.lit(0.0)).when(short, F.lit(0.9)).otherwise(jaro_winkler_ratio(a, b))
