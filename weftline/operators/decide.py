"""From probabilities to answers: one owner a record, thresholds, sets of greatest expected F0.5, value of a review."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BETA2 = 0.25
THRESHOLDS = [round(0.2 + 0.025 * k, 3) for k in range(31)]
MOST, REST = 12, 8


def exclusive(pairs: DataFrame, p: str = "p") -> DataFrame:
    """q: the posterior that i owns j, when j has one owner or none."""
    q = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    o = q / (1 - q)
    total = pairs.groupBy("j").agg(F.sum(o).alias("__total"))
    return pairs.join(total, "j").select(*pairs.columns, (o / (1 + F.col("__total"))).alias("q"))


def by_threshold(pairs: DataFrame, t: float, p: str = "p") -> DataFrame:
    """(i, ids): those at the threshold or above, most probable first."""
    key = F.struct((-F.col(p)).alias("o"), "j")
    return pairs.where(F.col(p) >= t).groupBy("i").agg(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["j"]).alias("ids"))


def _times(pmf: Column, q: Column) -> Column:
    """The distribution of a sum of independent trials, with one more of probability q."""
    zero = F.array(F.lit(0.0))
    stay, hit = F.concat(F.transform(pmf, lambda x: x * (1 - q)), zero), F.concat(zero, F.transform(pmf, lambda x: x * q))
    return F.zip_with(stay, hit, lambda a, b: a + b)


def _pmf(p: Column) -> Column:
    return F.aggregate(p, F.array(F.lit(1.0)), _times)


def expected_f_curve(p: Column, most: int = MOST) -> Column:
    """Expected F0.5 of emitting the first k of probabilities in descending order, for k = 0, 1, ...

    X counts hits among the first k and Y those left out; F = 1.25 x / (k + 0.25 (x + y)). k = 0 is right if there
    is nothing to find.
    """
    nothing = F.aggregate(p, F.lit(1.0), lambda a, x: a * (1 - x))

    def value(k: Column) -> Column:
        x, y = _pmf(F.slice(p, F.lit(1), k)), _pmf(F.slice(p, k + 1, F.greatest(F.size(p) - k, F.lit(0))))
        rows = F.transform(x, lambda a, i: a * F.aggregate(F.transform(y, lambda b, j: b * (1 + BETA2) * i / (k + BETA2 * (i + j))), F.lit(0.0), lambda s, v: s + v))
        return F.aggregate(rows, F.lit(0.0), lambda s, v: s + v)

    n = F.least(F.size(p), F.lit(most))
    return F.when(F.size(p) == 0, F.array(F.lit(1.0))).otherwise(F.concat(F.array(nothing), F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), value)))


def candidate_lists(pairs: DataFrame, p: str = "p", most: int | None = MOST) -> DataFrame:
    """(i, ids, ps): the candidates of each i, most probable first: as many as a decision looks at, or all."""
    clipped = F.least(F.greatest(F.col(p), F.lit(1e-9)), F.lit(1 - 1e-9))
    key = F.struct((-clipped).alias("o"), "j")
    if most is not None:
        rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc(p), "j"))
        pairs = pairs.withColumn("__k", rank).where(F.col("__k") <= most + REST)
    lists = pairs.groupBy("i").agg(F.array_sort(F.collect_list(key)).alias("c"))
    return lists.select("i", F.transform("c", lambda x: x["j"]).alias("ids"), F.transform("c", lambda x: -x["o"]).alias("ps"))


def choose_sets(pairs: DataFrame, p: str = "p", most: int = MOST) -> DataFrame:
    """(i, k, expected, ids): the prefix of greatest expected F0.5; the shortest of equals."""
    got = candidate_lists(pairs, p, most).withColumn("curve", F.transform(expected_f_curve(F.col("ps"), most), lambda x: F.round(x, 12)))
    best = F.array_max("curve")
    k = (F.array_position("curve", best) - 1).cast("int")
    return got.select("i", k.alias("k"), best.alias("expected"), F.slice("ids", F.lit(1), k).alias("ids"))


def _curve(p: np.ndarray, most: int) -> np.ndarray:
    ahead, behind = [np.ones(1)], [np.ones(1)]
    for q in p:
        ahead.append(np.convolve(ahead[-1], [1 - q, q]))
    for q in p[::-1]:
        behind.append(np.convolve(behind[-1], [1 - q, q]))
    out = [behind[-1][0]]
    for k in range(1, min(len(p), most) + 1):
        x, y = ahead[k], behind[len(p) - k]
        i, j = np.arange(len(x))[:, None], np.arange(len(y))[None, :]
        out.append(float((x[:, None] * y[None, :] * (1 + BETA2) * i / (k + BETA2 * (i + j))).sum()))
    return np.array(out)


def review_value(p: np.ndarray) -> tuple[float, int]:
    """(gain, place): how much knowing one candidate's truth raises the best expected F0.5 at most, and which one's."""
    if not len(p):
        return 0.0, -1
    base, gains = _curve(p, len(p)).max(), []
    for c, q in enumerate(p):
        rest = np.delete(p, c)
        yes, no = np.concatenate([[1 - 1e-9], rest]), np.concatenate([rest, [1e-9]])
        gains.append(q * _curve(yes, len(p)).max() + (1 - q) * _curve(no, len(p)).max() - base)
    where = int(np.argmax(np.round(gains, 12)))
    return float(gains[where]), where


def _best_f(p: np.ndarray) -> np.ndarray:
    """The greatest value of ``_curve`` for each row of probabilities."""
    m, n = p.shape
    ahead, behind = [np.ones((m, 1))], [np.ones((m, 1))]
    for c in range(n):
        for pmf, q in ((ahead, p[:, c, None]), (behind, p[:, n - 1 - c, None])):
            grown = np.zeros((m, c + 2))
            grown[:, :-1] = pmf[-1] * (1 - q)
            grown[:, 1:] += pmf[-1] * q
            pmf.append(grown)
    out = behind[n][:, 0].copy()
    for k in range(1, n + 1):
        i, j = np.arange(k + 1)[:, None], np.arange(n - k + 1)[None, :]
        np.maximum(out, ((ahead[k] @ ((1 + BETA2) * i / (k + BETA2 * (i + j)))) * behind[n - k]).sum(axis=1), out=out)
    return out


def review_values(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``review_value`` of many lists: those of one length at once, equal lists once."""
    gain, place = np.zeros(len(lists)), np.full(len(lists), -1)
    size = np.array([len(x) for x in lists])
    for n in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == n)
        p, same = np.unique(np.stack([lists[x] for x in at]).astype(float), axis=0, return_inverse=True)
        base, one, gains = _best_f(p), np.ones((len(p), 1)), []
        for c in range(n):
            rest, q = np.delete(p, c, axis=1), p[:, c]
            gains.append(q * _best_f(np.hstack([(1 - 1e-9) * one, rest])) + (1 - q) * _best_f(np.hstack([rest, 1e-9 * one])) - base)
        g = np.stack(gains, axis=1)
        best = np.argmax(np.round(g, 12), axis=1)
        gain[at], place[at] = g[np.arange(len(p)), best][same.reshape(-1)], best[same.reshape(-1)]
    return gain, place


def review_queue(pairs: DataFrame, p: str = "p", *, least: float = 1e-4, top: int = 150) -> DataFrame:
    """(i, gain, j, p): the entities that a review would help most. ``top`` is the length of the report."""
    @F.pandas_udf("gain double, place int")
    def value(ps: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("gain", "place"), review_values(list(ps)), strict=True)))

    got = candidate_lists(pairs, p, None).withColumn("v", value("ps")).where((F.col("v.gain") > least) & (F.col("v.place") >= 0))
    row = got.select("i", F.col("v.gain").alias("gain"), F.element_at("ids", F.col("v.place") + 1).alias("j"), F.element_at("ps", F.col("v.place") + 1).alias("p"))
    return row.orderBy(F.desc(F.round("gain", 9)), "i").limit(top)
