"""A mergeable quantile sketch: centroids sized by the arcsine scale, interpolated between the middles of their weights.

Up to 63 values stay apart, and quantiles are then exactly those of Hazen. A batch of groups is compressed per call
of an Arrow UDF; states are plain structs, so they are stored, merged and read like any column.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPRESSION = 100
#: Values that COMPRESSION leaves apart in any group.
APART = 63
STATE = T.StructType().add("count", T.LongType()).add("min", T.DoubleType()).add("max", T.DoubleType()).add("means", T.ArrayType(T.DoubleType())).add("weights", T.ArrayType(T.LongType()))


def compress(means: np.ndarray, weights: np.ndarray, compression: int = COMPRESSION) -> tuple[np.ndarray, np.ndarray]:
    """Joins sorted neighbours while their span of the scale is at most one unit."""
    order = np.argsort(means, kind="stable")
    means, weights = means[order], weights[order]
    if len(means) < 2:
        return means, weights
    edges = np.concatenate([[0.0], np.cumsum(weights) / weights.sum()])
    scale = compression / (2 * np.pi) * np.arcsin(np.clip(2 * edges - 1, -1, 1))
    starts, i = [0], 0
    while (j := max(int(np.searchsorted(scale, scale[i] + 1 + 1e-12, "right")) - 1, i + 1)) < len(means):
        starts.append(j)
        i = j
    total = np.add.reduceat(weights, starts)
    return np.add.reduceat(means * weights, starts) / total, total


class TDigest:
    """The sketch outside Spark."""

    def __init__(self, values=(), compression: int = COMPRESSION):
        x = np.asarray(list(values), float)
        if np.isnan(x).any():
            raise ValueError("a digest takes no NaN")
        self.compression, self.count = compression, len(x)
        self.min, self.max = (float(x.min()), float(x.max())) if len(x) else (np.inf, -np.inf)
        self.means, self.weights = compress(x, np.ones(len(x), np.int64), compression)

    def update(self, value: float) -> TDigest:
        return self.merge(TDigest([value], self.compression))

    def merge(self, other: TDigest) -> TDigest:
        if not other.count or not self.count:
            return self if self.count else other
        out = TDigest(compression=min(self.compression, other.compression))
        out.count, out.min, out.max = self.count + other.count, min(self.min, other.min), max(self.max, other.max)
        sides = [compress(d.means, d.weights, out.compression) if d.compression != out.compression else (d.means, d.weights) for d in (self, other)]
        out.means, out.weights = compress(np.concatenate([m for m, _ in sides]), np.concatenate([w for _, w in sides]), out.compression)
        return out

    def __eq__(self, other: object) -> bool:
        """Structural: the same compression, count, bounds and centroids."""
        if not isinstance(other, TDigest):
            return NotImplemented
        same = (self.compression, self.count, self.min, self.max) == (other.compression, other.count, other.min, other.max)
        return same and np.array_equal(self.means, other.means) and np.array_equal(self.weights, other.weights)

    __hash__ = None  # it can be changed in place

    def quantile(self, q: float) -> float:
        return quantile_of(self.count, self.min, self.max, self.means, self.weights, q)


def quantile_of(count: int, low: float, high: float, means, weights, q: float) -> float:
    if not count or means is None:
        return float("nan")
    if q <= 0 or q >= 1:
        return float(low if q <= 0 else high)
    w = np.asarray(weights, float)
    middles = np.cumsum(w) - w / 2
    return float(np.interp(q * count, np.concatenate([[0], middles, [count]]), np.concatenate([[low], means, [high]])))


@F.pandas_udf(STATE)
def _of_values(values: pd.Series) -> pd.DataFrame:
    return _frame([TDigest(v if v is not None else ()) for v in values])


@F.pandas_udf(STATE)
def _of_states(counts: pd.Series, lows: pd.Series, highs: pd.Series, means: pd.Series, weights: pd.Series) -> pd.DataFrame:
    out = []
    for n, low, high, m, w in zip(counts, lows, highs, means, weights, strict=True):
        d = TDigest()
        if n:
            d.count, d.min, d.max = int(n), low, high
            d.means, d.weights = compress(np.concatenate(list(m)), np.concatenate(list(w)).astype(np.int64))
        out.append(d)
    return _frame(out)


def _frame(digests: list[TDigest]) -> pd.DataFrame:
    return pd.DataFrame({"count": [d.count for d in digests], "min": [d.min if d.count else None for d in digests], "max": [d.max if d.count else None for d in digests], "means": [d.means for d in digests], "weights": [d.weights.astype(np.int64) for d in digests]})


def of_values(values: Column) -> Column:
    """The state of an array of values: in the JVM where they stay apart, else by ``_of_values``, which then sees only the large ones."""
    apart = F.size(values) <= APART
    own = F.array_sort(values)
    small = F.struct(F.size(values).cast("bigint").alias("count"), F.array_min(values).alias("min"), F.array_max(values).alias("max"), own.alias("means"), F.transform(own, lambda _: F.lit(1).cast("bigint")).alias("weights"))
    return F.when(apart, small).otherwise(_of_values(F.when(~apart, values)))


def quantile(state: Column, q: float) -> Column:
    """JVM-side: the value at clamped q of a state, in one pass over its centroids; NaN for an empty or null one."""
    if q <= 0 or q >= 1:
        value = state["min"] if q <= 0 else state["max"]
    else:
        target = F.lit(float(q)) * state["count"].cast("double")

        def between(at: Column, x: Column, y: Column) -> Column:
            return at["y"] + (y - at["y"]) * F.when(x <= at["x"], F.lit(0.0)).otherwise((target - at["x"]) / (x - at["x"]))

        def step(at: Column, centroid: Column) -> Column:
            x = at["seen"] + centroid["weights"] / 2.0
            found = F.when(at["found"].isNull() & (target < x), between(at, x, centroid["means"])).otherwise(at["found"])
            return F.struct((at["seen"] + centroid["weights"]).alias("seen"), x.alias("x"), centroid["means"].alias("y"), found.alias("found"))

        start = F.struct(F.lit(0.0).alias("seen"), F.lit(0.0).alias("x"), state["min"].alias("y"), F.lit(None).cast("double").alias("found"))
        value = F.aggregate(F.arrays_zip(state["means"].alias("means"), state["weights"].alias("weights")), start, step, lambda at: F.coalesce(at["found"], between(at, state["count"].cast("double"), state["max"])))
    return F.when(F.coalesce(state["count"], F.lit(0)) == 0, F.lit(float("nan"))).otherwise(value)
