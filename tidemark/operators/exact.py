"""Quantiles of the values themselves, where samples are at hand: sketches are exact for small groups only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.levels import bucket, utc
from ..plans.schema import TYPES, RollupSchema


def at_rank(q: float) -> Column:
    """The share of a row (value, c, upto, n) in the Hazen quantile of its group: c equal values end at place ``upto`` of n, from 1."""
    target = F.least(F.greatest(F.lit(float(q)) * F.col("n") - 0.5, F.lit(0.0)), F.col("n") - 1.0)
    low = F.floor(target)
    holds = lambda place: (place >= F.col("upto") - F.col("c")) & (place < F.col("upto"))
    share = F.when(holds(low), 1 - (target - low)).otherwise(0.0) + F.when(holds(low + 1), target - low).otherwise(0.0)
    return F.when(share > 0, F.col("value") * share)


def exact_quantiles(samples: DataFrame, schema: RollupSchema, measure: str, level: str, quantiles: dict[str, float], by: list[str]) -> DataFrame:
    """(bucket_start, by, n, total, quantiles): Hazen quantiles of a measure per bucket and group of raw samples, for groups of any size.

    Equal values are counted first. The rest of a group is sorted by value and may spill, so no group is gathered into a row.
    Rows are trusted as in ``from_samples``: a null measure counts as a sample, above all values.
    """
    kind = dict(samples.dtypes)[schema.time]
    if kind not in ("timestamp_ntz", "date"):
        samples = samples.withColumn(schema.time, utc(schema.time, kind))
    m = schema.measure(measure)
    keys = ["bucket_start", *[f"`{d}`" for d in by]]
    rows = samples.select(bucket(schema.time, level).alias("bucket_start"), *keys[1:], F.col(f"`{m.source}`").cast(TYPES[m.type]).alias("value"))
    counted = rows.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("c"), F.sum("value").alias("part"))
    group = Window.partitionBy(*keys)
    below = group.orderBy(F.col("value").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counted.withColumn("upto", F.sum("c").over(below)).withColumn("n", F.sum("c").over(group))
    return placed.groupBy(*keys).agg(F.max("n").alias("n"), F.sum("part").alias("total"), *[F.sum(at_rank(q)).alias(name) for name, q in quantiles.items()])
