"""An aggregate of one's own, outside the engine: it needs only the contract of ``MergeableAggregate``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .operators.aggregates import MergeableAggregate


class Variance(MergeableAggregate):
    """Count, mean and sum of squared deviations, merged pairwise; read gives the population or sample variance or deviation."""

    name = "variance"

    def update(self, value):
        x = value.cast("double")
        return F.struct(F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"))

    def merge(self, state):
        return F.array_sort(F.collect_list(state))

    def seal_merged(self, raw):
        def step(a: Column, b: Column) -> Column:
            n = a["n"] + b["n"]
            delta = b["mean"] - a["mean"]
            mean, m2 = a["mean"] + delta * b["n"] / n, a["m2"] + b["m2"] + delta * delta * a["n"] * b["n"] / n
            return F.when(a["n"] == 0, b).when(b["n"] == 0, a).otherwise(F.struct(n.alias("n"), mean.alias("mean"), m2.alias("m2")))

        empty = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
        return F.aggregate(raw, empty, step)

    def read(self, state, kind: str = "pop", **args):
        if kind == "pop":
            return F.when(state["n"] > 0, state["m2"] / state["n"])
        sample = F.when(state["n"] > 1, state["m2"] / (state["n"] - 1))
        return F.sqrt(sample) if kind == "stddev" else sample
