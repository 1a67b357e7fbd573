"""Mergeable aggregates: an identity, an update, a merge and a read, each a Column expression.

A state is built by ``update`` inside a groupBy and joined by ``merge`` inside a later one, so Spark supplies partial and
final aggregation. ``seal`` and ``seal_merged`` turn what the groupBy gives into the stored state, where they differ.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import digest

NUMERIC = ("i64", "u64", "f64")


class MergeableAggregate:
    name: str
    accepts: tuple[str, ...] = NUMERIC

    def update(self, value: Column) -> Column:
        raise NotImplementedError

    def merge(self, state: Column) -> Column:
        raise NotImplementedError

    def seal(self, raw: Column) -> Column:
        return raw

    def seal_merged(self, raw: Column) -> Column:
        return raw

    def read(self, state: Column, **args) -> Column:
        return state

    def identity(self) -> Column:
        return F.lit(None)


class Sum(MergeableAggregate):
    name = "sum"

    def update(self, value):
        return F.sum(value)

    def merge(self, state):
        return F.sum(state)

    def read(self, state, **args):
        return F.coalesce(state, F.lit(0))

    def identity(self):
        return F.lit(0)


class Count(MergeableAggregate):
    """Counts samples, whatever their value."""

    name = "count"

    def update(self, value):
        return F.count(F.lit(1))

    def merge(self, state):
        return F.sum(state)

    def read(self, state, **args):
        return F.coalesce(state, F.lit(0)).cast("bigint")

    def identity(self):
        return F.lit(0)


class Min(MergeableAggregate):
    name = "min"

    def update(self, value):
        return F.min(value)

    merge = update


class Max(MergeableAggregate):
    name = "max"

    def update(self, value):
        return F.max(value)

    merge = update


class Digest(MergeableAggregate):
    name, accepts = "tdigest", ("f64",)

    def update(self, value):
        return F.collect_list(value)

    def seal(self, raw):
        return digest.of_values(raw)

    def merge(self, state):
        return F.array_sort(F.collect_list(state))

    def seal_merged(self, raw):
        total = F.aggregate(raw, F.lit(0).cast("bigint"), lambda a, s: a + s["count"])
        parts = [raw[f] for f in ("min", "max", "means", "weights")]  # of an array of structs: an array of the field
        return digest._of_states(total, F.array_min(parts[0]), F.array_max(parts[1]), parts[2], parts[3])

    def read(self, state, quantile: float = 0.5, **args):
        return digest.quantile(state, quantile)


BUILT_IN: dict[str, MergeableAggregate] = {a.name: a for a in (Sum(), Count(), Min(), Max(), Digest())}
