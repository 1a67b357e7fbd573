"""From samples to bucket states, and from states to coarser states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import LEVELS, bucket, path_to, utc
from ..plans.schema import TYPES, RollupSchema, SchemaError
from .aggregates import MergeableAggregate

#: Sketches of coarser levels than this one are merged from it, so that no group gathers an unbounded list.
SKETCH_LEVEL = "hour"
#: Types of a time column, see ``utc``.
TIMES = ("timestamp_ntz", "timestamp", "date", "string", "bigint", "int")


def check_samples(samples: DataFrame, schema: RollupSchema) -> None:
    """Columns and types, before any row is read."""
    kinds = dict(samples.dtypes)
    if kinds.get(schema.time, "timestamp") not in TIMES:
        raise SchemaError("invalid_timestamp", f"{schema.time} is {kinds[schema.time]}", schema.time)
    for d in (schema.time, *schema.dimensions):
        if d not in kinds:
            raise SchemaError("dimension_count_mismatch", f"no column {d!r}", d)
    for m in schema.measures:
        if m.source not in kinds:
            raise SchemaError("measure_count_mismatch", f"no column {m.source!r}", m.source)
        kind = kinds[m.source]
        if not kind.startswith(("tinyint", "smallint", "int", "bigint", "decimal", "float", "double")) or (m.type != "f64" and kind in ("float", "double")):
            raise SchemaError("measure_type_mismatch", f"{m.source} is {kind}, not {m.type}", m.source)


def validated(samples: DataFrame, schema: RollupSchema) -> DataFrame:
    """``samples`` in the schema's types; a row with a null, a negative u64 or a NaN fails the query, so a batch goes in whole or not at all."""
    check_samples(samples, schema)
    at = utc(schema.time, dict(samples.dtypes)[schema.time])
    columns = [checked(at, at.isNotNull(), "invalid_timestamp").alias(schema.time)]
    columns += [checked(F.col(d), F.col(d).isNotNull(), "null dimension").cast("string").alias(d) for d in schema.dimensions]
    for m in schema.measures:
        c = F.col(m.source).cast(TYPES[m.type])
        fine = c.isNotNull()
        if m.type == "u64":
            fine &= c >= 0
        if m.type == "f64" and any(a.name == "tdigest" for a in m.aggregates):
            fine &= ~F.isnan(c)
        columns.append(checked(c, fine, f"measure_type_mismatch: {m.name}").alias(m.name))
    return samples.select(*columns)


def checked(value: Column, fine: Column, message: str) -> Column:
    return F.when(fine, value).otherwise(F.raise_error(F.lit(message)))


def _grouped(df: DataFrame, keys: list[Column], names: list[str], schema: RollupSchema, merged: bool, measures: list[str] | None = None) -> DataFrame:
    raw, sealed = [], []
    for m in schema.measures:
        if measures is not None and m.name not in measures:
            continue
        states = []
        for a in m.aggregates:
            flat = f"{m.name}__{a.name}"
            raw.append((a.merge(F.col(f"`{m.name}`")[a.name]) if merged else a.update(F.col(f"`{m.name}`"))).alias(flat))
            states.append((a.seal_merged if merged else a.seal)(F.col(f"`{flat}`")).alias(a.name))
        sealed.append(F.struct(*states).alias(m.name) if states else F.struct(F.lit(0).alias("none")).alias(m.name))
    grouped = df.groupBy(*keys)
    return (grouped.agg(*raw) if raw else grouped.agg(F.count(F.lit(1)).alias("__n"))).select(*[F.col(f"`{n}`") for n in names], *sealed)


def merge_states(states: DataFrame, schema: RollupSchema, keys: list[str], measures: list[str] | None = None) -> DataFrame:
    """One state per key; other key columns are merged away."""
    return _grouped(states, [F.col(f"`{k}`") for k in keys], keys, schema, True, measures)


def roll_edge(states: DataFrame, schema: RollupSchema, parent: str) -> DataFrame:
    """Buckets of a level merged into those of a parent."""
    keys = ["bucket_start", *schema.dimensions]
    return merge_states(states.withColumn("bucket_start", bucket("bucket_start", parent)), schema, keys)


def from_samples(samples: DataFrame, schema: RollupSchema, level: str) -> DataFrame:
    """States per (bucket, full key) straight from samples.

    Times are read as in ``validated``, but rows are trusted: a null or bad time or a null dimension is a group of its own,
    and a null measure counts as a sample. Use ``validated`` first where rows may be bad.
    """
    kind = dict(samples.dtypes)[schema.time]
    if kind not in ("timestamp_ntz", "date"):
        samples = samples.withColumn(schema.time, utc(schema.time, kind))
    sketched = any(type(a).seal is not MergeableAggregate.seal for m in schema.measures for a in m.aggregates)
    first = SKETCH_LEVEL if sketched and LEVELS.index(level) > LEVELS.index(SKETCH_LEVEL) else level
    df = samples.select(bucket(schema.time, first).alias("bucket_start"), *schema.dimensions, *[F.col(f"`{m.source}`").cast(TYPES[m.type]).alias(m.name) for m in schema.measures])
    states = _grouped(df, [F.col("bucket_start"), *schema.dimensions], ["bucket_start", *schema.dimensions], schema, False)
    return states if first == level else roll_edge(states, schema, level)


def cascade(samples: DataFrame, schema: RollupSchema, level: str) -> DataFrame:
    """States of a level by way of every level below it, merging only."""
    first, *rest = path_to(level)
    states = from_samples(samples, schema, first)
    for parent in rest:
        states = roll_edge(states, schema, parent)
    return states
