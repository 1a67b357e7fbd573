"""Range queries over bucket states: level, time range, filter, group-by, select."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import LEVELS, bucket, ceil, floor, literal, overlaps, utc
from ..operators.rollup import from_samples, merge_states
from .schema import RollupSchema, SchemaError


def instant(value: str | datetime) -> datetime:
    """A naive UTC datetime from RFC 3339 text or a datetime; a naive one is UTC."""
    try:
        at = datetime.fromisoformat(value) if isinstance(value, str) else value
    except ValueError:
        raise SchemaError("invalid_timestamp", repr(value), "time_range") from None
    return at.astimezone(timezone.utc).replace(tzinfo=None) if at.tzinfo else at


@dataclass
class Query:
    level: str
    start: str | datetime
    end: str | datetime
    select: list[dict]
    filter: dict[str, list[str]] = field(default_factory=dict)
    group_by: list[str] = field(default_factory=list)

    @staticmethod
    def from_json(body: dict) -> Query:
        span = body.get("time_range", {})
        return Query(body.get("level", ""), span.get("start"), span.get("end"), body.get("select", []), body.get("filter") or {}, body.get("group_by") or [])

    def validate(self, schema: RollupSchema) -> None:
        if self.level not in LEVELS:
            raise SchemaError("invalid_level", repr(self.level), "level")
        self.start, self.end = instant(self.start), instant(self.end)
        if self.start > self.end:
            raise SchemaError("invalid_range", "start is after end", "time_range")
        if not self.select:
            raise SchemaError("empty_select", "select something", "select")
        schema.mask([*self.filter, *self.group_by])
        for s in self.select:
            _state(schema, s)


def _state(schema: RollupSchema, item: dict) -> tuple[str, object]:
    measure = schema.measure(item["measure"])
    kind = measure.aggregate(item["aggregate"])
    if kind is None:
        hidden = next((m for m in schema.measures if m.name == f"__{measure.name}"), None)
        kind = hidden.aggregate(item["aggregate"]) if hidden else None
        measure = hidden or measure
    if kind is None:
        raise SchemaError("unknown_aggregate", f"{item['aggregate']!r} isn't kept for {item['measure']!r}", "select")
    if kind.name == "tdigest" and not (isinstance(item.get("quantile"), (int, float)) and 0 <= item["quantile"] <= 1):
        raise SchemaError("invalid_quantile", "a quantile from 0 to 1 is needed", "select")
    return measure.name, kind


def column_name(item: dict) -> str:
    if item.get("as"):
        return item["as"]
    q = f"_p{item['quantile'] * 100:g}".replace(".", "_") if item["aggregate"] == "tdigest" else ""
    return f"{item['measure']}_{item['aggregate']}{q}"


def reads(schema: RollupSchema, select: list[dict]) -> list[Column]:
    out = []
    for item in select:
        measure, kind = _state(schema, item)
        args = {k: v for k, v in item.items() if k in ("quantile", "kind")}
        out.append(kind.read(F.col(f"`{measure}`")[kind.name], **args).alias(column_name(item)))
    return out


def kept(states: DataFrame, filters: dict[str, list[str]]) -> DataFrame:
    """Rows whose dimensions have one of the listed values each; an empty list matches nothing."""
    for d, values in filters.items():
        states = states.where(F.col(d).isin(list(values)) if values else F.lit(False))
    return states


def run_query(states: DataFrame, schema: RollupSchema, query: Query, ordered: bool = True) -> DataFrame:
    """bucket_start, the group-by columns in the order asked for, and the selected values: one row per bucket and group that has samples."""
    query.validate(schema)
    wanted = list(dict.fromkeys(_state(schema, s)[0] for s in query.select))
    rows = kept(states.where(overlaps(query.start, query.end, query.level)), query.filter)
    keys = ["bucket_start", *dict.fromkeys(query.group_by)]
    merged = merge_states(rows, schema, keys, wanted)
    out = merged.select("bucket_start", *query.group_by, *reads(schema, query.select))
    return out.orderBy("bucket_start") if ordered else out


def run_on_samples(samples: DataFrame, schema: RollupSchema, query: Query, ordered: bool = True) -> DataFrame:
    """The same from raw samples, read only where a bucket of the range can have them."""
    query.validate(schema)
    rows = within(samples, schema, query.level, query.start, query.end)
    return run_query(from_samples(kept(rows, query.filter), schema, query.level), schema, query, ordered)


def within(samples: DataFrame, schema: RollupSchema, level: str, start, end) -> DataFrame:
    """The samples of the buckets that overlap a range, by a test on the raw time that reaches the scan. Rows are trusted, see ``from_samples``."""
    start, end = instant(start), instant(end)
    kind = dict(samples.dtypes)[schema.time]
    at = F.col(schema.time) if kind in ("timestamp_ntz", "date") else utc(schema.time, kind)
    low, high = (literal(x) for x in (floor(start, level), ceil(end, level)))
    return samples.where((at >= low) & (at < high))


def total(states: DataFrame, schema: RollupSchema, level: str, start, end, select: list[dict]) -> DataFrame:
    """One row: everything in range merged; identities if there is nothing."""
    query = Query(level, start, end, select)
    query.validate(schema)
    rows = states.where(overlaps(query.start, query.end, level))
    return merge_states(rows, schema, [], [_state(schema, s)[0] for s in select]).select(*reads(schema, select))


def grouped(states: DataFrame, schema: RollupSchema, level: str, start, end, select: list[dict], by: list[str]) -> DataFrame:
    """Merged across buckets per group; no row when there is nothing, also without dimensions."""
    query = Query(level, start, end, select, group_by=by)
    query.validate(schema)
    keys = schema.mask(by)
    rows = states.where(overlaps(query.start, query.end, level)).withColumn("__all", F.lit(1))
    return merge_states(rows, schema, ["__all", *keys], [_state(schema, s)[0] for s in select]).select(*keys, *reads(schema, select))


def nested(result: DataFrame, group_by: list[str]) -> DataFrame:
    """bucket_start and its groups as an array of (dimensions, values)."""
    values = [c for c in result.columns if c != "bucket_start" and c not in group_by]
    group = F.struct(F.array(*[F.col(g) for g in group_by]).cast("array<string>").alias("dimensions"), F.struct(*values).alias("values"))
    return result.groupBy("bucket_start").agg(F.array_sort(F.collect_list(group)).alias("groups")).orderBy("bucket_start")


def with_bounds(states: DataFrame, level: str) -> DataFrame:
    from ..functions.levels import bucket_end

    return states.withColumn("level", F.lit(level)).withColumn("bucket_end", bucket_end("bucket_start", level))


__all__ = ["Query", "bucket", "column_name", "grouped", "instant", "kept", "nested", "reads", "run_on_samples", "run_query", "total", "with_bounds", "within"]
