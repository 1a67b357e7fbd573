"""Schemas: named string dimensions and typed measures with aggregates; fixed once built."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from ..functions.levels import LEVELS
from ..operators.aggregates import BUILT_IN, NUMERIC, MergeableAggregate

TYPES = {"i64": T.LongType(), "u64": T.DecimalType(20, 0), "f64": T.DoubleType()}


class SchemaError(ValueError):
    """code: one word for programs; field: the place of the fault, if it has one."""

    def __init__(self, code: str, detail: str, field: str | None = None):
        super().__init__(f"{code}: {detail}")
        self.code, self.detail, self.field = code, detail, field

    def envelope(self) -> dict:
        return {"error": self.code, "detail": self.detail} | ({"field": self.field} if self.field else {})


@dataclass(frozen=True)
class Measure:
    name: str
    type: str
    aggregates: tuple[MergeableAggregate, ...]
    source: str  # the column it is cast from; differs from the name for a sketch of an integer measure

    def aggregate(self, name: str) -> MergeableAggregate | None:
        return next((a for a in self.aggregates if a.name == name), None)


@dataclass(frozen=True)
class RollupSchema:
    dimensions: tuple[str, ...]
    measures: tuple[Measure, ...]
    time: str = "ts"

    @staticmethod
    def builder(time: str = "ts") -> Builder:
        return Builder(time)

    def measure(self, name: str) -> Measure:
        found = next((m for m in self.measures if m.name == name), None)
        if not found:
            raise SchemaError("unknown_measure", f"no measure {name!r}", "measure")
        return found

    def mask(self, names) -> list[str]:
        """Dimensions in the order of the schema, each once."""
        for n in names:
            if n not in self.dimensions:
                raise SchemaError("unknown_dimension", f"no dimension {n!r}", "group_by")
        return [d for d in self.dimensions if d in set(names)]

    def sample_type(self) -> T.StructType:
        fields = [T.StructField(self.time, T.TimestampNTZType(), False), *(T.StructField(d, T.StringType(), False) for d in self.dimensions)]
        return T.StructType([*fields, *(T.StructField(m.name, TYPES[m.type], False) for m in self.measures if m.source == m.name)])

    def describe(self) -> dict:
        return {"dimensions": list(self.dimensions), "measures": [{"name": m.name, "type": m.type, "aggregates": [a.name for a in m.aggregates]} for m in self.measures]}


@dataclass
class Builder:
    time: str = "ts"
    _dimensions: list[str] = field(default_factory=list)
    _measures: dict[str, Measure] = field(default_factory=dict)

    def dimension(self, name: str) -> Builder:
        """A name given twice counts once; 64 at most."""
        if name not in self._dimensions:
            if len(self._dimensions) == 64:
                raise SchemaError("too_many_dimensions", "64 at most", "dimensions")
            self._dimensions.append(name)
        return self

    def measure(self, name: str, type: str, *aggregates: str | MergeableAggregate, cast_sketches: bool = False) -> Builder:
        """cast_sketches: a sketch of an integer measure is kept on a hidden copy of it as doubles."""
        if name in self._measures or name in self._dimensions:
            raise SchemaError("duplicate_name", f"{name!r} is there already", "measures")
        if type not in NUMERIC:
            raise SchemaError("type_mismatch", f"{type!r} is none of {', '.join(NUMERIC)}", "measures")
        found, hidden = [], []
        for a in aggregates:
            kind = BUILT_IN.get(a) if isinstance(a, str) else a
            if kind is None:
                raise SchemaError("unknown_aggregate", f"no aggregate {a!r}", "aggregates")
            if kind.name in [x.name for x in found + hidden]:
                raise SchemaError("duplicate_aggregate", f"{kind.name!r} is there already", "aggregates")
            if type in kind.accepts:
                found.append(kind)
            elif cast_sketches:
                hidden.append(kind)
            else:
                raise SchemaError("type_mismatch", f"{kind.name} takes {', '.join(kind.accepts)}", "aggregates")
        self._measures[name] = Measure(name, type, tuple(found), name)
        if hidden:
            self._measures[f"__{name}"] = Measure(f"__{name}", "f64", tuple(hidden), name)
        return self

    def build(self) -> RollupSchema:
        if not self._dimensions:
            raise SchemaError("no_dimensions", "a schema needs a dimension", "dimensions")
        if not self._measures:
            raise SchemaError("no_measures", "a schema needs a measure", "measures")
        return RollupSchema(tuple(self._dimensions), tuple(self._measures.values()), self.time)


def validate_retention(retention: dict[str, float], positive: bool = False) -> dict[str, float]:
    for level, seconds in retention.items():
        if level not in LEVELS or seconds < 0 or (positive and seconds == 0):
            raise SchemaError("invalid_retention", f"{level}={seconds}", "retention")
    return dict(retention)
