"""Samples from JSON text: {"ts": RFC 3339 text, "dimensions": [text, ...], "measures": [number, ...]}, in the schema's order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rollup import checked, validated
from ..plans.schema import RollupSchema


def from_json(bodies: DataFrame, column: str, schema: RollupSchema) -> DataFrame:
    """One sample per body, in the schema's types. A bad one fails the query, so a batch goes in whole or not at all.

    A number is accepted as f64, one without a fraction as i64, and if it isn't negative as u64 (1.0 has none); text isn't
    a number. Error codes: invalid_timestamp, dimension_count_mismatch, measure_count_mismatch, measure_type_mismatch.
    """
    own = [m for m in schema.measures if m.source == m.name]
    body = F.try_parse_json(F.col(f"`{column}`"))
    parts = bodies.select(F.try_variant_get(body, "$.ts", "string").alias("at"), F.try_variant_get(body, "$.dimensions", "array<string>").alias("d"), F.try_variant_get(body, "$.measures", "array<variant>").alias("m"))
    n = lambda c: F.coalesce(F.size(c), F.lit(-1))
    columns = [checked(F.col("at"), F.col("at").isNotNull(), "invalid_timestamp").alias(schema.time)]
    for i, d in enumerate(schema.dimensions):
        columns.append(checked(F.get("d", F.lit(i)), n("d") == len(schema.dimensions), "dimension_count_mismatch").alias(d))
    for i, m in enumerate(own):
        one = F.get("m", F.lit(i))
        kind, value = F.schema_of_variant(one), F.try_variant_get(one, "$", "double" if m.type == "f64" else "decimal(38,0)" if m.type == "u64" else "bigint")
        fine = kind.rlike("^(BIGINT|DECIMAL|DOUBLE)" if m.type == "f64" else r"^(BIGINT|DECIMAL\(\d+,0\))") & value.isNotNull()
        value = checked(value, fine, f"measure_type_mismatch: {m.name}")
        columns.append(checked(value, n("m") == len(own), "measure_count_mismatch").alias(m.name))
    return validated(parts.select(*columns), schema)
