"""Deterministic workloads made by Spark from row numbers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.levels import literal, utc
from ..plans.schema import RollupSchema

SERVICES, REGIONS, ENDPOINTS = ("api", "auth", "billing", "search"), ("us-east", "us-west", "eu-central"), ("/list", "/get", "/put")
#: What an incident, five minutes of each hour, multiplies (traffic, latency, errors) by.
SCENARIOS = {"normal": (1.0, 1.0, 1.0), "traffic_spike": (4.0, 1.0, 1.0), "latency_spike": (1.0, 3.0, 1.0), "error_spike": (1.0, 1.0, 10.0), "mixed": (2.5, 2.2, 7.0)}
#: Seconds that a demonstration keeps of each level.
RETENTION = {"second": 1200, "minute": 72000, "hour": 172800, "day": 5256000}


def schema() -> RollupSchema:
    """That of ``requests``."""
    made = RollupSchema.builder().dimension("service").dimension("region").dimension("endpoint").dimension("status")
    return made.measure("request_count", "u64", "sum", "count").measure("latency_ms", "f64", "sum", "count", "min", "max", "tdigest").measure("error_count", "u64", "sum", "count").build()


def requests(spark: SparkSession, n: int, start: str = "2026-01-01 00:00:00", step_seconds: int = 1, seed: int = 1, scenario: str = "mixed") -> DataFrame:
    """n samples of a service: ts, service, region, endpoint, status, request_count, latency_ms, error_count. Traffic follows the hour of the day."""
    if scenario not in SCENARIOS:
        raise ValueError(f"{scenario!r} is none of {', '.join(SCENARIOS)}")
    noise = lambda k: F.pmod(F.xxhash64("id", F.lit(seed * 100 + k)), F.lit(10_000)) / 10_000
    pick = lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), F.floor(noise(k) * len(xs)).cast("int") + 1)
    epoch = F.unix_seconds(F.lit(f"{start}+00:00").cast("timestamp")) + F.col("id") * step_seconds
    rows = spark.range(n).withColumn("at", epoch).withColumn("service", pick(SERVICES, 1)).withColumn("region", pick(REGIONS, 2)).withColumn("endpoint", pick(ENDPOINTS, 3))
    incident = F.pmod(F.floor(F.col("at") / 300), F.lit(12)) == 4
    busier, slower, worse = (F.when(incident, x).otherwise(1.0) for x in SCENARIOS[scenario])
    traffic = 1 + F.cos((F.pmod(F.col("at"), F.lit(86400)) / 3600 - 14) / 24 * 2 * F.lit(3.141592653589793))
    count = F.floor(1 + traffic * busier * 50 * (0.5 + noise(4))).cast("decimal(20,0)")
    errors = F.floor(count * F.least(0.02 * worse, F.lit(0.35)) * 2 * noise(6)).cast("decimal(20,0)")
    latency = F.greatest(F.lit(1.0), (20 + 10 * traffic + 30 * noise(5)) * slower)
    status = F.when(errors > 0, "500").otherwise("200")
    at = literal(datetime(1970, 1, 1)) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("at").cast("decimal(18,6)"))
    return rows.select(at.alias("ts"), "service", "region", "endpoint", status.alias("status"), count.alias("request_count"), latency.alias("latency_ms"), errors.alias("error_count"))


def grid(spark: SparkSession, start: str, end: str, step: str, **values: list[str]) -> DataFrame:
    """Every tick with every combination of the dimension values given."""
    df = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"), F.expr(f"interval {step}"))).alias("ts"))
    for name, xs in values.items():
        df = df.withColumn(name, F.explode(F.array(*map(F.lit, xs))))
    return df


def from_millis(df: DataFrame, column: str, ts: str = "ts") -> DataFrame:
    """``df`` with the UTC time of a column of milliseconds since 1970."""
    return df.withColumn(ts, utc(F.col(column).cast("bigint"), "bigint"))
