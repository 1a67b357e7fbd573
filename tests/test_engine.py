"""Scenarios with values worked out by hand: rollups, late data, pruning, the sketch, validation, calendar."""

from __future__ import annotations

from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import digest, levels
from tidemark.functions.digest import TDigest
from tidemark.operators import insight
from tidemark.operators.rollup import cascade, from_samples, validated
from tidemark.plans.query import Query, nested, run_on_samples, total
from tidemark.plans.schema import RollupSchema, SchemaError
from tidemark.sources import synthetic
from tidemark.sources.jsonl import from_json
from tidemark.sources.store import RollupStore

BASIC = RollupSchema.builder().dimension("host").measure("value", "f64", "sum", "count", "min", "max").build()


def samples(spark, rows):
    return spark.createDataFrame([(datetime.fromisoformat(t), h, float(v)) for t, h, v in rows], "ts timestamp_ntz, host string, value double")


def values(df):
    return sorted((str(r.bucket_start), r.host, r.value["sum"], r.value["count"]) for r in df.collect())


def test_cascade_reaches_every_level(spark):
    df = samples(spark, [("2026-12-20T05:00:00", "a", 40), ("2026-12-20T05:00:30", "a", 2)])
    for level, start in zip(levels.LEVELS[2:], ["2026-12-20 05:00:00", "2026-12-20 00:00:00", "2026-12-14 00:00:00", "2026-12-01 00:00:00", "2026-01-01 00:00:00"], strict=True):
        assert values(cascade(df, BASIC, level)) == [(start, "a", 42.0, 2)] == values(from_samples(df, BASIC, level))


def test_late_update_after_prune_counts_once(spark, tmp_path):
    store = RollupStore(spark, str(tmp_path), BASIC, {"second": 5})
    for value, second in ((10, 0), (20, 20)):
        store.ingest(samples(spark, [(f"2026-03-15T10:00:{second:02d}", "a", value)]))
        store.sweep()
    assert store.bucket_count("second") == 1
    store.ingest(samples(spark, [("2026-03-15T10:00:20", "a", 5)]), key="k")
    assert not store.ingest(samples(spark, [("2026-03-15T10:00:20", "a", 5)]), key="k")
    store.rollup()
    assert store.rollup() == 0
    assert values(store.buckets("minute")) == [("2026-03-15 10:00:00", "a", 35.0, 3)]
    again = RollupStore(spark, str(tmp_path), BASIC)
    again.compact("minute")
    assert values(again.buckets("minute")) == [("2026-03-15 10:00:00", "a", 35.0, 3)]
    with pytest.raises(SchemaError, match="schema_already_exists"):
        RollupStore(spark, str(tmp_path), BASIC, create=True)


def test_prune_keeps_what_is_not_rolled_up(spark, tmp_path):
    store = RollupStore(spark, str(tmp_path), BASIC, {"second": 0})
    store.ingest(samples(spark, [("2026-03-15T10:00:00", "a", 3)]))
    store.prune()
    assert store.bucket_count("second") == 1
    store.sweep()
    assert store.bucket_count("second") == 0 and values(store.buckets("minute")) == [("2026-03-15 10:00:00", "a", 3.0, 1)]


def test_batch_is_atomic(spark, tmp_path):
    store = RollupStore(spark, str(tmp_path), BASIC)
    bad = samples(spark, [("2026-03-15T10:00:00", "a", 3)]).withColumn("host", F.lit(None).cast("string"))
    with pytest.raises(Exception, match="null dimension"):
        store.ingest(bad)
    assert store.bucket_count("second") == 0
    with pytest.raises(SchemaError, match="dimension_count_mismatch"):
        store.ingest(bad.drop("host"))


def test_mean_is_of_sums(spark):
    df = samples(spark, [("2026-03-15T10:00:00", "a", 10), *[(f"2026-03-15T10:01:0{i}", "a", 1) for i in range(3)]])
    row = cascade(df, BASIC, "hour").first()
    assert row.value["sum"] / row.value["count"] == 3.25


def test_empty_total_is_identity(spark):
    df = samples(spark, [("2026-03-15T10:00:00", "a", 1)])
    select = [{"measure": "value", "aggregate": a} for a in ("sum", "count", "min", "max")]
    assert tuple(total(from_samples(df, BASIC, "hour"), BASIC, "hour", datetime(1990, 1, 1), datetime(1990, 1, 1), select).first()) == (0.0, 0, None, None)


def test_query_ranges_are_whole_buckets(spark):
    df = samples(spark, [("2026-03-15T10:59:59", "a", 1), ("2026-03-15T11:00:00", "b", 2)])
    select = [{"measure": "value", "aggregate": "sum"}]

    def starts(s, e):
        return [r.bucket_start.hour for r in run_on_samples(df, BASIC, Query("hour", s, e, select)).collect()]

    assert starts("2026-03-15T10:30:00Z", "2026-03-15T10:30:00Z") == [10]
    assert starts("2026-03-15T11:00:00Z", "2026-03-15T11:00:00Z") == []
    assert starts("2026-03-15T12:30:00+02:00", "2026-03-15T11:00:01Z") == [10, 11]
    out = nested(run_on_samples(df, BASIC, Query("day", "2026-03-15", "2026-03-16", select, group_by=["host"])), ["host"]).first()
    assert [(g["dimensions"], g["values"]["value_sum"]) for g in out.groups] == [(["a"], 1.0), (["b"], 2.0)]


@pytest.mark.parametrize(
    ("change", "code"),
    [({"level": "decade"}, "invalid_level"), ({"start": "2027-01-01"}, "invalid_range"), ({"start": "x"}, "invalid_timestamp"), ({"select": []}, "empty_select"), ({"group_by": ["nope"]}, "unknown_dimension"),
     ({"select": [{"measure": "nope", "aggregate": "sum"}]}, "unknown_measure"), ({"select": [{"measure": "value", "aggregate": "tdigest"}]}, "unknown_aggregate")],
)
def test_query_errors(change, code):
    spec = {"level": "hour", "start": "2026-01-01", "end": "2026-01-02", "select": [{"measure": "value", "aggregate": "sum"}]} | change
    with pytest.raises(SchemaError) as found:
        Query(**spec).validate(BASIC)
    assert found.value.code == code and found.value.envelope()["error"] == code


def test_schema_errors():
    with pytest.raises(SchemaError, match="no_dimensions"):
        RollupSchema.builder().build()
    with pytest.raises(SchemaError, match="no_measures"):
        RollupSchema.builder().dimension("a").build()
    with pytest.raises(SchemaError, match="duplicate_aggregate"):
        RollupSchema.builder().measure("a", "f64", "sum", "sum")
    with pytest.raises(SchemaError, match="duplicate_name"):
        RollupSchema.builder().measure("a", "f64").measure("a", "f64")
    with pytest.raises(SchemaError, match="type_mismatch"):
        RollupSchema.builder().measure("a", "i64", "tdigest")
    hidden = RollupSchema.builder().dimension("d").measure("a", "i64", "sum", "tdigest", cast_sketches=True).build()
    assert [m.name for m in hidden.measures] == ["a", "__a"]


def test_hidden_sketch_of_integers(spark):
    schema = RollupSchema.builder().dimension("host").measure("n", "i64", "sum", "tdigest", cast_sketches=True).build()
    df = spark.createDataFrame([(datetime(2026, 1, 1, 0, 0, i), "a", v) for i, v in enumerate([10, 20, 30, 40, 50])], "ts timestamp_ntz, host string, n long")
    select = [{"measure": "n", "aggregate": "sum"}, *[{"measure": "n", "aggregate": "tdigest", "quantile": q} for q in (0.5, 0.22, 0.38)]]
    row = run_on_samples(df, schema, Query("day", "2026-01-01", "2026-01-02", select)).first()
    assert row[1] == 150 and row[2:] == pytest.approx((30, 16, 24))


def test_calendar():
    at = datetime(2026, 3, 15, 10, 42, 37, 5)
    assert [levels.floor(at, x) for x in levels.LEVELS] == [datetime(2026, 3, 15, 10, 42, 37), datetime(2026, 3, 15, 10, 42), datetime(2026, 3, 15, 10), datetime(2026, 3, 15), datetime(2026, 3, 9), datetime(2026, 3, 1), datetime(2026, 1, 1)]
    assert levels.ceil(datetime(2026, 12, 2), "month") == datetime(2027, 1, 1) and levels.ceil(datetime(2024, 2, 1), "month") == datetime(2024, 2, 1)
    assert levels.ceil(datetime(2024, 1, 2), "year") == datetime(2025, 1, 1) and levels.ceil(datetime(2024, 1, 31, 5), "month") == datetime(2024, 2, 1)


def test_digest_small_and_large():
    assert np.isnan(TDigest().quantile(0.5))
    d = TDigest([10, 20, 30, 40, 50])
    assert [d.quantile(q) for q in (0, 0.22, 0.38, 0.5, 1)] == pytest.approx([10, 16, 24, 30, 50])
    assert len(TDigest(range(63)).means) == 63
    x = np.array([i * i % 997 for i in range(1000)], float)
    whole, parts = TDigest(x), TDigest()
    for i in range(0, 1000, 70):
        parts = parts.merge(TDigest(x[i : i + 70]))
    for d in (whole, parts):
        qs = [d.quantile(q / 100) for q in range(101)]
        assert qs == sorted(qs) and d.count == 1000 and abs(d.quantile(0.5) - np.median(x)) < 25
    small = TDigest(range(500), 200).merge(TDigest(range(500), 20))
    assert small.compression == 20 and len(small.means) <= 24
    with pytest.raises(ValueError, match="NaN"):
        TDigest([float("nan")])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=63), st.floats(0, 1))
def test_digest_is_hazen_up_to_63(xs, q):
    s, n = sorted(xs), len(xs)
    at = min(max(q * n - 0.5, 0), n - 1)
    low = int(at)
    want = s[0] if q <= 0 else s[-1] if q >= 1 else s[low] + (s[min(low + 1, n - 1)] - s[low]) * (at - low)
    assert TDigest(xs).quantile(q) == pytest.approx(want, abs=1e-6 * max(1, abs(want)))


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**8), st.sampled_from("ab"), st.integers(-100, 100)), min_size=1, max_size=20), st.integers(0, 20))
def test_split_and_order_do_not_matter(spark, tmp_path_factory, rows, cut):
    from datetime import timedelta

    made = [((datetime(2025, 1, 1) + timedelta(seconds=s)).isoformat(), h, v) for s, h, v in rows]
    store = RollupStore(spark, str(tmp_path_factory.mktemp("store")), BASIC)
    for part in (made[cut:][::-1], made[:cut]):
        if part:
            store.ingest(samples(spark, part))
            store.rollup()
    for level in ("day", "week", "year"):
        assert values(store.buckets(level)) == values(from_samples(samples(spark, made), BASIC, level))


def test_insight_pieces(spark):
    df = samples(spark, [("2026-03-15T10:00:00", "a", 6), ("2026-03-15T12:00:00", "a", 2), ("2026-03-15T12:30:00", "b", 2)])
    q = Query("hour", "2026-03-15T10:00:00", "2026-03-15T13:00:00", [{"measure": "value", "aggregate": "sum"}], group_by=["host"])
    s = insight.dense(run_on_samples(df, BASIC, q), "hour", q.start, q.end, ["host"], "value_sum")
    assert sorted((r.label, r.bucket_start.hour, r.value) for r in s.collect()) == [("a", 10, 6.0), ("a", 11, None), ("a", 12, 2.0), ("b", 10, None), ("b", 11, None), ("b", 12, 2.0)]
    assert {r.label: r.total for r in insight.series_total(s).collect()} == {"a": 8.0, "b": 2.0}
    assert insight.divide(s, s).where("label = 'b' and value is null").count() == 2
    none = insight.dense(run_on_samples(df, BASIC, q).where("false"), "hour", q.start, q.end, ["host"], "value_sum")
    assert [(r.label, r.value) for r in none.collect()] == [("(all)", None)] * 3
    assert insight.title("request_latency_ms") == "Request Latency Ms"
    with pytest.raises(ValueError, match="buckets"):
        insight.explore(df, BASIC, Query("second", "2026-01-01", "2026-02-01", q.select))


def test_synthetic_workload(spark):
    df = synthetic.requests(spark, 500)
    assert df.count() == 500 and df.where("latency_ms < 1 or error_count > request_count").count() == 0
    assert sorted(map(str, df.collect())) == sorted(map(str, synthetic.requests(spark, 500).collect()))
    assert synthetic.grid(spark, "2026-01-01", "2026-01-02", "6 hours", a=["x", "y"]).count() == 10
    assert [r.ts for r in synthetic.from_millis(spark.createDataFrame([(1767225600123,)], "ms long"), "ms").collect()] == [datetime(2026, 1, 1, 0, 0, 0, 123000)]


def test_scenarios_change_incidents_only(spark):
    means = {}
    for name in synthetic.SCENARIOS:
        df = synthetic.requests(spark, 3600, "2026-01-01 14:00:00", scenario=name)
        hit = df.withColumn("hit", F.minute("ts").between(20, 24)).groupBy("hit").agg(F.avg("request_count"), F.avg("latency_ms"), F.sum("error_count") / F.sum("request_count"))
        means[name] = {r[0]: [float(x) for x in r[1:]] for r in hit.collect()}
    base = means["normal"]
    for name, factors in synthetic.SCENARIOS.items():
        assert means[name][False] == base[False]
        for got, before, factor, rel in zip(means[name][True], base[True], factors, (0.1, 0.1, 0.4), strict=True):  # errors are rounded down
            assert got == pytest.approx(before * factor, rel=rel)
    with pytest.raises(ValueError, match="none of"):
        synthetic.requests(spark, 1, scenario="quiet")
    states = from_samples(validated(synthetic.requests(spark, 300), synthetic.schema()), synthetic.schema(), "minute")
    assert states.agg(F.sum("latency_ms.count")).first()[0] == 300


def test_times_are_utc_instants_on_both_paths(spark):
    texts = ["2026-03-15T10:00:00+02:00", "2026-03-15T08:59:59.999999Z", "2026-03-15t08:00:01z"]
    df = spark.createDataFrame([(t, "a", 1.0) for t in texts], "ts string, host string, value double")
    kinds = {"string": df, "timestamp": df.withColumn("ts", F.try_to_timestamp(F.upper("ts"))), "bigint": df.withColumn("ts", F.unix_millis(F.try_to_timestamp(F.upper("ts"))))}
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            for rows in kinds.values():
                for made in (rows, validated(rows, BASIC)):
                    assert values(from_samples(made, BASIC, "hour")) == [("2026-03-15 08:00:00", "a", 3.0, 3)]
                found = run_on_samples(rows, BASIC, Query("hour", "2026-03-15T08:30:00Z", "2026-03-15T08:30:00Z", [{"measure": "value", "aggregate": "count", "as": "n"}]))
                assert [r.n for r in found.collect()] == [3]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    for bad in ("2026-03-15T10:00:00", "yesterday", None):
        with pytest.raises(Exception, match="invalid_timestamp"):
            validated(spark.createDataFrame([(bad, "a", 1.0)], df.schema), BASIC).collect()
    with pytest.raises(SchemaError, match="invalid_timestamp"):
        validated(df.withColumn("ts", F.lit(True)), BASIC)


def test_json_samples(spark):
    schema = RollupSchema.builder().dimension("host").measure("f", "f64", "sum").measure("i", "i64", "sum").measure("u", "u64", "sum").build()

    def read(*bodies):
        return from_json(spark.createDataFrame([(b,) for b in bodies], "body string"), "body", schema).collect()

    good = '{"ts": "2026-03-15T10:00:00+02:00", "dimensions": ["a"], "measures": [%s]}'
    assert [tuple(r) for r in read(good % "1, -5, 18446744073709551615", good % "2.5, 0, 7")] == [(datetime(2026, 3, 15, 8), "a", 1.0, -5, 18446744073709551615), (datetime(2026, 3, 15, 8), "a", 2.5, 0, 7)]
    for body, code in [(good % "1, 2", "measure_count_mismatch"), (good % "1, 2, -3", "measure_type_mismatch"), (good % "1, 2.5, 3", "measure_type_mismatch"), (good % '"1", 2, 3', "measure_type_mismatch"), (good % "null, 2, 3", "measure_type_mismatch"), ((good % "1, 2, 3").replace('["a"]', "[]"), "dimension_count_mismatch"), ((good % "1, 2, 3").replace("+02:00", ""), "invalid_timestamp"), ("no json", "invalid_timestamp")]:
        with pytest.raises(Exception, match=code):
            read(good % "1, 2, 3", body)


def test_digests_equal_by_structure():
    assert TDigest([1, 2, 3]) == TDigest([3, 2, 1]) != TDigest([1, 2, 4]) and TDigest() == TDigest() != TDigest([1.0])
    assert TDigest([1], 50) != TDigest([1]) and TDigest([1]) != 1


def test_large_and_small_groups_of_a_sketch(spark):
    schema = RollupSchema.builder().dimension("host").measure("value", "f64", "count", "tdigest").build()
    rows = [("2026-03-15T10:00:00", "small", i) for i in range(63)] + [("2026-03-15T10:00:00", "large", i) for i in range(5000)] + [("2026-03-15T10:00:00", "one", 4)]
    state = F.col("value.tdigest")
    read = {r.host: tuple(r)[1:] for r in from_samples(samples(spark, rows), schema, "hour").select("host", *[digest.quantile(state, q) for q in (0, 0.25, 0.5, 0.99, 1)], F.size("value.tdigest.means")).collect()}
    assert read["small"][:5] == tuple(np.quantile(np.arange(63), q, method="hazen") for q in (0, 0.25, 0.5, 0.99, 1)) and read["small"][5] == 63
    assert read["one"] == (4, 4, 4, 4, 4, 1)
    assert 20 < read["large"][5] < 200 and all(abs(x - 5000 * q) < 50 for x, q in zip(read["large"], (0, 0.25, 0.5, 0.99, 1), strict=False))


def test_sweep_writes_nothing_where_nothing_is_due(spark, tmp_path):
    store = RollupStore(spark, str(tmp_path), BASIC, {"second": 3600})
    assert [r.last_sweep for r in store.freshness().collect()] == [None] * 7
    for k in range(20):
        assert store.ingest(samples(spark, [(f"2026-03-15T10:00:{k:02d}", "a", 1)]), mark=("feed", k))
    assert not store.ingest(samples(spark, [("2026-03-15T10:00:00", "a", 1)]), mark=("feed", 7))
    assert {r.level: r.stale for r in store.freshness().collect()} == {x: x != "second" for x in levels.LEVELS}
    store.sweep()
    live = dict(store.state["live"])
    assert len(live["second"]) == 1 and store.state["cutoff"] == {"second": "2026-03-15T09:00:20"} and store.state["keys"] == []
    store.sweep()
    assert store.state["live"] == live and not any(r.stale for r in store.freshness().collect())
    assert len(list((tmp_path / "_manifest").glob("0*"))) <= 9
    again = RollupStore(spark, str(tmp_path), BASIC)
    assert values(again.buckets("day")) == [("2026-03-15 00:00:00", "a", 20.0, 20)]


def test_ticks_lie_within_the_range(spark):
    df = samples(spark, [("2026-03-15T10:10:00", "a", 1), ("2026-03-15T11:10:00", "a", 2)])
    start, end = datetime(2026, 3, 15, 10, 30), datetime(2026, 3, 15, 13)
    rows = run_on_samples(df, BASIC, Query("hour", start, end, [{"measure": "value", "aggregate": "sum", "as": "s"}], group_by=["host"]))
    out = insight.dense(rows, "hour", start, end, ["host"], "s").orderBy("bucket_start").collect()
    assert [(r.label, r.bucket_start.hour, r.value) for r in out] == [("a", 11, 2.0), ("a", 12, None)]


def test_breakdowns_leave_pinned_dimensions_out(spark):
    schema = RollupSchema.builder().dimension("host").dimension("zone").measure("value", "f64", "sum").build()
    df = samples(spark, [("2026-03-15T10:00:00", "a", 1), ("2026-03-15T10:00:00", "b", 3)]).withColumn("zone", F.lit("z"))
    states, item = from_samples(df, schema, "hour"), {"measure": "value", "aggregate": "sum"}
    span = (datetime(2026, 3, 15), datetime(2026, 3, 16))
    assert [tuple(r) for r in insight.breakdowns(states, schema, "hour", *span, item).collect()] == [("host", "b", 3.0, 75.0), ("host", "a", 1.0, 25.0), ("zone", "z", 4.0, 100.0)]
    assert [tuple(r) for r in insight.breakdowns(states, schema, "hour", *span, item, {"host": ["a"]}).collect()] == [("zone", "z", 1.0, 100.0)]
    with pytest.raises(SchemaError, match="pinned"):
        insight.breakdowns(states, schema, "hour", *span, item, {"host": ["a"], "zone": ["z"]})
