"""A store of rollups: per level a log of partial states, merged on read.

A batch of samples adds second states; a rollup adds, along each edge, the merge of the batches that the edge has not yet
consumed. No parent is rebuilt, so late data needs no special case and pruning children never changes a parent. Batches
are directories, and a small manifest, replaced as a whole, says which are live. A batch key ingested again is a no-op; a feed
whose batches are numbered keeps one number instead of its keys, so the manifest stays small. What a sweep retires is deleted
at the next change after it, so a reader of the version before still finds its files.
"""

from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.levels import EDGES, LEVELS, bucket_end, literal
from ..operators.rollup import from_samples, merge_states, roll_edge, validated
from ..plans.query import Query, grouped, run_query, total
from ..plans.schema import RollupSchema, SchemaError, validate_retention


#: Versions of the manifest that are kept, and consumed batches of a level from which a sweep makes one of them.
VERSIONS, BATCHES = 8, 16


class RollupStore:
    def __init__(self, spark: SparkSession, path: str, schema: RollupSchema, retention: dict[str, float] | None = None, create: bool = False):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.retention = validate_retention(retention or {})
        versions = self._versions()
        if create and versions:
            raise SchemaError("schema_already_exists", path)
        self.state = json.loads(self._read_text(max(versions))) if versions else {"version": 0, "next": 0, "live": {x: [] for x in LEVELS}, "pending": {f"{c}>{p}": [] for c, p in EDGES}, "keys": [], "marks": {}, "cutoff": {}, "retired": [], "swept": None, "schema": schema.describe()}
        if not versions:
            self._commit()
        elif self.state["schema"] != schema.describe():
            raise SchemaError("schema mismatch", path)

    # manifest
    def _fs(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _versions(self) -> list[int]:
        path, fs = self._fs(f"{self.path}/_manifest")
        if not fs.exists(path):
            return []
        return [int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit()]

    def _read_text(self, version: int) -> str:
        path, fs = self._fs(f"{self.path}/_manifest/{version:09d}")
        stream = fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _commit(self) -> None:
        """A new version; two writers of one version can't both succeed."""
        self.state["version"] += 1
        path, fs = self._fs(f"{self.path}/_manifest/{self.state['version']:09d}")
        out = fs.create(path, False)
        out.write(json.dumps(self.state).encode())
        out.close()
        if self.state["version"] > VERSIONS:
            old, fs = self._fs(f"{self.path}/_manifest/{self.state['version'] - VERSIONS:09d}")
            fs.delete(old, False)

    def _retire(self, level: str, batches: list[int]) -> None:
        """Deletes what was retired before, and notes what is now."""
        for at in self.state["retired"]:
            path, fs = self._fs(f"{self.path}/{at}")
            fs.delete(path, True)
        self.state["retired"] = [f"{level}/batch={b}" for b in batches]

    # tables
    def _type(self) -> T.StructType:
        empty = self.spark.createDataFrame([], self.schema.sample_type())
        for m in self.schema.measures:
            if m.source != m.name:
                empty = empty.withColumn(m.source, F.lit(0).cast("bigint")) if m.source not in empty.columns else empty
        return from_samples(empty, self.schema, "second").schema

    def _rows(self, level: str, batches: list[int]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], self._type())
        return self.spark.read.schema(self._type()).parquet(*[f"{self.path}/{level}/batch={b}" for b in batches])

    def _add(self, level: str, states: DataFrame, pending: bool = True) -> int:
        k = self.state["next"]
        self.state["next"] += 1
        states.write.mode("overwrite").parquet(f"{self.path}/{level}/batch={k}")
        self.state["live"][level].append(k)
        if pending:
            for c, p in EDGES:
                if c == level:
                    self.state["pending"][f"{c}>{p}"].append(k)
        return k

    def ingest(self, samples: DataFrame, key: str | None = None, mark: tuple[str, int] | None = None) -> bool:
        """All rows or none; False if the key, or a batch of the mark's feed with its number or a later one, was ingested before."""
        if key is not None and key in self.state["keys"] or mark is not None and mark[1] <= self.state["marks"].get(mark[0], -1):
            return False
        self._add("second", from_samples(validated(samples, self.schema), self.schema, "second"))
        if key is not None:
            self.state["keys"].append(key)
        if mark is not None:
            self.state["marks"][mark[0]] = mark[1]
        self._commit()
        return True

    def rollup(self) -> int:
        """Carries what is new along every edge; returns how many edges had anything."""
        done = 0
        for child, parent in EDGES:
            fresh = self.state["pending"][f"{child}>{parent}"]
            if fresh:
                self._add(parent, roll_edge(self._rows(child, fresh), self.schema, parent))
                self.state["pending"][f"{child}>{parent}"] = []
                done += 1
        if done:
            self._commit()
        return done

    def prune(self) -> None:
        """Per level with a limit, drops consumed buckets that end at or before the newest end less the limit; does nothing where none is due."""
        changed = False
        for level, seconds in self.retention.items():
            waiting = {b for c, p in EDGES if c == level for b in self.state["pending"][f"{c}>{p}"]}
            done = [b for b in self.state["live"][level] if b not in waiting]
            newest = self._rows(level, self.state["live"][level]).agg(F.max(bucket_end("bucket_start", level))).first()[0]
            if newest is None or not done:
                continue
            cutoff = newest - timedelta(seconds=float(seconds))
            alive = bucket_end("bucket_start", level) > literal(cutoff)
            rows = self._rows(level, done)
            self.state["cutoff"][level] = max(self.state["cutoff"].get(level, ""), cutoff.isoformat())
            if not rows.where(~alive).limit(1).count():
                continue
            left = merge_states(rows.where(alive), self.schema, ["bucket_start", *self.schema.dimensions])
            self.state["live"][level] = [b for b in self.state["live"][level] if b in waiting]
            self._add(level, left, pending=False)
            self._retire(level, done)
            changed = True
        if changed:
            self._commit()

    def compact(self, level: str) -> None:
        """One batch for all that every edge has consumed."""
        waiting = {b for c, p in EDGES if c == level for b in self.state["pending"][f"{c}>{p}"]}
        done = [b for b in self.state["live"][level] if b not in waiting]
        if len(done) > 1:
            merged = merge_states(self._rows(level, done), self.schema, ["bucket_start", *self.schema.dimensions])
            self.state["live"][level] = sorted(waiting)
            self._add(level, merged, pending=False)
            self._retire(level, done)
            self._commit()

    def sweep(self) -> None:
        """Rolls up, prunes, and makes one batch of many."""
        self.rollup()
        self.prune()
        for level in LEVELS:
            if len(self.state["live"][level]) > BATCHES:
                self.compact(level)
        self.state["swept"] = datetime.now(timezone.utc).isoformat()
        self._commit()

    def freshness(self) -> DataFrame:
        """(level, newest, stale, last_sweep) per level: the start of its newest bucket (null: none), whether a level below has states that it lacks, and when the last sweep ended (null: never)."""
        below = {p: c for c, p in EDGES}
        out = None
        for level in LEVELS:
            path, at = [], level
            while at in below:
                path.append(f"{below[at]}>{at}")
                at = below[at]
            stale = any(self.state["pending"][e] for e in path)
            one = self.states(level).agg(F.max("bucket_start").alias("newest"))
            one = one.select(F.lit(level).alias("level"), "newest", F.lit(stale).alias("stale"), F.lit(self.state["swept"]).cast("timestamp").alias("last_sweep"))
            out = one if out is None else out.unionByName(one)
        return out

    def set_retention(self, retention: dict[str, float]) -> None:
        self.retention = validate_retention(retention)

    # reads
    def states(self, level: str) -> DataFrame:
        """The level's partial states; several rows may share a key."""
        return self._rows(level, self.state["live"][level])

    def buckets(self, level: str) -> DataFrame:
        """One row per bucket and key, in order of time."""
        return merge_states(self.states(level), self.schema, ["bucket_start", *self.schema.dimensions]).orderBy("bucket_start")

    def bucket(self, level: str, start: datetime) -> DataFrame:
        return self.buckets(level).where(F.col("bucket_start") == literal(start))

    def bucket_count(self, level: str) -> int:
        return self.states(level).select("bucket_start").distinct().count()

    def query(self, query: Query) -> DataFrame:
        return run_query(self.states(query.level), self.schema, query)

    def query_range(self, level: str, start, end, select: list[dict]) -> DataFrame:
        return total(self.states(level), self.schema, level, start, end, select)

    def query_range_grouped(self, level: str, start, end, select: list[dict], by: list[str]) -> DataFrame:
        return grouped(self.states(level), self.schema, level, start, end, select, by)
