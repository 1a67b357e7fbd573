"""Shared pieces: reading tables, tables in the shared folder, distributed connected components."""

from __future__ import annotations

import atexit
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch where each holds one or two whole texts.
TEXT_ROWS = 1000
#: Bytes of text that one step of vectorised work takes at most (a longer text is one step of its own).
STEP_BYTES = 2 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a folder of this machine only where that is unset (tests)."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir")
    if not found:
        if not conf.get("spark.master", "local").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _own_dir()
    return found.rstrip("/")


_OWN: list[str] = []


def _own_dir() -> str:
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="tidemark-"))
        import shutil

        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return _OWN[0]


class Workspace:
    """Tables written to the shared folder: they cut the lineage and outlive a lost executor.

    ``save`` writes and rereads, with Arrow batches of at most ``rows`` rows if that is given; ``drop`` removes
    a table that no later step reads. What the result itself reads stays until the folder is emptied, as files of
    ``checkpoint()`` do.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self.tidied = 0.0

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = self.spark.conf.get(key)
        try:
            self.spark.conf.set(key, str(rows or before))
            df.write.mode("overwrite").parquet(self.path(name))
        finally:
            self.spark.conf.set(key, before)
        self.tidy()
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def tidy(self) -> None:
        """Lets Spark remove the shuffle files of what is now written, at most once in a few seconds. The scheduler holds on to the last job, so a small one comes first."""
        if time.monotonic() - self.tidied > 3:
            self.spark.range(0, 1, 1, 1).collect()
            self.spark._jvm.System.gc()
            self.tidied = time.monotonic()

    def bucketed(self, df: DataFrame, name: str, column: str) -> DataFrame:
        """``save`` into buckets by ``column``, as many as there are shuffle partitions: joins and groups by it need no shuffle of this table."""
        table = f"{name}_{uuid.uuid4().hex}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.format("parquet").bucketBy(n, column).option("path", self.path(name)).saveAsTable(table)
        self.tidy()
        found = self.spark.table(table)
        self.spark.sql(f"drop table {table}")  # of the catalogue only: the files stay
        return found

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def steps(batch: pa.RecordBatch, columns: tuple[str, ...], most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, each with at most ``most`` bytes in ``columns`` or of one row."""
    if not batch.num_rows:
        return
    total = sum(pa.compute.fill_null(pa.compute.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype("int64") for c in columns)
    start, held = 0, 0
    for i, n in enumerate(total.tolist()):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)


def map_steps(df: DataFrame, columns: str | tuple[str, ...], make: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow over slices of bounded text size."""
    named = (columns,) if isinstance(columns, str) else columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, named):
                yield make(part)

    return df.mapInArrow(run, schema)


def components(ws: Workspace, edges: DataFrame, label: str) -> DataFrame:
    """Distributed union-find over ``edges`` (a, b): a row (node, component) for each node but the smallest of each component.

    Alternates large-star and small-star steps: each node's smallest neighbour is a partial aggregate, so a hub of any
    degree is reduced before the shuffle, and every step emits at most two rows an edge. Each round is a table in the
    shared folder. Ends when a round changes nothing. Loops and nulls in ``edges`` are ignored.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent")).distinct()
    current, before, k = ws.save(pairs, f"{label}-0"), None, 0
    while True:
        seen = current.agg(F.count("*"), F.sum(F.xxhash64("child", "parent").cast("decimal(38,0)"))).first()
        if seen == before or not seen[0]:
            return current.select(F.col("child").alias("node"), F.col("parent").alias("component"))
        before = seen
        both = current.select(F.col("child").alias("u"), F.col("parent").alias("v")).union(current.select("parent", "child"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("child"), F.col("m").alias("parent")).distinct()
        small = large.join(large.groupBy("child").agg(F.min("parent").alias("m")), "child")
        both_ends = F.array(F.struct(F.col("child"), F.col("m").alias("parent")), F.struct(F.col("parent").alias("child"), F.col("m").alias("parent")))
        after = small.select(F.inline(both_ends)).where("child <> parent").distinct()
        k += 1
        current = ws.save(after, f"{label}-{k}")
        ws.drop(f"{label}-{k - 1}")
