"""Operator 7: near-duplicate embeddings by spherical-cap filters.

Filters are directions from a random product code: after a fixed random rotation a vector is cut into two blocks, each
block has a codebook of random unit vectors, and every pair of codewords is a direction. A vector is list-decoded to the
directions nearest to it, as many as random pairs at the least cosine need in this very code to share one. Vectors of one
label that share a direction are compared in double precision.

A bucket is compared block against block by matrix products. What leaves a comparison is a sum of links and a local
component for each vector, never its pairs. A pair that meets in several buckets counts in the first they share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, components

#: Directions of a vector and rows of a bucket that the number of codewords is set for, rows of a block.
LIST, BUCKET, BLOCK = 32, 24, 1024
#: Random pairs at the least cosine of which none may miss (a pair misses with a chance of 1 in TRIALS + 1, below 0.0008
#: with 95 % confidence), and directions of a vector at most: a code that needs more is replaced by one of fewer words.
TRIALS, MOST = 4096, 256


#: Codewords of a block at most: the pairs of them are numbered by 32 bits. Up to 1.6 billion vectors of a label need fewer.
WORDS = 46_340


class Code:
    def __init__(self, dim: int, words: int, seed: int = 7):
        rng = np.random.Generator(np.random.PCG64([seed, dim, words]))
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.dim, self.half, self.words = dim, max(1, dim // 2), words
        books = [rng.standard_normal((words, n)) for n in (self.half, max(1, dim - self.half))]
        self.books = [b / np.linalg.norm(b, axis=1, keepdims=True) for b in books]

    def decode(self, unit: np.ndarray, n: int) -> np.ndarray:
        """The n nearest directions of each unit vector (all of them, if there are fewer), nearest first."""
        x = unit @ self.rotation
        first = x[:, : self.half] @ self.books[0].T
        second = (x[:, self.half :] if x.shape[1] > self.half else np.zeros((len(x), 1))) @ self.books[1].T
        (i, a), (j, b) = (_best(s, n) for s in (first, second))
        # the p-th and the q-th word make one of the n nearest only if p * q <= n
        rank = np.arange(1, a.shape[1] + 1)
        p, q = np.nonzero(np.outer(rank, rank) <= n)
        top = _best(a[:, p] + b[:, q], n)[0]
        return np.take_along_axis(i[:, p] * self.words + j[:, q], top, 1)

    def enough(self, least: float) -> int | None:
        """The list length with which none of TRIALS random pairs at cosine ``least`` misses, or None above MOST.

        The code is rotated at random, so the chance is the same for every pair of vectors at that cosine.
        """
        rng = np.random.Generator(np.random.PCG64([self.dim, self.words]))
        cosine, need = min(least, 0.999), 1
        for _ in range(0, TRIALS, 256):
            x, y = rng.standard_normal((2, 256, self.dim))
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            y -= (x * y).sum(axis=1, keepdims=True) * x
            y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
            y = cosine * x + np.sqrt(1 - cosine**2) * y
            for f, g in zip(self.decode(x, MOST), self.decode(y, MOST), strict=True):
                _, at, to = np.intersect1d(f, g, assume_unique=True, return_indices=True)
                if not len(at):
                    return None
                need = max(need, int(np.maximum(at, to).min()) + 1)
        return need


def _best(s: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the n largest values of each row, largest first, and the values."""
    n = min(n, s.shape[1])
    at = np.argpartition(-s, n - 1, axis=1)[:, :n]
    at = np.take_along_axis(at, np.argsort(-np.take_along_axis(s, at, 1), axis=1, kind="stable"), 1)
    return at, np.take_along_axis(s, at, 1)


def lists(dim: int, words: int, least: float) -> tuple[int, int]:
    """Codewords, ``words`` or fewer, and the list length for them.

    A vector meets n * n / words**2 of the others. Where no code makes that less than all, one direction holds all vectors.
    """
    while words > 1:
        n = Code(dim, words).enough(least)
        if n and n < words:
            return words, n
        words //= 2
    return 1, 1


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the most common length as doubles, and which rows of the batch they are: finite and not all zero."""
    values = column.cast(pa.list_(pa.float64()))
    lists = [None if x is None else x for x in values.to_numpy(zero_copy_only=False)]
    good = [i for i, x in enumerate(lists) if x is not None and len(x) and np.isfinite(x).all() and np.any(x)]
    return np.array(good, np.int64), [lists[i] for i in good]


def coded(source: DataFrame, plan: dict[int, tuple[int, int]]) -> DataFrame:
    """(id, label, embedding) -> the vectors that can link: id, label, dim, vector (binary doubles), directions.

    plan: codewords and list length by dimension, see ``lists``.
    """
    codes: dict[int, Code] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, vectors = _vectors(batch.column("embedding"))
            sizes = np.array([len(v) for v in vectors], np.int64)
            for dim in np.unique(sizes).tolist():
                words, n = plan[dim]
                if dim not in codes:
                    codes[dim] = Code(dim, words)
                some = np.flatnonzero(sizes == dim)
                for k in range(0, len(some), 2048):
                    part = some[k : k + 2048]
                    x = np.stack([vectors[i] for i in part])
                    scaled = x / np.abs(x).max(axis=1, keepdims=True)
                    unit = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
                    found = np.concatenate([codes[dim].decode(unit[i : i + 256], n) for i in range(0, len(unit), 256)]).astype(np.int32)
                    directions = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))
                    rows = batch.select(["id", "label"]).take(pa.array(at[part]))
                    yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(np.full(len(part), dim, np.int32)), pa.array([r.tobytes() for r in scaled], pa.binary()), directions], ["id", "label", "dim", "vector", "directions"])

    return source.mapInArrow(run, "id long, label string, dim int, vector binary, directions array<int>")


def _compare(group: pd.DataFrame, direction: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Ids with links, the weights they gain, and their local component; pairs of one block on both sides count once."""
    sides = [group[group["block"] == b] for b in sorted(group["block"].unique())]
    a, b = sides[0], sides[-1]
    x, y = (np.frombuffer(b"".join(s["vector"]), np.float64).reshape(len(s), -1) for s in (a, b))
    close = (x @ y.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(y, axis=1)[None, :] >= least
    if len(sides) == 1:
        np.fill_diagonal(close, False)
    if not close.any():
        return None
    flat = np.concatenate([*a["directions"], *b["directions"]])
    earlier = np.unique(flat[flat < direction])
    if len(earlier):
        member = []
        for s in (a, b):
            m = np.zeros((len(s), len(earlier)), np.float32)
            row = np.repeat(np.arange(len(s)), s["directions"].map(len))
            d = np.concatenate(list(s["directions"]))
            keep = d < direction
            m[row[keep], np.searchsorted(earlier, d[keep])] = 1
            member.append(m)
        counted = close & (member[0] @ member[1].T == 0)
    else:
        counted = close
    ids = [s["id"].to_numpy() for s in (a, b)]
    weights = [s["weight"].to_numpy() for s in (a, b)]
    gains = [counted @ weights[1], weights[0] @ counted]
    roots = [ids[0].copy(), ids[1].copy()]
    i, j = np.nonzero(close)
    while True:  # least label over links until nothing changes
        old = roots[0].copy(), roots[1].copy()
        np.minimum.at(roots[0], i, roots[1][j])
        np.minimum.at(roots[1], j, roots[0][i])
        if len(sides) == 1:
            roots[0] = roots[1] = np.minimum(roots[0], roots[1])
        if (old[0] == roots[0]).all() and (old[1] == roots[1]).all():
            break
    if len(sides) == 1:
        return ids[0], gains[0], roots[0]
    return np.concatenate(ids), np.concatenate(gains), np.concatenate(roots)


def near_duplicates(table: DataFrame, id: str = "vec_id", label: str = "label", embedding: str = "embedding", least: float = 0.93) -> DataFrame:
    """One row per row of ``table``: id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null and their cosine is ``least`` or more. Vectors that are null,
    empty, zero or hold a null or non-finite component, or differ in length, link with nothing, nor does a null id. Equal
    vectors of a label are one class with a weight, compared once. Rows that repeat an id are one vector. n_links counts
    other vectors linked directly; component_id is the smallest id reachable, or the row's own. An empty table gives none.
    """
    spark = table.sparkSession
    ws = Workspace(spark, "caps")
    source = table.select(F.col(id).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(embedding).alias("embedding"))
    able = source.where("id is not null and label is not null and embedding is not null")
    most = able.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    words = int(np.clip(np.sqrt(most * LIST / BUCKET), 16, WORDS))
    dims = [r[0] for r in able.select(F.size("embedding")).where(F.size("embedding") > 0).distinct().collect()]
    vectors = ws.save(coded(able, {dim: lists(dim, words, least) for dim in dims}), "coded").withColumn("key", F.sha2("vector", 256))
    classes = ws.save(vectors.groupBy("label", "key").agg(F.min("id").alias("first"), F.countDistinct("id").alias("weight")).where("weight > 1"), "classes")
    of_class = vectors.select("id", "label", "key").join(classes, ["label", "key"]).select("id", "first", "weight").dropDuplicates(["id"])
    of_class = ws.save(of_class, "members")
    first = vectors.join(of_class, "id", "left").where("first is null or id = first").dropDuplicates(["id"])
    first = ws.save(first.select("id", "label", "dim", "vector", "directions", F.coalesce("weight", F.lit(1)).alias("weight")), "first")
    bucket = ["label", "dim", "direction"]
    sizes = first.select("label", "dim", F.explode("directions").alias("direction")).groupBy(*bucket).count().where("count > 1")
    sizes = ws.save(sizes.select(*bucket, F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "buckets")
    rows = first.withColumn("direction", F.explode("directions")).join(sizes, bucket)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    task = [*bucket, "low", "high"]
    rows = rows.select(*bucket, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "weight", "vector", "directions")
    dealt = rows.repartition(*task).sortWithinPartitions(*task)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
            new = (batch[task] != batch[task].shift()).any(axis=1).to_numpy()
            starts = np.flatnonzero(new)
            if not len(starts):
                continue
            yield from judge(batch, starts[:-1], starts[1:])
            held = batch.iloc[starts[-1] :]
        if held is not None and len(held):
            yield from judge(held, [0], [len(held)])

    def judge(batch: pd.DataFrame, starts, ends) -> Iterator[pd.DataFrame]:
        out = []
        for s, e in zip(starts, ends, strict=True):
            group = batch.iloc[s:e]
            low, high = group["low"].iloc[0], group["high"].iloc[0]
            if e - s < 2 or (low != high and group["block"].nunique() < 2):
                continue
            if found := _compare(group, int(group["direction"].iloc[0]), least):
                out.append(pd.DataFrame({"id": found[0], "gain": found[1], "root": found[2]}))
        if out:
            rows = pd.concat(out, ignore_index=True)
            yield rows[(rows["gain"] > 0) | (rows["id"] != rows["root"])]

    links = ws.save(dealt.mapInPandas(run, "id long, gain long, root long"), "links")
    gained = ws.save(links.groupBy("id").agg(F.sum("gain").alias("gain")), "gained")
    known = components(ws, links.select(F.col("id").alias("a"), F.col("root").alias("b")), "component")
    out = source.select("id").join(of_class, "id", "left").withColumn("rep", F.coalesce("first", "id"))
    out = out.join(gained.withColumnRenamed("id", "rep"), "rep", "left").join(known.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("component", "rep")
    n = F.coalesce("gain", F.lit(0)) + F.coalesce("weight", F.lit(1)) - 1
    return out.select(F.col("id").alias(id), n.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
