"""Operator 10: near-duplicate documents by fast similarity sketching.

Dahlgaard, Knudsen and Thorup, "Fast Similarity Sketching" (FOCS 2017): in round i < t every element is placed in a
hashed one of t bins with a hashed value in [i, i + 1); in round t + i all elements go to bin i. A bin keeps its least
value, and a set is done as soon as no bin is empty. So all t coordinates fill within 2 t rounds, agree with probability
equal to the Jaccard similarity and are concentrated about it as t independent ones, for O(n + t log t) hashes.

Bands of coordinates give the candidates, and word-shingle sets of the whole texts decide: buckets are compared in the units
of bounded size of ``lines``, which return spanning links and never pairs.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP_BYTES, Workspace, map_steps
from .lines import Sets, link_lines, slices
from .words import U, Texts, distinct, mix

#: A pair at similarity 0.8 shares none of 24 bands of 5 with probability (1 - 0.8 ** 5) ** 24 = 0.00007.
BANDS, BAND_ROWS = 24, 5
_VALUE_BITS = 44


def shingle_sets(texts: Texts, k: int, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text index, shingle hash) rows; a text of fewer than k words has its whole sequence as one shingle."""
    words = texts.words(fold)
    hashes, at = texts.windows(words, k)
    few = np.flatnonzero((texts.n_words > 0) & (texts.n_words < k))
    whole = np.full(len(few), 0x51ED270B, U)
    for j in range(k - 1):
        more = texts.n_words[few] > j
        whole[more] = whole[more] * U(0x9E3779B97F4A7C15) + words[texts.first_word[:-1][few[more]] + j]
    return distinct(np.concatenate([texts.text_of[at], few]), np.concatenate([hashes, mix(whole + texts.n_words[few].astype(U))]))


def sketch(group: np.ndarray, values: np.ndarray, n: int, t: int) -> np.ndarray:
    """t coordinates for each of n sets, given as distinct (set, element) rows sorted by set; an empty set keeps the largest integer."""
    full = np.iinfo(U).max
    out = np.full(n * t, full, U)
    todo = np.ones(len(group), bool)
    for i in range(2 * t):
        group, values = group[todo], values[todo]
        if not len(group):
            break
        h = mix(values ^ mix(np.array([i + 1], U))[0])
        bins = ((h >> U(_VALUE_BITS)) % U(t)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, group * t + bins, (U(i) << U(_VALUE_BITS)) | (h & U((1 << _VALUE_BITS) - 1)))
        todo = (out.reshape(n, t) == full).any(axis=1)[group]
    return out.reshape(n, t)


def bands(sketches: np.ndarray, n_bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(sketches), n_bands), U)
    for b in range(n_bands):
        h = np.full(len(sketches), b + 1, U)
        for r in range(rows):
            h = mix(h * U(0x9E3779B97F4A7C15) + sketches[:, b * rows + r])
        out[:, b] = h
    return out


def describe(df: DataFrame, k: int, n_bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """(id, text) -> (id, size, key1, key2, bands): the size of the shingle set, a 128-bit key of it and its band keys."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = Texts(batch.column("text"))
        group, values = shingle_sets(texts, k)
        sizes = np.bincount(group, minlength=texts.n)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        keys = []
        for salt in (1, 2):
            sums = np.zeros(len(values) + 1, U)
            np.cumsum(mix(values + U(salt)), out=sums[1:])
            keys.append((sums[ends[1:]] - sums[ends[:-1]]).view(np.int64))
        made = bands(sketch(group, values, texts.n, n_bands * rows), n_bands, rows)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(texts.n + 1, dtype=np.int32) * n_bands), pa.array(made.view(np.int64).ravel()))
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes.astype(np.int64)), pa.array(keys[0]), pa.array(keys[1]), lists], ["id", "size", "key1", "key2", "bands"])

    return map_steps(df, "text", make, "id long, size long, key1 long, key2 long, bands array<long>")


def document_sets(own: pa.Array, k: int) -> Sets:
    """The sets of k-word shingles of whole texts; equal 64-bit hashes have equal numbers."""
    groups, values = [], []
    sizes = np.diff(np.frombuffer(own.buffers()[1], np.int32)[own.offset : own.offset + len(own) + 1].astype(np.int64))
    for part in slices(sizes, STEP_BYTES):
        group, found = shingle_sets(Texts(own.slice(part.start, part.stop - part.start)), k)
        groups.append(group + part.start)
        values.append(found)
    numbers = np.unique(np.concatenate(values), return_inverse=True)[1]
    return Sets(numbers.astype(U), np.searchsorted(np.concatenate(groups), np.arange(len(own) + 1)))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, n_bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    Links are the pairs of different ids whose sets of lower-cased k-word shingles have a Jaccard similarity of percent / 100
    or more; component_id is the smallest id reachable over links, and kept says that the row has that id.

    Null and word-less texts have an empty set and link with nothing. A null id links with nothing, has a null
    component_id and is kept. Rows that repeat an id count as one document. Equal sets are one class, tested once;
    of n copies no pair is made. An empty table gives an empty result. Other columns of ``docs`` aren't read.
    """
    ws = Workspace(docs.sparkSession, "minhash")
    source = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    signed = ws.save(describe(source, k, n_bands, rows), "signed")
    some = signed.where("size > 0 and id is not null")
    key = ["key1", "key2", "size"]
    classes = ws.save(some.groupBy(*key).agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "classes")
    first = some.join(classes, key, "left").where("first is null or id = first")
    members = first.select(F.explode("bands").alias("bucket"), "id", "size")
    shared = ws.save(members.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("bucket"), "buckets")
    live = ws.save(members.join(shared, "bucket").groupBy("bucket", "id").agg(F.max("size").alias("size")), "members")
    ids = live.select("id").distinct()
    # one partition an id, so that the copies of a text need no shuffle of their own and a bucket is one file
    texts = source.join(ids, "id", "left_semi").select("id", F.col("text").alias("own")).where("own is not null").repartition("id").distinct()
    texts = ws.bucketed(texts, "texts", "id")
    linked = link_lines(ws, live, texts, percent, partial(document_sets, k=k))
    ws.drop("texts", "members", "buckets", "dealt", "links", "large", "mixed", "blocks", "more")
    out = signed.join(classes, key, "left").withColumn("rep", F.expr("case when size > 0 then coalesce(first, id) else id end"))
    out = out.join(linked, out["rep"] == linked["node"], "left")
    component = F.coalesce("component", "rep")
    return out.select(F.col("id").alias(id), F.col("size").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
