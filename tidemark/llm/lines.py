"""Operator 9: fuzzy line dedup by MinHash.

A line's set holds the hashes of its character shingles at every position, of the line in lower case without white space
at its ends. One-permutation MinHash deals the shingles to bins and keeps the least of each; ROWS bins are a band, and
lines that share a band are a bucket. Buckets are compared in units of bounded size: a unit holds the lines of one bucket,
or one chunk of a large bucket together with hubs that all its chunks see. A unit's links are decided by the exact Jaccard
similarity of the sets, and it returns a spanning forest of them, never its pairs. Where chunks of a large bucket are still
not connected by the components of all links, the members outside the bucket's largest component meet every other
member. Distributed union-find leaves one line per component: the first by (document, line).

Lines are described and compared by DataFrame functions only. The units are also those of operator 10, whose sets are made
and compared in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import STEP_BYTES, TEXT_ROWS, Workspace, components, steps
from .words import U

#: Characters of a shingle. A pair at similarity 0.8 shares none of 12 bands of 4 with probability (1 - 0.8 ** 4) ** 12 = 0.0018.
WIDTH, BANDS, ROWS = 6, 12, 4
#: Members and shingles of a unit on average, and hubs that the chunks of one bucket share.
MEMBERS, SHINGLES, HUBS = 1024, 1 << 20, 64
#: Members from which a unit has a pivot; members by which it is chosen, and that are tried.
PIVOT_FROM, SAMPLE, PIVOTS = 128, 8, 3
#: Lines of a unit up to which its pairs are listed with those of other units; larger ones are products of matrices.
LISTED = 16
#: Rows of one step, and columns of a matrix.
_STEP_ROWS, _COLUMNS = 1 << 15, 2048
#: The white space that parts words.
SPACE = " \t\n\x0b\f\r"


def slices(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of a list of sizes, each of at most ``most`` in sum or of one item."""
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield slice(start, stop)
        start = stop


class Sets:
    """Sets of elements below 2 ** 48: those of set i are values[bounds[i] : bounds[i + 1]], in order."""

    def __init__(self, values: np.ndarray, bounds: np.ndarray):
        self.values, self.bounds, self.sizes = values, bounds, np.diff(bounds)

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into rows, element) of the sets of some rows."""
        n = self.sizes[rows]
        index = np.repeat(np.arange(len(rows)), n)
        at = np.arange(len(index)) + np.repeat(self.bounds[:-1][rows] - (np.cumsum(n) - n), n)
        return index, self.values[at]

    def links(self, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Whether rows a and b are similar, pair by pair."""
        out = np.minimum(self.sizes[a], self.sizes[b]) * 100 >= np.maximum(self.sizes[a], self.sizes[b]) * percent
        todo = np.flatnonzero(out)
        for part in slices(self.sizes[a[todo]] + self.sizes[b[todo]], STEP_BYTES):
            for k in range(part.start, part.stop, _STEP_ROWS):
                some = todo[k : min(k + _STEP_ROWS, part.stop)]
                both = [(index.astype(U) << U(48)) | x for index, x in (self.of(a[some]), self.of(b[some]))]
                x = np.sort(np.concatenate(both))
                shared = np.bincount((x[1:][x[1:] == x[:-1]] >> U(48)).astype(np.int64), minlength=len(some))
                out[some] = shared * 100 >= percent * (self.sizes[a[some]] + self.sizes[b[some]] - shared)
        return out

    def product(self, rows: np.ndarray, left: np.ndarray, percent: int) -> np.ndarray:
        """Whether the rows at ``left`` (indices into rows) are similar to each of rows, by products of incidence matrices over the shingles that several have."""
        index, x = self.of(rows)
        _, code, n = np.unique(x, return_inverse=True, return_counts=True)
        column = np.cumsum(n > 1) - 1
        some = np.flatnonzero(n[code] > 1)
        index, code = index[some], column[code[some]]
        order = np.argsort(code, kind="stable")
        index, code = index[order], code[order]
        shared = np.zeros((len(left), len(rows)), np.float64)
        for start in range(0, int(code[-1]) + 1 if len(code) else 0, _COLUMNS):
            part = slice(*np.searchsorted(code, [start, start + _COLUMNS]))
            matrix = np.zeros((len(rows), _COLUMNS), np.float32)
            matrix[index[part], code[part] - start] = 1
            shared += matrix[left] @ matrix.T
        sizes = self.sizes[rows]
        return shared * 100 >= percent * (sizes[left][:, None] + sizes[None, :] - shared)


def forest(links: np.ndarray, left: np.ndarray) -> np.ndarray:
    """For each of n nodes the least of its component, where links[i, j] says whether left[i] and j are linked."""
    n = links.shape[1]
    label = np.arange(n)
    while True:
        least = np.where(links, label[None, :], n).min(axis=1, initial=n)
        before, label = label, label.copy()
        np.minimum.at(label, left, least)
        label = np.minimum(label, np.where(links, label[left][:, None], n).min(axis=0, initial=n))
        label = label[label]
        if (label == before).all():
            return label


def solve(batch: pa.RecordBatch, percent: int, most: int, make: Callable[[pa.Array], Sets]) -> pa.RecordBatch:
    """Rows (unit, id, comp, asks, own) of whole units, sorted by unit -> links (a, b) that connect what is connected in each unit.

    Pairs whose ``comp`` is equal are known to be connected. In a unit of more than ``most`` rows only
    those that ask meet the others.
    """
    unit, id, comp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("unit", "id", "comp"))
    asks = batch.column("asks").to_numpy(zero_copy_only=False).astype(bool)
    sets = make(batch.column("own"))
    begins = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
    n = np.diff(np.append(begins, len(unit)))
    listed = []
    for size in range(2, most + 1):
        i, j = np.triu_indices(size, 1)
        at = begins[n == size][:, None]
        listed.append(np.stack([(at + i).ravel(), (at + j).ravel()]))
    i, j = np.concatenate(listed, axis=1)
    other = comp[i] != comp[j]
    i, j = i[other], j[other]
    a, b = np.minimum(id[i], id[j]), np.maximum(id[i], id[j])
    text = batch.column("own").dictionary_encode().indices.to_numpy().astype(np.int64)  # an id may have several texts
    both = np.minimum(text[i], text[j]) * len(unit) + np.maximum(text[i], text[j])
    order = np.lexsort((both, b, a))
    a, b, i, j, both = a[order], b[order], i[order], j[order], both[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (both[1:] != both[:-1]))[: len(a)]
    a, b, i, j = a[new], b[new], i[new], j[new]
    linked = sets.links(i, j, percent)
    heads, tails = [a[linked]], [b[linked]]
    for start, size in zip(begins[n > most], n[n > most]):
        rows = np.arange(start, start + size)
        left = np.flatnonzero(asks[rows])
        label = forest(sets.product(rows, left, percent), left)
        more = np.flatnonzero(label != np.arange(size))
        heads.append(id[rows[label[more]]])
        tails.append(id[rows[more]])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(heads)), pa.array(np.concatenate(tails))], ["a", "b"])


def meet(rows: DataFrame, percent: int) -> DataFrame:
    """Rows (unit, bucket, id, comp, asks, buckets, own) -> links (a, b) that connect what is connected in each unit, by DataFrame functions.

    Each member in turn meets the later ones that it is not connected with yet, if one of both asks, and the labels of those
    that it is similar to become its own. A pair that shares several buckets meets in the least of them only. Sets are held
    as their differences from a pivot, see ``against_pivot``.
    """

    def similar(x: Column, y: Column) -> Column:
        enough = lambda shared: shared * (100 + percent) >= (x["n"] + y["n"]) * percent
        return enough(most_shared(x, y)) & (F.array_min(F.array_intersect(x["buckets"], y["buckets"])) == F.col("bucket")) & enough(shared_by(x, y))

    def labels(members: Column) -> Column:
        def step(label: Column, i: Column) -> Column:
            x = members[i]
            near = F.filter(F.sequence(i, F.size(members) - 1), lambda j: (label[i] != label[j]) & (x["asks"] | members[j]["asks"]) & similar(x, members[j]))
            merged = lambda found: F.when(F.size(found) == 0, label).otherwise(F.transform(label, lambda c: F.when(F.array_contains(found, c), label[i]).otherwise(c)))
            return once(F.transform(near, lambda j: label[j]), merged)

        return F.aggregate(F.sequence(F.lit(0), F.size(members) - 1), F.transform(members, lambda m: m["comp"]), step)

    fields = ["id", "comp", "asks", "buckets"]
    units = rows.groupBy("unit").agg(F.any_value("bucket").alias("bucket"), F.collect_list(F.struct(*fields, "own")).alias("members")).where(F.size("members") > 1)
    sets = F.transform("members", lambda m: F.struct(*[m[c].alias(c) for c in fields], shingle_set(m["own"]).alias("set")))
    joined = lambda members: F.zip_with(F.transform(members, lambda m: m["comp"]), labels(members), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    links = once(sets, lambda members: once(against_pivot(members, fields), joined))
    return units.select(F.inline(F.filter(F.array_distinct(links), lambda link: link["a"] != link["b"])))


def against_pivot(members: Column, fields: list[str]) -> Column:
    """Members with sets -> ``fields``, n (size of the set), near (elements in the pivot), plus (those that aren't), minus (those of the pivot that the set lacks), whole (size of the pivot).

    The pivot is the set of one of the first members, the nearest to a sample of all; it is empty in a small unit, and where
    members are unlike it, so that differences would be no smaller than the sets. It decides the cost only: see ``shared_by``.
    """
    some = F.slice(members, 1, SAMPLE)
    total = lambda sizes: F.aggregate(sizes, F.lit(0), lambda a, b: a + b)
    score = lambda t: total(F.transform(some, lambda m: F.size(F.array_intersect(t["set"], m["set"]))))
    best = F.array_max(F.transform(F.slice(members, 1, PIVOTS), lambda t: F.struct(score(t).alias("score"), t["set"].alias("set"))))
    none = F.array().cast("array<bigint>")
    found = once(best, lambda b: F.when(b["score"] * 2 >= total(F.transform(some, lambda m: F.size(m["set"]))), b["set"]).otherwise(none))

    def apart(pivot: Column) -> Column:
        def one(m: Column) -> Column:
            plus = F.when(F.size(pivot) == 0, m["set"]).otherwise(F.array_except(m["set"], pivot))
            minus = F.when(F.size(pivot) == 0, pivot).otherwise(F.array_except(pivot, m["set"]))
            own = [F.size(m["set"]).alias("n"), plus.alias("plus"), F.size(pivot).alias("whole")]
            return once(minus, lambda minus: F.struct(*[m[c].alias(c) for c in fields], *own, (F.size(pivot) - F.size(minus)).alias("near"), minus.alias("minus")))

        return F.transform(members, one)

    return once(F.when(F.size(members) >= PIVOT_FROM, found).otherwise(none), apart)


def most_shared(x: Column, y: Column) -> Column:
    """A bound on the elements that two sets share, from their sizes and those of their parts in the pivot."""
    return F.least(x["near"], y["near"]) + F.least(x["n"] - x["near"], y["n"] - y["near"])


def shared_by(x: Column, y: Column) -> Column:
    """How many elements two sets share: of the pivot all that neither lacks, and what both have besides."""
    both = lambda part: F.size(F.array_intersect(x[part], y[part]))
    return x["near"] + y["near"] - x["whole"] + both("minus") + both("plus")


def once(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), where x is a variable of a lambda, so that it is made once."""
    return F.transform(F.array(x), use)[0]


def compare(ws: Workspace, rows: DataFrame, lines: DataFrame, percent: int, name: str, make: Callable[[pa.Array], Sets] | None) -> DataFrame:
    """The links (a, b) within the units of ``rows`` (unit, bucket, id, comp, asks); lines: (id, own), without ``make`` with their buckets too."""
    if make is None:
        return ws.save(meet(rows.join(lines, "id"), percent), name)
    most = LISTED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in (part for whole in batches for part in steps(whole, ("own",))):
            held.append(batch)
            size += batch.nbytes
            if size > STEP_BYTES or sum(x.num_rows for x in held) > _STEP_ROWS:
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                unit = whole.column("unit").to_numpy()
                last = int(np.searchsorted(unit, unit[-1]))  # rows are sorted by unit
                if last:
                    yield solve(whole.slice(0, last), percent, most, make)
                held = [whole.slice(last)]
                size = held[0].nbytes
        if held:
            yield solve(pa.Table.from_batches(held).combine_chunks().to_batches()[0], percent, most, make)

    texts = rows.join(lines, "id").select("unit", "id", "comp", "asks", "own")
    found = texts.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "a long, b long")
    return ws.save(found, name, TEXT_ROWS)


def chunks(total: Column, n: Column) -> Column:
    """Units among which n lines of ``total`` shingles are dealt."""
    return F.least(n, F.greatest(F.ceil(n / MEMBERS), F.ceil(total / SHINGLES))).cast("int")


def dealt(salt: int, k: str | Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), "id"), k).cast("int")


def link_lines(ws: Workspace, live: DataFrame, lines: DataFrame, percent: int, make: Callable[[pa.Array], Sets] | None = None) -> DataFrame:
    """(node, component) for members of components of two or more. live: (bucket, id, size); lines: (id, own); make: the sets of ``own`` in Arrow batches; without it the sets are those of lines, by DataFrame functions.

    Buckets with the same members, as a pair of near copies has in most bands, are one bucket.
    """
    whole = [F.min("id").alias("low"), F.max("id").alias("high"), F.bit_xor(F.xxhash64("id")).alias("mark"), F.count("*").alias("n"), F.sum("size").alias("total")]
    stats = live.groupBy("bucket").agg(*whole).groupBy("low", "high", "mark", "n", "total").agg(F.min("bucket").alias("bucket"))
    live = ws.save(live.join(stats.select("bucket", "low", chunks(F.col("total"), F.col("n")).alias("k")), "bucket"), "dealt")
    if make is None:
        lines = lines.join(live.groupBy("id").agg(F.collect_set("bucket").alias("buckets")), "id")
    unit = F.xxhash64("bucket", "chunk").alias("unit")
    members = live.select("bucket", "id", dealt(0, "k").alias("chunk"))
    share = F.ceil(F.col("k") * MEMBERS / HUBS)
    hubs = live.where("k > 1").where((dealt(1, share) == 0) | F.expr("id = low")).select("bucket", "id", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("chunk"))
    rows = members.union(hubs).select(unit, "bucket", "id", F.col("id").alias("comp"), F.lit(True).alias("asks"))
    found = compare(ws, rows, lines, percent, "links", make)
    known = components(ws, found, "first")
    large = live.where("k > 1")
    if not large.limit(1).count():
        return known
    # in large buckets, all outside the largest component meet all
    large = ws.save(large.join(known, F.col("id") == F.col("node"), "left").select("bucket", "id", "size", "k", F.coalesce("component", "id").alias("comp")), "large")
    each = large.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    mixed = ws.save(each.groupBy("bucket").agg(F.max_by("comp", "n").alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts"), "mixed")
    large = large.join(mixed, "bucket")
    asking = large.where("comp <> main")
    blocks = ws.save(asking.groupBy("bucket").agg(chunks(F.sum("size"), F.count("*")).alias("m")), "blocks")
    unit = F.xxhash64("bucket", "block", "chunk").alias("unit")
    every = lambda k, name: F.explode(F.sequence(F.lit(0), F.col(k) - 1)).alias(name)
    asking = asking.join(blocks, "bucket").select("bucket", "id", "comp", dealt(2, "m").alias("block"), every("k", "chunk")).select(unit, "bucket", "id", "comp", F.lit(True).alias("asks"))
    asked = large.join(blocks, "bucket").select("bucket", "id", "comp", dealt(0, "k").alias("chunk"), every("m", "block")).select(unit, "bucket", "id", "comp", F.lit(False).alias("asks"))
    more = compare(ws, asking.union(asked), lines, percent, "more", make)
    return components(ws, found.union(more), "second")


def folded(line: Column) -> Column:
    """A line in lower case, without white space at its ends."""
    own = F.ltrim(line, F.lit(SPACE))
    ends = F.lit(False)
    for c in SPACE:
        ends = ends | F.endswith(own, F.lit(c))
    return F.when(ends, F.rtrim(own, F.lit(SPACE))).otherwise(own)


def keys(line: Column) -> tuple[Column, Column]:
    """A line's two hashes, 128 bits together."""
    return F.xxhash64(line), F.xxhash64(F.lit(1), line)


def starts(wide: Column) -> Column:
    """Where the shingles of a line in UTF-32 begin, from 1: at every character; a shorter line is one shingle."""
    return F.sequence(F.lit(1), F.greatest(F.octet_length(wide) - (4 * WIDTH - 1), F.lit(1)), F.lit(4))


def hashed(wide: Column, start: Column) -> Column:
    return F.xxhash64(F.substring(wide, start, F.lit(4 * WIDTH)))


def shingle_set(own: Column) -> Column:
    """The distinct shingles of a line."""
    return F.array_distinct(once(F.encode(own, "UTF-32"), lambda wide: F.transform(starts(wide), lambda i: hashed(wide, i))))


def occurrences(source: DataFrame) -> DataFrame:
    """(doc, row, at, id, k2), a row per line with a word of ``source`` (doc, row, text in lower case)."""
    every = source.select("doc", "row", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    every = every.select("doc", "row", "at", folded(F.col("line")).alias("own")).where("own <> ''")
    first, second = keys(F.col("own"))
    return every.select("doc", "row", "at", first.alias("id"), second.alias("k2"))


def cut(source: DataFrame, heads: DataFrame) -> DataFrame:
    """(place, id, own): the lines of ``heads`` (id, first), read at their first places. source is bucketed by place."""
    first = heads.select("id", "first.*").select(F.xxhash64("doc", "row").alias("place"), F.struct("at", "id").alias("line"))
    wanted = first.groupBy("place").agg(F.collect_list("line").alias("wanted"))
    parts = source.join(wanted, "place").select("place", "wanted", F.split("text", "\n").alias("parts"))  # below the generator, so once a text
    parts = parts.select("place", "parts", F.explode("wanted").alias("line"))
    own = parts.select("place", "line.id", folded(F.get("parts", F.col("line.at"))).alias("own"))
    mark, other = keys(F.col("own"))
    return own.where((F.col("id") == mark) | (F.col("id") == other))  # places are hashes


def signed(lines: DataFrame) -> DataFrame:
    """(place, id, own) -> (place, id, band, size, b0 ..): the positions of the line and the least hash of each bin, for each band that holds a shingle. A table bucketed by place needs no shuffle."""
    wide = lines.select("place", "id", F.encode("own", "UTF-32").alias("wide"))
    rows = wide.select("place", "id", "wide", F.explode(starts(F.col("wide"))).alias("start"))
    positions = F.greatest(F.shiftright(F.octet_length("wide"), 2) - (WIDTH - 1), F.lit(1)).cast("long")
    rows = rows.select("place", "id", positions.alias("size"), hashed(F.col("wide"), F.col("start")).alias("h"))
    rows = rows.select("place", "id", "size", F.pmod(F.shiftright("h", 8), F.lit(BANDS)).alias("band"), F.col("h").bitwiseAND(F.lit(ROWS - 1)).alias("bin"), F.shiftright("h", 32).cast("int").alias("value"))
    return rows.groupBy("place", "id", "band").agg(F.max("size").alias("size"), *[F.min(F.when(F.col("bin") == r, F.col("value"))).alias(f"b{r}") for r in range(ROWS)])


def identified(ws: Workspace, source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, row, at, id) of the lines with a word, and a table (id, n, first) bucketed by id: how many there are of a line, and its first place (doc, at, row).

    id is the first hash of a line, but the second one where several lines have the same first one.
    """
    found = ws.save(occurrences(source), "found")
    whole = [F.min("k2").alias("low"), F.max("k2").alias("high"), F.count("*").alias("n"), F.min(F.struct("doc", "at", "row")).alias("first")]
    heads = ws.bucketed(found.groupBy("id").agg(*whole), "heads", "id")
    same = heads.where("low <> high").select(F.col("id").alias("same"))
    if same.limit(1).count():
        found = found.join(same, F.col("id") == F.col("same"), "left").withColumn("id", F.when(F.col("same").isNull(), F.col("id")).otherwise(F.col("k2")))
        found = ws.save(found.select("doc", "row", "at", "id", "k2"), "parted")
        ws.drop("found", "heads")
        heads = ws.bucketed(found.groupBy("id").agg(*whole), "parted_heads", "id")
    return found.select("doc", "row", "at", "id"), heads.select("id", "n", "first")


def duplicate_lines(docs: DataFrame, ws: Workspace, id: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """(doc, row, at) of every line that isn't the first of its component; row is a hash of its document's text."""
    source = docs.where(F.col(f"`{id}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    source = source.select(F.col(f"`{id}`").cast("long").alias("doc"), F.xxhash64(F.col(f"`{text}`")).alias("row"), F.lower(F.col(f"`{text}`")).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # one file a bucket
    source = ws.bucketed(source.withColumn("place", F.xxhash64("doc", "row")).repartition(parts, "place"), "source", "place")
    found, heads = identified(ws, source)
    mins = [f"b{r}" for r in range(ROWS)]
    # rows that repeat an id with its text have a place in common, so a line has its bands once
    members = signed(cut(source, heads)).select(F.xxhash64("band", *mins).alias("bucket"), "id", "size")
    # a sort, whose memory is bounded, finds the buckets that are shared
    bucket = Window.partitionBy("bucket")
    members = members.select("bucket", "id", "size", F.min("id").over(bucket).alias("low"), F.max("id").over(bucket).alias("high"))
    live = ws.save(members.where("low < high").select("bucket", "id", "size"), "live")
    own = cut(source, heads.join(live.select("id").distinct(), "id", "left_semi"))
    lines = ws.bucketed(own.groupBy("id").agg(F.any_value("own").alias("own")), "lines", "id")
    ws.drop("source")
    linked = link_lines(ws, live, lines, percent)
    ws.drop("live", "dealt", "lines", "links", "large", "mixed", "blocks", "more")
    # lines that are there again, or have a component, and the first place of all of it
    again = heads.join(linked, F.col("id") == F.col("node"), "left").select("id", "n", "first", F.coalesce("component", "id").alias("component"))
    least = linked.select(F.col("component").alias("id")).distinct().withColumn("linked", F.lit(True))
    again = ws.save(again.join(least, "id", "left").where("n > 1 or id <> component or linked").select("id", "first", "component"), "again")
    top = again.groupBy("component").agg(F.min("first").alias("top"))
    again = ws.save(again.join(top, "component").select("id", "top.doc", "top.at").toDF("again", "top_doc", "top_at"), "tops")
    placed = found.select("doc", "row", "at", "id").join(again, F.col("id") == F.col("again"))
    out = ws.save(placed.where("doc <> top_doc or at <> top_at").select("doc", "row", "at"), "duplicates")
    ws.drop("found", "parted", "heads", "parted_heads", "again", "tops")
    return out


def line_report(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """One row per document that loses lines: id, n_removed, removed_lines (sorted, from 0).

    Lines are the parts between line feeds, over whole texts. Lines without a word are left alone, as are documents with a
    null id; a null text has no lines. Rows that repeat an id count as one document. Equal lines are one class and are
    tested once. An empty table gives an empty result. Other columns aren't read.
    """
    found = duplicate_lines(docs, Workspace(docs.sparkSession, "lines"), id, text, percent)
    lines = F.array_sort(F.collect_set("at"))
    return found.groupBy(F.col("doc").alias(id)).agg(F.countDistinct("at").alias("n_removed"), lines.alias("removed_lines"))


def remove_duplicate_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """``docs`` with its columns, without lines that repeat an earlier one; documents that lose all their words go.

    Nulls, repeats and an empty table as in ``line_report``. A line is removed where both its place and its text's hash
    were found, so rows that share an id are safe. Columns of any name pass through.
    """
    found = duplicate_lines(docs, Workspace(docs.sparkSession, "lines"), id, text, percent)
    lost = found.groupBy("doc", F.col("row").alias("hash")).agg(F.collect_set("at").alias("drops"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    own = F.col("row")[text]
    joined = whole.join(lost, (F.col("row")[id].cast("long") == F.col("doc")) & (F.xxhash64(own) == F.col("hash")), "left")
    kept = F.filter(F.split(own, "\n"), lambda line, i: ~F.array_contains("drops", i))
    out = joined.select("row", F.when(F.col("drops").isNull(), own).otherwise(F.array_join(kept, "\n")).alias("left"), F.col("drops").isNull().alias("whole"))
    out = out.where(F.col("whole") | (F.ltrim(F.regexp_replace("left", "\n", " "), F.lit(SPACE)) != ""))
    return out.select(*[(F.col("left") if c == text else F.col("row")[c]).alias(c) for c in docs.columns])
