"""Operator 2: passages that repeat, by sparse suffix arrays over words.

Suffixes are retained where a minimiser falls: of each WINDOW neighbouring word positions, the one whose PIECE-word hash
is least. The choice depends on the words alone, so every passage of LEAST words that occurs twice has a suffix in both
places at the same distance from its start, and from there at least HEAD = LEAST - WINDOW + 1 words agree. The retained
suffixes are sorted by their first HEAD words, then by place, and compared with their neighbours: a run of equal heads is
headed by its first place. Each match with the head is extended left and right over the whole texts, and counts from LEAST
words on. Members of a run of three or more may share more with one another than with its head, whether they match that or
not: for those runs all windows of LEAST words around the suffixes are sorted in a second round, in which no match can fall short.

Equal texts are one class, of which one is looked at. Sorting is by range over (head, document, place), so one head
of any number of suffixes is spread over partitions; a run that crosses a border is headed by its first place in the partition
where it begins, so the result doesn't depend on the partitions. The text of a document that heads many others is copied for
every share of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TEXT_ROWS, Workspace, map_steps
from .words import U, Texts, mix, roll

#: Words of a passage that counts, neighbouring positions of which one is retained, and words that its hash covers.
LEAST, WINDOW, PIECE = 50, 20, 8
HEAD = LEAST - WINDOW + 1
#: Shares of the documents that refer to one, each of which joins its own copy of that one's text.
COPIES = 64
#: Names of a text's hashes.
KEYS = ["k1", "k2", "k3"]


def hashes(text: str) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), F.length(text).alias("k3")]


def retained(texts: Texts, words: np.ndarray) -> np.ndarray:
    """Indices of the words at which suffixes are retained: minimisers with HEAD words left in their text."""
    if len(words) < HEAD:
        return np.zeros(0, np.int64)
    hashes = mix(roll(words, PIECE))
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW)
    least = np.concatenate([views[i : i + 65536].argmin(axis=1) for i in range(0, n, 65536)]) + np.arange(n)
    # only windows that a passage of LEAST words of one text begins with
    starts = np.arange(n)
    good = starts + LEAST <= texts.first_word[1:][texts.text_of[:n]]
    return np.unique(least[good])


def suffixes(docs: DataFrame) -> DataFrame:
    """(doc, text) -> (head, doc, at): the retained suffixes."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = Texts(batch.column("text"))
        words = texts.words()
        at = retained(texts, words)
        heads = roll(words, HEAD)[at] if len(at) else np.zeros(0, U)
        text = texts.text_of[at]
        return pa.RecordBatch.from_arrays([pa.array(heads.view(np.int64)), batch.column("doc").take(pa.array(text)), pa.array((at - texts.first_word[text]).astype(np.int32))], ["head", "doc", "at"])

    return map_steps(docs, "text", make, "head long, doc long, at int")


def whole_windows(anchors: DataFrame) -> DataFrame:
    """(doc, ats, text) -> (head, doc, at): every window of LEAST words that can have one of the suffixes ats as its own."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = Texts(batch.column("text"))
        hashes, first = texts.windows(texts.words(), LEAST)
        inside = np.zeros(len(texts.starts) + 1, bool)
        for i, ats in enumerate(batch.column("ats").to_pylist()):
            for at in ats:
                inside[texts.first_word[i] + max(0, at - WINDOW + 1) : texts.first_word[i] + at + 1] = True
        keep = inside[first]
        text = texts.text_of[first[keep]]
        return pa.RecordBatch.from_arrays([pa.array(hashes[keep].view(np.int64)), batch.column("doc").take(pa.array(text)), pa.array((first[keep] - texts.first_word[text]).astype(np.int32))], ["head", "doc", "at"])

    return map_steps(anchors, "text", make, "head long, doc long, at int")


def neighbours(ws: Workspace, table: DataFrame, name: str) -> DataFrame:
    """(head, doc, at, to_doc, to_at, many): each suffix that isn't the first of its run, the first one, and 1 where the run has or may have three.

    A partition's first run may go on from the one before. Its rows name the first place in this partition, which two rows
    per partition, one for each end, map to the first place of the whole run.
    """
    ordered = table.repartitionByRange("head", "doc", "at").sortWithinPartitions("head", "doc", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, carry, before, first = TaskContext.get().partitionId(), None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            head, doc, at = (batch.column(c).to_numpy() for c in ("head", "doc", "at"))
            if carry is not None:
                head, doc, at = (np.concatenate([[x], c]) for x, c in zip(carry, (head, doc, at), strict=True))
            first = first or (head[0], doc[0], at[0])
            out, before = members(head, doc, at, before, first)
            carry = (head[-1], doc[-1], at[-1])
            yield rows(*(c[:-1][out[0][:-1]] for c in (head, doc, at, *out[1:])), -1)
        if carry is not None:
            head, doc, at = (np.array([x]) for x in carry)
            out, _ = members(head, doc, at, before, first, True)
            yield rows(*(c[out[0]] for c in (head, doc, at, *out[1:])), -1)
            yield rows(*(np.array([x]) for x in (*first, -1, -1, 0)), 2 * task)
            yield rows(head, doc, at, out[1], out[2], out[3], 2 * task + 1)

    def members(head, doc, at, before, first, ends=False):
        """Which rows aren't the first of their run; that one's doc and at, and whether the run may have three rows; and what the last row's run has before it."""
        n = len(head)
        new = np.concatenate([[before is None or head[0] != before[0]], head[1:] != head[:-1]])
        index = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        to_doc = np.where(index >= 0, doc[index], before[1] if before else 0)
        to_at = np.where(index >= 0, at[index], before[2] if before else 0)
        place = np.where(index >= 0, np.arange(n) - index, (before[3] if before else 0) + np.arange(n))
        goes_on = np.concatenate([head[1:] == head[:-1], [ends]])
        many = (place > 1) | goes_on | (head == first[0])
        return (~new, to_doc, to_at, many.astype(np.int32)), (head[-1], to_doc[-1], to_at[-1], place[-1])

    def rows(head, doc, at, to_doc, to_at, many, border) -> pa.RecordBatch:
        kinds = (np.int64, np.int64, np.int32, np.int64, np.int32, np.int32, np.int64)
        columns = (head, doc, at, to_doc, to_at, many, np.full(len(head), border))
        return pa.RecordBatch.from_arrays([pa.array(c.astype(k)) for c, k in zip(columns, kinds, strict=True)], ["head", "doc", "at", "to_doc", "to_at", "many", "border"])

    found = ws.save(ordered.mapInArrow(run, "head long, doc long, at int, to_doc long, to_at int, many int, border long"), name)
    # two rows per partition, not per suffix: its first row, and its last one with the first of that one's run
    borders = sorted(tuple(r) for r in found.where("border >= 0").select("border", "head", "doc", "at", "to_doc", "to_at").collect())
    links, last = [], None
    for border, head, doc, at, to_doc, to_at in borders:
        if border % 2 == 0:
            begins = (head, doc, at)
            if last and last[0] == head:
                links.append((head, doc, at, last[1], last[2], 1))
        elif not (last and last[0] == head and begins[0] == head):
            last = (head, to_doc, to_at)
    inside = found.where("border < 0").drop("border")
    if not links:
        return inside
    ends = ws.spark.createDataFrame(links, inside.schema)
    real = F.broadcast(ends.select("head", F.col("doc").alias("to_doc"), F.col("at").alias("to_at"), F.col("to_doc").alias("real_doc"), F.col("to_at").alias("real_at")))  # one row per partition at most
    moved = inside.join(real, ["head", "to_doc", "to_at"], "left")
    return moved.select("head", "doc", "at", F.coalesce("real_doc", "to_doc").alias("to_doc"), F.coalesce("real_at", "to_at").alias("to_at"), "many").union(ends)


def extend(pairs: DataFrame) -> DataFrame:
    """(doc, to_doc, anchors, text, to_text) -> the matches of the anchors, extended: doc, start, n, to_doc, to_start, and at for those that fall short (n is 0)."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        sides = [Texts(batch.column(c)) for c in ("text", "to_text")]
        words = [t.words() for t in sides]
        docs, to_docs = batch.column("doc").to_numpy(), batch.column("to_doc").to_numpy()
        out: list[tuple] = []
        for r, anchors in enumerate(batch.column("anchors").to_pylist()):
            x, y = (w[t.first_word[r] : t.first_word[r + 1]] for w, t in zip(words, sides, strict=True))
            by: dict[int, list[tuple[int, int]]] = {}
            for a in anchors:
                by.setdefault(a["at"] - a["to_at"], []).append((a["at"], a["head"]))
            for shift, ats in by.items():
                low, high = max(0, shift), min(len(x), len(y) + shift)
                differ = np.flatnonzero(x[low:high] != y[low - shift : high - shift]) + low
                seen = -1
                for at, head in sorted(ats):
                    k = np.searchsorted(differ, at)
                    start, end = int(differ[k - 1]) + 1 if k else low, int(differ[k]) if k < len(differ) else high
                    if end - start < LEAST:
                        out.append((docs[r], at, 0, None, None, head))
                    elif start != seen:
                        out.append((docs[r], start, end - start, to_docs[r], start - shift, None))
                        seen = start
        columns = list(zip(*out, strict=True)) if out else [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["doc", "start", "n", "to_doc", "to_start", "head"])

    return map_steps(pairs, ("text", "to_text"), make, "doc long, start int, n int, to_doc long, to_start int, head long")


def repeated_passages(docs: DataFrame, ws: Workspace, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame | None]:
    """(doc, start, n, to_doc, to_start): n words from word start of doc are those from to_start of to_doc; and what texts count.

    (to_doc, to_start) comes before (doc, start), so removing all the doc sides leaves one copy of each passage. Words are
    runs of characters other than ASCII white space, compared as bytes. Null ids and null texts are left out. Rows that
    repeat an id with one text count as one document. Where an id has several texts, the one with the least hash counts and
    the others are left out: the second result then has the (doc, k1, k2, k3) that count of such ids, and is None if there
    are none. Equal texts refer to the least id.
    """
    named = docs.select(F.col(f"`{id}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text")).where("doc is not null and text is not null")
    keyed = ws.save(named.select("doc", *hashes("text")).distinct(), "keys")
    many = keyed.groupBy("doc").agg(F.count("*").alias("n"), F.min(F.struct(*KEYS)).alias("k")).where("n > 1")
    chosen = ws.save(many.select("doc", "k.*"), "chosen")
    if chosen.limit(1).count():
        counts = chosen.select("doc", F.struct(*KEYS).alias("k"))
        named = named.join(counts, "doc", "left").where(F.col("k").isNull() | (F.col("k") == F.struct(*hashes("text")))).select("doc", "text")
        keyed = ws.save(keyed.join(counts, "doc", "left").where(F.col("k").isNull() | (F.col("k") == F.struct(*KEYS))).select("doc", *KEYS), "one-key")
    else:
        chosen = None
    classes = ws.save(keyed.groupBy(*KEYS).agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "classes")
    copies = ws.save(keyed.join(classes, KEYS).where("doc <> first").select("doc", "first").distinct(), "copies")
    ws.drop("keys")
    table = ws.save(suffixes(named.join(copies, "doc", "left_anti")).distinct(), "suffixes", TEXT_ROWS)
    found, texts = [], None
    for k in range(2):
        near = ws.save(neighbours(ws, table, f"sorted-{k}").where("doc <> to_doc or at <> to_at").distinct(), f"near-{k}")
        pairs = near.groupBy("doc", "to_doc").agg(F.collect_list(F.struct("at", "to_at", "head")).alias("anchors"))
        pairs = ws.save(pairs.withColumn("copy", F.pmod(F.xxhash64("doc"), F.lit(COPIES)).cast("int")), f"pairs-{k}")
        ws.drop(f"sorted-{k}")
        if texts is None:
            wanted = pairs.select("doc").union(pairs.select("to_doc")).distinct()
            texts = ws.bucketed(named.join(wanted, "doc", "left_semi").dropDuplicates(["doc"]), "texts", "doc")
        # a document that many refer to goes with each of their shares once
        sources = pairs.select("to_doc", "copy").distinct().join(texts.select(F.col("doc").alias("to_doc"), F.col("text").alias("to_text")), "to_doc")
        both = pairs.join(texts, "doc").join(sources, ["to_doc", "copy"])
        matched = ws.save(extend(both.select("doc", "to_doc", "anchors", "text", "to_text")), f"matched-{k}", TEXT_ROWS)
        found.append(matched.where("n > 0"))
        if not k:  # members of a run of three or more may share more with each other than with its head
            some = near.where("many = 1")
            again = some.select("doc", "at").union(some.select("to_doc", "to_at")).groupBy("doc").agg(F.collect_set("at").alias("ats"))
            table = ws.save(whole_windows(again.join(texts, "doc").select("doc", "ats", "text")), "windows", TEXT_ROWS)
        ws.drop(f"near-{k}", "suffixes")
    found = found[0].union(found[1])
    spans = found.select("doc", "start", "n", "to_doc", "to_start")
    if copies.limit(1).count():
        whole = map_steps(named.join(copies, "doc").select("doc", "first", "text"), "text", _counts, "doc long, start int, n int, to_doc long, to_start int")
        spans = spans.union(whole)
    return spans, chosen


def _counts(batch: pa.RecordBatch) -> pa.RecordBatch:
    n = Texts(batch.column("text")).n_words
    zero = pa.array(np.zeros(len(n), np.int32))
    out = pa.RecordBatch.from_arrays([batch.column("doc"), zero, pa.array(n.astype(np.int32)), batch.column("first"), zero], ["doc", "start", "n", "to_doc", "to_start"])
    return out.filter(pa.array(n >= LEAST))


def passage_report(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per repeated passage: id, start_word, n_words, of_<id>, of_start_word; see ``repeated_passages``. An empty table gives an empty result; other columns aren't read."""
    found, _ = repeated_passages(docs, Workspace(docs.sparkSession, "suffixes"), id, text)
    return found.select(F.col("doc").alias(id), F.col("start").cast("long").alias("start_word"), F.col("n").cast("long").alias("n_words"), F.col("to_doc").alias(f"of_{id}"), F.col("to_start").cast("long").alias("of_start_word")).distinct()


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with its columns, each repeated passage left in its first place only; documents that lose all words go.

    Rows with a null id or text, and those of an id whose text isn't the one that counts (see ``repeated_passages``), are
    left as they are. An empty table gives an empty result. Columns of any name pass through.
    """
    ws = Workspace(docs.sparkSession, "suffixes")
    spans, chosen = repeated_passages(docs, ws, id, text)
    spans = ws.save(spans, "spans")
    ws.drop("texts", "windows")
    cuts = spans.groupBy("doc").agg(F.collect_set(F.struct("start", "n")).alias("cuts"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text)
    own = F.col(names[docs.columns.index(id)]).cast("long")
    joined = docs.toDF(*names).join(cuts, own == F.col("doc"), "left").drop("doc")
    if chosen is not None:
        joined = joined.join(chosen.select("doc", F.struct(*KEYS).alias("k")), own == F.col("doc"), "left")
        joined = joined.withColumn("cuts", F.when(F.col("k").isNull() | (F.col("k") == F.struct(*hashes(names[at]))), F.col("cuts")))

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        column, cuts = batch.column(at), batch.column(len(names)).to_pylist()
        marked = [i for i, c in enumerate(cuts) if c]
        keep, out = np.ones(batch.num_rows, bool), column.to_pylist()
        texts = Texts(column)
        for i in marked:
            first, n = texts.first_word[i], texts.n_words[i]
            gone = np.zeros(n, bool)
            for c in cuts[i]:
                gone[c["start"] : c["start"] + c["n"]] = True
            keep[i] = not gone.all()
            edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
            data, base, at_byte, parts = out[i].encode(), texts.offsets[i], 0, []
            for s, e in edges.reshape(-1, 2):
                parts.append(data[at_byte : texts.starts[first + s] - base])
                at_byte = int(texts.starts[first + e] - base) if e < n else len(data)
            out[i] = b"".join([*parts, data[at_byte:]]).decode()
        columns = [pa.array(out, column.type) if k == at else batch.column(k) for k in range(len(names))]
        return pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    plain = docs.toDF(*names)
    return map_steps(joined.select(*names, "cuts"), names[at], make, plain.schema).toDF(*docs.columns)
