"""Operator 4: quality rules and gradient-boosted trees over document statistics.

Fixed rules decide first; what they pass is scored by boosted regression trees (log loss, histograms of quantile bins),
fitted here on a bounded sample of labelled documents. A feature may be constrained to raise or to lower the score: a
split that goes against it isn't taken, and the middle of a taken one bounds the leaves below. The trees are flattened
into node arrays, and a batch of documents steps through all of them at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_steps, steps
from .words import U, Texts, distinct, mix

#: Labelled documents that the trees are fitted on, at most: those with the least hashes of their ids.
SAMPLE = 8000
#: The statistics that the trees see, and whether a greater value may only lower (-1) or raise (1) the score.
FEATURES: dict[str, int] = {
    "log_words": 0, "word_length": 0, "symbols_per_char": -1, "dup_line_share": -1, "repeat_share": -1, "distinct_share": 0, "upper_share": 0,
    "digit_share": 0, "other_share": 0, "line_words": 0, "short_line_share": 0, "no_stop_share": 0, "neighbour_share": -1, "top_word_share": -1,
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def statistics(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """For each text its COUNTS (integers) and its FEATURES."""
    n, data, offsets = texts.n, texts.data, texts.offsets

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    words = texts.words()
    begins = (data & 0xC0) != 0x80
    chars, symbols = per_text(begins & texts.inside), per_text(_IS_SYMBOL[data])
    # lines with a word, each against the earlier ones of its text
    breaks = np.flatnonzero(data == 10)
    cuts = np.unique(np.concatenate([offsets[:-1], breaks + 1])) if n else np.zeros(0, np.int64)
    cuts = cuts[cuts < len(data)]
    line_text = np.searchsorted(offsets, cuts, "right") - 1
    ends = np.concatenate([cuts[1:], [len(data)]]).astype(np.int64) if len(cuts) else cuts
    ends = ends - (data[ends - 1] == 10) if len(cuts) else ends
    line_words = np.searchsorted(texts.starts, ends) - np.searchsorted(texts.starts, cuts)
    full = line_words > 0
    lines, line_words = line_text[full], line_words[full]
    n_lines = np.bincount(lines, minlength=n)
    alone, _ = distinct(lines, texts.spans(cuts[full], np.maximum(ends, cuts)[full]))
    dup_lines = n_lines - np.bincount(alone, minlength=n)
    # words in windows of five that the text has twice or more
    hashes, at = texts.windows(words, 5)
    keyed = mix(hashes + texts.text_of[at].astype(U) * U(0x9E3779B97F4A7C15))
    _, inverse, times = np.unique(keyed, return_inverse=True, return_counts=True)
    again = at[times[inverse] > 1]
    covered = np.zeros(len(words) + 5, bool)
    for j in range(5):
        covered[again + j] = True
    repeats = np.bincount(texts.text_of[covered[: len(words)]], minlength=n)

    word_text = texts.text_of
    order = np.lexsort((words, word_text))
    new = np.ones(len(words), bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (word_text[order][1:] != word_text[order][:-1])
    different = np.bincount(word_text[order][new], minlength=n)
    first = np.flatnonzero(new)
    runs = np.diff(np.concatenate([first, [len(words)]]))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, word_text[order][first], runs)
    next_same = np.flatnonzero((words[1:] == words[:-1]) & (word_text[1:] == word_text[:-1]))
    lasts = data[texts.ends - 1] if len(words) else np.zeros(0, np.uint8)
    stops = np.bincount(word_text[np.isin(lasts, [33, 46, 63])], minlength=n)
    size, w = np.maximum(np.diff(offsets), 1), np.maximum(texts.n_words, 1)
    short = np.bincount(lines[line_words < 4], minlength=n)
    features = np.column_stack([
        np.log1p(texts.n_words), chars / w, symbols / size, dup_lines / np.maximum(n_lines, 1), repeats / w, different / w, per_text((data >= 65) & (data <= 90)) / size,
        per_text((data >= 48) & (data <= 57)) / size, per_text(data >= 128) / size, texts.n_words / np.maximum(n_lines, 1), short / np.maximum(n_lines, 1),
        1 - stops / w, np.bincount(word_text[next_same], minlength=n) / w, top / w,
    ])
    return np.column_stack([texts.n_words, chars, symbols, dup_lines, repeats]).astype(np.int64).reshape(n, 5), features.reshape(n, len(FEATURES))


def base_failed(counts: np.ndarray) -> np.ndarray:
    """Too short, or too much of it in repeated windows."""
    return (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])


@dataclass
class Trees:
    """Flattened trees: node i sends x[feature[i]] <= threshold[i] to left[i], else to right[i]; a leaf leads to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.prior + self.value[at].sum(axis=1)


def fit(x: np.ndarray, y: np.ndarray, constraints: list[int], n_trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, least: int = 8, ridge: float = 1.0) -> Trees:
    """Boosted trees for log loss; constraints: -1, 0 or 1 for each feature."""
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if len(y) else 0.5
    prior = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []
    roots: list[int] = []
    if not len(y) or y.min() == y.max():
        return Trees(*(np.zeros(1, t) for t in (int, float, int, int, float)), np.zeros(1, int), 1, prior if len(y) else 1.0)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
    score = np.full(len(y), prior)
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)

        def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
            g, h = grad[rows].sum(), hess[rows].sum()  # noqa: B023
            me, best = len(nodes), (1e-6, None)
            nodes.append([0, 0.0, me, me, float(np.clip(g / (h + ridge), low, high)) * rate])
            for f in range(x.shape[1]) if level < depth else ():
                k = len(edges[f]) + 1
                b = binned[rows, f]
                gs, hs, cs = (np.cumsum(np.bincount(b, v, k)) for v in (grad[rows], hess[rows], np.ones(len(rows))))  # noqa: B023
                for j in range(k - 1):
                    if cs[j] < least or cs[-1] - cs[j] < least:
                        continue
                    lv, rv = (np.clip(v, low, high) for v in (gs[j] / (hs[j] + ridge), (g - gs[j]) / (h - hs[j] + ridge)))
                    if constraints[f] * (rv - lv) < 0:
                        continue
                    gain = gs[j] ** 2 / (hs[j] + ridge) + (g - gs[j]) ** 2 / (h - hs[j] + ridge) - g * g / (h + ridge)
                    if gain > best[0]:
                        best = (gain, (f, j, lv, rv))
            if best[1]:
                f, j, lv, rv = best[1]
                middle = (lv + rv) / 2
                sides = [(low, middle), (middle, high)] if constraints[f] > 0 else [(middle, high), (low, middle)] if constraints[f] < 0 else [(low, high)] * 2
                goes = binned[rows, f] <= j
                a, b = grow(rows[goes], level + 1, *sides[0]), grow(rows[~goes], level + 1, *sides[1])
                nodes[me][:4] = [f, float(edges[f][j]), a, b]
            return me

        roots.append(grow(np.arange(len(y)), 0, -4.0, 4.0))
        flat = np.array(nodes)
        score += Trees(*(flat[:, i].astype(t) for i, t in enumerate((int, float, int, int, float))), np.array(roots[-1:]), depth, 0.0).score(x)
    flat = np.array(nodes)
    return Trees(*(flat[:, i].astype(t) for i, t in enumerate((int, float, int, int, float))), np.array(roots), depth, prior)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees for labels (id, good) of ``docs`` (id, text), fitted on the labelled documents of the least id hashes."""
    some = labels.where("id is not null and good is not null").orderBy(F.xxhash64("id"), "id", "good").limit(sample).dropDuplicates(["id"])
    found = docs.join(F.broadcast(some), "id")  # at most `sample` rows of two numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, ("text",)):
                counts, x = statistics(Texts(part.column("text")))
                ok = ~base_failed(counts)
                yield pa.RecordBatch.from_arrays([part.column("id").filter(pa.array(ok)), part.column("good").filter(pa.array(ok)), pa.array(list(x[ok]), pa.list_(pa.float64()))], ["id", "good", "x"])

    rows = found.select("id", "text", "good").mapInArrow(run, "id long, good int, x array<double>").toPandas().sort_values("id")
    x = np.array(rows["x"].tolist()).reshape(-1, len(FEATURES))
    return fit(x, rows["good"].to_numpy(float), list(FEATURES.values()))


def judge(docs: DataFrame, trees: Trees, id: str = "doc_id", text: str = "text", keep_from: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: id, the COUNTS, base_failed, kept.

    Words are runs of characters other than ASCII white space, over the whole text. A null or empty text has no words and
    fails; so does any text of fewer than 10 words, or with over 20 % of its words in 5-word windows that it has twice or
    more. kept: it did not fail, and the trees give at least ``keep_from``. Repeated rows and null ids are judged as any.
    An empty table gives an empty result; other columns aren't read.
    """
    bar = np.log(keep_from / (1 - keep_from))

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, x = statistics(Texts(batch.column("text")))
        failed = base_failed(counts)
        return pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c) for c in counts.T.copy()), pa.array(failed), pa.array(~failed & (trees.score(x) >= bar))], [id, *COUNTS, "base_failed", "kept"])

    named = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    return map_steps(named, "text", make, f"`{id}` long, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, kept boolean")


def keep_good(docs: DataFrame, trees: Trees, text: str = "text", keep_from: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns.

    Rows with a null or empty text go, repeated rows and null ids are judged as any, and an empty table stays one.
    """
    bar = np.log(keep_from / (1 - keep_from))

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, x = statistics(Texts(batch.column(text)))
        return batch.filter(pa.array(~base_failed(counts) & (trees.score(x) >= bar)))

    return map_steps(docs, text, make, docs.schema)


def labelled(labels: DataFrame, id: str = "doc_id", label: str = "quality") -> DataFrame:
    return labels.select(F.col(id).cast("long").alias("id"), F.col(label).cast("int").alias("good"))
