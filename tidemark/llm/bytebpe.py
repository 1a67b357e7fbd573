"""Operator 8: byte-level BPE by prefix dynamic programming.

The encoding of a byte string determines that of each of its prefixes' last tokens: a prefix has exactly one last token
that BPE would produce, namely the one that ends the prefix, is itself what BPE makes of its bytes, and whose boundary
with the last token of what stands before it survives BPE's merges. ``Prefixes`` stores that token for each prefix. So an
append only looks at the new bytes, an edit recomputes from its place on until the tokens found before come up again, and
walking back yields the encoding. An automaton over all tokens gives those that end at a byte, so no substring is tried in vain.
"""

from __future__ import annotations

import base64
import struct
from functools import lru_cache
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_steps

#: Matches remembered by a task; emptied when full.
MEMORY = 400_000


def load_ranks(file: str) -> dict[bytes, int]:
    """A vocabulary file of lines with a token in base 64 and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in Path(file).read_bytes().splitlines() if line)}


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        #: Yields (place of the last byte, (rank, length)) for each token of a text that has a letter of Latin-1 for each byte.
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin1"), (rank, len(token)))
        self.automaton.make_automaton()
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[tuple[int, int], bool] = {}

    def halves(self, t: int) -> tuple[int, int] | None:
        """The two tokens that BPE merges last to make ``t``; (t, t) for a byte; None if BPE never makes it."""
        if t not in self._halves:
            parts, pair = [bytes([b]) for b in self.token[t]], (t, t)
            while len(parts) > 1:
                options = [(self.ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in self.ranks]
                if not options:
                    break
                i = min(options)[1]
                pair = (self.ranks[parts[i]], self.ranks[parts[i + 1]])
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self._halves[t] = pair if len(parts) == 1 else None
        return self._halves[t]

    def fits(self, x: int, y: int) -> bool:
        """Whether BPE leaves a boundary between tokens x and y: undoing their merges along it, latest first, no merge across it comes earlier."""
        known = self._fits.get((x, y))
        if known is None:
            left, right, bound = x, y, None
            while True:
                across = self.ranks.get(self.token[left] + self.token[right])
                if across is not None and (bound is None or across < bound[0] or across == bound[0] and bound[1]):
                    known = False
                    break
                # a merge on the left of the boundary goes before one across it of the same rank, one on the right after
                can_left, can_right = self.halves(left)[0] != left, self.halves(right)[0] != right
                if not (can_left or can_right):
                    known = True
                    break
                if can_left and (left > right or not can_right):
                    bound, left = (left, False), self.halves(left)[1]
                else:
                    bound, right = (right, True), self.halves(right)[0]
            if len(self._fits) > 4 * MEMORY:
                self._fits.clear()
            self._fits[x, y] = known
        return known


class Prefixes:
    """The last token of every prefix of a byte string that is open to appends and edits."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self._fill([], 0)

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Puts ``new`` in the place of the bytes start .. end - 1. What stands before stays as it is, and what follows from where as many prefixes as the longest token has bytes end as before."""
        old = self.last[end:]
        self.data, self.last = self.data[:start] + new + self.data[end:], self.last[:start]
        self._fill(old, start + len(new))

    def _fill(self, old: list[int], tail: int) -> None:
        """Finds the last tokens of the prefixes that have none; old: those of the bytes from ``tail`` on as they were before."""
        v, last, done, same = self.vocabulary, self.last, len(self.last), 0
        fits, halves = v.fits, v.halves
        for at, (t, n) in v.automaton.iter(self.data.decode("latin1"), max(0, done - v.longest + 1)):
            if at < done:
                continue
            if at > done:
                break
            before = at - n
            if (before < 0 or fits(last[before], t)) and halves(t) is not None:
                last.append(t)
                done += 1
                if old and at >= tail:
                    same = same + 1 if old[at - tail] == t else 0
                    if same >= v.longest:
                        last.extend(old[at - tail + 1 :])
                        return
        if done < len(self.data):
            raise ValueError("a byte has no token")

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.token[out[-1]])
        return out[::-1]


class Coder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary, self.pattern, self.known = Vocabulary(ranks), regex.compile(pattern), {}

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; matches of the pattern are encoded separately."""
        parts = self.pattern.findall(text)
        try:
            return b"".join(map(self.known.__getitem__, parts))
        except KeyError:
            if len(self.known) > MEMORY:
                self.known.clear()
            for part in set(parts).difference(self.known):
                data = part.encode()
                t = self.vocabulary.ranks.get(data)
                ids = [t] if t is not None else Prefixes(self.vocabulary, data).ids()
                self.known[part] = struct.pack(f"<{len(ids)}I", *ids)
            return b"".join(map(self.known.__getitem__, parts))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def coder_of(ranks: str, pattern: str) -> Coder:
    """One coder for all tasks of a Python worker."""
    return Coder(load_ranks(ranks), pattern)


def encode(docs: DataFrame, ranks: str, pattern: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ids (binary: little-endian unsigned 32-bit integers), decoded (binary).

    ranks: a vocabulary file. A null or empty text has no ids. No token is special. Repeated rows, null ids and other
    columns change nothing; an empty table gives an empty result.
    """

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = coder_of(ranks, pattern)
        ids = [coder.encode(x or "") for x in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.binary()), pa.array([coder.decode(x) for x in ids], pa.binary())], [id, "ids", "decoded"])

    return map_steps(docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")), "text", make, f"`{id}` long, ids binary, decoded binary")


def digests(encoded: DataFrame, id: str = "doc_id") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of what ``encode`` returns."""
    return encoded.select(id, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
