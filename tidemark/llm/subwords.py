"""Token ids of whole texts by a word-level BPE tokenizer of the tokenizers library, with a memory of words.

White space is dropped by the tokenizer and no match of its pattern contains any, so a text's ids are those of its
white-space-separated chunks in order. A chunk seen before costs one lookup; a plain Latin one is cut into matches of the
pattern, whose ids the BPE model gives without the cost of alignments; any other goes through the whole tokenizer.
"""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

import numpy as np

#: Chunks and matches remembered by a task; both memories are emptied when full, so memory stays bounded.
MEMORY = 400_000
#: Below this code point composition is the identity, and lower-casing doesn't depend on neighbours.
_PLAIN = re.compile("[\x21-\x7e\xa1-į]+")
#: The pattern of tokenizer files whose chunks are taken apart here, and the same for plain text.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_MATCH = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\w\s]|_)+")


def _byte_letters() -> dict[int, str]:
    """The visible letter that stands for each byte in byte-level BPE vocabularies."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordIds:
    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(file)
        self.whole.encode_special_tokens = True
        self.model = self.whole.model
        spec = json.loads(Path(file).read_text())
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        split = [x.get("pattern", {}).get("Regex") for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        #: Whether the file has the normaliser and the pattern that chunks and matches rest on; any other encodes whole texts.
        self.known = steps == ["NFC", "Replace", "Lowercase"] and split == [_SPLIT, None]
        self.letters = _byte_letters()
        self.chunks: dict[bytes, bytes] = {}
        self.matches: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not self.known:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        parts = text.encode().split()
        try:
            return b"".join(map(self.chunks.__getitem__, parts))
        except KeyError:
            if len(self.chunks) > MEMORY:
                self.chunks.clear()
            known = self.chunks
            for part in parts:
                if part not in known:
                    known[part] = self._chunk(part.decode())
            return b"".join(map(known.__getitem__, parts))

    def _chunk(self, chunk: str) -> bytes:
        if not _PLAIN.fullmatch(chunk):
            return np.array(self.whole.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        out = []
        for match in _MATCH.findall(chunk.lower()):
            if (ids := self.matches.get(match)) is None:
                if len(self.matches) > MEMORY:
                    self.matches.clear()
                mapped = match.encode().decode("latin1").translate(self.letters)
                ids = self.matches[match] = np.array([x.id for x in self.model.tokenize(mapped)], "<u4").tobytes()
            out.append(ids)
        return b"".join(out)
