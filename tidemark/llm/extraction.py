"""Operator 6: main text of HTML pages as the maximum-scoring contiguous run of tokens.

A page is a sequence of words and tags. Words score above zero and tags below, with weights learned from labelled pages,
where the tokens inside the only <article> are the content: a tag costs more the rarer it is inside, a word gains more
the likelier its place (the innermost named section around it) is inside. One linear scan finds the run of the greatest
sum. Subtrees of sections that are never content by name or by what was learned give no words, also inside the run.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_steps

#: Labelled pages that the weights come from, at most: those with the least hashes of their ids.
SAMPLE = 300
#: Bytes of a page that can be in that sample; longer ones are extracted like any other.
SAMPLE_BYTES = 1 << 18
#: Elements whose text isn't shown, elements without content, elements that end a block of text, and names
#: of elements and of class, id and role words that mark a section as no article text.
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "title", "svg", "math", "canvas", "object", "select")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
APART = frozenset("nav header footer aside form button menu dialog fieldset label head".split())
APART_WORDS = frozenset("ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent footer form header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted recommended related reply replies share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*+(?:>|\Z)|<\?[^>]*+(?:>|\Z)|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<more>(?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)(?:>|\Z)|</[^a-zA-Z][^>]*+(?:>|\Z)|(?P<text>[^<]++|<)",
    re.DOTALL | re.IGNORECASE,
)
_NAMES = re.compile(r"(?:class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+", re.IGNORECASE)


@dataclass
class Weights:
    """Log-odds of being inside the content for tags and for the places of words, and places that are never inside."""

    tag: dict[str, float] = field(default_factory=dict)
    place: dict[str, float] = field(default_factory=dict)
    apart: frozenset[str] = frozenset()

    def of_tag(self, name: str) -> float:
        return min(self.tag.get(name, -0.5), -0.1)

    def of_word(self, place: str) -> float:
        return max(self.place.get(place, 1.0), 0.05)


@dataclass
class Token:
    name: str  # of the tag; empty for text
    place: str
    apart: bool
    text: str = ""


def _apart(name: str, attributes: str) -> tuple[str, bool]:
    """The name of a section, and whether it is none of the article by that name."""
    words = [w.lower() for found in _NAMES.finditer(attributes) for w in re.split(r"[\s]+", next(x for x in found.groups("") if x or x == "")) if w]
    marks = {x.lower() for w in words for x in _WORD.findall(w)}
    return f"{name}.{words[0]}" if words else name, name in APART or (bool(marks & APART_WORDS) and name not in ("html", "body", "article", "main"))


def tokens(page: str, weights: Weights | None = None) -> list[Token]:
    """The page's tags and texts with their places; an unmatched end tag closes nothing."""
    out: list[Token] = []
    stack: list[tuple[str, str, bool]] = [("", "", False)]
    for m in _TOKEN.finditer(page):
        if m["text"]:
            out.append(Token("", stack[-1][1], stack[-1][2], m["text"]))
        elif m["name"]:
            name = m["name"].lower()
            if m["close"]:
                apart = stack[-1][2]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        apart = stack[k][2]
                        del stack[k:]
                        break
                out.append(Token(name, stack[-1][1], apart))
            else:
                section, apart = _apart(name, m["more"])
                apart = stack[-1][2] or apart or (weights is not None and section in weights.apart)
                out.append(Token(name, stack[-1][1], apart))
                if name == "p":  # a paragraph ends an open one
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == "p":
                            del stack[k:]
                            break
                        if stack[k][0] in BLOCK:
                            break
                if name not in VOID and not m["more"].endswith("/"):
                    place = stack[-1][1] if name not in BLOCK or name in ("p", "li") else section
                    stack.append((name, place, stack[-1][2] or apart))
    return out


def learn(pages: list[str]) -> Weights:
    """From the pages with exactly one <article>."""
    tag: dict[str, Counter] = defaultdict(Counter)
    place: dict[str, Counter] = defaultdict(Counter)
    for page in pages:
        found = tokens(page)
        marks = [i for i, t in enumerate(found) if t.name == "article"]
        if len(marks) != 2:
            continue
        for i, t in enumerate(found):
            if t.apart:
                continue
            inside = marks[0] < i < marks[1]
            if t.name:
                tag[t.name][inside] += 1
            else:
                place[t.place][inside] += len(t.text.split())

    def odds(c: Counter) -> float:
        return math.log((c[True] + 0.5) / (c[False] + 0.5))

    # tags cost at most what a few words give: inside-only tags are cheap, outside-only ones dear
    tags = {k: -0.1 if odds(c) > 0 else max(odds(c), -3.0) for k, c in tag.items()}
    places = {k: min(max(odds(c), 0.05), 2.0) for k, c in place.items() if sum(c.values()) >= 20}
    apart = frozenset(k for k, c in place.items() if k and sum(c.values()) >= 50 and c[True] < 0.02 * sum(c.values()) and k not in ("html", "body", "article", "main"))
    return Weights(tags, places, apart)


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run of the greatest sum, the first of equals; (0, 0) if no score is above zero."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, span = total, (start, i + 1)
    return span


def extract(page: str, weights: Weights) -> str:
    """Blocks in page order, one on a line: character references decoded, white space one space, ends trimmed."""
    found = tokens(page, weights)
    scores = [(0.0 if t.apart else weights.of_word(t.place) * len(t.text.split())) if not t.name else 0.0 if t.apart else weights.of_tag(t.name) for t in found]
    start, end = best_run(scores)
    blocks, open_ = [], []
    for t in found[start:end]:
        if not t.name:
            if not t.apart:
                open_.append(t.text)
        elif t.name in BLOCK:
            blocks.append(open_)
            open_ = []
        elif t.name == "br":
            open_.append(" ")
    lines = (" ".join(html.unescape("".join(b)).split()) for b in [*blocks, open_])
    return "\n".join(x for x in lines if x)


def main_text(pages: DataFrame, id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, text (empty if there is none), n_chars (its code points).

    A null or empty page has an empty text. Whole pages are read, whatever their length; unclosed comments, scripts and tags
    run to the end. Repeated rows and null ids are treated as any. An empty table gives an empty result; without labelled
    pages the weights are those of ``Weights``. Other columns aren't read.
    """
    source = pages.select(F.col(id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.col(page).alias("page"))
    ids = source.where("page is not null and id is not null").select("id").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).distinct()
    some = source.join(F.broadcast(ids), "id").select("page").where(F.octet_length("page") <= SAMPLE_BYTES).limit(SAMPLE).collect()  # ids first: few bytes a task reach the driver
    weights = learn([x[0] for x in some])

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract(x or "", weights) for x in batch.column("page").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [id, url, "text", "n_chars"])

    return map_steps(source, "page", make, f"`{id}` long, `{url}` string, text string, n_chars long")
