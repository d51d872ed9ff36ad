"""Main-text extraction by a linear-chain conditional random field over DOM blocks.

A page is cut into leaf blocks: stretches of text between the tags of block
elements. A block's ancestor tags with their class, id and role words, and
properties of its text, are its features. The model is fitted on labelled pages
and the best labelling of a page's blocks, found by Viterbi, tells which of
them are main text.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cuesheet.llm import crf

# The model is fitted on at most this many pages whose markup labels them.
FIT_PAGES = 250
ITERATIONS = 200
_CHAIN = 24
_CACHE = 100_000

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>\"'<]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[a-z]+")
# Elements whose content is not text.
_RAW = frozenset("script style noscript template textarea select svg iframe object canvas".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol
    option p pre section summary table tbody td tfoot th thead title tr ul""".split()
)
# An opening tag ends open elements of the same kind, up to what holds them.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_CLOSED_P = re.compile(r"[.!?:;\"'”’»)]$")
_HINTS = re.compile(
    r"©|\b(?:copyright|cookies?|privacy|subscribe|newsletter|advertisement|sponsored|comments?|reply"
    r"|share|log ?in|sign ?(?:in|up)|read more|related|menu|rights reserved)\b",
    re.I,
)


@dataclass
class Block:
    path: int
    text: str
    linked: float  # part of the text that stands in links


@dataclass
class Paths:
    """Ancestor chains, each stored as its last element and the chain above.

    `above` has the tags and names of all elements of a chain, of any length;
    chains that add none share their parent's set. With `known`, only those
    words are remembered there, so that no set is larger than it."""

    known: frozenset[str] | None = None
    ids: dict[tuple[int, str], int] = field(default_factory=dict)
    parts: list[tuple[int, tuple[str, ...]]] = field(default_factory=lambda: [(-1, ())])
    above: list[frozenset[str]] = field(default_factory=lambda: [frozenset()])

    def child(self, parent: int, tag: str, attributes: str) -> int:
        names = ""
        if "=" in attributes:
            found = sorted({w for m in _NAMES.findall(attributes) for w in _PARTS.findall("".join(m).lower())})
            names = " ".join(found)
        key = (parent, f"{tag} {names}")
        at = self.ids.get(key)
        if at is None:
            at = self.ids[key] = len(self.parts)
            own = (tag, *(f".{w}" for w in names.split()))
            self.parts.append((parent, own))
            told = frozenset(own) if self.known is None else self.known.intersection(own)
            self.above.append(self.above[parent] if told <= self.above[parent] else self.above[parent] | told)
        return at

    def words(self, path: int) -> list[tuple[str, ...]]:
        """Tag and names of all ancestors, innermost first."""
        out = []
        while path > 0:
            path, own = self.parts[path]
            out.append(own)
        return out

    def features(self, path: int) -> list[str]:
        """What `path_features` gives for the ancestors, of known words."""
        parent, own = self.parts[path]
        return _features(own, self.parts[parent][1] if parent > 0 else None, self.above[path])


def blocks_of(page: str, paths: Paths) -> list[Block]:
    """The leaf blocks of a page, in order. Unclosed and stray tags, a page that
    breaks off, and broken attributes are read as browsers mostly do."""
    out: list[Block] = []
    stack: list[tuple[str, int]] = []
    parts: list[str] = []
    linked = link = 0
    at, size = 0, len(page)

    def flush() -> None:
        nonlocal linked, link
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                share = min(1.0, linked / max(1, sum(map(len, parts))))
                out.append(Block(stack[-1][1] if stack else 0, text, share))
            parts.clear()
        linked = link = 0

    def close(until: int) -> None:
        flush()
        del stack[until:]

    while at < size:
        m = _TOKEN.search(page, at)
        end = m.start() if m else size
        if end > at:
            parts.append(page[at:end])
            if link:
                linked += end - at
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing = bool(m[1] or m[4])
        if tag in _RAW:
            if not closing:
                shut = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = shut.end() if shut else size
            parts.append(" ")
        elif tag == "br" or tag in _VOID and tag != "hr":
            if tag in ("br", "img", "input"):
                parts.append(" ")
        elif tag not in _BLOCKS:
            if tag == "a":
                link = 0 if closing else 1
        elif closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag or tag in _HEADINGS and stack[i][0] in _HEADINGS:
                    close(i)
                    break
            else:
                flush()
        else:
            flush()
            if stack and stack[-1][0] == "p":
                stack.pop()
            ends, holders = _ENDS.get(tag, ((), ()))
            for i in range(len(stack) - 1, -1, -1):
                if not ends or stack[i][0] in holders:
                    break
                if stack[i][0] in ends:
                    del stack[i:]
                    break
            if tag != "hr":
                stack.append((tag, paths.child(stack[-1][1] if stack else 0, tag, m[3] or "")))
    flush()
    return out


# Words of tags and names that mark parts of a page which are not main text.
BOILERPLATE = {
    "nav": ("nav", ".nav", ".menu", ".navbar", ".navigation", ".breadcrumb"),
    "header": ("header", ".header", ".masthead", ".banner", ".topbar"),
    "footer": ("footer", ".footer", ".copyright", ".contentinfo"),
    "aside": ("aside", ".sidebar", ".aside", ".widget", ".related", ".complementary"),
    "notice": ("dialog", ".cookie", ".notice", ".consent", ".popup", ".alert"),
    "advert": (".ad", ".ads", ".advert", ".advertisement", ".promo", ".sponsored"),
    "form": ("form", "fieldset", ".form", ".newsletter", ".subscribe", ".login", ".search"),
    "comment": (".comment", ".comments", ".discussion", ".disqus", ".replies"),
    "share": (".share", ".social", ".tags"),
    "head": ("head", "title"),
}
MAIN = ("article", "main", ".content", ".post", ".entry", ".story", ".article", ".body", ".text")
_KIND = {w: kind for kind, words in BOILERPLATE.items() for w in words}


def path_features(elements: list[tuple[str, ...]]) -> list[str]:
    """Features of a block's ancestors, innermost first: their tags and names,
    and whether a lexicon knows one of these as part of boilerplate."""
    parent = elements[1] if len(elements) > 1 else None
    return _features(elements[0] if elements else (), parent, frozenset(w for e in elements for w in e))


def _features(own: tuple[str, ...], parent: tuple[str, ...] | None, above: frozenset[str]) -> list[str]:
    known = {f"kind:{_KIND[w]}" for w in above if w in _KIND}
    if known:
        known.add("kind:any")
    return [
        *([f"own:{w}" for w in own] or ["own:"]),
        *([f"parent:{w}" for w in parent] if parent else ["parent:"]),
        *sorted(f"in:{w}" for w in above),
        *sorted(known),
    ]


def text_features(block: Block) -> list[str]:
    words = block.text.count(" ") + 1
    linked = 0 if block.linked == 0 else 1 + int(block.linked * 2.99)
    end = bool(_CLOSED_P.search(block.text[-1:]))
    hints = sorted({f"hint:{h.lower()}" for h in _HINTS.findall(block.text)}) if words < 60 else []
    return [f"words:{min(words.bit_length(), 8)}", f"linked:{linked}", f"end:{end}{words > 8}", *hints]


@dataclass
class Model:
    names: dict[str, int]
    weights: np.ndarray  # feature; boilerplate, main text
    moves: np.ndarray


_OUT = frozenset(_KIND)


def label_of(elements: list[tuple[str, ...]]) -> int | None:
    """1 in an `article` or `main` element outside boilerplate parts, 0 in such
    parts or outside; what the markup of a labelled page says."""
    words = {w for e in elements for w in e}
    if words & _OUT:
        return 0
    return int(bool(words & {"article", "main"}))


def is_labelled(page: str) -> bool:
    return bool(re.search(r"<(?:article|main)\b", page, re.I))


def training_pages(pages: list[str], seed: int = 5) -> list[list[tuple[list[str], int]]]:
    """Labelled chains of (features, label) from pages whose markup labels them.

    Every page is used as it is and in two variants, in which its parts carry
    other names of their kind and further parts, such as comments and notices
    with the text of other pages, are put in: so names, text and order are
    learned beside the labelling tags themselves.
    """
    rng = random.Random(seed)
    paths = Paths()
    parsed = [blocks_of(p, paths) for p in pages]
    prose = [b.text for blocks in parsed for b in blocks if label_of(paths.words(b.path))] or ["Text."]
    kinds = sorted(BOILERPLATE)
    out = []
    for blocks in parsed:
        real = [(paths.words(b.path), b) for b in blocks]
        out.append([([*path_features(e), *text_features(b)], label_of(e)) for e, b in real])
        for _ in range(2):
            main = rng.choice(MAIN)
            swap = {k: rng.choice(BOILERPLATE[k]) for k in kinds}

            def renamed(word: str) -> tuple[str, ...]:
                if word in ("article", "main"):
                    return (main,) if main[0] != "." else ("div", main)
                for kind, words in BOILERPLATE.items():
                    if word in words and kind != "head":
                        new = swap[kind]
                        return (new,) if new[0] != "." else ("div", new) if word[0] != "." else (new,)
                return (word,)

            chain = []
            for elements, b in real:
                other = [tuple(dict.fromkeys(x for w in e for x in renamed(w))) for e in elements]
                if other and other[0] == ("p",) and label_of(elements) and rng.random() < 0.35:
                    # Lists, quotations and headings are main text too.
                    tag = rng.choice(("li", "blockquote", "h2", "h3", "td", "dd", "div", "pre"))
                    holder = {"li": [("ul",)], "td": [("tr",), ("table",)], "dd": [("dl",)]}
                    other[:1] = [(tag,), *holder.get(tag, [])]
                    if rng.random() < 0.6:
                        b = Block(0, " ".join(b.text.split()[: rng.randint(1, 9)]), 0.0)
                chain.append(([*path_features(other), *text_features(b)], label_of(elements)))
            for _ in range(rng.randint(2, 8)):
                kind = rng.choice([k for k in kinds if k != "head"])
                name = rng.choice(BOILERPLATE[kind])
                element = (name,) if name[0] != "." else (rng.choice(("div", "section", "ul")), name)
                inner = rng.choice([[], [("p",)], [("li",)], [("div",)]])
                # Within the main part too, as pages have it; its name then tells.
                inside = [i for i, (_, y) in enumerate(chain) if y]
                above, place = [("body",), ("html",)], rng.randint(0, len(chain))
                if inside and rng.random() < 0.7:
                    above = [tuple(renamed("article")), *above]
                    place = rng.randint(inside[0], inside[-1] + 1)
                part = []
                for _ in range(rng.randint(1, 4)):
                    text = rng.choice(prose)
                    if rng.random() < 0.5:
                        text = " ".join(text.split()[: rng.randint(1, 12)])
                    b = Block(0, text, 1.0 if kind in ("nav", "share") else rng.choice((0.0, 0.0, 0.4)))
                    part.append(([*path_features([*inner, element, *above]), *text_features(b)], 0))
                chain[place:place] = part
            out.append(chain)
    return out


def fit(pages: list[str]) -> Model:
    """Fit on pages; those whose markup does not label them are passed over."""
    chains = [c for c in training_pages([p for p in pages if is_labelled(p)]) if c]
    seen: dict[tuple[str, ...], int] = {("pad",): 0}
    index, labels = [], []
    for chain in chains:
        for start in range(0, len(chain), _CHAIN):
            piece = chain[start : start + _CHAIN]
            index.append([seen.setdefault(tuple(f), len(seen)) for f, _ in piece] + [0] * (_CHAIN - len(piece)))
            labels.append([y for _, y in piece] + [0] * (_CHAIN - len(piece)))
    names: dict[str, int] = {}
    pairs = [(i, names.setdefault(f, len(names))) for fs, i in seen.items() for f in fs]
    if not index:
        return Model(names, np.zeros((len(names), 2)), np.zeros((2, 2)))
    rows, ids = (np.array(x) for x in zip(*pairs))
    weights, moves = crf.fit(
        rows, ids, len(seen), len(names), np.array(index), np.array(labels), 2, ITERATIONS
    )
    return Model(names, weights, moves)


class Extractor:
    """Applies a model to pages; scores of ancestor chains are kept between calls."""

    def __init__(self, model: Model):
        self.model = model
        self.known = frozenset(_KIND).union(n[3:] for n in model.names if n.startswith("in:"))
        self.paths, self.path_scores = Paths(self.known), {}
        self.text_scores: dict[tuple[str, ...], np.ndarray] = {}

    def _sum(self, features: list[str]) -> np.ndarray:
        known = [self.model.names[f] for f in features if f in self.model.names]
        return self.model.weights[known].sum(axis=0)

    def _score(self, block: Block) -> np.ndarray:
        above = self.path_scores.get(block.path)
        if above is None:
            above = self._sum(self.paths.features(block.path))
            self.path_scores[block.path] = above
        features = tuple(text_features(block))
        own = self.text_scores.get(features)
        if own is None:
            own = self.text_scores[features] = self._sum(list(features))
        return above + own

    def texts(self, pages: list[str | None]) -> list[str]:
        """The main text of every page."""
        blocks, starts, owners, item = [], [], [], []
        for i, page in enumerate(pages):
            if len(self.paths.parts) > _CACHE:
                self.paths, self.path_scores = Paths(self.known), {}
            found = blocks_of(page, self.paths) if page else []
            if found:
                owners.append(i)
                starts.append(len(blocks))
                item.extend(map(self._score, found))
                blocks.extend(found)
        out: list[list[str]] = [[] for _ in pages]
        if blocks:
            label = crf.viterbi(np.array(item), np.array(starts), self.model.moves)
            ends = [*starts[1:], len(blocks)]
            for i, a, b in zip(owners, starts, ends):
                out[i] = [blocks[j].text for j in range(a, b) if label[j]]
        return ["\n".join(x) for x in out]


def fitted(pages: DataFrame, text: str = "html", most: int = FIT_PAGES) -> Model:
    """A model from at most `most` pages that have an `article` or `main`
    element: those of the smallest digests, copies once.

    Only pages whose digest lies below a bound are ranked, about four times as
    many different ones as are wanted, so that what tasks send stays the same at
    every size.
    """
    labelled = pages.where(F.col(text).rlike(r"(?i)<(?:article|main)\b")).select(
        F.col(text).alias("html"), F.shiftrightunsigned(F.xxhash64(text), 32).alias("digest")
    )
    count = labelled.agg(F.approx_count_distinct("digest")).first()[0]
    if count > 4 * most:
        labelled = labelled.where(F.col("digest") < (4 * most << 32) // count)
    sample = labelled.dropDuplicates(["html"]).orderBy("digest", "html").limit(most)
    return fit([r["html"] for r in sample.collect()])


def main_text(pages: DataFrame, model: Model, html_column: str = "html") -> DataFrame:
    """`pages` without the html, with `main_text`: its main blocks, character
    references decoded, white space in a block made one space, blocks joined by
    one line feed. Null or empty pages, and pages without main text, give an
    empty string; repeated rows are read each. Pages of any length and depth are
    read whole."""
    at = pages.columns.index(html_column)
    kept = [f for i, f in enumerate(pages.schema.fields) if i != at]
    # The model has the features of a bounded sample, whatever the table.
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = Extractor(shared.value)
        for batch in batches:
            texts = extractor.texts(batch.column(at).to_pylist())
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            names = [n for i, n in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=[*names, "main_text"])

    return pages.mapInArrow(run, StructType([*kept, *StructType().add("main_text", "string")]))


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points of the text)."""
    source = pages.select("page_id", "url", "html")
    done = main_text(source, fitted(source))
    return done.select(
        "page_id",
        "url",
        F.col("main_text").alias("text"),
        F.length("main_text").cast("long").alias("n_chars"),
    )
