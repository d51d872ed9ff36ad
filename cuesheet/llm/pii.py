"""Personal data by weak supervision: labelers vote, expectation-maximisation
weighs them, and a span classifier trained on their verdicts decides.

1. Patterns find the base spans, which always stay, and further candidates:
   numbers inside longer chains, written-out addresses, names after a title.
2. Labelers (patterns, a gazetteer, context) vote yes, no or nothing on each.
3. Expectation-maximisation over the counts of all patterns of votes in the
   corpus estimates each labeler's reliability and every pattern's probability.
4. A logistic classifier over form and context of spans is trained on a bounded
   sample with these probabilities; candidates that both hold for data are added.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cuesheet.llm.common import unique_name, written

# In the order of the result; those after the fourth have no base pattern.
KINDS = ("email", "ip", "card", "phone", "name")
EMAIL, IP, CARD, PHONE, NAME = range(5)
# The classifier is trained on so many spans at most, so many of a kind and votes.
FIT_SPANS, FIT_SPANS_ALIKE = 20_000, 200
LEAST = 0.9
_FEATURES = 1 << 14

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

# --- base spans -------------------------------------------------------------


def luhn(digits: str) -> bool:
    """Whether a number's check digit fits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(span: str) -> str:
    return "".join(_DIGIT.findall(span))


def valid(kind: int, span: str) -> bool:
    """Whether a span that has the form of its kind is in range."""
    if kind == IP:
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in span.split("."))
    if kind == CARD:
        digits = _digits(span)
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind != PHONE or 9 <= len(_digits(span)) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of addresses, found from their `@`, so that no long word is read twice."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def matches(text: str) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of all leftmost matches of the base patterns."""
    for start, end in _emails(text):
        yield EMAIL, start, end
    if _DIGIT.search(text):
        for kind, pattern in ((IP, _IP), (CARD, _CARD), (PHONE, _PHONE)):
            for found in pattern.finditer(text):
                yield kind, found.start(), found.end()


# --- candidates and labelers ------------------------------------------------

_NAME_PART = r"[^\W\d_a-z][^\W\d_]+(?:[-'][^\W\d_]+)?"
_MORE = (
    (
        EMAIL,
        re.compile(
            r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[({] ?(?:at|AT|@) ?[\])}] ?[A-Za-z0-9-]++"
            r"(?: ?(?:[\[({] ?(?:dot|DOT|\.) ?[\])}]|\.) ?[A-Za-z0-9-]++)+"
        ),
    ),
    (CARD, re.compile(r"(?<![0-9A-Za-z])[0-9]{12,19}(?![0-9A-Za-z])")),
    (CARD, re.compile(r"(?<![0-9])[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])")),
    (PHONE, re.compile(r"(?<![0-9A-Za-z+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])")),
    (
        NAME,
        re.compile(
            r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra)\b\.? "
            rf"(?P<span>{_NAME_PART}(?: {_NAME_PART})?)"
        ),
    ),
    (NAME, re.compile(rf"\b(?:[Mm]y name is|[Ii]ch heiße|[Jj]e m'appelle|[Mm]e llamo) (?P<span>{_NAME_PART}(?: {_NAME_PART})?)")),
)
_TITLE_OR_DIGIT = re.compile(r"[0-9]|\[|\(|\{|Mr|Ms|Dr|Prof|Herr|Frau|Mons|Mad|Mme|Se|Sr|name is|heiße|appelle|llamo")

# Fixed values of the gazetteer: first names, endings of hosts, calling codes, first digits of card issuers.
_FIRST_NAMES = frozenset(
    "james mary john patricia robert jennifer michael linda william elizabeth david barbara richard susan joseph "
    "jessica thomas sarah charles karen hans peter wolfgang klaus jürgen ursula monika petra sabine renate jean "
    "pierre michel marie nathalie isabelle françoise nicolas antonio josé manuel francisco carmen maría ana isabel "
    "juan luis".split()
)
_ENDINGS = frozenset("com org net edu gov de fr es uk eu io info at ch it nl us ca".split())
_CALLING = re.compile(r"\+(?:1|2[07]|3[0-9]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])")
_ISSUER = re.compile("3[47]|4|5[1-5]|6")
# Words near a span that speak for its kind, or against any.
_CUES = (
    re.compile(r"\b(?:e-?mail|mail|contact|write to|kontakt|correo|courriel)\b", re.I),
    re.compile(r"\b(?:ip|address|host|server|adresse|servidor|serveur|login)\b", re.I),
    re.compile(r"\b(?:card|credit|visa|mastercard|karte|tarjeta|carte)\b", re.I),
    re.compile(r"\b(?:phone|call|tel|telefon|teléfono|téléphone|mobile|fax|handy)\b", re.I),
    re.compile(r"\b(?:name|signed|regards|dear|heiße|appelle|llamo)\b", re.I),
)
_AGAINST = re.compile(r"\b(?:version|isbn|order|invoice|token|key|sha\d*|hash|commit|figure|section|table|rechnung)\b|[=#/]\s*$", re.I)
_SHAPES = (
    re.compile(r"[A-Za-z0-9._%+-]{1,64}@[^@]*\.[A-Za-z]{2,24}"),
    re.compile(r"(?:[1-9][0-9]{0,2}|0)(?:\.(?:[1-9][0-9]{0,2}|0)){3}"),
    re.compile(r"[0-9]{13,16}|[0-9]{4}(?:[ -][0-9]{4}){3}|3[0-9]{3}[ -][0-9]{6}[ -][0-9]{5}"),
    re.compile(r"(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?(?:[ .-][0-9]{2,4}){1,4}"),
    re.compile(rf"{_NAME_PART}(?: {_NAME_PART})?"),
)
LABELERS = ("form", "shape", "gazetteer", "context", "edges")
NOTHING, NO, YES = range(3)


def _form(kind: int, span: str) -> int:
    if kind == NAME or kind == EMAIL and "@" not in span or kind == PHONE and span[0] != "+":
        return NOTHING
    return YES if valid(kind, span) else NO


def _gazetteer(kind: int, span: str) -> int:
    if kind == EMAIL:
        known = re.split(r"[^a-z]+", span.lower().rstrip(" )]}"))[-1] in _ENDINGS
    elif kind == CARD:
        known = bool(_ISSUER.match(span))
    elif kind == PHONE:
        known = bool(_CALLING.match(span))
    elif kind == NAME:
        known = span.split()[0].lower() in _FIRST_NAMES
    else:
        known = not span.startswith("0") and int(span.split(".")[0][-4:]) < 240
    return YES if known else NOTHING


def _context(kind: int, before: str, after: str) -> int:
    if _AGAINST.search(before):
        return NO
    return YES if _CUES[kind].search(before) or _CUES[kind].search(after) else NOTHING


def votes(kind: int, text: str, start: int, end: int) -> list[int]:
    """What every labeler says of a span."""
    span, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 24]
    glued = bool(re.search(r"[\w=\"'/]\Z", before) or re.match(r"[\w=\"'/]", after))
    return [
        _form(kind, span),
        YES if len(span) <= 200 and _SHAPES[kind].fullmatch(span) else NO,
        _gazetteer(kind, span),
        _context(kind, before, after),
        NO if glued else YES,
    ]


def features(kind: int, text: str, start: int, end: int) -> list[int]:
    """Hashed features of a span: its form, its neighbouring words and marks."""
    span = re.sub(r"[^\W\d_]", "a", re.sub("[0-9]", "9", text[start : min(end, start + 80)]))
    left = text[max(0, start - 40) : start].lower().split()[-2:]
    right = text[end : end + 24].lower().split()[:1]
    told = [
        f"f{span}",
        "r" + re.sub(r"(.)\1+", r"\1+", span),
        f"n{min(end - start, 40) // 4}",
        f"b{text[start - 1 : start]}",
        f"e{text[end : end + 1]}",
        *(f"l{w[-12:]}" for w in left),
        *(f"w{w[:12]}" for w in right),
        "",
    ]
    return [zlib.crc32(f"{kind}{t}".encode()) % _FEATURES for t in told]


@dataclass
class Span:
    kind: int
    start: int
    end: int
    base: bool


def spans_of(text: str) -> list[Span]:
    """Base spans, matches of base patterns that are out of range, and further
    candidates that overlap no base span, by start and kind."""
    found = [Span(kind, start, end, valid(kind, text[start:end])) for kind, start, end in matches(text)]
    if not _TITLE_OR_DIGIT.search(text):
        return found
    base = sorted((s.start, s.end) for s in found if s.base)
    more: dict[tuple[int, int, int], Span] = {(s.kind, s.start, s.end): s for s in found}
    starts, reach, far = [a for a, _ in base], [], 0
    for _, end in base:
        far = max(far, end)
        reach.append(far)
    for kind, pattern in _MORE:
        for m in pattern.finditer(text):
            start, end = m.span("span") if kind == NAME else m.span()
            at = int(np.searchsorted(starts, end)) - 1
            if at < 0 or reach[at] <= start:
                more.setdefault((kind, start, end), Span(kind, start, end, False))
    return sorted(more.values(), key=lambda s: (s.start, s.kind, s.end))


# --- reliabilities and classifier -------------------------------------------


@dataclass
class Reliabilities:
    prior: np.ndarray  # of every kind
    yes: np.ndarray  # labeler: chance of yes where it is data, if it says anything
    no: np.ndarray  # labeler: chance of no where it is none

    def probability(self, kind: np.ndarray, said: np.ndarray) -> np.ndarray:
        """That spans with these votes (span, labeler) are data."""
        tiny = 1e-12
        real = np.log(self.prior[kind] + tiny)
        none = np.log(1 - self.prior[kind] + tiny)
        for j in range(said.shape[1]):
            real = real + np.select([said[:, j] == YES, said[:, j] == NO], [np.log(self.yes[j]), np.log(1 - self.yes[j])], 0.0)
            none = none + np.select([said[:, j] == YES, said[:, j] == NO], [np.log(1 - self.no[j]), np.log(self.no[j])], 0.0)
        return 1 / (1 + np.exp(np.clip(none - real, -500, 500)))


def estimate(kind: np.ndarray, said: np.ndarray, count: np.ndarray, rounds: int = 100) -> Reliabilities:
    """Expectation-maximisation over patterns of votes and their counts.

    Labelers err independently, given whether a span is data. Each starts, and
    is held by a weak prior, at being right in four cases of five."""
    labelers = said.shape[1]
    model = Reliabilities(np.full(len(KINDS), 0.5), np.full(labelers, 0.8), np.full(labelers, 0.8))
    for _ in range(rounds):
        real = model.probability(kind, said) * count
        none = count - real
        weight = np.bincount(kind, count, len(KINDS))
        prior = (np.bincount(kind, real, len(KINDS)) + 1) / (weight + 2)
        yes, no = np.empty(labelers), np.empty(labelers)
        for j in range(labelers):
            is_yes, is_no = said[:, j] == YES, said[:, j] == NO
            yes[j] = (real[is_yes].sum() + 8) / (real[is_yes | is_no].sum() + 10)
            no[j] = (none[is_no].sum() + 8) / (none[is_yes | is_no].sum() + 10)
        model = Reliabilities(prior, yes, no)
    return model


def train(rows: list[list[int]], target: np.ndarray, weight: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Weights of a logistic classifier of hashed features for soft targets."""
    out = np.zeros(_FEATURES)
    if not rows:
        return out
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    at = np.array([i for r in rows for i in r])
    weight = weight / weight.sum()
    seen = np.full(_FEATURES, 1e-8)
    for _ in range(rounds):
        score = np.bincount(of, out[at], len(rows))
        error = weight * (target - 1 / (1 + np.exp(-score)))
        slope = np.bincount(at, error[of], _FEATURES) - 1e-5 * out
        seen += slope**2
        out += 0.3 * slope / np.sqrt(seen)
    return out


def _scores(weights: np.ndarray, rows: list[list[int]]) -> np.ndarray:
    return np.array([1 / (1 + np.exp(-weights[r].sum())) for r in rows])


_FOUND = "array<struct<kind:int,start:long,end:long,base:boolean,votes:array<int>,features:array<int>>>"


def _found(texts: DataFrame, text: str, name: str) -> DataFrame:
    """`texts` with all candidates of each text instead of the text."""
    at = texts.columns.index(text)
    kept = [f for f in texts.schema.fields if f.name != text]
    item = pa.list_(
        pa.struct(
            [
                ("kind", pa.int32()),
                ("start", pa.int64()),
                ("end", pa.int64()),
                ("base", pa.bool_()),
                ("votes", pa.list_(pa.int32())),
                ("features", pa.list_(pa.int32())),
            ]
        )
    )

    def described(value: str | None) -> list[dict]:
        if not value:
            return []
        return [
            {
                "kind": s.kind,
                "start": s.start,
                "end": s.end,
                "base": s.base,
                "votes": votes(s.kind, value, s.start, s.end),
                "features": features(s.kind, value, s.start, s.end),
            }
            for s in spans_of(value)
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array((described(v.as_py()) for v in batch.column(at)), item, size=batch.num_rows)
            rest = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, made], names=[*(f.name for f in kept), name])

    fields = StructType(kept).jsonValue()["fields"]
    found = StructType.fromDDL(f"x {_FOUND}").jsonValue()["fields"][0] | {"name": name}
    return texts.mapInArrow(run, StructType.fromJson({"type": "struct", "fields": [*fields, found]}))


def fitted(found: DataFrame, column: str) -> tuple[Reliabilities, np.ndarray]:
    """Reliabilities over the votes of all candidates, and the classifier's
    weights from at most `FIT_SPANS` of them, at most `FIT_SPANS_ALIKE` of a
    kind and pattern of votes, weighted by how many there are."""
    rows = found.select(F.explode(column).alias("x")).select("x.kind", "x.votes", "x.features")
    counts = {(r["kind"], tuple(r["votes"])): r["n"] for r in rows.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()}
    keys = sorted(counts)
    kind = np.array([k for k, _ in keys], dtype=np.int64)
    said = np.array([v for _, v in keys], dtype=np.int64).reshape(len(keys), len(LABELERS))
    count = np.array([counts[k] for k in keys], dtype=np.float64)
    model = estimate(kind, said, count)
    chance = dict(zip(keys, model.probability(kind, said)))
    digest = F.xxhash64("features")
    alike = Window.partitionBy("kind", "votes").orderBy(digest, "features")
    sample = (
        rows.groupBy("kind", "votes", "features")  # copies count once
        .agg(F.count("*").alias("n"))
        .withColumn("rank", F.row_number().over(alike))
        .where(F.col("rank") <= FIT_SPANS_ALIKE)
        .orderBy(digest, "kind", "votes")
        .limit(FIT_SPANS)
        .collect()
    )
    own = [(r["kind"], tuple(r["votes"])) for r in sample]
    drawn = Counter(own)
    target = np.array([chance[k] for k in own])
    weight = np.array([counts[k] / drawn[k] for k in own])
    return model, train([r["features"] for r in sample], target, weight)


def personal_data(
    docs: DataFrame, text: str = "text", spans: str = "spans", least: float = LEAST
) -> DataFrame:
    """`docs` without `text`, with `spans`: (kind, start, end, base) of all
    personal data in it, by start and then kind, in code points, the end
    exclusive. `base` marks those of the base patterns, which always stay.

    Other candidates are added if the votes give them a probability of `least`
    and the classifier agrees. A null text is empty and has no spans; repeated
    rows are searched each; an empty table gives none; texts of any length are
    searched whole, and no pattern reads a part of them more than a few times.
    """
    name = unique_name(docs, "found")
    found = written(_found(docs, text, name), "personal-data")
    model, weights = fitted(found, name)
    shared = docs.sparkSession.sparkContext.broadcast((model, weights))  # of fixed size
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
    at = found.columns.index(name)
    names = [*(c for c in found.columns if c != name), spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, weights = shared.value
        for batch in batches:
            out = []
            for row in batch.column(at).to_pylist():
                if row:
                    kind = np.array([s["kind"] for s in row])
                    chance = model.probability(kind, np.array([s["votes"] for s in row]))
                    score = _scores(weights, [s["features"] for s in row])
                    row = _chosen(row, chance, score, least)
                out.append([{"kind": KINDS[s["kind"]], **{k: s[k] for k in ("start", "end", "base")}} for s in row])
            rest = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(out, item)], names=names)

    kept = [f for f in found.schema.fields if f.name != name]
    added = StructType.fromDDL("x array<struct<kind:string,start:long,end:long,base:boolean>>").fields[0]
    added.name = spans
    return found.mapInArrow(run, StructType([*kept, added]))


def _chosen(row: list[dict], chance: np.ndarray, score: np.ndarray, least: float) -> list[dict]:
    """Base spans and, best first, added ones that overlap none chosen before."""
    out = [s for s in row if s["base"]]
    more = [i for i, s in enumerate(row) if not s["base"] and chance[i] >= least and score[i] >= 0.5]
    taken: list[tuple[int, int]] = []  # apart from each other, in order
    for i in sorted(more, key=lambda i: (-chance[i], row[i]["start"], row[i]["kind"], row[i]["end"])):
        s = row[i]
        at = bisect_left(taken, (s["end"],))
        if not at or taken[at - 1][1] <= s["start"]:
            taken.insert(at, (s["start"], s["end"]))
            out.append(s)
    return sorted(out, key=lambda s: (s["start"], s["kind"], s["end"]))


def span_digests(docs: DataFrame) -> DataFrame:
    """One row per document of (doc_id, text): doc_id, the number of base spans
    of each kind, base_sha256 and `spans` (kind:start:end, comma-joined)."""
    found = personal_data(docs.select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of_kind(kind: str) -> Column:
        return F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))

    return found.select(
        "doc_id",
        *[F.size(of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in KINDS[:4]],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
