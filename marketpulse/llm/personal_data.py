"""Personal data: fixed base patterns, and a semi-Markov conditional random field that adds spans.

Base spans (email, ip, card, phone) follow plain patterns, leftmost and non-overlapping per
kind. The field reads regions: neighbouring blank-separated pieces that hold a digit or @,
as tokens (digit runs, letter runs, single other characters). A segmentation gives each token
to a one-token outside segment or to an entity of at most LONGEST tokens and a kind. Features
of a whole span (digit count, validity of checksums and octets, marks, first and last
character, neighbours) and of adjacent kinds score it, and dynamic programming finds the best
segmentation of a region, boundaries and kinds together.

Weights are trained on at most EXAMPLES different regions per kind of base span (and as many
without), chosen by a hash; a region that occurs often counts once, so copies take no places.
The gold segmentation is the base spans. Training maximises the conditional
likelihood by stochastic gradient: expected feature counts come from the forward-backward
recursion over the same segments. Spans that the field finds with a mean log odds of at least
MARGIN over outside and that overlap no base span are added.

Defined results: null text counts as empty, without spans. Without any base span in the
corpus nothing is added. Equal texts get equal spans; no rows give no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .selection import distinct_sample

KINDS = ("email", "ip", "card", "phone")
LONGEST = 16
EXAMPLES = 120
EPOCHS = 6
RATE = 0.2
DECAY = 1e-3
MARGIN = 1.0
#: Longest region that is used for training.
TRAINED = 120

Span = tuple[int, int, str]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SEED = re.compile("[0-9@]")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s+|[\W_]")
_BLANK = "\x20\t\n\x0b\x0c\r"


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def _digits(value: str) -> str:
    return "".join(c for c in value if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern's leftmost matches: each @ with the longest local part left over before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) by start, then kind."""
    out: list[Span] = [(a, b, "email") for a, b in _emails(text)]
    if _SEED.search(text):
        out += [(*m.span(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
        out += [(*m.span(), "card") for m in _CARD.finditer(text) if 12 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
        out += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def regions(text: str) -> list[tuple[int, int]]:
    """(start, end) of runs of blank-separated pieces that each hold a digit or @."""
    out: list[tuple[int, int]] = []
    at = 0
    while m := _SEED.search(text, at):
        start, end = m.start(), m.end()
        while start > at and text[start - 1] not in _BLANK:
            start -= 1
        while end < len(text) and text[end] not in _BLANK:
            end += 1
        if out and out[-1][1] + 1 == start and text[start - 1] == " ":
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
        at = end
    return out


def span_features(value: str, before: str, after: str) -> list[str]:
    """Features of a whole span and its neighbours."""
    d = _digits(value)
    parts = value.split(".")
    octets = len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)
    mail = value.partition("@")
    n = len(d)
    size = "0" if n == 0 else "1-6" if n < 7 else "7-8" if n < 9 else "9-11" if n < 12 else "12-15" if n < 16 else "16-19" if n < 20 else "20+"
    out = ["bias", "digits=" + size, "first=" + _class(value[:1]), "last=" + _class(value[-1:]), "before=" + _class(before), "after=" + _class(after)]
    if octets:
        out.append("octets")
    if 12 <= n <= 19 and all(c in "0123456789 -" for c in value):
        out.append("luhn" if luhn(d) else "not luhn")
    if mail[0] and "." in mail[2].strip(".") and not any(c in _BLANK for c in value):
        out.append("mail")
    if any(c.isalpha() for c in value):
        out.append("letters")
    out += [f"has {c}" for c in "+()-. @" if c in value]
    return out


def _class(c: str) -> str:
    return "none" if not c else "digit" if c.isdigit() else "letter" if c.isalpha() else "blank" if c in _BLANK else c


class Field:
    """A semi-Markov field: weights of (kind, feature) and of (previous kind, kind)."""

    def __init__(self) -> None:
        self.weights: dict[tuple[str, str], float] = defaultdict(float)

    def segments(self, text: str, start: int, end: int) -> tuple[list[int], list[list[tuple[int, list[str]]]]]:
        """Token bounds of a region, and for each end bound the possible entities (first bound, features)."""
        bounds = [start, *(m.end() for m in _TOKEN.finditer(text, start, end))]
        seeds = [0]
        for a, b in zip(bounds, bounds[1:]):
            seeds.append(seeds[-1] + bool(_SEED.search(text, a, b)))
        out: list[list[tuple[int, list[str]]]] = [[]]
        for j in range(1, len(bounds)):
            here = []
            if text[bounds[j] - 1] not in _BLANK:
                for i in range(max(0, j - LONGEST), j):
                    if seeds[j] > seeds[i] and text[bounds[i]] not in _BLANK:
                        here.append((i, span_features(text[bounds[i] : bounds[j]], text[bounds[i] - 1 : bounds[i]] if bounds[i] else "", text[bounds[j] : bounds[j] + 1])))
            out.append(here)
        return bounds, out

    def score(self, kind: str, feats: list[str]) -> float:
        get = self.weights.get
        return sum(get((kind, f), 0.0) for f in feats)

    def best(self, text: str, start: int, end: int) -> list[tuple[Span, float]]:
        """Entities of the best segmentation, each with its score over that of outside tokens (0)."""
        bounds, entities = self.segments(text, start, end)
        states = ("", *KINDS)
        table: list[dict[str, tuple[float, int, str, float]]] = [{"": (0.0, 0, "", 0.0)}]
        get = self.weights.get
        for j in range(1, len(bounds)):
            cell: dict[str, tuple[float, int, str, float]] = {}
            value, previous = max(((v[0] + get((p, ""), 0.0), p) for p, v in table[j - 1].items()), key=lambda x: (x[0], -states.index(x[1])))
            cell[""] = (value, j - 1, previous, 0.0)
            for i, feats in entities[j]:
                for kind in KINDS:
                    own = self.score(kind, feats)
                    for p, v in table[i].items():
                        total = v[0] + get((p, kind), 0.0) + own
                        if kind not in cell or total > cell[kind][0]:
                            cell[kind] = (total, i, p, own)
            table.append(cell)
        out, j, state = [], len(bounds) - 1, max(table[-1], key=lambda k: table[-1][k][0])
        while j > 0:
            _, i, previous, own = table[j][state]
            if state:
                out.append(((bounds[i], bounds[j], state), own))
            j, state = i, previous
        return out[::-1]

    def learn(self, text: str, start: int, end: int, gold: list[Span]) -> None:
        """One gradient step on the log likelihood of the gold segmentation."""
        bounds, entities = self.segments(text, start, end)
        place = {b: k for k, b in enumerate(bounds)}
        wanted = {(place[a], place[b]): kind for a, b, kind in gold if a in place and b in place}
        n, states, get = len(bounds), ("", *KINDS), self.weights.get
        # edges: (i, j, kind, features); forward and backward sums per bound and kind of the last segment
        into: list[list[tuple[int, str, list[str], float]]] = [[]]
        for j in range(1, n):
            edges = [(j - 1, "", [], 0.0)]
            edges += [(i, kind, feats, self.score(kind, feats)) for i, feats in entities[j] for kind in KINDS]
            into.append(edges)
        low = -1e30
        forward = [dict.fromkeys(states, low) for _ in range(n)]
        forward[0][""] = 0.0
        for j in range(1, n):
            sums: dict[str, list[float]] = {s: [] for s in states}
            for i, kind, _, own in into[j]:
                sums[kind] += [forward[i][p] + get((p, kind), 0.0) + own for p in states if forward[i][p] > low]
            for s in states:
                forward[j][s] = _logsum(sums[s])
        back = [dict.fromkeys(states, low) for _ in range(n)]
        back[-1] = dict.fromkeys(states, 0.0)
        gathered: list[dict[str, list[float]]] = [{s: [] for s in states} for _ in range(n)]
        for j in range(n - 1, 0, -1):
            if j < n - 1:
                back[j] = {s: _logsum(gathered[j][s]) for s in states}
            for i, kind, _, own in into[j]:
                for p in states:
                    gathered[i][p].append(get((p, kind), 0.0) + own + back[j][kind])
        whole = _logsum(list(forward[-1].values()))
        change: dict[tuple[str, str], float] = defaultdict(float)
        for j in range(1, n):
            for i, kind, feats, own in into[j]:
                for p in states:
                    mass = forward[i][p] + get((p, kind), 0.0) + own + back[j][kind] - whole
                    if mass > -12:
                        share = math.exp(mass)
                        change[p, kind] -= share
                        for f in feats:
                            change[kind, f] -= share
        j, steps = n - 1, []
        ends = {b: (a, kind) for (a, b), kind in wanted.items()}
        while j > 0:
            i, kind = ends.get(j, (j - 1, ""))
            steps.append((i, j, kind))
            j = i
        previous = ""
        for i, j, kind in reversed(steps):
            change[previous, kind] += 1
            if kind:
                for f in next((f for a, f in entities[j] if a == i), []):
                    change[kind, f] += 1
            previous = kind
        for key, c in change.items():
            self.weights[key] += RATE * (c - DECAY * self.weights[key])


def _logsum(values: list[float]) -> float:
    top = max(values, default=-1e30)
    return top if top <= -1e29 else top + math.log(sum(math.exp(v - top) for v in values))


def added_spans(text: str, base: list[Span], weights: Field) -> list[Span]:
    """Spans that the field adds: clear ones that overlap no base span."""
    out = []
    for start, end in regions(text):
        near = [s for s in base if s[0] < end and s[1] > start]
        for (a, b, kind), own in weights.best(text, start, end):
            if own >= MARGIN and not any(s[0] < b and a < s[1] for s in near):
                out.append((a, b, kind))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for value in batch.column("text"):
            text = value.as_py() or ""
            base = base_spans(text) if _SEED.search(text) else []
            for a, b in regions(text):
                if b - a <= TRAINED:
                    low, high = max(0, a - 1), min(len(text), b + 1)
                    inside = [s for s in base if s[0] >= a and s[1] <= b]
                    # of overlapping gold spans the longest stays
                    gold = [s for s in inside if not any(t != s and t[0] < s[1] and s[0] < t[1] and (t[1] - t[0], -t[0]) > (s[1] - s[0], -s[0]) for t in inside)]
                    rows.append((text[low:high], a - low, b - low, joined([(x - low, y - low, k) for x, y, k in gold]), gold[0][2] if gold else ""))
        if rows:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["region", "low", "high", "gold", "kind"])


def fit(docs: DataFrame) -> Field:
    """The field trained on at most EXAMPLES regions per kind of base span and without one."""
    examples = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_examples, "region string, low int, high int, gold string, kind string")
    # the region without its neighbours, which are blanks
    sample = distinct_sample(examples.withColumn("own", F.expr("substring(region, low + 1, high - low)")), "kind", "own", EXAMPLES)
    kinds = [[r for r in sample if r.kind == k] for k in ("", *KINDS)]
    rows = [r for turn in zip_longest(*kinds) for r in turn if r]  # kinds in turn
    weights = Field()
    if not any(r.kind for r in rows):
        return weights
    for _ in range(EPOCHS):
        for r in rows:
            gold = [(int(a), int(b), k) for k, a, b in (s.split(":") for s in r.gold.split(",") if s)]
            weights.learn(r.region, r.low, r.high, gold)
    return weights


def finder(weights: Field):
    """A column function from text to counts and spans."""

    @F.arrow_udf("struct<n_email: long, n_ip: long, n_card: long, n_phone: long, base_sha256: string, spans: string>")
    def find(texts: pa.Array) -> pa.Array:
        empty = hashlib.sha256(b"").hexdigest()
        counts: list[list[int]] = [[] for _ in KINDS]
        base_sha, spans = [], []
        for low in range(0, len(texts), 500):
            for text in texts.slice(low, 500).to_pylist():
                if not text or not _SEED.search(text):
                    base, every = [], ""
                else:
                    base = base_spans(text)
                    every = joined(base + added_spans(text, base, weights))
                for column, kind in zip(counts, KINDS):
                    column.append(sum(s[2] == kind for s in base))
                base_sha.append(hashlib.sha256(joined(base).encode()).hexdigest() if base else empty)
                spans.append(every)
        columns = [*(pa.array(c, pa.int64()) for c in counts), pa.array(base_sha, pa.string()), pa.array(spans, pa.string())]
        return pa.StructArray.from_arrays(columns, ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return find


def personal_data(docs: DataFrame, weights: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: one row per row of `docs`."""
    find = finder(fit(docs) if weights is None else weights)
    return docs.select("doc_id", find(F.col("text").cast("string")).alias("f")).select("doc_id", "f.*")
