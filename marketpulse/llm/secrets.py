"""Secrets: wide candidates, and a random forest that removes the false positives.

A candidate is a run of 16 or more characters of keys and paths that holds a digit, a value of
8 or more characters assigned to a name that says secret (with a digit, or in quotes), or a
block of a private key. An assignment sign ends a run, so name and value are apart. Its
features are length, entropy, character classes and transitions between them, how much of it
the dictionary covers, marks of paths and addresses, and the words and signs before it. The
dictionary is the whole words of a public vocabulary file, whose path is a parameter.

The forest is trained on labelled findings: (finding, before, label) rows, or, where none are
given, the made ones of `secret_examples`, whose labels follow from how each text was made, and
BACKGROUND candidates of the documents that no sign of a secret surrounds, as negatives. At most
FINDINGS different strings per label are taken, chosen by a hash; a string that occurs often
counts once. Trees see bootstrap rows and a random half of the features at each split; all
random numbers have fixed seeds. Candidates whose mean leaf value reaches THRESHOLD are secrets:
the forest alone decides. Features see BEFORE characters before a candidate.

Defined results: null text counts as empty and has none (and stays null when redacted);
without any labelled positive nothing is a secret. Equal texts get equal findings. Rows and
other columns stay as they are; no rows give no rows.
"""

from __future__ import annotations


import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .secret_examples import labelled_examples
from .selection import distinct_sample

VOCABULARY = "byte_bpe_50k.json"
FINDINGS = 3_000
BACKGROUND = 1_000
BEFORE = 40
TREES = 24
DEPTH = 7
THRESHOLD = 0.5
MASK = "[SECRET]"

_RUN = re.compile(r"(?<![A-Za-z0-9_+/.@~-])[A-Za-z0-9_+/.@~-]{16,}(?:={1,2}(?![A-Za-z0-9_+/=.@~-]))?")
# Names of secret settings, and prefixes that providers give their keys.
_NAMES = re.compile(r"(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth|bearer)\W*$", re.I)
_PREFIX = re.compile(r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk_(?:live|test)_[0-9A-Za-z]{16,}|xox[abprs]-[0-9A-Za-z-]{16,}|eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.)")
_DIGEST = re.compile(r"(?:sha-?\d*|md5|commit|digest|checksum|integrity|etag|rev|revision|hash|blob|fingerprint|base64|uuid|guid|id|trace|session)\W*$", re.I)
_UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I)
_PLACEHOLDER = re.compile(r"your[-_]|change-?me|placeholder|replace|insert|dummy|[-_]here|^[<$*]|(.)\1{7}", re.I)
_PASSWORD = re.compile(r"(?:password|passwd|pwd)\W*$", re.I)
_ASSIGNED = re.compile(r"""["']?\s{0,3}[=:]\s*["']?$""")
_VALUE = re.compile(
    r"""(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth|bearer)["']?\s{0,3}[=:]\s{0,3}"""
    r"""(?:"([^\s"']{8,})"|'([^\s"']{8,})'|([A-Za-z0-9_+/.@~-]{8,}(?:={1,2}(?![A-Za-z0-9_+/=.@~-]))?))""",
    re.I,
)
_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----")
_BODY = re.compile(r"(?:(?:\s|\\[nr])*[A-Za-z0-9+/]{16,}={0,2})+")


def key_blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) of private keys: from BEGIN to the dashes after END, or to the last line of a cut one."""
    out = []
    for m in _BLOCK.finditer(text):
        close = text.find("-----", m.end())
        end = text.find("-----", close + 5) if close >= 0 and text.startswith("END ", close + 5) else -1
        body = _BODY.search(text, m.end(), close if end >= 0 else min(len(text), m.end() + 40))
        if body and end >= 0:
            out.append((m.start(), end + 5))
        elif body:
            out.append((m.start(), _BODY.match(text, body.start()).end()))
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of every candidate, in order and apart; runs are without dots and signs at their ends."""
    found = key_blocks(text)
    for m in _VALUE.finditer(text):
        low, high = m.span(m.lastindex)
        while m.lastindex == 3 and high > low and text[high - 1] == ".":
            high -= 1
        if high - low >= 8 and (m.lastindex < 3 or re.search("[0-9]", text[low:high])):
            found.append((low, high))
    for m in _RUN.finditer(text):
        low, high = m.span()
        while low < high and text[low] in ".-/+@":
            low += 1
        while low < high and text[high - 1] in ".-/@+":
            high -= 1
        if high - low >= 16 and re.search("[0-9]", m.group()):
            found.append((low, high))
    # blocks and values come before runs that overlap them
    return _apart([(low, high, rank) for rank, (low, high) in enumerate(found)])


def _apart(found: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The spans in order; of overlapping ones the first listed (smallest rank) stays."""
    kept: list[tuple[int, int, int]] = []
    for span in sorted(found):
        while kept and kept[-1][1] > span[0] and kept[-1][2] > span[2]:
            kept.pop()
        if not kept or kept[-1][1] <= span[0]:
            kept.append(span)
    return [(low, high) for low, high, _ in kept]


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


@lru_cache(maxsize=2)
def dictionary(path: str) -> frozenset[str]:
    """The lower-case words of four or more letters that a vocabulary file holds as one token."""
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    return frozenset(t[1:].lower() for t in vocabulary if len(t) > 4 and t[0] == "Ġ" and t[1:].isascii() and t[1:].isalpha())


def covered(value: str, words: frozenset[str]) -> float:
    """The share of the characters inside dictionary words, longest first from the left."""
    low, at, hit = value.lower(), 0, 0
    while at < len(low):
        size = next((k for k in range(min(14, len(low) - at), 3, -1) if low[at : at + k] in words), 0)
        hit += size
        at += size or 1
    return hit / len(low)


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if "a" <= c <= "z" else 2 if "A" <= c <= "Z" else 3


def features(value: str, before: str, words: frozenset[str]) -> list[float]:
    kinds = [_kind(c) for c in value]
    n = len(value)
    return [
        n,
        entropy(value),
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
        kinds.count(0) / n,
        kinds.count(2) / n,
        kinds.count(3) / n,
        sum(c in "0123456789abcdefABCDEF" for c in value) / n,
        covered(value, words),
        value.count("/") + value.count("\\"),
        value.count("."),
        float("@" in value),
        float(bool(re.search(r"(?:https?:/*|www\.|path|file|url|href)\W*$", before, re.I))),
        float(bool(_NAMES.search(before))),
        float(bool(_ASSIGNED.search(before))),
        float(before[-1:] in "\"'"),
        float(bool(_PREFIX.match(value))),
        float(bool(_BLOCK.match(value))),
        float(bool(_DIGEST.search(before))),
        float(bool(_PASSWORD.search(before))),
        float(bool(_UUID.fullmatch(value))),
        float(bool(_PLACEHOLDER.search(value))),
        len(set(value)) / n,
        value.count("_") / n,
    ]


def _like_a_path(value: str) -> bool:
    """Slashes between words; base64 has both cases, digits and more entropy."""
    mixed = all(re.search(c, value) for c in ("[0-9]", "[a-z]", "[A-Z]"))
    return "/" in value and not (mixed and "." not in value and entropy(value) >= 4.2)


def strict_label(value: str, before: str) -> int:
    assigned = _ASSIGNED.search(before)
    named = assigned and _NAMES.search(before[: assigned.start()] + " ")
    # 16 characters or more need an entropy of 3, shorter ones as much of what they can have
    varied = entropy(value) >= min(3.0, 0.75 * math.log2(max(2, len(value))))
    email = re.fullmatch(r"[^@]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", value)
    return int(bool(_BLOCK.match(value)) or bool(_PREFIX.match(value)) or bool(named and varied and not email and not _like_a_path(value)))


class Forest:
    """Classification trees as arrays: split feature (-1 in a leaf), threshold, children, leaf value."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 17) -> None:
        self.trees = []
        for k in range(trees if len(y) and y.any() else 0):
            rng = np.random.default_rng(seed + k)
            rows = rng.integers(0, len(y), len(y))
            nodes: list[list[float]] = []
            self._grow(x[rows], y[rows], depth, rng, nodes)
            self.trees.append(np.array(nodes))

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator, nodes: list[list[float]]) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, 0, 0, y.mean()])
        best = (y.mean() * (1 - y.mean()) * len(y) - 1e-9, -1, 0.0)
        if depth and best[0] > 0:
            for f in rng.permutation(x.shape[1])[: (x.shape[1] + 1) // 2]:
                for cut in np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 15))):
                    left = x[:, f] <= cut
                    n = left.sum()
                    if 0 < n < len(y):
                        a, b = y[left].mean(), y[~left].mean()
                        cost = a * (1 - a) * n + b * (1 - b) * (len(y) - n)
                        if cost < best[0]:
                            best = (cost, f, cut)
        if best[1] >= 0:
            left = x[:, best[1]] <= best[2]
            nodes[at][:2] = best[1:]
            nodes[at][2] = self._grow(x[left], y[left], depth - 1, rng, nodes)
            nodes[at][3] = self._grow(x[~left], y[~left], depth - 1, rng, nodes)
        return at

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for nodes in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := nodes[at, 0] >= 0).any():
                here = nodes[at[inner]]
                right = x[inner, here[:, 0].astype(int)] > here[:, 1]
                at[inner] = np.where(right, here[:, 3], here[:, 2]).astype(int)
            total += nodes[at, 4]
        return total / max(1, len(self.trees))


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _findings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text"):
            value = text.as_py() or ""
            rows += [(value[a:b], value[max(0, a - BEFORE) : a]) for a, b in candidates(value)]
        if rows:
            finding, before = zip(*rows)
            label = pa.array([strict_label(*r) for r in rows], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(finding, pa.string()), pa.array(before, pa.string()), label], ["finding", "before", "label"])


def labelled_findings(docs: DataFrame) -> DataFrame:
    """(finding, before, label) of all candidates, labelled by the strict rule."""
    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_findings, "finding string, before string, label int")


def training_findings(docs: DataFrame) -> DataFrame:
    """(finding, before, label): the made examples, and BACKGROUND candidates of the documents as negatives.

    Background are different candidates, the first by a hash, without a provider's prefix and
    not after a name of secrets, whatever their form.
    """
    plain = labelled_findings(docs).where("label = 0").where(~F.col("before").rlike(f"(?i){_NAMES.pattern}"))
    background = distinct_sample(plain, "label", "finding", BACKGROUND)
    rows = [r[:3] for r in labelled_examples(candidates, BEFORE)] + [(r.finding, r.before, 0) for r in background]
    return docs.sparkSession.createDataFrame(rows, "finding string, before string, label int")


def fit(findings: DataFrame, path: str | None = None) -> Forest:
    """The forest of at most FINDINGS labelled findings per label."""
    rows = distinct_sample(findings.where("label is not null and finding is not null").select("finding", "before", "label"), "label", "finding", FINDINGS)
    words = dictionary(path or vocabulary_path())
    x = np.array([features(r.finding, r.before or "", words) for r in rows])
    return Forest(x, np.array([r.label for r in rows], float))


def secret_spans(texts: list[str], forest: Forest, words: frozenset[str]) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of candidates, spans of secrets) of each text."""
    spans = [candidates(t) for t in texts]
    pairs = [(t[a:b], t[max(0, a - BEFORE) : a]) for t, s in zip(texts, spans) for a, b in s]
    rows = [features(*p, words) for p in pairs]
    scores = forest.score(np.array(rows)) if rows and forest.trees else [0.0] * len(rows)
    sure = iter([s >= THRESHOLD for s in scores])
    return [(len(s), [span for span in s if next(sure)]) for s in spans]


def scanner(forest: Forest, path: str | None = None):
    """A column function from text to n_candidates, n_secrets, findings (start:end, code points), redacted text."""

    @F.arrow_udf("struct<n_candidates: long, n_secrets: long, findings: string, redacted: string>")
    def scan(texts: pa.Array) -> pa.Array:
        words = dictionary(path or vocabulary_path())
        n, secrets, found, redacted = [], [], [], []
        for low in range(0, len(texts), 500):
            values = texts.slice(low, 500).to_pylist()
            for value, (count, spans) in zip(values, secret_spans([v or "" for v in values], forest, words)):
                n.append(count)
                secrets.append(len(spans))
                found.append(",".join(f"{a}:{b}" for a, b in spans))
                for a, b in reversed(spans):
                    value = value[:a] + MASK + value[b:]
                redacted.append(value)
        columns = [pa.array(n, pa.int64()), pa.array(secrets, pa.int64()), pa.array(found, pa.string()), pa.array(redacted, pa.string())]
        return pa.StructArray.from_arrays(columns, ["n_candidates", "n_secrets", "findings", "redacted"])

    return scan


def _digest(findings: Column) -> Column:
    return F.sha2(F.coalesce(findings, F.lit("")), 256)


def scan_documents(docs: DataFrame, findings: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """doc_id, n_candidates, n_secrets, findings, redacted_sha256: one row per row of `docs`."""
    scan = scanner(fit(training_findings(docs) if findings is None else findings, path), path)
    scanned = docs.select("doc_id", scan(F.col("text").cast("string")).alias("s"))
    return scanned.select("doc_id", "s.n_candidates", "s.n_secrets", "s.findings", _digest(F.col("s.redacted")).alias("redacted_sha256"))


def redact_documents(docs: DataFrame, findings: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """`docs` with every secret in `text` replaced by MASK, and `n_chars` (where there is one) counted anew."""
    scan = scanner(fit(training_findings(docs) if findings is None else findings, path), path)
    clean = docs.withColumn("text", scan(F.col("text").cast("string"))["redacted"])
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
