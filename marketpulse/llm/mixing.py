"""Mixing to target weights with soft domain membership, in DataFrame functions only.

Domains come from the labelled table: clean, toxic (good but toxic) and low (bad quality). A
naive Bayes classifier over hashed tokens (words, and their last two characters), fitted on at
most FIT_DOCS labelled documents, gives every document a posterior per domain; its log
odds are multiplied by SOFTNESS, since the tokens of a text aren't independent.

A document of n words with rate r counts r * n * posterior words to each domain. The rates are
the least-squares solution nearest to 1 inside [0, MAX_RATE]: they minimise the sum of
n * (rate - 1)^2 plus the squared misses of the domain totals over SLACK of the budget, so targets are
met to that share where rates inside the bounds can meet them, and missed by as little as can
be where not. The solution is a projection: a rate is 1 less the multipliers of the domains
weighted by the document's posterior, cut to the bounds, and a multiplier is its domain's
miss over SLACK of the budget. The gradient in the multipliers is one row of totals that Spark adds up over all
documents; it is measured by the inverse of the domains' joint weights (sums of n * posterior *
posterior over the documents whose rate is inside its bounds), and the best of HALVINGS step lengths is taken, all
of them measured in one pass. Nothing per document is stored or joined.

The budget is what keeps the rate of ANCHOR documents near 1: its words divided by its target
share. Rates above 1 repeat documents of domains below their share, at most MAX_RATE times. A
domain with less than LEAST_SHARE of all words isn't there to be mixed: its total is left as it is, and `missed_shares` says by how much.

A document is emitted floor(rate + u) times, u in (0, 1) fixed by doc_id: rate times on
average, and always where the rate is 1.

Defined results: null, empty or blank text has no words, the prior as posterior, and rate 1.
Without usable labels all posteriors are equal and rates only meet the budget, which then is
all words. Documents with contradictory labels aren't fitted on. Equal rows get equal rates
and copies. No rows give no rows. Columns of `mixed_documents` are those of `docs`.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialized
from .arrays import let, words
from .selection import uniform

DOMAINS = ("clean", "toxic", "low")
TARGETS = {"clean": 0.97, "toxic": 0.02, "low": 0.01}
ANCHOR = "clean"
FIT_DOCS = 5_000
BUCKETS = 1 << 14
SOFTNESS = 0.5
MAX_RATE = 8.0
#: A domain with a smaller share of all words (in posteriors) is out of reach.
LEAST_SHARE = 1e-3
SLACK = 1e-5
STEPS = 40
HALVINGS = 12
#: What SLACK leaves of the misses where rates inside the bounds can meet the targets, as a share of the budget.
TOLERANCE = 1e-3
SEED = 5
#: Log odds are whole multiples of 1 / UNIT, below _RAISE / UNIT in size.
UNIT = 64
_RAISE = 1 << 10
_PACKED = 1 << 20


def _buckets(word: Column) -> tuple[Column, Column]:
    """The buckets of a word and of its ending."""
    return _bucket(word), _bucket(F.substring(word, -2, 2)) + BUCKETS


def _bucket(part: Column) -> Column:
    return F.pmod(F.xxhash64(part), F.lit(BUCKETS)).cast("int")


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, domain number) of at most FIT_DOCS labelled documents, the first by a hash of doc_id."""
    one = labels.groupBy("doc_id").agg(*[f(F.coalesce(c, F.lit(0))).alias(f"{n}_{c}") for c in ("quality", "toxic") for n, f in (("low", F.min), ("high", F.max))])
    agreed = one.where("doc_id is not null and low_quality = high_quality and low_toxic = high_toxic")
    domain = F.when(F.col("low_quality") != 1, F.lit(2)).when(F.col("low_toxic") == 1, F.lit(1)).otherwise(F.lit(0))
    chosen = agreed.select("doc_id", domain.alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCS)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "domain")  # at most FIT_DOCS rows


def log_odds(docs: DataFrame, labels: DataFrame) -> tuple[list[float], list[list[int]]]:
    """Of toxic and low against clean: the prior's log odds, and those of each bucket as multiples of 1 / UNIT."""
    fitted = materialized(_labelled(docs, labels), "labelled")
    sizes = dict(fitted.groupBy("domain").agg(F.count(F.lit(1))).collect())
    found = F.explode(words(F.coalesce("text", F.lit(""))))
    tokens = fitted.select("domain", found.alias("word")).select("domain", F.explode(F.array(*_buckets(F.col("word")))).alias("bucket"))
    counts = {(d, b): n for d, b, n in tokens.groupBy("domain", "bucket").agg(F.count(F.lit(1))).collect()}  # at most 6 * BUCKETS rows
    totals = [sum(n for (d, _), n in counts.items() if d == k) + BUCKETS for k in range(3)]
    if not sizes:
        return [0.0, 0.0], [[0] * 2 * BUCKETS] * 2
    prior = [math.log((sizes.get(k, 0) + 0.5) / (sizes.get(0, 0) + 0.5)) for k in (1, 2)]
    odds = [
        [round(UNIT * (math.log((counts.get((k, b), 0) + 0.5) / totals[k]) - math.log((counts.get((0, b), 0) + 0.5) / totals[0]))) for b in range(2 * BUCKETS)]
        for k in (1, 2)
    ]
    return prior, odds


def membership(text: Column, prior: list[float], odds: list[list[int]]) -> Column:
    """Struct of n (words) and p (posteriors in the order of DOMAINS) of a non-null text.

    Both sums run in one pass, as the halves of one 64-bit number; each weight is raised by
    _RAISE to keep the halves apart. Runs of _PACKED words are summed like this, then added up.
    """
    raised = [[o + _RAISE for o in side] for side in odds]
    weights = F.from_json(F.lit(json.dumps([(a << 32) + b for a, b in zip(*raised)])), "array<long>")

    def halves(found: Column) -> Column:
        def add(s: Column, w: Column) -> Column:
            word, end = _buckets(w)
            return s + F.get(weights, word) + F.get(weights, end)

        packed = F.aggregate(found, F.lit(0).cast("long"), add)
        return let(packed, lambda s: F.array(F.shiftright(s, 32), s.bitwiseAND(F.lit((1 << 32) - 1))))

    def summed(found: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor(F.size(found) / _PACKED).cast("int"))
        none = F.array(F.lit(0).cast("long"), F.lit(0).cast("long"))
        return F.aggregate(runs, none, lambda s, k: let(halves(F.slice(found, k * _PACKED + 1, F.lit(_PACKED))), lambda h: F.array(s[0] + h[0], s[1] + h[1])))

    def posterior(sums: Column, n: Column) -> Column:
        logits = [F.lit(p) + SOFTNESS / UNIT * (sums[k] - 2 * _RAISE * n) for k, p in enumerate(prior)]

        def softmax(x: Column) -> Column:
            exps = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
            return let(exps, lambda e: F.transform(e, lambda v: v / (e[0] + e[1] + e[2])))

        return let(F.array(F.lit(0.0), *logits), softmax)

    def of_words(found: Column) -> Column:
        n = F.size(found).cast("long")
        return F.struct(n.alias("n"), let(summed(found), lambda s: posterior(s, n)).alias("p"))

    return let(words(text), of_words)


def rate_of(m: Column, multipliers: Sequence[float], max_rate: float) -> Column:
    """The rate of a document with membership `m`; without words 1."""
    pull = sum((m["p"][k] * F.lit(float(x)) for k, x in enumerate(multipliers)), F.lit(0.0))
    return F.when(m["n"] == 0, F.lit(1.0)).otherwise(F.least(F.lit(float(max_rate)), F.greatest(F.lit(0.0), F.lit(1.0) - pull)))


def fitted_multipliers(members: DataFrame, targets: dict[str, float], max_rate: float, slack: float = SLACK) -> list[float]:
    """The multipliers of the domains (0 where out of reach), from column `m`."""
    pairs = [(i, j) for i in range(3) for j in range(i + 1)]

    def measured(tried: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
        """For each vector of multipliers: domain totals, joint weights of the domains, distance of the rates from 1."""
        n, p, sums = F.col("m.n"), F.col("m.p"), []
        for x in tried:
            rate = rate_of(F.col("m"), x, max_rate)
            free = F.when((rate > 0) & (rate < max_rate), n).otherwise(F.lit(0))
            sums += [rate * n * p[k] for k in range(3)] + [free * p[i] * p[j] for i, j in pairs] + [n * (rate - 1) * (rate - 1)]
        found = np.array(members.agg(*[F.coalesce(F.sum(x), F.lit(0.0)) for x in sums]).first(), float).reshape(len(tried), -1)
        joint = np.zeros((len(tried), 3, 3))
        for at, (i, j) in enumerate(pairs):
            joint[:, i, j] = joint[:, j, i] = found[:, 3 + at]
        return [(row[:3], square, float(row[-1])) for row, square in zip(found, joint)]

    x = np.zeros(3)
    now, joint, far = measured([x])[0]
    budget = now[DOMAINS.index(ANCHOR)] / targets[ANCHOR]
    want = np.array([targets[d] * budget for d in DOMAINS])
    inside = np.flatnonzero(now >= LEAST_SHARE * now.sum())
    if DOMAINS.index(ANCHOR) not in inside or not budget:
        return [0.0, 0.0, 0.0]
    width = slack * budget

    def gradient(x: np.ndarray, now: np.ndarray) -> np.ndarray:
        return (now - want - width * x)[inside]

    def height(x: np.ndarray, now: np.ndarray, far: float) -> float:
        """What the multipliers maximise: the least-squares sum's dual."""
        return far / 2 + float(x @ (now - want)) - width / 2 * float(x @ x)

    high = height(x, now, far)
    for _ in range(STEPS):
        g = gradient(x, now)
        if abs(g).max() <= 1e-3 * width:
            break
        step = np.zeros(3)
        step[inside] = np.linalg.solve(joint[np.ix_(inside, inside)] + width * np.eye(len(inside)), g)
        tried = [x + step / 2**k for k in range(HALVINGS)]
        after = measured(tried)
        heights = [height(t, a[0], a[2]) for t, a in zip(tried, after)]
        best = int(np.argmax(heights))
        if heights[best] <= high:
            break
        x, (now, joint, far), high = tried[best], after[best], heights[best]
    return [float(v) for v in x]


def missed_shares(rated: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """domain, target, share, missed: the shares of the words that the rates of `document_rates` give, against the targets."""
    words_of = [F.coalesce(F.sum(F.col("rate") * F.col("n_tokens") * F.col(f"p_{d}")), F.lit(0.0)) for d in DOMAINS]
    total = F.array_compact(F.array(*[F.col(d) for d in DOMAINS]))
    all_words = F.aggregate(total, F.lit(0.0), lambda s, v: s + v)
    one = rated.agg(*[w.alias(d) for w, d in zip(words_of, DOMAINS)])
    rows = F.explode(F.array(*[F.struct(F.lit(d).alias("domain"), F.lit(targets[d]).alias("target"), F.try_divide(F.col(d), all_words).alias("share")) for d in DOMAINS]))
    return one.select(rows.alias("r")).select("r.*", (F.col("r.target") - F.col("r.share")).alias("missed"))


def _copies(rate: Column, doc_id: Column) -> Column:
    return F.floor(rate + uniform(SEED, doc_id)).cast("int")


def document_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, max_rate: float = MAX_RATE) -> DataFrame:
    """doc_id, n_tokens, p_clean, p_toxic, p_low, rate, copies: one row per row of `docs`."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    members = materialized(narrow.select("doc_id", membership(F.col("text"), *log_odds(narrow, labels)).alias("m")), "members")
    rated = members.withColumn("rate", rate_of(F.col("m"), fitted_multipliers(members, targets, max_rate), max_rate))
    p = [F.col("m.p")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)]
    return rated.select("doc_id", F.col("m.n").alias("n_tokens"), *p, "rate", _copies(F.col("rate"), F.col("doc_id")).alias("copies"))


def mixed_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, max_rate: float = MAX_RATE) -> DataFrame:
    """`docs`, each row as often as its copies say; rows are written with their membership, which is computed once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    members = materialized(docs.select(whole.alias("doc"), F.col("doc_id").cast("long").alias("id"), membership(text, *log_odds(narrow, labels)).alias("m")), "members")
    multipliers = fitted_multipliers(members.select("m"), targets, max_rate)
    copies = _copies(rate_of(F.col("m"), multipliers, max_rate), F.col("id"))
    return members.select("doc", F.explode(F.array_repeat(F.lit(0), copies))).select("doc.*")
