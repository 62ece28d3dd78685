"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Tokens are runs of word bytes or of punctuation, case kept; a token equal to the one before
it is a repeat mark. Single tokens and pairs are hashed into BUCKETS cells. The raw model
counts every document, the target model the documents labelled good; a document's log weight
is the sum over its n-grams of log(target / raw), both smoothed. Gumbel noise, fixed by
doc_id and SEED, is added, and the k largest keys are the sample: a draw without replacement
in proportion to the weights. k is the number of documents whose weight reaches what the
share RECALL of the target documents reaches, less SLACK.

The target model is fitted on at most TARGETS labelled documents (the first by a hash of
doc_id); everything else covers all rows.

Defined results: null, empty or blank text has no n-grams, a null weight and is rejected.
Equal keys at the k-th place are all kept. Without a usable label both models are equal and
every document with text is kept. Repeated labels count once, contradictory ones not at all.
No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialized
from .selection import kth_largest, uniform
from .tokens import WORDS_AND_MARKS, grams, slices, tokens

BUCKETS = 1 << 16
TARGETS = 20_000
SMOOTHING = 0.5
RECALL = 0.999
#: Gumbel noise moves a key by a few units; the weight that counts towards k lies this much lower.
SLACK = 8.0
SEED = 11

_REPEAT = np.uint64(0x5EED)
_COUNTS = "bucket int, raw long, target long"


def hashed_grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text number) of every token and pair of tokens."""
    t = tokens(data, offsets, WORDS_AND_MARKS)
    again = np.flatnonzero((t.hash[1:] == t.hash[:-1]) & (t.text[1:] == t.text[:-1])) + 1
    t.hash[again] = _REPEAT
    pair, at = grams(t, 2)
    cell = np.concatenate((t.hash, pair)) >> np.uint64(64 - BUCKETS.bit_length() + 1)
    return cell.astype(np.int64), np.concatenate((t.text, t.text[at]))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        chosen = batch.column("chosen").to_numpy(zero_copy_only=False).astype(bool)
        for low, data, offsets in slices(batch.column("text")):
            cell, text = hashed_grams(data, offsets)
            raw += np.bincount(cell, minlength=BUCKETS)
            target += np.bincount(cell[chosen[low + text]], minlength=BUCKETS)
    filled = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(filled.astype(np.int32)), pa.array(raw[filled]), pa.array(target[filled])], ["bucket", "raw", "target"])


def good_ids(labels: DataFrame) -> DataFrame:
    """At most TARGETS doc_id whose labels all say good and not toxic."""
    agreed = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    good = agreed.where("q = 1 and t = 0 and doc_id is not null").select("doc_id")
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGETS)


def _chosen(docs: DataFrame, labels: DataFrame) -> DataFrame:
    ids = F.broadcast(good_ids(labels).select("doc_id", F.lit(True).alias("chosen")))  # at most TARGETS numbers
    return docs.join(ids, "doc_id", "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))


def log_ratios(chosen: DataFrame) -> np.ndarray:
    """log(target / raw) of each bucket, from (text, chosen)."""
    counts = chosen.select("text", "chosen").mapInArrow(_count, _COUNTS).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.full(BUCKETS, SMOOTHING), np.full(BUCKETS, SMOOTHING)
    for bucket, r, t in counts.collect():  # at most BUCKETS rows
        raw[bucket] += r
        target[bucket] += t
    if target.sum() == SMOOTHING * BUCKETS:
        return np.zeros(BUCKETS)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weigher(ratios: np.ndarray) -> Callable[[Column], Column]:
    """A column function from text to (n_grams, log_weight)."""

    @F.arrow_udf("struct<n_grams: long, log_weight: double>")
    def weigh(texts: pa.Array) -> pa.Array:
        total, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for low, data, offsets in slices(texts):
            cell, text = hashed_grams(data, offsets)
            size = len(offsets) - 1
            total[low : low + size] = np.bincount(text, ratios[cell], size)
            n[low : low + size] = np.bincount(text, minlength=size)
        return pa.StructArray.from_arrays([pa.array(n), pa.array(total, mask=n == 0)], ["n_grams", "log_weight"])

    return weigh


def _key(weight: str) -> Column:
    return F.col(weight) - F.log(-F.log(uniform(SEED, "doc_id")))


def resampler(docs: DataFrame, labels: DataFrame) -> tuple[Callable[[Column], Column], DataFrame, int, float | None]:
    """The fitted weigher, (doc_id, n_grams, log_weight, gumbel_key) of all rows, k, and the k-th largest key."""
    narrow = _chosen(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), labels)
    weigh = weigher(log_ratios(narrow))
    weighed = narrow.select("doc_id", "chosen", weigh("text").alias("w")).select("doc_id", "chosen", "w.*")
    weighed = materialized(weighed.withColumn("gumbel_key", _key("log_weight")), "weights")
    lowest = weighed.where("chosen").agg(F.percentile_approx("log_weight", 1 - RECALL, 10_000)).first()[0]
    floor = F.lit(True) if lowest is None else F.col("log_weight") >= lowest - SLACK
    k = weighed.where(floor & F.col("log_weight").isNotNull()).count()
    return weigh, weighed, k, kth_largest(weighed, "gumbel_key", k)


def importance_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_grams, log_weight, gumbel_key, k, kept: one row per row of `docs`."""
    _, weighed, k, lowest = resampler(docs, labels)
    kept = F.lit(False) if lowest is None else F.coalesce(F.col("gumbel_key") >= lowest, F.lit(False))
    return weighed.select("doc_id", "n_grams", "log_weight", "gumbel_key", F.lit(k).cast("long").alias("k"), kept.alias("kept"))


def keep_sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents in the sample, with all their columns; weights are computed again, so nothing is joined."""
    weigh, _, _, lowest = resampler(docs, labels)
    if lowest is None:
        return docs.limit(0)
    name = "__weight" + "_" * max(map(len, docs.columns))  # no column has this name
    weighed = docs.withColumn(name, weigh(F.col("text").cast("string"))["log_weight"])
    noise = -F.log(-F.log(uniform(SEED, F.col("doc_id").cast("long"))))
    return weighed.where(F.col(name) + noise >= lowest).select(*[F.col(f"`{c}`") for c in docs.columns])
