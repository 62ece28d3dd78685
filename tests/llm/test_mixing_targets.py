"""The three domain totals against the targets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from marketpulse.llm import mixing


def test_scarce_domains_reach_their_targets(spark):
    # toxic and low are below their shares, so rates up to 1 can't meet the targets
    rng = np.random.default_rng(4)
    sure = [(100, [0.999, 0.0007, 0.0003])] * 990 + [(100, [0.05, 0.9, 0.05])] * 6 + [(80, [0.1, 0.02, 0.88])] * 4
    soft = [(int(rng.integers(20, 300)), [float(x) for x in rng.dirichlet([8, 0.08, 0.04])]) for _ in range(1000)]
    for rows in (sure, soft):
        members = spark.createDataFrame([(r,) for r in rows], "m struct<n: long, p: array<double>>")
        multipliers = mixing.fitted_multipliers(members, mixing.TARGETS, mixing.MAX_RATE)
        rated = members.select("m", mixing.rate_of(F.col("m"), multipliers, mixing.MAX_RATE).alias("rate")).collect()
        totals = [sum(r.rate * r.m.n * r.m.p[k] for r in rated) for k in range(3)]
        budget = sum(r.m.n * r.m.p[0] for r in rated) / mixing.TARGETS["clean"]
        assert all(0 <= r.rate <= mixing.MAX_RATE for r in rated) and max(r.rate for r in rated) > 1
        for total, domain in zip(totals, mixing.DOMAINS):
            assert abs(total - mixing.TARGETS[domain] * budget) <= 2 * mixing.TOLERANCE * budget


def test_operator_meets_the_three_targets(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    bad = labels.where("quality = 0 or toxic = 1").select("doc_id").distinct()
    few = docs.join(bad.orderBy("doc_id").offset(2), "doc_id", "left_anti")  # two rows of the scarce domains stay
    rows = mixing.document_rates(few, labels).where("n_tokens > 0").collect()
    totals = [sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in rows) for d in mixing.DOMAINS]
    for total, domain in zip(totals, mixing.DOMAINS):
        assert abs(total / sum(totals) - mixing.TARGETS[domain]) <= 5 * mixing.TOLERANCE


def test_rates_are_the_least_squares_solution(spark):
    rng = np.random.default_rng(9)
    n, p = rng.integers(20, 300, 60).astype(float), rng.dirichlet([6, 0.4, 0.3], 60)
    members = spark.createDataFrame([((int(k), [float(x) for x in q]),) for k, q in zip(n, p)], "m struct<n: long, p: array<double>>")
    x = mixing.fitted_multipliers(members, mixing.TARGETS, 2.0, slack=0.01)
    got = [r.rate for r in members.select(mixing.rate_of(F.col("m"), x, 2.0).alias("rate")).collect()]
    weights = n[:, None] * p
    budget = weights[:, 0].sum() / mixing.TARGETS["clean"]
    want = np.array([mixing.TARGETS[d] * budget for d in mixing.DOMAINS])
    rate, slack = np.ones(60), 0.01 * budget
    root = np.sqrt(n)
    length = 1 / np.linalg.eigvalsh(np.eye(60) + (weights / root[:, None]) @ (weights / root[:, None]).T / slack).max()
    z, before, t = rate * root, rate * root, 1.0
    for _ in range(60_000):  # accelerated projected gradient, one rate at a time
        misses = (z / root) @ weights - want
        after = np.clip(z - length * (z - root + (weights @ misses) / slack / root), 0, 2 * root)
        if (z - after) @ (after - before) > 0:
            t = 1.0
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, before, t = after + (t - 1) / t2 * (after - before), after, t2
    assert np.abs(before / root - got).max() < 1e-3


def test_absent_domain_is_left_alone(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    few = docs.join(labels.where("quality = 0 or toxic = 1").select("doc_id").distinct(), "doc_id", "left_anti")
    rated = mixing.document_rates(few, labels)
    assert rated.agg(F.max("copies")).first()[0] <= mixing.MAX_RATE
    assert rated.agg(F.sum("copies")).first()[0] > 0.8 * few.count()
    missed = {r.domain: r for r in mixing.missed_shares(rated).collect()}
    assert set(missed) == set(mixing.DOMAINS) and abs(sum(r.share for r in missed.values()) - 1) < 1e-6
