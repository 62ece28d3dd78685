"""Samples for fits hold different strings, however often one of them occurs."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketpulse.llm import personal_data, secrets, selection


def test_copies_take_no_places(spark):
    rows = [("a", f"value {i}", i) for i in range(30)] + [("b", "only", 1)]
    plain = spark.createDataFrame(rows, "label string, value string, other int")
    copies = plain.union(plain.where("other < 5").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(200)))).drop("n"))
    got = selection.distinct_sample(copies, "label", "value", 20)
    assert len({r.value for r in got if r.label == "a"}) == len([r for r in got if r.label == "a"]) == 20
    assert got == selection.distinct_sample(plain, "label", "value", 20)


def test_fits_do_not_follow_copies(spark):
    texts = [f"mail user{i}@example{i % 7}.com or 10.0.{i % 250}.{i % 99} in {i}.5 of 3.{i} at version-{i}" for i in range(300)]
    texts += [f'token = "{i * 7919 ** 9:x}{i * 104729 ** 7:x}" in src/module{i}/file_{i}_name.py' for i in range(1, 300)]
    plain = spark.createDataFrame([(t,) for t in texts], "text string")
    copies = plain.union(plain.limit(5).union(plain.where("text like 'token%'").limit(5)).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(1000)))).drop("n"))
    assert dict(personal_data.fit(copies).weights) == dict(personal_data.fit(plain).weights)
    one, other = (secrets.fit(secrets.labelled_findings(d)) for d in (plain, copies))
    assert len(one.trees) == len(other.trees) and all((a == b).all() for a, b in zip(one.trees, other.trees))
