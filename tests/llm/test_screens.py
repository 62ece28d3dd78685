"""Only rows that may be among the keys of a join are shuffled: texts that stay are not."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from marketpulse.llm import near_duplicates, screens


def test_documents_that_stay_are_not_shuffled(spark, capsys):
    texts = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t) for i, t in enumerate(texts[:5])] + [(3, texts[3]), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = near_duplicates.drop_near_duplicates(docs)
        capsys.readouterr()
        out.explain()
        plan = capsys.readouterr().out
        kept = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert kept == sorted([(False, i, t) for i, t in enumerate(texts)] + [(True, 0, "")] * 2)
    union = re.search(r"^(.*)\bUnion\n", plan, re.M)
    branches = re.split(rf"^.{{{len(union[1])}}}[:+]- ", plan[union.end() :], flags=re.M)[1:]
    # a branch that has no join by shuffled keys, and so doesn't move the documents that it lets through
    assert any("Scan" in b and "SortMergeJoin" not in b and "ShuffledHashJoin" not in b for b in branches)


def test_screens_let_every_key_through(spark):
    keys = spark.range(0, 50_000, 7).select(F.col("id").alias("k"), F.concat(F.lit("t"), "id").alias("name"))
    rows = spark.range(-1000, 50_000).select("id", F.concat(F.lit("t"), "id").alias("name")).unionByName(spark.createDataFrame([(None, "t7"), (7, None)], "id long, name string"))
    found = screens.screened(rows, ["id", "name"], keys, ["k", "name"])
    assert found.columns == rows.columns
    ids = {(r.id, r.name) for r in found.collect()}
    assert {(i, f"t{i}") for i in range(0, 50_000, 7)} <= ids
    assert len(ids) < 7300  # 7143 keys in 2^26 bits
    assert screens.screened(rows, ["id"], keys.limit(0), ["k"]).count() == 0
    assert screens.flagged(rows, ["id"], keys.limit(0), ["k"]).where("not may").count() == rows.count()
