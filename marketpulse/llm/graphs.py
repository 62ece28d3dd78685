"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) of every node in `edges` (a, b): label is the smallest node reachable.

    Each round takes the smallest label among a node's neighbours, then the label of that
    label, so paths halve; every round is written, which cuts the lineage, and replaces the one
    before. Nodes without an edge don't appear; no edges give an empty table.
    """
    ends = edges.select(F.explode(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ("ab", "ba", "aa", "bb")])).alias("e"))
    both = scratch.write(ends.select("e.*"), "edges")
    labels = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("low"), F.min(F.when(F.col("a") == F.col("b"), F.col("label"))).alias("old"))
        hop = labels.select(F.col("node").alias("low"), F.col("label").alias("root"))
        after = near.join(hop, "low").select(F.col("a").alias("node"), F.least("low", "root").alias("label"), (F.col("old") != F.least("low", "root")).alias("moved"))
        after = scratch.write(after, "labels")
        scratch.keep_last("labels")
        labels = after.select("node", "label")
        if after.where("moved").isEmpty():
            scratch.remove("edges")
            return labels


def extended(known: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """`known` (node, label) with further links (a, b): only labels that links join are followed again.

    The links are written as edges between labels, so their components are those of whole parts.
    The result is the table `known` of `scratch`; the one before is removed.
    """
    parts = links
    for end in "ab":
        label = known.select(F.col("node").alias(end), F.col("label").alias(f"{end}_part"))
        parts = parts.join(label, end, "left")
    parts = parts.select(F.coalesce("a_part", "a").alias("a"), F.coalesce("b_part", "b").alias("b")).where("a != b").distinct()
    joined = components(parts, scratch).select(F.col("node").alias("label"), F.col("label").alias("root"))
    new = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(known, "node", "left_anti").select("node", F.col("node").alias("label"))
    named = known.unionByName(new).join(joined, "label", "left").select("node", F.coalesce("root", "label").alias("label"))
    named = scratch.write(named, "known")
    scratch.keep_last("known")
    scratch.remove("labels")
    return named
