"""A Merkle manifest of a table of documents, checked by a recursive climb over stored nodes.

Every row is a leaf: the SHA-256 of its fields. The leaves of a source, in order of doc_id,
are hashed in runs of FAN until one digest, the subroot, is left; the subroots, in order of
source, likewise until the root is left. All levels are stored as parent-linked rows: a
family has the digests of its children, and names its parent's family and its place there.

`climb` is one recursive query over the families. Each step takes a leaf to its parent:
its digest is put back among its siblings and folded with them, and the siblings are
appended to the proof. Leaves of one run share every sibling above their own level, so one
row climbs for a run, with one list of siblings and the distinct digests that its leaves
have reached: all untampered leaves of a run reach the same, each tampered one its own.

Leaves are numbered in slices of a range partition and offset by the counts of the slices
before, so no task sees more of a source than a slice; a run is at most FAN rows. The
driver loops over levels (the logarithm of the rows) and reads counts and the root only.

Defined results: null doc_id or source come first; null fields are hashed as `-`. Equal
doc_ids of a source stand in the order of their leaves, equal leaves in any order. A row
without doc_id is never tampered with. A table of one row has that leaf as subroot and root
and the digest of nothing as its proof. No rows give no rows. Other columns don't count.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialized

FAN = 16
#: Every document whose checksum of doc_id is a multiple of this is tampered with.
TAMPERED = 5
TOP = -1


@dataclass(frozen=True)
class Manifest:
    """runs: one row per run of leaves; families: parent-linked nodes above; subroots: one row per source."""

    runs: DataFrame
    families: DataFrame
    subroots: DataFrame
    root: str | None


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def leaf(*fields: Column) -> Column:
    """The digest of a row's fields, each as `-` or as byte count, colon, value."""

    def framed(field: Column) -> Column:
        return F.when(field.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(field).cast("string"), F.lit(":"), field))

    return digest(F.concat(*[framed(f.cast("string")) for f in fields]))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, and `shown`: the leaf of the row as a reader presents it, tampered with or not."""
    doc_id, source, lang, n_chars, text = (F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
    changed = F.translate(text.cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    touched = F.crc32(doc_id.cast("string")) % TAMPERED == 0
    own = leaf(doc_id, source, lang, n_chars, text)
    shown = F.when(touched & (changed != text), leaf(doc_id, source, lang, n_chars, changed)).otherwise(own)
    return docs.select(doc_id.cast("long").alias("doc_id"), source.cast("string").alias("source"), own.alias("leaf"), shown.alias("shown"))


def numbered(df: DataFrame, key: str, *order: Column) -> tuple[DataFrame, DataFrame]:
    """The rows with their `place` (from 0) in the order of their key, and per key the count `n`.

    Rows are range-partitioned by key and order, so a hot key is cut into slices; what is
    gathered per key is one row per slice.
    """
    by = F.col(key).asc_nulls_first()
    sliced = materialized(df.repartitionByRange(by, *order).withColumn("slice", F.spark_partition_id()), "slices")
    counts = sliced.groupBy(key, "slice").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy(key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialized(counts.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0))), "offsets")
    inside = Window.partitionBy(key, "slice").orderBy(*order)
    ranked = sliced.withColumn("rank", F.row_number().over(inside))
    placed = ranked.alias("r").join(offsets.alias("o"), F.expr(f"r.slice = o.slice and r.{key} <=> o.{key}"))
    place = (F.col("o.before") + F.col("r.rank") - 1).alias("place")
    return placed.select(*[F.col(f"r.{c}") for c in df.columns], place), offsets.groupBy(key).agg(F.sum("rows").alias("n"))


def _name(tree: Column, level: int, idx: Column) -> Column:
    return F.concat_ws("/", tree, F.lit(level), idx)


def _linked(nodes: DataFrame, level: int, trees: int) -> DataFrame:
    """Nodes (tree, idx, n: nodes of the tree at this level) with `parent` and `place`; the root has none."""
    tree, idx, inner = F.col("tree"), F.col("idx"), F.col("n") > 1
    outer = (tree != TOP) & F.lit(trees > 1)
    parent = F.when(inner, _name(tree, level + 1, F.expr(f"idx div {FAN}"))).when(outer, _name(F.lit(TOP), 1, F.expr(f"tree div {FAN}")))
    place = F.when(inner, idx % FAN).when(outer, tree % FAN).cast("int")
    return nodes.withColumns({"parent": parent, "place": place})


def _parents(nodes: DataFrame, level: int, trees: int) -> DataFrame:
    """One row per run of FAN nodes at `level`: its digest, its children's digests, its own link."""
    runs = nodes.where("n > 1").groupBy("tree", F.expr(f"idx div {FAN}").alias("up"), "n").agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("c"))
    children = F.col("c.digest")
    above = runs.select("tree", F.col("up").alias("idx"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), children.alias("children"), digest(F.concat_ws("", children)).alias("digest"))
    return _linked(above, level + 1, trees).withColumn("node", _name(F.col("tree"), level + 1, F.col("idx")))


def _climb_levels(nodes: DataFrame, level: int, trees: int) -> list[DataFrame]:
    """The families above `nodes`, level by level, each written before the next is built."""
    found = []
    while not nodes.where("n > 1").isEmpty():
        nodes = materialized(_parents(nodes, level, trees), f"nodes_{level + 1}")
        found.append(nodes)
        level += 1
    return found


def build(docs: DataFrame) -> Manifest:
    """All levels of the manifest of `docs`, written to the shared folder."""
    rows = materialized(leaves(docs), "leaves")
    placed, counts = numbered(rows, "source", F.col("doc_id").asc_nulls_first(), F.col("leaf"))
    sources, total = numbered(counts.withColumn("all", F.lit(0)), "all", F.col("source").asc_nulls_first())
    trees = total.first()
    trees = trees.n if trees else 0
    known = materialized(sources.select("source", "n", F.col("place").alias("tree")), "sources")
    run = placed.groupBy("source", F.expr(f"place div {FAN}").alias("idx")).agg(F.array_sort(F.collect_list(F.struct("place", "doc_id", "leaf", "shown"))).alias("members"))
    own = run.alias("r").join(known.alias("k"), F.expr("r.source <=> k.source")).select("k.tree", "r.idx", "k.n", "r.members")
    digests = F.col("members.leaf")
    one = F.when(F.col("n") == 1, digests[0]).otherwise(digest(F.concat_ws("", digests)))
    first = own.select("tree", "idx", F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), F.col("n").alias("leaves"), "members", one.alias("digest"))
    runs = materialized(_linked(first, 1, trees), "runs")
    inner = _climb_levels(runs.select("tree", "idx", "n", "digest"), 1, trees)
    tops = [level.where("n = 1").select("tree", "digest") for level in [runs, *inner]]
    subroots = tops[0]
    for top in tops[1:]:
        subroots = subroots.unionByName(top)
    subroots = materialized(subroots, "subroots")
    outer = _climb_levels(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(trees).cast("long").alias("n"), "digest"), 0, trees)
    root = (outer[-1] if outer else subroots).select("digest").first()
    link = ["node", "children", "parent", "place"]
    families = docs.sparkSession.createDataFrame([], "node string, children array<string>, parent string, place int")
    for level in [*inner, *outer]:
        families = families.unionByName(level.select(*link))
    return Manifest(runs, materialized(families, "families"), subroots, root.digest if root else None)


_CLIMB = f"""
WITH RECURSIVE climb (tree, idx, reached, proof, parent, place) AS (
  SELECT tree, idx, reached, X'', parent, place FROM {{runs}}
  UNION ALL
  SELECT c.tree, c.idx,
         transform(c.reached, x -> unhex(sha2(concat(array_join(slice(f.children, 1, c.place), ''), lower(hex(x)), array_join(slice(f.children, c.place + 2, {FAN}), '')), 256))),
         concat(c.proof, unhex(array_join(slice(f.children, 1, c.place), '')), unhex(array_join(slice(f.children, c.place + 2, {FAN}), ''))),
         f.parent, f.place
  FROM climb c JOIN {{families}} f ON c.parent = f.node)
SELECT tree, idx, reached, proof FROM climb WHERE parent IS NULL
"""


def _start() -> Column:
    """What each member of a run reaches first: the run's digest with its shown leaf among the others, or the lone leaf."""
    members = F.col("members")

    def among(m: Column) -> Column:
        return digest(F.array_join(F.transform(members, lambda o: F.when(o.place == m.place, m.shown).otherwise(o.leaf)), ""))

    reached = F.when(F.col("leaves") == 1, F.transform(members, lambda m: m.shown)).otherwise(
        F.transform(members, lambda m: F.when(m.shown == m.leaf, F.col("digest")).otherwise(among(m)))
    )
    return F.transform(reached, lambda d: F.unhex(d))


def climb(manifest: Manifest) -> DataFrame:
    """tree, idx, reached, proof: per run what each of its distinct starts reaches at the root, and the siblings' digests (binary)."""
    spark: SparkSession = manifest.runs.sparkSession
    start = manifest.runs.select("tree", "idx", F.array_distinct(_start()).alias("reached"), "parent", "place")
    # A guard against endless recursion; the climb ends at the root.
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        return materialized(spark.sql(_CLIMB, runs=start, families=manifest.families), "climb")
    finally:
        spark.conf.set(limit, before)


def manifest_proofs(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row per row of `docs`."""
    manifest = build(docs)
    runs = manifest.runs.select("tree", "idx", "members", _start().alias("start")).join(climb(manifest), ["tree", "idx"])
    whole = runs.join(manifest.subroots.select("tree", F.col("digest").alias("subroot")), "tree")
    member = whole.select("start", "reached", "proof", "subroot", F.col("members.leaf").alias("leaves"), F.posexplode("members").alias("at", "m"))
    others = F.concat(F.array_join(F.slice("leaves", F.lit(1), F.col("at")), ""), F.array_join(F.slice("leaves", F.col("at") + 2, F.lit(FAN)), ""))
    own = F.array_position(F.array_distinct("start"), F.get("start", F.col("at")))
    root, folded = F.lit(manifest.root), F.lower(F.hex(F.get("reached", (own - 1).cast("int"))))
    return member.select(
        F.col("m.doc_id").alias("doc_id"),
        F.col("m.leaf").alias("leaf"),
        "subroot",
        root.alias("root"),
        digest(F.concat(others, F.lower(F.hex("proof")))).alias("proof_sha256"),
        folded.alias("folded_root"),
        (folded == root).alias("verified"),
    )
