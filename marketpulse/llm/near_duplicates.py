"""Near-duplicate documents by one-permutation MinHash, star-shaped candidates and exact checks.

A document's set holds the hashes of its distinct five-word shingles. One hash per shingle
is enough: its top bits name one of 128 bins and each bin keeps its smallest hash. Empty
bins copy from a donor bin, found by walking a fixed pseudo-random order of all bins that
differs per bin (optimal densification). Four bins make a band; documents that agree in a
band share a bucket. A pair at similarity 0.75 is in no common bucket with probability
(1 - 0.75^4)^32 = 5e-6.

Documents with equal sets are one node from the start, so copies never meet in a bucket.
Inside a bucket, nodes are compared with one centre, the first by a hash, and not with each
other. TURNS turns of stars with different centres, the first over EARLY bands only, connect most
groups; buckets that lie in one component, or whose two nodes have been compared, are left alone.

What stars can't decide is settled exactly by rare shingles. Nodes of the buckets that are left
order their shingles by how many of these nodes hold them. Two sets of n and m shingles need
o >= 75 (n + m) / 175 in common to be linked, so the first one they share is among the first
n - o + 1 and m - o + 1. Nodes that meet there, in different components, are compared; shingles
that only one component holds are skipped, and nodes of a shingle's largest component aren't
paired with each other; a node meets nobody at a shingle where even the best partner there is
out of reach. No link between different components is left out.

Every link is confirmed on the full sets, which are read again for nodes in shared buckets. Pairs
already connected, of sizes too far apart, or with too few 16-bit marks of their hashes in common,
can add no link and are left out before.

Defined results: null or empty text and text without words has an empty set, is linked with
nothing and is kept. Fewer than five words are one shingle. A null doc_id never is a
component's id unless the whole component has none. Rows that repeat a doc_id and text are
copies; `drop_near_duplicates` keeps one row of each component whatever its ids are. No rows
give no rows. Other columns are ignored by `near_duplicates`.

Written tables are removed once what was made from them is written. Components are extended
by the links of each turn: only the labels that they join are followed again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialized
from .graphs import components, extended
from .scratch import Scratch
from .screens import flagged, screened
from .tokens import grams, mixed, slices, tokens

WORDS = 5
BINS = 128
ROWS = 4
#: So many bands are compared by stars alone at first, to connect what is easily connected.
EARLY = 6
#: Turns of stars, each with other centres, before what is left is settled exactly.
TURNS = 3
#: Linked: PERCENT * union <= 100 * intersection.
PERCENT = 75

_SIGNED = "doc_id long, t1 long, t2 long, node binary, n long, bands array<long>"
_SETS = "node binary, items array<long>"


def _donors() -> np.ndarray:
    """Row i: all bins in an order of its own; the first is i itself."""
    orders = np.argsort(mixed(np.arange(BINS * BINS, dtype=np.uint64) + np.uint64(1)).reshape(BINS, BINS), axis=1)
    rows = [np.concatenate(([i], order[order != i])) for i, order in enumerate(orders)]
    return np.array(rows)


DONORS = _donors()


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    t = tokens(data, offsets, lower=True)
    value, at = grams(t, WORDS)
    cut = np.searchsorted(at, t.first)
    out = []
    for i in range(t.n):
        low, high = t.first[i], t.first[i + 1]
        if 0 < high - low < WORDS:
            whole = np.uint64(high - low)
            for h in t.hash[low:high]:
                whole = mixed(np.array([whole], np.uint64) ^ h)[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.unique(value[cut[i] : cut[i + 1]]))
    return out


def signature(items: np.ndarray) -> bytes:
    """128 bits that name a set."""
    with np.errstate(over="ignore"):
        low, high = mixed(items).sum(dtype=np.uint64), mixed(items ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return int(low).to_bytes(8, "big") + int(high).to_bytes(8, "big")


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """The densified sketch (one row of BINS hashes) of each non-empty set."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    items = np.concatenate(sets)
    bins = (items >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    cell = owner * BINS + bins
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    out = np.zeros(len(sets) * BINS, np.uint64)
    full = np.zeros(len(sets) * BINS, bool)
    out[cell[first]], full[cell[first]] = items[first], True
    left = np.flatnonzero(~full)
    for step in range(1, BINS):
        if not len(left):
            break
        donor = left - left % BINS + DONORS[left % BINS, step]
        ready = full[donor]
        out[left[ready]] = out[donor[ready]]
        left = left[~ready]
    return out.reshape(len(sets), BINS)


def band_hashes(sketch: np.ndarray) -> np.ndarray:
    """One hash per band; its last bit tells the first EARLY bands."""
    parts = sketch.reshape(len(sketch), BINS // ROWS, ROWS)
    value = np.broadcast_to(np.arange(BINS // ROWS, dtype=np.uint64), parts.shape[:2])
    for j in range(ROWS):
        value = mixed(value ^ parts[:, :, j]) + np.uint64(j)
    early = np.arange(BINS // ROWS, dtype=np.uint64) < EARLY
    return (value & ~np.uint64(1) | early).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, data, offsets in slices(batch.column("text")):
            sets = shingle_sets(data, offsets)
            filled = [i for i, s in enumerate(sets) if len(s)]
            bands = np.full((len(sets), BINS // ROWS), 0, np.int64)
            if filled:
                bands[filled] = band_hashes(sketches([sets[i] for i in filled]))
            sizes = np.array([len(s) for s in sets], np.int64)
            ends = np.concatenate(([0], np.cumsum(np.where(sizes > 0, BINS // ROWS, 0)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).slice(low, len(sets)).cast(pa.int64()) for c in ("doc_id", "t1", "t2")),
                    pa.array([signature(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array(sizes),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(bands[sizes > 0].ravel())),
                ],
                ["doc_id", "t1", "t2", "node", "n", "bands"],
            )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, data, offsets in slices(batch.column("text")):
            sets = [s for s in shingle_sets(data, offsets) if len(s)]
            if sets:
                ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                items = pa.array(np.concatenate(sets).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([signature(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), items)],
                    ["node", "items"],
                )


def _joined(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """The written `pairs` with the array `column` of both nodes, as x and y."""
    left, right = (screened(sets.select(F.col("node").alias(n), F.col(column).alias(z)), [n], pairs, [n]) for n, z in ("ax", "by"))
    return pairs.join(left, "a").join(right, "b")


def _marked(sets: DataFrame) -> DataFrame:
    """(node, marks) of the full sets: size and the distinct last 16 bits of the hashes, a quarter of their bytes."""
    short = F.array_distinct(F.transform("items", lambda x: x.bitwiseAND(F.lit(0xFFFF)) - F.lit(0x8000)).cast("array<smallint>"))
    return sets.select("node", F.struct(F.size("items").cast("long").alias("n"), short.alias("short")).alias("marks"))


def _hopeful(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs that can be linked: hashes in common have marks in common, so the others bound the intersection."""
    common = F.size(F.array_intersect("x.short", "y.short"))
    most = F.least(*[F.col(f"{z}.n") - F.size(f"{z}.short") + common for z in "xy"])
    bound = _joined(pairs, marks, "marks").select("a", "b", most.alias("inter"), (F.col("x.n") + F.col("y.n")).alias("both"))
    return bound.where(f"{100 + PERCENT} * inter >= {PERCENT} * both").select("a", "b")


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, inter, total) of the written distinct pairs (a, b): sizes of intersection and union of the full sets."""
    inter = F.size(F.array_intersect("x", "y")).cast("long")
    joined = _joined(pairs, sets, "items").select("a", "b", inter.alias("inter"), (F.size("x") + F.size("y")).alias("both"))
    return joined.select("a", "b", "inter", (F.col("both") - F.col("inter")).alias("total"))


_LINKED = f"100 * inter >= {PERCENT} * total"


def _rare_pairs(rows: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of nodes in different components (part) that can be linked, by the rarest shingles of each."""
    nodes = scratch.write(rows.select("node", "n", "part").distinct(), "rest")
    held = scratch.write(sets.join(nodes, "node").select("node", F.explode("items").alias("item")), "held")
    spread = held.groupBy("item").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    inside = Window.partitionBy("node")
    ranked = held.join(spread, "item").withColumn("shared", F.count(F.lit(1)).over(inside))
    # shingles that no other node holds come first
    ranked = ranked.withColumn("after", F.col("shared") - F.row_number().over(inside.orderBy("df", "item")) + 1)
    # the most that can be common if this is the first common shingle, against the least partner there is
    rare = ranked.join(nodes, "node").where(f"after * 100 >= n * {PERCENT}").select("item", "node", "n", "part", "after")
    rare = scratch.write(rare, "rare")
    scratch.remove("held")
    best = (F.min("n").alias("least_n"), F.max("after").alias("most"))
    parts = rare.groupBy("item", "part").agg(F.count(F.lit(1)).alias("members"), *best)
    main = parts.groupBy("item").agg(F.max(F.struct("members", "part")).alias("main"), F.count(F.lit(1)).alias("parts"), F.min("least_n").alias("least_n"), F.max("most").alias("most"))
    # written, so that a hot shingle's rows in the joins below can be split
    main = scratch.write(main.where("parts > 1").select("item", F.col("main.part").alias("main"), "least_n", "most"), "main")

    def need(m: str, left: str) -> str:
        return f"{PERCENT} * (n + {m}) <= {100 + PERCENT} * least(after, {left})"

    # a row whose best partner at this shingle is out of reach meets nobody: pages of one template don't meet at its words
    hopeful = scratch.write(rare.join(main, "item").where(need("least_n", "most")).select("item", "node", "n", "part", "after", (F.col("part") != F.col("main")).alias("minor")), "hopeful")
    scratch.remove("rare", "main")
    other = hopeful.select("item", F.col("node").alias("b"), F.col("n").alias("m"), F.col("part").alias("other"), F.col("after").alias("left"))
    met = hopeful.where("minor").join(other, "item").where(f"part != other and {need('m', 'left')}")
    return met.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()


def _labels(signed: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) of all nodes that are linked with another."""
    nodes = signed.where("n > 0").groupBy("node").agg(F.first("bands").alias("bands"), F.first("n").alias("n"), F.min(F.coalesce("doc_id", F.lit(0))).alias("some_id"))
    nodes = scratch.write(nodes, "nodes")
    keys = nodes.select(F.explode("bands").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("members"))
    shared = scratch.write(keys.where("members > 1").select("key"), "shared")
    # narrow rows are shuffled; the other columns join the buckets that are left
    entries = screened(nodes.select("node", F.explode("bands").alias("key")), ["key"], shared, ["key"]).join(shared, "key")
    met = scratch.write(entries, "met")
    buckets = scratch.write(met.join(nodes.select("node", "n", "some_id"), "node"), "buckets")
    scratch.remove("nodes", "shared", "met")
    # written, so that the planner knows its size
    wanted = scratch.write(buckets.select("some_id").distinct(), "wanted")
    some_id = F.coalesce("doc_id", F.lit(0))
    texts = screened(docs.select("doc_id", "text"), [some_id], wanted, ["some_id"]).join(wanted, some_id == F.col("some_id"), "left_semi")
    sets = scratch.write(texts.mapInArrow(_full_sets, _SETS), "sets")
    # a node comes twice only where a doc_id does; then one of its sets is taken
    if not sets.groupBy("node").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1").isEmpty():
        sets = scratch.write(sets.groupBy("node").agg(F.first("items").alias("items")), "sets")
        scratch.keep_last("sets")
    marks = scratch.write(_marked(sets), "marks")
    scratch.remove("wanted")

    def confirmed(pairs: DataFrame) -> DataFrame:
        near = scratch.write(_hopeful(scratch.write(pairs, "pairs"), marks), "near")
        scratch.remove("pairs")
        links = scratch.write(_measured(near, sets).where(_LINKED).select("a", "b"), "links")
        scratch.keep_last("links")
        scratch.remove("near")
        return links

    def undecided(rows: DataFrame, known: DataFrame, least: int) -> DataFrame:
        """The rows of buckets (key) with `least` or more nodes and more than one component (part) left."""
        rows = rows.join(known.withColumnRenamed("label", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
        keys = rows.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("members"))
        left = scratch.write(rows.join(keys.where(f"low != high and members >= {least}").select("key"), "key"), "undecided")
        scratch.keep_last("undecided")
        return left

    def starred(rows: DataFrame, turn: int) -> DataFrame:
        """Pairs (a, b) of each node and the centre that its bucket has in this turn, but for connected ones and for sizes too far apart."""
        rows = rows if "part" in rows.columns else rows.withColumn("part", F.col("node"))
        centres = rows.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node").alias("b"), F.col("n").alias("m"), F.col("part").alias("other"))).alias("c"))
        met = rows.withColumnRenamed("node", "a").join(centres.select("key", "c.b", "c.m", "c.other"), "key")
        return met.where(f"part != other and {PERCENT} * greatest(n, m) <= 100 * least(n, m)").select("a", "b").distinct()

    rows = buckets.select("key", "node", "n")
    links = confirmed(starred(rows.where(F.col("key").bitwiseAND(F.lit(1)) == 1), 0))
    known = scratch.write(components(links, scratch), "known")
    scratch.remove("labels")
    for turn in range(1, TURNS + 1):
        # all bands have had a star once the first turn here is over, so pairs are decided then
        rows = undecided(rows.drop("part"), known, 2 if turn == 1 else 3)
        scratch.remove("buckets")
        known = extended(known, confirmed(starred(rows, turn)), scratch)
    rows = undecided(rows.drop("part"), known, 3)
    known = extended(known, confirmed(_rare_pairs(rows, sets, scratch)), scratch)
    scratch.remove("undecided", "rest", "hopeful", "sets", "marks", "links")
    return known


def _text_key(text: Column) -> list[Column]:
    """128 bits that name a text; null is a text of its own."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, t1, t2, node, n) of every row, and (node, lowest, label) of the nodes that are linked or have copies."""
    scratch = Scratch(docs.sparkSession)
    text = F.col("text").cast("string")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *_text_key(text))
    signed = scratch.write(narrow.mapInArrow(_sign, _SIGNED), "signed")
    rows = scratch.write(signed.drop("bands"), "signed_rows")
    labels = _labels(signed, narrow, scratch)
    scratch.remove("signed")
    copies = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("lowest"), F.count(F.lit(1)).alias("copies"))
    grouped = copies.join(labels, "node", "left").where("copies > 1 or label is not null")
    grouped = scratch.write(grouped.select("node", "lowest", F.coalesce("label", "node").alias("label")), "grouped")
    scratch.remove("known")
    return rows, grouped


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept: one row per row of `docs`."""
    signed, grouped = _grouped(docs)
    component = grouped.groupBy("label").agg(F.min("lowest").alias("component"))
    named = grouped.join(component, "label").select("node", "component")
    joined = signed.join(named, "node", "left")
    smallest = F.coalesce("component", "doc_id")
    return joined.select(
        "doc_id", F.col("n").alias("n_shingles"), smallest.alias("component_id"), F.coalesce(F.col("doc_id") == smallest, smallest.isNull()).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates, and all other rows.

    A group keeps its smallest doc_id (null is the largest), and of that the text whose hash is
    smallest; of rows that repeat both, the one whose other columns hash lowest. What goes is
    named by doc_id and text, so other rows with that doc_id, or with none, stay. Rows without
    words are in no group and stay, however often they repeat.
    """
    signed, grouped = _grouped(docs)
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "t1", "t2")
    rows = materialized(signed.select("node", key.alias("key")).join(grouped.select("node", "label"), "node").select("label", "key"), "rows")
    counted = rows.groupBy("label", "key").agg(F.count(F.lit(1)).alias("rows"))
    first = counted.groupBy("label").agg(F.min("key").alias("first"))
    # one row per key that goes, or of which one row is to stay
    marked = materialized(counted.join(first, "label").where("key != first or rows > 1").select("key.*", (F.col("key") == F.col("first")).alias("one_stays")), "marked")
    # the columns of `docs` are fields of `doc`, so no name clashes
    doc_id, text = F.col("doc.doc_id").cast("long"), F.col("doc.text").cast("string")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    keyed = keyed.select("doc", doc_id.isNull().alias("none"), F.coalesce(doc_id, F.lit(0)).alias("id"), *_text_key(text))
    names = ["none", "id", "t1", "t2"]
    # most documents stay, and aren't shuffled
    keyed = flagged(keyed, names, marked, names)
    met = keyed.where("may").join(marked, names, "left")
    once = met.where("one_stays").groupBy(*names).agg(F.min_by("doc", F.xxhash64("doc")).alias("doc")).select("doc")
    return keyed.where("not may").select("doc").unionByName(met.where("one_stays is null").select("doc")).unionByName(once).select("doc.*")
