"""Shards of equal row counts by balanced label propagation.

Documents with equal texts are linked. Groups of more than 1 / LARGE of a shard (at most
LARGE * shards of them, whose counts come to the driver) choose first, the largest first:
as many shards as their size needs, each filled up before the next; the last part goes to
the shard with the least room that holds it. Their rows get exact quotas by row numbers,
counted inside hash slices. All other documents start in a shard given by a hash, in
proportion to the room that is left.

In each round a smaller group's parts look at the shard where most of the group is (ties by
a hash that differs per round; every second round, shards with room come first) and move there.
Parts move as wholes, up to a quota per pair of shards: what goes both ways is exchanged, the
rest is let in as far as there is room or room becomes free. Meanwhile a shard may hold 1 / SLACK
more than its share. Every move joins two parts, so rounds come to an end; they end when no
group has two parts or two rounds in a row move nothing.

At the end rows are numbered inside their shard, large groups first, then smaller groups one
after the other, then unlinked documents, which cut no edge. What exceeds the shard's share is
numbered on and fills the shards that lack rows, so unlinked documents go before groups, and
groups go as wholes but for those at the ends of shards. Numbers come from row numbers inside hash slices of a shard plus counts per slice, so no
task sorts a whole shard.

Law `rows`: counts differ by at most one. Defined results: null text counts as empty, a null
doc_id is a value like others, repeated rows are rows of one group, fewer rows than shards
leave shards empty, no rows give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialized
from .selection import uniform

SHARDS = 40
SLICES = 64
#: A group of more than 1 / LARGE of a shard's rows is placed by its size.
LARGE = 8
#: While groups gather, a shard may hold 1 / SLACK more than its share.
SLACK = 8
#: Hash slices in which a large group's rows are numbered.
GROUP_SLICES = 512

_GROUP = ["g1", "g2"]


def _at(values: list[float], index: str | Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.col(index) if isinstance(index, str) else index).cast("int") + 1)


def _counts(df: DataFrame, shards: int) -> list[int]:
    """Rows per shard; at most one row per shard comes to the driver."""
    found = dict(df.groupBy("shard").agg(F.count(F.lit(1))).collect())
    return [found.get(s, 0) for s in range(shards)]


def planned(sizes: list[int], room: list[int]) -> list[list[tuple[int, int]]]:
    """Of each group, the largest first, (shard, rows) parts; `room` shrinks by them."""
    out = []
    for left in sizes:
        parts = []
        while left:
            fits = [s for s, r in enumerate(room) if r >= left]
            to = min(fits, key=lambda s: room[s]) if fits else max(range(len(room)), key=lambda s: room[s])
            n = min(left, room[to])
            room[to] -= n
            left -= n
            parts.append((to, n))
        out.append(parts)
    return out


def quotas(demand: dict[tuple[int, int], int], room: Sequence[int]) -> dict[tuple[int, int], int]:
    """How many rows may go from shard i to shard j, so that no shard is filled beyond its room."""
    room = list(room)
    out = {(i, j): min(n, demand.get((j, i), 0)) for (i, j), n in demand.items()}
    left = {k: n - out[k] for k, n in demand.items()}
    moved = True
    while moved:
        moved = False
        for (i, j), n in sorted(left.items()):
            some = min(n, max(0, room[j]))
            if some:
                out[i, j] += some
                left[i, j] -= some
                room[j] -= some
                room[i] += some
                moved = True
    return out


def propagate(linked: DataFrame, share: list[int]) -> DataFrame:
    """(row, g1, g2, shard) once nothing moves; `share` is the number of these rows that a shard is to hold."""
    shards = len(share)
    state = materialized(linked.groupBy(*_GROUP, F.col("shard").alias("start")).agg(F.count(F.lit(1)).alias("n")).withColumn("shard", F.col("start")), "state")
    turn = idle = 0
    while idle < 2:
        have = dict(state.groupBy("shard").agg(F.sum("n")).collect())
        room = [s + s // SLACK - have.get(i, 0) for i, s in enumerate(share)]
        parts = state.groupBy(*_GROUP, "shard").agg(F.sum("n").alias("n"))
        first = _at(room, "shard") > 0 if turn % 2 else F.lit(True)
        ranked = parts.withColumn("rank", F.struct(first.alias("first"), "n", F.xxhash64(*_GROUP, "shard", F.lit(turn)).alias("tie"), "shard"))
        best = ranked.groupBy(*_GROUP).agg(F.max("rank").alias("best"))
        moves = ranked.join(best, _GROUP).where("best > rank").select(*_GROUP, "shard", F.col("best.shard").alias("to"), "n")
        moves = materialized(moves, "moves")
        wanted = {(i, j): n for i, j, n in moves.groupBy("shard", "to").agg(F.sum("n")).collect()}
        if not wanted:
            break
        allowed = quotas(wanted, room)
        flat = [float(allowed.get((i, j), 0)) for i in range(shards) for j in range(shards)]
        # small parts first, so that a part that doesn't fit blocks none that does
        so_far = F.sum("n").over(Window.partitionBy("shard", "to").orderBy("n", F.xxhash64(*_GROUP), *_GROUP).rowsBetween(Window.unboundedPreceding, 0))
        let_in = materialized(moves.withColumn("sum", so_far).where(F.col("sum") <= _at(flat, F.col("shard") * shards + F.col("to"))).select(*_GROUP, "shard", "to"), "let_in")
        turn += 1
        idle = idle + 1 if let_in.isEmpty() else 0
        if idle:
            continue
        moved = state.join(let_in, [*_GROUP, "shard"], "left")
        state = materialized(moved.select(*_GROUP, "start", "n", F.coalesce("to", "shard").alias("shard")), "state")
    final = state.select(*_GROUP, "start", F.col("shard").alias("to"))
    return linked.withColumnRenamed("shard", "start").join(final, [*_GROUP, "start"]).select("row", *_GROUP, F.col("to").alias("shard"))


def _large_rows(rows: DataFrame, plans: list[list[tuple[int, int]]]) -> DataFrame:
    """(row, shard) of the rows of large groups (number `large`), dealt by their plans."""
    sliced = rows.select("row", "large", F.pmod(F.xxhash64("row", F.lit(5)), F.lit(GROUP_SLICES)).cast("int").alias("slice"))
    sliced = materialized(sliced, "large")
    before = Window.partitionBy("large").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sliced.groupBy("large", "slice").agg(F.count(F.lit(1)).alias("n"))  # at most LARGE * shards * GROUP_SLICES rows
    offsets = sizes.select("large", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("large", "slice").orderBy("row"))
    numbered = sliced.withColumn("inside", inside).join(offsets, ["large", "slice"]).withColumn("number", F.col("before") + F.col("inside") - 1)
    plan = [(k, [0, *accumulate(n for _, n in parts[:-1])], [s for s, _ in parts]) for k, parts in enumerate(plans)]
    plan = rows.sparkSession.createDataFrame(plan, "large int, firsts array<long>, shards array<int>")
    dealt = numbered.join(F.broadcast(plan), "large")
    return dealt.select("row", F.element_at("shards", F.size(F.filter("firsts", lambda x: x <= F.col("number")))).alias("shard"))


def _numbered(placed: DataFrame) -> DataFrame:
    """`placed` with `number`, from 0 inside each shard: large groups (level 0), smaller ones (1), unlinked rows (2)."""
    by_row, by_group = (F.pmod(h, F.lit(SLICES)).cast("int") for h in (F.xxhash64("row", F.lit(3)), F.xxhash64(*_GROUP, F.lit(3))))
    sliced = placed.withColumn("slice", F.when(F.col("level") == 1, by_group).otherwise(by_row) + SLICES * F.col("level"))
    sliced = materialized(sliced, "sliced")
    sizes = sliced.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n"))  # at most shards * 3 * SLICES rows
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("shard", "slice").orderBy(*_GROUP, "row")
    joined = sliced.withColumn("inside", F.row_number().over(inside)).join(F.broadcast(offsets), ["shard", "slice"])
    return joined.withColumn("number", F.col("before") + F.col("inside") - 1).drop("before", "inside", "slice")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, linked: one row per row of `docs`."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("g1"),
        F.xxhash64(F.lit(1), text).alias("g2"),
    )
    base = materialized(base, "sized")
    total = base.count()
    share = [total // shards + (s < total % shards) for s in range(shards)]
    groups = materialized(base.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "groups")
    is_large = F.col("n") * LARGE > total // shards
    large = sorted(groups.where(is_large).collect(), key=lambda r: (-r.n, r.g1, r.g2))  # at most LARGE * shards rows
    room = list(share)
    plans = planned([r.n for r in large], room)
    numbers = base.sparkSession.createDataFrame([(r.g1, r.g2, k) for k, r in enumerate(large)], "g1 long, g2 long, large int")
    marked = base.join(F.broadcast(numbers), _GROUP, "left")
    bounds = F.array(*[F.lit(float(x)) for x in accumulate(room[:-1])])
    start = F.size(F.filter(bounds, lambda x: x <= uniform(7, "row") * sum(room)))
    others = marked.where("large is null").withColumn("shard", start)
    small = materialized(others.join(groups.where(~is_large).select(*_GROUP), _GROUP).select("row", *_GROUP, "shard"), "linked")
    final = propagate(small, room).select("row", "shard", F.lit(1).alias("level"))
    if large:
        final = final.unionByName(_large_rows(marked.where("large is not null"), plans).select("row", "shard", F.lit(0).alias("level")))
    final = final.withColumnRenamed("shard", "moved_to")
    level = F.coalesce("level", F.lit(2))
    placed = base.withColumn("start", start).join(final, "row", "left").select(
        "row", "doc_id", "size", "text_crc32", *_GROUP, F.coalesce("moved_to", "start").alias("shard"), level.alias("level"), (level < 2).alias("linked")
    )
    placed = materialized(placed, "placed")
    numbered = _numbered(placed)
    have = _counts(placed, shards)
    over = [max(0, n - s) for n, s in zip(have, share)]
    lack = [max(0, s - n) for n, s in zip(have, share)]
    first_over, first_lack = [0, *accumulate(over)], [0, *accumulate(lack)]
    leaves = F.col("number") >= _at(share, "shard")
    spare = (F.col("number") - _at(share, "shard") + _at(first_over, "shard")).cast("long")
    to = F.lit(shards - 1)
    for s in reversed(range(shards)):
        to = F.when(F.col("spare") < first_lack[s + 1], F.lit(s)).otherwise(to)
    slot = (F.col("spare") - _at(first_lack, "to") + _at([min(n, s) for n, s in zip(have, share)], "to")).cast("long")
    moved = numbered.withColumn("spare", F.when(leaves, spare)).withColumn("to", F.when(F.col("spare").isNotNull(), to))
    return moved.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.coalesce("to", "shard").cast("int").alias("shard"),
        F.when(F.col("to").isNull(), F.col("number")).otherwise(slot).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "linked",
    )
