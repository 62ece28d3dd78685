"""Groups larger than a shard, and tables without unlinked documents."""

from __future__ import annotations

import collections
import random

from marketpulse.llm import sharding


def test_shards_of_large_groups(spark):
    def touched(rows, shards):
        docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
        out = sharding.shard_documents(docs, shards).collect()
        sizes = collections.Counter(r.shard for r in out)
        assert max(sizes.values()) - min(sizes[s] for s in range(shards)) <= 1
        for shard in sizes:
            assert sorted(r.slot for r in out if r.shard == shard) == list(range(sizes[shard]))
        found = collections.defaultdict(set)
        for r in out:
            found[rows[r.doc_id]].add(r.shard)
        return found

    n, shards = 8000, 40
    rows = ["third"] * (n // 3) + ["fifth"] * (n // 5) + [f"text {i}" for i in range(n - n // 3 - n // 5)]
    random.Random(1).shuffle(rows)
    found = touched(rows, shards)
    assert len(found["third"]) == 14 and len(found["fifth"]) == 8
    # every document has a copy, so no unlinked one makes room
    found = touched([f"text {i % 2000}" for i in range(6000)] + ["large"] * 2000, shards)
    assert len(found["large"]) == 10
    assert sum(len(s) > 1 for s in found.values()) <= 2 * shards


def test_quotas_keep_within_room():
    rng = random.Random(2)
    demand = {(i, j): rng.randrange(50) for i in range(6) for j in range(6) if i != j}
    room = [rng.randrange(-20, 40) for _ in range(6)]
    got = sharding.quotas(demand, room)
    assert all(0 <= got[k] <= demand[k] for k in demand)
    for s in range(6):
        change = sum(n for (_, j), n in got.items() if j == s) - sum(n for (i, _), n in got.items() if i == s)
        assert change <= max(0, room[s])
