"""The bound by 16-bit marks never leaves out a pair that the full sets link."""

from __future__ import annotations

import random

from marketpulse.llm import near_duplicates as nd


def test_marks_keep_every_link(spark):
    rng = random.Random(3)
    sets, pairs = [], []
    for i in range(60):
        size = rng.choice([1, 2, 5, 40, 300])
        # few low values, so that marks collide inside and between sets
        one = {rng.randrange(1 << 40) << 16 | rng.randrange(50) for _ in range(size)}
        other = {x for x in one if rng.random() < rng.choice([0.7, 0.86, 1.0])} | {-rng.randrange(1, 1 << 60) for _ in range(rng.randrange(1 + size // 8))}
        other = other or {7}
        sets += [(bytes([0, i]), sorted(one)), (bytes([1, i]), sorted(other))]
        pairs.append((bytes([0, i]), bytes([1, i])))
    table = spark.createDataFrame(sets, "node binary, items array<long>")
    both = spark.createDataFrame(pairs, "a binary, b binary")
    near = {(bytes(r.a), bytes(r.b)) for r in nd._hopeful(both, nd._marked(table)).collect()}
    linked = {(bytes(r.a), bytes(r.b)) for r in nd._measured(both, table).where(nd._LINKED).collect()}
    by_hand = {(a, b) for a, b in pairs if 100 * len(set(dict(sets)[a]) & set(dict(sets)[b])) >= 75 * len(set(dict(sets)[a]) | set(dict(sets)[b]))}
    assert linked == by_hand and linked and linked <= near
