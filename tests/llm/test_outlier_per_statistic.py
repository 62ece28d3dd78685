"""A planted document per statistic is rejected by its distance."""

from __future__ import annotations

import random

from marketpulse.llm import outliers


def test_each_statistic_rejects(spark):
    rng = random.Random(6)

    def word():
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9)))

    def line():
        return " ".join(word() for _ in range(5))

    rows = [(i, "\n".join(line() for _ in range(40))) for i in range(300)]
    passage = " ".join(word() for _ in range(28))
    planted = {
        "length": " ".join(word() * 5 for _ in range(200)),
        "symbols": "\n".join(line() + " ### $$$" for _ in range(40)),
        "lines": "\n".join("menu" if i % 2 else line() for i in range(200)),
        "repeats": " ".join([passage, *(word() for _ in range(144)), passage]),
    }
    rows += [(1000 + i, t) for i, t in enumerate(planted.values())]
    docs = spark.createDataFrame([(i, t, "en", "web") for i, t in rows], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in outliers.judged(docs).collect()}
    for i, name in enumerate(planted):
        assert not got[1000 + i].base_failed and not got[1000 + i].kept, name
    assert sum(got[i].kept for i in range(300)) >= 294
