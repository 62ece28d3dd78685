"""Near copies go by row, not by id."""

from __future__ import annotations

import collections

from marketpulse.llm import near_duplicates


def test_dropping_near_duplicates_keeps_other_rows_of_an_id(spark):
    def text(name, changed=None):
        return " ".join(f"{name}{i}" if i != changed else "changed" for i in range(100))

    rows = [(1, text("a")), (None, text("a", 99)), (None, text("b")), (None, text("c")), (2, text("d")), (2, text("a", 0))]
    rows += [(None, text("e")), (None, text("e", 99)), (None, text("e", 0)), (3, text("f")), (3, text("f")), (4, text("f")), (None, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = collections.Counter((r.doc_id, r.text) for r in near_duplicates.drop_near_duplicates(docs).collect())
    assert max(kept.values()) == 1
    for row in [(1, text("a")), (None, text("b")), (None, text("c")), (2, text("d")), (3, text("f")), (None, None), (5, "")]:
        assert kept.pop(row) == 1
    assert len(kept) == 1 and next(iter(kept))[1].startswith(("e", "changed e"))


def test_clashing_columns_and_repeated_rows(spark):
    names = ["__id", "__none", "__t1", "__t2", "doc", "none", "id", "t1", "t2", "one.stays", "key", "label"]
    text = " ".join(f"word{i}" for i in range(20))
    rows = [(1, text), (1, text), (2, text.upper()), (3, "a few words only"), (4, ""), (4, ""), (None, None), (None, None)]
    docs = spark.createDataFrame([(*r, *map(str, range(len(names)))) for r in rows], ["doc_id", "text", *names])
    out = near_duplicates.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    got = collections.Counter((r.doc_id, r.text) for r in out.collect())
    assert got == {(1, text): 1, (3, "a few words only"): 1, (4, ""): 2, (None, None): 2}


def test_pages_of_one_template_below_the_limit(spark):
    # 24 of 41 words are the template's, so no two pages are linked but the last, which copies another with one word changed
    template = " ".join(f"t{i}" for i in range(24))
    rows = [(i, template + " " + " ".join(f"own{i}x{j}" for j in range(17))) for i in range(60)]
    rows.append((100, rows[7][1][: rows[7][1].rindex(" ")] + " changed"))
    out = {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {i: i for i in range(60)} | {100: 7}
