"""Zipped reports read as files: whole, broken, and with broken members."""

from __future__ import annotations

import io
import zipfile

from marketpulse.sources import bulk


def packed(members: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, data in members.items():
            archive.writestr(name, data)
    return out.getvalue()


def test_archives(spark, tmp_path):
    good = packed({"pr/etf010124.csv": b"\xef\xbb\xbfSYMBOL, CLOSE\r\nA,1.5\r\n\"B, C\", 2\r\nD\r\n", "readme.txt": b"x", "etf2.csv": b"SYMBOL\n\xff\n"})
    (tmp_path / "good.zip").write_bytes(good)
    (tmp_path / "cut.zip").write_bytes(good[:60])
    (tmp_path / "notes.txt").write_bytes(b"not an archive")
    rows = {(r.archive, r.member, r.line): (r.fields, r.problem) for r in bulk.read_archives(spark, str(tmp_path), "etf*.csv").collect()}
    assert rows == {
        ("good.zip", "pr/etf010124.csv", 1): ({"SYMBOL": "A", "CLOSE": "1.5"}, None),
        ("good.zip", "pr/etf010124.csv", 2): ({"SYMBOL": "B, C", "CLOSE": "2"}, None),
        ("good.zip", "pr/etf010124.csv", 3): (None, "wrong number of fields"),
        ("good.zip", "etf2.csv", 1): (None, "unreadable member"),
        ("cut.zip", None, None): (None, "unreadable archive"),
    }


def test_given_contents(spark):
    rows = spark.createDataFrame([("empty.zip", bytearray()), ("none.zip", None), ("bare.zip", bytearray(packed({})))], "archive string, content binary")
    assert {(r.archive, r.problem) for r in bulk.unpacked(rows).collect()} == {("empty.zip", "unreadable archive"), ("none.zip", "unreadable archive")}
