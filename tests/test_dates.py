from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marketpulse.functions import dates as D

RELATIVE = [
    ("5 minutes ago", "2024-03-31 10:06:12", "ok"),
    ("2 hours ago", "2024-03-31 08:11:12", "ok"),
    ("a day ago", "2024-03-30 10:11:12", "ok"),
    ("last week", "2024-03-24 10:11:12", "ok"),
    ("1 month ago", "2024-02-29 10:11:12", "ok"),
    ("1 year ago", "2023-03-31 10:11:12", "ok"),
    ("13 months ago", "2023-02-28 10:11:12", "ok"),
    ("1 yesterday", "2024-03-30 10:11:12", "ok"),
    ("0 today", "2024-03-31 10:11:12", "ok"),
    ("  2   weeks\tago ", "2024-03-17 10:11:12", "ok"),
    ("-5 days ago", "2024-04-05 10:11:12", "ok"),
    ("1_0 days ago", "2024-03-21 10:11:12", "ok"),
    ("3 mins ago", "", "empty"),
    ("yesterday", "", "empty"),
    ("", "", "empty"),
    ("   ", "", "empty"),
    ("about 2 hours ago", "", "empty"),
    ("an hour ago", None, "reject"),
    ("x mins ago", None, "reject"),
    ("9999999 days ago", None, "reject"),
    ("99999999999999999999 days ago", None, "reject"),
    ("2147483647 minutes ago", None, "reject"),
    ("99999999999999999999 mins ago", None, "reject"),
    (None, None, "reject"),
]


def test_relative(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(RELATIVE)], "i int, text string")
    df = df.withColumn("as_of", F.to_timestamp_ntz(F.lit("2024-03-31 10:11:12")))
    got = D.with_relative_date(df, "text", "as_of", "d").orderBy("i").collect()
    assert [(r.text, r.d, r.d_status) for r in got] == RELATIVE


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_relative_accepts_both_timestamp_types(spark, kind):
    df = spark.createDataFrame([("1 month ago",)], "text string")
    df = df.withColumn("as_of", F.lit("2024-03-31 10:11:12").cast(kind))
    assert D.with_relative_date(df, "text", "as_of", "d").first().d == "2024-02-29 10:11:12"


ABSOLUTE = [
    ("5 Apr, 9:07 PM", "2025-04-05 21:07:00", "ok"),
    ("05 apr, 09:07 pm", "2025-04-05 21:07:00", "ok"),
    ("5 Apr, 9:7 PM", "2025-04-05 21:07:00", "ok"),
    ("5 Dec, 9:07 PM", "2024-12-05 21:07:00", "ok"),
    ("1 Jun, 12:00 AM", "2024-06-01 00:00:00", "ok"),
    ("29 Feb, 9:07 PM", "", "empty"),
    ("31 Apr, 9:07 PM", "", "empty"),
    ("5 Apr, 13:07 PM", "", "empty"),
    ("005 Apr, 9:07 PM", "", "empty"),
    ("junk", "", "empty"),
]


def test_absolute_without_year(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(ABSOLUTE)], "i int, text string")
    df = df.withColumn("as_of", F.to_timestamp_ntz(F.lit("2025-06-01 00:00:00")))
    got = D.with_absolute_date(df, "text", "%d %b, %I:%M %p", "as_of", "d").orderBy("i").collect()
    assert [(r.text, r.d, r.d_status) for r in got] == ABSOLUTE


def test_absolute_with_year_rejects_and_without_format_is_empty(spark):
    df = spark.createDataFrame([("2024-02-29 01:02:03",), ("2023-02-29 01:02:03",), ("junk",)], "text string")
    df = df.withColumn("as_of", F.to_timestamp_ntz(F.lit("2025-06-01 00:00:00")))
    got = D.with_absolute_date(df, "text", "%Y-%m-%d %H:%M:%S", "as_of", "d").collect()
    assert [(r.d, r.d_status) for r in got] == [("2024-02-29 01:02:03", "ok"), (None, "reject"), (None, "reject")]
    bare = D.with_absolute_date(df, "text", None, "as_of", "d").first()
    assert (bare.d, bare.d_status) == ("", "empty")


def test_iso_keeps_the_written_time(spark):
    df = spark.createDataFrame(
        [("2025-04-20T06:34:35Z",), ("2025-04-20T06:34:35+05:30",), ("2025-04-20T06:34:35+0530",), ("2025-04-20",)],
        "text string",
    )
    got = D.with_iso_date(df, "text", "d").collect()
    assert [(r.d, r.d_utc) for r in got] == [
        ("2025-04-20 06:34:35", "2025-04-20 06:34:35"),
        ("2025-04-20 06:34:35", "2025-04-20 01:04:35"),
        ("2025-04-20 06:34:35", "2025-04-20 01:04:35"),
        (None, None),
    ]
