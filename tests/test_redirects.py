"""Redirect pages in the forms that real ones take."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marketpulse.functions import redirects

FORMS = [
    ('<a class="x" rel="nofollow" href="http://n/1">go</a>', "http://n/1"),
    ("<a href='http://n/2' rel='nofollow'>go</a>", "http://n/2"),
    ('<a rel="noopener nofollow" href="http://n/3?a=1&amp;b=2">go</a>', "http://n/3?a=1&b=2"),
    ('<a href="http://other/">x</a><a href="http://n/4" rel="nofollow">go</a>', "http://n/4"),
    ('<!-- <a rel="nofollow" href="http://old/"> --><a rel=nofollow href=http://n/5>go</a>', "http://n/5"),
    ("<script>window.location.replace('https://n/6%3Fq%3Da+b%20c');</script>", "https://n/6?q=a+b c"),
    ("<p>window.location.replace('http://text/')</p>", None),
    ('<script>let a = 1;</script><script>window.location.replace("http://n/7")</script>', "http://n/7"),
    ('<a rel="nofollow">no link</a><a rel="nofollow" href="http://second/">x</a>', None),
    ('<a rel="nofollow" href="">x</a><script>window.location.replace(\'http://n/8\')</script>', "http://n/8"),
    ("<script>window.location.replace(target); window.location.replace('http://n/9')</script>", "http://n/9"),
    ("<script>window.location.replace('ftp://n/')</script>", None),
    ("<a rel='nofollow' href='http://n/10'>x</a><![bad[x]]>", "http://n/10"),
    ("", None),
    (None, None),
]


@pytest.mark.parametrize("html, want", FORMS)
def test_forms(html, want):
    assert redirects.target_of(html) == want


def test_column(spark):
    df = spark.createDataFrame(FORMS, "html string, want string")
    assert df.where(~redirects.redirect_target(F.col("html")).eqNullSafe(F.col("want"))).count() == 0
