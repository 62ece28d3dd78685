from __future__ import annotations

import random

from pyspark.sql import functions as F

from marketpulse.operators import extract
from marketpulse.sources import sites


def test_unclosed_tags_scripts_and_nesting():
    html = (
        '<script>var t="<article><h1>fake</h1></article></p>";</script><article><h1>A <b>bold<p>title</h1>'
        "<h1>second</h1></article><article><p>no heading<article><h1>inner &amp; more</h1></article></article>"
    )
    found = [item.get("headline") for item in extract.find_items(html, sites.ARTICLE_PAGE)]
    # The outer third element contains the inner one, so both see its heading.
    assert found == ["A boldtitle", "inner & more", "inner & more"]


def test_site_rules(spark):
    pages = {
        "GoogleFinance": '<div class="a z4rs2b"><a href="/x"></a><div class="Yfwt5">H\\nx </div>'
        '<div class="Adak">an hour ago</div><div class="sfyJob">S</div></div>',
        "YahooFinance": '<li class="stream-item story-item yf-1drgw5l"><a href="http://q"><h3>H</h3></a></li>'
        '<li class="stream-item story-item"><a href="/no"><h3>other class</h3></a></li>',
        "Finology": '<div id="newsarticles"><a id="btnDetails" class="newslink"><span>H</span><small> junk </small></a></div>'
        '<div><a id="btnDetails" class="newslink"><span>outside</span><small>junk</small></a></div>',
    }
    rows = [("T", site, f"http://{site}", html) for site, html in pages.items()] + [("T", "Finology", "u", None)]
    df = spark.createDataFrame(rows, "ticker string, site string, url string, html string")
    df = df.withColumn("as_of", F.to_timestamp(F.lit("2024-03-31 10:11:12")))
    items = extract.extract_articles(df, sites.TICKER_SITES)
    got = {r.site: r for r in items.where("item_pos >= 0").collect()}
    assert len(got) == 3
    assert [(r.site, r.problem) for r in items.where("item_pos < 0").collect()] == [("Finology", "no page")]
    assert got["GoogleFinance"].problem == "unreadable date" and got["GoogleFinance"].headline == "Hx"
    yahoo = got["YahooFinance"]
    assert (yahoo.source, yahoo.date_posted, yahoo.article_link, yahoo.problem) == ("Yahoo Finance", "", "http://q", None)
    fin = got["Finology"]
    assert (fin.source, fin.date_posted, fin.article_link, fin.headline) == ("Finology", "", "http://Finology", "H")


def test_whole_long_page_is_read(spark):
    long = "<p>" + "x" * 3_000_000 + "</p><article><h1>at the end</h1></article>"
    df = spark.createDataFrame([("u", long)], "url string, html string")
    assert extract.extract_site(df, sites.ARTICLE_PAGE).first().headline == "at the end"


def test_pages_without_items_are_rejects(spark):
    item = '<div class="z4rs2b"><a href="http://n/1"><div class="sfyJob">Paper</div><div class="Yfwt5">Up</div><div class="Adak">2 hours ago</div></a></div>'
    pages = [("GoogleFinance", item + "<![bad[x]]>"), ("GoogleFinance", "<p>nothing"), ("GoogleFinance", None), ("Elsewhere", item), ("GoogleFinance", "")]
    df = spark.createDataFrame([("T", s, "u", h) for s, h in pages], "ticker string, site string, url string, html string")
    out = extract.extract_articles(df.withColumn("as_of", F.to_timestamp(F.lit("2024-03-31 10:11:12"))), sites.TICKER_SITES)
    assert [(r.headline, r.article_link) for r in extract.usable(out).collect()] == [("Up", "http://n/1")]
    rejects = sorted((r.site, r.problem) for r in extract.rejected(out).collect())
    assert rejects == [("Elsewhere", "unknown site"), ("GoogleFinance", "no items"), ("GoogleFinance", "no items"), ("GoogleFinance", "no page"), ("GoogleFinance", "unreadable page")]


def test_references_cut_before_their_semicolon_are_text():
    html = "<article><h1>{0}</h1></article>"
    found = [extract.find_items(html.format(h), sites.ARTICLE_PAGE)[0]["headline"] for h in ("a &amp;&amp", "b &quot;&quot", "c &amp;lt; &lt", "d &am", "e & f &#39;")]
    assert found == ["a &&amp", 'b "&quot', "c &lt; &lt", "d &am", "e & f '"]
    listing = '<div class="z4rs2b"><div class="Yfwt5">a &amp;&amp</div></div>'
    assert extract.find_items(listing, sites.GOOGLE_FINANCE)[0]["headline"] == "a &&"


def test_plain_pages_are_read_by_form_as_the_parser_reads_them():
    rng = random.Random(5)
    parts = [
        '<div class="z4rs2b">', "</div>", '<div class="Yfwt5">', '<div class="Adak">', '<div class="sfyJob">', '<a href="/x">', '<a href="/y?a=1&amp;b=2">',
        '<a href="">', "<a\nhref='q'>", "</a>", "<p>", "</p>", "<br/>", "one", "two &amp; three", "&lt", "a < b", "<!-- c -->", '<!-- href="a--b" -->',
        '<script>var t="</div>";</script>', "<title>t &amp;</title>", "<title><b></title>", "<textarea></div></textarea>", '<article class="IFHyqb DeXSAc">',
        '<a class="JtKRv" href=".z">', '<div class="vr1PYe">', '<time datetime="d1">', '<time datetime="d2">', "</time>", "</article>", "<DIV>", "&", "\x01", "\0", "<h1>", "</h1>",
    ]
    for rule in (sites.GOOGLE_FINANCE, sites.GOOGLE_NEWS, sites.ARTICLE_PAGE):
        plain, by_parser = extract._Plain(rule), extract._Finder
        read = 0
        for _ in range(4000):
            page = "".join(rng.choices(parts, k=rng.randint(1, 12)))
            found = plain.items(page)
            if found is not None:
                finder = by_parser(rule)
                finder.feed(page)
                finder.close()
                assert found == finder.items, page
                read += 1
        assert read > 400


def test_pages_of_one_form_are_walked_once():
    page = '<div class="z4rs2b"><a href="/ev/{0}"><div class="sfyJob">S</div><div class="Yfwt5">H {0}</div><div class="Adak">{0} days ago</div></a></div>'
    plain = extract._Plain(sites.GOOGLE_FINANCE)
    found = [plain.items(page.format(i))[0] for i in range(500)]
    assert found == [{"link": f"/ev/{i}", "source": "S", "headline": f"H {i}", "date": f"{i} days ago"} for i in range(500)]
    assert len(plain.forms) == 1
