"""Queries over landed pages, JSON and files, and the text and date rules they use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import redirects
from ..functions import text as T
from ..operators import extract
from ..session import scratch_path
from ..sources import bulk, landed, sites
from ..sources.store import ArticleStore
from ..sources.views import Views
from . import jobs
from .registry import query
from .sql_views import with_views


# --- landed JSON and files --------------------------------------------------------------------------
@query("SELECT page_id, url, length(html) AS n_chars, contains(html, '<article') AS has_article FROM pages")
def page_scan(v: Views) -> DataFrame:
    return v.pages().select(
        "page_id",
        "url",
        F.length("html").cast("bigint").alias("n_chars"),
        F.contains("html", F.lit("<article")).alias("has_article"),
    )


def trade_info(v: Views) -> DataFrame:
    """Trade-info responses: some empty, some without the inner level."""
    full = F.concat(F.lit('{"marketDeptOrderBook":{"tradeInfo":{"ffmc":'), F.col("value"), F.lit("}}}"))
    shape = F.pmod("event_id", F.lit(4))
    body = F.when(shape == 0, "{}").when(shape == 1, '{"marketDeptOrderBook":{}}').otherwise(full)
    return v.events().select("event_id", "props", body.alias("body"))


@query(
    """SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k,
  CASE WHEN event_id % 4 > 1 THEN value END AS ffmc FROM events"""
)
def json_extract(v: Views) -> DataFrame:
    return trade_info(v).select(
        "event_id",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        landed.order_book_ffmc(F.col("body")).alias("ffmc"),
    )


@query(
    """SELECT event_id, event_type AS assets, 'T' || user_id AS symbol, value AS ffmc FROM events WHERE event_id % 5 > 0
UNION ALL SELECT event_id, NULL, 'E' || event_id, NULL FROM events WHERE event_id % 5 > 0"""
)
def json_explode(v: Views) -> DataFrame:
    body = F.format_string(
        '{"data":[{"assets":"%s","symbol":"T%d","ffmc":%s},{"symbol":"E%d"}]}',
        "event_type",
        "user_id",
        F.col("value").cast("string"),
        "event_id",
    )
    responses = v.events().select(
        "event_id", F.when(F.pmod("event_id", F.lit(5)) == 0, "{}").otherwise(body).alias("body")
    )
    return landed.listing_items(responses, "body")


@query(
    with_views(
        "meta",
        body="""SELECT ticker, sector, industry,
  round("mCap" * ((c_custkey + 1) * 1000003)::DOUBLE / 1e9, 2) AS "mCap", "companyName"
FROM meta JOIN customer ON c_name = "companyName" WHERE c_custkey % 9 NOT IN (3, 7)""",
    )
)
def metadata_mcap(v: Views) -> DataFrame:
    """Quote responses, two of nine without one of the fields."""
    key = F.substring("ticker", 2, 20).cast("bigint")
    shape = F.pmod(key, F.lit(9))
    quote = F.to_json(
        F.struct(
            F.struct(F.col("sector").alias("macro"), F.when(shape != 3, F.col("industry")).alias("industry")).alias(
                "industryInfo"
            ),
            F.when(shape != 7, F.struct(F.col("mCap").alias("previousClose"))).alias("priceInfo"),
            F.struct(((key + 1) * 1000003).alias("issuedSize")).alias("securityInfo"),
            F.struct("companyName").alias("info"),
        )
    )
    return landed.ticker_metadata(v.meta().select("ticker", quote.alias("quote")))


@query(
    with_views(
        "art",
        body="""SELECT ticker, headline, date_posted, round(compound_sentiment::DOUBLE, 6) AS compound_sentiment FROM art""",
    )
)
def csv_roundtrip(v: Views) -> DataFrame:
    """Articles exported as CSV with a header, and read back with their schema."""
    path = scratch_path(v.spark, "csv_roundtrip")
    rows = v.articles().select(
        "ticker",
        "headline",
        "date_posted",
        F.round(F.col("compound_sentiment").cast("double"), 6).alias("compound_sentiment"),
    )
    landed.write_csv(rows, path)
    return landed.read_csv(
        v.spark, path, "ticker string, headline string, date_posted string, compound_sentiment double"
    )


# --- text rules -------------------------------------------------------------------------------------
@query(
    with_views(
        "art",
        body="""SELECT article_link, headline AS clean, chr(9) || headline AS kept_inside
FROM (SELECT article_link, headline || chr(9) || headline AS kept_inside0, headline FROM art)
UNION ALL
SELECT 'doc/' || doc_id, replace(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', ''), '\\n', ''), NULL FROM documents""",
    )
)
def headline_clean(v: Views) -> DataFrame:
    """White space and a literal backslash-n around headlines; whole documents as they are."""
    dirty = F.concat(F.lit(" \t\n"), "headline", F.lit("\\n"), F.lit("\r\n "))
    news = v.articles().select(
        "article_link",
        T.clean_headline(dirty).alias("clean"),
        F.concat(F.lit("\t"), T.strip(F.concat(F.lit("\t"), "headline"))).alias("kept_inside"),
    )
    texts = v.documents().select(
        F.concat(F.lit("doc/"), "doc_id").alias("article_link"),
        T.clean_headline(F.col("text")).alias("clean"),
        F.lit(None).cast("string").alias("kept_inside"),
    )
    return news.unionByName(texts)


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Yahoo Finance' ELSE event_type END AS source,
  CASE event_id % 4 WHEN 2 THEN (event_id % 20) || ' hours ago' WHEN 3 THEN 'a day ago' ELSE '' END AS time_text FROM events"""
)
def footer_split(v: Views) -> DataFrame:
    shape, kind = F.pmod("event_id", F.lit(4)), F.col("event_type")
    hours = F.concat(F.pmod("event_id", F.lit(20)), F.lit(" hours ago"))
    footer = (
        F.when(shape == 1, F.concat(kind, F.lit("  ")))
        .when(shape == 2, F.concat(F.lit(" "), kind, F.lit(" • "), hours, F.lit("\n")))
        .when(shape == 3, F.concat(kind, F.lit("•a day ago •extra")))
    )
    source, time_text = T.footer_parts(footer)
    return v.events().select("event_id", source.alias("source"), time_text.alias("time_text"))


@query(
    with_views(
        "meta",
        body="""SELECT ticker, replace("companyName", '#', ' no ') AS name,
  replace(replace("companyName", '#', ' no '), ' ', '+') AS query_text,
  'https://finance.yahoo.com/' || ticker AS relative_link, 'http://x.example/' || ticker AS absolute_link,
  'https://news.google.com/read/' || ticker AS dotted_link FROM meta""",
    )
)
def link_normalise(v: Views) -> DataFrame:
    name = F.replace("companyName", F.lit("#"), F.lit(" no "))
    root = sites.YAHOO_FINANCE.link_root
    return v.meta().select(
        "ticker",
        name.alias("name"),
        T.search_query(name).alias("query_text"),
        T.absolute_link(F.concat(F.lit("/"), "ticker"), root).alias("relative_link"),
        T.absolute_link(F.concat(F.lit("http://x.example/"), "ticker"), root).alias("absolute_link"),
        T.dot_link(F.concat(F.lit("./read/"), "ticker"), sites.GOOGLE_NEWS.link_root).alias("dotted_link"),
    )


@query(
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN url
  WHEN 2 THEN regexp_extract(url, '^[^?#]*') || '?q=a b' END AS target FROM pages"""
)
def redirect_target(v: Views) -> DataFrame:
    """Whole pages with a nofollow link (attributes in either order), a script, or neither."""
    shape = F.pmod("page_id", F.lit(4))
    plain = F.regexp_extract("url", "^[^?#]*", 0)
    tail = (
        F.when(shape == 0, F.concat(F.lit('<a class="x" rel="nofollow" href="'), "url", F.lit('">go</a>')))
        .when(shape == 1, F.concat(F.lit("<a href='"), "url", F.lit("' rel='nofollow'>go</a>")))
        .when(
            shape == 2,
            F.concat(F.lit("<script>window.location.replace('"), plain, F.lit("%3Fq%3Da%20b');</script>")),
        )
        .otherwise("")
    )
    return v.pages().select("page_id", redirects.redirect_target(F.concat("html", tail)).alias("target"))


# --- zipped reports ---------------------------------------------------------------------------------
@query(
    with_views(
        "px",
        body="""SELECT 'pr' || strftime(date, '%Y%m') || '.zip' AS archive, 'etf' || strftime(date, '%Y%m%d') || '.csv' AS member,
  ticker AS symbol, close, NULL AS problem FROM px WHERE year(date) = 1998
UNION ALL SELECT DISTINCT 'pr' || strftime(date, '%Y%m') || '-cut.zip', NULL, NULL, NULL, 'unreadable archive'
FROM px WHERE year(date) = 1998""",
    )
)
def bulk_report(v: Views) -> DataFrame:
    """A year's prices as monthly archives of daily reports, each month once more cut off, read back."""
    priced = v.prices().where(F.year("date") == 1998)
    rows = priced.select(
        F.concat(F.lit("pr"), F.date_format("date", "yyyyMM"), F.lit(".zip")).alias("archive"),
        F.concat(F.lit("etf"), F.date_format("date", "yyyyMMdd"), F.lit(".csv")).alias("member"),
        F.struct(F.col("ticker").alias("SYMBOL"), F.col("close").cast("string").alias("CLOSE_PRICE")).alias("fields"),
    )
    folder = scratch_path(v.spark, "reports")
    bulk.write_archives(rows, folder, cut_copies=True)
    found = bulk.read_archives(v.spark, folder, "etf*.csv")
    return found.select(
        "archive",
        "member",
        F.col("fields").getItem("SYMBOL").alias("symbol"),
        F.col("fields").getItem("CLOSE_PRICE").cast("decimal(12,4)").alias("close"),
        "problem",
    )


# --- dates ------------------------------------------------------------------------------------------
# Every branch of the relative rules; #N stands for the event's own small number.
RELATIVE_TEXTS = (
    "#N minutes ago",
    "#N hours ago",
    "a day ago",
    "last week",
    "#N months ago",
    "1 year ago",
    "#N mins ago",
    "yesterday",
    "",
    "about #N hours ago",
    "an hour ago",
    "#N weeks",
)


def _relative_text(number: Column) -> Column:
    shapes = F.array(*(F.lit(t) for t in RELATIVE_TEXTS))
    return F.replace(F.element_at(shapes, F.pmod("event_id", F.lit(12)).cast("int") + 1), F.lit("#N"), number)


def relative_texts(v: Views) -> DataFrame:
    return v.events().select(
        "event_id", _relative_text((F.pmod("event_id", F.lit(50))).cast("string")).alias("text"), F.col("ts").alias("as_of")
    )


RELATIVE_VALUE_SQL = """CASE event_id % 12
    WHEN 0 THEN ts - (event_id % 50) * INTERVAL 1 MINUTE WHEN 1 THEN ts - (event_id % 50) * INTERVAL 1 HOUR
    WHEN 2 THEN ts - INTERVAL 1 DAY WHEN 3 THEN ts - INTERVAL 7 DAY WHEN 4 THEN ts - (event_id % 50) * INTERVAL 1 MONTH
    WHEN 5 THEN ts - INTERVAL 1 YEAR WHEN 11 THEN ts - (event_id % 50) * INTERVAL 7 DAY END"""


@query(
    f"""SELECT event_id, CASE WHEN moment IS NOT NULL THEN strftime(moment, '%Y-%m-%d %H:%M:%S')
                        WHEN event_id % 12 IN (6, 7, 8, 9) THEN '' END AS date_posted,
  CASE WHEN moment IS NOT NULL THEN 'ok' WHEN event_id % 12 = 10 THEN 'reject' ELSE 'empty' END AS date_posted_status
FROM (SELECT event_id, {RELATIVE_VALUE_SQL} AS moment FROM events)"""
)
def parse_relative_date(v: Views) -> DataFrame:
    parsed = D.with_relative_date(relative_texts(v), "text", "as_of", "date_posted")
    return parsed.select("event_id", "date_posted", "date_posted_status")


ABSOLUTE_FORMAT = "%d %b, %I:%M %p"


@query(
    """SELECT event_id, CASE WHEN shape IN (0, 1) THEN ''
  ELSE strftime(CASE WHEN this_year < as_of THEN this_year ELSE this_year - INTERVAL 1 YEAR END, '%Y-%m-%d %H:%M:%S')
  END AS date_posted, CASE WHEN shape IN (0, 1) THEN 'empty' ELSE 'ok' END AS date_posted_status
FROM (SELECT event_id, event_id % 12 AS shape, ts + INTERVAL 500 DAY AS as_of,
             strptime('2025 ' || strftime(ts + (event_id % 360)::INT * INTERVAL 1 DAY + CASE WHEN
               strftime(ts + (event_id % 360)::INT * INTERVAL 1 DAY, '%m-%d') = '02-29' THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END,
               '%m-%d %H:%M'), '%Y %m-%d %H:%M') AS this_year
      FROM events)"""
)
def parse_absolute_date(v: Views) -> DataFrame:
    """Dates without a year, seen from a day in the middle of the reference year."""
    shape = F.pmod("event_id", F.lit(12))
    days = F.make_interval(days=F.pmod("event_id", F.lit(360)).cast("int"))
    moment = F.col("ts") + days
    moment = F.when(F.date_format(moment, "MM-dd") == "02-29", moment + F.make_interval(days=F.lit(1))).otherwise(moment)
    text = (
        F.when(shape == 0, "junk").when(shape == 1, "29 Feb, 9:07 PM").otherwise(F.date_format(moment, "d MMM, hh:mm a"))
    )
    rows = v.events().select(
        "event_id", text.alias("text"), (F.col("ts") + F.make_interval(days=F.lit(500))).alias("as_of")
    )
    parsed = D.with_absolute_date(rows, "text", ABSOLUTE_FORMAT, "as_of", "date_posted")
    return parsed.select("event_id", "date_posted", "date_posted_status")


@query(
    """SELECT event_id, CASE WHEN event_id % 7 > 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS date_posted,
  CASE WHEN event_id % 7 > 0 THEN 'ok' ELSE 'reject' END AS date_posted_status,
  CASE WHEN event_id % 7 > 0 THEN strftime(CASE WHEN event_id % 3 = 0 THEN ts ELSE ts - INTERVAL 330 MINUTE END,
       '%Y-%m-%d %H:%M:%S') END AS date_posted_utc FROM events"""
)
def parse_iso_date(v: Views) -> DataFrame:
    zones = F.element_at(F.array(F.lit("Z"), F.lit("+05:30"), F.lit("+0530")), F.pmod("event_id", F.lit(3)).cast("int") + 1)
    text = F.when(F.pmod("event_id", F.lit(7)) == 0, F.lit("2024-01-01 without zone")).otherwise(
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), zones)
    )
    parsed = D.with_iso_date(v.events().select("event_id", text.alias("text")), "text", "date_posted")
    return parsed.drop("text")


@query("SELECT event_id, strftime(ts + INTERVAL 330 MINUTE, '%d/%m/%Y %H:%M:%S') AS shown FROM events")
def ist_timestamp(v: Views) -> DataFrame:
    return v.events().select("event_id", D.display_time(F.col("ts")).alias("shown"))


# --- extraction --------------------------------------------------------------------------------------
ENTITIES_SQL = "replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&amp;', '&')"


@query(
    f"""SELECT page_id, {ENTITIES_SQL.format("trim(regexp_extract(html, '<article><h1>(.*?)</h1>', 1, 's'))")} AS headline,
  url AS article_link FROM pages"""
)
def extract_articles(v: Views) -> DataFrame:
    """Headlines of the given pages: one article element per page."""
    items = extract.usable(extract.extract_site(v._spread("pages"), sites.ARTICLE_PAGE))
    return items.select("page_id", "headline", "article_link")


@query(
    with_views(
        "univ",
        body="""SELECT ticker, visit_order, site, replace(url, '{ticker}', ticker) AS url FROM univ, (VALUES
  (0, 'GoogleFinance', 'https://www.google.com/finance/quote/{ticker}:NSE'),
  (1, 'YahooFinance', 'https://finance.yahoo.com/quote/{ticker}.NS/news/'),
  (2, 'Finology', 'https://ticker.finology.in/company/{ticker}')) s(visit_order, site, url)
WHERE idx_500""",
    )
)
def ticker_source_fanout(v: Views) -> DataFrame:
    return extract.site_requests(v.universe().where("idx_500"), sites.TICKER_SITES)


def _escaped(column: str) -> Column:
    return F.replace(F.replace(column, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))


PAGE_HEAD = '<html><head><script>var t="</div></li></a>";</script></head><body><p>lead'


def site_pages(v: Views) -> DataFrame:
    """Listing pages as the sites mark them up: every event as one item on each of four sites.

    Items cycle through complete ones, ones without link text, and ones without a date.
    """
    shape = F.pmod("event_id", F.lit(10))
    number = F.pmod("event_id", F.lit(50)).cast("string")
    events = v._spread("events").withColumns({"text": _relative_text(number), "as_of": F.col("ts")})
    headline = F.concat(_escaped("event_type"), F.lit(" "), _escaped("props"))
    link = F.when(shape == 3, "").otherwise(F.concat(F.lit("/ev/"), "event_id"))

    def html(*parts) -> Column:
        return F.concat(F.lit(PAGE_HEAD), *(F.lit(p) if isinstance(p, str) else p for p in parts), F.lit("</body>"))

    source = F.col("event_type")
    date_block = F.when(shape == 4, "").otherwise(F.concat(F.lit('<div class="Adak">'), F.col("text"), F.lit("</div>")))
    bodies = {
        "GoogleFinance": html(
            '<div class="z4rs2b big"><a href="', link, '"><div class="sfyJob">', source,
            '</div><div class="Yfwt5">\n ', headline, "\\n</div>", date_block, "</a></div>",
        ),
        "YahooFinance": html(
            '<ul><li class="stream-item x story-item yf-1drgw5l"><a href="', link, '"><h3>', headline,
            '<br></h3></a><div class="publishing yf-1weyqlp"> ', source, " • ", F.col("text"), "</div></ul>",
        ),
        "Finology": html(
            '<div id="newsarticles"><a id="btnDetails" class="newslink y" href="#"><span> ', headline,
            "</span><small>", F.date_format("ts", "dd MMM, hh:mm a"), '</small></a></div><a class="newslink"><span>no</span></a>',
        ),
        "GoogleNews": html(
            '<article class="IFHyqb DeXSAc"><a class="JtKRv" href=".', link, '">', headline,
            '</a><div class="vr1PYe">', source, '</div><time datetime="',
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), '">then</time></article>',
        ),
    }
    rules = {rule.name: rule for rule in (*sites.TICKER_SITES, sites.GOOGLE_NEWS)}
    ticker = F.concat(F.lit("T"), "user_id")
    landed_pages = F.array(
        *(
            F.struct(
                F.lit(name).alias("site"),
                F.replace(F.lit(rules[name].url), F.lit("{ticker}"), ticker).alias("url"),
                body.alias("html"),
            )
            for name, body in bodies.items()
        )
    )
    return events.select("event_id", ticker.alias("ticker"), "as_of", F.inline(landed_pages))


LISTINGS_SQL = f"""SELECT event_id, 'T' || user_id AS ticker, site, event_type || ' ' || props AS headline,
  CASE site WHEN 'Finology' THEN 'Finology' ELSE event_type END AS source,
  CASE site WHEN 'GoogleFinance' THEN CASE WHEN event_id % 10 = 3 THEN '' ELSE '/ev/' || event_id END
            WHEN 'YahooFinance' THEN 'https://finance.yahoo.com' || CASE WHEN event_id % 10 = 3 THEN '' ELSE '/ev/' || event_id END
            WHEN 'Finology' THEN 'https://ticker.finology.in/company/T' || user_id
            ELSE 'https://news.google.com' || CASE WHEN event_id % 10 = 3 THEN '' ELSE '/ev/' || event_id END END AS article_link,
  CASE site WHEN 'Finology' THEN strftime(this_year - INTERVAL 1 YEAR, '%Y-%m-%d %H:%M:00')
            WHEN 'GoogleNews' THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
            ELSE CASE WHEN site = 'GoogleFinance' AND event_id % 10 = 4 THEN NULL
                      WHEN moment IS NOT NULL THEN strftime(moment, '%Y-%m-%d %H:%M:%S')
                      WHEN event_id % 12 IN (6, 7, 8, 9) THEN '' END END AS date_posted,
  CASE WHEN site = 'GoogleFinance' AND event_id % 10 = 4 THEN 'missing element'
       WHEN site IN ('GoogleFinance', 'YahooFinance') AND event_id % 10 = 3 THEN 'missing link'
       WHEN site IN ('GoogleFinance', 'YahooFinance') AND event_id % 12 = 10 THEN 'unreadable date' END AS problem
FROM (SELECT *, {RELATIVE_VALUE_SQL} AS moment, ts + INTERVAL 1 YEAR AS this_year FROM events),
     (VALUES ('GoogleFinance'), ('YahooFinance'), ('Finology'), ('GoogleNews')) s(site)"""


@query(LISTINGS_SQL)
def extract_site_listings(v: Views) -> DataFrame:
    """Items of the four news sites, with the reason for each one that is not usable."""
    rules = (*sites.TICKER_SITES, sites.GOOGLE_NEWS)
    items = extract.extract_articles(site_pages(v), rules)
    return items.select(
        "event_id", "ticker", "site", "headline", "source", "article_link", "date_posted", "problem"
    )


@query(
    with_views(
        "univ",
        body=f""", listed AS ({LISTINGS_SQL}),
ranked AS (
  SELECT l.*, row_number() OVER (PARTITION BY ticker, headline ORDER BY CASE site WHEN 'GoogleFinance' THEN 0 WHEN 'YahooFinance' THEN 1 ELSE 2 END,
         date_posted, source NULLS FIRST, article_link NULLS FIRST) AS r
  FROM listed l WHERE site <> 'GoogleNews' AND problem IS NULL AND date_posted IS NOT NULL AND ticker IN (SELECT ticker FROM univ WHERE idx_500))
SELECT ticker, headline, date_posted, source, article_link FROM ranked WHERE r = 1""",
    )
)
def collect_news(v: Views) -> DataFrame:
    """The daily collection on an empty store: pages of an index's tickers to stored articles."""
    store = ArticleStore(v.spark, scratch_path(v.spark, "store"))
    store.write_universe(v.universe())
    jobs.collect_news(store, site_pages(v), "idx_500", F.to_timestamp(F.lit("2024-02-01 17:30:00")))
    return store.articles.select("ticker", "headline", "date_posted", "source", "article_link")
