"""Explicit schemas (DDL strings) and keys. Nothing here infers a schema from data."""

from __future__ import annotations

SCORE_COLUMNS = (
    "negative_sentiment",
    "positive_sentiment",
    "neutral_sentiment",
    "compound_sentiment",
)
# Scorer output naming -> store naming. Both are accepted by the scored upsert.
SCORER_TO_STORE = {
    "Negative": "negative_sentiment",
    "Positive": "positive_sentiment",
    "Neutral": "neutral_sentiment",
    "compound": "compound_sentiment",
}
LABELS = ("Positive", "Negative", "Neutral")

ARTICLE_KEY = ("ticker", "headline")
ARTICLE_REQUIRED = ("ticker", "headline", "date_posted")
ARTICLE_CONTENT = ("date_posted", "source", "article_link")


# --- the article store -------------------------------------------------------------
ARTICLE_RAW = (
    "ticker string, headline string, date_posted string, article_link string, "
    "source string, arrival_seq bigint"
)
ARTICLE = (
    "ticker string not null, headline string not null, date_posted string not null, "
    "source string, article_link string, negative_sentiment float, "
    "positive_sentiment float, neutral_sentiment float, compound_sentiment float, "
    "created_at timestamp"
)
TICKER_META = (
    "ticker string not null, sector string not null, industry string not null, "
    "mCap float, companyName string not null"
)
MODEL_OUT = "array<struct<label: string, score: float>>"

# --- landed JSON --------------------------------------------------------------------
QUOTE_JSON = (
    "industryInfo struct<macro: string, industry: string>, "
    "priceInfo struct<previousClose: double>, "
    "securityInfo struct<issuedSize: bigint>, "
    "info struct<companyName: string>"
)
ORDER_BOOK_JSON = "marketDeptOrderBook struct<tradeInfo: struct<ffmc: double>>"
LISTING_JSON = ("data array<struct<assets: string, symbol: string, ffmc: double>>")

# Published index membership lists (CSV with header).
INDEX_LIST_CSV = "`Company Name` string, Industry string, Symbol string, Series string, `ISIN Code` string"

# --- market tables --------------------------------------------------------------------
TICKERS = (
    "ticker string not null, isin_code string, company_name string not null, "
    "sector string, industry string, listing_date date, face_value decimal(10,2), "
    "total_shares_outstanding bigint, created_at timestamp, updated_at timestamp"
)
SHARD_MAPPING = (
    "ticker string not null, shard_id string not null, sector string, created_at timestamp"
)
PRICE_DATA = (
    "ticker string not null, date date not null, open_price decimal(12,4) not null, "
    "high_price decimal(12,4) not null, low_price decimal(12,4) not null, "
    "close_price decimal(12,4) not null, volume bigint, adjusted_close decimal(12,4)"
)
MARKET_DATA = (
    "ticker string not null, date date not null, free_float_percentage decimal(5,2), "
    "market_cap decimal(15,2), free_float_market_cap decimal(15,2)"
)
INDEX_CONSTITUENTS = (
    "index_name string not null, ticker string not null, weight decimal(8,4), "
    "effective_date date not null, end_date date"
)
FUNDAMENTAL_DATA = (
    "ticker string not null, quarter date not null, revenue decimal(15,2), "
    "net_income decimal(15,2), eps decimal(8,4), book_value_per_share decimal(8,4), "
    "debt_to_equity decimal(8,4), roe decimal(8,4), roa decimal(8,4)"
)
COMPUTED_METRICS = (
    "ticker string not null, date date not null, pe_ratio decimal(8,4), "
    "pb_ratio decimal(8,4), dividend_yield decimal(8,4), revenue_growth_yoy decimal(8,4), "
    "eps_growth_yoy decimal(8,4), beta decimal(8,4), volatility_30d decimal(8,4)"
)
CUSTOM_INDICES = (
    "index_id string not null, index_name string not null, user_query string not null, "
    "generation_method string not null, base_date date not null, "
    "creation_timestamp timestamp, status string"
)
CUSTOM_INDEX_CONSTITUENTS = (
    "index_id string not null, ticker string not null, weight decimal(8,4) not null, "
    "rationale string, confidence_score decimal(5,4)"
)
QUERY_LOGS = (
    "log_id string not null, user_query string not null, processed_query string, "
    "generation_method string not null, result_count int, processing_time_ms int, "
    "success boolean not null, error_message string, timestamp timestamp, index_id string"
)
INDEX_PERFORMANCE = (
    "index_id string not null, date date not null, index_value decimal(12,4) not null, "
    "returns_1d decimal(8,4), returns_1w decimal(8,4), returns_1m decimal(8,4), "
    "returns_1y decimal(8,4), volatility decimal(8,4), max_drawdown decimal(8,4)"
)
CORPORATE_ACTIONS = (
    "ticker string not null, action_date date not null, action_type string not null, "
    "ratio_numerator int, ratio_denominator int, amount decimal(10,4), "
    "adjustment_factor decimal(10,6)"
)

# Allowed values of the enum columns (fixed values).
GENERATION_METHODS = ("gemini_api", "sql_query")
INDEX_STATUSES = ("active", "archived", "failed")
ACTION_TYPES = ("split", "bonus", "dividend", "rights", "merger")

# --- the given tables -------------------------------------------------------------------
GIVEN = {
    "region": ("r_regionkey int, r_name string"),
    "nation": ("n_nationkey int, n_name string, n_regionkey int"),
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "supplier": ("s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"),
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
        "p_retailprice double"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
        "value double, props string"
    ),
    "documents": ("doc_id bigint, text string, lang string, source string, n_chars bigint"),
    "embeddings": ("vec_id bigint, embedding array<float>, label int"),
    "pages": ("page_id bigint, url string, html string"),
    "benchmark": ("item_id bigint, text string"),
    "labels": ("doc_id bigint, quality int, toxic int"),
    "conversations": ("conv_id bigint, turn bigint, role string, text string"),
}
