"""The views of ``sources.views`` as SQL, for the oracle."""

from __future__ import annotations

# name -> (names it builds on, definition), in dependency order.
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "raw_scores": (
        (),
        """
        SELECT *, ((event_id*37)%3001)/9973.0::DOUBLE AS p, ((event_id*53)%3001)/9973.0::DOUBLE AS n
        FROM events""",
    ),
    "art": (
        ("raw_scores",),
        """
        SELECT 'T' || user_id AS ticker, event_type || ' ' || props AS headline,
               strftime(ts, '%Y-%m-%d %H:%M:%S') AS date_posted, event_type AS source,
               'ev/' || event_id AS article_link,
               CASE WHEN event_type <> 'error' THEN n::FLOAT END AS negative_sentiment,
               CASE WHEN event_type <> 'error' THEN p::FLOAT END AS positive_sentiment,
               CASE WHEN event_type <> 'error' THEN (1 - p - n)::FLOAT END AS neutral_sentiment,
               CASE WHEN event_type <> 'error'
                    THEN round_even(CASE WHEN p > n THEN p ELSE -n END, 4)::FLOAT END AS compound_sentiment,
               ts AS created_at, event_id AS arrival_seq
        FROM raw_scores""",
    ),
    "meta": (
        (),
        """
        SELECT 'T' || c_custkey AS ticker, r_name AS sector, n_name AS industry,
               round(c_acctbal + 1000, 2) AS "mCap", c_name AS "companyName"
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    ),
    "univ": (
        (),
        """
        SELECT 'T' || c_custkey AS ticker, 'IN' || lpad(c_custkey::VARCHAR, 10, '0') AS "ISIN_Code",
               c_custkey % 10 = 0 AS idx_50, c_custkey % 10 < 2 AS idx_100,
               c_custkey % 10 < 4 AS idx_200, true AS idx_500
        FROM customer""",
    ),
    "news_members": (
        (),
        """
        SELECT 'idx_50' AS index_name, 'T' || c_custkey AS ticker,
               DATE '2024-01-01' + (c_custkey % 7)::INT AS effective_date,
               CASE WHEN c_custkey % 3 = 0 THEN DATE '2024-01-21' END AS end_date
        FROM customer WHERE c_custkey % 10 = 0""",
    ),
    "trades": (
        (),
        """
        SELECT 'S' || l_suppkey AS ticker, l_shipdate::DATE AS date,
               (floor(round(l_extendedprice * 100)::BIGINT * 100 / l_quantity) / 10000.0::DOUBLE)::DECIMAL(12,4) AS price,
               l_quantity::BIGINT AS quantity,
               (round(l_extendedprice * 100) / 100.0::DOUBLE)::DECIMAL(14,2) AS amount,
               (l_orderkey * 8 + l_linenumber) * 1048576 + l_partkey % 1048576 AS seq
        FROM lineitem""",
    ),
    "px": (
        ("trades",),
        """
        SELECT ticker, date, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low,
               arg_max(price, seq) AS close, sum(quantity)::BIGINT AS volume, sum(amount) AS turnover
        FROM trades GROUP BY ticker, date""",
    ),
    "ipx": (
        (),
        """
        SELECT event_type AS ticker, ts::DATE AS date, arg_min(value + 1.0::DOUBLE, event_id) AS open,
               max(value + 1.0::DOUBLE) AS high, min(value + 1.0::DOUBLE) AS low,
               arg_max(value + 1.0::DOUBLE, event_id) AS close, count(*) AS volume
        FROM events GROUP BY 1, 2""",
    ),
    "shares": (
        (),
        """
        SELECT 'S' || s_suppkey AS ticker, (s_suppkey % 97) * 100 + 1000 AS total_shares,
               s_suppkey % 80 + 20 AS ff_pct, r_name AS sector, n_name AS industry, s_acctbal AS acctbal
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    ),
    "mkt": (
        ("px", "shares"),
        """
        SELECT px.ticker, date, sector, close, volume,
               total_shares::DECIMAL(15,0) * close AS market_cap,
               ((total_shares * ff_pct)::DECIMAL(15,0) * close)::DECIMAL(30,6) * 0.01::DECIMAL(3,2) AS ffmc
        FROM px JOIN shares ON px.ticker = shares.ticker""",
    ),
    "fund": (
        ("shares",),
        """
        SELECT r.ticker, quarter, sector, industry, revenue, revenue / total_shares AS eps,
               (acctbal + 500) / total_shares * 100 AS book_value_per_share
        FROM (SELECT 'S' || l_suppkey AS ticker,
                     last_day((date_trunc('quarter', l_shipdate) + INTERVAL 2 MONTH)::DATE) AS quarter,
                     sum(round(l_extendedprice * 100)::BIGINT * round((1 - l_discount) * 100)::BIGINT)::BIGINT
                       / 10000.0::DOUBLE AS revenue
              FROM lineitem GROUP BY 1, 2) r
        JOIN shares ON r.ticker = shares.ticker""",
    ),
    "actions": (
        (),
        """
        SELECT 'S' || s_suppkey AS ticker, DATE '1998-01-01' + (s_suppkey % 365)::INT AS action_date,
               CASE s_suppkey % 3 WHEN 0 THEN 'split' WHEN 1 THEN 'bonus' ELSE 'dividend' END AS action_type,
               CASE s_suppkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS ratio_numerator,
               CASE s_suppkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 END AS ratio_denominator,
               CASE WHEN s_suppkey % 3 = 2 THEN s_suppkey % 9 + 1 END::DECIMAL(10,4) AS amount
        FROM supplier
        UNION ALL
        SELECT 'S' || s_suppkey, DATE '1999-06-01' + (s_suppkey % 100)::INT, 'split', 1, 2, NULL::DECIMAL(10,4)
        FROM supplier WHERE s_suppkey % 5 = 0""",
    ),
    "book": (
        (),
        """
        SELECT 'B' || (o_custkey % 50) AS ticker,
               CASE WHEN o_orderstatus = 'F' THEN 'bid' ELSE 'ask' END AS side,
               round(o_totalprice / 1000)::BIGINT + CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 500 END AS price,
               o_orderkey % 9 + 1 AS qty
        FROM orders WHERE o_orderstatus IN ('F', 'O')""",
    ),
    "qlog": (
        (),
        """
        SELECT 'log-' || event_id AS log_id, event_type AS generation_method,
               json_extract_string(props, '$.k')::INT AS result_count,
               round(value * 100)::INT AS processing_time_ms, value < 200 AS success,
               ts AS timestamp, 'IDX' || user_id AS index_id
        FROM events""",
    ),
    # --- index building blocks --------------------------------------------------------------
    "latest": (
        ("mkt",),
        """
        SELECT ticker, sector, max(date) AS date, arg_max(close, date) AS close,
               arg_max(ffmc, date) AS ffmc, sum(volume)::BIGINT AS volume
        FROM mkt WHERE date <= DATE '1998-12-31' GROUP BY ticker, sector""",
    ),
    "picked": (
        ("latest",),
        """
        SELECT sector AS index_name, ticker, close, ffmc, volume
        FROM (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY ffmc DESC, ticker) AS r FROM latest)
        WHERE r <= 10""",
    ),
    "sector_series": (
        ("picked", "mkt"),
        """
        SELECT index_name, mkt.ticker, mkt.date, mkt.ffmc
        FROM mkt JOIN picked ON mkt.ticker = picked.ticker""",
    ),
    "all_series": (
        ("sector_series",),
        """
        SELECT * FROM sector_series
        UNION ALL SELECT 'MARKET', ticker, date, ffmc FROM sector_series""",
    ),
    "calendar": (
        ("all_series",),
        "SELECT DISTINCT index_name, date FROM all_series",
    ),
    "spans": (
        ("all_series",),
        """
        SELECT *, lead(date) OVER (PARTITION BY index_name, ticker ORDER BY date) AS until
        FROM all_series""",
    ),
    "combined": (
        ("calendar", "spans"),
        """
        SELECT c.index_name, c.date, sum(s.ffmc) AS combined, count(*) AS n_live
        FROM calendar c JOIN spans s ON c.index_name = s.index_name AND s.date <= c.date
             AND (s.until IS NULL OR c.date < s.until)
        GROUP BY 1, 2""",
    ),
    "index_vals": (
        ("combined",),
        """
        SELECT index_name, date, combined,
               combined::DOUBLE / first_value(combined::DOUBLE) OVER (PARTITION BY index_name ORDER BY date) * 1000
                 AS index_value
        FROM (SELECT *, max(n_live) OVER (PARTITION BY index_name) AS n FROM combined) WHERE n_live = n""",
    ),
    "index_rets": (
        ("index_vals",),
        """
        SELECT * FROM (
          SELECT index_name, date, index_value / lag(index_value) OVER (PARTITION BY index_name ORDER BY date) - 1 AS ret
          FROM index_vals) WHERE ret IS NOT NULL""",
    ),
    "rets": (
        ("px",),
        """
        SELECT * FROM (
          SELECT ticker, date, close::DOUBLE / lag(close::DOUBLE) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret
          FROM px) WHERE ret IS NOT NULL""",
    ),
    "betas": (
        ("rets", "index_rets"),
        """
        SELECT ticker, covar_samp(r.ret, m.ret) / nullif(var_samp(m.ret), 0) AS beta, count(*) AS n_days
        FROM rets r JOIN index_rets m ON r.date = m.date AND m.index_name = 'MARKET' GROUP BY ticker""",
    ),
    "member": (
        ("mkt",),
        """
        SELECT 'TOP10' AS index_name, ticker, quarter, quarter + 1 AS effective_date,
               CASE WHEN quarter < (SELECT max(last_day((date_trunc('quarter', l_shipdate) + INTERVAL 2 MONTH)::DATE)) FROM lineitem)
                    THEN last_day((quarter + INTERVAL 3 MONTH)::DATE) + 1 END AS end_date
        FROM (SELECT *, row_number() OVER (PARTITION BY quarter ORDER BY ffmc DESC, ticker) AS r
              FROM (SELECT ticker, last_day((date_trunc('quarter', date) + INTERVAL 2 MONTH)::DATE) AS quarter,
                           arg_max(ffmc, date) AS ffmc
                    FROM mkt GROUP BY 1, 2))
        WHERE r <= 10""",
    ),
    # --- the article store split in time ---------------------------------------------------------
    "whole": (
        ("art",),
        """
        SELECT * EXCLUDE (r) FROM (
          SELECT *, row_number() OVER (PARTITION BY ticker, headline ORDER BY created_at, arrival_seq) AS r FROM art) WHERE r = 1""",
    ),
    "stored": (
        ("art",),
        """
        SELECT * EXCLUDE (r) FROM (
          SELECT *, row_number() OVER (PARTITION BY ticker, headline ORDER BY created_at, arrival_seq) AS r
          FROM art WHERE created_at < TIMESTAMP '2024-01-16') WHERE r = 1""",
    ),
    "batch": (
        ("art",),
        """
        SELECT * EXCLUDE (r) FROM (
          SELECT *, row_number() OVER (PARTITION BY ticker, headline ORDER BY arrival_seq) AS r
          FROM art WHERE created_at >= TIMESTAMP '2024-01-16') WHERE r = 1""",
    ),
}


def with_views(*names: str, body: str) -> str:
    """The body behind a WITH list of the named views and all they build on."""
    needed: set[str] = set()

    def need(name: str) -> None:
        for other in VIEWS[name][0]:
            need(other)
        needed.add(name)

    for name in names:
        need(name)
    listed = ",\n".join(f"{name} AS ({VIEWS[name][1]}\n)" for name in VIEWS if name in needed)
    return f"WITH {listed}\n{body}" if listed else body
