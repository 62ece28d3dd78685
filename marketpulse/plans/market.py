"""Queries over prices, indices, risk and fundamentals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fundamentals as Q
from ..operators import governance, indices, prices, risk
from ..session import materialized, scratch_path
from ..sources.views import Views, quarter_end
from .registry import query, r6
from .sql_views import with_views

REBALANCE = "1998-12-31"
PER_SECTOR = 10


# --- building blocks -----------------------------------------------------------------------------
def latest(v: Views) -> DataFrame:
    """Last close, free-float cap and traded volume per ticker up to the rebalance date."""
    return (
        v.market_data()
        .where(F.col("date") <= F.lit(REBALANCE).cast("date"))
        .groupBy("ticker", "sector")
        .agg(
            F.max_by("close", "date").alias("close"),
            F.max_by("ffmc", "date").alias("ffmc"),
            F.sum("volume").alias("volume"),
        )
    )


def picked(v: Views) -> DataFrame:
    """The ten largest of each sector, as the constituents of that sector's index.

    Written once per query: the list is short and every later step starts from it.
    """
    top = indices.select_top(latest(v), "ffmc", PER_SECTOR, within=["sector"])
    return materialized(top.withColumnRenamed("sector", "index_name"), "constituents")


def with_market(constituents: DataFrame) -> DataFrame:
    """Each constituent in its own index and in the index of all of them."""
    return constituents.select("ticker", F.explode(F.array("index_name", F.lit("MARKET"))).alias("index_name"))


def constituent_series(v: Views, constituents: DataFrame) -> DataFrame:
    """Daily free-float caps of the constituents, for each index and for all of them."""
    held = v.market_data(only=constituents)
    return held.select("ticker", "date", "ffmc").join(with_market(constituents), "ticker")


def index_values_of(v: Views, constituents: DataFrame) -> DataFrame:
    """Index values: one row per index and day, written once per query."""
    series = constituent_series(v, constituents)
    return materialized(indices.index_values(indices.combined_mcap(series)), "index_values")


def index_returns(values: DataFrame) -> DataFrame:
    return prices.daily_returns(values, "index_value", "index_name")


def market_of(index_rets: DataFrame) -> DataFrame:
    return index_rets.where("index_name = 'MARKET'").select("date", F.col("ret").alias("market_ret"))


def members(v: Views) -> DataFrame:
    """Quarterly ten largest over all tickers, as validity intervals."""
    quarters = (
        v.market_data()
        .groupBy("ticker", quarter_end(F.col("date")).alias("quarter"))
        .agg(F.max_by("ffmc", "date").alias("ffmc"))
    )
    selected = materialized(indices.select_top(quarters, "ffmc", 10, within=["quarter"]), "selected")
    return indices.membership(selected, "TOP10")


# --- prices -----------------------------------------------------------------------------------------
@query(
    with_views(
        "px",
        body="""SELECT date, ticker AS symbol, open::DOUBLE AS open, high::DOUBLE AS high, low::DOUBLE AS low,
  close::DOUBLE AS close, volume, turnover::DOUBLE AS turnover, turnover::DOUBLE / volume AS vwap FROM px""",
    )
)
def ohlcv_project(v: Views) -> DataFrame:
    raw = v.prices().withColumn("avg_price", F.col("turnover").cast("double") / F.col("volume"))
    names = dict(
        zip(
            prices.OHLCV_COLUMNS,
            ("date", "ticker", "open", "high", "low", "close", "volume", "turnover", "avg_price"),
        )
    )
    shaped = prices.project_by_name(raw, names)
    money = ("open", "high", "low", "close", "turnover")
    return shaped.withColumns({c: F.col(c).cast("double") for c in money})


@query(
    with_views(
        "ipx",
        body="SELECT date, ticker AS index_name, round(open, 4) AS open, round(high, 4) AS high, "
        "round(low, 4) AS low, round(close, 4) AS close FROM ipx",
    )
)
def index_history_project(v: Views) -> DataFrame:
    names = dict(zip(prices.INDEX_HISTORY_COLUMNS, ("date", "ticker", "open", "high", "low", "close")))
    shaped = prices.project_by_name(v.series_prices(), names)
    return shaped.withColumns({c: F.col(c).cast("double") for c in ("open", "high", "low", "close")})


RANGE_TICKERS = ["S1", "S2", "S3", "S5", "S8", "S13"]


@query(
    with_views(
        "px",
        body="""SELECT ticker, date, close::DOUBLE AS close FROM px
WHERE ticker IN ('S1', 'S2', 'S3', 'S5', 'S8', 'S13') AND date BETWEEN DATE '1996-04-01' AND DATE '1997-01-01'""",
    )
)
def price_range_scan(v: Views) -> DataFrame:
    days = ("1996-04-01", "1997-01-01")
    wanted = prices.price_range(v.prices(tickers=RANGE_TICKERS, between=days), RANGE_TICKERS, *days)
    return wanted.select("ticker", "date", F.col("close").cast("double").alias("close"))


@query(
    with_views(
        "px",
        "mkt",
        body="""SELECT p.ticker, p.date, p.close::DOUBLE AS close, m.market_cap::DOUBLE AS market_cap
FROM px p JOIN mkt m ON p.ticker = m.ticker AND p.date = m.date
WHERE p.date BETWEEN DATE '1997-04-01' AND DATE '1998-01-01'""",
    )
)
def price_market_join(v: Views) -> DataFrame:
    span = F.col("date").between(F.lit("1997-04-01").cast("date"), F.lit("1998-01-01").cast("date"))
    closes = v.prices().select("ticker", "date", "close").where(span)
    caps = v.market_data().select("ticker", "date", "market_cap")
    return closes.join(caps, ["ticker", "date"]).select(
        "ticker", "date", F.col("close").cast("double").alias("close"), F.col("market_cap").cast("double").alias("market_cap")
    )


@query(
    with_views(
        "mkt",
        body="""SELECT sector, date, sum(market_cap)::DOUBLE AS market_cap, count(*) AS n_tickers,
  sum(close)::DOUBLE / count(*) AS avg_close FROM mkt GROUP BY sector, date""",
    )
)
def sector_market_cap(v: Views) -> DataFrame:
    return (
        v.market_data()
        .groupBy("sector", "date")
        .agg(
            F.sum("market_cap").cast("double").alias("market_cap"),
            F.count(F.lit(1)).alias("n_tickers"),
            (F.sum("close").cast("double") / F.count(F.lit(1))).alias("avg_close"),
        )
    )


@query(with_views("mkt", body="SELECT ticker, date, ffmc::DOUBLE AS ffmc FROM mkt"))
def free_float_mcap(v: Views) -> DataFrame:
    return v.market_data().select("ticker", "date", F.col("ffmc").cast("double").alias("ffmc"))


@query(
    with_views(
        "px",
        "actions",
        body="""SELECT ticker, date, round(close * factor, 6) AS adjusted_close, round(factor, 6) AS factor FROM (
  SELECT p.ticker, p.date, p.close::DOUBLE AS close,
         coalesce(product(CASE WHEN action_type IN ('split', 'bonus')
                               THEN ratio_numerator::DOUBLE / ratio_denominator ELSE 1 END), 1) AS factor
  FROM px p LEFT JOIN actions a ON p.ticker = a.ticker AND p.date < a.action_date
  GROUP BY p.ticker, p.date, p.close)""",
    )
)
def adjusted_close(v: Views) -> DataFrame:
    closes = v.prices().select("ticker", "date", "close")
    return prices.adjusted_close(closes, v.actions()).select("ticker", "date", r6("adjusted_close"), r6("factor"))


@query(
    with_views(
        "px",
        body="""SELECT ticker, date,
  round(c / lag(c) OVER (PARTITION BY ticker ORDER BY date) - 1, 6) AS returns_1d,
  round(c / last_value(c) OVER (PARTITION BY ticker ORDER BY date
        RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 7 DAYS PRECEDING) - 1, 6) AS returns_1w,
  round(c / last_value(c) OVER (PARTITION BY ticker ORDER BY date
        RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MONTH PRECEDING) - 1, 6) AS returns_1m,
  round(c / last_value(c) OVER (PARTITION BY ticker ORDER BY date
        RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 YEAR PRECEDING) - 1, 6) AS returns_1y
FROM (SELECT ticker, date, close::DOUBLE AS c FROM px)""",
    )
)
def returns_multi(v: Views) -> DataFrame:
    series = prices.returns(v.prices().select("ticker", "date", "close"))
    return series.select("ticker", "date", *(r6(f"returns_{p}") for p in ("1d", "1w", "1m", "1y")))


@query(
    with_views(
        "rets",
        body="""SELECT ticker, date, round(CASE WHEN n = 30 THEN s END, 6) AS volatility FROM (
  SELECT ticker, date, stddev_samp(ret) OVER w AS s, count(ret) OVER w AS n FROM rets
  WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))""",
    )
)
def volatility_30d(v: Views) -> DataFrame:
    return prices.rolling_volatility(v.prices()).select("ticker", "date", r6("volatility"))


@query(
    with_views(
        "px",
        body="""SELECT ticker, date, round(dd, 6) AS drawdown,
  round(min(dd) OVER (PARTITION BY ticker ORDER BY date), 6) AS max_drawdown
FROM (SELECT ticker, date, close::DOUBLE / max(close::DOUBLE) OVER (PARTITION BY ticker ORDER BY date) - 1 AS dd FROM px)""",
    )
)
def max_drawdown(v: Views) -> DataFrame:
    down = prices.max_drawdown(v.prices().select("ticker", "date", "close"))
    return down.select("ticker", "date", r6("drawdown"), r6("max_drawdown"))


# --- index construction --------------------------------------------------------------------------
@query(
    with_views(
        "picked",
        body="SELECT index_name AS sector, ticker, ffmc::DOUBLE AS ffmc FROM picked",
    )
)
def select_top_ffmc(v: Views) -> DataFrame:
    return picked(v).select(
        F.col("index_name").alias("sector"), "ticker", F.col("ffmc").cast("double").alias("ffmc")
    )


WEIGHT_SCHEMES = {"ffmc": "ffmc", "price": "close", "factor": "volume", "equal": None}


@query(
    with_views(
        "picked",
        body="""SELECT index_name, ticker,
  round(ffmc::DOUBLE / sum(ffmc::DOUBLE) OVER w, 6) AS w_ffmc,
  round(close::DOUBLE / sum(close::DOUBLE) OVER w, 6) AS w_price,
  round(volume::DOUBLE / sum(volume::DOUBLE) OVER w, 6) AS w_factor,
  round(1.0::DOUBLE / count(*) OVER w, 6) AS w_equal
FROM picked WINDOW w AS (PARTITION BY index_name)""",
    )
)
def index_weights(v: Views) -> DataFrame:
    frame = picked(v)
    for scheme, measure in WEIGHT_SCHEMES.items():
        frame = indices.weights(frame, measure).withColumnRenamed("weight", f"w_{scheme}")
    return frame.select("index_name", "ticker", *(r6(f"w_{s}") for s in WEIGHT_SCHEMES))


# Single-name cap and limit for the three largest: the published example, and tighter ones.
CAPS = {"wide": (0.33, 0.62), "tight": (0.14, 0.36)}

WEIGHT_LIST_SQL = """w AS (
  SELECT index_name, ticker, w, row_number() OVER (PARTITION BY index_name ORDER BY w DESC, ticker) AS r,
         count(*) OVER (PARTITION BY index_name) AS n
  FROM (SELECT index_name, ticker, ffmc::DOUBLE / sum(ffmc::DOUBLE) OVER (PARTITION BY index_name) AS w FROM picked)),
tails AS (
  SELECT a.index_name, a.r, a.w, a.n, sum(b.w) AS tail
  FROM w a JOIN w b ON a.index_name = b.index_name AND b.r >= a.r GROUP BY 1, 2, 3, 4)"""
# For caps in ``tried(index_name, scheme, cap, ...)``: the scale of the uncapped names.
SCALES_SQL = """scales AS (
  SELECT t.index_name, t.scheme, t.cap, arg_min((1 - (r - 1) * cap) / tail, r) AS s
  FROM tried t JOIN tails USING (index_name)
  WHERE (r - 1) * cap < 1 AND w * (1 - (r - 1) * cap) / tail <= cap + 1e-12 GROUP BY 1, 2, 3),
filled AS (
  SELECT t.index_name, t.scheme, t.cap, ticker, r,
         CASE WHEN t.cap * n < 1 THEN 1.0::DOUBLE / n ELSE least(t.cap, w * s) END AS capped_weight
  FROM tried t JOIN w USING (index_name) LEFT JOIN scales USING (index_name, scheme, cap))"""
_CAP_ROWS = ", ".join(f"('{name}', {cap}::DOUBLE, {top}::DOUBLE)" for name, (cap, top) in CAPS.items())


@query(
    with_views(
        "picked",
        body=f""", {WEIGHT_LIST_SQL},
tried AS (SELECT DISTINCT index_name, scheme, cap FROM w, (VALUES {_CAP_ROWS}) c(scheme, cap, top)),
{SCALES_SQL}
SELECT index_name, ticker, scheme, round(capped_weight, 6) AS capped_weight FROM filled""",
    )
)
def capped_weights(v: Views) -> DataFrame:
    """Single-name caps at two limits."""
    weighted = indices.weights(picked(v), "ffmc").select("index_name", "ticker", "weight")
    out = [
        indices.capped_weights(weighted, cap).withColumn("scheme", F.lit(name)) for name, (cap, _) in CAPS.items()
    ]
    return out[0].unionByName(out[1]).select("index_name", "ticker", "scheme", r6("capped_weight"))


@query(
    with_views(
        "picked",
        body=f""", {WEIGHT_LIST_SQL},
caps AS (SELECT * FROM (VALUES {_CAP_ROWS}) c(scheme, cap, top)),
edge AS (SELECT index_name, max(w) FILTER (WHERE r = 2) AS w2, max(w) FILTER (WHERE r = 3) AS w3,
                max(tail) FILTER (WHERE r = 2) AS s2, max(tail) FILTER (WHERE r = 3) AS s3 FROM tails GROUP BY 1),
tried AS (
  SELECT DISTINCT index_name, scheme, cap FROM (
    SELECT index_name, scheme, unnest([cap, top / 3, (top - (w2 + w3) / s2) / (1 - (w2 + w3) / s2),
                                       (top - w3 / s3) / (2 - 2 * w3 / s3)]) AS cap, cap AS limit_cap
    FROM edge, caps) WHERE cap > 0 AND cap <= limit_cap),
{SCALES_SQL},
fitting AS (
  -- where the limit cannot be met, a third of it is below 1/n and the weights are equal
  SELECT index_name, scheme, coalesce(max(f.cap) FILTER (WHERE top3 <= top + 1e-9), max(top) / 3) AS cap FROM (
    SELECT index_name, scheme, cap, sum(capped_weight) FILTER (WHERE r <= 3) AS top3 FROM filled GROUP BY 1, 2, 3) f
  JOIN caps USING (scheme) GROUP BY 1, 2)
SELECT index_name, ticker, scheme, round(capped_weight, 6) AS capped_weight
FROM filled JOIN fitting USING (index_name, scheme, cap)""",
    )
)
def capped_weights_top3(v: Views) -> DataFrame:
    """Single-name caps with a limit on the three largest together."""
    weighted = indices.weights(picked(v), "ffmc").select("index_name", "ticker", "weight")
    out = [
        indices.capped_weights(weighted, cap, top).withColumn("scheme", F.lit(name))
        for name, (cap, top) in CAPS.items()
    ]
    return out[0].unionByName(out[1]).select("index_name", "ticker", "scheme", r6("capped_weight"))


@query(
    with_views(
        "picked",
        body=f""", named AS (SELECT index_name, count(*) AS n FROM picked GROUP BY index_name)
SELECT index_name, scheme, n, n >= 1 / cap AND n > 3 AND n >= 3 / top AS feasible
FROM named, (VALUES {_CAP_ROWS}) c(scheme, cap, top)""",
    )
)
def capping_feasible(v: Views) -> DataFrame:
    """Whether each index has names enough for its limits."""
    weighted = indices.weights(picked(v), "ffmc").select("index_name", "ticker", "weight")
    out = [indices.capped_weights(weighted, cap, top).withColumn("scheme", F.lit(name)) for name, (cap, top) in CAPS.items()]
    return out[0].unionByName(out[1]).groupBy("index_name", "scheme").agg(F.count(F.lit(1)).alias("n"), F.bool_and("feasible").alias("feasible"))


@query(
    with_views(
        "index_vals",
        body="""SELECT index_name, date, round(combined::DOUBLE, 4) AS combined, round(index_value, 6) AS index_value
FROM index_vals""",
    )
)
def index_value(v: Views) -> DataFrame:
    return index_values_of(v, picked(v)).select(
        "index_name", "date", F.round(F.col("combined").cast("double"), 4).alias("combined"), r6("index_value")
    )


def dividends_paid(v: Views, constituents: DataFrame) -> DataFrame:
    """Cash paid per index and day on the free float of its constituents."""
    paid = v.actions().where("action_type = 'dividend'").select("ticker", F.col("action_date").alias("date"), "amount")
    float_shares = v.shares().select("ticker", (F.col("total_shares") * F.col("ff_pct")).alias("__units"))
    cash = F.sum(F.col("__units").cast("decimal(15,0)") * F.col("amount")) / F.lit(100.0)
    return (
        paid.join(with_market(constituents), "ticker")
        .join(float_shares, "ticker")
        .groupBy("index_name", "date")
        .agg(cash.alias("dividend"))
    )


TOTAL_RETURN_VIEWS = """, divs AS (
  SELECT index_name, date, sum(dividend) AS dividend FROM (
    SELECT unnest([p.index_name, 'MARKET']) AS index_name, a.action_date AS date,
           total_shares * ff_pct * amount::DOUBLE / 100 AS dividend
    FROM actions a JOIN picked p ON a.ticker = p.ticker JOIN shares s ON s.ticker = p.ticker
    WHERE action_type = 'dividend') GROUP BY 1, 2),
moved AS (
  SELECT d.index_name, (SELECT min(v.date) FROM index_vals v WHERE v.index_name = d.index_name AND v.date >= d.date) AS date,
         sum(d.dividend) AS dividend FROM divs d GROUP BY ALL),
grown AS (
  SELECT v.index_name, v.date, v.index_value,
         coalesce((v.combined::DOUBLE + coalesce(d.dividend, 0))
                  / lag(v.combined::DOUBLE) OVER (PARTITION BY v.index_name ORDER BY v.date), 1) AS g
  FROM index_vals v LEFT JOIN moved d ON d.index_name = v.index_name AND d.date = v.date),
tri AS (
  SELECT index_name, date, index_value,
         1000 * exp(sum(ln(g)) OVER (PARTITION BY index_name ORDER BY date)) AS total_return_value FROM grown)"""


@query(
    with_views(
        "index_vals",
        "actions",
        "shares",
        body=f"""{TOTAL_RETURN_VIEWS}
SELECT index_name, date, round(index_value, 4) AS index_value, round(total_return_value, 4) AS total_return_value FROM tri""",
    )
)
def total_return_index(v: Views) -> DataFrame:
    held = picked(v)
    out = indices.total_return(index_values_of(v, held), dividends_paid(v, held))
    return out.select(
        "index_name",
        "date",
        F.round("index_value", 4).alias("index_value"),
        F.round("total_return_value", 4).alias("total_return_value"),
    )


@query(
    with_views(
        "index_vals",
        body="""SELECT index_name, date,
  round(v / lag(v) OVER (PARTITION BY index_name ORDER BY date) - 1, 6) AS returns_1d,
  round(v / last_value(v) OVER (PARTITION BY index_name ORDER BY date
        RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 7 DAYS PRECEDING) - 1, 6) AS returns_1w,
  round(v / last_value(v) OVER (PARTITION BY index_name ORDER BY date
        RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MONTH PRECEDING) - 1, 6) AS returns_1m,
  round(v / last_value(v) OVER (PARTITION BY index_name ORDER BY date
        RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 YEAR PRECEDING) - 1, 6) AS returns_1y,
  round(CASE WHEN count(r) OVER w30 = 30 THEN stddev_samp(r) OVER w30 END, 6) AS volatility,
  round(min(dd) OVER (PARTITION BY index_name ORDER BY date), 6) AS max_drawdown
FROM (SELECT index_name, date, index_value AS v,
             index_value / lag(index_value) OVER (PARTITION BY index_name ORDER BY date) - 1 AS r,
             index_value / max(index_value) OVER (PARTITION BY index_name ORDER BY date) - 1 AS dd FROM index_vals)
WINDOW w30 AS (PARTITION BY index_name ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""",
    )
)
def index_performance(v: Views) -> DataFrame:
    series = prices.returns(index_values_of(v, picked(v)), "index_value", "index_name")
    risky = prices.with_rolling_volatility(series, "returns_1d", key="index_name")
    down = prices.max_drawdown(risky, "index_value", "index_name")
    names = [f"returns_{p}" for p in ("1d", "1w", "1m", "1y")]
    return down.select("index_name", "date", *(r6(c) for c in (*names, "volatility", "max_drawdown")))


# --- membership -----------------------------------------------------------------------------------
@query(
    with_views(
        "mkt",
        "member",
        body="""SELECT index_name, m.ticker, date, ffmc::DOUBLE AS ffmc, effective_date
FROM mkt m JOIN member k ON m.ticker = k.ticker AND m.date >= k.effective_date
     AND (k.end_date IS NULL OR m.date < k.end_date)""",
    )
)
def constituents_asof(v: Views) -> DataFrame:
    spans = members(v)
    rows = v.market_data(only=spans).select("ticker", "date", "ffmc")
    return indices.active_on(rows, spans).select(
        "index_name", "ticker", "date", F.col("ffmc").cast("double").alias("ffmc"), "effective_date"
    )


@query(
    with_views(
        "member",
        body="""SELECT index_name, ticker, effective_date AS rebalance_date, 'added' AS change FROM member a
WHERE NOT EXISTS (SELECT 1 FROM member b WHERE b.ticker = a.ticker AND b.end_date = a.effective_date)
UNION ALL
SELECT index_name, ticker, end_date, 'removed' FROM member a
WHERE end_date IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM member b WHERE b.ticker = a.ticker AND b.effective_date = a.end_date)""",
    )
)
def index_turnover(v: Views) -> DataFrame:
    return indices.turnover(members(v))


# --- risk -------------------------------------------------------------------------------------------
@query(with_views("betas", body="SELECT ticker, round(beta, 6) AS beta, n_days FROM betas"))
def beta(v: Views) -> DataFrame:
    market = market_of(index_returns(index_values_of(v, picked(v))))
    paired = risk.with_benchmark(prices.daily_returns(v.prices()), market)
    return risk.beta(paired).select("ticker", r6("beta"), "n_days")


@query(
    with_views(
        "betas",
        "picked",
        body="""SELECT index_name, round(sum(w * beta), 6) AS portfolio_beta, count(*) AS n
FROM (SELECT index_name, ticker, ffmc::DOUBLE / sum(ffmc::DOUBLE) OVER (PARTITION BY index_name) AS w FROM picked)
JOIN betas USING (ticker) GROUP BY index_name""",
    )
)
def portfolio_beta(v: Views) -> DataFrame:
    constituents = picked(v)
    market = market_of(index_returns(index_values_of(v, constituents)))
    weighted = indices.weights(constituents, "ffmc").select("index_name", "ticker", "weight")
    held = v.prices(only=constituents)
    betas = risk.beta(risk.with_benchmark(prices.daily_returns(held), market))
    return risk.portfolio_beta(weighted, betas).select("index_name", r6("portfolio_beta"), "n")


@query(
    with_views(
        "index_vals",
        "actions",
        "shares",
        body=f"""{TOTAL_RETURN_VIEWS},
diffs AS (
  SELECT index_name, index_value / lag(index_value) OVER (PARTITION BY index_name ORDER BY date)
         - total_return_value / lag(total_return_value) OVER (PARTITION BY index_name ORDER BY date) AS diff FROM tri)
SELECT index_name, round(stddev_samp(diff) * sqrt(252), 6) AS tracking_error, count(diff) AS n_days
FROM diffs WHERE diff IS NOT NULL GROUP BY index_name""",
    )
)
def tracking_error(v: Views) -> DataFrame:
    """How far each price index strays from its own total-return index."""
    held = picked(v)
    series = indices.total_return(index_values_of(v, held), dividends_paid(v, held))
    both = prices.daily_returns(series, "index_value", "index_name").join(
        prices.daily_returns(series, "total_return_value", "index_name").withColumnRenamed("ret", "market_ret"),
        ["index_name", "date"],
    )
    return risk.tracking_error(both).select("index_name", r6("tracking_error"), "n_days")


@query(
    with_views(
        "index_rets",
        body="""SELECT r.index_name, year(r.date)::INT AS period,
  round(exp(sum(ln(1 + r.ret))) - 1, 6) AS total_return, round(exp(sum(ln(1 + m.ret))) - 1, 6) AS benchmark_return,
  round(exp(sum(ln(1 + r.ret))) - exp(sum(ln(1 + m.ret))), 6) AS excess_return,
  round(stddev_samp(r.ret), 6) AS volatility, round(stddev_samp(m.ret), 6) AS benchmark_volatility, count(*) AS n_days
FROM index_rets r JOIN index_rets m ON r.date = m.date AND m.index_name = 'MARKET'
WHERE r.index_name <> 'MARKET' GROUP BY 1, 2""",
    )
)
def benchmark_compare(v: Views) -> DataFrame:
    rets = index_returns(index_values_of(v, picked(v)))
    paired = risk.with_benchmark(rets.where("index_name <> 'MARKET'"), market_of(rets))
    stats = risk.benchmark_stats(paired.withColumn("period", F.year("date")), "index_name", "period")
    measures = ("total_return", "benchmark_return", "excess_return", "volatility", "benchmark_volatility")
    return stats.select("index_name", "period", *(r6(c) for c in measures), "n_days")


@query(
    with_views(
        "rets",
        "picked",
        body="""SELECT a.ticker AS a, b.ticker AS b, count(*) AS n_days, round(covar_samp(a.ret, b.ret), 6) AS covariance
FROM (SELECT * FROM rets WHERE ticker IN (SELECT ticker FROM picked)) a
JOIN (SELECT * FROM rets WHERE ticker IN (SELECT ticker FROM picked)) b ON a.date = b.date AND a.ticker <= b.ticker
GROUP BY 1, 2 HAVING count(*) > 1""",
    )
)
def return_covariance(v: Views) -> DataFrame:
    """Covariances of the daily returns of all index constituents."""
    held = v.prices(only=picked(v))
    returns = materialized(prices.daily_returns(held), "returns")
    return risk.return_covariance(returns).select("a", "b", "n_days", r6("covariance"))


@query(
    with_views(
        "book",
        body=""", lv AS (SELECT ticker, side, price, sum(qty) AS qty FROM book GROUP BY 1, 2, 3),
best AS (SELECT ticker, max(price) FILTER (WHERE side = 'bid') AS best_bid,
                min(price) FILTER (WHERE side = 'ask') AS best_ask FROM lv GROUP BY ticker),
fill AS (
  SELECT ticker, sum(taken)::BIGINT AS filled, sum(taken * price)::DOUBLE AS paid FROM (
    SELECT ticker, price, least(qty, greatest(150 - (sum(qty) OVER (PARTITION BY ticker ORDER BY price) - qty), 0)) AS taken
    FROM lv WHERE side = 'ask') GROUP BY ticker)
SELECT ticker, filled, (best_bid + best_ask) / 2 AS mid, round(paid / filled, 6) AS average_price,
       round((paid / filled - (best_bid + best_ask) / 2) / ((best_bid + best_ask) / 2), 6) AS impact_cost
FROM best JOIN fill USING (ticker)""",
    )
)
def impact_cost(v: Views) -> DataFrame:
    out = indices.impact_cost(v.order_book(), F.lit(150))
    return out.select("ticker", "filled", "mid", r6("average_price"), r6("impact_cost"))


# --- fundamentals ---------------------------------------------------------------------------------
@query(
    with_views(
        "px",
        "fund",
        body="""SELECT p.ticker, p.date, f.quarter AS asof_date, f.eps
FROM px p ASOF LEFT JOIN fund f ON p.ticker = f.ticker AND p.date >= f.quarter""",
    )
)
def asof_fundamentals(v: Views) -> DataFrame:
    closes = v.prices().select("ticker", "date", "close")
    out = Q.asof(closes, v.fundamentals(), ["eps"], "quarter")
    return out.select("ticker", "date", "asof_date", "eps")


@query(
    with_views(
        "px",
        "fund",
        "actions",
        body=""", facts AS (
  SELECT p.ticker, p.date, p.close::DOUBLE AS close, f.eps, f.book_value_per_share
  FROM px p ASOF LEFT JOIN fund f ON p.ticker = f.ticker AND p.date >= f.quarter),
paid AS (
  SELECT p.ticker, p.date, sum(a.amount)::DOUBLE AS dividends_1y FROM px p
  JOIN actions a ON a.ticker = p.ticker AND a.action_date <= p.date AND a.action_date >= p.date - INTERVAL 1 YEAR
  GROUP BY 1, 2)
SELECT ticker, date, round(CASE WHEN eps > 0 THEN close / eps END, 6) AS pe_ratio,
  round(CASE WHEN book_value_per_share > 0 THEN close / book_value_per_share END, 6) AS pb_ratio,
  round(CASE WHEN close > 0 THEN coalesce(dividends_1y, 0) / close END, 6) AS dividend_yield
FROM facts LEFT JOIN paid USING (ticker, date)""",
    )
)
def valuation_ratios(v: Views) -> DataFrame:
    closes = v.prices().select("ticker", "date", "close")
    dividends = v.actions().where("amount is not null")
    known = Q.with_facts_and_dividends(closes, v.fundamentals(), ["eps", "book_value_per_share"], "quarter", dividends)
    return Q.valuation_ratios(known).select("ticker", "date", r6("pe_ratio"), r6("pb_ratio"), r6("dividend_yield"))


GROWTH_SQL = """SELECT f.ticker, f.quarter, f.sector, f.industry, f.revenue / b.revenue - 1 AS revenue_growth_yoy,
  f.eps / b.eps - 1 AS eps_growth_yoy
FROM fund f LEFT JOIN fund b ON f.ticker = b.ticker AND b.quarter = last_day((f.quarter - INTERVAL 12 MONTH)::DATE)"""


@query(
    with_views(
        "fund",
        body=f"""SELECT ticker, quarter, round(revenue_growth_yoy, 6) AS revenue_growth_yoy,
  round(eps_growth_yoy, 6) AS eps_growth_yoy FROM ({GROWTH_SQL})""",
    )
)
def growth_yoy(v: Views) -> DataFrame:
    return Q.growth_yoy(v.fundamentals(), ["revenue", "eps"]).select(
        "ticker", "quarter", r6("revenue_growth_yoy"), r6("eps_growth_yoy")
    )


@query(
    with_views(
        "fund",
        body=f"""SELECT ticker, round(revenue_growth_yoy, 6) AS revenue_growth_yoy FROM ({GROWTH_SQL})
WHERE sector = 'ASIA' AND quarter = DATE '1998-12-31' AND revenue_growth_yoy IS NOT NULL
ORDER BY revenue_growth_yoy DESC, ticker LIMIT 10""",
    )
)
def screen_growth_topn(v: Views) -> DataFrame:
    """The ten fastest growing companies of one sector in one quarter."""
    grown = Q.growth_yoy(v.fundamentals(), ["revenue"])
    top = Q.screen_growth(grown, "revenue_growth_yoy", 10, "sector = 'ASIA' AND quarter = DATE'1998-12-31'")
    return top.select("ticker", r6("revenue_growth_yoy"))


@query(
    with_views(
        "fund",
        body=""", q AS (
  SELECT ticker, quarter, eps, row_number() OVER (PARTITION BY ticker ORDER BY quarter DESC) AS age
  FROM fund WHERE quarter <= DATE '2000-12-31')
SELECT a.ticker, a.quarter AS latest_quarter, a.eps AS latest_eps
FROM q a JOIN q b ON b.ticker = a.ticker AND b.age = 2 JOIN q c ON c.ticker = a.ticker AND c.age = 3
JOIN q d ON d.ticker = a.ticker AND d.age = 4
WHERE a.age = 1 AND a.eps > 0 AND a.eps > b.eps AND b.eps > c.eps AND c.eps > d.eps
  AND d.quarter = last_day((a.quarter - INTERVAL 9 MONTH)::DATE)""",
    )
)
def screen_eps_streak(v: Views) -> DataFrame:
    """The four latest quarters as of the end of a year."""
    return Q.screen_eps_streak(v.fundamentals(), as_of="2000-12-31")


@query(
    with_views(
        "px",
        "fund",
        "actions",
        "betas",
        body=f""", grown AS (
  SELECT g.*, f.eps, f.book_value_per_share FROM ({GROWTH_SQL}) g JOIN fund f USING (ticker, quarter)),
facts AS (
  SELECT p.ticker, p.date, p.close::DOUBLE AS close, g.eps, g.book_value_per_share, g.revenue_growth_yoy, g.eps_growth_yoy
  FROM px p ASOF LEFT JOIN grown g ON p.ticker = g.ticker AND p.date >= g.quarter),
paid AS (
  SELECT p.ticker, p.date, sum(a.amount)::DOUBLE AS dividends_1y FROM px p
  JOIN actions a ON a.ticker = p.ticker AND a.action_date <= p.date AND a.action_date >= p.date - INTERVAL 1 YEAR
  GROUP BY 1, 2)
SELECT ticker, facts.date, round(CASE WHEN eps > 0 THEN close / eps END, 6) AS pe_ratio,
  round(CASE WHEN book_value_per_share > 0 THEN close / book_value_per_share END, 6) AS pb_ratio,
  round(CASE WHEN close > 0 THEN coalesce(dividends_1y, 0) / close END, 6) AS dividend_yield,
  round(revenue_growth_yoy, 6) AS revenue_growth_yoy, round(eps_growth_yoy, 6) AS eps_growth_yoy,
  round(beta, 6) AS beta, round(vol, 6) AS volatility_30d
FROM facts LEFT JOIN paid USING (ticker, date) LEFT JOIN betas USING (ticker)
LEFT JOIN (SELECT ticker, date, CASE WHEN count(ret) OVER w = 30 THEN stddev_samp(ret) OVER w END AS vol FROM rets
           WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) USING (ticker, date)""",
    )
)
def computed_metrics(v: Views) -> DataFrame:
    v.write_closes()
    market = market_of(index_returns(index_values_of(v, picked(v))))
    closes = v.closes().select("ticker", "date", "close")
    betas = risk.beta(risk.with_benchmark(prices.daily_returns(closes), market))
    dividends = v.actions().where("amount is not null")
    out = Q.computed_metrics(closes, v.fundamentals(), dividends, betas)
    return out.select("ticker", "date", *(r6(c) for c in out.columns[2:]))


# --- checks, logs, storage ------------------------------------------------------------------------------
@query(
    with_views(
        "trades",
        body="""SELECT ticker, count(*) AS n_rows FROM trades
WHERE ticker NOT IN (SELECT 'S' || s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY ticker""",
    )
)
def fk_violations(v: Views) -> DataFrame:
    """Traded tickers that the list of companies in good standing does not know."""
    listed = v._table("supplier").where("s_acctbal > 0").select(F.concat(F.lit("S"), "s_suppkey").alias("listed"))
    return governance.fk_violations(v.trades(), "ticker", listed, "listed")


@query(
    with_views(
        "qlog",
        body="""SELECT generation_method, count(*) AS n_rows FROM qlog
WHERE generation_method NOT IN ('click', 'view') GROUP BY 1""",
    )
)
def enum_violations(v: Views) -> DataFrame:
    return governance.enum_violations(v.query_logs(), "generation_method", ("click", "view"))


@query(
    with_views(
        "qlog",
        body="""SELECT generation_method, count(*) AS n_queries, round(avg(success::INT), 6) AS success_rate,
  round(avg(processing_time_ms), 6) AS avg_ms, max(processing_time_ms) AS max_ms, sum(result_count)::BIGINT AS results,
  quantile_disc(processing_time_ms, 0.5) AS p50, quantile_disc(processing_time_ms, 0.95) AS p95
FROM qlog GROUP BY generation_method""",
    )
)
def query_log_stats(v: Views) -> DataFrame:
    stats = governance.query_log_stats(v.query_logs())
    return stats.withColumns({"success_rate": F.round("success_rate", 6), "avg_ms": F.round("avg_ms", 6)})


@query(
    with_views(
        "px",
        "picked",
        body="""SELECT p.ticker, p.date, p.close::DOUBLE AS close FROM px p JOIN picked k ON p.ticker = k.ticker
WHERE k.index_name = 'ASIA' AND p.date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'""",
    )
)
def sharded_prices(v: Views) -> DataFrame:
    """Prices written by shard; one index's history read from its shards only."""
    sector = F.col("sector")
    shards = v.shares().select(
        "ticker", F.when(sector.isin("AFRICA", "ASIA"), F.lower(sector)).otherwise("misc").alias("shard_id")
    )
    path = scratch_path(v.spark, "sharded_prices")
    governance.write_sharded(v.prices().select("ticker", "date", "close"), shards, path)
    wanted = picked(v).where("index_name = 'ASIA'").select("ticker")
    table = governance.read_sharded(
        v.spark, path, "ticker string, date date, close decimal(12,4)", governance.shards_of(shards, wanted)
    )
    year = table.where(F.col("date").between(F.lit("1998-01-01").cast("date"), F.lit("1998-12-31").cast("date")))
    return year.join(wanted, "ticker", "left_semi").select(
        "ticker", "date", F.col("close").cast("double").alias("close")
    )
