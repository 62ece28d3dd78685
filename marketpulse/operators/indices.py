"""Index construction: selection, weights, capping, values, membership, turnover."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import top_per_key

BASE_VALUE = 1000


def free_float_mcap(shares: Column, free_float_pct: Column, close: Column) -> Column:
    """Outstanding shares x free-float percentage x close, as an exact decimal."""
    units = (shares * free_float_pct).cast("decimal(15,0)")
    return (units * close.cast("decimal(12,4)") / F.lit(100)).cast("decimal(30,6)")


def select_top(df: DataFrame, by: str, n: int, within: Sequence[str] = ()) -> DataFrame:
    """The n largest by a measure, overall or within groups; equal measures by ticker."""
    order = [F.col(by).desc(), F.col("ticker")]
    if within:
        return top_per_key(df, within, order, n)
    return df.orderBy(*order).limit(n)


def weights(constituents: DataFrame, measure: str | None, index: str = "index_name") -> DataFrame:
    """Each constituent's share of its index; measure None weights all the same.

    Totals are aggregated and joined back, so no index is gathered into one window.
    """
    value = F.lit(1.0) if measure is None else F.col(measure).cast("double")
    totals = constituents.groupBy(index).agg(F.sum(value).alias("__total"))
    return (
        constituents.join(totals, index)
        .withColumn("weight", F.try_divide(value, F.col("__total")))
        .drop("__total")
    )


def capped_weights(
    weighted: DataFrame, cap: float, top_cap: float | None = None, index: str = "index_name"
) -> DataFrame:
    """Weights after a single-name cap with the excess shared out pro rata.

    Closed form, no loop: with names sorted by weight, capping the k largest scales the
    rest by (1 - k*cap) / (their sum); k is the smallest count whose next name then fits.
    With ``top_cap`` the three largest together are limited too, by lowering the cap. When
    even equal weights break the cap, the result is equal weights. ``feasible`` tells whether
    an index of so many names can keep the limits at all: n names at the cap must reach the
    whole, and so must n names at a third of ``top_cap``; three names or fewer are the whole.

    An index is a selected list (a few hundred names), which bounds the window group.
    """
    first = _water_fill(weighted.withColumn("__cap", F.lit(float(cap))), index)
    n = F.col("__n")
    if top_cap is None:
        return _drop_helpers(first.withColumn("feasible", n * cap >= 1 - 1e-12))
    group = Window.partitionBy(index)
    top3 = F.sum(F.when(F.col("__rank") <= 3, F.col("capped_weight"))).over(group)
    lowered = _lower_cap(first.withColumn("__top3", top3), float(top_cap), index)
    # Only the cap differs from the first pass; the ranks and sums are reused.
    within = (n * cap >= 1 - 1e-12) & (n > 3) & (n * (top_cap / 3) >= 1 - 1e-12) if top_cap < 1 else n * cap >= 1 - 1e-12
    return _drop_helpers(_water_fill(lowered.drop("capped_weight"), index).withColumn("feasible", within))


def _drop_helpers(df: DataFrame) -> DataFrame:
    return df.drop(*(c for c in df.columns if c.startswith("__")))


def _water_fill(df: DataFrame, index: str) -> DataFrame:
    group = Window.partitionBy(index)
    if "__rank" not in df.columns:
        ordered = group.orderBy(F.col("weight").desc(), "ticker")
        df = df.withColumns(
            {
                "__rank": F.row_number().over(ordered),
                "__n": F.count(F.lit(1)).over(group),
                # sum of this weight and all smaller ones
                "__tail": F.sum("weight").over(
                    group.orderBy(F.col("weight").asc(), F.col("ticker").desc()).rowsBetween(
                        Window.unboundedPreceding, 0
                    )
                ),
            }
        )
    cap, rank = F.col("__cap"), F.col("__rank")
    # Row r stands for k = r-1 capped names: the rest scales by this, and fits if row r does.
    scale = F.try_divide(1 - (rank - 1) * cap, F.col("__tail"))
    fits = F.col("weight") * scale <= cap + F.lit(1e-12)
    k = F.min(F.when(fits & ((rank - 1) * cap < 1), rank - 1)).over(group)
    df = df.withColumn("__k", F.coalesce(k, F.col("__n")))
    rest = F.max(F.when(rank == F.col("__k") + 1, scale)).over(group)
    feasible = cap * F.col("__n") >= 1
    return df.withColumn("__rest", rest).withColumn(
        "capped_weight",
        F.when(~feasible, 1 / F.col("__n"))
        .when(rank <= F.col("__k"), cap)
        .otherwise(F.col("weight") * F.col("__rest")),
    )


def _lower_cap(df: DataFrame, limit: float, index: str) -> DataFrame:
    """Replace the cap where the three largest exceed the limit.

    The largest feasible uniform cap that brings them to the limit: with all three at the
    cap it is limit/3; with one or two at the cap the others follow from proportionality.
    """
    group = Window.partitionBy(index)
    rank, weight, cap = F.col("__rank"), F.col("weight"), F.col("__cap")

    def at(r: int, column: Column) -> Column:
        return F.max(F.when(rank == r, column)).over(group)

    df = df.withColumns(
        {
            "__w1": at(1, weight),
            "__w2": at(2, weight),
            "__w3": at(3, weight),
            "__s2": at(2, F.col("__tail")),
            "__s3": at(3, F.col("__tail")),
            "__s4": at(4, F.col("__tail")),
        }
    )
    third = F.lit(limit / 3)
    one = (F.col("__w2") + F.col("__w3")) / F.col("__s2")
    two = F.col("__w3") / F.col("__s3")
    c1 = (limit - one) / (1 - one)
    c2 = (limit - two) / (2 - 2 * two)

    def exactly(k: int, c: Column) -> Column:
        """Water-filling at cap c caps exactly k names."""
        tail = {1: F.col("__s2"), 2: F.col("__s3")}[k]
        next_weight = {1: F.col("__w2"), 2: F.col("__w3")}[k]
        before_tail = {1: F.lit(1.0), 2: F.col("__s2")}[k]
        before_weight = {1: F.col("__w1"), 2: F.col("__w2")}[k]
        fits = next_weight * (1 - k * c) / tail <= c + 1e-12
        needed = before_weight * (1 - (k - 1) * c) / before_tail > c
        return (c >= third) & (c <= cap) & fits & needed

    better = F.greatest(
        third, F.when(exactly(1, c1), c1), F.when(exactly(2, c2), c2)
    )
    over = (F.col("__top3") > limit + 1e-12) & (F.col("__n") > 3)
    return df.withColumn("__cap", F.when(over, better).otherwise(cap))


def combined_mcap(series: DataFrame, index: str = "index_name", value: str = "ffmc") -> DataFrame:
    """Sum over constituents of the latest known value, for every day any of them traded.

    Carrying values forward needs no constituent x day grid: each trade contributes its
    change since the ticker's previous one, changes are summed per day (map-side), and the
    running total over days is the combined value. Decimal arithmetic keeps it exact.
    """
    by_ticker = Window.partitionBy(index, "ticker").orderBy("date")
    change = F.col(value) - F.coalesce(F.lag(value).over(by_ticker), F.lit(0).cast("decimal(30,6)"))
    steps = series.withColumns({"__change": change, "__new": F.lag(value).over(by_ticker).isNull()})
    days = steps.groupBy(index, "date").agg(
        F.sum("__change").alias("__change"), F.count_if("__new").alias("__joined")
    )
    so_far = Window.partitionBy(index).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return days.select(
        index,
        "date",
        F.sum("__change").over(so_far).alias("combined"),
        F.sum("__joined").over(so_far).alias("n_live"),
    )


def index_values(combined: DataFrame, base_value: float = BASE_VALUE, index: str = "index_name") -> DataFrame:
    """Combined / combined at base x base value, from the first day all constituents live."""
    group = Window.partitionBy(index)
    full = F.col("n_live") == F.max("n_live").over(group)
    live = combined.withColumn("__full", full).where("__full")
    base = F.min_by("combined", "date").over(group).cast("double")
    value = F.try_divide(F.col("combined").cast("double"), base) * base_value
    return live.withColumn("index_value", value).drop("__full", "n_live")


def on_index_days(values: DataFrame, payments: DataFrame, index: str = "index_name", amount: str = "dividend") -> DataFrame:
    """Payments summed on the first index day on or after theirs; ``pending`` marks those after the last one, under their own date.

    Days and payments of an index are merged into one series, in which each payment looks
    forward to the next day, so no payment meets all days.
    """
    days = values.select(index, "date", F.lit(None).cast("double").alias(amount), F.lit(True).alias("__day"))
    paid = payments.select(index, "date", F.col(amount).cast("double").alias(amount), F.lit(False).alias("__day"))
    ahead = Window.partitionBy(index).orderBy("date").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    moved = days.unionByName(paid).withColumn("__next", F.min(F.when(F.col("__day"), F.col("date"))).over(ahead))
    late = F.col("__next").isNull()
    return moved.where(~F.col("__day")).groupBy(index, F.coalesce("__next", "date").alias("date"), late.alias("pending")).agg(F.sum(amount).alias(amount))


def total_return(values: DataFrame, dividends: DataFrame, index: str = "index_name") -> DataFrame:
    """Values with dividends reinvested on the first index day on or after their own: compounds (V_t + D_t) / V_{t-1}.

    ``dividends`` has the cash paid per index and day, in the same money as ``combined``. What
    is paid up to the base day comes before the index; what is paid after its last day is pending.
    """
    dividends = on_index_days(values, dividends, index).where("not pending").drop("pending")
    days = Window.partitionBy(index).orderBy("date")
    now, paid = F.col("combined").cast("double"), F.coalesce(F.col("dividend").cast("double"), F.lit(0.0))
    growth = F.coalesce(F.try_divide(now + paid, F.lag(now).over(days)), F.lit(1.0))
    first = F.first("index_value").over(days.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    grown = values.join(dividends, [index, "date"], "left").withColumns({"__log": F.ln(growth), "__first": first})
    so_far = days.rowsBetween(Window.unboundedPreceding, 0)
    return grown.withColumn("total_return_value", F.col("__first") * F.exp(F.sum("__log").over(so_far))).drop(
        "__log", "__first", "dividend"
    )


def membership(selected: DataFrame, index_name: str) -> DataFrame:
    """Validity intervals from selections per quarter (named by its last day).

    A selection made on a quarter's data takes effect when the next quarter starts and ends
    when the one after does (never before its data exists); the newest is open-ended.
    """
    newest = selected.agg(F.max("quarter")).scalar()
    return selected.select(
        F.lit(index_name).alias("index_name"),
        "ticker",
        "quarter",
        F.date_add("quarter", 1).alias("effective_date"),
        F.when(F.col("quarter") < newest, F.date_add(F.last_day(F.add_months("quarter", 3)), 1)).alias("end_date"),
    )


def active_on(rows: DataFrame, members: DataFrame, date: str = "date") -> DataFrame:
    """Rows joined to the memberships of their ticker valid on their date.

    Intervals are closed at the start and open at the end; no end means still valid. The
    join is an equi-join on ticker; a ticker has one row per day and one interval per quarter.
    """
    valid = (F.col(date) >= F.col("effective_date")) & (
        F.col("end_date").isNull() | (F.col(date) < F.col("end_date"))
    )
    return rows.join(members, "ticker").where(valid)


def turnover(members: DataFrame, index: str = "index_name") -> DataFrame:
    """Tickers added to and removed from an index at each rebalance date.

    Each interval meets the one that continues it (same ticker, starts where this ends).
    """
    spans = members.select(index, "ticker", "effective_date", "end_date")
    started = spans.select(index, "ticker", F.col("effective_date").alias("rebalance_date"))
    ended = spans.where("end_date is not null").select(index, "ticker", F.col("end_date").alias("rebalance_date"))
    key = [index, "ticker", "rebalance_date"]
    added = started.join(ended, key, "left_anti").withColumn("change", F.lit("added"))
    removed = ended.join(started, key, "left_anti").withColumn("change", F.lit("removed"))
    return added.unionByName(removed)


def impact_cost(book: DataFrame, quantity: Column) -> DataFrame:
    """Cost of buying ``quantity`` at once, against the mid price, per ticker.

    Orders are first summed per price level, so the running quantity runs over the price
    grid, not over orders. ``filled`` tells how much the book could serve.
    """
    levels = book.groupBy("ticker", "side", "price").agg(F.sum("qty").alias("qty"))
    best = levels.groupBy("ticker").agg(
        F.max(F.when(F.col("side") == "bid", F.col("price"))).alias("best_bid"),
        F.min(F.when(F.col("side") == "ask", F.col("price"))).alias("best_ask"),
    )
    cheaper = Window.partitionBy("ticker").orderBy("price").rowsBetween(Window.unboundedPreceding, -1)
    asks = levels.where(F.col("side") == "ask").withColumn(
        "__before", F.coalesce(F.sum("qty").over(cheaper), F.lit(0))
    )
    taken = F.least(F.col("qty"), F.greatest(quantity - F.col("__before"), F.lit(0)))
    fills = (
        asks.withColumn("__taken", taken)
        .groupBy("ticker")
        .agg(
            F.sum("__taken").alias("filled"),
            F.sum(F.col("__taken") * F.col("price")).alias("__paid"),
        )
    )
    mid = (F.col("best_bid") + F.col("best_ask")) / 2
    average = F.try_divide(F.col("__paid").cast("double"), F.col("filled"))
    return best.join(fills, "ticker").select(
        "ticker",
        "filled",
        mid.alias("mid"),
        average.alias("average_price"),
        F.try_divide(average - mid, mid).alias("impact_cost"),
    )
