"""Quality rules by robust multivariate outliers, in DataFrame functions only.

Every document gets a vector of transformed statistics. Per language and source, mean and
covariance are minimum-covariance-determinant estimates: starting from coordinate-wise
medians and median deviations, each concentration step keeps the share COVERED of the group's
rows with the smallest Mahalanobis distance and estimates from them again. STEPS steps, then
a consistency factor for the part left out. A document is rejected where its squared distance
exceeds CUTOFF, the LEVEL quantile of a chi-square variable with one degree of freedom per
statistic, or by the two base rules (fewer than 20 words; more than 30 % of words in
repeated 8-word windows).

Each statistic's variance gets a floor (the square of what FEATURES lists), so that a
statistic that is constant in a group, such as no symbols at all, rejects nobody for a trace
of it; the floors are so small that each statistic can exceed CUTOFF by itself inside its range
(up to 0.3 for repeats, after the base rule). Groups with fewer than LEAST rows take the estimates of all rows together.

Group statistics are aggregated map-side; a group of a third of all rows is a few numbers
per task. Estimates come back by a join on the group, of which adaptive execution splits a
hot side.

Defined results: null text counts as empty (no words, base rule fails); null lang or source
are groups of their own; equal rows get equal verdicts; no rows give no rows; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialized
from .arrays import let, starts, words

#: Statistic -> floor of its standard deviation.
FEATURES = {"length": 0.6, "symbols": 0.25, "lines": 0.08, "repeats": 0.04}
COVERED = 0.75
STEPS = 3
LEAST = 50
LEVEL = 0.999
#: Its chi-square quantile with four degrees of freedom.
CUTOFF = 18.467
MIN_WORDS = 20
MAX_REPEATED = 30
RUN = 8

#: Mean of the smallest COVERED share of a chi-square variable with four degrees of freedom, over four.
_SHRUNK = 0.594


def text_statistics(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (not blank)."""

    def repeated(runs: Column) -> Column:
        placed = F.sort_array(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twin = lambda p, j: F.coalesce(F.get(p, j)["h"] == F.get(p, j - 1)["h"], F.lit(False)) | F.coalesce(F.get(p, j)["h"] == F.get(p, j + 1)["h"], F.lit(False))
        at = let(placed, lambda p: F.sort_array(F.transform(F.filter(p, lambda _, j: twin(p, j)), lambda e: e["i"])))
        covered = let(at, lambda a: F.aggregate(F.transform(a, lambda x, j: F.least(F.lit(RUN), F.coalesce(F.get(a, j + 1) - x, F.lit(RUN)))), F.lit(0), lambda s, x: s + x))
        return F.when(F.size(F.array_distinct(runs)) == F.size(runs), F.lit(0)).otherwise(covered)

    def of_words(w: Column) -> Column:
        runs = F.transform(starts(F.size(w) - RUN + 1), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(RUN)]))
        return F.struct(F.size(w).alias("n"), F.when(F.size(w) <= RUN, F.lit(0)).otherwise(let(runs, repeated)).alias("repeats"))

    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    counts = F.struct(let(words(text), of_words).alias("w"), let(lines, lambda x: F.struct(F.size(x).alias("all"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("l"))
    return let(
        counts,
        lambda c: F.struct(
            c["w"]["n"].cast("long").alias("n_words"),
            F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            c["l"]["dup"].cast("long").alias("n_dup_lines"),
            c["w"]["repeats"].cast("long").alias("n_repeat_words"),
            c["l"]["all"].cast("long").alias("n_lines"),
        ),
    )


def _vector(df: DataFrame) -> DataFrame:
    """The transformed statistics, named as in FEATURES; no null."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return df.withColumns(
        {
            "length": F.col("word_chars") / n,
            "symbols": F.log1p(100 * F.col("n_symbols") / n),
            "lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
            "repeats": F.col("n_repeat_words") / n,
        }
    )


def _estimates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean m_x, variances and covariances c_x_y of the rows, per key, with floors."""
    names = list(FEATURES)
    aggregates = [F.avg(x).alias(f"m_{x}") for x in names]
    aggregates += [(F.covar_pop(x, y) + (F.lit(FEATURES[x] ** 2) if x == y else F.lit(0.0))).alias(f"c_{x}_{y}") for i, x in enumerate(names) for y in names[: i + 1]]
    return rows.groupBy(*keys).agg(*aggregates, F.count(F.lit(1)).alias("rows"))


def _factored(estimates: DataFrame, scale: float) -> DataFrame:
    """Lower Cholesky factors l_x_y of the covariances times `scale`."""
    names = list(FEATURES)
    for i, x in enumerate(names):
        for j, y in enumerate(names[: i + 1]):
            inner = sum((F.col(f"l_{x}_{z}") * F.col(f"l_{y}_{z}") for z in names[:j]), F.lit(0.0))
            left = F.col(f"c_{x}_{y}") * scale - inner
            estimates = estimates.withColumn(f"l_{x}_{y}", F.sqrt(F.greatest(left, F.lit(1e-9))) if i == j else left / F.col(f"l_{y}_{y}"))
    return estimates.drop(*[c for c in estimates.columns if c.startswith("c_")])


def _distance(df: DataFrame, factors: DataFrame, keys: list[str]) -> DataFrame:
    """`df` with d2, the squared Mahalanobis distance to its group's estimate."""
    names, out = list(FEATURES), df.join(factors, keys, "left")
    for i, x in enumerate(names):
        inner = sum((F.col(f"l_{x}_{z}") * F.col(f"z_{z}") for z in names[:i]), F.lit(0.0))
        out = out.withColumn(f"z_{x}", (F.col(x) - F.col(f"m_{x}") - inner) / F.col(f"l_{x}_{x}"))
    return out.withColumn("d2", sum((F.col(f"z_{x}") * F.col(f"z_{x}") for x in names), F.lit(0.0))).select(*df.columns, "d2")


def _first_factors(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Medians and median deviations as a diagonal estimate."""
    names = list(FEATURES)
    medians = rows.groupBy(*keys).agg(*[F.percentile_approx(x, 0.5, 1000).alias(f"m_{x}") for x in names])
    away = rows.join(medians, keys).groupBy(*keys).agg(
        *[F.first(f"m_{x}").alias(f"m_{x}") for x in names], *[(1.4826 * F.percentile_approx(F.abs(F.col(x) - F.col(f"m_{x}")), 0.5, 1000)).alias(f"s_{x}") for x in names]
    )
    for i, x in enumerate(names):
        for y in names[: i + 1]:
            away = away.withColumn(f"l_{x}_{y}", F.sqrt(F.col(f"s_{x}") ** 2 + FEATURES[x] ** 2) if x == y else F.lit(0.0))
    return away.drop(*[f"s_{x}" for x in names])


def robust_factors(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Minimum-covariance-determinant mean and Cholesky factor per key."""
    factors = materialized(_first_factors(rows, keys), "estimates")
    for step in range(STEPS):
        near = _distance(rows, factors, keys)
        limit = near.groupBy(*keys).agg(F.percentile_approx("d2", COVERED, 1000).alias("limit"))
        core = near.join(limit, keys).where("d2 <= limit")
        last = step == STEPS - 1
        factors = materialized(_factored(_estimates(core, keys), 1 / _SHRUNK if last else 1.0), "estimates")
    return factors


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed, d2, kept: one row per row of `docs`."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    group = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(c) for c in ("lang", "source")]  # "" is null
    stats = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *group, text_statistics(text).alias("s")).select("doc_id", "lang", "source", "s.*")
    stats = _vector(materialized(stats, "statistics"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    stats = stats.withColumn("base_failed", failed)
    stats = stats.withColumn("all", F.length("lang") >= 0)  # true in every row, but a column and no constant
    good = stats.where("not base_failed")
    keys = ["lang", "source"]
    enough = robust_factors(good, keys).where(F.col("rows") >= LEAST).drop("rows")
    overall = robust_factors(good, ["all"]).drop("rows")
    own = _distance(stats, enough, keys).withColumnRenamed("d2", "own")
    both = _distance(own, overall, ["all"])
    d2 = F.coalesce("own", "d2")
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return both.select(*base, d2.alias("d2"), (~F.col("base_failed") & (F.coalesce(d2, F.lit(0.0)) <= CUTOFF)).alias("kept"))
