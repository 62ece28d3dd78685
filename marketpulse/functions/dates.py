"""Date text, parsed with column expressions in a few projection steps.

Each parser adds ``<out>`` and ``<out>_status``: 'ok' with the formatted timestamp, 'empty'
with '' (the article is kept without a date) or 'reject' with null (the whole article is
dropped). "Now" is always an ``as_of`` column, the scrape time.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip

STORE_FORMAT = "yyyy-MM-dd HH:mm:ss"
DEFAULT_REF_YEAR = 2025

# Unit prefix -> (unit of the step, largest count that can still land in years 1..9999).
# The order decides which prefix is tried first (fixed values).
UNITS = (
    ("minute", "MINUTE", 2_000_000_000),
    ("hour", "HOUR", 100_000_000),
    ("day", "DAY", 4_000_000),
    ("week", "WEEK", 600_000),
    ("month", "MONTH", 130_000),
    ("year", "YEAR", 11_000),
)

# strptime directive -> Spark datetime pattern (fixed values).
DIRECTIVES = {
    "%d": "d",
    "%b": "MMM",
    "%B": "MMMM",
    "%m": "M",
    "%y": "yy",
    "%Y": "yyyy",
    "%I": "h",
    "%H": "H",
    "%M": "m",
    "%S": "s",
    "%p": "a",
}
# Text each directive accepts; guards against the looser digit counts of the JVM parser.
SHAPES = {
    "%d": r"\d{1,2}",
    "%b": "[A-Za-z]{3}",
    "%B": "[A-Za-z]+",
    "%m": r"\d{1,2}",
    "%y": r"\d{2}",
    "%Y": r"\d{4}",
    "%I": r"\d{1,2}",
    "%H": r"\d{1,2}",
    "%M": r"\d{1,2}",
    "%S": r"\d{1,2}",
    "%p": "[AaPp][Mm]",
}


def store_text(moment: Column) -> Column:
    """The text form article dates are stored in."""
    return F.date_format(moment, STORE_FORMAT)


def _with_outcome(df: DataFrame, moment: Column, status: Column, out: str) -> DataFrame:
    """The status and value columns."""
    value = F.when(F.col(f"{out}_status") == "ok", store_text(moment)).when(F.col(f"{out}_status") == "empty", "")
    return df.withColumn(f"{out}_status", status).withColumn(out, value)


def with_relative_date(df: DataFrame, text: str, as_of: str, out: str) -> DataFrame:
    """'N unit ago' counted back from as_of; month and year steps clamp to month end."""
    words, first, unit, count, moment = (f"__{out}_{step}" for step in ("words", "first", "unit", "count", "moment"))
    prefixes = "|".join([*(prefix for prefix, *_ in UNITS), "yesterday", "today"])
    digits = F.when(F.col(first).rlike(r"^[+-]?\d+(_\d+)*$"), F.replace(first, F.lit("_"), F.lit("")))

    back = F
    for prefix, part, limit in UNITS:
        back = back.when(
            (F.col(unit) == prefix) & F.col(count).between(-limit, limit),
            F.timestamp_add(part, -F.col(count).cast("int"), F.col(as_of)),
        )
    back = back.when(F.col(unit) == "yesterday", F.timestamp_add("DAY", F.lit(-1), F.col(as_of)))
    back = back.when(F.col(unit) == "today", F.col(as_of))
    status = (
        F.when(F.col(text).isNull(), "reject")
        .when(~F.size(words).isin(2, 3), "empty")
        .when(F.col(count).isNull(), "reject")
        .when(F.col(unit).isNull(), "empty")
        .when(F.col(moment).isNull(), "reject")
        .otherwise("ok")
    )
    return _with_outcome(
        df.withColumn(words, F.split(strip(F.col(text)), r"(?U)\s+"))
        .withColumns(
            {
                first: F.try_element_at(words, F.lit(1)),
                unit: F.nullif(F.regexp_extract(F.try_element_at(words, F.lit(2)), f"^({prefixes})", 1), F.lit("")),
            }
        )
        .withColumn(count, F.when(F.col(first).isin("a", "last"), F.lit(1)).otherwise(digits.try_cast("bigint")))
        .withColumn(moment, back)
        .withColumn(moment, F.when(F.year(moment).between(1, 9999), F.col(moment))),
        F.col(moment),
        status,
        out,
    ).drop(words, first, unit, count, moment)


def _pieces(fmt: str) -> list[str]:
    return [piece for piece in re.split(r"(%[A-Za-z])", fmt) if piece]


def _jvm_pattern(fmt: str) -> str:
    quoted = (DIRECTIVES.get(p) or re.sub(r"[A-Za-z]+", r"'\g<0>'", p) for p in _pieces(fmt))
    return "".join(quoted)


def _shape(fmt: str) -> str:
    return "^" + "".join(SHAPES.get(p) or re.escape(p) for p in _pieces(fmt)) + "$"


def with_absolute_date(
    df: DataFrame,
    text: str,
    fmt: str | None,
    as_of: str,
    out: str,
    ref_year: int = DEFAULT_REF_YEAR,
) -> DataFrame:
    """Date text in a strptime format.

    With a year in the format, bad input rejects the article. Without one the year is
    ``ref_year``, or the year before when that would not lie before as_of; bad input is
    empty, and so is 29 February (the text is first read in the non-leap year 1900).
    """
    if not fmt:
        return df.withColumns({out: F.lit(""), f"{out}_status": F.lit("empty")})
    pattern = _jvm_pattern(fmt)
    shaped = F.when(F.col(text).rlike(_shape(fmt)), F.col(text))
    moment, this_year = f"__{out}_moment", f"__{out}_this_year"
    if "%Y" in fmt:
        read = F.try_to_timestamp(shaped, F.lit(pattern)).cast("timestamp_ntz")
        return _with_outcome(df.withColumn(moment, read), F.col(moment), F.when(F.col(moment).isNull(), "reject").otherwise("ok"), out).drop(moment)

    # Years differ in leap days only, which the reading in 1900 excludes: the text is read once.
    read = F.try_to_timestamp(F.concat(F.lit("1900 "), shaped), F.lit(f"yyyy {pattern}")).cast("timestamp_ntz")

    def years_after(moment: Column, years: int) -> Column:
        return moment + F.make_interval(years=F.lit(years))

    chosen = F.when(F.col(this_year) < F.col(as_of), F.col(this_year)).otherwise(years_after(F.col(this_year), -1))
    dated = df.withColumn(this_year, years_after(read, ref_year - 1900)).withColumn(moment, F.when(F.col(this_year).isNotNull(), chosen))
    return _with_outcome(dated, F.col(moment), F.when(F.col(moment).isNull(), "empty").otherwise("ok"), out).drop(this_year, moment)


def with_iso_date(df: DataFrame, text: str, out: str) -> DataFrame:
    """ISO-8601 with a zone (Z, +hhmm or +hh:mm): the wall-clock time as written.

    Also adds ``<out>_utc``, the instant in UTC. Bad input rejects.
    """
    shape = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(Z|[+-]\d{2}:?\d{2})$"
    shaped = F.when(F.col(text).rlike(shape), F.col(text))
    wall, instant = f"__{out}_wall", f"__{out}_instant"
    local = F.try_to_timestamp(F.substring(shaped, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    read = df.withColumns(
        {
            instant: F.coalesce(
                F.try_to_timestamp(shaped, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")),
                F.try_to_timestamp(shaped, F.lit("yyyy-MM-dd'T'HH:mm:ssXX")),
            ),
            wall: local.cast("timestamp_ntz"),
        }
    )
    dated = _with_outcome(read, F.col(wall), F.when(F.col(instant).isNull() | F.col(wall).isNull(), "reject").otherwise("ok"), out)
    return dated.withColumn(f"{out}_utc", store_text(F.col(instant))).drop(wall, instant)


def display_time(moment: Column, zone: str = "Asia/Kolkata") -> Column:
    """A UTC timestamp as the dashboard prints it in its own zone."""
    return F.date_format(F.from_utc_timestamp(moment, zone), "dd/MM/yyyy HH:mm:ss")
