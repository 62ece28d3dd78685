"""Score arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import LABELS


def compound(positive: Column, negative: Column) -> Column:
    """Positive score if it beats the negative one, else the negated negative score.

    A tie is negative. Rounded half-even to 4 places, null counts as 0, kept in [-1, 1].
    """
    signed = F.when(positive > negative, positive).otherwise(-negative)
    rounded = F.coalesce(F.bround(signed.cast("double"), 4), F.lit(0.0))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rounded))


def label_score(outputs: Column, label: str) -> Column:
    """Score of one label in an array<struct<label, score>>; a missing label scores 0.

    When a label repeats, its last entry counts.
    """
    last = F.aggregate(
        outputs,
        F.lit(None).cast("float"),
        lambda kept, item: F.when(item["label"] == label, item["score"]).otherwise(kept),
    )
    return F.coalesce(last, F.lit(0.0).cast("float"))


def label_columns(outputs: Column) -> list[Column]:
    """One column per label plus the compound score, from raw model output."""
    scores = {label: label_score(outputs, label) for label in LABELS}
    return [
        *(column.alias(label) for label, column in scores.items()),
        compound(scores["Positive"], scores["Negative"]).alias("compound"),
    ]


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: sum(value*weight)/sum(weight) over rows whose value is present.

    Rows without a value stay out of the denominator; a zero weight total gives null.
    """
    used = F.when(value.isNotNull(), weight)
    return F.try_divide(F.sum(value * weight), F.sum(used))
