"""Headline scoring with exchangeable scorers, and the score-the-backlog job."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import compound, label_columns
from ..schemas import ARTICLE_KEY, LABELS, MODEL_OUT
from .articles import get_articles
from .upsert import upsert_articles

DEFAULT_BATCH = 8

# A scorer returns, per headline, its labels with scores - the shape model pipelines use.
Scorer = Callable[[list[str]], list[list[dict]]]

# The shipped word lists (fixed values, English finance headlines).
POSITIVE_WORDS = (
    "advance", "beat", "beats", "boost", "bullish", "gain", "gains", "good", "growth", "high",
    "improve", "jump", "profit", "profits", "rally", "record", "rise", "rises", "soar", "strong",
    "surge", "up", "upgrade", "win",
)
NEGATIVE_WORDS = (
    "bearish", "crash", "cut", "cuts", "decline", "default", "down", "downgrade", "drop", "drops",
    "error", "fall", "falls", "fraud", "loss", "losses", "low", "miss", "misses", "plunge",
    "probe", "slump", "weak",
)
NEUTRAL_WORDS = ("announces", "holds", "meeting", "reports", "results", "schedule", "steady", "update")


def word_pattern(words: Sequence[str]) -> str:
    """Any of the words, where a word is an unbroken run of the letters a-z."""
    return "(?<![a-z])(?:" + "|".join(words) + ")(?![a-z])"


def lexicon_scores(
    text: Column,
    positive: Sequence[str] = POSITIVE_WORDS,
    negative: Sequence[str] = NEGATIVE_WORDS,
    neutral: Sequence[str] = NEUTRAL_WORDS,
) -> dict[str, Column]:
    """Share of hits per word list over the whole text, each list starting from one.

    Stays on the row: no word is shuffled, whatever the text's length.
    """

    def hits(words: Sequence[str]) -> Column:
        return F.regexp_count(F.lower(text), F.lit(word_pattern(words)))

    counts = {
        "Positive": hits(positive) + 1,
        "Negative": hits(negative) + 1,
        "Neutral": hits(neutral) + 1,
    }
    total = counts["Positive"] + counts["Negative"] + counts["Neutral"]
    return {label: (count.cast("double") / total).cast("float") for label, count in counts.items()}


def score_with_lexicon(df: DataFrame, text: str = "headline") -> DataFrame:
    """Adds Positive, Negative, Neutral and compound, with built-in functions only."""
    scored = df.withColumns(lexicon_scores(F.col(text)))
    return scored.withColumn("compound", compound(F.col("Positive"), F.col("Negative")))


def lexicon_scorer() -> Scorer:
    """The same scorer as a plain function, for score_with_model."""
    lists = dict(zip(LABELS, (POSITIVE_WORDS, NEGATIVE_WORDS, NEUTRAL_WORDS)))
    patterns = {label: re.compile(word_pattern(words)) for label, words in lists.items()}

    def score(headlines: list[str]) -> list[list[dict]]:
        out = []
        for headline in headlines:
            counts = {k: len(p.findall(headline.lower())) + 1 for k, p in patterns.items()}
            total = sum(counts.values())
            out.append([{"label": k, "score": n / total} for k, n in counts.items()])
        return out

    return score


def score_with_model(
    df: DataFrame,
    make_scorer: Callable[[], Scorer],
    text: str = "headline",
    batch_size: int = DEFAULT_BATCH,
) -> DataFrame:
    """Adds Positive, Negative, Neutral and compound from a model.

    ``make_scorer`` runs once per task (it loads the model); headlines go through it in
    batches. Scores stay on the row they belong to. A batch whose scoring fails, or comes
    back with another length, is left unscored (null) and so returns to the backlog.
    """

    @F.pandas_udf(MODEL_OUT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = make_scorer()
        for series in batches:
            texts, outputs = series.tolist(), []
            for start in range(0, len(texts), batch_size):
                chunk = texts[start : start + batch_size]
                try:
                    result = list(scorer(chunk))
                except Exception:
                    result = []
                outputs.extend(result if len(result) == len(chunk) else [None] * len(chunk))
            yield pd.Series(outputs, dtype="object")

    raw = df.withColumn("__output", run(F.col(text)))
    scored = raw.select(*df.columns, "__output", *label_columns(F.col("__output")))
    absent = F.col("__output").isNull()
    nulled = {c: F.when(~absent, F.col(c)) for c in (*LABELS, "compound")}
    return scored.withColumns(nulled).drop("__output")


def scored_backlog(
    store: DataFrame, score: Callable[[DataFrame], DataFrame], n: int | None = 200
) -> DataFrame:
    """The latest n unscored articles (None: all) that the scorer could score."""
    backlog = get_articles(store, n=n, latest=True, has_sentiment=False)
    scored = score(backlog.select(*ARTICLE_KEY, "date_posted", "source", "article_link"))
    return scored.where(F.col("compound").isNotNull())


def score_backlog(
    store: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    as_of: Column,
    n: int | None = 200,
) -> DataFrame:
    """Next article snapshot after scoring the backlog."""
    return upsert_articles(store, scored_backlog(store, score, n), as_of, has_sentiment=True)


def compare_scorers(left: DataFrame, right: DataFrame, suffixes: tuple[str, str]) -> DataFrame:
    """Two scorers' outputs side by side per article key, columns told apart by suffix."""
    names = (*LABELS, "compound")

    def side(df: DataFrame, suffix: str) -> DataFrame:
        return df.select(*ARTICLE_KEY, *(F.col(c).alias(f"{c}{suffix}") for c in names))

    return side(left, suffixes[0]).join(side(right, suffixes[1]), list(ARTICLE_KEY), "inner")
