from __future__ import annotations

from pyspark.sql import functions as F

from marketpulse.functions.scores import compound, label_columns
from marketpulse.operators import scoring
from marketpulse.schemas import MODEL_OUT


def test_compound(spark):
    cases = [(0.5, 0.1, 0.5), (0.2, 0.7, -0.7), (0.4, 0.4, -0.4), (None, 0.3, -0.3), (0.9, None, 0.0), (1.5, 0.0, 1.0)]
    df = spark.createDataFrame(cases, "p double, n double, want double")
    for row in df.select("want", compound(F.col("p"), F.col("n")).alias("got")).collect():
        assert row.got == row.want


def test_labels_to_columns(spark):
    df = spark.createDataFrame(
        [([("Negative", 0.25), ("Neutral", 0.75)],), ([("Positive", 0.1), ("Positive", 0.5)],), ([],)],
        f"out {MODEL_OUT}",
    )
    got = [tuple(r) for r in df.select(*label_columns(F.col("out"))).collect()]
    assert got == [(0.0, 0.25, 0.75, -0.25), (0.5, 0.0, 0.0, 0.5), (0.0, 0.0, 0.0, 0.0)]


TEXTS = [
    "Profits surge to record high",
    "Shares plunge on fraud probe; losses up",
    "Board meeting schedule",
    "upbeat downtown highs",
    "up2up éup ÉUP up",
    "",
]


def test_word_lists_and_model_interface_agree(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, headline string")
    names = ("Positive", "Negative", "Neutral", "compound")
    built_in = scoring.score_with_lexicon(df).orderBy("i").select(*names).collect()
    model = scoring.score_with_model(df, scoring.lexicon_scorer, batch_size=2).orderBy("i").select(*names).collect()
    assert built_in == model
    assert built_in[0].Positive == 5 / 7 or abs(built_in[0].Positive - 5 / 7) < 1e-6


def _fails_on_bad():
    def score(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("model failure")
        if any("short" in t for t in texts):
            return []
        return [[{"label": "Positive", "score": 0.75}, {"label": "Negative", "score": 0.25}] for _ in texts]

    return score


def test_failed_batches_stay_unscored(spark):
    df = spark.createDataFrame([("good",), ("bad",), ("short",), ("fine",)], "headline string").coalesce(1)
    got = {r.headline: r.compound for r in scoring.score_with_model(df, _fails_on_bad, batch_size=1).collect()}
    assert got == {"good": 0.75, "bad": None, "short": None, "fine": 0.75}
