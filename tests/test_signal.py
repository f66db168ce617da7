"""The boosted signal: what it must gain, what it names, when it stops."""

import random

import pytest
from pyspark.sql import functions as F

from crosstide.operators import modelling

NAMES = ["useful", "weak", "noise"]


@pytest.fixture(scope="module")
def table(spark):
    draw = random.Random(11)
    rows = []
    for i in range(1500):
        x = [draw.gauss(0, 1) for _ in NAMES]
        segment = ("train", "train", "train", "valid", "test")[i % 5]
        rows.append((i, i % 30, segment, *x, (1.0 if x[0] > 0 else -1.0) + 0.2 * x[1] + draw.gauss(0, 0.3), draw.gauss(0, 1), 3 * x[0] + 2 * x[1] + x[2]))
    return spark.createDataFrame(rows, "datetime long, instrument long, segment string, useful double, weak double, noise double, label double, luck double, total double").cache()


def test_scores_beat_the_mean_label_on_test(table):
    scores = modelling.boosted_signal(table, NAMES, "label", rounds=15)
    test = table.where("segment = 'test'")
    assert scores.columns == ["datetime", "instrument", "score"] and scores.count() == test.count()
    mean = table.where("segment = 'train'").agg(F.avg("label")).first()[0]
    errors = test.join(scores, ["datetime", "instrument"]).agg(F.avg(F.pow(F.col("score") - F.col("label"), 2)), F.avg(F.pow(mean - F.col("label"), 2))).first()
    assert errors[0] < 0.3 * errors[1]


def test_importances_name_the_useful_feature(table):
    model = modelling.fit_signal(table, NAMES, "label", rounds=15)
    shares = model.importances()
    assert list(shares) == NAMES and abs(sum(shares.values()) - 1) < 1e-9
    assert shares["useful"] > shares["weak"] > 0 and shares["useful"] > 0.5
    assert {"score", "label"} <= set(model.score(table).columns)


def test_noise_stops_early(table):
    assert modelling.fit_signal(table, NAMES, "luck", rounds=25).rounds < 25
    assert modelling.fit_signal(table, NAMES, "total", rounds=6, depth=2).rounds == 6
