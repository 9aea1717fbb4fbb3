"""Sampling, splits, weak labels and classifiers on their contracts."""

import hashlib

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Observation
from pyspark.sql import functions as F

from msgpulse.functions import labels
from msgpulse.models import classifier as clf
from msgpulse.operators import curation, sampling
from msgpulse.sources import lexicon


def corpus(spark, bears, bulls, spam=0):
    rows = [(f"b{i}", 0, 0) for i in range(bears)] + [(f"u{i}", 1, 0) for i in range(bulls)]
    rows += [(f"s{i}", i % 2, 1) for i in range(spam)] + [("n0", None, 0), ("n1", -69, 0)]
    return spark.createDataFrame(rows, "id string, sentiment int, is_spam int")


def by_hand(rows, size, salt="balance"):
    chosen = set()
    for label in (0, 1):
        of_class = [r.id for r in rows if r.sentiment == label]
        chosen |= set(sorted(of_class, key=lambda i: (hashlib.md5(f"{salt}{i}".encode()).hexdigest(), i))[:size])
    return chosen


def test_three_quarters_of_the_bearish_hams(spark):
    hams = corpus(spark, 40, 200, 10).where("is_spam = 0")
    got = sampling.balanced_sample(hams).collect()
    assert sorted(r.sentiment for r in got) == [0] * 30 + [1] * 30
    assert {r.id for r in got} == by_hand(hams.collect(), 30)


@pytest.mark.parametrize("size", [1, 7, 40])
def test_any_size_equals_a_global_ranking(spark, size):
    rows = corpus(spark, 40, 500)
    assert {r.id for r in sampling.balanced_sample(rows, size=size).collect()} == by_hand(rows.collect(), size)


def test_equal_hash_cells_are_ranked_exactly(spark, monkeypatch):
    """With one-digit cells nearly every cell holds many rows, the cut one included."""
    monkeypatch.setattr(sampling, "_CELL_DIGITS", 1)
    rows = corpus(spark, 300, 300)
    assert {r.id for r in sampling.balanced_sample(rows, size=111).collect()} == by_hand(rows.collect(), 111)


def test_too_small_a_class_is_an_error(spark):
    with pytest.raises(Exception, match="smaller than the balanced sample size"):
        sampling.balanced_sample(corpus(spark, 40, 10)).collect()


def test_no_bearish_rows_means_an_empty_sample(spark):
    assert sampling.balanced_sample(corpus(spark, 0, 10)).count() == 0


def test_split_parts_are_disjoint_and_cover(spark):
    rows = spark.range(20000).select(F.col("id").cast("string"))
    shares = {r.part: r.n / 20000 for r in sampling.spam_split(rows).groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert set(shares) == {"train", "test", "val"} and abs(sum(shares.values()) - 1) < 1e-9
    assert abs(shares["train"] - 0.75) < 0.02 and abs(shares["val"] - 0.0625) < 0.01
    assert sampling.split_of(rows, [("all", 1.0)]).where("part = 'all'").count() == 20000


def test_sets_of_the_sentiment_model(spark):
    sets = curation.sentiment_sets(corpus(spark, 40, 200, 10))
    rows = sets.collect()
    assert len({r.id for r in rows}) == len(rows) == 242
    assert sum(r.part == "train" for r in rows) == 60
    assert {r.id for r in rows if r.part == "train"} == by_hand([r for r in rows if r.sentiment in (0, 1)], 30)


def test_weak_labels(spark):
    rows = [
        ("1", "trusted text", 1, "FIQA"),
        ("2", "trusted but trade alerts", 1, "FIQA"),
        ("3", "plain", 1, "StockTwits"),
        ("4", "listed ham", 0, "StockTwits"),
        ("5", "listed both", 0, "StockTwits"),
        ("6", "Trade Alerts", 0, "StockTwits"),
        ("7", "unlabelled trade alerts", None, "StockTwits"),
        ("8", "uncertain, listed ham", -69, "StockTwits"),
    ]
    messages = spark.createDataFrame(rows, "id string, body string, sentiment int, source string")
    got = curation.weak_spam_labels(
        messages, lexicon.SPAM_PHRASES, lexicon.relation(spark, ["5"], "id"), lexicon.relation(spark, ["4", "5", "8"], "id")
    )
    assert {r.id: r.is_spam for r in got.collect()} == {"1": 0, "2": 1, "4": 0, "5": 1}


def test_unknown_flag_and_its_code(spark):
    rows = curation.unknown_spam(spark.createDataFrame([("1",)], "id string"))
    assert rows.first().is_spam is None and curation.spam_code(rows).first().is_spam == -69


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(str(i), f"moon rocket buy {i % 7}" if i % 2 else f"crash dump sell {i % 5}", i % 2) for i in range(200)]
    rows += [("x", None, None), ("y", "", None), ("z", "neither word known", None), ("m", "moon rocket", None)]
    return spark.createDataFrame(rows, "id string, body string, sentiment int").repartition(4)


@pytest.fixture(scope="module")
def model(texts):
    return clf.fitted(texts.where("sentiment IS NOT NULL"), "sentiment", features=1 << 12)


def test_classifier_learns_and_survives_saving(spark, texts, model, tmp_path):
    clf.save(model, str(tmp_path / "m"))
    clf.save(model, str(tmp_path / "m"))
    again = clf.load(str(tmp_path / "m"))
    first, second = (
        {r.id: r.guess for r in clf.classified(texts, m, "guess").collect()} for m in (model, again)
    )
    assert first == second
    truth = {r.id: r.sentiment for r in texts.collect() if r.sentiment is not None}
    assert all(first[i] == s for i, s in truth.items())
    assert clf.classified(texts, model).columns == texts.columns


def test_scoring_works_after_metrics_were_observed(spark, texts):
    seen = Observation()
    texts.observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 204
    fresh = clf.fitted(texts.where("sentiment IS NOT NULL"), "sentiment", features=1 << 8, max_iter=2)
    assert clf.classified(texts, fresh, "guess").count() == 204
    assert len(clf.classified(texts, fresh, "guess").collect()) == 204


def test_probabilities_follow_the_band(texts, model):
    rows = clf.probabilities(texts, model).withColumn("s", labels.sentiment_of_pair(F.col("p0"), F.col("p1"))).collect()
    for r in rows:
        assert abs(r.p0 + r.p1 - 1) < 1e-9
        assert r.s == (-69 if abs(r.p0 - r.p1) < 0.05 else 0 if r.p0 > r.p1 else 1)


def test_back_fill_keeps_stored_labels(texts, model):
    before = {r.id: r.sentiment for r in texts.collect()}
    after = {r.id: r.sentiment for r in clf.back_filled(texts, model).collect()}
    assert all(after[i] == s for i, s in before.items() if s is not None)
    assert after["m"] == 1 and set(after.values()) <= {0, 1, -69}
    predicted = clf.predictions_for(texts, model, "v7").collect()
    assert {r.id for r in predicted} == {"x", "y", "z", "m"} and {r.model_version for r in predicted} == {"v7"}


def test_log_loss_is_the_mean_over_rows(texts, model):
    labelled = texts.where("sentiment IS NOT NULL")
    rows = clf.probabilities(labelled, model).toPandas()
    p = rows["p1"].where(rows["sentiment"] == 1, rows["p0"])
    import numpy as np

    got = clf.mean_log_loss(labelled, model, "sentiment").first()
    assert got.n == 200 and abs(got.log_loss - float(-np.log(p).mean())) < 1e-9


def test_live_order_drops_spam_first(texts, model):
    """The sentiment model doubles as spam model: class 1 is dropped."""
    kept = clf.live_labels(texts, model, model, drop_spam=True)
    assert {r.is_spam for r in kept.collect()} == {0}
    assert clf.live_labels(texts, model).count() == texts.count()


def test_own_model_loads_once_per_task(texts):
    def load():
        return lambda bodies: pd.DataFrame({"a": bodies.fillna("").str.count("crash"), "b": bodies.fillna("").str.count("moon")})

    got = {r.id: r.guess for r in clf.scored_with(texts, load, "guess").collect()}
    assert got["1"] == 1 and got["0"] == 0 and got["z"] == -69 and got["x"] == -69


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(-800, 800), st.floats(-800, 800)), min_size=1, max_size=40))
def test_scores_are_total_and_symmetric(spark, pairs):
    frame = spark.createDataFrame(pairs, "a double, b double")
    p, q = labels.softmax_pair(F.col("a"), F.col("b")), labels.softmax_pair(F.col("b"), F.col("a"))
    rows = frame.select(labels.sentiment_of_pair(p[0], p[1]).alias("s"), labels.sentiment_of_pair(q[0], q[1]).alias("t")).collect()
    for r in rows:
        assert (r.s, r.t) in {(1, 0), (0, 1), (-69, -69)}
