"""Text classifiers on Spark ML: tokens, hashed term weights, logistic regression."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgpulse.functions.labels import log_loss_of, sentiment_of_pair, softmax_pair
from msgpulse.functions.text import tokens_sql
from msgpulse.operators.filters import hams, unlabelled
from msgpulse.session import scratch_path

_TOKENS_SQL = f"""SELECT *, {tokens_sql("coalesce(body, '')")} AS _tokens FROM __THIS__"""
_WORK_COLUMNS = ["_tokens", "_counts", "_weights", "rawPrediction", "probability", "prediction"]


def classifier(label: str, features: int = 1 << 16, max_iter: int = 20, reg: float = 0.01) -> Pipeline:
    """An unfitted text classifier for a 0/1 label column over ``body``.

    The tokenizer is a stage, so a saved model carries it. All statistics Spark ML
    moves to the driver are vectors of ``features`` length, whatever the data size.
    """
    return Pipeline(
        stages=[
            SQLTransformer(statement=_TOKENS_SQL),
            HashingTF(inputCol="_tokens", outputCol="_counts", numFeatures=features),
            IDF(inputCol="_counts", outputCol="_weights"),
            LogisticRegression(featuresCol="_weights", labelCol=label, maxIter=max_iter, regParam=reg),
        ]
    )


def fitted(train: DataFrame, label: str, **settings) -> PipelineModel:
    """Fit on the narrow (body, label) projection; returns the stored form of the model.

    A model fresh from training refers to its training summary and through it to the
    session, which cannot go to the tasks once the session has observed metrics. The
    stored form is parameters only.
    """
    data = train.select("body", F.col(label).cast("double").alias(label)).persist()
    try:
        model = classifier(label, **settings).fit(data)
    finally:
        data.unpersist()
    path = scratch_path(train.sparkSession, "model")
    save(model, path)
    return load(path)


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def probabilities(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """Add ``p0`` and ``p1``, the class probabilities."""
    scored = model.transform(rows).withColumn("_p", vector_to_array("probability"))
    return scored.withColumns({"p0": F.col("_p")[0], "p1": F.col("_p")[1]}).drop("_p", *_WORK_COLUMNS)


def classified(rows: DataFrame, model: PipelineModel, column: str = "sentiment") -> DataFrame:
    """Three-way label of every row as a column; near-ties are uncertain."""
    scored = probabilities(rows, model)
    return scored.withColumn(column, sentiment_of_pair(F.col("p0"), F.col("p1"))).drop("p0", "p1")


def back_filled(messages: DataFrame, model: PipelineModel) -> DataFrame:
    """Label every unlabelled row and keep stored labels, in one pass and without a join."""
    scored = probabilities(messages, model)
    predicted = sentiment_of_pair(F.col("p0"), F.col("p1"))
    return scored.withColumn("sentiment", F.coalesce("sentiment", predicted)).drop("p0", "p1")


def predictions_for(messages: DataFrame, model: PipelineModel, version: str) -> DataFrame:
    """Predicted labels of the unlabelled rows, in the predictions table's form."""
    scored = classified(unlabelled(messages).select("id", "body"), model)
    return scored.select("id", "sentiment", F.lit(version).alias("model_version"))


def spam_flagged(messages: DataFrame, model: PipelineModel) -> DataFrame:
    """Add ``is_spam`` (1 or 0) from a spam model."""
    return (
        probabilities(messages, model)
        .withColumn("is_spam", F.when(F.col("p1") > F.col("p0"), 1).otherwise(0))
        .drop("p0", "p1")
    )


def live_labels(
    messages: DataFrame, sentiment_model: PipelineModel, spam_model: PipelineModel | None = None, drop_spam: bool = False
) -> DataFrame:
    """The live order: optionally flag and drop spam, then classify what is unlabelled."""
    if spam_model is not None:
        messages = spam_flagged(messages, spam_model)
        if drop_spam:
            messages = hams(messages)
    return back_filled(messages, sentiment_model)


def mean_log_loss(rows: DataFrame, model: PipelineModel, label: str, by: str | None = None) -> DataFrame:
    """Exact per-row log loss over the rows, or over each value of ``by``."""
    scored = probabilities(rows, model)
    loss = F.avg(log_loss_of(F.col("p0"), F.col("p1"), F.col(label))).alias("log_loss")
    grouped = scored.groupBy(by) if by else scored.groupBy()
    return grouped.agg(loss, F.count(F.lit(1)).alias("n"))


def scored_with(
    rows: DataFrame, loader: Callable[[], Callable[[pd.Series], pd.DataFrame]], column: str = "sentiment"
) -> DataFrame:
    """Score with a user's own model.

    ``loader`` runs once per Python worker task and returns a function from a batch
    of texts to two logit columns; texts arrive in Arrow batches.
    """

    @F.pandas_udf("struct<l0: double, l1: double>")
    def logits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = loader()
        for texts in batches:
            out = model(texts)
            yield pd.DataFrame({"l0": out.iloc[:, 0].astype(float), "l1": out.iloc[:, 1].astype(float)})

    pair = softmax_pair(F.col("_logits.l0"), F.col("_logits.l1"))
    return (
        rows.withColumn("_logits", logits(F.col("body")))
        .withColumn("_pair", pair)
        .withColumn(column, sentiment_of_pair(F.col("_pair")[0], F.col("_pair")[1]))
        .drop("_logits", "_pair")
    )
