"""Curation, sampling, splits and classifiers on the document messages."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F

from msgpulse.functions.labels import log_loss_of, softmax_pair
from msgpulse.models import classifier as clf
from msgpulse.operators import curation, filters, keyed, sampling
from msgpulse.plans.catalogue import query
from msgpulse.plans.corpus import _PHRASE_SQL, PHRASES
from msgpulse.plans.inputs import DOC_SQL, EV_SQL, LOGITS_SQL, document_messages, event_messages, logit_pairs, table
from msgpulse.session import materialise, scratch_path
from msgpulse.sources import lexicon, sinks

# --- curation -------------------------------------------------------------------------

_WEAK_SQL = f"""WITH {DOC_SQL} SELECT id, sentiment, is_spam FROM (
    SELECT id, sentiment, CASE
        WHEN {_PHRASE_SQL} OR id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1) THEN 1
        WHEN source = 'FIQA' OR id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 1 AND toxic = 0) THEN 0
        END AS is_spam FROM doc WHERE sentiment IS NOT NULL) WHERE is_spam IS NOT NULL"""


def _weak_labels(spark, sf):
    labels = table(spark, sf, "labels").withColumn("id", F.col("doc_id").cast("string"))
    return curation.weak_spam_labels(
        document_messages(spark, sf).drop("is_spam"),
        PHRASES,
        labels.where("toxic = 1"),
        labels.where("quality = 1 AND toxic = 0"),
    )


@query("l1_weak_spam_labels", _WEAK_SQL)
def weak_spam_labels(spark, sf):
    return _weak_labels(spark, sf).select("id", "sentiment", "is_spam")


@query(
    "s12_inline_lists",
    f"""WITH {DOC_SQL} SELECT count(*) AS n, count(*) FILTER (is_spam = 1) AS n_spam, count(*) FILTER (is_spam = 0) AS n_ham
        FROM (SELECT CASE WHEN id IN ('0', '1', '4') THEN 1 WHEN source = 'FIQA' THEN 0 END AS is_spam
              FROM doc WHERE sentiment IS NOT NULL) WHERE is_spam IS NOT NULL""",
)
def inline_lists(spark, sf):
    """The shipped phrases and id lists, the spam list extended by three ids of this corpus."""
    weak = curation.weak_spam_labels(
        document_messages(spark, sf).drop("is_spam"),
        lexicon.SPAM_PHRASES,
        lexicon.relation(spark, [*lexicon.FORCED_SPAM_IDS, "0", "1", "4"], "id"),
        lexicon.forced_ham(spark),
    )
    return weak.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("is_spam") == 1).alias("n_spam"),
        F.count_if(F.col("is_spam") == 0).alias("n_ham"),
    )


# --- sampling and splits ----------------------------------------------------------------

_CHOSEN_SQL = """sized AS (SELECT CAST(floor(count(*) * 0.75) AS BIGINT) AS size FROM {rows} WHERE sentiment = 0),
    chosen AS (SELECT id, sentiment FROM (
        SELECT id, sentiment, row_number() OVER (PARTITION BY sentiment ORDER BY md5('balance' || id), id) AS r
        FROM {rows} WHERE sentiment IN (0, 1)) WHERE r <= (SELECT size FROM sized))"""


@query("m2_balanced_sample", f"WITH {EV_SQL}, {_CHOSEN_SQL.format(rows='ev')} SELECT id, sentiment FROM chosen")
def balanced(spark, sf):
    return sampling.balanced_sample(event_messages(spark, sf)).select("id", "sentiment")


@query(
    "m2_balanced_hams",
    f"""WITH {DOC_SQL}, ham AS (SELECT * FROM doc WHERE is_spam = 0),
        {_CHOSEN_SQL.format(rows='ham')} SELECT id, sentiment FROM chosen""",
)
def balanced_hams(spark, sf):
    return sampling.balanced_sample(filters.hams(document_messages(spark, sf))).select("id", "sentiment")


_UNIT_SQL = "('0x' || substr(md5('split' || {id}), 1, 8))::BIGINT / 4294967296.0"


@query(
    "m3_hash_split",
    f"""WITH u AS (SELECT doc_id, {_UNIT_SQL.format(id='doc_id')} AS u FROM documents)
        SELECT doc_id, CASE WHEN u < 0.75 THEN 'train' WHEN u < 0.9375 THEN 'test' ELSE 'val' END AS part FROM u""",
)
def hash_split(spark, sf):
    return sampling.split_of(table(spark, sf, "documents").select("doc_id"), sampling.SPAM_PARTS, key="doc_id")


@query(
    "m3_remainder_split",
    f"""WITH {EV_SQL}, {_CHOSEN_SQL.format(rows='ev')},
        u AS (SELECT ev.id, chosen.id IS NOT NULL AS train,
              {_UNIT_SQL.replace("'split'", "'balance'").format(id='ev.id')} AS u FROM ev LEFT JOIN chosen ON ev.id = chosen.id)
        SELECT id, CASE WHEN train THEN 'train' WHEN u < 0.75 THEN 'test' ELSE 'val' END AS part FROM u""",
)
def remainder_split(spark, sf):
    """Balanced training rows and the split of everything else, in one marked pass."""
    ham = event_messages(spark, sf).withColumn("is_spam", F.lit(0))
    return curation.sentiment_sets(ham).select("id", "part")


# --- scores -----------------------------------------------------------------------------


@query(
    "a10_log_loss",
    f"""WITH {LOGITS_SQL} SELECT label, round(avg(-ln(CASE WHEN label = 1 THEN p1 ELSE p0 END)), 6) AS log_loss, count(*) AS n
        FROM scored GROUP BY 1""",
)
def log_loss(spark, sf):
    pair = softmax_pair(F.col("l0"), F.col("l1"))
    return (
        logit_pairs(spark, sf)
        .groupBy("label")
        .agg(
            F.round(F.avg(log_loss_of(pair[0], pair[1], F.col("label"))), 6).alias("log_loss"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def _count_sql(word: str) -> str:
    return f"(length(text) - length(replace(text, '{word}', ''))) / {len(word)}"


@query(
    "x4_own_model",
    f"""WITH l AS (SELECT doc_id, 0.01 * {_count_sql('the')} AS l0, 0.01 * {_count_sql('and')} AS l1 FROM documents),
        p AS (SELECT doc_id, exp(l0) / (exp(l0) + exp(l1)) AS p0, exp(l1) / (exp(l0) + exp(l1)) AS p1 FROM l)
        SELECT doc_id, CASE WHEN abs(p0 - p1) < 0.05 THEN -69 WHEN p0 > p1 THEN 0 ELSE 1 END AS sentiment FROM p""",
)
def own_model(spark, sf):
    """A user's model behind the scoring interface: two word counts as logits."""

    def load():
        return lambda texts: pd.DataFrame({"l0": 0.01 * texts.str.count("the"), "l1": 0.01 * texts.str.count("and")})

    documents = table(spark, sf, "documents").select("doc_id", F.col("text").alias("body"))
    return clf.scored_with(documents, load).select("doc_id", "sentiment")


# --- classifiers --------------------------------------------------------------------------
# Weights have no SQL form; what must hold of every result has, and is compared.

_PART_SQL = "CASE WHEN u < 0.75 THEN 'train' WHEN u < 0.9375 THEN 'test' ELSE 'val' END"
_WEAK_PARTS_SQL = f"""weak AS ({_WEAK_SQL}),
    parts AS (SELECT {_PART_SQL} AS part FROM (SELECT {_UNIT_SQL.format(id='id')} AS u FROM weak))"""


def _spam_model(spark, sf):
    weak = sampling.spam_split(_weak_labels(spark, sf))
    return clf.fitted(weak.where("part = 'train'"), "is_spam"), weak


def _sentiment_model(spark, sf):
    """Trained on the balanced part of the labelled documents outside the spam class."""
    ham = materialise(filters.hams(filters.labelled(document_messages(spark, sf))), "hams")
    sets = curation.sentiment_sets(ham)
    return clf.fitted(sets.where("part = 'train'"), "sentiment"), sets


def _learned(losses):
    """Rows of each part, and for the one fitted on whether its loss is below that of a coin."""
    return losses.select("part", "n", ((F.col("part") == "train") & (F.col("log_loss") < math.log(2))).alias("learned"))


@query(
    "l2_spam_classifier",
    f"WITH {_WEAK_PARTS_SQL} SELECT part, count(*) AS n, part = 'train' AS learned FROM parts GROUP BY part",
)
def spam_classifier(spark, sf):
    """Fit on the weak labels; every part's rows and loss."""
    model, weak = _spam_model(spark, sf)
    return _learned(clf.mean_log_loss(weak, model, "is_spam", "part"))


@query(
    "l3_sentiment_classifier",
    f"""WITH {DOC_SQL}, ham AS (SELECT * FROM doc WHERE sentiment IN (0, 1) AND is_spam = 0), {_CHOSEN_SQL.format(rows='ham')},
        u AS (SELECT ham.id, chosen.id IS NOT NULL AS train,
              {_UNIT_SQL.replace("'split'", "'balance'").format(id='ham.id')} AS u FROM ham LEFT JOIN chosen ON ham.id = chosen.id),
        parts AS (SELECT CASE WHEN train THEN 'train' WHEN u < 0.75 THEN 'test' ELSE 'val' END AS part FROM u)
        SELECT part, count(*) AS n, part = 'train' AS learned FROM parts GROUP BY part""",
)
def sentiment_classifier(spark, sf):
    """Fit on the balanced part; every part's rows, and that the part fitted on has been learned."""
    model, sets = _sentiment_model(spark, sf)
    return _learned(clf.mean_log_loss(sets, model, "sentiment", "part"))


@query("l4_batch_scoring", f"WITH {DOC_SQL} SELECT id, true AS has_label FROM doc")
def batch_scoring(spark, sf):
    """Every id once, with one of the three labels."""
    model, _ = _sentiment_model(spark, sf)
    scored = clf.classified(document_messages(spark, sf).select("id", "body"), model)
    return scored.select("id", F.coalesce(F.col("sentiment").isin(1, 0, -69), F.lit(False)).alias("has_label"))


@query("l5_back_fill", f"WITH {DOC_SQL} SELECT id, sentiment AS stored, true AS has_label FROM doc")
def back_fill(spark, sf):
    """Predictions of all unlabelled rows appended to a table and applied; stored labels stay as they are."""
    model, _ = _sentiment_model(spark, sf)
    messages = document_messages(spark, sf)
    path = scratch_path(spark, "predictions")
    sinks.append_predictions(clf.predictions_for(messages, model, "v1"), path)
    filled = keyed.with_predictions(messages, sinks.read_predictions(spark, path))
    predicted = sinks.read_predictions(spark, path).select("id", F.lit(True).alias("predicted"))
    return filled.join(predicted, "id", "left").select(
        "id",
        F.when(F.col("predicted").isNull(), F.col("sentiment")).alias("stored"),
        F.coalesce(F.col("sentiment").isin(1, 0, -69), F.lit(False)).alias("has_label"),
    )


@query("l6_ham_filtered_corpus", f"WITH {DOC_SQL} SELECT id, sentiment, true AS has_flag FROM doc WHERE sentiment IN (0, 1)")
def ham_filtered_corpus(spark, sf):
    """Labelled rows with the spam model's flag, written and read as the next stage does."""
    model, _ = _spam_model(spark, sf)
    flagged = clf.spam_flagged(filters.labelled(document_messages(spark, sf).drop("is_spam")), model)
    found = stored_rows(flagged, "filtered")
    return found.select("id", "sentiment", F.coalesce(F.col("is_spam").isin(0, 1), F.lit(False)).alias("has_flag"))


def stored_rows(rows, label):
    """A whole corpus written and read again, as between two jobs."""
    path = scratch_path(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@query(
    "l7_live_order",
    f"WITH {DOC_SQL} SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_spam_left, CAST(0 AS BIGINT) AS n_changed, CAST(0 AS BIGINT) AS n_open FROM doc",
)
def live_order(spark, sf):
    """Spam out first, then sentiment for what has none. Kept and dropped rows are all there are, no spam
    is left, stored labels are unchanged and none is open."""
    spam, _ = _spam_model(spark, sf)
    sentiment, _ = _sentiment_model(spark, sf)
    messages = document_messages(spark, sf).drop("is_spam").withColumn("stored", F.col("sentiment"))
    live = clf.live_labels(messages, sentiment, spam, drop_spam=True)
    dropped = clf.spam_flagged(messages, spam).where("is_spam = 1").agg(F.count(F.lit(1)).alias("n_dropped"))
    counts = live.agg(
        F.count(F.lit(1)).alias("n_kept"),
        F.count_if(F.col("is_spam") == 1).alias("n_spam_left"),
        F.count_if(F.col("stored") != F.col("sentiment")).alias("n_changed"),
        F.count_if(F.col("sentiment").isNull()).alias("n_open"),
    )
    return (
        counts.withColumn("part", F.lit(1))
        .join(dropped.withColumn("part", F.lit(1)), "part")
        .select((F.col("n_kept") + F.col("n_dropped")).alias("n"), "n_spam_left", "n_changed", "n_open")
    )


@query("k6_saved_model", f"WITH {DOC_SQL} SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_different FROM doc")
def saved_model(spark, sf):
    """Rows whose flag differs before and after the model was stored."""
    path = scratch_path(spark, "model")
    model, _ = _spam_model(spark, sf)
    clf.save(model, path)
    rows = clf.spam_flagged(document_messages(spark, sf).select("id", "body"), model).withColumnRenamed("is_spam", "before")
    again = clf.spam_flagged(rows, clf.load(path))
    return again.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("before").eqNullSafe(F.col("is_spam"))).alias("n_different"))
