"""Column functions for sentiment labels and classifier scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from msgpulse.schema import BEARISH, BULLISH, UNCERTAIN

# Half-width of the "uncertain" band, the same for score pairs and score means.
UNCERTAIN_BAND = 0.05


def decode_label(basic: Column) -> Column:
    """Feed label text to code; anything else is unlabelled (NULL)."""
    return F.when(basic == "Bullish", F.lit(BULLISH)).when(basic == "Bearish", F.lit(BEARISH))


def decode_label_strict(entities: Column) -> Column:
    """Compatibility decoding over a Variant ``entities`` object.

    Here only an explicit JSON null under ``sentiment`` is unlabelled; a missing
    key or an unknown label counts as bearish.
    """
    is_null = F.coalesce(F.is_variant_null(F.try_variant_get(entities, "$.sentiment", "variant")), F.lit(False))
    basic = F.try_variant_get(entities, "$.sentiment.basic", "string")
    return (
        F.when(is_null, F.lit(None).cast("int"))
        .when(basic == "Bullish", F.lit(BULLISH))
        .otherwise(F.lit(BEARISH))
    )


def sentinel_to_null(code: Column) -> Column:
    return F.nullif(code, F.lit(UNCERTAIN))


def null_to_sentinel(code: Column) -> Column:
    return F.coalesce(code, F.lit(UNCERTAIN))


def remap_legacy(code: Column) -> Column:
    """Older corpora write bearish as -1."""
    return F.when(code == -1, F.lit(BEARISH)).otherwise(code)


def mean_score(scores: Column) -> Column:
    """Mean of an array of numeric values; NULL when the array is empty."""
    total = F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return F.when(F.size(scores) > 0, total / F.size(scores))


def sentiment_of_mean(mean: Column) -> Column:
    """Three-way label of a mean score; the upper bound itself is bullish."""
    return (
        F.when(F.abs(mean) < UNCERTAIN_BAND, F.lit(UNCERTAIN))
        .when(mean >= UNCERTAIN_BAND, F.lit(BULLISH))
        .when(mean.isNotNull(), F.lit(BEARISH))
    )


def softmax_pair(first: Column, second: Column) -> Column:
    """Probabilities of two logits, shifted by the maximum so large logits stay finite."""
    top = F.greatest(first, second)
    e0, e1 = F.exp(first - top), F.exp(second - top)
    return F.array(e0 / (e0 + e1), e1 / (e0 + e1))


def sentiment_of_pair(p0: Column, p1: Column) -> Column:
    """(bearish, bullish) probabilities to a label; near-ties are uncertain."""
    return (
        F.when(F.abs(p0 - p1) < UNCERTAIN_BAND, F.lit(UNCERTAIN))
        .when(p0 > p1, F.lit(BEARISH))
        .otherwise(F.lit(BULLISH))
    )


def log_loss_of(p0: Column, p1: Column, label: Column) -> Column:
    """Negative log probability of the true class."""
    return -F.ln(F.when(label == 1, p1).otherwise(p0))
