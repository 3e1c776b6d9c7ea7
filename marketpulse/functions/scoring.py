"""Sentiment and sarcasm scores as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpulse.constants import (
    NEGATIVE_WORDS,
    POSITIVE_WORDS,
    SARCASM_CUES,
    SARCASM_DEFAULT,
    SARCASM_PUNCTUATION,
    SARCASM_PUNCTUATION_FLOOR,
)
from marketpulse.functions.text import strip


def is_blank(text: Column) -> Column:
    return strip(F.coalesce(text, F.lit(""))) == ""


def _distinct_hits(lowered: Column, words: tuple[str, ...]) -> Column:
    return reduce(add, [F.contains(lowered, F.lit(word)).cast("int") for word in words])


def positive_hits(lowered: Column) -> Column:
    """How many positive words occur in the lower-cased text, each counted once."""
    return _distinct_hits(lowered, POSITIVE_WORDS)


def negative_hits(lowered: Column) -> Column:
    """How many negative words occur in the lower-cased text, each counted once."""
    return _distinct_hits(lowered, NEGATIVE_WORDS)


def sarcasm(text: Column, lowered: Column) -> Column:
    """Weight of the strongest cue present; a floor for loud punctuation; a default where there is none."""
    loud = reduce(lambda a, b: a | b, [F.contains(text, F.lit(mark)) for mark in SARCASM_PUNCTUATION])
    cues = [(F.contains(lowered, F.lit(cue)), weight) for cue, weight in SARCASM_CUES.items()]
    cues.append((loud, SARCASM_PUNCTUATION_FLOOR))
    # Strongest first, so evaluation stops at the first hit.
    cues.sort(key=lambda cue: -cue[1])
    strongest = F.when(cues[0][0], cues[0][1])
    for present, weight in cues[1:]:
        strongest = strongest.when(present, weight)
    return strongest.otherwise(F.lit(SARCASM_DEFAULT))


def _score(polarity: Column, subjectivity: Column, sarcasm_prob: Column, confidence: Column, model: str) -> Column:
    return F.struct(
        polarity.cast("double").alias("polarity"),
        subjectivity.cast("double").alias("subjectivity"),
        sarcasm_prob.cast("double").alias("sarcasm_prob"),
        confidence.cast("double").alias("confidence"),
        F.lit(model).alias("model"),
    )


def empty_score() -> Column:
    zero = F.lit(0.0)
    return _score(zero, zero, zero, zero, "empty")


def heuristic_score(positive: Column, negative: Column, sarcasm_prob: Column) -> Column:
    """Score from the two hit counts."""
    total = positive + negative
    return _score(
        polarity=F.when(total == 0, F.lit(0.0)).otherwise(F.try_divide((positive - negative).cast("double"), total)),
        subjectivity=F.when(total == 0, F.lit(0.2)).otherwise(F.least(F.lit(1.0), total / 3)),
        sarcasm_prob=sarcasm_prob,
        confidence=F.when(total == 0, F.lit(0.3)).otherwise(F.least(F.lit(0.7), total / 5)),
        model="heuristic",
    )


def score_from_logits(negative: Column, positive: Column, sarcasm_prob: Column, model: str = "distilbert") -> Column:
    """Score from a two-class model. Null logits give a null score."""
    top = F.greatest(negative, positive)
    neg, pos = F.exp(negative - top), F.exp(positive - top)
    neg_prob, pos_prob = neg / (neg + pos), pos / (neg + pos)
    confidence = F.greatest(neg_prob, pos_prob)
    difference = pos_prob - neg_prob
    # Uncertain predictions are pulled towards neutral.
    polarity = F.when(confidence < 0.6, difference * confidence).otherwise(difference)
    score = _score(
        polarity=F.greatest(F.lit(-1.0), F.least(F.lit(1.0), polarity)),
        subjectivity=F.abs(polarity),
        sarcasm_prob=sarcasm_prob,
        confidence=confidence,
        model=model,
    )
    return F.when(negative.isNotNull() & positive.isNotNull(), score)


def with_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Add what a score needs: `_blank`, `_positive`, `_negative`, `_sarcasm`.

    In two projections on purpose: the optimizer keeps apart what is costly and used more than once, so the text is
    lower-cased once and each word is looked for once.
    """
    lowered = F.col("_lowered")
    return df.withColumn("_lowered", F.lower(text)).withColumns({
        "_blank": is_blank(F.col(text)),
        "_positive": positive_hits(lowered),
        "_negative": negative_hits(lowered),
        "_sarcasm": sarcasm(F.col(text), lowered),
    }).drop("_lowered")


FEATURES = ("_blank", "_positive", "_negative", "_sarcasm")


def score_from_features(model_score: Column | None = None) -> Column:
    """Empty text scores zero; otherwise the model's score if there is one; otherwise the word lists."""
    by_words = heuristic_score(F.col("_positive"), F.col("_negative"), F.col("_sarcasm"))
    scored = by_words if model_score is None else F.coalesce(model_score, by_words)
    return F.when(F.col("_blank"), empty_score()).otherwise(scored)


def score_posts(df: DataFrame, text: str = "text") -> DataFrame:
    """Add `score` by the word lists."""
    return with_features(df, text).withColumn("score", score_from_features()).drop(*FEATURES)


def stored_score(score: Column) -> list[Column]:
    """Score fields as stored: four single-precision numbers and the model name."""
    numbers = ("polarity", "subjectivity", "sarcasm_prob", "confidence")
    return [score[name].cast("float").alias(name) for name in numbers] + [score["model"].alias("model")]
