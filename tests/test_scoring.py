import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketpulse.constants import NEGATIVE_WORDS, POSITIVE_WORDS, SARCASM_CUES
from marketpulse.functions import scoring as S


def scores(texts, values):
    return [r["score"] for r in S.score_posts(texts(values)).orderBy("i").collect()]


def by_hand(t):
    if not (t or "").strip():
        return 0.0, 0.0, 0.0, 0.0, "empty"
    low = t.lower()
    p, n = sum(w in low for w in POSITIVE_WORDS), sum(w in low for w in NEGATIVE_WORDS)
    cue = max([w for c, w in SARCASM_CUES.items() if c in low] + ([0.5] if "?!" in t or "!!!" in t else []), default=0.05)
    if p + n == 0:
        return 0.0, 0.2, cue, 0.3, "heuristic"
    return (p - n) / (p + n), min(1.0, (p + n) / 3), cue, min(0.7, (p + n) / 5), "heuristic"


SENTENCES = [
    "This stock is bullish", "This stock is excellent and will moon", "Some text", "This is great, bullish, moon, profit",
    "This is terrible, bearish, crash, loss", "yeah right, sure that'll happen", "This is a normal sentence",
    "an UPDATE", "what?!", "no!!!", "buy buy buy", "moon or crash", "/s lol", "\U0001F644", "to the moon", "", "  \t\n ", None,
]


def test_scores_match_counting_by_hand(texts):
    for sentence, score in zip(SENTENCES, scores(texts, SENTENCES)):
        assert tuple(score) == pytest.approx(by_hand(sentence)), sentence


def test_signs_and_sarcasm(texts):
    good, bad, odd, plain = scores(texts, [SENTENCES[3], SENTENCES[4], SENTENCES[5], SENTENCES[6]])
    assert good["polarity"] > 0 > bad["polarity"]
    assert odd["sarcasm_prob"] > 0.5 and plain["sarcasm_prob"] < 0.2


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from([*POSITIVE_WORDS, *NEGATIVE_WORDS, *SARCASM_CUES, "word", "?!", "!!!"]), max_size=8).map(" ".join),
                min_size=20, max_size=40))
def test_ranges(texts, values):
    for value, score in zip(values, scores(texts, values)):
        assert -1 <= score["polarity"] <= 1
        assert 0 <= score["confidence"] <= 1 and 0 <= score["subjectivity"] <= 1 and 0 <= score["sarcasm_prob"] <= 1
        assert tuple(score) == pytest.approx(by_hand(value))


@pytest.mark.parametrize("neg,pos", [(0.0, 0.0), (0.1, 0.2), (-3.0, 4.0), (5.0, -5.0), (800.0, -800.0), (0.0, math.log(1.5) + 1e-9)])
def test_logits(spark, neg, pos):
    score = spark.range(1).select(S.score_from_logits(F.lit(neg), F.lit(pos), F.lit(0.05)).alias("s")).first()["s"]
    top = max(neg, pos)
    n, p = math.exp(neg - top), math.exp(pos - top)
    n, p = n / (n + p), p / (n + p)
    polarity = (p - n) * (max(n, p) if max(n, p) < 0.6 else 1)
    assert score["polarity"] == pytest.approx(polarity)
    assert score["subjectivity"] == pytest.approx(abs(polarity))
    assert score["confidence"] == pytest.approx(max(n, p))


def test_null_logits_give_no_score(spark):
    none = F.lit(None).cast("double")
    assert spark.range(1).select(S.score_from_logits(none, F.lit(1.0), F.lit(0.05)).alias("s")).first()["s"] is None
