"""The sink of answers and the stored resolver cache."""

import datetime as dt
import json

import pytest
from test_report import NOW, ask, collected, trends  # noqa: F401

from marketpulse.operators import aggregate as A
from marketpulse.plans.report import NO_POSTS, NO_VALID_POSTS, report_json, sentiment_report
from marketpulse.store import answers, cache

SCHEMA = "query string, window string, body string"


def bodies(spark, path):
    return {(r["run"], r["query"]): json.loads(r["body"]) for r in answers.read_answers(spark, path, SCHEMA).collect()}


def test_whole_answers(spark, tmp_path, collected, trends):  # noqa: F811
    """An answer, an end without posts, one without valid posts, and a dry run, every field by value."""
    path = str(tmp_path)
    cleaned = A.clean(collected)
    stored = A.scored(cleaned.filter("outcome = 'processed'"))
    live = sentiment_report(ask(spark, ("AAPL", "24h"), ("NVDA", "7d"), ("TSLA", "4h")), cleaned, stored, trends, NOW)
    answers.write_answers(report_json(live), path, "live")
    answers.write_answers(report_json(sentiment_report(ask(spark, ("AAPL", "24h")), cleaned, None, trends, NOW, dry_run=True)), path, "dry")
    got = bodies(spark, path)
    instrument = lambda s: {"symbol": s, "cik": None, "isin": None, "figi": None, "company_name": s}
    interest = {"interest_over_time": {"2024-01-29": 20.0}, "related_queries": ["aapl stock", "aapl news"],
                "interest_by_region": {"Maine": 9.0, "Ohio": 5.0}, "fetched_at": "2024-01-31T00:00:00.000Z"}
    passed = {"total_input": 3, "no_symbols": 1, "probable_bots": 1, "processed": 1}
    common = {"symbol": "AAPL", "posts_found": 3, "posts_processed": 1, "sources": {"x": 1, "reddit": 2, "stocktwits": 0},
              "search_interest": interest, "resolved_instrument": instrument("AAPL"), "filter_stats": passed}
    assert got["live", "AAPL"] == common | {"window_since": "2024-01-30T00:00:00", "count": 2, "weighted_sentiment": 1.0}
    assert got["dry", "AAPL"] == common | {"avg_polarity": 0.0, "avg_subjectivity": 0.0, "avg_confidence": 0.0, "total_posts": 1, "dry_run": True}
    nothing = {"x": 0, "reddit": 0, "stocktwits": 0}
    assert got["live", "NVDA"] == {"symbol": "NVDA", "posts_found": 0, "posts_processed": 0, "sources": nothing, "search_interest": None,
                                   "resolved_instrument": instrument("NVDA"), "error": NO_POSTS}
    assert got["live", "TSLA"] == {
        "symbol": "TSLA", "posts_found": 1, "posts_processed": 0, "sources": nothing | {"stocktwits": 1}, "search_interest": None,
        "resolved_instrument": instrument("TSLA"), "error": NO_VALID_POSTS, "filter_stats": {"total_input": 1, "no_symbols": 0, "probable_bots": 1, "processed": 0}}


def test_runs_replace_their_own_answers_only(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    rows = lambda *pairs: spark.createDataFrame([(q, "1h", json.dumps({"n": n})) for q, n in pairs], SCHEMA)
    answers.write_answers(rows(("A", 1), ("B", 1)), path, "one")
    answers.write_answers(rows(("A", 2)), path, "two")
    answers.write_answers(rows(("C", 3)), path, "one")
    wanted = {("one", "C"): {"n": 3}, ("two", "A"): {"n": 2}}
    assert bodies(spark, path) == wanted
    with monkeypatch.context() as broken:
        broken.setattr(answers, "_commits", lambda *a: 1 / 0)  # killed after staging, before the commit
        with pytest.raises(ZeroDivisionError):
            answers.write_answers(rows(("D", 4)), path, "two")
    assert bodies(spark, path) == wanted
    answers.write_answers(rows(("D", 5)), path, "two")
    answers.write_answers(rows(("D", 6)), path, "two")
    assert bodies(spark, path) == {("one", "C"): {"n": 3}, ("two", "D"): {"n": 6}}
    assert len(list((tmp_path / "answers" / "run=two").iterdir())) == 2
    with pytest.raises(ValueError):
        answers.write_answers(rows(("D", 5)), path, "a_b")
    assert answers.read_answers(spark, str(tmp_path / "none"), SCHEMA).count() == 0


def test_misses_are_remembered_and_expire(spark, tmp_path):
    path = str(tmp_path / "cache")
    asked = spark.createDataFrame([("microsoft",), ("Microsoft",), ("$tsla",)], "query string")
    hits = lambda day: sorted((r["query"], r["instrument"]["symbol"], r["cache_hit"]) for r in cache.resolve_and_remember(asked, path, NOW + dt.timedelta(days=day)).collect())
    missed = [("$tsla", "TSLA", False), ("Microsoft", "MSFT", False), ("microsoft", "MSFT", False)]
    found = [(q, s, True) for q, s, _ in missed]
    assert hits(0) == missed and hits(1) == found and hits(6) == found
    assert hits(7) == missed  # seven days old is expired
    assert hits(8) == found and cache.read_cache(spark, path).count() == 2
