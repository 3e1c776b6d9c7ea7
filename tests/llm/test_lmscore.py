"""Cross-entropy difference against plain counting."""

import math
from collections import Counter

import pytest

from marketpulse.llm import lmscore, queries


def split(text):
    out = []
    for word in (text or "").encode().split():
        out += [word] if len(word) <= lmscore.LONGEST else [c.encode() for c in word.decode()]
    return out


def expected(rows, wanted):
    singles, pairs = [Counter(), Counter()], [Counter(), Counter()]  # target, background
    lines = []
    for key, text in rows:
        found = split(text)
        events = list(zip(["$", *found], [*found, "$"])) if found else []
        lines.append((key, len(found), events))
        for model in (0, 1) if key in wanted and key is not None else (1,):
            singles[model].update(w for _, w in events)
            pairs[model].update(events)
    vocabulary = len(singles[1])

    def loss(model, events):
        total, out = sum(singles[model].values()), 0.0
        for before, word in events:
            p = (singles[model][word] + lmscore.PRIOR / (vocabulary + 1)) / (total + lmscore.PRIOR)
            out -= math.log((pairs[model][before, word] + lmscore.PRIOR * p) / (singles[model][before] + lmscore.PRIOR))
        return out / len(events)

    return [(key, n, *((loss(0, e), loss(1, e), loss(0, e) - loss(1, e)) if e else (None,) * 3)) for key, n, e in lines]


def check(found, wanted):
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3] or 0))
    assert len(found) == len(wanted)
    for a, b in zip(order(found), order(wanted)):
        assert a[:2] == b[:2] and all(x == y or x == pytest.approx(y, abs=1e-9) for x, y in zip(a[2:], b[2:])), (a, b)


def test_query_against_plain_counting(spark, sf_dir, monkeypatch):
    """Small chunks and ranges, so that n-grams meet from many of them."""
    monkeypatch.setattr(lmscore, "CHUNK_BYTES", 40_000)
    monkeypatch.setattr(lmscore, "RANGE_BYTES", 100_000)
    rows = [tuple(r) for r in queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    good = {r[0] for r in queries.table(spark, sf_dir, "labels").where(lmscore.good_documents()).select("doc_id").collect()}
    check([tuple(r) for r in queries.op7_cross_entropy_difference(spark, sf_dir).collect()], expected(rows, good))


def test_scripts_nulls_repeats_and_long_runs(spark):
    rows = [(1, "Привет мир"), (2, "Добрый вечер"), (3, "今天天气很好我们去公园散步吧"), (4, "他昨天买了一本关于历史的书"), (5, None), (6, ""), (7, " \n\t"),
            (None, "no id"), (None, "no id"), (8, "same"), (8, "same"), (9, "x" * 5000), (10, "word " * 3000), (11, "мир мир Привет")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS chunk", "2 AS n", "'t' AS wanted", "3 AS target")
    wanted = spark.createDataFrame([(1,), (1,), (3,), (None,)], "doc_id long")
    found = [tuple(r) for r in lmscore.cross_entropy_difference(docs, wanted).collect()]
    check(found, expected(rows, {1, 3}))
    by = {r[0]: r[4] for r in found}
    assert by[1] < by[11] < by[2] and by[3] < by[4] and len({by[i] for i in (1, 2, 3, 4)}) == 4
    none = [tuple(r) for r in lmscore.cross_entropy_difference(docs, wanted.limit(0)).collect()]
    check(none, expected(rows, set()))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lmscore.cross_entropy_difference(docs, docs.select("doc_id")).count() == 0
