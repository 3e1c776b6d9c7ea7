"""Hard negatives against brute force; what the index certifies and passes over."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketpulse.llm import hardnegatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int"


def expected(rows, positives=5, negatives=5):
    good = {i: (label, [math.floor(256 * x) for x in v]) for i, v, label in rows
            if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a, (label, v) in good.items():
        if a % 10:
            continue
        score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in good.items() if i != a and len(w) == len(v)}
        best = sorted((-s, i) for i, s in score.items() if good[i][0] == label)[:positives]
        for p, i in ((-p, i) for p, i in best):
            hard = sorted((-s, j) for j, s in score.items() if good[j][0] != label and 80 * p <= 100 * s <= 100 * p)[:negatives]
            out += [(a, i, rank, j, p, -s) for rank, (s, j) in enumerate(hard, 1)]
    return out


def check(spark, rows):
    vectors = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("anchor", "block", "shard", "rank", "positives", "anchor_id")})
    found = [tuple(r) for r in hn.hard_negatives(vectors, F.col("vec_id") % 10 == 0).collect()]
    assert sorted(found) == sorted(expected(rows))
    return found


def clustered(n, dim, groups, seed=3):
    draw = np.random.default_rng(seed)
    centers = draw.normal(size=(groups, dim))
    own = draw.integers(0, groups, n)
    return [(i, (centers[g] + 0.2 * draw.normal(size=dim)).tolist(), int(g) // 2 if draw.random() < 0.8 else int(draw.integers(0, 5))) for i, g in enumerate(own.tolist())]


def test_many_shards_and_blocks(spark, monkeypatch):
    for name, value in (("SHARD_ROWS", 60), ("ANCHOR_ROWS", 7), ("TOGETHER", 8), ("SAMPLE_ROWS", 50), ("CODEWORDS", 6)):
        monkeypatch.setattr(hn, name, value)
    assert check(spark, clustered(300, 9, 8))


def test_nulls_lengths_ties_and_huge_values(spark):
    rows = clustered(60, 4, 4) + [(100 + i, [0.5, 0.5, 0.5, 0.5], i % 2) for i in range(12)]
    rows += [(200, None, 1), (210, [0.1, None, 0.2, 0.3], 1), (220, [float("nan"), 0.0, 0.0, 0.0], 1), (230, [float("inf"), 0.0, 0.0, 0.0], 1),
             (240, [1.0] * 4, None), (None, [1.0] * 4, 1), (250, [], 1), (251, [], 1), (252, [], 2), (260, [0.3], 0), (261, [0.3], 0), (262, [0.28], 1),
             (270, [2.0**20, 1.0, 0.1, 0.2], 7), (271, [2.0**20, 1.0, 0.3, 0.2], 7), (272, [2.0**20 - 1, 1.0, 0.3, 0.2], 8),
             (280, [0.0] * 4, 5), (281, [0.0] * 4, 5), (282, [0.0] * 4, 6), (290, [-1.0] * 4, 9)]
    found = check(spark, rows)
    assert {250, 260, 270, 280} <= {r[0] for r in found}


def test_squares_beyond_a_long_take_no_part_and_repeats_count_once(spark):
    rows = [(10, [1e300, 1.0], 1), (11, [1e300, 1.0], 1), (20, [1.0, 1.0], 1), (21, [1.0, 1.0], 1), (21, [1.0, 1.0], 1), (22, [1.0, 0.9], 2), (22, [1.0, 0.9], 2)]
    found = [tuple(r) for r in hn.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0).collect()]
    assert found == [(20, 21, 1, 22, 256 * 512, 256 * 256 + 256 * 230)]


def test_empty_table(spark):
    check(spark, [])


@pytest.mark.parametrize("dim", [2, 5, 16])
def test_cells_come_in_order_and_bound_their_members(dim):
    draw = np.random.default_rng(dim)
    vectors = np.floor(256 * draw.normal(size=(500, dim)))
    books = hn.fit(vectors[:, : dim // 2], 7), hn.fit(vectors[:, dim // 2 :], 7)
    shard = hn.Shard(np.arange(500), np.zeros(500, np.int64), vectors, books)
    anchor = vectors[0]
    seen, last = [], np.inf
    for high, low, cell in shard.cells(anchor):
        members = shard.vectors[shard.begin[cell] : shard.begin[cell + 1]] @ anchor
        assert high <= last and (members <= high).all() and (members >= low).all()
        seen.append(cell)
        last = high
    assert sorted(seen) == list(range(len(books[0]) * len(books[1])))


def test_clustered_vectors_are_mostly_not_read():
    """With vectors in tight groups the walk ends early, and windows below the anchor's own group pass it over."""
    rows = clustered(4000, 16, 40, seed=9)
    vectors = np.floor(256 * np.array([v for _, v, _ in rows]))
    labels = np.array([label for *_, label in rows])
    shard = hn.Shard(np.arange(4000), labels, vectors, (hn.fit(vectors[:, :8], 40), hn.fit(vectors[:, 8:], 40)))
    anchor = vectors[0]
    ids, score = shard.positives(0, labels[0], anchor, 5, -np.inf)
    read = sum(len(places) for places, _ in shard.visit(anchor, lambda: float(score[-1])))
    assert 5 <= read < 2000
    exact = sorted((-int(v @ anchor), i) for i, v in enumerate(vectors) if i and labels[i] == labels[0])[:5]
    assert [(-s, i) for s, i in exact] == [(int(s), int(i)) for s, i in zip(score, ids)]
