"""SimHash fingerprints and their groups against brute force."""

import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketpulse.llm import queries, simhash


def print_of(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    width = min(width, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + width]).encode(), seed=42) for i in range(len(words) - width + 1)]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def expected(rows, width, most):
    prints = [print_of(text, width) for _, text in rows]
    at = [i for i, (key, _) in enumerate(rows) if key is not None]
    group = {i: i for i in at}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in at:
        for j in at:
            if j < i and (rows[i][0] == rows[j][0] or (prints[i] ^ prints[j]).bit_count() <= most):
                group[root(i)] = root(j)
    least = {}
    for i in at:
        least[root(i)] = min(rows[i][0], least.get(root(i), rows[i][0]))
    return [(key, f"{p:016x}", None if key is None else least[root(i)]) for i, ((key, _), p) in enumerate(zip(rows, prints))]


def check(spark, rows, width=3, most=3):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit(c) for c in ("print", "first", "most", "component_id", "piece", "rank", "fingerprint")})
    found = [tuple(r) for r in simhash.near_duplicates(docs, width, most).collect()]
    assert sorted(found, key=str) == sorted(expected(rows, width, most), key=str)


def gray(prints):
    rank = prints.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return prints[np.argsort(rank)]


def closure(prints, most, own=None):
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= most
    if own is not None:
        near[:own, :own] = near[own:, own:] = False
    return simhash.join_groups(np.arange(len(prints)), *np.nonzero(near))


@given(st.lists(st.integers(0, 2**12 - 1), min_size=1, max_size=200, unique=True), st.integers(0, 52), st.integers(0, 4), st.integers(1, 200))
@settings(max_examples=80, deadline=None)
def test_index_finds_all_links(prints, shift, most, cut):
    """Dense bits, with few searches and states at a time: the groups are those of all pairs, within and across blocks."""
    simhash.TOGETHER, simhash.STATES, before = 7, 16, (simhash.TOGETHER, simhash.STATES)
    try:
        prints = gray(np.array(prints, np.uint64) << np.uint64(shift))
        assert (simhash.link_within(prints, np.zeros(len(prints), np.int64), most) == closure(prints, most)).all()
        cells = prints >> np.uint64(shift + 8)
        found = simhash.link_within(prints, cells, most)
        for cell in np.unique(cells):
            at = np.flatnonzero(cells == cell)
            assert (found[at] == at[closure(prints[at], most)]).all()
        if cut < len(prints):
            assert (simhash.link_across(prints[:cut], prints[cut:], most) == closure(prints, most, cut)).all()
    finally:
        simhash.TOGETHER, simhash.STATES = before


def varied(n):
    """Groups of texts with a few words changed, from none to many."""
    draw = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(400)])
    bases = [draw.choice(words, size) for size in (1, 2, 5, 60, 300, 900)]
    rows = []
    for i in range(n):
        base = bases[i % len(bases)].copy()
        for _ in range(int(draw.integers(0, 4))):
            base[draw.integers(0, len(base))] = draw.choice(words)
        rows.append((i, " ".join(base.tolist())))
    return rows


@pytest.mark.parametrize("rows_of_a_block", [simhash.BLOCK_ROWS, 3], ids=["whole cells", "cut cells"])
def test_edges_against_brute_force(spark, monkeypatch, rows_of_a_block):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", rows_of_a_block)
    rows = varied(150) + [(200, None), (201, ""), (202, " \n\t "), (None, "no id here"), (None, "no id here"), (203, "No ID here"), (204, "É é ÀB c"),
                          (205, "long " * 30_000 + "text"), (0, "the same id with another text"), (206, "the same id with another text"),
                          (207, "a\x0bb\x0cc\x1cd\x85e f"), (207, "a\x0bb\x0cc\x1cd\x85e f")]
    check(spark, rows)


def test_empty_table(spark):
    check(spark, [])


def test_query_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    found = [tuple(r) for r in queries.op11_gray_simhash(spark, sf_dir).collect()]
    assert sorted(found) == sorted(expected(rows, 3, 3)) and len({c for _, _, c in found}) < len(found)
