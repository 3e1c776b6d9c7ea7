"""The Merkle manifest against plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from marketpulse.llm import manifest, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def path(tree, i):
    out = []
    for level in tree[:-1]:
        first = i - i % 3
        out.append(("".join(level[first:i]), "".join(level[i + 1 : first + 3])))
        i //= 3
    return out


def expected(rows):
    by = {}
    for row in rows:
        by.setdefault(row[1], []).append(row)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: levels([leaf(r) for r in by[s]]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    out = []
    for place, s in enumerate(sources):
        for i, row in enumerate(by[s]):
            steps = path(trees[s], i) + path(top, place)
            told = row
            if row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                told = (*row[:4], row[4].replace("\n", ""))
            folded = leaf(told)
            for left, right in steps:
                folded = digest(left + folded + right)
            root = top[-1][0]
            out.append((row[0], s, leaf(row), trees[s][-1][0], root, digest("".join(a + b for a, b in steps)), folded, folded == root))
    return out


def check(spark, rows, **more):
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({k: F.lit(v) for k, v in more.items()})
    found = [tuple(r) for r in manifest.manifest(docs, manifest.without_newlines(F.col("doc_id"), F.col("text"))).collect()]
    assert sorted(found, key=str) == sorted(expected(rows), key=str)


def some(n, source):
    return [(i, source, "en" if i % 3 else None, i, f"text {i}\nof {source}\n" if i % 4 else None) for i in range(n)]


@pytest.mark.parametrize("rows", [
    [], some(1, "a"), some(9, "a") + some(10, "b") + some(1, "ä") + some(28, None) + some(3, "c") + some(2, "d")],
    ids=["empty", "one", "powers of three"])
def test_small_tables(spark, rows):
    check(spark, rows)


def test_nulls_ties_repeats_and_clashing_names(spark):
    rows = [(None, "a", None, None, "no id\n"), (None, "a", None, None, "no id\n"), (7, "a", "en", 1, "x\ny"), (7, "a", "en", 1, "x\ny"),
            (7, "a", "en", 1, "another"), (8, "", "", 0, ""), (9, "=", "é", -1, "é" * 5000 + "\n"), (10, "a", "en", None, None)]
    check(spark, rows, place=1, n=2, digest="x", block=3, levels="y", key="z", i=0, above="a", root="r")


def test_trees_of_many_blocks(spark, monkeypatch):
    """Blocks of nine nodes: three levels of blocks over the documents, two over the sources."""
    monkeypatch.setattr(manifest, "HEIGHT", 2)
    monkeypatch.setattr(manifest, "BLOCK", 9)
    check(spark, some(200, "hot") + [row for s in range(14) for row in some(1 + s % 4, f"s{s}")])


def test_without_a_copy_all_is_verified(spark, sf_dir):
    rows = manifest.manifest(queries.table(spark, sf_dir, "documents")).toPandas()
    assert rows["verified"].all() and rows["root"].nunique() == 1
