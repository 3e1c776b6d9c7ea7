"""The stored index of text pieces against plain substring tests."""

import random

from pyspark.sql import functions as F
from test_store import GOOD, NOW, PLAIN, pages

from marketpulse.operators import mentions
from marketpulse.store import compact, search
from marketpulse.streaming import ingest

TEXTS = ["$AAPL and $TSLA", "apple pie", "Straße nach Köln", "aaaa", "ab", "a", "", None, "x\ny $GE.", "PAGE one", "😀 emoji $GE", "multi\tspace  text"]


def brute(texts, needles):
    return sorted((i, n) for i, t in texts.items() for n in needles if t is not None and n in t.upper())


def found(rows):
    return sorted((r["platform_id"], r["tag"]) for r in rows.collect())


def test_needles_of_all_lengths(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_POSTS", 9)
    draw = random.Random(4)
    texts = {str(i): t for i, t in enumerate(TEXTS + ["".join(draw.choice("ab$ c") for _ in range(draw.randint(0, 40))) for _ in range(80)])}
    needles = ["A", "$", "GE", "$GE", "AAPL", "$AAPL", "APPLE PIE", "STRASSE", "KÖLN", "ABAB", "AB C", "😀", "😀 EMOJI", "NOWHERE", "X\nY", "A" * 5, "SPACE  TEXT", "$AAPL AND $TSLA"]
    posts = spark.createDataFrame([("x", i, t) for i, t in texts.items()], "source string, platform_id string, text string")
    wanted = spark.createDataFrame([(n, n) for n in needles + needles[:3]] + [("", "")], "needle string, tag string")
    path = str(tmp_path / "index")
    assert found(search.search(search.open_index(spark, path), wanted)) == []
    for run in (0, 1):
        index = search.add(posts.filter(F.col("platform_id").cast("int") % 2 == run), path, f"run={run}_{run}")
    search.add(posts.filter(F.col("platform_id").cast("int") % 2 == 1), path, "run=1_1")  # a repeated run replaces itself
    assert found(search.search(index, wanted)) == brute(texts, needles) == found(mentions.substring_join(posts, wanted.filter("needle != ''")))
    # Candidates come from postings alone, of the folders of their pieces.
    some = search.candidates(index, wanted.filter("tag = '$AAPL'").select("needle").distinct())
    assert all("/postings/" in path or "asked-pieces" in path for path in some.inputFiles())
    assert "folder#" in some._jdf.queryExecution().executedPlan().toString().split("PartitionFilters", 1)[1][:60]


def test_index_of_a_store(spark, tmp_path):
    store, path = str(tmp_path / "store"), str(tmp_path / "index")
    ingest.create_store(spark, store, buckets=2)
    needles = spark.createDataFrame([("$TSLA", "t"), ("MOON", "m")], "needle string, tag string")
    ingest.write_batch(pages(spark, 0, [("1", GOOD, 1), ("2", PLAIN, 1)]), 0, store, NOW, embed=False)
    assert found(search.search(search.update(spark, store, path), needles)) == [("1", "m"), ("2", "t")]
    ingest.write_batch(pages(spark, 1, [("1", PLAIN, 1), ("3", GOOD, 1)]), 1, store, NOW, embed=False)  # a post keeps its first text
    compact.compact(spark, store, fan_in=2)
    index = search.update(spark, store, path)
    assert found(search.search(index, needles)) == [("1", "m"), ("2", "t"), ("3", "m")]
    assert search.update(spark, store, path).runs == index.runs == ["run=0_0", "run=1_1"]


def test_pieces_come_of_one_pass_over_a_text(spark, texts):
    rows = texts([t for t in TEXTS if t is not None] + ["a\0b\0", "ab😀ab😀a"])
    pieces = rows.select("text", search._distinct_pieces(F.col("text")).alias("pieces"))
    for row in pieces.collect():
        text = row["text"]
        assert sorted(row["pieces"]) == sorted({text[i:i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1)})
    assert pieces._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
