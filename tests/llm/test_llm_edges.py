"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marketpulse.llm import langid, lmscore, minhash, mixing, packing, rules, thresholds, tokenfile, topk, warc

LONG = "alpha beta gamma " * 20_000
DOCS = [
    (1, "The quick brown fox jumps over the lazy dog again and again", "en", "a", 59),
    (2, "The quick brown fox jumps over the lazy dog again and again", "en", "a", 59),
    (2, "The quick brown fox jumps over the lazy dog again and again", "en", "a", 59),
    (3, "", "en", "b", 0), (4, None, None, None, None), (5, " \n\t ", "de", "a", 4), (6, LONG, "en", "a", len(LONG)),
    (7, "Der schnelle braune Fuchs springt über den faulen Hund und schläft", "de", "b", 66), (8, "## %% 12", None, "a", 8),
    (9, "x", "de", None, 1), (None, "The quick brown fox without any number", "en", "a", 38), (10, "été où ça", "fr", "c", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves.
CLASHES = ["score", "words", "n_tokens", "rate", "kept", "label", "component_id", "bucket", "edge", "chars", "held", "first", "lang_pred"]


@pytest.fixture(scope="module")
def docs(spark):
    out = spark.createDataFrame(DOCS, SCHEMA)
    return out.withColumns({c: F.lit("taken") for c in CLASHES})


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i not in (3, 5, 8)), 0) for i in range(1, 11)] + [(1, 1, None), (None, 1, 0), (77, None, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


OPERATORS = {
    "pack": lambda d, t: packing.pack(d),
    "langid": lambda d, t: langid.identify(d, *langid.learn(d, F.lit(True)), ["doc_id"]),
    "tokens": lambda d, t: tokenfile.round_trip(d, public_tokenizers.path("word_bpe_49k.json")),
    "mix": lambda d, t: mixing.mix(d, ["doc_id"]),
    "rules": lambda d, t: rules.score(d, rules.fit(d, t, F.lit(True)), ["doc_id"]),
    "lm": lambda d, t: lmscore.cross_entropy_difference(d, t.where(lmscore.good_documents())),
    "thresholds": lambda d, t: thresholds.judge(d, t),
    "minhash": lambda d, t: minhash.near_duplicates(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_gets_an_answer(docs, labels, name):
    found = [r["doc_id"] for r in OPERATORS[name](docs, labels).select("doc_id").collect()]
    assert sorted(map(str, found)) == sorted(str(d[0]) for d in DOCS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(docs, labels, name):
    assert OPERATORS[name](docs.limit(0), labels).count() == 0
    assert OPERATORS[name](docs.limit(0), labels.limit(0)).count() == 0


def test_stages_keep_columns_and_take_empty_tables(spark, docs, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (docs, docs.limit(0)):
        now = rows
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, str(tmp_path))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns, name
            now = spark.createDataFrame(out.collect(), out.schema)
        if rows is not docs:
            assert now.count() == 0


def test_answers_of_the_edges(docs, labels):
    told = {r["doc_id"]: r for r in langid.identify(docs, *langid.learn(docs, F.lit(True)), ["doc_id"]).collect()}
    assert [told[i]["lang_pred"] for i in (3, 4, 5, 8)] == ["und"] * 4 and told[7]["lang_pred"] == "de" and told[1]["lang_pred"] == "en"
    assert langid.identify(docs, [], None, ["doc_id"]).where("lang_pred != 'und'").count() == 0
    near = {r["doc_id"]: r for r in minhash.near_duplicates(docs).collect()}
    assert near[2]["component_id"] == 1 and not near[2]["kept"] and near[6]["n_shingles"] == 3
    assert all(near[i]["n_shingles"] == 0 and near[i]["kept"] for i in (3, 4, 5)) and near[None]["kept"]
    stays = [r["doc_id"] for r in minhash.drop_near_duplicates(docs).collect()]
    assert stays.count(1) == 1 and 2 not in stays and None in stays
    lm = {r["doc_id"]: r for r in lmscore.cross_entropy_difference(docs, labels.limit(0)).collect()}
    assert lm[3]["difference"] is None and lm[4]["n_tokens"] == 0 and lm[6]["n_tokens"] == len(LONG.split())
    judged = {r["doc_id"]: r for r in thresholds.judge(docs, labels).collect()}
    assert judged[4]["base_failed"] and judged[6]["n_repeat_words"] == 60_000 and not judged[6]["kept"]


def test_repeated_ids_with_unlike_texts(spark):
    rows = [(1, "a b c d e f g h"), (2, "p q r s t u v w"), (2, "a b c d e f g h"), (3, "p q r s t u v w")]
    found = {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {(1, 1), (2, 1), (3, 1)}


def test_pages_and_vectors(spark):
    big = "ü" * 70_000
    pages = [(1, "http://a\r\nX: y", "p" * 200, "z"), (2, None, "p" * 200, "z"), (3, "u", None, "z"), (4, "u", "short", "z"), (5, "u", "short", "z"),
             (6, "u", big, "z"), (6, "u", big, "z"), (None, "u", big, "z"), (7, "u", "a\r\n\r\nWARC/1.1\r\n\r\n" * 30, "z")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, digest string")
    found = warc.round_trip(frame).collect()
    assert all(r["problem"] is None for r in found)
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in found)
    assert got == sorted([("1", 200, "response", None), ("2", 200, "revisit", 1), ("3", 0, "response", None), ("4", 5, "response", None),
                          ("5", 5, "response", None), ("6", 140_000, "response", None), ("6", 140_000, "response", None),
                          ("None", 140_000, "revisit", 6), ("7", 510, "response", None)])
    assert warc.round_trip(frame.limit(0)).count() == 0
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []),
            (8, [-1.0, -0.01]), (None, [1.0, 1.0]), (9, [1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    found = {tuple(r) for r in topk.exact_topk(vectors, F.col("vec_id") == 0, k=2).collect()}
    assert found == {(0, 1, 1, 64 * 64 + 32 * 32), (0, 2, 2, 64 * 64 + 32 * 32)}
    assert topk.exact_topk(vectors.limit(0), F.col("vec_id") == 0).count() == 0
