"""The methods against brute force, exact round trips and held-out accuracy."""

import gzip
import itertools
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from compare import connect, differences
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from marketpulse.llm import langid, minhash, mixing, packing, queries, thresholds, tokenfile, topk, warc

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, sf_dir, name):
    left, right, only_spark, only_sql = differences(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLE_SQL[name])
    assert left == right and not only_spark and not only_sql


@given(st.lists(st.tuples(st.integers(1, 60), st.integers(1, 9)), min_size=1, max_size=9, unique_by=lambda x: x[0]), st.integers(1, 4))
@settings(max_examples=60, deadline=None)
def test_boundaries_are_optimal(bins, buckets):
    bins = sorted(bins)
    edges, counts = np.array([e for e, _ in bins]), np.array([n for _, n in bins])
    cost = lambda ends: sum(n * min(e for e in ends if e >= edge) for edge, n in bins)
    found = packing.boundaries(edges, counts, buckets)
    assert len(found) <= buckets and found == sorted(set(found))
    rest = [c + (edges[-1],) for k in range(buckets) for c in itertools.combinations(edges[:-1].tolist(), k)]
    assert cost(found) == min(map(cost, rest))


@given(st.lists(st.tuples(st.integers(1, 60), st.integers(1, 9)), min_size=1, max_size=9, unique_by=lambda x: x[0]), st.integers(1, 4), st.integers(1, 60))
@settings(max_examples=60, deadline=None)
def test_boundaries_with_a_budget_are_optimal(bins, buckets, budget):
    bins = sorted(bins)
    edges, counts = np.array([e for e, _ in bins]), np.array([n for _, n in bins])
    cost = lambda ends: sum(n * min(e for e in ends if e >= edge) for edge, n in bins)
    found = packing.boundaries(edges, counts, buckets, budget)
    fitting = [e for e, _ in bins if e <= budget][-1:]
    both = bool(fitting) and fitting[0] < edges[-1]
    buckets = max(buckets, 2) if both else buckets
    rest = [c + (edges[-1],) for k in range(buckets) for c in itertools.combinations(edges[:-1].tolist(), k)]
    assert len(found) <= buckets and (not both or fitting[0] in found)
    assert cost(found) == min(cost(ends) for ends in rest if not both or fitting[0] in ends)


@pytest.mark.parametrize("budget", [16_384, 6_001])
def test_fitting_documents_stay_within_the_budget(spark, budget):
    lengths = [*range(1, 3000, 7), 6_000, 6_001, 6_002, 9_000, 16_384, 16_385, 20_050]
    docs = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n long")
    rows = packing.pack(docs, 4, budget, F.col("n")).toPandas()
    assert sorted(rows["n_tokens"]) == lengths and (rows["n_tokens"] <= rows["padded_length"]).all()
    assert (rows["over_budget"] == (rows["n_tokens"] > budget)).all()
    assert (rows.loc[rows["n_tokens"] <= budget, "padded_length"] <= budget).all()
    batches = rows.groupby(["bucket", "part", "batch"]).agg(n=("doc_id", "size"), wide=("padded_length", "max"))
    assert ((batches["n"] * batches["wide"] <= budget) | (batches["n"] == 1)).all()


def test_packing_stays_within_budget(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 3)
    rows = packing.pack(queries.table(spark, sf_dir, "documents")).toPandas()
    batches = rows.groupby(["bucket", "part", "batch"]).agg(n=("doc_id", "size"), wide=("padded_length", "max"), most=("n_tokens", "max"))
    assert rows["doc_id"].is_unique and (rows["n_tokens"] <= rows["padded_length"]).all() and rows["part"].max() > 0
    assert ((batches["n"] * batches["wide"] <= packing.BUDGET) | (batches["n"] == 1)).all()


def test_languages_held_out(spark, sf_dir):
    told = queries.op2_language_mixture(spark, sf_dir).join(queries.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    share = told.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert share > 0.97


def test_mixture_has_the_written_proportions(spark):
    en, de = "the house is with that other thing and this " * 20, "der hund ist nicht mit dem haus und sich auch " * 20
    docs = spark.createDataFrame([(1, en, "en"), (2, de, "de")], "doc_id long, text string, lang string")
    langs, model = langid.learn(docs, F.lit(True))
    names, shares, sizes = langid.infer([en, de, en + de, de + de + en], langs, model)
    assert sizes == [1, 1, 2, 2] and names[0] == "en" and names[1] == names[3] == "de"
    assert abs(shares[2] - 0.5) < 0.1 and abs(shares[3] - 0.67) < 0.1


def test_quality_held_out(spark, sf_dir):
    found = queries.op5_rule_ensemble(spark, sf_dir).join(queries.table(spark, sf_dir, "labels"), "doc_id").where("held_out").toPandas()
    assert ((found["predicted"] == found["quality"]).mean() > 0.8) and found["score"].between(0, 1).all()


@given(st.lists(st.integers(2, 9), max_size=400), st.integers(1, 5))
@settings(max_examples=60, deadline=None)
def test_grammar_round_trip(ids, parts):
    symbols = np.array(ids * 8, np.uint16)
    cuts = np.sort(np.random.default_rng(len(ids)).integers(0, len(symbols) + 1, parts - 1)) if parts > 1 else np.empty(0, np.int64)
    ends = np.append(cuts, len(symbols)).astype(np.int64)
    packed, new_ends, rules, lengths = tokenfile.compress(symbols, ends, 10)
    assert np.array_equal(tokenfile.expand(packed, rules, 10), symbols)
    shard = dict(doc_ends=new_ends.astype("<u4").tobytes(), symbols=packed.tobytes(), rules=rules.astype("<u2").tobytes(), base=10,
                 rule_tokens=lengths.astype("<u4").tobytes())
    begin = 0
    for place, end in enumerate(ends):
        assert np.array_equal(tokenfile.decode_document(shard, place), symbols[begin:end])
        for low in range(0, end - begin + 2, 7):
            for high in (low - 1, low + 1, low + 5, end - begin, end - begin + 3):
                assert np.array_equal(tokenfile.decode_range(shard, place, low, high), symbols[begin:end][low:max(low, high)])
        begin = end
    # Nothing is left that is worth a rule, unless the symbols are used up.
    inside = np.ones(max(0, len(packed) - 1), bool)
    inside[new_ends[(new_ends > 0) & (new_ends < len(packed))] - 1] = False
    pairs = [p for p, i in zip(zip(packed.tolist(), packed[1:].tolist()), inside) if i]
    apart = Counter()
    for i, p in enumerate(pairs):  # a run of one symbol holds half as many pairs
        apart[p] += not (p[0] == p[1] and i and pairs[i - 1] == p)
    assert all(n < 2 * tokenfile.LEAST_COUNT for n in apart.values())
    assert all(len(tokenfile.expand(np.array([10 + i], np.uint16), rules, 10)) == n for i, n in enumerate(lengths))


@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=12) | st.sampled_from(["it's", "A.B", "<|endoftext|>", "é\x1c2", "Stop.", " "]), max_size=30))
@settings(max_examples=150, deadline=None)
def test_words_encode_as_whole_texts(parts):
    text = " ".join(parts)
    encoder = tokenfile.word_encoder(TOKENIZER)
    whole = Tokenizer.from_file(TOKENIZER).encode(text, add_special_tokens=False).ids if parts else []
    assert np.frombuffer(encoder.encode(text.encode()), np.uint16).tolist() == whole


#: Letters that normalize to more than letters, or that tables of characters disagree about; words of one piece, and of more.
WORDS = ["\u0958\u093e", "\u0958", "क", "x\u0301", "e\u0301", "İstanbul", "ΑΣ", "\U00010d4a", "\U00010d4a.", "\U00010d4a\u0061.", "ﬁn", "한국", "\u1112\u1161\u11ab", "ß!", "Ça.",
         "don't!!", "'s", "it'S.", "'", "...", "a.b", "ABC,", "abc", "v2.", "2²", "x\x1cy", "x\u00a0y", "<|endoftext|>", "a<|endoftext|>b", "\x7f.", "a\x7f.", "é\u2026.", "ſ"]


def test_words_learned_together_encode_as_alone():
    """Many words go to the tokenizer at once; none shifts another, whatever is learned with it."""
    whole = Tokenizer.from_file(TOKENIZER)
    texts = [" ".join(WORDS), " ".join(reversed(WORDS)), None, "", " \t", "\n".join(f"{a}{b}" for a in WORDS for b in (".", "'", "s", "!?")), *WORDS]
    wanted = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        encoder = tokenfile.WordEncoder(whole)
        for _ in range(2):  # new, then known
            found = encoder.encode_all(pa.array([t if t is None else t.encode() for t in texts], pa.binary()))
            assert [np.frombuffer(f, np.uint16).tolist() for f in found] == wanted
        texts, wanted = texts[::-1], wanted[::-1]


def test_distinct_words_are_looked_up_once():
    """Copies of a word, its cases and the marks after it cost no further look at the known words."""
    encoder = tokenfile.WordEncoder(Tokenizer.from_file(TOKENIZER))
    encoder.encode_all(pa.array([b"alpha Alpha, ALPHA. beta " * 500] * 4, pa.binary()))
    assert set(encoder.known) == {b"", b"alpha", b"beta", b",", b"."}


def test_latin_words_are_looked_up_once():
    """So do those of words with Latin letters beyond ASCII, which need no normalizing and cutting of their own."""
    encoder = tokenfile.WordEncoder(Tokenizer.from_file(TOKENIZER))
    encoder.encode_all(pa.array(["été Été, ÉTÉ. straße Straße. ÀB àb ".encode() * 500] * 4, pa.binary()))
    assert set(encoder.known) == {w.encode() for w in ("", "été", "straße", "àb", ",", ".")}


def test_latin_letters_encode_as_whole_texts():
    """Each letter by itself, beside others, before marks and before accents that join it, learned with all others."""
    whole, letters = Tokenizer.from_file(TOKENIZER), tokenfile.LATIN
    texts = [" ".join(f"{a}{c}{b}" for c in letters) for a in ("", "x", "É", "'s") for b in ("", "e", "ßT.", "\u0301", "\u0327\u0301o", "'s", "2")]
    texts += [" ".join(a + b for a in letters[::7] for b in letters), letters, letters[::-1]]
    found = tokenfile.WordEncoder(whole).encode_all(pa.array([t.encode() for t in texts], pa.binary()))
    for text, ids in zip(texts, found):
        assert np.frombuffer(ids, np.uint16).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_pairs_of_one_hash_all_become_rules():
    """Pairs that share an entry of the table by hash are told apart, whichever is written there last."""
    pairs = np.arange(2, 700, dtype=np.uint32)
    pairs = ((pairs[:, None] << np.uint32(16)) | pairs).ravel()
    hashes = tokenfile._hash(pairs)
    order = np.argsort(hashes, kind="stable")
    same = np.flatnonzero(hashes[order][1:] == hashes[order][:-1])[:40]
    chosen = np.unique(pairs[order[np.append(same, same + 1)]])
    symbols = np.stack([chosen >> 16, chosen & 0xFFFF], axis=1).astype(np.uint16)
    text = np.tile(symbols, (tokenfile.LEAST_COUNT, 1))
    ends = np.arange(2, text.size + 1, 2)  # a document for each pair
    packed, new_ends, rules, lengths = tokenfile.compress(text.ravel(), ends, 1000)
    assert len(rules) == len(chosen) and len(packed) == len(text) and (packed >= 1000).all() and (lengths == 2).all()
    assert np.array_equal(tokenfile.expand(packed, rules, 1000), text.ravel()) and np.array_equal(new_ends, np.arange(1, len(text) + 1))


def test_token_files_of_empty_and_repeated_rows(spark):
    rows = [(3, None), (1, ""), (2, "one two"), (2, "one two"), (2, "a"), (None, "no id"), (5, " \n"), (4, "x " * 3000)]
    tokenizer, start, wanted = Tokenizer.from_file(TOKENIZER), 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        wanted.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    found = tokenfile.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), TOKENIZER)
    assert sorted(map(tuple, found.collect()), key=lambda r: r[1]) == wanted


def test_token_files(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(tokenfile, "SHARD_IDS", 5000)
    found = {r["doc_id"]: tuple(r) for r in queries.op3_repair_tokens(spark, sf_dir).collect()}
    tokenizer, start = Tokenizer.from_file(TOKENIZER), 0
    for r in queries.table(spark, sf_dir, "documents").orderBy("doc_id").collect():
        ids = np.array(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4")
        assert found[r["doc_id"]] == (r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_raked_margins_meet_targets(spark):
    rows = [(s, l, t, 1.0 + (i * 7) % 5) for i, (s, l, t) in enumerate(itertools.product("abc", "xy", "pq"))]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens double")
    goal = {"source": {"a": 2.0, "b": 1.0, "c": 1.0}, "lang": {"x": 0.3, "y": 0.7}}
    out = mixing.rake(cells, targets=goal).toPandas()
    assert np.allclose(out.groupby("source")["weight"].sum(), [0.5, 0.25, 0.25]) and np.allclose(out.groupby("lang")["weight"].sum(), [0.3, 0.7])
    assert out["rate"].max() == 1.0 and (out["rate"] > 0).all()


def test_wanted_share_is_kept_beside_a_rare_source(spark):
    """One rare source does not decide how much of the others stays; margins are met where the cells have the tokens."""
    rows = [(s, l, t, 1e6 + 1e5 * ((i * 7) % 5)) for i, (s, l, t) in enumerate(itertools.product("abc", "xy", "pq"))] + [("rare", "x", "p", 300.0)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens double")
    fitted = mixing.rake(cells, share=0.5).cache()
    told = {(r["margin"], r["value"]): r for r in mixing.report(fitted).collect()}
    out = fitted.toPandas()
    assert out["rate"].between(0, 1).all() and abs(out["weight"].sum() - 1) < 1e-9
    assert abs(told["all", "all"]["kept_share"] - 0.5) < 1e-6 and abs(told["source", "rare"]["kept_share"] - 1) < 1e-6
    assert all(abs(r["gap"]) < 1e-6 for (m, _), r in told.items() if m in ("lang", "topic"))
    others = [told["source", s]["share"] / told["source", s]["wanted"] for s in "abc"]
    assert max(others) - min(others) < 1e-6


def test_binomial_bound(spark):
    def brute(n, risk, level):
        total, best = 0.0, -1
        for k in range(int(n * risk) + 1):
            total += math.comb(n, k) * risk**k * (1 - risk) ** (n - k)
            best = k if total <= level else best
        return best

    cases = [(n, r, d) for n in (0, 5, 100, 900) for r in (0.01, 0.05) for d in (0.004, 0.05)]
    for n, risk, level in cases:
        got = spark.range(1).select(thresholds.allowed(F.lit(n).cast("long"), risk, level)).first()[0]
        assert got == brute(n, risk, level), (n, risk, level)


def test_quality_rules_count_like_python(spark, sf_dir):
    found = {r["doc_id"]: r for r in queries.op8_risk_controlled_rules(spark, sf_dir).collect()}
    for r in queries.table(spark, sf_dir, "documents").collect():
        words = (r["text"] or "").encode().split()
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        times = Counter(windows)
        covered = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(8)}
        lines = [x for x in (r["text"] or "").split("\n") if x.encode().split()]
        got = found[r["doc_id"]]
        assert (got["n_words"], got["n_repeat_words"], got["n_dup_lines"]) == (len(words), len(covered), len(lines) - len(set(lines)))
        assert got["n_symbols"] == sum(c in "#*$%&|<>" for c in r["text"] or "") and got["word_chars"] == sum(len(w.decode()) for w in words)


def test_topk_is_exact(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(topk, "CORPUS_ROWS", 40)
    monkeypatch.setattr(topk, "GROUP", 2)
    rows = queries.table(spark, sf_dir, "embeddings").select("vec_id", "embedding").toPandas().sort_values("vec_id")
    whole, ids = np.floor(64 * np.stack(rows["embedding"].to_numpy()).astype(float)), rows["vec_id"].to_numpy()
    expected = set()
    for i in np.flatnonzero(ids % 20 == 0):
        score = whole @ whole[i]
        order = [j for j in np.lexsort((ids, -score)) if j != i][:20]
        expected |= {(ids[i], k, ids[j], int(score[j])) for k, j in enumerate(order, 1)}
    assert {tuple(r) for r in queries.op6_segment_topk(spark, sf_dir).collect()} == expected


@pytest.mark.parametrize("copies", [2, 20])
def test_repeated_candidates_leave_room_for_others(copies):
    """Each id counts once, with its best row, in one block and over several."""
    draw = np.random.default_rng(4)
    vectors, ids = np.floor(64 * draw.normal(size=(90, 32))), np.arange(90)
    own, names = vectors[:7], ids[:7]
    rows, named = np.concatenate([vectors] * copies), np.concatenate([ids] * copies)
    rows[90:180] -= 1.0  # rows of one id that differ
    expected = []
    for q in range(7):
        score = np.maximum.reduce([own[q] @ part.T for part in np.split(rows, copies)]).astype(int)
        expected += [(q, int(j), int(score[j])) for j in np.lexsort((ids, -score)) if j != q][:20]
    order = draw.permutation(len(rows))
    for places in ([np.arange(len(rows))], np.array_split(order, 5)):
        found = topk.best_of(own, names, [(rows[p], named[p]) for p in places], 20)
        assert list(zip(*(x.tolist() for x in found))) == expected


def test_segment_bounds_hold():
    draw = np.random.default_rng(3)
    a, b = draw.normal(size=(50, 64)), draw.normal(size=(60, 64))
    for length in (16, 7, 4):
        assert (topk.statistics(a, length) @ topk.statistics(b, length).T >= a @ b.T - 1e-9).all()


def test_damaged_archives_are_reported(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x" * 60_000)], "page_id long, url string, html string")
    path = str(tmp_path / "good")
    warc.write_warc(pages, path)
    records = spark.read.option("lineSep", warc.END).text(path)
    whole = b"".join(gzip.open(f).read() for f in sorted(map(str, (tmp_path / "good").glob("part-*"))))
    assert records.count() and whole.count(b"WARC-Type: continuation") == 3

    def problem(data):
        folder = tmp_path / str(abs(hash(data)))
        folder.mkdir()
        (folder / "a.warc").write_bytes(data)
        return [r["problem"] for r in warc.read_warc(spark, str(folder)).collect()]

    assert problem(whole) == [None]
    assert problem(whole.replace(b"Total-Length: ", b"Total-Length: 1")) == ["wrong total length"]
    third = whole.split(b"WARC/1.1\r\n")
    assert problem(b"".join(b"WARC/1.1\r\n" + p for p in third[1:] if b"Segment-Number: 3" not in p)) == ["segment missing"]
    assert problem(whole[:-5])[-1] == "broken file" or "broken file" in problem(whole[:-6])
    assert warc.decode_chunked(b"3\r\nabc\r\n0\r\n\r\n") == (b"abc", None) and warc.decode_chunked(b"5\r\nabc")[1] == "bad chunk"


def brute_components(texts, width, percent):
    sets = {}
    for i, t in texts.items():
        words = (t or "").encode().lower().split()
        sets[i] = {tuple(words[j : j + width]) for j in range(max(1, len(words) - width + 1))} if words else set()
    least = {i: i for i in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            least[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_against_all_pairs(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 150)  # components of many blocks
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, sf_dir, "documents").collect()}
    draw = np.random.default_rng(5)
    base = [f"w{i}" for i in range(60)]
    for i in range(40):
        copy = list(base)
        for j in draw.integers(0, 60, draw.integers(1, 4)):
            copy[j] = f"x{draw.integers(0, 99)}"
        texts[10_000 + i] = " ".join(copy)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame, 4, 80).collect()}
    assert found == brute_components(texts, 4, 80)


@pytest.mark.parametrize("block", [120, 700])
def test_large_components_of_several_groups(spark, monkeypatch, block):
    """Texts that share half of their words hang together by buckets; what is linked is told by exact sets only."""
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", block)
    draw = np.random.default_rng(8)
    texts = {}
    for base, size in (("a", 30), ("b", 18), ("c", 5)):
        words = [f"s{i}" for i in range(40)] + [f"{base}{i}" for i in range(18)]
        for i in range(size):
            copy = list(words)
            for j in draw.integers(0, 58, draw.integers(0, 3)):
                copy[j] = f"x{draw.integers(0, 99)}"
            texts[int(draw.integers(1, 1 << 40))] = " ".join(copy)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame, 4, 80).collect()}
    assert found == brute_components(texts, 4, 80)


def lengthened_copies(draw):
    """Near-copies of one text, each but the first few in two forms: a word changed, and that with 12 to 25 % of new words appended."""
    base = [f"w{i}" for i in range(103)]
    texts = {}
    for i in range(32):
        copy = list(base)
        copy[int(draw.integers(0, 103))] = f"x{i}"
        texts[2 * i] = " ".join(copy)
        if i > 3:
            texts[2 * i + 1] = " ".join(copy + [f"y{i}_{j}" for j in range(int(draw.integers(13, 25)))])
    return texts


@pytest.mark.parametrize("settled", [False, True])
def test_copies_with_appended_text_join(settled):
    """Their link to a member of the group counts although it gets no row of its own, in one block and beside settled ones."""
    texts = lengthened_copies(np.random.default_rng(11))
    expected = {i: c for i, (_, c) in brute_components(texts, 4, 80).items()}
    ids = np.array(sorted(texts))
    known = ids % 2 == 0 if settled else None
    sets = [minhash.shingle_set(texts[i].encode(), 4) for i in ids.tolist()]
    found = dict(minhash.link_forest(ids, sets, 80, known))
    assert set(expected.values()) == {0}
    assert found == {i: c for i, c in expected.items() if i != c and not (settled and i % 2 == 0)}


@pytest.mark.parametrize("block", [400, 1_000_000])
def test_appended_text_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", block)
    texts = lengthened_copies(np.random.default_rng(12))
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame, 4, 80).collect()}
    assert found == brute_components(texts, 4, 80)


def test_pipeline_is_its_stages(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, docs, sf_dir)
        docs = spark.createDataFrame(now.collect(), now.schema)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(c == i for i, (_, c) in brute_components(texts, 5, 80).items())
    rows = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert set(rows["doc_id"]) == set(texts) and len(rows) == len(texts)
