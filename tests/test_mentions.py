import datetime as dt
import random

from marketpulse.operators import mentions as N

POSTS = "source string, platform_id string, text string, lang string, repost_of_id string, subreddit string, created_at timestamp"
NOW = dt.datetime(2024, 1, 31)


def make(spark, rows):
    return spark.createDataFrame(rows, POSTS)


def test_all_three_forms_agree_with_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    alphabet = "abcABC $éß\U0001F644"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(150)] + ["", "ABCABCABC" * 3]
    names = {"".join(rng.choice("ABC É") for _ in range(n)) for n in (1, 1, 2, 2, 3, 3, 4, 5, 6, 8, 9, 12)} | {"ABCABCABC", "SS", "", "\U0001F644A"}
    instruments = [(s, "".join(rng.choice("abc ") for _ in range(rng.randint(0, 9)))) for s in sorted(names)] + [("QQ", "QQ"), (None, "abca")]
    posts = make(spark, [("x", str(i), t, "en", None, None, NOW) for i, t in enumerate(texts)])
    table = spark.createDataFrame(instruments, "symbol string, company_name string")
    expected = {
        (str(i), s or "") for i, t in enumerate(texts) for s, c in instruments
        if (s and s in t.upper()) or (c and c.upper() in t.upper())}
    for limit, small in ((1000, None), (0, True), (0, False)):
        monkeypatch.setattr(N, "is_small", lambda df, small=small: small)
        rows = N.mention_join(posts, table, inline_limit=limit).collect()
        assert {(r["platform_id"], r["symbol"]) for r in rows} == expected
        assert len(rows) == len(expected)


def test_search_terms(spark):
    table = spark.createDataFrame(
        [("AAPL", "Apple"), ("META", "META"), ("MSFT", "msft"), ("TOOLONG", "x"), ("", "Acme"), ("", ""), ("$brk", "B")], "symbol string, company_name string")
    got = {}
    for r in N.search_terms(table).collect():
        got.setdefault((r["symbol"], r["source"]), []).append((r["term_no"], r["term"]))
    assert got["AAPL", "x"] == [(0, '($AAPL OR "Apple") -is:retweet lang:en')]
    assert got["AAPL", "reddit"] == [(0, "$AAPL"), (1, "AAPL"), (2, "Apple")]
    assert got["AAPL", "stocktwits"] == [(0, "AAPL")] and got["AAPL", "trends"] == [(0, "AAPL"), (1, "Apple")]
    assert got["META", "x"] == [(0, "($META) -is:retweet lang:en")] and got["META", "reddit"] == [(0, "$META"), (1, "META")]
    # X compares names as written, Reddit and trends in upper case.
    assert got["MSFT", "x"] == [(0, '($MSFT OR "msft") -is:retweet lang:en')] and len(got["MSFT", "reddit"]) == 2
    assert ("TOOLONG", "stocktwits") not in got and got["$brk", "stocktwits"] == [(0, "BRK")]
    assert got["", "x"] == [(0, '("Acme") -is:retweet lang:en')] and got["", "reddit"] == [(2, "Acme")]


def test_search_match(spark, monkeypatch):
    day = dt.timedelta(days=1)
    rows = [
        ("x", "1", "about $aapl and Apple", "en", None, None, NOW), ("x", "2", "$AAPL", "de", None, None, NOW),
        ("x", "3", "$AAPL", "en", "7", None, NOW), ("x", "4", "AAPL alone", "en", None, None, NOW),
        ("stocktwits", "5", "$AAPL", "en", None, None, NOW), ("stocktwits", "6", "AAPL", "en", None, None, NOW),
        ("reddit", "7", "AAPL", "en", None, "stocks", NOW - day), ("reddit", "8", "AAPL", "en", None, "cooking", NOW),
        ("reddit", "9", "AAPL", "en", None, "stocks", NOW - 8 * day),
        *[("reddit", f"n{i}", "apple", "en", None, "stocks", NOW - i * dt.timedelta(hours=1)) for i in range(6)],
    ]
    table = spark.createDataFrame([("AAPL", "Apple")], "symbol string, company_name string")
    for limit, small in ((100, None), (0, True), (0, False)):
        monkeypatch.setattr(N, "is_small", lambda df, small=small: small)
        got = sorted((r["platform_id"], r["term_no"]) for r in N.search_match(make(spark, rows), table, NOW, per_term=3, inline_limit=limit).collect())
        assert got == [("1", 0), ("5", 0), ("7", 1), ("n0", 2), ("n1", 2), ("n2", 2)]
