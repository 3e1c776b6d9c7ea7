import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from marketpulse.schemas import LANDED_PAGE
from marketpulse.sources import landed, outcomes, reddit, stocktwits, x

AS_OF = dt.datetime(2025, 1, 20)
SINCE = dt.datetime(2025, 1, 15)


@pytest.fixture
def pages(spark):
    def make(source, *bodies, kind="search", post_id=None, symbol="AAPL"):
        rows = [(source, kind, symbol, "Apple", symbol, 0, i, post_id, AS_OF, b if isinstance(b, str) or b is None else json.dumps(b))
                for i, b in enumerate(bodies)]
        return spark.createDataFrame(rows, LANDED_PAGE)
    return make


def tweet(n, **more):
    """A post of the recent search: id and text, and whatever else a case gives it."""
    return {"id": f"t{n}", "text": f"post {n} on $AAPL", **more}


TWEET = tweet(3, author_id="u-77", created_at="2025-01-17T08:41:09Z", lang="nl", public_metrics={"like_count": 731, "retweet_count": 64})
USER = {"id": "u-77", "username": "quietfox", "public_metrics": {"followers_count": 2903, "tweet_count": 17}}


def test_tweets_of_a_page(pages):
    body = {"data": [tweet(1, author_id="u-5"), TWEET, tweet(2, author_id="u-5", public_metrics={"reply_count": 8})],
            "includes": {"users": [USER, {"id": "u-5", "username": "rook"}]}}
    first, second, third = x.posts(pages("x", body), AS_OF).orderBy("pos").collect()
    assert (second["source"], second["platform_id"], second["text"], second["lang"]) == ("x", "t3", "post 3 on $AAPL", "nl")
    assert (second["author_handle"], second["like_count"], second["reply_count"], second["repost_count"], second["follower_count"]) == ("quietfox", 731, None, 64, 2903)
    assert second["permalink"] == "https://twitter.com/quietfox/status/t3"
    assert second["created_at"] == dt.datetime(2025, 1, 17, 8, 41, 9)
    assert (first["author_handle"], first["follower_count"], first["lang"], first["created_at"]) == ("rook", None, "en", AS_OF)
    assert (third["reply_count"], third["like_count"], third["permalink"]) == (8, None, "https://twitter.com/rook/status/t2")


def test_tweet_without_user_and_last_duplicate_user_counts(pages):
    other = {**USER, "username": "later"}
    body = {"data": [tweet(4, author_id="nobody", public_metrics={}, lang=None), TWEET], "includes": {"users": [USER, other]}}
    first, second = x.posts(pages("x", body), AS_OF).orderBy("pos").collect()
    assert (first["author_handle"], first["follower_count"], first["permalink"], first["lang"]) == ("", None, None, "en")
    assert second["author_handle"] == "later"


EMPTY = [{}, {"meta": {"result_count": 0}}, None, "null", "not valid json", {"data": None}, '{"data": [', "[]", "5"]


def test_pages_without_posts(pages):
    for source in ("x", "reddit", "stocktwits"):
        assert landed.collect_posts(pages(source, *EMPTY), AS_OF, SINCE).count() == 0


def test_items_without_id_or_text(pages):
    body = {"data": [{}, {**TWEET, "id": ""}, {**TWEET, "text": ""}, TWEET]}
    reasons = [r["reason"] for r in x.candidates(pages("x", body), AS_OF).orderBy("pos").collect()]
    assert reasons == ["missing_id", "missing_id", "missing_text", None]


WRITTEN = [
    ("2025-01-15T10:00:00Z", "10:00:00", "10:00:00"), ("2025-01-15T10:00:00.250Z", "10:00:00.25", "10:00:00.25"),
    ("2025-01-15T10:00:00.123456Z", "10:00:00.123456", "10:00:00.123456"), ("2025-01-15T10:00:00+02:00", None, "10:00:00"),
    ("yesterday", None, None), ("", None, None), (None, None, None), ("2025-13-45T10:00:00Z", None, None),
]


def test_created_at(pages):
    def expected(t):
        return AS_OF if t is None else dt.datetime.fromisoformat(f"2025-01-15T{t}")

    tweets = x.posts(pages("x", {"data": [{**TWEET, "created_at": w} for w, _, _ in WRITTEN]}), AS_OF).orderBy("pos")
    assert [r["created_at"] for r in tweets.collect()] == [expected(t) for _, t, _ in WRITTEN]
    messages = stocktwits.posts(pages("stocktwits", {"messages": [{**MESSAGE, "created_at": w} for w, _, _ in WRITTEN]}), AS_OF)
    assert [r["created_at"] for r in messages.orderBy("pos").collect()] == [expected(t) for _, _, t in WRITTEN]


#: A message as the stream gives it when its author has chosen a side.
MESSAGE = {"id": 88012, "body": "Holding AAPL through the split", "created_at": "2025-01-18T21:07:30Z", "likes": {"total": 46, "user_ids": [9, 12]},
           "entities": {"sentiment": {"basic": "bearish"}, "chart": None}, "user": {"id": 660, "username": "rook", "followers": 31}}


def test_stocktwits_tags_and_defaults(pages):
    plain = {**MESSAGE, "id": 2, "entities": {"sentiment": {}}, "likes": 5, "user": {}}
    bare = {**MESSAGE, "id": 3, "entities": {"sentiment": None}, "likes": None, "user": None}
    tagged, untagged, nulls = stocktwits.posts(pages("stocktwits", {"messages": [MESSAGE, plain, bare]}), AS_OF).orderBy("pos").collect()
    assert tagged["text"] == "[BEARISH] Holding AAPL through the split" and tagged["author_id"] == "660"
    assert (tagged["like_count"], tagged["follower_count"], tagged["created_at"]) == (46, 31, dt.datetime(2025, 1, 18, 21, 7, 30))
    assert tagged["permalink"] == "https://stocktwits.com/rook/message/88012"
    assert untagged["text"] == MESSAGE["body"] and untagged["like_count"] == 0 and untagged["follower_count"] == 0
    assert (untagged["author_handle"], untagged["permalink"], nulls["author_id"]) == ("", None, "")


#: A submission with a text of its own and no votes given.
POST = {"id": "q8zt1", "title": "What now?", "selftext": "Sold half of my AAPL on Monday", "author": "mossy_pine", "over_18": False,
        "created_utc": dt.datetime(2025, 1, 18, 3, 20, tzinfo=dt.timezone.utc).timestamp(), "permalink": "/r/investing/comments/q8zt1/what_now"}


def listing(*posts, after=None):
    return {"data": {"children": [{"data": p} for p in posts], "after": after}}


def test_reddit_posts(pages):
    posts = [POST, {**POST, "author": "[deleted]"}, {**POST, "selftext": "[removed]"}, {**POST, "title": " ", "selftext": "\n"},
             {**POST, "id": ""}, {**POST, "created_utc": 0}, {**POST, "id": "b", "selftext": None, "ups": 7, "num_comments": 213, "permalink": ""}]
    rows = reddit.post_candidates(pages("reddit", listing(*posts)), AS_OF, SINCE).orderBy("pos").collect()
    assert [r["reason"] for r in rows] == [None, "deleted", "removed", "missing_text", "missing_id", "too_old", None]
    assert rows[0]["text"] == "What now?\nSold half of my AAPL on Monday" and rows[0]["created_at"] == dt.datetime(2025, 1, 18, 3, 20)
    assert (rows[0]["platform_id"], rows[0]["like_count"], rows[0]["reply_count"]) == ("post_q8zt1", 0, 0)
    assert (rows[6]["text"], rows[6]["like_count"], rows[6]["reply_count"], rows[6]["permalink"]) == ("What now?", 7, 213, None)


def thread(*children):
    return [{}, {"data": {"children": list(children)}}]


def comment(n, **more):
    return {"kind": more.pop("kind", "t1"), "data": {"id": f"c{n}", "body": f"body {n}", "author": "a", "created_utc": POST["created_utc"], **more}}


def test_ten_children_then_comments_of_accepted_posts(pages):
    children = [comment(i, kind="more" if i == 0 else "t1", body="[deleted]" if i == 1 else f"body {i}") for i in range(15)]
    submissions = reddit.posts(pages("reddit", listing(POST)), AS_OF, SINCE)
    mine = pages("reddit", thread(*children), kind="comments", post_id="q8zt1")
    other = pages("reddit", thread(comment(99)), kind="comments", post_id="elsewhere")
    found = reddit.thread_comments(mine.union(other), submissions, AS_OF, SINCE).collect()
    assert sorted(r["platform_id"] for r in found) == sorted(f"comment_c{i}" for i in range(2, 10))
    assert {r["reply_to_id"] for r in found} == {"q8zt1"}
    both = landed.collect_posts(mine.union(other).union(pages("reddit", listing(POST))), AS_OF, SINCE)
    assert both.count() == 9


def test_an_odd_item_costs_only_itself(pages):
    odd = [7, "text", None, [], {**MESSAGE, "id": "abc"}, {**MESSAGE, "user": 3}, {**MESSAGE, "likes": {"total": "x"}}, MESSAGE]
    rows = stocktwits.candidates(pages("stocktwits", {"messages": odd}), AS_OF).orderBy("pos").collect()
    assert [r["reason"] for r in rows] == ["missing_id"] * 5 + [None, None, None]
    assert [r["like_count"] for r in rows[5:]] == [46, 0, 46]
    tweets = [{**TWEET, "public_metrics": 5}, 3, TWEET]
    got = x.posts(pages("x", {"data": tweets, "includes": {"users": [3, USER]}}), AS_OF).orderBy("pos").collect()
    assert [(r["like_count"], r["author_handle"]) for r in got] == [(None, "quietfox"), (731, "quietfox")]
    posts = [{"data": {**POST, "ups": "many"}}, "nothing", {"data": POST}]
    assert reddit.posts(pages("reddit", {"data": {"children": posts}}), AS_OF).count() == 2


def test_a_failing_parser_leaves_the_others(pages):
    def broken(raw, as_of, since):
        raise RuntimeError("no such platform")

    raw = pages("x", {"data": [TWEET]}).union(pages("reddit", listing(POST)))
    got = landed.collect_posts(raw, AS_OF, SINCE, {"x": x.posts, "reddit": broken})
    assert [r["source"] for r in got.collect()] == ["x"]


def test_registered_parser_is_used(pages, spark):
    landed.register_parser("forum", lambda raw, as_of, since: raw.select(F.lit("forum").alias("source"), F.col("body").alias("text")))
    try:
        assert landed.collect_posts(pages("forum", "hello"), AS_OF).filter("source = 'forum'").first()["text"] == "hello"
    finally:
        del landed.PARSERS["forum"]


def test_page_cap_and_take_while(pages):
    more = {"cursor": {"max": 9}}
    new = {**MESSAGE, "created_at": "2025-01-19T00:00:00Z"}
    old = {**MESSAGE, "created_at": "2025-01-01T00:00:00Z"}
    five = pages("stocktwits", *[{"messages": [new], **more}] * 5)
    assert sorted(r["page_no"] for r in landed.page_cap(five).collect()) == [0, 1, 2]
    stop = pages("stocktwits", {"messages": [new], **more}, {"messages": [new], "cursor": {"max": 0}}, {"messages": [new], **more})
    assert sorted(r["page_no"] for r in landed.page_cap(stop).collect()) == [0, 1]
    aged = pages("stocktwits", {"messages": [new, old]}, {"messages": [old]}, {"messages": [new]})
    kept = landed.page_take_while(aged, stocktwits.page_yields(AS_OF, SINCE))
    assert sorted(r["page_no"] for r in kept.collect()) == [0, 1]


def test_validation_and_quarantine(pages, spark):
    rows = [("x", "1", "a", AS_OF, "t"), ("myspace", "1", "a", AS_OF, "t"), ("x", None, "a", AS_OF, "t"), ("x", "1", "a", None, "t")]
    df = spark.createDataFrame(rows, "source string, platform_id string, author_id string, created_at timestamp, text string")
    assert [r["is_valid"] for r in landed.validate_posts(df).collect()] == [True, False, False, False]
    raw = pages("x", {"data": [TWEET, {}]}, "{broken").union(pages("reddit", "nonsense"))
    threads = pages("reddit", thread(comment(1), comment(2, author="[deleted]")), "[{}, {", kind="comments", post_id="q8zt1")
    more = threads.union(pages("myspace", "{}")).union(pages("reddit", listing(POST), kind="wiki"))
    refused = sorted((r["source"], r["post_id"] or "", -1 if r["pos"] is None else r["pos"], r["reason"]) for r in landed.quarantine(more, AS_OF).collect())
    assert refused == [("myspace", "", -1, "unknown_source"), ("reddit", "", -1, "unknown_kind"),
                       ("reddit", "q8zt1", -1, "bad_json"), ("reddit", "q8zt1", 1, "deleted")]
    got = sorted((r["source"], r["page_no"], r["reason"]) for r in landed.quarantine(raw, AS_OF).collect())
    assert got == [("reddit", 0, "bad_json"), ("x", 0, "missing_id"), ("x", 1, "bad_json")]


def test_outcomes_in_one_pass(pages, spark, tmp_path):
    """Every item and page comes out once, as the parsers and the quarantine have it, from one scan."""
    raw = pages("x", {"data": [TWEET, {}, 5], "includes": {"users": [USER, 3]}}, "{broken", {"data": []}).union(pages("reddit", "nonsense", listing(POST, {**POST, "author": "[deleted]"})))
    raw = raw.union(pages("reddit", thread(*[comment(i, kind="more" if i == 2 else "t1") for i in range(13)]), "[{}, {", kind="comments", post_id="q8zt1"))
    raw = raw.union(pages("reddit", thread(comment(50)), kind="comments", post_id="elsewhere"))
    raw = raw.union(pages("stocktwits", {"messages": [MESSAGE, {**MESSAGE, "body": None}]}, "5")).union(pages("myspace", "{}")).union(pages("reddit", listing(POST), kind="wiki"))
    path = str(tmp_path / "pages")
    raw.write.parquet(path)
    raw = spark.read.parquet(path)
    found = outcomes.outcomes(raw, AS_OF, SINCE)
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    rows = found.collect()
    refused = sorted(str((r["source"], r["page_no"], r["post_id"], r["pos"], r["reason"])) for r in rows if r["tag"] != "post")
    assert refused == sorted(str((r["source"], r["page_no"], r["post_id"], r["pos"], r["reason"])) for r in landed.quarantine(raw, AS_OF, SINCE).collect())
    assert all((r["body"] is not None) == (r["tag"] == "refused_page") and (r["item"] is not None) == (r["tag"] == "refused_item") for r in rows)
    outcomes.create(spark, str(tmp_path / "o"))
    outcomes.write_outcomes(raw, str(tmp_path / "o"), 0, AS_OF, SINCE)
    fields = ["source", "platform_id", "author_handle", "created_at", "text", "lang", "like_count", "reply_to_id", "follower_count", "permalink"]
    wanted = landed.collect_posts(raw.filter("source != 'myspace' and kind != 'wiki'"), AS_OF, SINCE).select(fields)
    assert sorted(map(str, outcomes.accepted_posts(spark, str(tmp_path / "o")).select(fields).collect())) == sorted(map(str, wanted.collect()))


def test_dead_letters_leave_when_replayed(pages, spark, tmp_path):
    path = str(tmp_path)
    outcomes.create(spark, path)
    outcomes.write_outcomes(pages("x", "{broken", {"data": [TWEET]}, "{also broken"), path, 0, AS_OF, SINCE)
    waiting = lambda: [(r["page_no"], r["batch"]) for r in outcomes.dead_letters(spark, path).orderBy("page_no", "batch").collect()]
    posts = lambda: sorted(r["platform_id"] for r in outcomes.accepted_posts(spark, path).collect())
    assert waiting() == [(0, 0), (2, 0)] and posts() == ["t3"]
    # The first page is put right, the second was never refused, the third is still broken.
    fixed = pages("x", {"data": [tweet(7, author_id="a"), {}]}, {"data": [tweet(8, author_id="a")]}, "{still broken")
    for _ in range(2):  # a repeated batch replaces itself
        outcomes.replay(fixed, path, 1, AS_OF, SINCE)
        assert waiting() == [(2, 1)] and posts() == ["t3", "t7"]
    assert outcomes.read_outcomes(spark, path).filter("tag = 'refused_item'").count() == 1


def test_dedupe_keeps_first_by_term_page_place(spark):
    rows = [("reddit", "1", 1, 0, 0, "late term"), ("reddit", "1", 0, 2, 5, "late page"), ("reddit", "1", 0, 1, 3, "first"), ("reddit", "2", 4, 0, 0, "only")]
    df = spark.createDataFrame(rows, "source string, platform_id string, term_no int, page_no int, pos int, text string")
    assert sorted(r["text"] for r in landed.dedupe_keep_first(df, "source", "platform_id").collect()) == ["first", "only"]


def test_landed_files_round_trip(pages, spark, tmp_path):
    raw = pages("x", {"data": [TWEET]}).union(pages("reddit", listing(POST)))
    landed.write_landed(raw, str(tmp_path / "landed"))
    back = landed.scan_landed(spark, str(tmp_path / "landed"))
    assert sorted(map(tuple, back.select(*raw.columns).collect())) == sorted(map(tuple, raw.collect()))


def test_iso_forms_and_numbers_beyond_any_time(pages, spark):
    iso = [("2024-01-15", "2024-01-15"), ("2024-01-15 10:00:00", "2024-01-15T10:00:00"), ("2024-01-15T10:00", "2024-01-15T10:00"),
           ("2024-01-15T10", "2024-01-15T10:00"), ("2024-01-15T10:00:00+0530", "2024-01-15T10:00:00"), ("2024-01-15 10:00-05", "2024-01-15T10:00")]
    messages = stocktwits.posts(pages("stocktwits", {"messages": [{**MESSAGE, "created_at": w} for w, _ in iso]}), AS_OF)
    assert [r["created_at"] for r in messages.orderBy("pos").collect()] == [dt.datetime.fromisoformat(t) for _, t in iso]
    times = [1e14, -1e14, 1e300, 253402300800.0, POST["created_utc"]]
    found = reddit.post_candidates(pages("reddit", listing(*[{**POST, "created_utc": t} for t in times])), AS_OF).orderBy("pos").collect()
    assert [r["reason"] for r in found] == ["bad_time"] * 4 + [None]


def test_posts_found_twice_are_collected_once(pages):
    twice = pages("reddit", listing(POST), listing(POST))
    assert landed.collect_posts(twice, AS_OF).count() == 1
