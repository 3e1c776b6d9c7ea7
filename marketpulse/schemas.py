"""Schemas of posts, keyed tables and landed platform responses."""

from pyspark.sql import types as T

_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


POST_KEY = ("source", "platform_id")

SOCIAL_POST = _struct(
    source=_S, platform_id=_S, author_id=_S, author_handle=_S, created_at=T.TimestampType(), text=_S,
    symbols=T.ArrayType(_S), urls=T.ArrayType(_S), lang=_S, reply_to_id=_S, repost_of_id=_S, like_count=_I,
    reply_count=_I, repost_count=_I, follower_count=_I, permalink=_S,
)
REQUIRED_POST_FIELDS = ("source", "platform_id", "author_id", "created_at", "text")

SENTIMENT_SCORE = _struct(polarity=_D, subjectivity=_D, sarcasm_prob=_D, confidence=_D, model=_S)

RESOLVED_INSTRUMENT = _struct(symbol=_S, cik=_S, isin=_S, figi=_S, company_name=_S)

# One landed response per row. `symbol` and `company_name` say for whom the page was fetched,
# `kind` is "search" or "comments", `post_id` is the thread of a comments page.
LANDED_PAGE = _struct(
    source=_S, kind=_S, symbol=_S, company_name=_S, term=_S, term_no=_I, page_no=_I, post_id=_S,
    fetched_at=T.TimestampType(), body=_S,
)

CORRUPT = "_bad"
_ITEMS = T.ArrayType(_S)

# Pages keep their items as JSON text, and each item is read by itself: a field of the wrong kind then costs that field
# of that item, and not its neighbours.
X_PAGE = _struct(data=_ITEMS, includes=_struct(users=_ITEMS), **{CORRUPT: _S})
X_POST = _struct(
    id=_S, text=_S, created_at=_S, author_id=_S, lang=_S,
    public_metrics=_struct(like_count=_I, reply_count=_I, retweet_count=_I),
)
X_USER = _struct(id=_S, username=_S, public_metrics=_struct(followers_count=_I))

REDDIT_LISTING = _struct(data=_struct(children=_ITEMS), **{CORRUPT: _S})
REDDIT_POST = _struct(data=_struct(
    id=_S, title=_S, selftext=_S, author=_S, created_utc=_D, ups=_I, num_comments=_I, permalink=_S,
))

REDDIT_THREAD = T.ArrayType(_struct(data=_struct(children=_ITEMS)))
REDDIT_COMMENT = _struct(
    kind=_S, data=_struct(id=_S, body=_S, author=_S, created_utc=_D, ups=_I, permalink=_S),
)

STOCKTWITS_STREAM = _struct(messages=_ITEMS, **{CORRUPT: _S})
STOCKTWITS_MESSAGE = _struct(
    id=_L, body=_S, created_at=_S, entities=_struct(sentiment=_struct(basic=_S)),
    # Not always an object; read in a second step.
    likes=_S,
    user=_struct(id=_L, username=_S, followers=_I),
)
