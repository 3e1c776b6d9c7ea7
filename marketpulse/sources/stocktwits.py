"""Symbol-stream pages of StockTwits."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpulse.schemas import STOCKTWITS_MESSAGE, STOCKTWITS_STREAM
from marketpulse.sources.parsing import accepted, as_candidates, literal_time, missing, page_items
from marketpulse.sources.timestamps import stocktwits_created_at


def _reason(message: Column, as_of: dt.datetime, since: dt.datetime | None) -> Column:
    created_at = stocktwits_created_at(message["created_at"], literal_time(as_of))
    too_old = F.lit(False) if since is None else created_at < literal_time(since)
    return (
        F.when(too_old, "too_old")
        .when(message["id"].isNull() | (message["id"] == 0), "missing_id")
        .when(missing(message["body"]), "missing_text")
    )


def page_yields(as_of: dt.datetime, since: dt.datetime) -> Column:
    """Whether a page holds any message that would be accepted."""
    messages = F.from_json("body", STOCKTWITS_STREAM)["messages"]
    accepted_one = F.exists(
        F.transform(messages, lambda text: F.from_json(text, STOCKTWITS_MESSAGE)),
        lambda message: _reason(message, as_of, since).isNull())
    return F.coalesce(accepted_one, F.lit(False))


def item(message: Column, as_of: dt.datetime, since: dt.datetime | None = None) -> tuple[Column, dict[str, Column]]:
    """Why a message is refused (null where it is not), and its fields."""
    user = message["user"]
    tag = message["entities"]["sentiment"]["basic"]
    tagged = F.concat(F.lit("["), F.upper(tag), F.lit("] "), message["body"])
    handle = F.coalesce(user["username"], F.lit(""))
    message_id = message["id"].cast("string")
    return _reason(message, as_of, since), dict(
        source=F.lit("stocktwits"),
        platform_id=message_id,
        author_id=F.coalesce(user["id"].cast("string"), F.lit("")),
        author_handle=handle,
        created_at=stocktwits_created_at(message["created_at"], literal_time(as_of)),
        text=F.when(missing(tag), message["body"]).otherwise(tagged),
        lang=F.lit("en"),
        like_count=F.coalesce(F.get_json_object(message["likes"], "$.total").try_cast("int"), F.lit(0)),
        follower_count=F.coalesce(user["followers"], F.lit(0)),
        permalink=F.when(handle != "", F.concat(
            F.lit("https://stocktwits.com/"), handle, F.lit("/message/"), message_id)),
    )


def candidates(raw: DataFrame, as_of: dt.datetime, since: dt.datetime | None = None) -> DataFrame:
    df = page_items(raw, STOCKTWITS_STREAM, F.col("page")["messages"], STOCKTWITS_MESSAGE)
    reason, fields = item(F.col("item"), as_of, since)
    return as_candidates(df, reason, **fields)


def posts(raw: DataFrame, as_of: dt.datetime, since: dt.datetime | None = None) -> DataFrame:
    return accepted(candidates(raw, as_of, since))
