"""Which posts contain which strings: a join on substrings, and the searches built on it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketpulse.constants import (
    SEARCH_LOOKBACK_DAYS,
    SEARCH_RESULTS_PER_TERM,
    SUBREDDITS,
)
from marketpulse.functions.text import strip
from marketpulse.operators.sizes import is_small
from marketpulse.schemas import POST_KEY
from marketpulse.sources.parsing import literal_time

Find = Callable[..., DataFrame]

# Up to this many needles stand in the plan as literals; more go through the distributed join.
INLINE_NEEDLES = 256
# Lengths of the text pieces the distributed join compares. A needle uses the longest that fits in it.
PIECE_LENGTHS = (1, 2, 3, 5, 8)
SALTS = 16


def substring_join(
    posts: DataFrame, needles: DataFrame, carry: tuple[str, ...] = (), same: dict[str, str] | None = None,
    inline_limit: int = INLINE_NEEDLES,
) -> DataFrame:
    """Posts with each needle found in their upper-cased text: post key, carried post columns, needle columns.

    `needles` has a column `needle`, upper-cased and not empty, which the result leaves out; equal results of one post
    appear once. `same` names needle columns that must equal a post column. No pair is tried that does not share a
    piece of text, but for a list of needles short enough to be tested in place.
    """
    upper = posts.select(*POST_KEY, *carry, F.upper("text").alias("_upper"))
    probe = needles.limit(inline_limit + 1).collect()
    if len(probe) <= inline_limit:
        return _inline(upper, needles, probe, same or {}).drop("_upper")
    return _by_pieces(upper, needles, same or {})


def _inline(upper: DataFrame, needles: DataFrame, rows: list, same: dict[str, str]) -> DataFrame:
    """Few needles: tested row by row, without any join or shuffle."""
    fields = needles.schema.fields
    out = [f.name for f in fields if f.name != "needle"]
    literal = F.array(*[
        F.struct(*[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in fields]) for row in rows])
    literal = literal.cast(f"array<{needles.schema.simpleString()}>")

    def found(n: Column) -> Column:
        condition = F.contains(F.col("_upper"), n["needle"])
        for needle_column, post_column in same.items():
            condition = (n[needle_column] == F.col(post_column)) & condition
        return condition

    kept = F.transform(F.filter(literal, found), lambda n: F.struct(*[n[c].alias(c) for c in out]))
    return upper.select("*", F.inline(F.array_distinct(kept)))


def _piece_length(needle: Column) -> Column:
    length = F.lit(PIECE_LENGTHS[0])
    for n in PIECE_LENGTHS[1:]:
        length = F.when(F.length(needle) >= n, F.lit(n)).otherwise(length)
    return length


def _by_pieces(upper: DataFrame, needles: DataFrame, same: dict[str, str]) -> DataFrame:
    """Many needles: an equi join of text pieces with the heads of the needles, then an exact test.

    Each post yields every distinct piece once per length in use. Needles that can be broadcast are looked up as the
    pieces come, with the text still at hand, so no piece is ever shuffled. More needles than that are joined by a
    shuffle of the pieces without the text, which is fetched by key for the pairs that have a piece in common; pieces
    that many posts share are spread over salts, and the needles, the smaller side, are repeated per salt.
    """
    heads = needles.withColumn("_length", _piece_length(F.col("needle"))).withColumn(
        "_piece", F.substring(F.col("needle"), F.lit(1), F.col("_length")))
    lengths = sorted(row["_length"] for row in heads.select("_length").distinct().collect())
    heads = heads.drop("_length")

    # A look-ahead takes the piece at every place in one pass over the text.
    pieces = F.explode(F.array_distinct(F.flatten(F.array(*[
        F.regexp_extract_all(F.col("_upper"), F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in lengths])))).alias("_piece")
    if is_small(heads):
        met = upper.select("*", pieces).join(F.broadcast(heads), "_piece").drop("_piece")
    else:
        salt = F.pmod(F.xxhash64(*POST_KEY), F.lit(SALTS))
        left = upper.select(*POST_KEY, salt.alias("_salt"), pieces)
        right = heads.withColumn(
            "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        met = left.join(right, ["_piece", "_salt"]).drop("_piece", "_salt").join(upper, list(POST_KEY))
    tested = met.filter(F.contains(F.col("_upper"), F.col("needle")))
    for needle_column, post_column in same.items():
        tested = tested.filter(F.col(needle_column) == F.col(post_column))
    return tested.drop("_upper", "needle").distinct()


def mention_join(posts: DataFrame, instruments: DataFrame, inline_limit: int = INLINE_NEEDLES, find: Find | None = None) -> DataFrame:
    """Post key and symbol for every instrument a post mentions, by symbol or by company name.

    find: another way to join substrings, such as a stored index (`store.search.finder`).
    """
    by_symbol = instruments.select("symbol", F.col("symbol").alias("needle"))
    by_company = instruments.select(F.coalesce("symbol", F.lit("")).alias("symbol"), F.upper("company_name").alias("needle"))
    needles = by_symbol.unionByName(by_company).filter(F.col("needle") != "").distinct()
    return (find or substring_join)(posts, needles, inline_limit=inline_limit)


def _stream_symbol(symbol: Column) -> Column:
    """The name of a symbol's StockTwits stream."""
    return F.regexp_replace(F.upper(strip(symbol)), r"^\$+", "")


def search_terms(instruments: DataFrame) -> DataFrame:
    """What each platform is asked for an instrument: (symbol, source, term_no, term)."""
    symbol, company = F.coalesce("symbol", F.lit("")), F.coalesce("company_name", F.lit(""))
    differs = (company != "") & (F.upper(company) != symbol)
    tagged = F.concat(F.lit("$"), symbol)
    quoted = F.concat(F.lit('"'), company, F.lit('"'))
    either = F.array_compact(F.array(
        F.when(symbol != "", tagged), F.when((company != "") & (company != symbol), quoted)))
    x_query = F.concat(F.lit("("), F.array_join(either, " OR "), F.lit(") -is:retweet lang:en"))
    stream = _stream_symbol(symbol)

    def term(source: str, number: int, value: Column, condition: Column) -> Column:
        return F.when(condition, F.struct(
            F.lit(source).alias("source"), F.lit(number).alias("term_no"), value.alias("term")))

    terms = F.array_compact(F.array(
        term("x", 0, x_query, (symbol != "") | (company != "")),
        term("reddit", 0, tagged, symbol != ""),
        term("reddit", 1, symbol, symbol != ""),
        term("reddit", 2, company, differs),
        term("stocktwits", 0, stream, F.length(stream).between(1, 5)),
        term("trends", 0, symbol, symbol != ""),
        term("trends", 1, company, (symbol != "") & differs),
    ))
    return instruments.select("symbol", F.inline(terms))


def search_match(
    posts: DataFrame, instruments: DataFrame, as_of: dt.datetime,
    per_term: int = SEARCH_RESULTS_PER_TERM, inline_limit: int = INLINE_NEEDLES, find: Find | None = None,
) -> DataFrame:
    """Landed posts that the platforms' searches would return for each instrument, with the matching term.

    X takes English posts that are not reposts; Reddit the newest posts of a week per community and term; StockTwits
    the posts tagged with the symbol. Matching ignores case. find: another way to join substrings, such as a stored index.
    """
    symbol, company = F.coalesce("symbol", F.lit("")), F.coalesce("company_name", F.lit(""))
    differs = (company != "") & (F.upper(company) != symbol)
    tagged, stream = F.concat(F.lit("$"), symbol), _stream_symbol(symbol)

    def term(source: str, number: int, value: Column, condition: Column) -> Column:
        return F.when(condition, F.struct(F.lit(source).alias("term_source"), F.lit(number).alias("term_no"),
                                          F.upper(value).alias("needle")))

    terms = F.array_compact(F.array(
        term("x", 0, tagged, symbol != ""),
        term("x", 0, company, (company != "") & (company != symbol)),
        term("reddit", 0, tagged, symbol != ""),
        term("reddit", 1, symbol, symbol != ""),
        term("reddit", 2, company, differs),
        term("stocktwits", 0, F.concat(F.lit("$"), stream), F.length(stream).between(1, 5)),
    ))
    needles = instruments.select("symbol", F.inline(terms)).distinct()
    week = literal_time(as_of - dt.timedelta(days=SEARCH_LOOKBACK_DAYS))
    searchable = posts.filter(
        ((F.col("source") == "x") & (F.col("lang") == "en") & F.col("repost_of_id").isNull())
        | ((F.col("source") == "reddit") & F.col("subreddit").isin(*SUBREDDITS) & (F.col("created_at") >= week))
        | (F.col("source") == "stocktwits")
    )
    found = (find or substring_join)(
        searchable, needles, carry=("subreddit", "created_at"), same={"term_source": "source"}, inline_limit=inline_limit)
    newest = Window.partitionBy("symbol", "term_no", "subreddit").orderBy(F.desc("created_at"), "platform_id")
    reddit = (
        found.filter(F.col("source") == "reddit")
        .withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= per_term)
    )
    columns = [*POST_KEY, "symbol", "term_no"]
    return found.filter(F.col("source") != "reddit").select(*columns).unionByName(reddit.select(*columns))
