"""Cleaning, ticker extraction and post predicates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketpulse.constants import (
    JAVA_WHITESPACE,
    MAX_DOLLAR_SIGNS,
    MIN_POST_LENGTH,
    WHITESPACE_CHARACTERS,
)

_URL = rf"(?U)https?://[^{JAVA_WHITESPACE}]+"
_GAP = rf"(?U)[{JAVA_WHITESPACE}]+"
_CASHTAG = r"\$([A-Z]{1,5})(?![A-Z])"
_NO_STRINGS = "array<string>"


def strip(text: Column) -> Column:
    """Trim any white space, not only blanks."""
    return F.btrim(text, F.lit(WHITESPACE_CHARACTERS))


def normalize_text(text: Column) -> Column:
    """Delete links, collapse white space, trim."""
    without_links = F.when(F.contains(text, F.lit("http")), F.regexp_replace(text, _URL, "")).otherwise(text)
    return F.trim(F.regexp_replace(without_links, _GAP, " "))


def cashtags(text: Column) -> Column:
    """Distinct tickers written as $ plus one to five capitals."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(_CASHTAG), F.lit(1)))
    return F.when(F.contains(text, F.lit("$")), found).otherwise(F.array().cast(_NO_STRINGS))


def symbol_mention(upper: Column, symbol: Column) -> Column:
    """The symbol stands anywhere in the upper-cased text. A matching cashtag is one such place."""
    return F.coalesce((symbol != "") & F.contains(upper, symbol), F.lit(False))


def company_mention(upper: Column, company: Column) -> Column:
    """The company name stands anywhere in the text, in any case."""
    return F.coalesce((company != "") & F.contains(upper, F.upper(company)), F.lit(False))


def extract_symbols(
    text: Column, upper: Column | None = None, symbol: Column | None = None, company: Column | None = None
) -> Column:
    """Sorted set of cashtags, plus the instrument's symbol where it or its company is mentioned."""
    tags = cashtags(text)
    if symbol is None:
        return F.array_sort(tags)
    upper = F.upper(text) if upper is None else upper
    mentioned = symbol_mention(upper, symbol)
    if company is not None:
        mentioned = mentioned | company_mention(upper, company)
    own = F.coalesce(symbol, F.lit(""))
    return F.array_sort(F.when(mentioned, F.array_union(tags, F.array(own))).otherwise(tags))


def cleaned(text: Column, symbol: Column | None = None, company: Column | None = None) -> Column:
    """One-element array of struct<text, symbols> for use with inline.

    A generator, because the filters that follow test these two several times: the optimizer would put the whole
    expressions in place of each mention, and normalize every text again and again. Past a generator they are columns.
    """
    cased = F.transform(F.array(normalize_text(text)), lambda t: F.struct(t.alias("text"), F.upper(t).alias("upper")))
    return F.transform(cased, lambda p: F.struct(
        p["text"].alias("text"), extract_symbols(p["text"], p["upper"], symbol, company).alias("symbols")))


def has_symbols(symbols: Column) -> Column:
    return F.size(symbols) > 0


def is_short(text: Column, symbols: Column) -> Column:
    """Little more than a ticker."""
    return (F.length(text) < MIN_POST_LENGTH) & has_symbols(symbols)


def dollar_signs(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("$"), F.lit("")))


def has_many_dollars(text: Column) -> Column:
    return dollar_signs(text) > MAX_DOLLAR_SIGNS


def is_probable_bot(text: Column, symbols: Column) -> Column:
    return is_short(text, symbols) | has_many_dollars(text)


def outcome(text: Column, symbols: Column) -> Column:
    """The first rule a post fails, or "processed"."""
    return (
        F.when(~has_symbols(symbols), "no_symbols")
        .when(is_probable_bot(text, symbols), "probable_bots")
        .otherwise("processed")
    )
