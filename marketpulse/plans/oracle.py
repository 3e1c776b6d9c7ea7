"""The registered queries in SQL for another engine, written from the tables directly."""

from __future__ import annotations

import re

from marketpulse.constants import COMPANY_TICKERS, NEGATIVE_WORDS, POSITIVE_WORDS, SARCASM_CUES, SUBREDDITS
from marketpulse.plans.views import COMMUNITIES, CUES, PAGE_DOCS, QUERIES, TICKERS, WINDOW_UNITS

AS_OF = "TIMESTAMP '2024-01-31'"
WEEK = "TIMESTAMP '2024-01-24'"
# White space as a class of this engine's patterns.
WS = (r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def items(values) -> str:
    return "[" + ", ".join(text(x) for x in values) + "]"


def pick(values, index: str) -> str:
    return f"{items(values)}[({index}) % {len(values)} + 1]"


def up(value: str) -> str:
    return f"replace(upper({value}), 'ẞ', 'SS')"


def stamp(value: str) -> str:
    return f"strftime({value}, '%Y-%m-%d %H:%M:%S')"


def normalized(value: str) -> str:
    return f"trim(regexp_replace(regexp_replace({value}, 'https?://[^{WS}]+', '', 'g'), '[{WS}]+', ' ', 'g'))"


def stripped(value: str) -> str:
    return f"regexp_replace(regexp_replace({value}, '^[{WS}]+', ''), '[{WS}]+$', '')"


def tags(value: str) -> str:
    return rf"list_distinct(list_filter(regexp_extract_all({value}, '\$([A-Z]+)', 1), lambda s: length(s) <= 5))"


def crc32(value: str) -> str:
    """Of a text in ASCII, byte by byte and bit by bit."""
    return f"""xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({value}, ''), lambda c: ascii(c)::UBIGINT)),
      lambda acc, b: list_reduce(list_prepend(xor(acc, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384::UBIGINT * (x & 1) + z))),
      4294967295::UBIGINT)"""


def hits(value: str, words) -> str:
    return "(" + " + ".join(f"contains({value}, {text(w)})::BIGINT" for w in words) + ")"


def company(ticker: str) -> str:
    whens = " ".join(f"WHEN {text(t)} THEN {text(c)}" for c, t in COMPANY_TICKERS.items())
    return f"CASE {ticker} {whens} END"


def symbols(value: str, ticker: str) -> str:
    upper = up(value)
    return (f"list_sort(CASE WHEN contains({upper}, {ticker}) OR contains({upper}, {company(ticker)}) "
            f"THEN list_distinct(list_append({tags(value)}, {ticker})) ELSE {tags(value)} END)")


def sarcasm(value: str, lowered: str) -> str:
    loud = f"contains({value}, '?!') OR contains({value}, '!!!')"
    cues = ", ".join(f"CASE WHEN contains({lowered}, {text(c)}) THEN {w}::DOUBLE ELSE 0 END" for c, w in SARCASM_CUES.items())
    return f"coalesce(nullif(greatest({cues}, CASE WHEN {loud} THEN 0.5::DOUBLE ELSE 0 END), 0), 0.05::DOUBLE)"


OUTCOME = """CASE WHEN len(symbols) = 0 THEN 'no_symbols'
    WHEN length(text) < 20 OR length(text) - length(replace(text, '$', '')) > 5 THEN 'probable_bots'
    ELSE 'processed' END"""

D = "doc_id"
POST_TEXT = f"""CASE WHEN {D} % 17 = 0 THEN '$' || {pick(TICKERS, D)}
    WHEN {D} % 13 = 0 THEN text || ' $A $B $C $D $E $F '
    WHEN {D} % 4 = 0 THEN text
    ELSE text || '  $' || {pick(TICKERS, D)} || ' ' || {pick(CUES, D)}
        || CASE WHEN {D} % 11 = 0 THEN ' https://ex.com/a/s?q=1' ELSE '' END END"""

CTES: dict[str, str] = {}
CTES["p"] = f"""SELECT {D}, {pick(('x', 'reddit', 'stocktwits'), D)} AS source, {D}::VARCHAR AS platform_id,
    'u' || ({D} % 97) AS author_id, TIMESTAMP '2024-01-01' + to_minutes({D} * 7919 % 43200) AS created_at,
    {pick(TICKERS, D)} AS ticker, {POST_TEXT} AS text, lang, CASE WHEN {D} % 59 = 0 THEN '1' END AS repost_of_id,
    {pick(COMMUNITIES, D)} AS subreddit, {D} % 50 AS like_count, {D} % 97 * 10 AS follower_count FROM documents"""
CTES["norm"] = f"SELECT * REPLACE ({normalized('text')} AS text) FROM p"
CTES["sym"] = f"SELECT *, {symbols('text', 'ticker')} AS symbols FROM norm"
CTES["cleaned"] = f"SELECT *, {OUTCOME} AS outcome FROM sym"


def scores(source: str) -> str:
    """Score columns in stored precision beside all columns of a table with text."""
    return f"""SELECT * EXCLUDE (pos, neg, cue),
      CASE WHEN blank OR pos + neg = 0 THEN 0 ELSE (pos - neg)::DOUBLE / (pos + neg) END::FLOAT AS polarity,
      CASE WHEN blank THEN 0 WHEN pos + neg = 0 THEN 0.2 ELSE least(1.0::DOUBLE, (pos + neg) / 3.0::DOUBLE) END::FLOAT AS subjectivity,
      CASE WHEN blank THEN 0 ELSE cue END::FLOAT AS sarcasm_prob,
      CASE WHEN blank THEN 0 WHEN pos + neg = 0 THEN 0.3 ELSE least(0.7::DOUBLE, (pos + neg) / 5.0::DOUBLE) END::FLOAT AS confidence,
      CASE WHEN blank THEN 'empty' ELSE 'heuristic' END AS model
    FROM (SELECT *, {stripped("coalesce(text, '')")} = '' AS blank, {hits('lower(text)', POSITIVE_WORDS)} AS pos,
      {hits('lower(text)', NEGATIVE_WORDS)} AS neg, {sarcasm('text', 'lower(text)')} AS cue FROM {source})"""


SCORE_OUT = """round(polarity::DOUBLE, 6) AS polarity, round(subjectivity::DOUBLE, 6) AS subjectivity,
    round(sarcasm_prob::DOUBLE, 6) AS sarcasm_prob, round(confidence::DOUBLE, 6) AS confidence, model"""

CTES["stored"] = "SELECT * FROM cleaned WHERE outcome = 'processed'"
CTES["scored_all"] = scores("cleaned")
CTES["scored"] = """SELECT * REPLACE (CASE WHEN doc_id % 23 = 0 OR (ticker = 'MSFT' AND source = 'reddit') THEN NULL
    ELSE polarity END AS polarity) FROM scored_all WHERE outcome = 'processed'"""
CTES["recent"] = f"SELECT * FROM scored WHERE created_at >= {WEEK}"
CTES["by_source"] = """SELECT symbol, source, count(*) AS n, avg(polarity::DOUBLE) AS avg_polarity,
    stddev_samp(polarity::DOUBLE) AS stddev_polarity
    FROM (SELECT unnest(symbols) AS symbol, source, polarity FROM recent) GROUP BY ALL"""
CTES["weighted"] = """SELECT symbol, sum(n)::BIGINT AS count, sum(coalesce(avg_polarity, 0) * n) / sum(n) AS weighted_sentiment
    FROM by_source GROUP BY symbol"""

# Posts as they should come out of the landed pages.
CTES["page"] = f"""SELECT *, {D} // {PAGE_DOCS} AS page_no, CASE WHEN {D} % 37 = 0 THEN '' ELSE text END AS ltext,
    CASE WHEN {D} % 29 = 0 AND source <> 'reddit' THEN {AS_OF} ELSE created_at END AS seen_at,
    ticker = 'NVDA' AND ({D} // {PAGE_DOCS}) % 3 = 1 AS broken FROM p"""
CTES["landed_x"] = f"""SELECT {D}, ticker AS symbol, page_no, platform_id, author_id,
    CASE WHEN author_id LIKE '%3' THEN '' ELSE 'h_' || author_id END AS author_handle, seen_at AS created_at,
    CASE WHEN {D} % 7 = 3 THEN 'en' ELSE lang END AS lang, like_count,
    CASE WHEN author_id NOT LIKE '%3' THEN 'https://twitter.com/h_' || author_id || '/status/' || platform_id END AS permalink,
    ltext AS text, {D} % 7 AS reply_count, {D} % 11 AS repost_count,
    CASE WHEN author_id NOT LIKE '%3' THEN follower_count END AS follower_count
    FROM page WHERE source = 'x' AND NOT broken AND {D} % 31 <> 0 AND {D} % 37 <> 0"""
REDDIT_TEXT = f"""{stripped("'T' || platform_id || chr(10) || ltext")}"""
CTES["landed_reddit"] = f"""SELECT {D}, ticker AS symbol, page_no, 'post_' || platform_id AS platform_id, author_id,
    author_id AS author_handle, created_at, 'en' AS lang, CASE WHEN {D} % 23 = 0 THEN 0 ELSE like_count END AS like_count,
    CASE WHEN {D} % 43 <> 0 THEN 'https://reddit.com/r/' || subreddit || '/comments/' || platform_id END AS permalink,
    {REDDIT_TEXT} AS text, {D} % 7 AS reply_count, NULL::BIGINT AS repost_count, NULL::BIGINT AS follower_count
    FROM page WHERE source = 'reddit' AND NOT broken AND {D} % 31 <> 0 AND {D} % 19 <> 0 AND {D} % 41 <> 0"""
CTES["landed_st"] = f"""SELECT {D}, ticker AS symbol, page_no, platform_id, ({D} % 97)::VARCHAR AS author_id,
    CASE WHEN {D} % 43 = 0 THEN '' ELSE 'h_' || author_id END AS author_handle, seen_at AS created_at, 'en' AS lang,
    CASE WHEN {D} % 23 = 0 THEN 0 ELSE like_count END AS like_count,
    CASE WHEN {D} % 43 <> 0 THEN 'https://stocktwits.com/h_' || author_id || '/message/' || platform_id END AS permalink,
    CASE WHEN {D} % 5 = 0 THEN '[BULLISH] ' WHEN {D} % 7 = 1 THEN '[BEARISH] ' ELSE '' END || ltext AS text,
    NULL::BIGINT AS reply_count, NULL::BIGINT AS repost_count,
    CASE WHEN {D} % 47 = 0 THEN 0 ELSE follower_count END AS follower_count
    FROM page WHERE source = 'stocktwits' AND NOT broken AND {D} % 31 <> 0 AND {D} % 37 <> 0"""
CTES["landed"] = """SELECT 'x' AS source, * FROM landed_x UNION ALL SELECT 'reddit', * FROM landed_reddit
    UNION ALL SELECT 'stocktwits', * FROM landed_st"""
CTES["landed_sym"] = f"""SELECT *, {symbols('text', 'symbol')} AS symbols
    FROM (SELECT * REPLACE ({normalized('text')} AS text) FROM landed)"""
CTES["landed_clean"] = f"SELECT *, {OUTCOME} AS outcome FROM landed_sym"
CTES["landed_scored"] = scores("(SELECT * FROM landed_clean WHERE outcome = 'processed')")
CTES["landed_rescored"] = scores("""(SELECT * REPLACE (replace(text, 'bullish moon', 'crash dump sell') AS text)
    FROM landed_clean WHERE outcome = 'processed')""")

CTES["turns"] = f"""SELECT *, conv_id || '_' || turn AS id,
    CASE WHEN (conv_id + turn) % 13 = 0 THEN '[removed]' ELSE text END AS body,
    CASE WHEN (conv_id + turn) % 11 = 0 THEN '[deleted]' ELSE 'a' || turn END AS author,
    {AS_OF} - to_hours((conv_id * 7 + turn) % 240) AS created_at,
    row_number() OVER (PARTITION BY conv_id, (turn - 1) // 20 ORDER BY turn) AS place
    FROM conversations"""
CTES["comments"] = f"""SELECT * FROM turns WHERE turn > 0 AND place <= 10 AND role <> 'system' AND created_at >= {WEEK}
    AND author <> '[deleted]' AND body NOT IN ('[removed]', '[deleted]', '')"""

CTES["req"] = f"""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'C' || o_custkey ELSE {pick(QUERIES, 'o_orderkey')} END AS symbol,
    CASE WHEN o_orderkey % 41 = 0 THEN 'invalid' ELSE (o_orderkey % 40) || {pick(WINDOW_UNITS, 'o_custkey')} END AS "window" FROM orders"""
CTES["hours"] = """SELECT *, CASE WHEN NOT regexp_full_match(left("window", length("window") - 1), '[0-9]+') THEN NULL
    ELSE CASE lower(right("window", 1)) WHEN 'h' THEN left("window", length("window") - 1)::BIGINT
      WHEN 'd' THEN left("window", length("window") - 1)::BIGINT * 24
      WHEN 'w' THEN left("window", length("window") - 1)::BIGINT * 168 ELSE 24 END END AS hours FROM req"""
CTES["checked"] = """SELECT *, CASE WHEN length(symbol) < 1 THEN 'symbol_missing' WHEN length(symbol) > 10 THEN 'symbol_too_long'
    WHEN NOT regexp_full_match("window", '[0-9]+[hd]') THEN 'window_invalid' END AS reason FROM hours"""
CTES["cache"] = f"""SELECT 'C' || c_custkey AS query, 'S' || c_custkey AS symbol, c_name AS company_name,
    {AS_OF} - to_days((c_custkey % 3 + 6)::INT) AS cached_at FROM customer"""
NAME = r"regexp_replace(upper(query), '^\$+|\$+$', '', 'g')"
IS_TICKER = rf"regexp_full_match({NAME}, '\p{{L}}{{1,5}}')"
MAPPED = f"CASE {NAME} " + " ".join(f"WHEN {text(c)} THEN {text(t)}" for c, t in COMPANY_TICKERS.items()) + f" ELSE {NAME} END"


def resolved(source: str) -> str:
    return f"""SELECT *, CASE WHEN {IS_TICKER} THEN {NAME} ELSE {MAPPED} END AS symbol,
        CASE WHEN {IS_TICKER} THEN {NAME} ELSE query END AS company_name FROM {source}"""


CTES["asked"] = "SELECT o_orderkey, symbol AS query FROM req"
CTES["plain"] = resolved("asked")
CTES["cached"] = f"""SELECT a.o_orderkey, a.query, c.query IS NOT NULL AS cache_hit, coalesce(c.symbol, a.symbol) AS symbol,
    coalesce(c.company_name, a.company_name) AS company_name
    FROM plain a LEFT JOIN cache c ON upper(a.query) = c.query AND c.cached_at > {WEEK}"""

CTES["instruments"] = f"""SELECT DISTINCT * FROM (SELECT upper(left(n_name, 4)) AS symbol, n_name AS company_name FROM nation
    UNION ALL SELECT ticker, {company('ticker')} FROM p)"""

KINDS = ("click", "error", "purchase", "signup", "view")
CTES["points"] = f"""SELECT {pick(TICKERS, 'user_id')} AS symbol,
    CASE WHEN user_id % 7 < 4 AND event_type = 'purchase' THEN {pick(TICKERS, 'user_id')}
      WHEN user_id % 7 = 6 AND event_type = 'click' THEN 'isPartial' ELSE event_type END AS term,
    list_position({items(KINDS)}, event_type) AS term_no, ts, event_id, value FROM events
    WHERE ts BETWEEN {WEEK} AND {AS_OF}"""
CTES["series"] = """SELECT symbol, arg_min(term, (CASE WHEN term = symbol THEN 0 ELSE 1 END, term_no, term)) AS term
    FROM points GROUP BY symbol"""
CTES["daily"] = """SELECT symbol, ts::DATE AS date, arg_max(value, (ts, event_id)) AS value
    FROM points JOIN (SELECT * FROM series WHERE term <> 'isPartial') USING (symbol, term) GROUP BY ALL"""
CTES["related_ranked"] = f"""SELECT *, row_number() OVER (PARTITION BY symbol, kind ORDER BY n DESC, query) AS position FROM (
    SELECT {pick(TICKERS, 'user_id')} AS symbol, CASE event_type WHEN 'purchase' THEN 'top' ELSE 'rising' END AS kind,
      'q' || user_id AS query, count(*) AS n FROM events WHERE event_type IN ('purchase', 'view') GROUP BY ALL)"""
CTES["related"] = """SELECT symbol, string_agg(query, ',' ORDER BY place) AS related_queries FROM (
    SELECT symbol, query, min(position + CASE kind WHEN 'rising' THEN 5 ELSE 0 END) AS place
    FROM related_ranked WHERE position <= 5 GROUP BY ALL) GROUP BY symbol"""
CTES["regions"] = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY value DESC, region) AS rank FROM (
    SELECT {pick(TICKERS, 'c_custkey')} AS symbol, n_name AS region, round(sum(c_acctbal), 2) AS value
    FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)) WHERE rank <= 10"""
CTES["record"] = """SELECT symbol, coalesce(days, 0) AS days, coalesce(related_queries, '') AS related_queries,
    coalesce(regions, 0) AS regions
    FROM (SELECT symbol, count(*) AS days FROM daily GROUP BY symbol) FULL JOIN related USING (symbol)
    FULL JOIN (SELECT symbol, count(*) AS regions FROM regions GROUP BY symbol) USING (symbol)"""

# The report, request by request: every answer is counted straight from the posts.
CTES["todo"] = f"""SELECT t.o_orderkey, t.query, t."window", t.hours, coalesce(c.symbol, t.symbol) AS symbol,
    coalesce(c.company_name, t.company_name) AS company_name
    FROM ({resolved('''(SELECT o_orderkey, upper(symbol) AS query, "window", hours FROM checked WHERE reason IS NULL)''')}) t
    LEFT JOIN cache c ON upper(t.query) = c.query AND c.cached_at > {WEEK}"""
CTES["keys"] = "SELECT DISTINCT symbol, hours FROM todo"
CTES["found"] = f"""SELECT k.symbol, k.hours, count(*) AS posts_found, count(*) FILTER (WHERE outcome = 'no_symbols') AS no_symbols,
    count(*) FILTER (WHERE outcome = 'probable_bots') AS probable_bots, count(*) FILTER (WHERE outcome = 'processed') AS posts_processed,
    count(*) FILTER (WHERE source = 'x') AS x, count(*) FILTER (WHERE source = 'reddit') AS reddit, count(*) FILTER (WHERE source = 'stocktwits') AS stocktwits
    FROM keys k JOIN landed_clean l ON l.symbol = k.symbol AND l.created_at >= {AS_OF} - to_hours(k.hours) GROUP BY ALL"""
CTES["answers"] = f"""SELECT symbol, hours, sum(n)::BIGINT AS count, sum(coalesce(a, 0) * n) / sum(n) AS weighted_sentiment FROM (
    SELECT k.symbol, k.hours, l.source, count(*) AS n, avg(polarity::DOUBLE) AS a
    FROM keys k JOIN (SELECT unnest(symbols) AS s, source, created_at, polarity FROM landed_scored) l
      ON l.s = k.symbol AND l.created_at >= {AS_OF} - to_hours(k.hours) GROUP BY ALL) GROUP BY ALL"""
CTES["report"] = f"""SELECT t.o_orderkey, t.query, t."window", t.hours, t.company_name, t.symbol AS inst_symbol,
    coalesce(posts_found, 0) AS posts_found, coalesce(posts_processed, 0) AS posts_processed, coalesce(x, 0) AS x,
    coalesce(reddit, 0) AS reddit, coalesce(stocktwits, 0) AS stocktwits, no_symbols, probable_bots, count, weighted_sentiment, days,
    CASE WHEN posts_found IS NULL THEN 'No posts found for this symbol'
      WHEN posts_processed = 0 THEN 'No valid posts after filtering' END AS error
    FROM todo t LEFT JOIN found USING (symbol, hours) LEFT JOIN answers USING (symbol, hours) LEFT JOIN record USING (symbol)"""

CTES["delivered"] = f"""SELECT {D}, source, platform_id, text, like_count, 0 AS seq, {AS_OF} AS ingested_at, 1 AS batch FROM p WHERE {D} % 50 <> 0
    UNION ALL SELECT {D}, source, platform_id, 'changed ' || seq, like_count + 100 * seq, seq, {AS_OF} + to_hours(seq), 2
    FROM p, (VALUES (1), (2)) s(seq) WHERE {D} % 5 = 0 AND ({D} % 10 = 0 OR seq = 1)"""

CTES["vec"] = "SELECT vec_id, embedding::DOUBLE[] AS vector, label FROM embeddings"


def means(source: str, by: str) -> str:
    return f"""SELECT {by}, list(x ORDER BY place) AS mean FROM (SELECT {by}, place, avg(x) AS x FROM (
        SELECT {by}, unnest(vector) AS x, generate_subscripts(vector, 1) AS place FROM {source}) GROUP BY ALL) GROUP BY {by}"""


CTES["source_mean"] = means("(SELECT v.vector, d.source FROM vec v JOIN documents d ON d.doc_id = v.vec_id)", "source")
CTES["label_mean"] = means("vec", "label")
CTES["pairs"] = """SELECT source AS query_id, vec_id, label, round(list_cosine_similarity(mean, vector), 9) AS score
    FROM source_mean, vec"""


def unit(vector: str) -> str:
    return f"list_transform({vector}, lambda x: x / sqrt(list_sum(list_transform({vector}, lambda y: y * y))))"


def spread(source: str, key: str, vector: str) -> str:
    """What identifies a vector, in the form of the registered queries."""
    return f"""SELECT {key}, len({vector})::BIGINT AS dim,
        round(list_sum(list_transform({vector}, lambda x, i: x * i)), 6) AS checksum,
        round({vector}[1], 6) AS "first", round({vector}[-1], 6) AS "last" FROM {source}"""


WORDS = ", ".join(f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT::DOUBLE" for i in range(4))


def gaussian(source: str, key: str, dim: int = 384) -> str:
    """Unit vectors drawn from the digest of the text, as `emb` in single precision."""
    two_pi = 6.283185307179586
    return f"""SELECT {key}, list_transform(z, lambda x: (x / norm)::FLOAT::DOUBLE) AS emb FROM (
      SELECT {key}, z, sqrt(list_sum(list_transform(z, lambda x: x * x))) AS norm FROM (
      SELECT {key}, list(x ORDER BY j, n) AS z FROM (
        SELECT {key}, j, n, CASE n WHEN 0 THEN r0 * cos(a0) WHEN 1 THEN r0 * sin(a0) WHEN 2 THEN r1 * cos(a1) ELSE r1 * sin(a1) END AS x
        FROM (SELECT {key}, j, sqrt(-2 * ln((w[1] + 1) / 4294967296)) AS r0, {two_pi} * w[2] / 4294967296 AS a0,
            sqrt(-2 * ln((w[3] + 1) / 4294967296)) AS r1, {two_pi} * w[4] / 4294967296 AS a1
          FROM (SELECT {key}, j, [{WORDS}] AS w FROM (
            SELECT {key}, j, md5(seed || '#' || j) AS h FROM (SELECT {key}, md5(text) AS seed FROM {source}), range({dim // 4}) r(j)))),
          range(4) q(n)) GROUP BY {key}))"""


LETTERS = "aeinorst"
COUNTS = "[" + ", ".join(f"(length(text) - length(replace(text, '{c}', '')))::DOUBLE" for c in LETTERS) + "]"


def term_rows() -> str:
    differs = "company_name <> '' AND upper(company_name) <> symbol"
    both = "(CASE WHEN symbol <> '' THEN '$' || symbol ELSE '' END)"
    quoted = "CASE WHEN company_name <> '' AND company_name <> symbol THEN '\"' || company_name || '\"' ELSE '' END"
    joined = f"{both} || CASE WHEN {both} <> '' AND {quoted} <> '' THEN ' OR ' ELSE '' END || {quoted}"
    stream = r"regexp_replace(upper(trim(symbol)), '^\$+', '')"
    return " UNION ALL ".join([
        f"SELECT symbol, 'x' AS source, 0 AS term_no, '(' || {joined} || ') -is:retweet lang:en' AS term FROM i WHERE symbol <> '' OR company_name <> ''",
        "SELECT symbol, 'reddit', 0, '$' || symbol FROM i WHERE symbol <> ''",
        "SELECT symbol, 'reddit', 1, symbol FROM i WHERE symbol <> ''",
        f"SELECT symbol, 'reddit', 2, company_name FROM i WHERE {differs}",
        f"SELECT symbol, 'stocktwits', 0, {stream} FROM i WHERE length({stream}) BETWEEN 1 AND 5",
        "SELECT symbol, 'trends', 0, symbol FROM i WHERE symbol <> ''",
        f"SELECT symbol, 'trends', 1, company_name FROM i WHERE symbol <> '' AND {differs}",
    ])


U = up("p.text")
SEARCHES = " UNION ALL ".join([
    f"""SELECT DISTINCT source, platform_id, symbol, 0 AS term_no FROM p, instruments i WHERE source = 'x' AND lang = 'en'
        AND repost_of_id IS NULL AND (contains({U}, '$' || symbol) OR (company_name <> symbol AND contains({U}, upper(company_name))))""",
    f"""SELECT DISTINCT source, platform_id, symbol, 0 FROM p, instruments i WHERE source = 'stocktwits'
        AND length(symbol) BETWEEN 1 AND 5 AND contains({U}, '$' || symbol)""",
    f"""SELECT source, platform_id, symbol, term_no FROM (SELECT *, row_number() OVER (
        PARTITION BY symbol, term_no, subreddit ORDER BY created_at DESC, platform_id) AS rank FROM (
          SELECT DISTINCT source, platform_id, symbol, term_no, subreddit, created_at FROM p, (
            SELECT symbol, 0 AS term_no, '$' || symbol AS term FROM instruments UNION ALL SELECT symbol, 1, symbol FROM instruments
            UNION ALL SELECT symbol, 2, upper(company_name) FROM instruments WHERE upper(company_name) <> symbol)
          WHERE source = 'reddit' AND subreddit IN {tuple(SUBREDDITS)} AND created_at >= {WEEK} AND contains({U}, term))) WHERE rank <= 300""",
])

CURSOR = "(page_no * 7 + length(ticker)) % 3 <> 2 AND NOT broken"
CTES["page_list"] = f"SELECT source, ticker, page_no, bool_and({CURSOR}) AS has_next FROM page GROUP BY ALL"
CTES["st_pages"] = f"""SELECT ticker, page_no,
    bool_or(NOT broken AND {D} % 31 <> 0 AND {D} % 37 <> 0 AND seen_at >= {WEEK}) AS yielded FROM page
    WHERE source = 'stocktwits' GROUP BY ALL"""

BAD_X = f"CASE WHEN {D} % 31 = 0 THEN 'missing_id' WHEN {D} % 37 = 0 THEN 'missing_text' WHEN seen_at < {WEEK} THEN 'too_old' END"
BAD_REDDIT = (f"CASE WHEN created_at < {WEEK} THEN 'too_old' WHEN {D} % 19 = 0 THEN 'deleted' WHEN {D} % 41 = 0 THEN 'removed' "
              f"WHEN {D} % 31 = 0 THEN 'missing_id' END")
BAD_ST = f"CASE WHEN seen_at < {WEEK} THEN 'too_old' WHEN {D} % 31 = 0 THEN 'missing_id' WHEN {D} % 37 = 0 THEN 'missing_text' END"

POST = f"platform_id, author_id, author_handle, {stamp('created_at')} AS created_at, lang, like_count, permalink"

SELECTS: dict[str, str] = {
    "x_parse": f"SELECT symbol, {POST}, text, reply_count, repost_count, follower_count FROM landed_x",
    "x_author_join": """SELECT platform_id, author_id, CASE WHEN author_id LIKE '%3' THEN '' ELSE 'h_' || author_id END AS author_handle,
        CASE WHEN author_id NOT LIKE '%3' THEN follower_count END AS follower_count FROM p WHERE source = 'x'""",
    "reddit_post_parse": f"SELECT symbol, {POST}, text, reply_count FROM landed_reddit",
    "reddit_comment_parse": f"""SELECT 'comment_' || id AS platform_id, author AS author_id, author AS author_handle,
        {stamp('created_at')} AS created_at, 'en' AS lang, conv_id % 9 AS like_count, 'https://reddit.com/c/' || conv_id AS permalink,
        body AS text, conv_id::VARCHAR AS reply_to_id FROM comments""",
    "reddit_thread_comments": f"""SELECT 'comment_' || id AS platform_id, conv_id::VARCHAR AS reply_to_id, author AS author_id,
        {stamp('created_at')} AS created_at FROM comments WHERE conv_id IN (SELECT conv_id FROM turns WHERE turn = 0
          AND created_at >= {WEEK} AND author <> '[deleted]' AND body <> '[removed]' AND {stripped('body')} <> '')""",
    "stocktwits_parse": f"SELECT symbol, {POST}, text, follower_count FROM landed_st",
    "parse_created_at": f"""SELECT event_id, epoch_us(CASE event_id % 6 WHEN 0 THEN ts WHEN 1 THEN date_trunc('millisecond', ts)
          WHEN 2 THEN date_trunc('second', ts) ELSE {AS_OF} END) AS x_micros,
        epoch_us(CASE event_id % 6 WHEN 0 THEN ts WHEN 1 THEN date_trunc('millisecond', ts)
          WHEN 2 THEN date_trunc('second', ts) WHEN 3 THEN date_trunc('second', ts) ELSE {AS_OF} END) AS stocktwits_micros FROM events""",
    "page_cap": """SELECT source, ticker AS symbol, page_no FROM page_list l WHERE page_no < 3 AND NOT EXISTS (
        SELECT 1 FROM page_list e WHERE e.source = l.source AND e.ticker = l.ticker AND e.page_no < l.page_no AND NOT e.has_next)""",
    "page_take_while": """SELECT ticker AS symbol, page_no FROM st_pages l WHERE NOT EXISTS (
        SELECT 1 FROM st_pages e WHERE e.ticker = l.ticker AND e.page_no < l.page_no AND NOT e.yielded)""",
    "search_terms": f"SELECT symbol, source, term_no::BIGINT AS term_no, term FROM (WITH i AS (SELECT DISTINCT symbol, company_name FROM plain) {term_rows()})",
    "search_match": f"SELECT source, platform_id, symbol, term_no::BIGINT AS term_no FROM ({SEARCHES})",
    "dedupe_keep_first": f"""SELECT source, platform_id, (3 - {D} % 3)::BIGINT AS term_no, (3 - {D} % 3) || ':' || text AS text FROM p""",
    "union_sources": """SELECT source, count(*) AS n, count(reply_count) AS n_replies, count(repost_count) AS n_reposts,
        count(follower_count) AS n_followers, sum(length(text))::BIGINT AS chars FROM landed GROUP BY source""",
    "validate_posts": f"SELECT {D}, {D} % 10 <> 0 AND {D} % 21 <> 0 AS is_valid FROM p",
    "quarantine": f"""SELECT source, ticker AS symbol, reason, count(*) AS n FROM (
        SELECT DISTINCT source, ticker, 'bad_json' AS reason, page_no, NULL AS place FROM page WHERE broken
        UNION ALL SELECT source, ticker, CASE source WHEN 'x' THEN {BAD_X} WHEN 'reddit' THEN {BAD_REDDIT} ELSE {BAD_ST} END, page_no, {D}
        FROM page WHERE NOT broken
        UNION ALL SELECT DISTINCT CASE WHEN conv_id % 19 = 4 THEN 'forum' ELSE 'reddit' END, NULL,
          CASE WHEN conv_id % 19 = 4 THEN 'unknown_source' ELSE 'bad_json' END, conv_id * 1000 + (turn - 1) // 20, NULL
        FROM turns WHERE turn > 0 AND (conv_id % 19 = 4 OR conv_id % 17 = 3)
        UNION ALL SELECT 'reddit', NULL, CASE WHEN created_at < {WEEK} THEN 'too_old' WHEN author = '[deleted]' THEN 'deleted'
          WHEN body IN ('[removed]', '[deleted]') THEN 'removed' WHEN coalesce(body, '') = '' THEN 'missing_text' END, conv_id, turn
        FROM turns WHERE turn > 0 AND place <= 10 AND role <> 'system' AND conv_id % 19 <> 4 AND conv_id % 17 <> 3)
        WHERE reason IS NOT NULL GROUP BY ALL""",
    "scan_landed": "SELECT source, symbol, count(*) AS n, sum(length(text))::BIGINT AS chars FROM landed GROUP BY ALL",
    "since_filter": f"""SELECT source, platform_id, {stamp('created_at')} AS created_at FROM p
        WHERE created_at >= {WEEK} + CASE source WHEN 'x' THEN INTERVAL 0 SECOND ELSE INTERVAL 500 MILLISECOND END""",
    "permalinks": "SELECT source, platform_id, permalink FROM landed",
    "normalize_text": f"""SELECT id, {normalized('text')} AS text FROM (SELECT 'd' || platform_id AS id, text FROM p
        UNION ALL SELECT 'p' || page_id, url || chr(9) || html FROM pages)""",
    "cashtags": f"SELECT {D}, array_to_string(list_sort({tags('text')}), ',') AS tags FROM p",
    "symbol_mention": f"SELECT {D}, contains({up('text')}, ticker) AS hit FROM p",
    "company_mention": f"SELECT {D}, contains({up('text')}, {company('ticker')}) AS hit FROM p",
    "extract_symbols": f"SELECT {D}, array_to_string(symbols, ',') AS symbols FROM cleaned",
    "has_symbols": f"SELECT {D} FROM cleaned WHERE len(symbols) > 0",
    "bot_short": f"SELECT {D}, text FROM cleaned WHERE length(text) < 20 AND len(symbols) > 0",
    "bot_dollar": f"""SELECT {D}, dollars FROM (SELECT {D}, length(text) - length(replace(text, '$', '')) AS dollars FROM cleaned)
        WHERE dollars > 5""",
    "drop_bots": f"""SELECT {D} FROM cleaned WHERE NOT (length(text) < 20 AND len(symbols) > 0)
        AND length(text) - length(replace(text, '$', '')) <= 5""",
    "parse_window": 'SELECT o_orderkey, "window", hours FROM hours',
    "validate_requests": """SELECT o_orderkey, symbol, "window", reason, CASE WHEN reason IS NULL THEN upper(symbol) END AS query FROM checked""",
    "posts_for_symbol": f"""SELECT source, platform_id, {stamp('created_at')} AS created_at FROM stored
        WHERE list_contains(symbols, 'NVDA') AND created_at >= {WEEK}""",
    "score_empty": f"""SELECT {D}, {SCORE_OUT} FROM ({scores(f'''(SELECT {D}, CASE {D} % 5 WHEN 0 THEN NULL
        WHEN 1 THEN ' ' || chr(9) || chr(10) || ' ' ELSE text END AS text FROM documents)''')})""".replace("::FLOAT", ""),
    "lexicon_hits": f"SELECT {D}, {hits('lower(text)', POSITIVE_WORDS)} AS positive, {hits('lower(text)', NEGATIVE_WORDS)} AS negative FROM p",
    "score_heuristic": f"""SELECT {D}, round(polarity, 6) AS polarity, round(subjectivity, 6) AS subjectivity,
        round(confidence, 6) AS confidence, model FROM ({scores('p')})""".replace("::FLOAT", ""),
    "sarcasm": f"SELECT {D}, round({sarcasm('text', 'lower(text)')}, 6) AS sarcasm_prob FROM p",
    "score_text": f"SELECT {D}, {SCORE_OUT} FROM scored_all",
    "l2_normalize": f"""SELECT vec_id, (i - 1)::BIGINT AS place, round(x, 6) AS x FROM (
        SELECT vec_id, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM (SELECT vec_id, {unit('vector')} AS u FROM vec))""",
    "embed_hash": spread(f"({gaussian('p', D)})", D, "emb"),
    "resolve_normalize": f"SELECT o_orderkey, {NAME} AS normalized FROM asked",
    "resolve_symbols": "SELECT o_orderkey, query, symbol, company_name FROM plain",
    "resolve_cached": "SELECT o_orderkey, query, cache_hit, symbol, company_name FROM cached",
    "posts_sentiment_join": f"SELECT {D}, {SCORE_OUT} FROM scored_all WHERE outcome = 'processed' AND {D} % 9 <> 0",
    "mention_join": f"""SELECT DISTINCT source, platform_id, symbol FROM p, instruments
        WHERE contains({U}, symbol) OR contains({U}, upper(company_name))""",
    "enrich_trends": """SELECT symbol, count, CASE WHEN related_queries IS NOT NULL THEN days END AS days, related_queries AS related
        FROM (SELECT symbol, sum(n)::BIGINT AS count FROM (SELECT unnest(symbols) AS symbol, 1 AS n FROM scored) GROUP BY symbol)
        LEFT JOIN record USING (symbol)""",
    "cascade_cleanup": f"SELECT source, platform_id, model FROM scored_all WHERE outcome = 'processed' AND {D} % 9 <> 0",
    "sentiment_by_source": """SELECT symbol, source, n, round(avg_polarity, 6) AS avg_polarity, round(stddev_polarity, 6) AS stddev_polarity
        FROM by_source""",
    "weighted_sentiment": "SELECT symbol, count, round(weighted_sentiment, 6) AS weighted_sentiment FROM weighted",
    "stored_sources_map": "SELECT symbol, source, n FROM by_source",
    "source_counts": """SELECT s.symbol, k.source, count(l.symbol) AS n FROM (SELECT DISTINCT symbol FROM landed) s
        CROSS JOIN (VALUES ('x'), ('reddit'), ('stocktwits')) k(source)
        LEFT JOIN landed l ON l.symbol = s.symbol AND l.source = k.source AND (l.symbol <> 'META' OR l.source <> 'x') GROUP BY ALL""",
    "filter_stats": """SELECT ticker AS symbol, count(*) AS total_input, count(*) FILTER (WHERE outcome = 'no_symbols') AS no_symbols,
        count(*) FILTER (WHERE outcome = 'probable_bots') AS probable_bots, count(*) FILTER (WHERE outcome = 'processed') AS processed FROM cleaned GROUP BY ticker""",
    "avg_scores": """SELECT symbol, round(avg(polarity::DOUBLE), 6) AS avg_polarity, round(avg(subjectivity::DOUBLE), 6) AS avg_subjectivity,
        round(avg(confidence::DOUBLE), 6) AS avg_confidence
        FROM (SELECT unnest(symbols) AS symbol, polarity, subjectivity, confidence FROM recent) GROUP BY symbol""",
    "sentiment_report": f"""SELECT o_orderkey, query, "window", CASE WHEN error IS NULL THEN inst_symbol ELSE query END AS symbol,
        CASE WHEN error IS NULL THEN strftime({AS_OF} - to_hours(hours), '%Y-%m-%dT%H:%M:%S') END AS window_since,
        CASE WHEN error IS NULL THEN coalesce(count, 0) END AS count,
        CASE WHEN error IS NULL THEN round(coalesce(weighted_sentiment, 0), 6) END AS weighted_sentiment, company_name,
        posts_found, posts_processed, x, reddit, stocktwits, CASE WHEN error IS NULL THEN days END AS trend_days,
        no_symbols, probable_bots, error FROM report""",
    "report_status": """SELECT error, count(*) AS n, count(*) FILTER (WHERE posts_found > 0) AS with_stats,
        count(*) FILTER (WHERE error IS NULL AND days IS NOT NULL) AS with_trends FROM report GROUP BY error""",
    "report_dry_run": """SELECT o_orderkey, query, "window", CASE WHEN error IS NULL THEN inst_symbol ELSE query END AS symbol,
        CASE WHEN error IS NULL THEN 0.0::DOUBLE END AS avg_polarity, CASE WHEN error IS NULL THEN 0.0::DOUBLE END AS avg_subjectivity,
        CASE WHEN error IS NULL THEN 0.0::DOUBLE END AS avg_confidence,
        CASE WHEN error IS NULL THEN posts_processed END AS total_posts, posts_found, true AS dry_run FROM report""",
    "report_json": """SELECT o_orderkey, query, "window", CASE WHEN error IS NULL THEN inst_symbol ELSE query END AS symbol, posts_found, reddit,
        CASE WHEN error IS NULL THEN round(coalesce(weighted_sentiment, 0), 6) END AS weighted_sentiment, error,
        company_name, CASE WHEN error IS NULL THEN
          'count,filter_stats,posts_found,posts_processed,resolved_instrument,search_interest,sources,symbol,weighted_sentiment,window_since'
          ELSE concat('error,', CASE WHEN posts_found > 0 THEN 'filter_stats,' ELSE '' END,
            'posts_found,posts_processed,resolved_instrument,search_interest,sources,symbol') END AS fields FROM report""",
    "interest_over_time": "SELECT symbol, strftime(date, '%Y-%m-%d') AS date, round(value, 6) AS value FROM daily",
    "trend_series_pick": "SELECT symbol, term FROM series WHERE term <> 'isPartial'",
    "related_queries": "SELECT symbol, related_queries FROM related",
    "top_regions": "SELECT symbol, rank, region, round(value, 6) AS value FROM regions",
    "trends_record": f"SELECT symbol, days, related_queries, regions, {stamp(AS_OF)} AS fetched_at FROM record",
    "upsert_posts": f"""SELECT source, platform_id, arg_min(text, (batch, seq)) AS text, arg_min(like_count, (batch, seq)) AS like_count,
        {stamp('max(ingested_at)')} AS ingested_at FROM delivered GROUP BY source, platform_id""",
    "upsert_sentiment": f"""SELECT source, platform_id, {SCORE_OUT} FROM ({scores(f'''(SELECT source, platform_id,
        arg_max(text, (batch, seq)) AS text FROM delivered GROUP BY source, platform_id)''')})""",
    "upsert_embeddings": spread("""(SELECT vec_id::VARCHAR AS platform_id,
        CASE WHEN label < 5 THEN list_reverse(vector) ELSE vector END AS emb FROM vec)""", "platform_id", "emb"),
    "account_rollup": f"""SELECT source, author_id, arg_max(author_id || '@' || platform_id, (created_at, platform_id)) AS handle,
        arg_max({D}, (created_at, platform_id)) AS follower_count, {stamp('max(created_at)')} AS last_seen FROM p GROUP BY source, author_id""",
    "processed_count": f"""SELECT source, count(*) AS n FROM stored WHERE {D} % 9 <> 0 AND {D} IN (SELECT vec_id FROM embeddings) GROUP BY source""",
    "stream_ingest": f"""SELECT source, platform_id, like_count, {stamp(f"{AS_OF} + INTERVAL 1 HOUR")} AS ingested_at,
        array_to_string(symbols, ',') AS symbols, round(polarity::DOUBLE, 6) AS polarity, model, 384::BIGINT AS dims FROM landed_rescored""",
    "stream_dedupe": f"SELECT source, platform_id, {stamp('created_at')} AS created_at FROM p",
    "rolling_sentiment": f"""SELECT symbol, {stamp('window_start')} AS window_start, count(*) AS n,
        round(avg(polarity::DOUBLE), 6) AS avg_polarity FROM (
          SELECT unnest(symbols) AS symbol, date_trunc('hour', created_at) - to_hours(b) AS window_start, polarity
          FROM scored, range(24) r(b)) GROUP BY ALL""",
    "rolling_sentiment_stream": f"""SELECT symbol, {stamp('window_start')} AS window_start, count(*) AS n,
        round(avg(polarity::DOUBLE), 6) AS avg_polarity FROM (
          SELECT unnest(symbols) AS symbol, date_trunc('hour', created_at) - to_hours(b) AS window_start, polarity
          FROM scored_all, range(24) r(b) WHERE outcome = 'processed')
        WHERE window_start + INTERVAL 24 HOUR <= (SELECT max(created_at) - INTERVAL 1 HOUR FROM scored_all WHERE outcome = 'processed')
        GROUP BY ALL""",
    "resolver_cache_update": f"""SELECT query, symbol, company_name, {stamp('cached_at')} AS cached_at FROM cache
          WHERE query NOT IN (SELECT upper(query) FROM cached WHERE NOT cache_hit)
        UNION ALL SELECT upper(query), arg_max(symbol, query), arg_max(company_name, query), {stamp(AS_OF)}
          FROM cached WHERE NOT cache_hit GROUP BY upper(query)""",
    "cosine_topk": """SELECT query_id, vec_id, score, rank FROM (SELECT *,
        row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 10""",
    "ivf_topk": """SELECT query_id, vec_id, score, rank FROM (SELECT *,
        row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs JOIN (
          SELECT vec_id, label AS list_id FROM (SELECT v.vec_id, m.label, row_number() OVER (PARTITION BY v.vec_id
            ORDER BY round(list_cosine_similarity(v.vector, m.mean), 9) DESC, m.label) AS r FROM vec v, label_mean m) WHERE r = 1) USING (vec_id)
        JOIN (SELECT source AS query_id, label AS list_id FROM (SELECT s.source, m.label, row_number() OVER (PARTITION BY s.source
            ORDER BY round(list_cosine_similarity(s.mean, m.mean), 9) DESC, m.label) AS r FROM source_mean s, label_mean m) WHERE r <= 3)
          USING (query_id, list_id)) WHERE rank <= 10""",
}

SELECTS["resolver_cache_stored"] = f"""SELECT u.*, CASE WHEN q.query IS NOT NULL THEN true END AS hit FROM ({SELECTS["resolver_cache_update"]}) u
    LEFT JOIN (SELECT DISTINCT upper(query) AS query FROM asked) q USING (query)"""
SELECTS["dead_letters_replay"] = f"""SELECT source, ticker AS symbol, CASE WHEN reason IS NULL THEN 'post' ELSE 'refused_item' END AS tag,
    coalesce(reason, '') AS reason, count(*) AS n FROM (
      SELECT source, ticker, CASE source WHEN 'x' THEN {BAD_X} WHEN 'reddit' THEN {BAD_REDDIT} ELSE {BAD_ST} END AS reason FROM page)
    GROUP BY ALL"""
SELECTS["answers_sink"] = f"""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS run, "window",
    CASE WHEN error IS NULL THEN inst_symbol ELSE query END AS symbol,
    CASE WHEN error IS NULL THEN strftime({AS_OF} - to_hours(hours), '%Y-%m-%dT%H:%M:%S') END AS window_since,
    CASE WHEN error IS NULL THEN coalesce(count, 0) END AS count,
    CASE WHEN error IS NULL THEN round(coalesce(weighted_sentiment, 0), 6) END AS weighted_sentiment, posts_found, posts_processed,
    x, reddit, stocktwits, CASE WHEN error IS NULL THEN days END AS trend_days, company_name, inst_symbol AS instrument,
    CASE WHEN posts_found > 0 THEN posts_found END AS total_input, no_symbols, probable_bots,
    CASE WHEN posts_found > 0 THEN posts_processed END AS passed, error FROM report"""
SELECTS["stream_keep_first"] = SELECTS["dedupe_keep_first"]
SELECTS["search_match_indexed"], SELECTS["mention_join_indexed"] = SELECTS["search_match"], SELECTS["mention_join"]
SELECTS["ivf_exact"] = SELECTS["cosine_topk"]
SELECTS["posts_sentiment_bucketed"] = SELECTS["posts_sentiment_join"]
SELECTS["stream_compacted"] = SELECTS["stream_ingest"]
# Counted anew from the posts: collected ones by the instrument, stored ones by every symbol, with the scores of the second delivery.
SELECTS["sentiment_cube"] = f"""SELECT symbol, source, {stamp('hour')} AS hour, sum(total_input)::BIGINT AS total_input,
    sum(no_symbols)::BIGINT AS no_symbols, sum(probable_bots)::BIGINT AS probable_bots, sum(processed)::BIGINT AS processed,
    sum(processed)::BIGINT AS complete, sum(n)::BIGINT AS n, sum(n)::BIGINT AS n_scored, round(sum(polarity)::DOUBLE, 6) AS sum_polarity FROM (
      SELECT symbol, source, date_trunc('hour', created_at) AS hour, 1 AS total_input, (outcome = 'no_symbols')::INT AS no_symbols,
        (outcome = 'probable_bots')::INT AS probable_bots, (outcome = 'processed')::INT AS processed, 0 AS n, 0 AS polarity FROM landed_clean
      UNION ALL SELECT unnest(symbols), source, date_trunc('hour', created_at), 0, 0, 0, 0, 1, polarity::DOUBLE FROM landed_rescored)
    GROUP BY ALL"""
FIFTH = f"{crc32('platform_id')} % 5 = 0"
SELECTS["progress_ledger"] = f"""SELECT 0 AS delivery, source, count(*) AS stored, count(*) FILTER (NOT {FIFTH}) AS scored,
      count(*) FILTER ({FIFTH}) AS failed FROM landed_clean WHERE outcome = 'processed' AND page_no % 2 = 0 GROUP BY source
    UNION ALL SELECT 1, source, count(*), count(*), 0 FROM landed_clean WHERE outcome = 'processed' GROUP BY source"""
#: The same answers, whether counted from the pages or from what ingestion stored of them.
SELECTS["report_from_store"] = SELECTS["sentiment_report"]


def model_scores(source: str, neg: str, pos: str, name: str) -> str:
    """Scores from two logits; null logits leave the model's columns null."""
    return f"""SELECT *, CASE WHEN conf < 0.6 THEN (pp - np) * conf ELSE pp - np END AS pol FROM (
        SELECT *, np, 1 - np AS pp, greatest(np, 1 - np) AS conf FROM (
        SELECT *, '{name}' AS model_name, 1 / (1 + exp({pos} - ({neg}))) AS np FROM {source}))"""


SELECTS["logits_to_score"] = f"""SELECT vec_id, round(pol, 6) AS polarity, round(abs(pol), 6) AS subjectivity, 0.05::DOUBLE AS sarcasm_prob,
    round(conf, 6) AS confidence, model_name AS model FROM ({model_scores('vec', 'vector[1] * 4', 'vector[2] * 4', 'distilbert')})"""
_BY_WORDS = scores(f"(SELECT {D}, CASE WHEN {D} % 9 <> 0 THEN text ELSE ' ' END AS text FROM p)").replace("::FLOAT", "")
_TAKEN = "model = 'heuristic' AND NOT contains(text, '$A $B')"
_LETTER = "(length(text) - length(replace(text, '{}', ''))) / 10.0::DOUBLE"
SELECTS["score_model"] = f"""SELECT {D}, round(CASE WHEN {_TAKEN} THEN pol ELSE polarity END, 6) AS polarity,
    round(CASE WHEN {_TAKEN} THEN abs(pol) ELSE subjectivity END, 6) AS subjectivity, round(sarcasm_prob, 6) AS sarcasm_prob,
    round(CASE WHEN {_TAKEN} THEN conf ELSE confidence END, 6) AS confidence,
    CASE WHEN {_TAKEN} THEN 'letters' ELSE model END AS model
    FROM ({model_scores(f"({_BY_WORDS})", _LETTER.format('a'), _LETTER.format('e'), 'letters')})"""
SELECTS["embed_model"] = spread(f"""(SELECT p.{D}, CASE WHEN contains(text, '$A $B') OR trim(text) = '' THEN h.emb
    ELSE list_transform(v, lambda x: (CASE WHEN norm > 0 THEN x / norm ELSE x END)::FLOAT::DOUBLE) END AS emb
    FROM (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM (SELECT {D}, text, {COUNTS} AS v FROM p)) p
    LEFT JOIN ({gaussian("(SELECT * FROM p WHERE contains(text, '$A $B'))", D, 8)}) h USING ({D}))""", D, "emb")


# Vectors of the latest texts: those on even pages were changed.
_LATEST = """(SELECT source || ':' || platform_id AS id, regexp_extract(platform_id, '(\\d+)$', 1)::BIGINT AS number,
    CASE WHEN page_no % 2 = 0 THEN replace(text, 'bullish moon', 'crash dump sell') ELSE text END AS text
    FROM landed_clean WHERE outcome = 'processed')"""
SELECTS["stored_similarity"] = f"""SELECT * FROM (WITH e AS MATERIALIZED (SELECT e.id, l.number, e.emb FROM ({gaussian(_LATEST, 'id')}) e JOIN {_LATEST} l USING (id))
    SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
      SELECT q.id AS query_id, e.id AS vec_id, round(list_cosine_similarity(q.emb, e.emb), 9) AS score FROM e q, e WHERE q.number % 50 = 1)
    QUALIFY rank <= 5)"""


def statement(name: str) -> str:
    """The query with the tables it is built from."""
    body = SELECTS[name]
    order = list(CTES)
    needed: set[str] = set()
    frontier = [body]
    while frontier:
        part = frontier.pop()
        for cte in order:
            if cte not in needed and re.search(rf"\b(?:FROM|JOIN)\s+\(?{cte}\b|,\s*{cte}\b", part):
                needed.add(cte)
                frontier.append(CTES[cte])
    tables = ",\n".join(f"{cte} AS ({CTES[cte]})" for cte in order if cte in needed)
    return f"WITH {tables}\n{body}" if tables else body


def oracle_sql() -> dict[str, str]:
    return {name: statement(name) for name in SELECTS}
