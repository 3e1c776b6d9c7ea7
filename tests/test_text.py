import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketpulse.constants import WHITESPACE_CHARACTERS
from marketpulse.functions import text as T

PIECES = [*WHITESPACE_CHARACTERS, *"ab:/$AZ", "http://", "https://x", "é", "ß", "\U0001F644"]


def evaluate(df, column):
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def expected_normalized(t):
    return re.sub(r"\s+", " ", re.sub(r"https?://\S+", "", t)).strip()


CASES = [
    ("Read https://news.test/a?b=1 before noon", "Read before noon"),
    ("Wide   gaps \t and\n\n  line   ends", "Wide gaps and line ends"),
    ("http://a.b/c?d=1", ""),
    ("a  b\x1c\x1fc　", "a b c"),
    ("see https://x.y next", "see next"),
    ("httpx stays, http:/ too", "httpx stays, http:/ too"),
    ("", ""),
]


def test_normalize_cases(texts):
    got = evaluate(texts([c[0] for c in CASES]), T.normalize_text(F.col("text")))
    assert got == [c[1] for c in CASES]
    assert got == [expected_normalized(c[0]) for c in CASES]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=30).map("".join), min_size=30, max_size=60))
def test_normalize_agrees_with_unicode_rules_and_is_idempotent(texts, values):
    df = texts(values)
    once = T.normalize_text(F.col("text"))
    got = df.orderBy("i").select(once, T.normalize_text(once)).collect()
    assert [r[0] for r in got] == [expected_normalized(v) for v in values]
    assert all(r[0] == r[1] for r in got)


def expected_tags(t):
    return sorted(set(re.findall(r"\$([A-Z]{1,5})(?![A-Z])", t)))


TAGGED = [
    "Sold $AAPL, kept $TSLA", "$TOOLONG $ABCDE $ABCDEF", "long $aapl only", "$A$B $A", "$AAPLx $AAPL.", "no tags", "$$X", "",
]


def test_cashtags(texts):
    got = evaluate(texts(TAGGED), F.array_sort(T.cashtags(F.col("text"))))
    assert [list(g) for g in got] == [expected_tags(t) for t in TAGGED]
    assert got[2] == []


# Mentions are substrings, not words.
MENTIONS = [
    ("Apple surprised today", "AAPL", "Apple", ["AAPL"]),
    ("a fine page", "GE", "General Electric", ["GE"]),
    ("a fine day", "GE", "General Electric", []),
    ("$TSLA and apple", "AAPL", "Apple", ["AAPL", "TSLA"]),
    ("apple pie", "", "Apple", [""]),
    ("nothing here", None, None, []),
    ("$MSFT", "msft", "x-corp", ["MSFT"]),
    ("straße", "SS", "x", ["SS"]),
]


def test_extract_symbols(spark):
    rows = [(i, *m[:3]) for i, m in enumerate(MENTIONS)]
    df = spark.createDataFrame(rows, "i int, text string, s string, c string")
    got = evaluate(df, T.extract_symbols(F.col("text"), F.upper("text"), F.col("s"), F.col("c")))
    assert [list(g) for g in got] == [m[3] for m in MENTIONS]


FILTERED = [
    ("$AAPL up", ["AAPL"], "probable_bots"),
    ("x" * 19, ["AAPL"], "probable_bots"),
    ("x" * 20, ["AAPL"], "processed"),
    ("short", [], "no_symbols"),
    ("$A $B $C $D $E and a longer text", ["A"], "processed"),
    ("$A $B $C $D $E $F and a longer text", ["A"], "probable_bots"),
    ("$A $B $C $D $E $F and a longer text", [], "no_symbols"),
    ("\U0001F644" * 19, ["A"], "probable_bots"),
]


def test_first_failing_filter(spark):
    df = spark.createDataFrame([(i, t, s) for i, (t, s, _) in enumerate(FILTERED)], "i int, text string, symbols array<string>")
    assert evaluate(df, T.outcome(F.col("text"), F.col("symbols"))) == [f[2] for f in FILTERED]
