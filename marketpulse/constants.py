"""Fixed values. Results depend on them exactly, so they are stated plainly here."""

# Opinion words, matched as substrings of the lower-cased text.
POSITIVE_WORDS = (
    "boom", "breakout", "bullish", "buy", "excellent", "gain", "great", "growth", "long",
    "moon", "profit", "rally", "rocket", "soar", "strong", "surge", "undervalued", "up",
)
NEGATIVE_WORDS = (
    "bad", "bearish", "bubble", "crash", "decline", "down", "dump", "fall", "loss",
    "overvalued", "plunge", "scam", "sell", "short", "tank", "terrible", "weak",
)

# Sarcasm cues and their weights.
SARCASM_CUES = {
    "/s": 0.95,
    "what could go wrong": 0.9,
    "\U0001F644": 0.9,
    "yeah right": 0.8,
    "sure thing": 0.7,
    "genius": 0.6,
    "obviously": 0.6,
    "brilliant": 0.5,
    "great job": 0.5,
    "to the moon": 0.4,
    "totally": 0.4,
    "lol": 0.3,
}
SARCASM_PUNCTUATION = ("?!", "!!!")
SARCASM_PUNCTUATION_FLOOR = 0.5
SARCASM_DEFAULT = 0.05

# Company names that resolve to a ticker.
COMPANY_TICKERS = {
    "AMAZON": "AMZN",
    "APPLE": "AAPL",
    "GOOGLE": "GOOGL",
    "META": "META",
    "MICROSOFT": "MSFT",
    "NVIDIA": "NVDA",
    "TESLA": "TSLA",
}

# Platforms, communities and operating limits.
SOURCES = ("x", "reddit", "stocktwits")
SUBREDDITS = ("investing", "stockmarket", "stocks", "wallstreetbets")
MIN_POST_LENGTH = 20
MAX_DOLLAR_SIGNS = 5
MAX_PAGES = 3
COMMENTS_PER_POST = 10
SEARCH_RESULTS_PER_TERM = 300
SEARCH_LOOKBACK_DAYS = 7
CACHE_TTL_DAYS = 7
EMBEDDING_DIM = 384
RELATED_PER_KIND = 5
RELATED_TOTAL = 10
TREND_DAYS = 7
TOP_REGIONS = 10
DEFAULT_WINDOW_HOURS = 24

# What Unicode text tools take for white space.
WHITESPACE_CHARACTERS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The same in a Java pattern with the flag U: Unicode white space and four separators that Java leaves out.
JAVA_WHITESPACE = r"\s\x1c-\x1f"
