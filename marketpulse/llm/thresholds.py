"""Quality rules with risk-controlled thresholds. DataFrame operations only.

Rules reject a document whose statistic reaches a cutoff. Cutoffs are chosen on labelled documents: per stratum and rule,
going down from the cutoff that rejects nothing, a cutoff is allowed while the exact binomial test rejects, at the corrected
level, that more than the permitted share of good documents falls. Among those allowed the one that catches the most bad
documents is taken, and of equal ones the mildest. Going down in a fixed order needs no correction over the cutoffs; strata
and rules are corrected for by Bonferroni.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketpulse.llm.common import words
from marketpulse.operators.sizes import broadcast_if_small
from marketpulse.session import configure, materialize

SYMBOLS = "[#*$%&|<>]"
WORD_CHAR = "[^\\x20\\x09-\\x0D]"
WINDOW = 8
#: Share of good documents that the rules of a stratum may reject together, and the chance that any stratum has more.
RISK, CONFIDENCE = 0.05, 0.95
#: Cutoffs are multiples of 1/STEPS.
STEPS = 64
#: Strata by number of words: lower ends.
STRATA = (20, 100, 1000)
RULES = ("symbols", "dup_lines", "repeats", "capitals")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the step of each rule's statistic, per row.

    Null text has no words and zeros everywhere. Windows are compared by 64-bit hashes within a document.
    """
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", words(F.col("text")))
    rows = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    # As plain text lines: a line counts if it has a word.
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(WORD_CHAR))))
    last = F.size("hashes") - (WINDOW - 1)
    rows = rows.withColumn("windows", F.when(last > 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice("hashes", i, WINDOW)))))
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn("sorted", F.when(again, F.array_sort(F.transform("windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    twice = F.filter("sorted", lambda e, j: (
        F.coalesce(F.get("sorted", j + 1)["x"] == e["x"], F.lit(False)) | F.coalesce(F.when(j > 0, F.get("sorted", j - 1)["x"]) == e["x"], F.lit(False))))
    rows = rows.withColumn("at", F.array_sort(F.transform(twice, lambda e: e["i"])))
    covered = F.aggregate(F.transform("at", lambda p, j: F.coalesce(F.least(F.lit(WINDOW), F.get("at", j + 1) - p), F.lit(WINDOW))),
                          F.lit(0), lambda a, x: a + x)
    solid = F.aggregate("words", F.lit(0), lambda n, w: n + F.length(w))
    counted = rows.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), solid.cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), F.size("lines").alias("n_lines"),
        F.regexp_count("text", F.lit("\\p{Lu}")).alias("n_capitals"))
    shares = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"),
              "repeats": ("n_repeat_words", "n_words"), "capitals": ("n_capitals", "word_chars")}
    step = lambda part, whole: F.when(F.col(whole) > 0, F.floor(STEPS * F.col(part) / F.col(whole))).otherwise(0).cast("int")
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                          *[step(*shares[r]).alias(f"step_{r}") for r in RULES])


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def stratum() -> Column:
    out = F.lit(0)
    for i, least in enumerate(STRATA[1:], 1):
        out = F.when(F.col("n_words") >= least, i).otherwise(out)
    return out


def allowed(n: Column, risk: float, level: float) -> Column:
    """The largest k with P(Binomial(n, risk) <= k) <= level, else -1: so many of n good documents may fall."""
    start = F.struct((n * F.log1p(F.lit(-risk))).alias("log"), F.lit(0.0).alias("total"), F.lit(-1).cast("long").alias("best"))
    odds = F.lit(risk / (1.0 - risk))

    def step(a: Column, j: Column) -> Column:
        total = a["total"] + F.exp(a["log"])
        more = F.log(F.greatest(n - j, F.lit(1)).cast("double") / (j + 1) * odds)
        return F.struct((a["log"] + more).alias("log"), total.alias("total"), F.when(total <= level, j).otherwise(a["best"]).alias("best"))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.floor(n * risk)), start, step, lambda a: a["best"])


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """stratum, rule, cutoff (in steps): the chosen cutoffs; a rule that may not or need not reject anything has no row.

    labels: doc_id, quality; rows with another quality than 0 or 1 or without id are ignored. All labelled documents count
    that pass the base rules. They are a holdout: nothing else is learned from them here.
    """
    marked = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    held = measured.where(~base_failed()).join(broadcast_if_small(marked), "doc_id").withColumn("stratum", stratum())
    level, each = (1.0 - confidence) / (len(STRATA) * len(RULES)), risk / len(RULES)
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"step_{r}").alias("step")) for r in RULES])).alias("r")
    counts = held.select("stratum", "quality", rules).groupBy("stratum", "r.rule", "r.step").agg(
        F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    part = Window.partitionBy("stratum", "rule")
    down = part.orderBy(F.desc("step"))
    tried = counts.select("stratum", "rule", "step", F.sum("good").over(down).alias("fallen"), F.sum("bad").over(down).alias("caught"),
                          F.sum("good").over(part).alias("n"))
    most = tried.select("stratum", "n").distinct().withColumn("most", allowed(F.col("n"), each, level))
    fit = tried.where("step > 0 and caught > 0").join(F.broadcast(most), ["stratum", "n"]).where("fallen <= most")
    best = F.row_number().over(part.orderBy(F.desc("caught"), F.desc("step")))
    return fit.withColumn("place", best).where("place = 1").select("stratum", "rule", F.col("step").alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, stratum.

    Rows with null or blank text fail the base rules. Repeated rows are judged each; an id labelled twice counts twice.
    Too few labels in a stratum allow no rejection there. An empty table gives an empty result.
    """
    configure(docs.sparkSession)
    measured = materialize(measure(docs), "measured")
    chosen = materialize(cutoffs(measured, labels, risk, confidence), "cutoffs")
    # At most one row per stratum.
    wide = chosen.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES])
    rows = measured.withColumn("stratum", stratum()).join(F.broadcast(wide), "stratum", "left")
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | F.coalesce(F.col(f"step_{r}") >= F.col(f"cut_{r}"), F.lit(False))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       base_failed().alias("base_failed"), (~base_failed() & ~rejected).alias("kept"), "stratum")
