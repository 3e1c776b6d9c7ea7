"""Quality classifier as a sparse ensemble of rules.

Text statistics are built-in column expressions. Trees grown on a bounded sample of labelled rows give conjunctive rules
(their paths); a lasso logistic fit keeps few of them, and those compile into one column expression.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassificationModel, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpulse.llm.common import words
from marketpulse.operators.sizes import broadcast_if_small
from marketpulse.session import configure, materialize

#: At most about so many labelled rows are fitted on, chosen by a hash of the id.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS = 24, 3, 64
LASSO = 0.002
#: A rule must hold for this share of the sample, and fail for this share.
SUPPORT = 0.003
SYMBOLS = r"[#*$%&|<>{}\[\]~^=_\\/]"
STATISTICS = ("chars", "words", "word_length", "symbols", "bangs", "capitals", "digits", "distinct_words", "repeated_lines")


@dataclass(frozen=True)
class RuleEnsemble:
    """score = logistic(intercept + sum of the weights of the rules that hold). A rule: ((statistic, is_greater, bound), ...)."""

    intercept: float
    rules: tuple[tuple[tuple[tuple[str, bool, float], ...], float], ...]

    def score(self) -> Column:
        """Over the columns of with_statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(_holds(rule), weight).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def _holds(rule) -> Column:
    parts = [F.col(name) > bound if greater else F.col(name) <= bound for name, greater, bound in rule]
    out = parts[0]
    for part in parts[1:]:
        out = out & part
    return out


def with_statistics(docs: DataFrame, keep: list[Column], text: str = "text") -> DataFrame:
    """The columns `keep`, then the statistics of a whole text as doubles; null counts as empty.

    Shares are of characters, words or lines; 0 of none. The statistics come out of a generator: else every use of them in a
    rule or a filter would be replaced by the expression that makes them.
    """
    names = [f"kept {i}" for i in range(len(keep))]
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(*[c.alias(n) for c, n in zip(keep, names)], whole.alias("text of statistics"))
    rows = rows.withColumn("words of statistics", words(F.col("text of statistics")))
    text, found = F.col("text of statistics"), F.col("words of statistics")
    share = lambda part, of: F.when(of > 0, part / of).otherwise(0.0)
    length, count, lines = F.length(text), F.size(found), F.split(text, "\n")
    per_char = lambda pattern: share(F.regexp_count(text, F.lit(pattern)), length)
    parts = {
        "chars": length, "words": count, "word_length": share(length, count),
        "symbols": per_char(SYMBOLS), "bangs": per_char("[!?]"), "capitals": per_char("\\p{Lu}"), "digits": per_char("[0-9]"),
        "distinct_words": share(F.size(F.array_distinct(found)), count),
        "repeated_lines": 1.0 - share(F.size(F.array_distinct(lines)), F.size(lines)),
    }
    return rows.select(*names, F.inline(F.array(F.struct(*[parts[name].cast("double").alias(name) for name in STATISTICS]))))


def tree_paths(tree: DecisionTreeClassificationModel) -> list[tuple[tuple[str, bool, float], ...]]:
    """The conjunction that leads to each node below the root."""
    out, path = [], []
    for line in tree.toDebugString.splitlines():
        found = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if found:
            depth = len(found[1]) - 2
            path = path[:depth] + [(STATISTICS[int(found[2])], found[3] == ">", float(found[4]))]
            out.append(_tight(path))
    return out


def _tight(path) -> tuple[tuple[str, bool, float], ...]:
    """One bound per statistic and direction, sorted."""
    bounds: dict[tuple[str, bool], float] = {}
    for name, greater, bound in path:
        old = bounds.get((name, greater), bound)
        bounds[name, greater] = max(old, bound) if greater else min(old, bound)
    return tuple(sorted((name, greater, bound) for (name, greater), bound in bounds.items()))


def fit(docs: DataFrame, labels: DataFrame, learning: Column, sample_rows: int = SAMPLE_ROWS) -> RuleEnsemble:
    """Learn from the labelled rows for which `learning` (an expression over doc_id) is true.

    docs: doc_id, text. labels: doc_id, quality. Rows with null id or quality teach nothing. An id labelled more than once counts
    once for each label. Without labels the score is 0.5 everywhere; with one class only, or no rule, it is the smoothed share of label 1.
    """
    configure(docs.sparkSession)
    taught = labels.select(F.col("doc_id"), F.col("quality").cast("double").alias("label")).where(
        "doc_id is not null and label in (0.0, 1.0)").where(learning)
    taught = materialize(taught, "taught")
    n = taught.count()
    if n > sample_rows:
        taught = taught.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < int(1_000_000 * sample_rows / n))
    rows = docs.select("doc_id", "text").join(broadcast_if_small(taught), "doc_id")
    rows = materialize(with_statistics(rows, [F.col("label")]).withColumnRenamed("kept 0", "label"), "statistics")
    # The same rows in the same order at every run: the forest draws its samples by place.
    rows = rows.repartition(8, F.xxhash64(*STATISTICS)).sortWithinPartitions(*STATISTICS, "label").coalesce(4).cache()
    try:
        return _fit(rows)
    finally:
        rows.unpersist()


def _fit(rows: DataFrame) -> RuleEnsemble:
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    good, total = counts.get(1.0, 0), sum(counts.values())
    base = RuleEnsemble(math.log((good + 0.5) / (total - good + 0.5)), ())
    if len(counts) < 2:
        return base
    data = rows.select("label", array_to_vector(F.array(*STATISTICS)).alias("x"))
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, maxBins=BINS,
                                    featureSubsetStrategy="onethird", subsamplingRate=0.7, seed=5).fit(data)
    rules = sorted({path for tree in forest.trees for path in tree_paths(tree)})
    if not rules:
        return base
    # Hundreds of rules make too large an expression; those that the lasso keeps are few.
    held = rows.mapInArrow(_indicators(rules), "label double, held array<double>").cache()
    support = held.select(F.posexplode("held")).groupBy("pos").agg(F.avg("col").alias("share")).collect()
    shares = {r["pos"]: r["share"] for r in support}
    usable = [i for i in range(len(rules)) if SUPPORT <= shares[i] <= 1 - SUPPORT]
    if not usable:
        return base
    rules = [rules[i] for i in usable]
    data = rows.mapInArrow(_indicators(rules), "label double, held array<double>")
    data = data.select("label", array_to_vector("held").alias("x")).cache()
    held.unpersist()
    lasso = LogisticRegression(featuresCol="x", labelCol="label", elasticNetParam=1.0, regParam=LASSO, maxIter=60, standardization=False).fit(data)
    data.unpersist()
    kept = tuple((r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray()) if w != 0.0)
    return RuleEnsemble(float(lasso.intercept), kept)


def _indicators(rules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = dict(zip(batch.schema.names, (c.to_numpy() for c in batch.columns)))
            held = np.ones((batch.num_rows, len(rules)))
            for i, rule in enumerate(rules):
                for name, greater, bound in rule:
                    held[:, i] *= values[name] > bound if greater else values[name] <= bound
            ends = pa.array(np.arange(0, held.size + 1, len(rules)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.ListArray.from_arrays(ends, pa.array(held.ravel()))], ["label", "held"])

    return run


def score(docs: DataFrame, ensemble: RuleEnsemble, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` and the score (0 to 1) of every whole text, by column expressions only. Null text scores as empty."""
    rows = with_statistics(docs, [F.col(c) for c in keep], text)
    return rows.select(*[f"kept {i}" for i in range(len(keep))], ensemble.score().alias("score")).toDF(*keep, "score")


def keep_quality(docs: DataFrame, labels: DataFrame, learning: Column, least: float = 0.3) -> DataFrame:
    """The documents, all columns, that score `least` or more."""
    ensemble = fit(docs, labels, learning)
    names = docs.columns
    scored = score(docs, ensemble, names).toDF(*[f"c{i}" for i in range(len(names) + 1)])
    kept = scored.where(F.col(f"c{len(names)}") >= least)
    return kept.select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(names)])
