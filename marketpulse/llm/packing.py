"""Packing into token-budget batches inside optimal length buckets.

A histogram of all lengths goes to the driver: its size is bounded by the resolution, not by the data. Dynamic programming
finds the bucket boundaries that make the padding least, the budget being one of them. Inside each bucket batches of (budget / padded length) documents
are formed; large buckets are dealt out first, so no task orders more than PART_ROWS documents or so.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketpulse.llm.common import n_words
from marketpulse.session import configure, materialize

BUCKETS = 16
BUDGET = 16_384
#: Lengths to 2**(BITS + 1) are exact; longer ones are rounded up to BITS leading bits and one, that is by less than 1 %.
BITS = 7
PART_ROWS = 20_000


def edge(length: Column) -> Column:
    """The length a document is padded to at least: its own, rounded up as the resolution says; 1 for none."""
    step = F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double"))) - BITS))
    return F.greatest(F.lit(1), F.ceil(length / step) * step).cast("long")


def boundaries(edges: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS, budget: int | None = None) -> list[int]:
    """Upper ends of at most `buckets` buckets over the sorted edges with the least total padded length.

    With a budget no bucket holds edges both up to it and beyond it; where there are both, two buckets are the least.
    best[j] after m rounds: the least padded length of the first j edges in m buckets at most. Ties: the fewer buckets, the earlier cut.
    """
    n = len(edges)
    if not n:
        return []
    before = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    best = np.concatenate([[0.0], edges * before[1:]])
    fit = 0 if budget is None else int(np.searchsorted(edges, budget, side="right"))
    if 0 < fit < n:
        best[fit + 1 :], buckets = np.inf, max(buckets, 2)
    cuts = [np.zeros(n + 1, np.int64)]
    for _ in range(min(buckets, n) - 1):
        new, cut = best.copy(), np.full(n + 1, -1, np.int64)
        for j in range(2, n + 1):
            least = max(1, fit) if j > fit else 1
            cost = best[least:j] + edges[j - 1] * (before[j] - before[least:j])
            i = int(cost.argmin())
            if cost[i] < new[j]:
                new[j], cut[j] = cost[i], i + least
        best = new
        cuts.append(cut)
    ends, j, m = [], n, len(cuts) - 1
    while j > 0:
        while m > 0 and cuts[m][j] < 0:
            m -= 1
        ends.append(int(edges[j - 1]))
        j = int(cuts[m][j]) if m > 0 else 0
        m -= 1
    return ends[::-1]


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, length: Column | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, bucket (from 0), padded_length, part, batch, slot (from 0), over_budget.

    (bucket, part, batch) names a batch; its documents times padded_length stay within the budget, or it holds one document
    that is longer (over_budget). Every document is in one batch, whole. Length: words of `text` between white space
    if not given; null and empty texts have 0 tokens and are padded to the first bucket. A null doc_id is packed as any
    other; repeated rows are packed each. An empty table gives an empty result.
    """
    spark = configure(docs.sparkSession)
    length = n_words(F.col("text").cast("string")) if length is None else length.cast("long")
    rows = docs.select(F.col("doc_id"), F.coalesce(length, F.lit(0)).alias("n_tokens"))
    # What fits the budget is not rounded up beyond it.
    fits = F.col("n_tokens") <= budget
    rows = rows.withColumn("edge", F.when(fits, F.least(edge(F.col("n_tokens")), F.lit(max(1, budget)).cast("long"))).otherwise(edge(F.col("n_tokens"))))
    rows = materialize(rows, "lengths")
    histogram = sorted((r["edge"], r["n"]) for r in rows.groupBy("edge").agg(F.count(F.lit(1)).alias("n")).collect())
    edges, counts = np.array([e for e, _ in histogram], np.int64), np.array([n for _, n in histogram], np.int64)
    ends = boundaries(edges, counts, buckets, budget)
    held = [int(n) for n in np.add.reduceat(counts, np.concatenate([[0], np.searchsorted(edges, ends[:-1], side="right")]))] if ends else []
    bucket, padded, parts, capacity = (F.lit(None).cast("int"), F.lit(None).cast("long"), F.lit(1), F.lit(1))
    for i in range(len(ends) - 1, -1, -1):
        here = F.col("edge") <= ends[i]
        bucket = F.when(here, i).otherwise(bucket)
        padded = F.when(here, F.lit(ends[i]).cast("long")).otherwise(padded)
        parts = F.when(here, -(-held[i] // PART_ROWS)).otherwise(parts)
        capacity = F.when(here, max(1, budget // ends[i])).otherwise(capacity)
    salt = F.pmod(F.xxhash64("doc_id", "n_tokens"), F.col("parts")).cast("int")
    dealt = rows.select("doc_id", "n_tokens", bucket.alias("bucket"), padded.alias("padded_length"), parts.alias("parts"),
                        capacity.alias("capacity")).withColumn("part", salt)
    place = F.row_number().over(Window.partitionBy("bucket", "part").orderBy("doc_id", "n_tokens")) - 1
    dealt = dealt.withColumn("place", place)
    return dealt.select("doc_id", "n_tokens", "bucket", "padded_length", "part",
                        F.floor(F.col("place") / F.col("capacity")).cast("long").alias("batch"),
                        (F.col("place") % F.col("capacity")).cast("int").alias("slot"),
                        (F.col("n_tokens") > budget).alias("over_budget"))
