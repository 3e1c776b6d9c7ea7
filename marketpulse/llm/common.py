"""What the operators of this folder share: tables, folds, word patterns, id joins, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketpulse.operators.sizes import broadcast_if_small
from marketpulse.session import configure, materialize

#: White space of the contracts: the six ASCII characters, also what bytes.split() takes.
SPACE = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")) % folds


def words(text: Column) -> Column:
    """Words between ASCII white space; an empty array for null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): component is the smallest node reachable.

    Alternating large and small stars; every round is written to the shared folder, so a lost executor costs a round
    at most and lineage stays short. A hub with many edges is met in a join that adaptive execution can split.
    Nodes are longs; rows with a null end or two equal ends are ignored.
    """
    edges = edges.toDF("a", "b").where("a != b")
    edges = materialize(_star(_star(edges, large=True), large=False), "stars")
    while True:
        after = materialize(_star(_star(edges, large=True), large=False), "stars")
        if _mark(after) == _mark(edges):
            break
        edges = after
    roots = after.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return after.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: hang each node's larger neighbours on its smallest. Small: hang a node and its smaller ones there."""
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = near.groupBy("a").agg(F.min("b").alias("m"))
        out = near.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def one_row_per_id(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows, with one row (the first by a hash of all columns) for an id that occurs more than once.

    Rows without id all stay. Only repeated ids are shuffled with their columns.
    """
    again = docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key)
    again = materialize(again, "repeated-ids")
    if not again.limit(1).count():
        return docs
    again = broadcast_if_small(again)
    single = docs.join(again, key, "left_anti").select(docs.columns)
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*docs.columns)))
    kept = docs.join(again, key, "left_semi").withColumn("place of row", place).where("`place of row` = 1")
    return single.unionByName(kept.select(docs.columns))
