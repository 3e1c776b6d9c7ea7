"""A stored index of text pieces, so that a search reads postings and only then the texts that may hold what it looks for.

Texts are upper-cased and cut into their distinct pieces of one to LONGEST characters. Posts are dealt to blocks of some thousands and
numbered there; a posting is a piece and a block with the numbers of the posts that hold the piece, so a piece that is in every text is a row for each
block, not for each post. Postings lie in folders by the hash of the piece. A needle's candidates of a block are the numbers that all of its
pieces share. Needles of LONGEST characters or fewer are pieces themselves and need no text; others are tested on the texts of their candidates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketpulse.operators.sizes import broadcast_if_small, is_small
from marketpulse.schemas import POST_KEY
from marketpulse.session import materialize
from marketpulse.store.log import exists, folders, snapshot

LONGEST = 3
#: Posts of a block, about, and folders of postings.
BLOCK_POSTS, FOLDERS = 4096, 64
#: Blocks that are named in the filter of the texts; with more, all blocks are read.
NAMED_BLOCKS = 1000
_POSTINGS = "piece string, block long, posts array<int>, run string, folder int"
_TEXTS = "block long, number int, source string, platform_id string, upper string, run string"


def _pieces(upper: Column, length: int) -> Column:
    """Every piece of that length, one at each place: a look-ahead takes them in one pass. The point after it goes on by a whole
    character, never into one that Java keeps as two."""
    return F.regexp_extract_all(upper, F.lit(rf"(?s)(?=(.{{{length}}}))."), F.lit(1))


def _distinct_pieces(upper: Column) -> Column:
    """The distinct pieces of one to LONGEST characters. The text is gone through once, for the longest piece at each place
    (at its end: what is left); the shorter ones are how the distinct ones of these begin."""
    heads = F.array_distinct(F.regexp_extract_all(upper, F.lit(rf"(?s)(?=(.{{1,{LONGEST}}}))."), F.lit(1)))
    begins = F.transform(heads, lambda head: F.array(*[F.substring(head, 1, n) for n in range(1, LONGEST + 1)]))
    return F.array_distinct(F.flatten(begins))


def _folder(piece: Column) -> Column:
    return F.pmod(F.xxhash64(piece), F.lit(FOLDERS)).cast("int")


@dataclass(frozen=True)
class TextIndex:
    """The complete runs of an index."""

    spark: SparkSession
    path: str
    runs: list[str]

    def _read(self, table: str, schema: str) -> DataFrame:
        if not self.runs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(*[f"{self.path}/{table}/{r}" for r in self.runs])

    @property
    def postings(self) -> DataFrame:
        return self._read("postings", _POSTINGS)

    @property
    def texts(self) -> DataFrame:
        return self._read("texts", _TEXTS)


def open_index(spark: SparkSession, path: str) -> TextIndex:
    # A run's postings are written after its texts.
    found = [name for name in folders(spark, f"{path}/postings") if exists(spark, f"{path}/postings/{name}/_SUCCESS")]
    return TextIndex(spark, path, sorted(found, key=lambda name: int(name.rsplit("_", 1)[1])))


def add(posts: DataFrame, path: str, run: str) -> TextIndex:
    """Index posts (source, platform_id, text), each key once, as one run `run=<first>_<last>`; a repeated run replaces itself."""
    spark = posts.sparkSession
    keyed = posts.filter("text is not null").select(*POST_KEY, F.upper("text").alias("upper"))
    blocks = max(1, -(-keyed.count() // BLOCK_POSTS))
    numbered = keyed.withColumn("block", F.pmod(F.xxhash64(*POST_KEY), F.lit(blocks)))
    # A block holds about BLOCK_POSTS posts.
    number = F.row_number().over(Window.partitionBy("block").orderBy(*POST_KEY)) - 1
    numbered.withColumn("number", number).select("block", "number", *POST_KEY, "upper").repartitionByRange("block").sortWithinPartitions(
        "block", "number").write.mode("overwrite").parquet(f"{path}/texts/{run}")
    texts = spark.read.schema(_TEXTS.removesuffix(", run string")).parquet(f"{path}/texts/{run}")
    rows = texts.select("block", "number", F.explode(_distinct_pieces(F.col("upper"))).alias("piece"))
    rows.groupBy("piece", "block").agg(F.array_sort(F.collect_list("number")).alias("posts")).withColumn("folder", _folder(F.col("piece"))).hint(
        "rebalance", "folder").sortWithinPartitions("folder", "piece").write.mode("overwrite").partitionBy("folder").parquet(f"{path}/postings/{run}")
    return open_index(spark, path)


def update(spark: SparkSession, store: str, path: str) -> TextIndex:
    """Index what a store of posts holds beyond the index. Stored texts never change, so runs are only added."""
    index, now = open_index(spark, path), snapshot(spark, store)
    done = int(index.runs[-1].rsplit("_", 1)[1]) if index.runs else -1
    last = now.runs[-1][1]
    if index.runs and last <= done:
        return index
    return add(now.read("posts").filter(F.col("batch_id") > done), path, f"run={done + 1}_{max(last, done + 1)}")


def candidates(index: TextIndex, needles: DataFrame) -> DataFrame:
    """(needle, run, block, number) of the posts that hold all pieces of a needle. Only postings are read, of the folders asked for.

    needles: distinct `needle`, upper-cased, not empty.
    """
    length = F.least(F.length("needle"), F.lit(LONGEST))
    pieces = F.when(F.length("needle") <= LONGEST, F.array("needle")).otherwise(F.array_distinct(_pieces(F.col("needle"), LONGEST)))
    asked = needles.filter(length > 0).select("needle", F.size(pieces).alias("wanted"), F.explode(pieces).alias("piece"))
    asked = materialize(asked, "asked-pieces")
    wanted = [r[0] for r in asked.select(_folder(F.col("piece"))).distinct().collect()]  # at most FOLDERS
    met = index.postings.filter(F.col("folder").isin(wanted)).join(broadcast_if_small(asked), "piece")
    # Per needle and block a list for each of its pieces.
    shared = met.groupBy("needle", "wanted", "run", "block").agg(F.collect_list("posts").alias("lists")).filter(F.size("lists") == F.col("wanted"))
    both = F.aggregate(F.slice("lists", 2, F.size("lists")), F.col("lists")[0], lambda done, more: F.array_intersect(done, more))
    return shared.select("needle", "run", "block", F.explode(both).alias("number"))


def search(index: TextIndex, needles: DataFrame) -> DataFrame:
    """Post key and needle columns for every post whose upper-cased text contains a needle; equal rows appear once.

    needles: `needle`, upper-cased, and further columns. Empty needles are found nowhere.
    """
    found = materialize(candidates(index, needles.select("needle").distinct()), "candidates")
    place = ["run", "block", "number"]
    short = found.filter(F.length("needle") <= LONGEST).join(index.texts.select(*place, *POST_KEY), place)
    long = found.filter(F.length("needle") > LONGEST)
    texts = index.texts
    blocks = [r[0] for r in long.select("block").distinct().limit(NAMED_BLOCKS + 1).collect()]
    if len(blocks) <= NAMED_BLOCKS:
        texts = texts.filter(F.col("block").isin(blocks))
    tested = (F.broadcast(long) if is_small(long) else long).join(texts, place).filter(F.contains("upper", F.col("needle")))
    hits = short.unionByName(tested.drop("upper")).select(*POST_KEY, "needle")
    return hits.join(broadcast_if_small(needles), "needle").drop("needle").distinct()


def finder(index: TextIndex):
    """`mentions.substring_join` by the index: of the posts only keys and carried columns are read, not their texts."""
    def find(posts: DataFrame, needles: DataFrame, carry: tuple[str, ...] = (), same: dict[str, str] | None = None, **_) -> DataFrame:
        rows = search(index, needles)
        pairs = same or {}
        posts = posts.select(*POST_KEY, *[c for c in (*carry, *pairs.values()) if c not in POST_KEY])
        for needle_column, post_column in pairs.items():
            if post_column in POST_KEY:
                rows = rows.filter(F.col(needle_column) == F.col(post_column))
        rows = rows.join(posts, list(POST_KEY))
        for needle_column, post_column in pairs.items():
            rows = rows.filter(F.col(needle_column) == F.col(post_column))
        return rows

    return find
