"""A Merkle manifest of a data set: a digest per document, a tree of threes per source, a tree of threes over the sources.

Nodes of a level are never rows of their own. A tree is cut into aligned blocks of 3**HEIGHT nodes, and a block keeps each of its
levels as one string of hex digests side by side, 64 characters each:

1. Leaves are sorted by range over (source, doc_id), so a source of any size is spread over tasks; a place is the place in the
   part plus the rows of the source in the parts before it.
2. The leaves of a block, side by side, are its lowest level. Substrings of three digests, hashed, are the next one, up to one digest.
3. The digests left of all blocks are the leaves of a smaller tree: the same again, until each source has one. The sources' digests,
   in order, are the leaves of one more tree of this kind.
4. Downwards, the substrings left and right of a node in its run of three are its siblings; those of its block follow. Paths are joined
   block by block, so documents are not shuffled a second time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketpulse.operators.sizes import broadcast_if_small
from marketpulse.session import configure, materialize

WIDTH = 3
#: Levels of a block; it holds WIDTH**HEIGHT nodes of its lowest level at most.
HEIGHT = 6
BLOCK = WIDTH**HEIGHT
DIGEST = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left:binary,right:binary>>"


def field(value: Column) -> Column:
    """`-` for null, else the bytes of the value in UTF-8, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """Digest of one document."""
    return F.sha2(F.concat(*[field(c) for c in (doc_id, source, lang, n_chars, text)]).cast("binary"), 256)


def _cut(level: Column, begin: Column, n: Column) -> Column:
    """n digests of a level from place `begin` on. Levels are binary: cutting them takes no walk over characters."""
    return F.substring(level, begin * DIGEST + 1, n * DIGEST)


def _parents(level: Column) -> Column:
    runs = F.ceil(F.octet_length(level) / (WIDTH * DIGEST)).cast("int")
    hashed = F.transform(F.sequence(F.lit(0), runs - 1), lambda j: F.sha2(_cut(level, j * WIDTH, F.lit(WIDTH)), 256))
    return F.array_join(hashed, "").cast("binary")


def _height(n: Column) -> Column:
    """Levels above the lowest one that a block has in a tree of n nodes: until one digest is left, HEIGHT at most."""
    height = F.lit(HEIGHT)
    for h in range(HEIGHT - 1, -1, -1):
        height = F.when(n <= WIDTH**h, h).otherwise(height)
    return height


def _levels(lowest: Column, height: Column) -> Column:
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(HEIGHT)), F.array(lowest),
        lambda done, h: F.when(h <= height, F.concat(done, F.array(_parents(F.element_at(done, -1))))).otherwise(done))


def siblings(levels: Column, height: Column, place: Column) -> Column:
    """What lies left and right of the node's own place in its run of three, per level of the block, lowest first."""
    def at(h: Column) -> Column:
        level, here = levels[h], F.floor(place / F.pow(F.lit(WIDTH), h)).cast("int")
        first = here - here % WIDTH
        return F.struct(_cut(level, first, here - first).alias("left"), _cut(level, here + 1, first + WIDTH - 1 - here).alias("right"))

    return F.when(height > 0, F.transform(F.sequence(F.lit(0), height - 1), at)).otherwise(F.array().cast(_PATH))


def places(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """The rows with `place` (from 0, in the given order) and `n` (rows) within their group. Written once, sorted by range."""
    by = [group, *order]
    sorted_rows = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    marked = materialize(sorted_rows.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")), name)
    runs = marked.groupBy(group, "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    # One row per part and group in it: the windows add up a few rows for each part that a group lies in.
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(group, "_part", "_first", before.alias("_before"), F.sum("_rows").over(whole).alias("n"))
    runs = broadcast_if_small(materialize(runs, f"{name}-runs"))
    return marked.join(runs, [group, "_part"]).withColumn("place", F.col("_row") - F.col("_first") + F.col("_before")).drop(
        "_row", "_first", "_before", "_part")


@dataclass(frozen=True)
class Tree:
    """Written blocks, lowest level first, and the digest left of each group (group, root)."""

    stages: list[DataFrame]
    roots: DataFrame


def build(nodes: DataFrame, group: str, carried: list[str], name: str) -> Tree:
    """Blocks of all levels over nodes (group, place, n, digest, further columns that are carried in the lowest blocks)."""
    stages: list[DataFrame] = []
    while True:
        keep = carried if not stages else []
        members = F.array_sort(F.collect_list(F.struct("place", *keep, "digest")))
        blocks = (
            nodes.groupBy(group, F.floor(F.col("place") / BLOCK).cast("long").alias("block"))
            # n is the same for all nodes of a group; a block collects BLOCK rows at most.
            .agg(F.max("n").alias("n"), members.alias("members"))
            .select(group, "block", "n", *[F.col(f"members.{c}").alias(c) for c in keep], _height(F.col("n")).alias("height"),
                    F.array_join("members.digest", "").cast("binary").alias("lowest"))
            .select("*", _levels(F.col("lowest"), F.col("height")).alias("levels")).drop("lowest"))
        blocks = materialize(blocks, f"{name}-{len(stages)}")
        stages.append(blocks)
        nodes = blocks.select(group, F.col("block").alias("place"), F.ceil(F.col("n") / BLOCK).cast("long").alias("n"),
                              F.element_at("levels", -1).cast("string").alias("digest"))
        if not nodes.where("n > 1").limit(1).count():
            return Tree(stages, nodes.select(group, F.col("digest").alias("root")))


def _members(blocks: DataFrame, *columns: Column) -> DataFrame:
    """One row per node of the blocks' lowest level, `i` its place in the block."""
    return blocks.select("*", F.explode(F.sequence(F.lit(0), (F.octet_length(F.col("levels")[0]) / DIGEST).cast("int") - 1)).alias("i")).select(*columns)


def paths(tree: Tree, group: str, above: DataFrame) -> DataFrame:
    """The lowest blocks with `above`: the path from the block's own digest to the top.

    above: group, above (path of the group's root).
    """
    upper = above.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(tree.stages[1:]):
        held = blocks.join(broadcast_if_small(upper), [group, "block"])
        upper = materialize(_members(
            held, F.col(group), (F.col("block") * BLOCK + F.col("i")).alias("block"),
            F.concat(siblings(F.col("levels"), F.col("height"), F.col("i")), "above").alias("above")), "paths")
    return tree.stages[0].join(broadcast_if_small(upper), [group, "block"])


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, digest, lambda done, s: F.sha2(F.concat(s["left"], done.cast("binary"), s["right"]), 256))


def manifest(docs: DataFrame, tampered_text: Column | None = None) -> DataFrame:
    """Per row: doc_id, source, leaf, subroot (of its source), root, proof_sha256, folded_root, verified.

    docs: doc_id, source, lang, n_chars, text; other columns are not read. tampered_text: what a copy to be checked holds as text;
    the row's own text if not given. folded_root is the root that the copy's digest gives with the siblings of the manifest;
    verified says whether it is the root. proof_sha256 is the digest of those siblings, from the leaf to the root.

    Nulls are part of a digest (`-`), and a null source is a source, the first one. Rows without doc_id come first in their source. Repeated
    rows are leaves each; rows of one doc_id are ordered by their digests. A source of one document has its leaf as subroot, a table
    of one source its subroot as root. An empty table gives an empty result. Texts are hashed whole.
    """
    configure(docs.sparkSession)
    doc_id, source, lang, n_chars, text = (F.col(c) for c in FIELDS)
    told = text if tampered_text is None else tampered_text
    changed = ~told.eqNullSafe(text)
    leaves = docs.select(
        doc_id.cast("long").alias("doc_id"), source.cast("string").alias("source"),
        # Orders null before all others, and the others by their bytes; never null itself.
        F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("")).alias("key"),
        leaf(doc_id, source, lang, n_chars, text).alias("digest"),
        F.when(changed, leaf(doc_id, source, lang, n_chars, told)).alias("told"))
    # Written before they are sorted: to learn the ranges, the sort reads its input twice.
    leaves = places(materialize(leaves, "digests"), "key", ["doc_id", "digest"], "leaves")
    tree = build(leaves, "key", ["doc_id", "source", "told"], "blocks")
    tops = places(tree.roots.select(F.lit("").alias("all"), "key", F.col("root").alias("digest")), "all", ["key"], "subroots")
    top = build(tops, "all", ["key"], "top")
    base = top.roots.select("all", "root", F.array().cast(_PATH).alias("above"))
    held = paths(top, "all", base.drop("root"))
    above = _members(held, F.col("all"), F.col("key")[F.col("i")].alias("key"),
                     F.col("levels")[0].alias("level"), "i", F.concat(siblings(F.col("levels"), F.col("height"), F.col("i")), "above").alias("above"))
    above = materialize(above.select("all", "key", _cut(F.col("level"), F.col("i"), F.lit(1)).cast("string").alias("subroot"), "above"), "top-paths")
    blocks = paths(tree, "key", above.select("key", "above"))
    subroots = above.join(F.broadcast(base.select("all", "root")), "all").select("key", "subroot", "root")
    blocks = blocks.join(broadcast_if_small(subroots), "key")
    i = F.col("i")
    rows = _members(
        blocks, F.col("doc_id")[i].alias("doc_id"), F.col("source")[i].alias("source"),
        _cut(F.col("levels")[0], i, F.lit(1)).cast("string").alias("leaf"), F.col("told")[i].alias("told"), "subroot", "root",
        F.concat(siblings(F.col("levels"), F.col("height"), i), "above").alias("path"))
    rows = rows.select("*", F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"]).cast("string")), "").cast("binary"), 256).alias("proof_sha256"),
                       fold(F.coalesce("told", "leaf"), F.col("path")).alias("folded_root"))
    return rows.select("doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))


def without_newlines(doc_id: Column, text: Column) -> Column:
    """The text without \\n where 2 divides the crc32 of the id as text, else the text."""
    return F.when(F.crc32(doc_id.cast("string")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
