"""Near-duplicates by circulant MinHash: candidates from bands, links from exact Jaccard on whole shingle sets.

Two fixed permutations of 2**20 places make all signature coordinates: the first scatters a shingle's place, the second,
shifted by k places, gives its k-th value. Rows of six coordinates form 40 bands, so two documents at similarity 0.8 share
no band with probability 5e-6, and less above it.

1. Features per row: shingle set (64-bit hashes), its size, a 128-bit digest, the band keys. Sets are not kept.
2. Documents with equal sets form a class; from here on only the smallest id of a class works.
3. Each band bucket with two classes or more gives star edges to its smallest id; their connected components bound what
   can be linked. No pairs of a bucket are made.
4. Texts of a component that fits into one block are one task, which counts exact intersections by posting lists and
   returns a spanning forest of the links. In larger components each document is first compared with the document it shares
   most buckets with, in bounded groups; the largest group linked so is settled. Only blocks of the remaining documents
   meet all blocks, one task for each pair, so a group of near-copies of any size costs one pass over its texts.
5. Components of the links give the answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketpulse.llm.common import components, one_row_per_id
from marketpulse.operators.sizes import broadcast_if_small
from marketpulse.session import configure, materialize

PLACES = 1 << 20
ROWS, BANDS = 6, 40
SEED = 7
CHUNK = 1 << 20
#: Shingles of a block of texts: what one task holds of a component, twice.
BLOCK_SHINGLES = 300_000
_STEP = 0x9E3779B97F4A7C15
_FEATURES = "doc_id long, n_shingles long, digest_hi long, digest_lo long, bands array<long>"


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; A-Z is lower-cased, nothing else.

    Fewer words than the width are one shingle; no words or null: empty.
    """
    found = text.lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(width, len(found))
    out = np.full(len(found) - width + 1, width, np.uint64)
    for i in range(width):
        out = out * np.uint64(_STEP) + each[i : len(found) - width + 1 + i]
    return np.unique(_mix(out))


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(SEED)
    scatter = draw.permutation(PLACES).astype(np.int64)
    values = draw.permutation(PLACES).astype(np.uint32)
    return scatter, np.concatenate([values, values[: ROWS * BANDS]])


def band_keys(sets: list[np.ndarray], scatter: np.ndarray, values: np.ndarray) -> np.ndarray:
    """One row of BANDS keys for each non-empty set."""
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    places = scatter[(np.concatenate(sets) & np.uint64(PLACES - 1)).astype(np.int64)]
    seen = np.empty(len(places), np.uint32)
    keys = np.empty((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(sets), band + 1, np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            np.take(values[k : k + PLACES], places, out=seen, mode="clip")
            key = _mix(key * np.uint64(_STEP) + np.minimum.reduceat(seen, starts))
        keys[:, band] = key
    return keys.view(np.int64)


def _features(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scatter, values = _permutations()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(ids):
                begin, sets, held = at, [], 0
                while at < len(ids) and held < CHUNK:
                    sets.append(shingle_set(texts[at].as_py(), width))
                    held += len(sets[-1])
                    at += 1
                sizes = np.array([len(s) for s in sets], np.int64)
                digests = np.zeros((len(sets), 2), np.uint64)
                for i, s in enumerate(sets):
                    whole = xxhash.xxh3_128_intdigest(s.tobytes())
                    digests[i] = whole >> 64, whole & 0xFFFFFFFFFFFFFFFF
                full = [s for s in sets if len(s)]
                keys = band_keys(full, scatter, values) if full else np.empty((0, BANDS), np.int64)
                ends = np.concatenate([[0], np.cumsum((sizes > 0) * BANDS)]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(begin, len(sets)), pa.array(sizes), *(pa.array(d.view(np.int64)) for d in digests.T.copy()), bands],
                    ["doc_id", "n_shingles", "digest_hi", "digest_lo", "bands"])

    return run


def link_forest(ids: np.ndarray, sets: list[np.ndarray], percent: int, settled: np.ndarray | None = None) -> list[tuple[int, int]]:
    """(id, smallest id of its linked group) for the documents that have links among the given ones.

    Rows of intersections are counted by posting lists. Once the documents linked to the one with the most links among a
    few are known, members of its growing group need no row of their own: what is left of the others gets one, against all.
    Documents marked as settled are known to be one group: they are not returned, and their smallest id stands for them.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    shingles, code = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(code, kind="stable")
    posted = owner[order]
    counts = np.bincount(code, minlength=len(shingles))
    shared = counts > 1
    first = np.cumsum(counts) - counts
    at = np.cumsum(sizes) - sizes
    group = np.arange(n)

    def row(x: int) -> np.ndarray:
        own = code[at[x] : at[x] + sizes[x]]
        own = own[shared[own]]
        if not len(own):
            return own
        met = counts[own]
        places = np.repeat(first[own] - np.concatenate([[0], np.cumsum(met)[:-1]]), met) + np.arange(met.sum())
        common = np.bincount(posted[places], minlength=n)
        common[x] = sizes[x]  # its shingles that nothing else here has are not counted above
        return np.flatnonzero(100 * common >= percent * (sizes[x] + sizes - common))

    def join(linked: np.ndarray) -> None:
        if len(linked) > 1:
            groups = np.unique(group[linked])
            if len(groups) > 1:
                group[np.isin(group, groups)] = groups[0]

    known = np.zeros(n, bool) if settled is None else settled
    if known.any():
        anchor, rows = int(np.flatnonzero(known)[0]), {}
        group[known] = anchor
    else:
        rows = {x: row(x) for x in range(0, n, max(1, n // 8))}
        anchor = max(rows, key=lambda x: len(rows[x]))
    for linked in rows.values():
        join(linked)
    for x in range(n):
        if x not in rows and group[x] != group[anchor]:
            join(row(x))
    least: dict[int, int] = {}
    for g, i in zip(group.tolist(), ids.tolist()):
        least[g] = min(i, least.get(g, i))
    if known.any():
        least[int(group[anchor])] = int(ids[known].min())
    return [(i, least[g]) for g, i, k in zip(group.tolist(), ids.tolist(), known.tolist()) if i != least[g] and not k]


def _verify(width: int, percent: int):
    def run(pool: pa.Table) -> pa.Table:
        # Of repeated ids each row takes part; a link between rows of one id is none.
        texts = pool.column("text").cast(pa.binary())
        sets = [shingle_set(t.as_py(), width) for t in texts]
        held = [i for i, s in enumerate(sets) if len(s)]
        ids, settled = pool.column("doc_id").to_numpy()[held], pool.column("settled").to_numpy()[held]
        forest = sorted(set(link_forest(ids, [sets[i] for i in held], percent, settled))) if len(held) > 1 else []
        return pa.table({"a": pa.array([a for a, _ in forest], pa.int64()), "b": pa.array([b for _, b in forest], pa.int64()),
                         "whole": pa.array([pool.column("whole")[0].as_py()] * len(forest), pa.bool_())})

    return run


def _verify_anchor(width: int, percent: int):
    def similar(a: np.ndarray, b: np.ndarray) -> bool:
        common = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * common >= percent * (len(a) + len(b) - common)

    def run(pool: pa.Table) -> pa.Table:
        ids, anchor = pool.column("doc_id").to_pylist(), pool.column("anchor")[0].as_py()
        sets = [shingle_set(t.as_py(), width) for t in pool.column("text").cast(pa.binary())]
        hubs = [s for s, i in zip(sets, ids) if i == anchor and len(s)]
        linked = sorted({i for s, i in zip(sets, ids) if i != anchor and len(s) and any(similar(s, h) for h in hubs)})
        return pa.table({"a": pa.array(linked, pa.int64()), "b": pa.array([anchor] * len(linked), pa.int64())})

    return run


def _anchor_links(docs: DataFrame, members: DataFrame, hits: DataFrame, width: int, percent: int) -> DataFrame:
    """Exact links (a, b) of members (node, n) with the one document each shares most buckets with.

    A document that many share is sent to each bounded part of them.
    """
    nearest = hits.groupBy("doc_id").agg(F.max_by("least", F.struct("shared", -F.col("least"))).alias("anchor"))
    pairs = materialize(members.select(F.col("node").alias("doc_id"), "n").join(nearest, "doc_id"), "anchors")
    sizes = pairs.groupBy("anchor").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("parts"))
    sizes = broadcast_if_small(materialize(sizes, "anchor-sizes"))
    followers = pairs.join(sizes, "anchor").select("doc_id", "anchor", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"))
    hubs = sizes.select(F.col("anchor").alias("doc_id"), "anchor", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pools = docs.join(broadcast_if_small(followers.unionByName(hubs)), "doc_id").select("anchor", "part", "doc_id", "text")
    return pools.groupBy("anchor", "part").applyInArrow(_verify_anchor(width, percent), "a long, b long")


def _settle(members: DataFrame, groups: DataFrame) -> DataFrame:
    """component, node, settled, and the numbers of blocks of settled and of other documents.

    Settled are the documents of the largest of the linked groups (node, component) of a component.
    """
    found = members.join(groups.toDF("node", "found"), "node", "left").withColumn("found", F.coalesce("found", "node"))
    found = materialize(found, "grouped")
    mass = found.groupBy("component", "found").agg(F.sum("n").alias("n"))
    top = mass.groupBy("component").agg(F.max_by("found", F.struct("n", -F.col("found"))).alias("top"), F.max("n").alias("most"), F.sum("n").alias("total"))
    blocks = lambda n: F.ceil(n / BLOCK_SHINGLES).cast("int")
    top = top.select("component", "top", blocks(F.col("most")).alias("settled_parts"), blocks(F.col("total") - F.col("most")).alias("rest_parts"))
    rows = found.join(broadcast_if_small(materialize(top, "settled")), "component")
    return rows.select("component", "node", (F.col("found") == F.col("top")).alias("settled"), "settled_parts", "rest_parts")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id linked through any chain), kept (doc_id = component_id).

    Two documents are linked if the Jaccard similarity of their sets of distinct word shingles is percent/100 or more.
    Null, empty and blank texts have no shingles and link with nothing. A row without doc_id links with nothing either: its
    component_id is null and it is kept. Rows with one doc_id count as one document: they share a component. An empty
    table gives an empty result; other columns are not read.
    """
    spark = configure(docs.sparkSession)
    # Column doc_id is taken as a long.
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_features(width), _FEATURES)
    made = materialize(made, "minhash")
    full = made.where("n_shingles > 0 and doc_id is not null")
    digest = ["digest_hi", "digest_lo"]
    copies = full.groupBy(*digest).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    copies = broadcast_if_small(materialize(copies, "copies"))
    classes = full.join(copies, digest, "left").withColumn("first", F.coalesce("first", "doc_id"))

    keyed = classes.where("doc_id = first").select("doc_id", F.explode("bands").alias("key"))
    # A count of two ids also when one id's rows differ; the star edge below then has equal ends and goes.
    buckets = keyed.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    buckets = broadcast_if_small(materialize(buckets.where("least != most").drop("most"), "buckets"))
    hits = keyed.join(buckets, "key").where("doc_id != least").groupBy("doc_id", "least").agg(F.count(F.lit(1)).alias("shared"))
    hits = materialize(hits, "star-edges")
    coarse = components(hits.select("doc_id", "least"))

    sized = materialize(coarse.join(full.groupBy(F.col("doc_id").alias("node")).agg(F.sum("n_shingles").alias("n")), "node"), "sized")
    parts = sized.groupBy("component").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("parts"))
    member = materialize(sized.join(broadcast_if_small(parts), "component"), "members")
    dealt = member.where("parts = 1").select("component", "node", F.lit(False).alias("settled"), F.lit(0).alias("settled_parts"),
                                             F.lit(1).alias("rest_parts"), F.lit(True).alias("whole"))
    large = member.where("parts > 1")
    near = None
    if large.limit(1).count():
        near = materialize(_anchor_links(docs, large, hits, width, percent), "anchor-links")
        grouped = components(near)
        dealt = materialize(dealt.unionByName(_settle(large, grouped).withColumn("whole", F.lit(False))), "dealt")
    own = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.when(F.col("settled"), F.col("settled_parts")).otherwise(F.col("rest_parts")))).cast("int")
    block = own + F.when(F.col("settled"), F.col("rest_parts")).otherwise(0)
    every = lambda n: F.filter(F.sequence(F.lit(0), F.greatest(F.lit(1), n) - 1), lambda x: x < n)
    # Blocks of settled documents meet the others only; of the others, each meets every one.
    total = F.col("rest_parts") + F.col("settled_parts")
    other = F.explode(F.when(F.col("settled"), every(F.col("rest_parts"))).when(total == 1, F.array(F.lit(0))).otherwise(
        F.filter(every(total), lambda x: x != F.col("block"))))
    pools = (docs.join(broadcast_if_small(dealt.withColumnRenamed("node", "doc_id")), "doc_id").withColumn("block", block)
             .withColumn("other", other)
             .select("component", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "doc_id", "text", "settled", "whole"))
    links = materialize(pools.groupBy("component", "lo", "hi").applyInArrow(_verify(width, percent), "a long, b long, whole boolean"), "links")
    final = links.where("whole").select(F.col("a").alias("first"), F.col("b").alias("component_id"))
    if near is not None:
        split = links.where("not whole").select("a", "b")
        joined = components(near.unionByName(split)) if split.limit(1).count() else grouped
        final = final.unionByName(joined.toDF("first", "component_id"))
    final = broadcast_if_small(final)
    # An id of several classes (repeated ids) may have several answers: they are joined below.
    found = (classes.select("doc_id", "first").join(final, "first", "left")
             .select("doc_id", F.coalesce("component_id", "first").alias("component_id")))
    twice = full.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    if twice:
        # Rows of one id hang together whatever their texts say.
        found = components(found.toDF("a", "b")).toDF("doc_id", "component_id")
    else:
        found = found.where("doc_id != component_id")
    rows = made.select("doc_id", "n_shingles").join(broadcast_if_small(found), "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"),
                       F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns, that stay: one row of each group of near-duplicates; rows without doc_id stay."""
    gone = near_duplicates(docs, width, percent).where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    gone = broadcast_if_small(materialize(gone, "near-duplicates"))
    kept = docs.join(gone, docs["doc_id"].cast("long") == gone["gone_id"], "left_anti")
    return one_row_per_id(kept)
