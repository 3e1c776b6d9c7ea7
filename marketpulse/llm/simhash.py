"""Near-duplicates by SimHash fingerprints, found with a hierarchical index in Gray order.

Two fingerprints that differ in few bits agree in one of a few pieces, so a fingerprint is indexed once per piece, turned so that
this piece leads, and sorted by its Gray rank: the place of its bits in the reflected Gray code, in which neighbours differ in one bit.

1. Documents with one fingerprint form a class; from here on only the class works.
2. Turned fingerprints are sorted by range over (piece, rank) and cut into blocks of whole cells; a cell is the fingerprints with one
   leading piece. A cell that is too long, or lies on the edge of a task, becomes blocks of its own.
3. A block's index: leaves are runs of FANOUT neighbours, and upper nodes are runs of nodes below. What all members of a node share is
   factored into it as masked bits; nodes below keep only what is not in the mask above.
4. A search carries (fingerprint, node, differences so far) downwards, level by level, and drops a node with all below it once more bits
   differ than allowed, or once all its members are known to be in the fingerprint's group. No lists of all pairs are
   made: a block returns a spanning forest of its links.
5. Blocks that share a cell meet in pairs if their masked bits allow it. Components of the links give the answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpulse.llm.common import components
from marketpulse.operators.sizes import broadcast_if_small
from marketpulse.session import configure, materialize

SEED = 42
BITS = 64
#: Fingerprints of a block; a cell beyond that is cut.
BLOCK_ROWS = 1 << 19
FANOUT = 8
#: Searches that start together, and (fingerprint, node) states that are held at once.
TOGETHER, STATES = 4096, 1 << 18
_HASHES = 1 << 16
_BLOCKS = "a long, b long, piece int, cell long, block long, mask long, bits long, prints binary, ids binary"


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of every word shingle, repeats included; A-Z is lower-cased, nothing else. Fewer words than the width are one shingle."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    width = min(width, len(words))
    spaced = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    cuts = map(slice, begins[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    return np.fromiter(map(xxhash.xxh64_intdigest, map(spaced.__getitem__, cuts), repeat(SEED)), np.uint64, len(words) - width + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; zero without any."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _HASHES):
        some = hashes[at : at + _HASHES].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _prints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(shingle_hashes(text.as_py() or b"", width)) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "print"])

    return run


def gray_rank(bits: Column) -> Column:
    """The place, as an unsigned number, of 64 bits in the reflected Gray code."""
    for shift in (1, 2, 4, 8, 16, 32):
        bits = bits.bitwiseXOR(F.shiftrightunsigned(bits, shift))
    return bits


def turned(bits: Column, by: int) -> Column:
    """Rotated to the left."""
    return F.shiftleft(bits, by).bitwiseOR(F.shiftrightunsigned(bits, BITS - by)) if by else bits


class Index:
    """Masked bits of runs of neighbours, level by level, over fingerprints in Gray order; each cell has a root of its own.

    A node of level k is a run of FANOUT**k neighbours of a cell; level 0 are the fingerprints.
    """

    def __init__(self, prints: np.ndarray, cells: np.ndarray) -> None:
        begins = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
        sizes = np.diff(np.append(begins, len(prints)))
        self.cells = cells[begins]
        shared = (prints, prints)  # bits set in all members, bits set in any
        self.levels = [(np.full(len(prints), ~np.uint64(0)), prints)]  # mask, bits
        self.first = [np.arange(len(prints))]  # the first member of each node
        self.children = [np.empty(0, np.int64)]  # the first child of each node, one more at the end
        while len(shared[0]) > len(begins):
            above = -(-sizes // FANOUT)
            roots = np.concatenate([[0], np.cumsum(above)])
            own = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            child = np.repeat(own, above) + FANOUT * (np.arange(roots[-1]) - np.repeat(roots[:-1], above))
            shared = np.bitwise_and.reduceat(shared[0], child), np.bitwise_or.reduceat(shared[1], child)
            mask = ~(shared[0] ^ shared[1])
            self.levels.append((mask, shared[0] & mask))
            self.first.append(self.first[-1][child])
            self.children.append(np.append(child, np.sum(sizes)))
            sizes = above
        # What the node above holds is taken off the masks below.
        for k in range(len(self.levels) - 1):
            mask, bits = self.levels[k]
            mask = mask & ~np.repeat(self.levels[k + 1][0], np.diff(self.children[k + 1]))
            self.levels[k] = mask, bits & mask
        self.last = [np.append(f[1:], len(prints)) for f in self.first]

    def search(self, prints: np.ndarray, roots: np.ndarray, most: int, group: np.ndarray, label: np.ndarray, after: np.ndarray | None):
        """(search, member) pairs at `most` differing bits or fewer, in parts.

        roots: the root each search starts at. label: group of each member, group: of each search; members of the search's
        own group are left out. after: with it, only members behind that place are looked at.
        """
        least = [np.minimum.reduceat(label, f) for f in self.first]
        same = [np.where(lo == np.maximum.reduceat(label, f), lo, -1) for lo, f in zip(least, self.first)]
        at = np.arange(len(prints))
        open_states = [(len(self.levels) - 1, at[b : b + STATES], roots[b : b + STATES], np.zeros(min(STATES, len(at) - b), np.uint8)) for b in range(0, len(at), STATES)]
        while open_states:
            level, who, node, differ = open_states.pop()
            mask, bits = self.levels[level]
            differ = differ + np.bitwise_count((prints[who] ^ bits[node]) & mask[node])
            fit = (differ <= most) & (same[level][node] != group[who])
            if after is not None:
                fit &= self.last[level][node] > after[who] + 1
            who, node, differ = who[fit], node[fit], differ[fit]
            if not len(who):
                continue
            if not level:
                yield who, node
                continue
            begin, end = self.children[level][node], self.children[level][node + 1]
            n = end - begin
            node = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
            who, differ = np.repeat(who, n), np.repeat(differ, n)
            open_states += [(level - 1, who[b : b + STATES], node[b : b + STATES], differ[b : b + STATES]) for b in range(0, len(who), STATES)]


def join_groups(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the smallest member's place) after the groups of a and b are joined."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def link_within(prints: np.ndarray, cells: np.ndarray, most: int) -> np.ndarray:
    """The group of each fingerprint, as the place of its first member. Fingerprints are in Gray order, of whole cells."""
    index, label = Index(prints, cells), np.arange(len(prints))
    roots = np.repeat(np.arange(len(index.cells)), np.diff(np.append(np.flatnonzero(np.append(True, cells[1:] != cells[:-1])), len(cells))))
    step = max(TOGETHER, len(prints) // 64)
    for b in range(0, len(prints), step):
        who = np.arange(b, min(b + step, len(prints)))
        for a, found in index.search(prints[who], roots[who], most, label[who].copy(), label, who):
            label = join_groups(label, who[a], found)
    return label


def link_across(left: np.ndarray, right: np.ndarray, most: int) -> np.ndarray:
    """Groups over the fingerprints of two blocks of one cell, left ones first, from links between the two only."""
    index, n = Index(right, np.zeros(len(right), np.int64)), len(left)
    label = np.arange(n + len(right))
    step = max(TOGETHER, n // 64)
    for b in range(0, n, step):
        who = np.arange(b, min(b + step, n))
        for a, found in index.search(left[who], np.zeros(len(who), np.int64), most, label[who].copy(), label[n:], None):
            label = join_groups(label, who[a], n + found)
    return label


def _forest(ids: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hung = np.flatnonzero(label != np.arange(len(label)))
    return ids[hung], ids[label[hung]]


def _index(bits: int, most: int):
    """Blocks of the task's fingerprints: links inside them, and the blocks of cells that others may hold a part of."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        shift = np.uint64(BITS - bits)

        def out(rows: dict, n: int) -> pa.RecordBatch:
            types = {"piece": pa.int32(), "prints": pa.binary(), "ids": pa.binary()}
            names = [c.split()[0] for c in _BLOCKS.split(", ")]
            return pa.RecordBatch.from_pydict({c: pa.array(rows.get(c, [None] * n), types.get(c, pa.int64())) for c in names})

        def links(ids: np.ndarray, label: np.ndarray) -> Iterator[pa.RecordBatch]:
            a, b = _forest(ids, label)
            if len(a):
                yield out({"a": a, "b": b}, len(a))

        def shared_cell(piece: int, prints: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal number
            for b in range(0, len(prints), BLOCK_ROWS):
                some, own = prints[b : b + BLOCK_ROWS], ids[b : b + BLOCK_ROWS]
                yield from links(own, link_within(some, np.zeros(len(some), np.int64), most))
                both, either = np.bitwise_and.reduce(some), np.bitwise_or.reduce(some)
                mask = ~(both ^ either)
                number += 1
                yield out({
                    "piece": [piece], "cell": [int(some[0] >> shift)], "block": [part * (1 << 32) + number],
                    "mask": np.array([mask]).view(np.int64), "bits": np.array([both & mask]).view(np.int64),
                    "prints": [some.tobytes()], "ids": [own.tobytes()]}, 1)

        def emit(piece: int, prints: np.ndarray, ids: np.ndarray, whole: bool) -> Iterator[pa.RecordBatch]:
            if whole and len(prints) <= BLOCK_ROWS:
                yield from links(ids, link_within(prints, prints >> shift, most))
            else:
                yield from shared_cell(piece, prints, ids)

        # Rows come in (piece, rank) order. Whole cells are gathered up to a block; the first and the last cell of the task may go
        # on in another one.
        held: list[tuple[np.ndarray, np.ndarray]] = []  # cells that are done
        rows, piece_held = 0, -1
        cell: list[tuple[np.ndarray, np.ndarray]] = []  # the cell that is being read
        key, first = None, True

        def gathered(parts):
            return tuple(np.concatenate(x) for x in zip(*parts))

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            if held:
                yield from emit(piece_held, *gathered(held), True)
            held, rows = [], 0

        def close(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows, cell, first, piece_held
            prints, ids = gathered(cell)
            if first or last or len(prints) > BLOCK_ROWS:
                yield from shared_cell(key[0], prints, ids)
            else:
                if key[0] != piece_held or rows + len(prints) > BLOCK_ROWS:
                    yield from flush()
                held.append((prints, ids))
                rows, piece_held = rows + len(prints), key[0]
            cell, first = [], False

        for batch in batches:
            pieces = batch.column(0).to_numpy()
            prints, ids = batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()
            cells = prints >> shift
            cuts = np.flatnonzero(np.append(True, (pieces[1:] != pieces[:-1]) | (cells[1:] != cells[:-1]))) if len(prints) else []
            for b, e in zip(cuts, [*cuts[1:], len(prints)]):
                here = int(pieces[b]), int(cells[b])
                if key is not None and here != key:
                    yield from close(False)
                key = here
                cell.append((prints[b:e], ids[b:e]))
                # A long cell is passed on block by block.
                if sum(len(x) for x, _ in cell) > 2 * BLOCK_ROWS:
                    some, own = gathered(cell)
                    yield from shared_cell(key[0], some[:BLOCK_ROWS], own[:BLOCK_ROWS])
                    cell, first = [(some[BLOCK_ROWS:], own[BLOCK_ROWS:])], True
        if cell:
            yield from close(True)
        yield from flush()

    return run


def _meet(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                left, right = (np.frombuffer(row[c], np.uint64) for c in ("prints", "other_prints"))
                ids = np.concatenate([np.frombuffer(row[c], np.int64) for c in ("ids", "other_ids")])
                a, b = _forest(ids, link_across(left, right, most))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def links(classes: DataFrame, most: int = 3) -> DataFrame:
    """(a, b): a spanning forest of the links between classes (first, print), and further links inside its trees.

    Prints are distinct. Two of them are linked if they differ in `most` bits or fewer.
    """
    bits = BITS // (most + 1)
    pieces = F.explode(F.array(*[
        F.struct(F.lit(k).alias("piece"), turned(F.col("print"), k * bits).alias("print")) for k in range(most + 1)])).alias("p")
    rows = classes.select("first", pieces).select("p.*", F.col("first").alias("id"))
    # Shifted, as ranks are unsigned.
    rank = gray_rank(F.col("print")).bitwiseXOR(F.lit(-(1 << 63)))
    ordered = rows.withColumn("rank", rank).repartitionByRange("piece", "rank").sortWithinPartitions("piece", "rank")
    found = materialize(ordered.select("piece", "print", "id").mapInArrow(_index(bits, most), _BLOCKS), "gray-index")
    inside = found.where("a is not null").select("a", "b")
    shared = found.where("prints is not null")
    heads = shared.select("piece", "cell", "block", "mask", "bits")
    other = heads.select("piece", "cell", *[F.col(c).alias(f"other_{c}") for c in ("block", "mask", "bits")])
    apart = F.bit_count(F.col("bits").bitwiseXOR(F.col("other_bits")).bitwiseAND(F.col("mask")).bitwiseAND(F.col("other_mask")))
    # Heads only, a row per block: few blocks share a cell unless the cell is longer than a block.
    pairs = materialize(heads.join(other, ["piece", "cell"]).where((F.col("block") < F.col("other_block")) & (apart <= most))
                        .select("block", "other_block"), "block-pairs")
    met = (pairs.join(shared.select("block", "prints", "ids"), "block")
           .join(shared.select(F.col("block").alias("other_block"), F.col("prints").alias("other_prints"), F.col("ids").alias("other_ids")), "other_block"))
    across = met.select("prints", "ids", "other_prints", "other_ids").mapInArrow(_meet(most), "a long, b long")
    return inside.unionByName(across)


def near_duplicates(docs: DataFrame, width: int = 5, most: int = 3) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id linked through any chain).

    A bit of the fingerprint is set if it is set in over half of the XXH64 hashes of the text's word shingles. Fingerprints are linked if
    they differ in `most` bits or fewer. Null, empty and blank texts have the fingerprint zero, which is linked like any other. A
    row without doc_id links with nothing and has no component_id. Rows with one doc_id count as one document: they share a component. An
    empty table gives an empty result; other columns are not read. Texts are taken whole.
    """
    configure(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    made = materialize(texts.mapInArrow(_prints(width), "doc_id long, print long"), "simhash")
    full = made.where("doc_id is not null")
    classes = materialize(full.groupBy("print").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("most")), "prints")
    found = materialize(components(links(classes.select("first", "print"), most)).toDF("first", "component_id"), "linked")
    # Only what is not its own answer is joined: classes of several documents, and linked ones.
    answers = classes.join(broadcast_if_small(found), "first", "left").where("first != most or component_id is not null")
    answers = materialize(answers.select("print", F.coalesce("component_id", "first").alias("component_id")), "answers")
    rows = made.join(broadcast_if_small(answers), "print", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    rows = rows.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), component.alias("component_id"))
    if full.groupBy("doc_id").agg(F.min("print").alias("p"), F.max("print").alias("q")).where("p != q").limit(1).count():
        # Rows of one id hang together whatever their texts say.
        whole = components(rows.where("doc_id is not null").select("doc_id", "component_id")).toDF("doc_id", "whole")
        rows = rows.join(broadcast_if_small(materialize(whole, "whole-ids")), "doc_id", "left")
        rows = rows.select("doc_id", "fingerprint", F.coalesce("whole", "component_id").alias("component_id"))
    return rows
