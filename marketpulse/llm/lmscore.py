"""Cross-entropy difference of matched language models over the words of the corpus.

A target model (documents to imitate) and a background model (all documents) are interpolated bigram models of the same order,
smoothing and vocabulary: every word of every text. A document's score is the mean over its events (its words and its end) of the target's
loss minus the background's: the lower, the more like the target.

What is gathered grows with the corpus, and no task or driver holds it whole:

1. Texts are packed into chunks of bounded size, written once. A chunk counts its own n-grams first, so a word that is everywhere counts
   once per chunk. Sorted by their hash, they are cut into as many ranges as the size of the corpus asks for.
2. A range adds up what all chunks have of it, and answers each chunk with the totals of its n-grams, in its own order.
3. A chunk meets its answers, and its texts are scored.

N-grams travel as packed numbers, a row for each chunk and range; in a corpus so large that there are more ranges than a chunk has n-grams,
that is one row for each n-gram of a chunk, never more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpulse.operators.sizes import broadcast_if_small
from marketpulse.session import configure, materialize, scratch_path

#: Weight of the shorter context in each interpolation.
PRIOR = 20.0
#: Bytes of text of a chunk, and of the corpus for each range of n-grams.
CHUNK_BYTES, RANGE_BYTES = 2 << 20, 6 << 20
#: A longer run without white space counts character by character: scripts without spaces, and junk.
LONGEST = 24
#: Bits of an n-gram's hash that are kept; the lowest one tells words from pairs.
KEY_BITS = 50
END = 0x9E3779B97F4A7C15
_CHUNKS = "chunk long, doc_ids array<{}>, wanted array<boolean>, texts array<binary>"
_PARTS = "chunk long, range int, n int, keys binary, background binary, target binary"
_SCORES = "doc_id {}, n_tokens long, target_loss double, background_loss double, difference double"


def words(text: bytes) -> list[bytes]:
    """Runs between ASCII white space; those of more than LONGEST bytes as single characters."""
    found = text.split()
    if max(map(len, found), default=0) <= LONGEST:
        return found
    out: list[bytes] = []
    for word in found:
        out += [word] if len(word) <= LONGEST else [c.encode() for c in word.decode(errors="replace")]
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))) >> np.uint64(64 - KEY_BITS)


def events(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word key, context key, pair key) of every event, and the events of each text: its words, then its end, if it has words.

    The context of the first word is the end of a text.
    """
    lengths = np.zeros(len(texts), np.int64)
    hashes = []
    for i, text in enumerate(texts):
        found = words(text)
        if found:
            lengths[i] = len(found) + 1
            own = np.empty(len(found) + 1, np.uint64)
            own[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
            own[-1] = END
            hashes.append(own)
    word = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    before = np.roll(word, 1)
    before[np.cumsum(lengths)[lengths > 0] - lengths[lengths > 0]] = END
    one, low = np.uint64(1), ~np.uint64(1)
    pair = _mix(before * np.uint64(0xD6E8FEB86659FD93) + word) & low
    return _mix(word) | one, _mix(before) | one, pair, lengths


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    held: tuple[list, list, list] = ([], [], [])
    size = 0
    for batch in batches:
        kind = batch.schema.field(0).type

        def chunk() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part * (1 << 32) + number]), pa.array([held[0]], pa.list_(kind)), pa.array([held[1]], pa.list_(pa.bool_())),
                 pa.array([held[2]], pa.list_(pa.binary()))], ["chunk", "doc_ids", "wanted", "texts"])

        for key, wanted, text in zip(*(c.to_pylist() for c in batch.columns)):
            for column, value in zip(held, (key, wanted, text or b"")):
                column.append(value)
            size += len(held[2][-1]) + 64
            if size >= CHUNK_BYTES:
                yield chunk()
                held, size, number = ([], [], []), 0, number + 1
    if held[0]:
        yield chunk()


def _planes(numbers: np.ndarray) -> bytes:
    """Whole numbers byte by byte of like weight, without the upper bytes that none of them needs."""
    width = max(1, -(-int(numbers.max(initial=0)).bit_length() // 8))
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width].tobytes()


def _numbers(planes: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, : len(planes) // n] = np.frombuffer(planes, np.uint8).reshape(-1, n).T
    return out.view("<u8").ravel()


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return np.minimum(keys // np.uint64(-(-(1 << KEY_BITS) // ranges)), np.uint64(ranges - 1)).astype(np.int64)


def _own_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys of a chunk; place of word, context and pair of every event among them; events of each text."""
    word, context, pair, lengths = events(texts)
    keys, place = np.unique(np.concatenate([word, pair]), return_inverse=True)
    return keys, place[: len(word)], np.searchsorted(keys, context), place[len(word) :], lengths


def _count(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                keys, word, _, pair, lengths = _own_keys(batch.column(3)[row].as_py())
                wanted = np.repeat(np.array(batch.column(2)[row].as_py(), bool), lengths)
                both = np.concatenate([word, pair])
                counts = [np.bincount(both, minlength=len(keys)), np.bincount(both[np.tile(wanted, 2)], minlength=len(keys))]
                begin = np.searchsorted(_range_of(keys, ranges), np.arange(ranges + 1))
                used = np.flatnonzero(np.diff(begin))
                cut = lambda values: [_planes(values[begin[r] : begin[r + 1]]) for r in used]  # noqa: E731,B023
                own = [_planes(np.diff(keys[begin[r] : begin[r + 1]], prepend=np.uint64(0))) for r in used]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[row].as_py()] * len(used), pa.int64()), pa.array(used, pa.int32()), pa.array(np.diff(begin)[used], pa.int32()),
                     pa.array(own, pa.binary()), pa.array(cut(counts[0]), pa.binary()), pa.array(cut(counts[1]), pa.binary())],
                    ["chunk", "range", "n", "keys", "background", "target"])

    return run


def _add_up(pool: pa.Table) -> pa.Table:
    """Totals of a range for each chunk, in the chunk's order; and, without a chunk, its words and their totals."""
    sizes = pool.column("n").to_pylist()
    read = lambda name: [_numbers(c.as_py(), n) for c, n in zip(pool.column(name), sizes)]
    keys, place = np.unique(np.concatenate([np.cumsum(k) for k in read("keys")]), return_inverse=True)
    totals = [np.bincount(place, np.concatenate(read(name)), len(keys)).astype(np.uint64) for name in ("background", "target")]
    ends = np.cumsum(sizes)
    is_word = (keys & np.uint64(1)).astype(bool)
    rows = [(chunk, r, n, None, _planes(totals[0][place[e - n : e]]), _planes(totals[1][place[e - n : e]])) for chunk, r, n, e in zip(
        pool.column("chunk").to_pylist(), pool.column("range").to_pylist(), sizes, ends.tolist())]
    rows.append((None, rows[0][1], int(is_word.sum()), None, *[_planes(np.array([int(t[is_word].sum())])) for t in totals]))
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), types)], [c.split()[0] for c in _PARTS.split(", ")])


def log_probabilities(pair: np.ndarray, context: np.ndarray, word: np.ndarray, total: float, vocabulary: int) -> np.ndarray:
    """log P(word | context) from counts, interpolated down to the uniform distribution over the vocabulary and one unseen word."""
    p = (word + PRIOR / (vocabulary + 1)) / (total + PRIOR)
    return np.log((pair + PRIOR * p) / (context + PRIOR))


def _score(vocabulary: int, sums: tuple[int, int], kind: pa.DataType):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        answers = right.sort_by("range")
        counts = [np.concatenate([_numbers(c.as_py(), n) for c, n in zip(answers.column(name), answers.column("n").to_pylist())] or [np.empty(0)]).astype(
            np.float64) for name in ("target", "background")]
        for row in left.to_pylist():
            _, word, context, pair, lengths = _own_keys(row["texts"])
            full = lengths > 0
            begin = (np.cumsum(lengths) - lengths)[full]
            losses = []
            for count, total in zip(counts, sums):
                loss = np.zeros(len(lengths))
                if len(begin):
                    loss[full] = -np.add.reduceat(log_probabilities(count[pair], count[context], count[word], total, vocabulary), begin)
                losses.append(loss / np.maximum(lengths, 1))
            columns = [pa.array(x, mask=~full) for x in (*losses, losses[0] - losses[1])]
            out.append(pa.table([pa.array(row["doc_ids"], kind), pa.array(np.maximum(lengths - 1, 0)), *columns],
                                ["doc_id", "n_tokens", "target_loss", "background_loss", "difference"]))
        types = [kind, pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        empty = pa.table([pa.array([], t) for t in types], ["doc_id", "n_tokens", "target_loss", "background_loss", "difference"])
        return pa.concat_tables(out) if out else empty

    return run


def cross_entropy_difference(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per row: doc_id, n_tokens (words), target_loss, background_loss (nats an event), difference (of the two).

    Every whole text is counted into the background model, those whose doc_id is in `wanted` (doc_id) also into the target
    model, and every text is scored. Words lie between ASCII white space; a run of more than LONGEST bytes counts by characters. Null, empty
    and blank texts have 0 tokens and null losses. A null doc_id is never wanted; an id listed twice counts once; repeated rows count
    each. With no wanted document the target model is uniform. An empty table gives an empty result. Other columns are not read.
    """
    spark = configure(docs.sparkSession)
    key = docs.schema["doc_id"].dataType
    kind = pa.int64() if key.typeName() in ("long", "integer", "short", "byte") else pa.string()
    docs = docs.select(F.col("doc_id").cast("long" if kind == pa.int64() else "string").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    name = docs.schema["doc_id"].dataType.simpleString()
    wanted = materialize(wanted.select(F.col("doc_id").alias("wanted_id")).where("wanted_id is not null").distinct(), "wanted")
    marked = docs.join(broadcast_if_small(wanted), F.col("doc_id") == F.col("wanted_id"), "left")
    marked = marked.select("doc_id", F.col("wanted_id").isNotNull().alias("wanted"), "text")
    path = scratch_path(spark, "chunks")
    marked.mapInArrow(_pack_texts, _CHUNKS.format(name)).write.option("compression", "zstd").parquet(path)
    chunks = spark.read.schema(_CHUNKS.format(name)).parquet(path)
    size = chunks.select(F.aggregate("texts", F.lit(0).cast("bigint"), lambda n, t: n + F.octet_length(t)).alias("n")).agg(F.sum("n")).first()[0]
    ranges = max(1, -(-(size or 0) // RANGE_BYTES))
    parts = chunks.mapInArrow(_count(ranges), _PARTS)
    totals = materialize(parts.groupBy("range").applyInArrow(_add_up, _PARTS), "totals")
    # One row per range.
    known = totals.where("chunk is null").select("n", "background", "target").toArrow().to_pylist()
    sums = tuple(sum(int(_numbers(r[c], 1)[0]) for r in known) for c in ("target", "background"))
    answers = totals.where("chunk is not null").select("chunk", "range", "n", "background", "target")
    scored = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    return scored.applyInArrow(_score(sum(r["n"] for r in known), sums, kind), _SCORES.format(name))


def good_documents() -> Column:
    """Rows of labels that show what is wanted: good quality, not toxic."""
    return (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
