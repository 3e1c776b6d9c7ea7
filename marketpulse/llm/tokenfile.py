"""Token files: ids of whole texts in shards compressed by Re-Pair, readable document by document.

A shard is one row of a Parquet table: documents in ascending doc_id order, their ids in a grammar made for this shard.
Frequent pairs of neighbouring symbols are replaced by new symbols, round after round, until no pair is worth a rule or the symbols
are used up; a pair never spans two documents. The rules, how many ids each new symbol stands for, where each document's symbols end
and how many ids it has are stored with the symbols, so any document is expanded without its neighbours, and any range of its ids without the rest.
"""

from __future__ import annotations

import codecs
import sys
import types
import zlib
from collections.abc import Iterator
from string import ascii_letters

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

from marketpulse.operators.sizes import broadcast_if_small
from marketpulse.session import configure, materialize, scratch_path

END_ID = 1
#: Ids of a shard or so (a document is never split).
SHARD_IDS = 1 << 20
#: Pairs that are replaced together before pairs are counted again (numbered in 16 bits); rounds go on until nothing is gained.
ROUND_RULES = 4096
#: A rule takes eight bytes (two symbols and a length), a replaced pair saves two: it must occur five times to be worth one.
LEAST_COUNT = 5
SYMBOLS = 1 << 16
#: Words whose ids a Python worker remembers.
CACHE_WORDS = 1_000_000
#: Bytes of texts or so whose words are looked up together, each distinct one once (a text is never split).
TOGETHER = 1 << 22
_SHARDS = ("part int, shard int, base int, doc_ids array<long>, doc_ends binary, doc_tokens binary, rules binary, rule_tokens binary, "
           "symbols binary, n_ids long")


#: ASCII marks that may follow a word's letters as one piece. Not the apostrophe, which joins letters after it.
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
#: Letters beyond ASCII none of which is combined with its neighbours when normalized.
LATIN = "".join(c for c in map(chr, range(0xAA, 0x250)) if c.isalpha())


class _Letters(dict):
    """Characters, and whether the tokenizer takes them for letters, in any word and alone."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.tokenizer = tokenizer

    def __missing__(self, char: str) -> bool:
        normal = self.tokenizer.normalizer.normalize_str(char)
        self[char] = len(self.tokenizer.pre_tokenizer.pre_tokenize_str(f"a{normal}a")) == 1
        return self[char]


class WordEncoder:
    """Ids of whole texts by a tokenizer whose pieces never span ASCII white space and which takes a run of letters, in lower case, as one.

    Each distinct word of many texts is looked up once, without its case and the marks at its end if the rest is Latin letters. Words
    of letters only, bare or before a run of marks, are a piece or two and go to the tokenizer many at a time; an end-of-word token
    closes each. Any other word goes by itself.
    """

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.tokenizer = tokenizer
        self.size = tokenizer.get_vocab_size()
        self.closes = np.zeros(self.size, bool)
        for token, i in tokenizer.get_vocab().items():
            self.closes[i] = token.endswith("</w>")
        self.letters = _Letters(tokenizer)
        #: The model alone, the characters it has for bytes, and the letters of which words may go there; else the whole tokenizer.
        self.plain, self.table, self.simple = self._plain(ascii_letters + LATIN) or self._plain(ascii_letters) or (tokenizer, None, ascii_letters)
        self.pattern = f"^[{self.simple}]+$"
        self.is_simple = frozenset(self.simple).issuperset
        self.known: dict[bytes, bytes] = {b"": b""}

    def _plain(self, letters: str) -> tuple[Tokenizer, str, str] | None:
        """For words of these letters in lower case: the model alone, if normalizing and cutting change no more than case and bytes."""
        lower = dict(zip(letters, pc.utf8_lower(pa.array(list(letters))).to_pylist()))
        letters = "".join(c for c in letters if lower[c] in lower and self.tokenizer.normalizer.normalize_str(c) == lower[c] and self.letters[c])
        small = [c for c in letters if lower[c] == c]
        table = {ord(" "): " "}
        for c in small:
            table.update(zip(c.encode(), "".join(piece for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(c))))
        table = "".join(table.get(b, "\ufffe") for b in range(256))  # U+FFFE: no character
        plain = Tokenizer(self.tokenizer.model)
        plain.pre_tokenizer = WhitespaceSplit()
        probe = " ".join(a + b for a in small for b in ["", *small[:26], a, f"{a}a"])
        added = any(t.content.isalpha() for t in self.tokenizer.get_added_tokens_decoder().values())
        given = codecs.charmap_decode(probe.encode(), "replace", table)[0]
        same = plain.encode(given, add_special_tokens=False).ids == self.tokenizer.encode(probe, add_special_tokens=False).ids
        return (plain, table, letters) if letters and same and not added else None

    def encode(self, text: bytes) -> bytes:
        """The ids as little-endian unsigned 16-bit numbers."""
        return self.encode_all(pa.array([text], pa.binary()))[0]

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        if len(self.known) > CACHE_WORDS:
            self.known = {b"": b""}
        split = pc.ascii_split_whitespace(texts.cast(pa.string()).fill_null(""))
        words = split.flatten().dictionary_encode()
        ids = self._words(words.dictionary).take(words.indices)
        sizes = np.append(0, np.cumsum(pc.binary_length(ids).to_numpy()))
        ends = sizes[np.cumsum(split.value_lengths().to_numpy())].tolist()
        buffer = ids.buffers()[2]
        data = buffer.to_pybytes() if buffer else b""
        return [data[b:e] for b, e in zip([0, *ends], ends)]

    def _words(self, words: pa.Array) -> pa.Array:
        stems = pc.ascii_rtrim(words, characters=MARKS)
        simple = pc.match_substring_regex(stems, self.pattern)
        stems = pc.if_else(simple, pc.utf8_lower(stems), words)
        marks = pc.if_else(simple, pc.utf8_ltrim(words, characters=self.simple), "")
        return pc.binary_join_element_wise(self._look(stems), self._look(marks), b"")

    def _look(self, words: pa.Array) -> pa.Array:
        found = words.dictionary_encode()
        keys = found.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.known.get, keys))
        if new := [k for k, i in zip(keys, ids) if i is None]:
            self.learn(new)
            ids = [self.known[k] if i is None else i for k, i in zip(keys, ids)]
        return pa.array(ids, pa.binary()).take(found.indices)

    def learn(self, new: list[bytes]) -> None:
        """new: distinct words not known yet; those of Latin letters only are in lower case."""
        known, letters, marked = self.known, self.letters.__getitem__, MARKS.encode()
        plain, stems, rest = [], set(), []
        made: list[tuple[bytes, bytes, bytes]] = []  # word, stem, marks
        for word in new:
            if word.isalpha() or self.is_simple(word.decode()):
                plain.append(word)
                continue
            stem = word.rstrip(marked)  # with letters beyond Latin, or more than letters
            if stem and all(map(letters, stem.decode())):
                stems.add(stem)
                made.append((word, stem, word[len(stem):]))
            else:
                rest.append(word)
        self._learn_letters(self.plain, plain, self.table)
        self._learn_letters(self.tokenizer, [s for s in stems if s not in known])
        rest += {m for *_, m in made}.difference(known, rest)
        known.update(zip(rest, self._ids(rest)))
        known.update([(word, known[stem] + known[m]) for word, stem, m in made])

    def _learn_letters(self, tokenizer: Tokenizer, words: list[bytes], table: str | None = None) -> None:
        """Words of letters only, at once; by themselves if they turn out not to be a piece each."""
        if not words:
            return
        text = b" ".join(words)
        text = codecs.charmap_decode(text, "strict", table)[0] if table else text.decode()
        ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint16)
        data, ends = ids.tobytes(), (2 * np.flatnonzero(self.closes[ids]) + 2).tolist()
        each = len(ends) == len(words)
        self.known.update(zip(words, [data[b:e] for b, e in zip([0, *ends], ends)] if each else self._ids(words)))

    def _ids(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [np.array(e.ids, np.uint16).tobytes() for e in found]


def word_encoder(path: str) -> WordEncoder:
    """One encoder per Python worker and file, kept between tasks."""
    store = sys.modules.setdefault("marketpulse_worker_store", types.ModuleType("marketpulse_worker_store"))
    kept = store.__dict__.setdefault("encoders", {})
    if path not in kept:
        kept[path] = WordEncoder(Tokenizer.from_file(path))
    return kept[path]


def _hash(pairs: np.ndarray) -> np.ndarray:
    return (pairs * np.uint32(2654435761)) >> np.uint32(14)


def compress(symbols: np.ndarray, ends: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair: (symbols, ends, rules (n, 2), ids each rule stands for). ends: end of each document in the symbols."""
    symbols = symbols.astype(np.uint32)
    empty = np.diff(ends, prepend=0) == 0
    last = np.uint32(SYMBOLS)  # the bit above a symbol: it is the last one of its document
    symbols[ends[~empty] - 1] |= last
    rules, lengths = np.empty((0, 2), np.uint32), np.empty(0, np.uint32)
    while (room := min(ROUND_RULES, SYMBOLS - base - len(rules))) > 0 and len(symbols) > 1:
        pairs = (symbols[:-1] << np.uint32(16)) | (symbols[1:] & np.uint32(SYMBOLS - 1))
        inside = symbols[:-1] < last
        found = np.sort(pairs[inside])
        # A pair stays as often as it occurs, less LEAST_COUNT - 1.
        upto = max(0, len(found) - LEAST_COUNT + 1)
        found = found[:upto][found[:upto] == found[LEAST_COUNT - 1 :]]
        if not len(found):
            break
        first = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
        often = np.sort(np.argsort(-np.diff(first, append=len(found)), kind="stable")[:room])
        chosen = found[first[often]]
        # A table by hash has the place of a pair among those chosen; pairs that share its entry are looked up.
        hashes, numbers = _hash(chosen), np.arange(len(chosen), dtype=np.int16)
        entry = np.full(1 << 18, -1, np.int16)
        entry[hashes] = numbers
        likely = entry[_hash(pairs)]
        at = np.flatnonzero((likely >= 0) & inside)
        place, pair = likely[at], pairs[at]
        right = chosen[place] == pair
        if len(hidden := np.flatnonzero(entry[hashes] != numbers)):
            shared = np.zeros(len(entry), bool)
            shared[hashes[hidden]] = True
            wrong = np.flatnonzero(~right)
            wrong = wrong[shared[_hash(pair[wrong])]]
            place[wrong] = np.minimum(np.searchsorted(chosen, pair[wrong]), len(chosen) - 1)
            right[wrong] = chosen[place[wrong]] == pair[wrong]
        at, place = at[right], place[right]
        # Of pairs that overlap, every other one from the left.
        run = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        odd = (at ^ np.repeat(at[run], np.diff(run, append=len(at)))) & 1 == 0
        at, place = at[odd], place[odd]
        symbols[at] = (place + np.uint32(base + len(rules))) | (symbols[at + 1] & last)
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        symbols = symbols[stay]
        of = np.concatenate([np.ones(base, np.uint32), lengths])
        left, right = chosen >> np.uint32(16), chosen & np.uint32(0xFFFF)
        lengths = np.append(lengths, of[left] + of[right])
        rules = np.concatenate([rules, np.stack([left, right], axis=1)])
    new_ends = np.zeros(len(ends), np.int64)
    new_ends[~empty] = np.flatnonzero(symbols >= last) + 1
    return symbols.astype(np.uint16), np.maximum.accumulate(new_ends) if len(ends) else new_ends, rules, lengths


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for."""
    symbols = symbols.astype(np.uint32)
    left, right = np.ascontiguousarray(rules[:, 0]), np.ascontiguousarray(rules[:, 1])
    while len(new := np.flatnonzero(symbols >= base)):
        rule = symbols[new] - base
        at = new + np.arange(len(new))  # each one before took a place more
        stay = np.ones(len(symbols) + len(new), bool)
        stay[at + 1] = False
        out = np.empty(len(stay), np.uint32)
        out[stay] = symbols
        out[at], out[at + 1] = left[rule], right[rule]
        symbols = out
    return symbols


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        part, shard = TaskContext.get().partitionId(), 0
        end = np.array([END_ID], np.uint16).tobytes()
        ids: list[int | None] = []
        texts: list[bytes] = []
        size = 0

        def full() -> pa.RecordBatch:
            nonlocal shard
            symbols = np.frombuffer(b"".join(texts), np.uint16)
            tokens = np.array([len(t) // 2 for t in texts], np.int64)
            out, ends, rules, lengths = compress(symbols, np.cumsum(tokens), encoder.size)
            batch = pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "base": pa.array([encoder.size], pa.int32()),
                "doc_ids": pa.array([ids], pa.list_(pa.int64())), "doc_ends": [ends.astype("<u4").tobytes()],
                "doc_tokens": [tokens.astype("<u4").tobytes()], "rules": [rules.astype("<u2").tobytes()],
                "rule_tokens": [lengths.astype("<u4").tobytes()], "symbols": [out.astype("<u2").tobytes()], "n_ids": pa.array([len(symbols)], pa.int64())})
            shard += 1
            return batch

        for batch in batches:
            upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(), dtype=np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(upto // TOGETHER)) + 1).tolist(), batch.num_rows]
            for begin, stop in zip(cuts, cuts[1:]):
                some = batch.slice(begin, stop - begin)
                for key, text in zip(some.column(0).to_pylist(), encoder.encode_all(some.column(1))):
                    ids.append(key)
                    texts.append(text + end)
                    size += len(texts[-1]) // 2
                    if size >= SHARD_IDS:
                        yield full()
                        ids, texts, size = [], [], 0
        if ids:
            yield full()

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str) -> None:
    """Write the ids of every whole text, each followed by END_ID, in ascending doc_id order (part, shard, place).

    docs: doc_id, text. Null text is empty; rows without doc_id come first; rows of one doc_id keep the order of their texts. The tokenizer's
    file must be found at tokenizer_path on every executor, and its ids must leave room for new symbols below 65,536.
    """
    configure(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_encode(tokenizer_path), _SHARDS).write.parquet(path)


def decode_document(shard: dict, place: int) -> np.ndarray:
    """Ids of one document of a shard, from its own symbols only."""
    ends = np.frombuffer(shard["doc_ends"], "<u4")
    symbols = np.frombuffer(shard["symbols"], "<u2")[ends[place - 1] if place else 0 : ends[place]]
    return expand(symbols, np.frombuffer(shard["rules"], "<u2").reshape(-1, 2).astype(np.uint32), shard["base"])


def decode_range(shard: dict, place: int, begin: int, stop: int) -> np.ndarray:
    """Ids begin..stop of one document, found by the lengths of its symbols: only rules over the edge of the range are taken apart."""
    ends = np.frombuffer(shard["doc_ends"], "<u4")
    symbols = np.frombuffer(shard["symbols"], "<u2")[ends[place - 1] if place else 0 : ends[place]].astype(np.int64)
    rules = np.frombuffer(shard["rules"], "<u2").reshape(-1, 2).astype(np.uint32)
    base, lengths = shard["base"], np.frombuffer(shard["rule_tokens"], "<u4")
    upto = np.cumsum(np.where(symbols < base, 1, lengths[np.maximum(symbols - base, 0)] if len(lengths) else 1))
    begin, stop = max(0, begin), min(stop, int(upto[-1]) if len(upto) else 0)
    if begin >= stop:
        return np.empty(0, np.uint32)
    first, last = int(np.searchsorted(upto, begin, "right")), int(np.searchsorted(upto, stop, "left"))
    skip, take, out = begin - (int(upto[first - 1]) if first else 0), stop - begin, []
    todo = symbols[first : last + 1][::-1].tolist()
    while todo and take:
        symbol = todo.pop()
        n = int(lengths[symbol - base]) if symbol >= base else 1
        if n <= skip:
            skip -= n
        elif not skip and n <= take:
            out.append(symbol)
            take -= n
        else:
            left, right = rules[symbol - base].tolist()
            todo += [right, left]
    return expand(np.array(out, np.uint32), rules, base)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard in batch.to_pylist():
            rules = np.frombuffer(shard["rules"], "<u2").reshape(-1, 2).astype(np.uint32)
            ids = expand(np.frombuffer(shard["symbols"], "<u2"), rules, shard["base"])
            tokens = np.frombuffer(shard["doc_tokens"], "<u4").astype(np.int64)
            ends = np.cumsum(tokens)
            data = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), tokens.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard["doc_ids"], pa.int64()), pa.array(shard["before"] + ends - tokens), pa.array(tokens), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"])


def digest_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Read the files back: doc_id, start (ids of all documents before), n_tokens (with the end id), ids_crc32 (of the
    document's ids as little-endian unsigned 32-bit numbers). Places are added up per part, then over the parts."""
    shards = configure(spark).read.parquet(path)
    sizes = shards.select("part", "shard", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("in_part"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("in_part").over(upto(Window.orderBy("part"))), F.lit(0)).alias("parts_before"))
    inside = sizes.select("part", "shard", F.coalesce(F.sum("n_ids").over(upto(Window.partitionBy("part").orderBy("shard"))), F.lit(0)).alias("shards_before"))
    before = inside.join(parts, "part").select("part", "shard", (F.col("parts_before") + F.col("shards_before")).alias("before"))
    before = broadcast_if_small(materialize(before, "shard-places"))
    rows = shards.join(before, ["part", "shard"]).select("base", "doc_ids", "doc_tokens", "rules", "symbols", "before")
    return rows.mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer_path, path)
    return digest_tokens(docs.sparkSession, path)
