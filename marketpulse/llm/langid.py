"""Language identification as a mixture: each text is inferred to be written in a few languages in unknown proportions.

Every language is a model of byte trigrams inside and across words, hashed into a fixed number of buckets, counted over all
learning rows. A text is cut into pieces of trigrams; expectation-maximisation finds the proportions that make the pieces
likeliest. Languages leave the set one by one, the one with the least share first, while the penalised likelihood (BIC) gains.
The prediction is the language with the largest share that is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpulse.session import configure

#: Buckets of hashed trigrams per language: the size of a model, whatever the corpus.
BUCKETS = 1 << 16
#: Trigrams of a piece of text.
PIECE = 48
ROUNDS = 15
#: Share of each model that is spread evenly over all buckets.
EVEN = 0.01
CHUNK = 1 << 20
UNKNOWN = "und"
#: ASCII that is no letter reads as a space; bytes of other letters stay.
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def normal(text: str) -> bytes:
    """Lower case, words of letters between single spaces, one at either end."""
    return b" " + b" ".join(text.lower().encode("utf-8", "ignore").translate(_LETTERS).split()) + b" "


def trigrams(data: bytes) -> np.ndarray:
    """Bucket of the trigram at each byte but the last two."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    code = b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        texts: dict[str, list[bytes]] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            texts.setdefault(lang, []).append(normal(text))
        for lang, found in texts.items():
            if lang not in counts:
                counts[lang] = np.zeros(BUCKETS, np.int64)
            counts[lang] += np.bincount(trigrams(b"".join(found)), minlength=BUCKETS) if found else 0
    for lang, found in counts.items():
        used = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(found[used])], ["lang", "bucket", "n"])


def learn(docs: DataFrame, learning: Column, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and their logarithmic trigram probabilities, (BUCKETS, languages).

    Counts cover every row for which `learning` is true and text and lang are not null. What comes to the driver is one
    count per language and bucket. No such rows: no languages.
    """
    rows = docs.where(learning & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    counts = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = counts.toPandas()
    langs = sorted(counts["lang"].unique())
    seen = np.zeros((BUCKETS, len(langs)))
    seen[counts["bucket"], pd.Categorical(counts["lang"], categories=langs).codes] = counts["n"]
    model = np.log((1 - EVEN) * seen / np.maximum(seen.sum(axis=0), 1) + EVEN / BUCKETS)
    return langs, model.astype(np.float32)


def shares(pieces: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Proportions of the languages in each text. pieces: log likelihoods (pieces, languages); starts: first piece of each text."""
    sizes = np.diff(np.append(starts, len(pieces)))
    text_of = np.repeat(np.arange(len(starts)), sizes)
    top = pieces.max(axis=1, keepdims=True)
    likely = np.exp(np.maximum(pieces - top, -60.0))
    penalty = 0.5 * np.log(sizes + 1.0)

    def fit(active: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions and penalised log likelihood of the texts `which`, each over its active languages."""
        mine = np.flatnonzero(np.isin(text_of, which)) if len(which) < len(starts) else np.arange(len(pieces))
        p, size = likely[mine], sizes[which]
        own = np.repeat(np.arange(len(which)), size)
        first = np.cumsum(size) - size
        theta = active / active.sum(axis=1, keepdims=True)
        for _ in range(ROUNDS):
            part = theta[own] * p
            part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-300)
            theta = np.add.reduceat(part, first, axis=0) / size[:, None]
        fitted = np.log(np.maximum((theta[own] * p).sum(axis=1), 1e-300))
        return theta, np.add.reduceat(fitted, first) - penalty[which] * (active.sum(axis=1) - 1)

    active = np.ones((len(starts), pieces.shape[1]))
    which = np.arange(len(starts))
    theta, value = fit(active, which)
    while len(which := which[active[which].sum(axis=1) > 1]):
        tried = active[which].copy()
        tried[np.arange(len(which)), np.where(tried > 0, theta[which], np.inf).argmin(axis=1)] = 0
        new_theta, new_value = fit(tried, which)
        better = new_value >= value[which]
        which = which[better]
        active[which], theta[which], value[which] = tried[better], new_theta[better], new_value[better]
    return theta


def infer(texts: list[str | None], langs: list[str], model: np.ndarray) -> tuple[list[str], list[float], list[int]]:
    """Language, its share, and how many languages the set holds, for each text."""
    out = [(UNKNOWN, 0.0, 0)] * len(texts)
    at = 0
    while at < len(texts) and langs:
        held, data, size = [], [], 0
        while at < len(texts) and size < CHUNK:
            if texts[at] is not None and regex.search(r"\p{L}", texts[at]):
                held.append(at)
                data.append(normal(texts[at]))
                size += len(data[-1])
            at += 1
        if not held:
            continue
        # One pass over all texts of the chunk; the trigrams that cross from one text into the next go.
        lengths = np.array([len(d) for d in data])
        ends = np.cumsum(lengths)
        codes = trigrams(b"".join(data))
        n_pieces = np.maximum(1, (lengths - 2) // PIECE)
        starts = np.cumsum(n_pieces) - n_pieces
        begin = np.repeat(ends - lengths, n_pieces) + PIECE * (np.arange(n_pieces.sum()) - np.repeat(starts, n_pieces))
        score = model[codes]
        for end in ends[:-1]:
            score[end - 2 : end] = 0
        theta = shares(np.add.reduceat(score, begin, axis=0).astype(np.float64), starts)
        for i, row in zip(held, theta):
            best = int(row.argmax())
            out[i] = (langs[best], float(min(1.0, row[best])), int((row > 0).sum()))
    return [o[0] for o in out], [o[1] for o in out], [o[2] for o in out]


def _predictor(langs: list[str], shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, sizes = infer(batch.column(batch.num_columns - 1).to_pylist(), langs, shared.value)
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sizes, pa.int32())],
                [str(i) for i in range(len(kept) + 3)])

    return run


def identify(docs: DataFrame, langs: list[str], model: np.ndarray, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep`, then lang_pred, score (share of that language, 0 to 1) and n_langs (size of the language set).

    Whole texts are read. Null text, text without a letter, or no learned language: `und`, 0, 0. Equal texts get equal
    answers; ties go to the language that comes first. Columns of `keep` may have the new names; they come first then.
    """
    spark = configure(docs.sparkSession)
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("text"))
    names = [*keep, "lang_pred", "score", "n_langs"]
    fields = [f"`{i}` {rows.schema[i].dataType.simpleString()}" for i in range(len(keep))]
    schema = ", ".join([*fields, f"`{len(keep)}` string", f"`{len(keep) + 1}` double", f"`{len(keep) + 2}` int"])
    return rows.mapInArrow(_predictor(langs, spark.sparkContext.broadcast(model)), schema).toDF(*names)


def keep_languages(docs: DataFrame, learning: Column, least_share: float = 0.5) -> DataFrame:
    """The documents, all columns, that have a known language making up `least_share` of the text or more.

    Learns from the rows of `learning`. Without any learned language nothing can be told and all rows stay.
    """
    langs, model = learn(docs, learning)
    if not langs:
        return docs
    names = docs.columns
    told = identify(docs, langs, model, names).toDF(*[f"c{i}" for i in range(len(names) + 3)])
    n = len(names)
    kept = told.where((F.col(f"c{n}") != UNKNOWN) & (F.col(f"c{n + 1}") >= least_share))
    return kept.select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(names)])
