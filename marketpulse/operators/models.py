"""Model scoring and embedding in Arrow batches, with a model the caller supplies.

A factory is called once per Python worker task and returns a function from a list of texts to an array with one row
per text. Whatever fails, the factory, a batch or a single text, gives nulls, and the column functions fall back.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpulse.functions.scoring import FEATURES, score_from_features, score_from_logits, with_features
from marketpulse.functions.vectors import hash_embedding

log = logging.getLogger(__name__)

Model = Callable[[list[str]], np.ndarray]
Factory = Callable[[], Model]


def _run(model: Model, texts: list[str]) -> list:
    """Rows of the model's answer. If a batch fails its texts are tried one by one."""
    if not texts:
        return []
    try:
        return list(np.asarray(model(texts)))
    except Exception:  # noqa: BLE001 - one bad text must not lose the batch
        pass
    rows, error = [], None
    for text in texts:
        try:
            rows.append(np.asarray(model([text]))[0])
        except Exception as failure:  # noqa: BLE001
            rows.append(None)
            error = failure
    log.debug("model failed on some of %d texts, last: %s", len(texts), error)
    return rows


def _apply(batches: Iterator[pd.Series], factory: Factory, max_chars: int | None) -> Iterator[list]:
    try:
        model = factory()
    except Exception as error:  # noqa: BLE001 - without a model the fallback takes over
        log.error("model could not be loaded: %s", error)
        model = None
    for texts in batches:
        wanted = [i for i, t in enumerate(texts) if isinstance(t, str) and t.strip()]
        rows: list = [None] * len(texts)
        if model is not None:
            given = [texts.iloc[i] if max_chars is None else texts.iloc[i][:max_chars] for i in wanted]
            for i, row in zip(wanted, _run(model, given)):
                rows[i] = row
        yield rows


def logits(text: Column, factory: Factory, max_chars: int | None = None) -> Column:
    """Two-class logits as struct<negative, positive>; null fields where there is no answer.

    Whole texts go to the model unless its input limit is stated in `max_chars`.
    """
    @F.pandas_udf("struct<negative:double,positive:double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for rows in _apply(batches, factory, max_chars):
            yield pd.DataFrame({
                "negative": [None if r is None else float(r[0]) for r in rows],
                "positive": [None if r is None else float(r[1]) for r in rows],
            }, dtype="float64")

    return run(text)


def score_with_model(posts: DataFrame, factory: Factory, name: str = "distilbert", max_chars: int | None = None) -> DataFrame:
    """Add `score`: zero for empty text, the model's score where it answers, the word lists elsewhere."""
    with_logits = posts.withColumn("_logits", logits(F.col("text"), factory, max_chars))
    negative, positive = F.col("_logits.negative"), F.col("_logits.positive")
    answered = ~F.isnan(negative) & ~F.isnan(positive)
    by_model = F.when(answered, score_from_logits(negative, positive, F.col("_sarcasm"), name))
    return with_features(with_logits).withColumn("score", score_from_features(by_model)).drop("_logits", *FEATURES)


def model_vector(text: Column, factory: Factory, max_chars: int | None = None) -> Column:
    """The model's vector as array<float>, scaled to unit length; null where there is no answer."""
    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in _apply(batches, factory, max_chars):
            out = []
            for row in rows:
                if row is None:
                    out.append(None)
                    continue
                vector = np.asarray(row, dtype=np.float64)
                norm = np.linalg.norm(vector)
                out.append((vector / norm if norm > 0 else vector).astype(np.float32))
            yield pd.Series(out, dtype=object)

    return run(text)


def embed_with_model(posts: DataFrame, factory: Factory, max_chars: int | None = None, dim: int | None = None) -> DataFrame:
    """Add `emb`: the model's vector where it answers, else the vector drawn from the text's digest."""
    fallback = hash_embedding(F.col("text")) if dim is None else hash_embedding(F.col("text"), dim)
    df = posts.withColumn("_vector", model_vector(F.col("text"), factory, max_chars))
    return df.withColumn("emb", F.when(F.col("_vector").isNotNull(), F.col("_vector")).otherwise(fallback)).drop("_vector")

