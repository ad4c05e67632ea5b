"""Vectors of texts from a model that the caller brings.

A model is named by a factory: a picklable function without arguments that gives a function from a list of texts to a
list of vectors. Each Python worker calls the factory once and keeps the model for all its batches.
"""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..config import Config
from ..plans.physical import cut, spread

Factory = Callable[[], Callable[[list[str]], list]]
#: The model that a worker loaded last, by the name of the call
LOADED: dict[str, Callable[[list[str]], list]] = {}


def embed(df: DataFrame, key: str, text: str, factory: Factory, cfg: Config = Config()) -> DataFrame:
    """(key, vec). Texts go to the model ``embed_batch_size`` at a time; null and blank ones get a null vector."""
    kind, name = df.schema[key].dataType.simpleString(), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in LOADED:
            LOADED.clear()
            LOADED[name] = factory()
        model = LOADED[name]
        for batch in batches:
            texts = batch.column(text).to_pylist()
            some = [i for i, t in enumerate(texts) if t and t.strip()]
            vectors: list = [None] * len(texts)
            for at in range(0, len(some), cfg.embed_batch_size):
                part = some[at : at + cfg.embed_batch_size]
                for i, v in zip(part, model([texts[i] for i in part]), strict=True):
                    vectors[i] = [float(x) for x in v]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(vectors, pa.list_(pa.float64()))], names=[key, "vec"])

    return spread(df.select(key, text), key).mapInArrow(run, f"`{key}` {kind}, vec array<double>")


def embedded_or_none(df: DataFrame, key: str, text: str, factory: Factory | None, cfg: Config = Config()) -> DataFrame | None:
    """Vectors, or None if there is no model or it fails: the caller then goes by terms. A failure is warned of."""
    if factory is None:
        return None
    try:
        return cut(embed(df, key, text, factory, cfg))
    except Exception as e:  # noqa: BLE001 - whatever a model raises, terms remain
        warnings.warn(f"no vectors, terms are used instead: {e}", stacklevel=2)
        return None
