"""Vectors of messages: a pluggable backend, backfill of pending rows, replacement by id, change of backend."""

from __future__ import annotations

from abc import ABC, abstractmethod

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows a batch, characters a text has at least, and the states of a row.
BATCH, LEAST = 64, 8
PENDING, DONE, SHORT = 0, 2, 3
VECTORS = "vec_id long, embedding array<float>"


class Backend(ABC):
    """Texts to vectors; sent to executors, so it should load its model at first use."""

    name: str
    dimension: int

    @abstractmethod
    def embed(self, texts: list[str]) -> list[list[float]]: ...

    @property
    def label(self) -> str:
        return f"{self.name}:{self.dimension}"


class Pooled(Backend):
    """Token vectors of a model, averaged over the tokens that count and set to length one."""

    def __init__(self, name: str, dimension: int, tokens):
        self.name, self.dimension, self.tokens = name, dimension, tokens

    def embed(self, texts: list[str]) -> list[list[float]]:
        import numpy as np

        vectors, mask = self.tokens(texts)
        total = (vectors * mask[:, :, None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1e-9)
        return (total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)).tolist()


def backfill(emails: DataFrame, vectors: DataFrame, backend: Backend, batches: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The messages with new states, and the vectors (vec_id, embedding) with those of pending rows put in place.

    With ``batches`` only so many times BATCH rows, newest first. Texts under LEAST characters are marked short.
    """
    todo = emails.where(F.col("embed_state") == PENDING).select("id", "date_received", F.trim(F.concat(F.coalesce("subject", F.lit("")), F.lit("\n"), F.coalesce("snippet", F.lit(""))), F.lit(" \t\n\r")).alias("text"))
    if batches is not None:
        todo = todo.orderBy(F.desc_nulls_last("date_received"), "id").limit(BATCH * batches)

    def run(parts):
        for batch in parts:
            for a in range(0, batch.num_rows, BATCH):
                part = batch.slice(a, BATCH)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(backend.embed(part.column(1).to_pylist()), pa.list_(pa.float32()))], ["vec_id", "embedding"])

    new = todo.where(F.length("text") >= LEAST).select("id", "text").mapInArrow(run, VECTORS)
    state = todo.select("id", F.when(F.length("text") >= LEAST, DONE).otherwise(SHORT).alias("_state"))
    out = emails.join(state, "id", "left").withColumn("embed_state", F.coalesce("_state", "embed_state")).select(*emails.columns)
    return out, replaced(vectors, new)


def replaced(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or replace by vec_id."""
    return vectors.join(new.select("vec_id"), "vec_id", "left_anti").select("vec_id", "embedding").unionByName(new.select("vec_id", "embedding"))


def invalidated(emails: DataFrame, vectors: DataFrame, stored: str | None, backend: Backend) -> tuple[DataFrame, DataFrame]:
    """Messages and vectors for a backend: one of another name or dimension starts over."""
    if stored is None or stored == backend.label:
        return emails, vectors
    return emails.withColumn("embed_state", F.when(F.col("embed_state") == DONE, PENDING).otherwise(F.col("embed_state"))), vectors.limit(0)
