"""Batch embedding with a pluggable model and the incremental backfill built on it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webfacts.operators.joins import without_embedding

Model = Callable[[list[str]], np.ndarray]
DIMS = 64


def hashing_model(dims: int = DIMS) -> Model:
    """Deterministic stand-in model: signed word hashes, unit length."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims))
        for row, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                out[row, h % dims] += 1.0 if (h >> 32) & 1 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)

    return embed


def embed_texts(rows: DataFrame, id_col: str, text_col: str, make_model: Callable[[], Model] = hashing_model, batch: int = 256) -> DataFrame:
    """``(id, embedding)``. Equal texts are embedded once; the model is made once per task and fed in batches."""
    keyed = rows.filter(F.col(text_col).isNotNull()).select(id_col, text_col, F.sha2(text_col, 256).alias("_h"))
    texts = keyed.groupBy("_h").agg(F.any_value(text_col).alias("_t"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for pdf in parts:
            model = model or make_model()
            for at in range(0, len(pdf), batch):
                some = pdf.iloc[at : at + batch]
                yield pd.DataFrame({"_h": some["_h"], "embedding": list(model(some["_t"].tolist()).astype(np.float32))})

    vectors = texts.mapInPandas(run, "_h string, embedding array<float>")
    return keyed.select(id_col, "_h").join(vectors, "_h").select(id_col, "embedding")


def backfill(facts: DataFrame, embeddings: DataFrame, id_col: str, emb_id: str, text_col: str, make_model: Callable[[], Model] = hashing_model) -> DataFrame:
    """Embeddings for the facts that have none."""
    return embed_texts(without_embedding(facts, embeddings, id_col, emb_id), id_col, text_col, make_model)
