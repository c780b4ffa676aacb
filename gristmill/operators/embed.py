"""Embedders: text to vector, pluggable."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 128


def hash_embedder(dims: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for a remote model: signed hashes of words and character triples."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims), np.float32)
        for i, t in enumerate(texts):
            low = f" {t.lower()} "
            for g in [*low.split(), *(low[j : j + 3] for j in range(len(low) - 2))]:
                h = int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "little")
                out[i, h % dims] += 1.0 if h >> 63 else -1.0
        return out

    return embed


def embed_text(df: DataFrame, text: str, embedder: Callable[[list[str]], np.ndarray], out: str = "vec", batch: int = BATCH) -> DataFrame:
    """``df`` with ``out array<float>``; the embedder sees ``batch`` texts at a time, equal ones that arrive together once."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        codes, texts = pd.factorize(s.fillna(""))
        vecs = [v.tolist() for i in range(0, len(texts), batch) for v in embedder(texts[i : i + batch].tolist())]
        return pd.Series([vecs[i] for i in codes])

    return df.withColumn(out, run(F.col(text)))


def channel_vectors(channels: DataFrame, embedder: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """``(row_id, channel, vec)`` of the three text channels."""
    long = channels.select("row_id", F.inline(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"{c}_text").alias("text")) for c in ("title", "desc", "specs")])))
    return embed_text(long, "text", embedder).select("row_id", "channel", "vec")
