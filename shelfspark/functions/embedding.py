"""Embedding hook: any Arrow/pandas UDF ``text -> array<float>`` can take its place."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.text import embed_text


def hashing_embedder(dimensions: int = 64):
    """Deterministic stand-in for a hosted model: signed hashes of words and their 3-letter pieces.

    Blank text gives an empty vector, the form in which a failed call is reported.
    """

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        def one(text) -> np.ndarray:
            tokens = (text or "").lower().split()
            pieces = tokens + [t[i : i + 3] for t in tokens for i in range(len(t) - 2)]
            vector = np.zeros(dimensions if pieces else 0, dtype=np.float32)
            for piece in pieces:
                code = xxhash.xxh64_intdigest(piece)
                vector[code % dimensions] += 1.0 if (code >> 32) & 1 else -1.0
            return vector

        return texts.map(one)

    return embed


def embed_products(products: DataFrame, embedder=None, with_category: bool = False) -> DataFrame:
    """``product_id, embedding`` of products; distinct texts are embedded once."""
    embedder = embedder or hashing_embedder()
    category = F.col("category_path") if with_category else None
    texts = products.select("product_id", embed_text(F.col("canonical_name"), F.col("brand"), category).alias("_text"))
    vectors = texts.select("_text").distinct().withColumn("embedding", embedder(F.col("_text")))
    return texts.join(vectors, "_text").select("product_id", "embedding")
