"""Text vectors: provider hook, local provider, documents, means."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeloom.functions import text as tx

#: A provider maps a list of texts to one vector per text.
Provider = Callable[[list[str]], list[list[float]]]

DIM = 256


def embed_with_provider(
    df: DataFrame,
    provider: Provider,
    dim: int,
    text: str = "text",
    batch_size: int = 10,
) -> DataFrame:
    """Add ``embedding`` and ``failed`` by calling ``provider`` on batches of texts.

    A failing batch, or a wrong-shaped answer, gives zero vectors and ``failed`` = true;
    the job goes on.
    """
    added = [
        T.StructField("embedding", T.ArrayType(T.DoubleType())),
        T.StructField("failed", T.BooleanType()),
    ]
    schema = T.StructType([*df.schema.fields, *added])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors, failed = [], []
            texts = ["" if t is None else t for t in frame[text]]
            for at in range(0, len(texts), batch_size):
                batch = texts[at : at + batch_size]
                try:
                    got = np.asarray(provider(batch), dtype=float)
                    if got.shape != (len(batch), dim):
                        raise ValueError(f"expected {(len(batch), dim)}, got {got.shape}")
                    vectors += list(got)
                    failed += [False] * len(batch)
                except Exception:
                    vectors += [np.zeros(dim)] * len(batch)
                    failed += [True] * len(batch)
            yield frame.assign(embedding=vectors, failed=failed)

    return df.mapInPandas(run, schema)


def fit_hashing(df: DataFrame, text: str = "text", dim: int = DIM) -> PipelineModel:
    """Local provider: hashed term counts, inverse document frequency, unit length."""
    words = df.select(_words_of(df, text).alias("_words"))
    tf = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dim)
    idf = IDF(inputCol="_tf", outputCol="_idf").fit(tf.transform(words))
    return PipelineModel([tf, idf, Normalizer(inputCol="_idf", outputCol="_unit", p=2.0)])


def embed_hashing(df: DataFrame, model: PipelineModel, text: str = "text") -> DataFrame:
    """Add ``embedding``; a text without words gets the zero vector."""
    out = model.transform(df.withColumn("_words", _words_of(df, text)))
    return out.withColumn("embedding", vector_to_array("_unit")).drop(
        "_words", "_tf", "_idf", "_unit"
    )


def _words_of(df: DataFrame, text: str) -> Column:
    """The ``words`` column where the caller has tokenised already, else fresh tokens."""
    return F.col("words") if "words" in df.columns else content_words(F.col(text))


def with_words(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``words``, which a fit and its application then share; ``cut`` the result in between."""
    return df.withColumn("words", content_words(F.col(text)))


def content_words(t: Column) -> Column:
    return tx.drop_stop_words(tx.word_tokens(F.coalesce(t, F.lit(""))))


def embed_one(df: DataFrame, model: PipelineModel, text: str) -> list[float]:
    """Vector of a single query text."""
    one = df.sparkSession.range(1).select(F.lit(text).alias("text"))
    return embed_hashing(one, model).first()["embedding"]


def dimension(df: DataFrame, column: str = "embedding") -> int:
    row = df.where(F.col(column).isNotNull()).select(F.size(column).alias("n")).first()
    return 0 if row is None else row["n"]


def documents(texts: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """(row_id, document struct<text, metadata>); texts without metadata get an empty map."""
    empty = F.expr("cast(map() as map<string,string>)")
    if metadata is None:
        return texts.select(
            "row_id", F.struct(F.col("text"), empty.alias("metadata")).alias("document")
        )
    return texts.join(metadata.select("row_id", "metadata"), "row_id", "left").select(
        "row_id",
        F.struct(F.col("text"), F.coalesce("metadata", empty).alias("metadata")).alias("document"),
    )


def with_metadata(embedded: DataFrame, metadata: DataFrame) -> DataFrame:
    """(index, embedding, metadata, text) of the rows both sides have."""
    return embedded.join(metadata.select("row_id", "metadata"), "row_id").select(
        F.col("row_id").alias("index"), "embedding", "metadata", "text"
    )


def mean_of(vector: Column) -> Column:
    """Aggregate: element-wise mean of ``array<double>`` vectors, combined map-side."""
    return vector_to_array(Summarizer.mean(array_to_vector(vector.cast("array<double>"))))


def mean_vector(df: DataFrame, column: str = "embedding", by: str | None = None) -> DataFrame:
    """One mean vector, or one per value of ``by``."""
    grouped = df.groupBy(by) if by else df.groupBy()
    return grouped.agg(mean_of(F.col(column)).alias("mean"))
