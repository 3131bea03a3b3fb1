"""Linear reduction of vectors: unit length, then principal components.

This is PCA and nothing else; it does not imitate a neighbour-graph layout. The cosine
neighbour graph itself is ``neighbors.knn_graph`` / ``cosine_top_k``.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import PCA, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_reducer(df: DataFrame, components: int = 2, column: str = "embedding") -> PipelineModel:
    """Unit-length + PCA model. The covariance is summed map-side (dim x dim per task)."""
    vectors = df.select(array_to_vector(F.col(column).cast("array<double>")).alias("_v"))
    unit = Normalizer(inputCol="_v", outputCol="_unit", p=2.0)
    pca = PCA(k=components, inputCol="_unit", outputCol="_pc").fit(unit.transform(vectors))
    return PipelineModel([unit, pca])


def reduce(df: DataFrame, model: PipelineModel, column: str = "embedding") -> DataFrame:
    """Add ``point``, the reduced vector."""
    v = df.withColumn("_v", array_to_vector(F.col(column).cast("array<double>")))
    return model.transform(v).withColumn("point", vector_to_array("_pc")).drop("_v", "_unit", "_pc")
