"""Drift of new vectors against training vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.functions import vector
from themeloom.operators.embed import mean_vector


def drift_from_means(new_mean: DataFrame, train_mean: DataFrame) -> DataFrame:
    """One row ``drift_score`` = 1 - cosine of two one-row ``mean`` tables; NaN when
    either mean has no length."""
    a, b = F.col("mean"), F.col("_train")
    size = vector.norm(a) * vector.norm(b)
    return new_mean.select("mean", train_mean.select("mean").scalar().alias("_train")).select(
        F.when(size == 0, F.lit(float("nan")))
        .otherwise(1 - vector.dot(a, b) / size)
        .alias("drift_score")
    )


def drift_score(new: DataFrame, training: DataFrame, column: str = "embedding") -> DataFrame:
    return drift_from_means(mean_vector(new, column), mean_vector(training, column))


def drift_decision(score: DataFrame, threshold: float = 0.1) -> DataFrame:
    d = F.col("drift_score")
    return score.select(
        "drift_score",
        F.lit(float(threshold)).alias("threshold"),
        (~F.isnan(d) & (d > threshold)).alias("needs_retraining"),
        F.when(~F.isnan(d) & (d > 0.2), F.lit("High"))
        .when(~F.isnan(d) & (d > 0.1), F.lit("Medium"))
        .otherwise(F.lit("Low"))
        .alias("drift_severity"),
    )


def update_training(
    new: DataFrame, training: DataFrame, threshold: float = 0.1, column: str = "embedding"
) -> DataFrame:
    """Training rows, plus the new ones when drift passes the threshold.

    The gate is a scalar subquery over the two means, so the decision is part of the plan
    and a closed gate prunes the new rows at run time.
    """
    gate = drift_score(new, training, column).select(
        (~F.isnan("drift_score") & (F.col("drift_score") > threshold)).alias("open")
    )
    return training.unionByName(new.where(gate.scalar()))


def needs_update(new: DataFrame, training: DataFrame, threshold: float = 0.1) -> bool:
    score = drift_score(new, training).first()["drift_score"]
    return score is not None and score == score and score > threshold
