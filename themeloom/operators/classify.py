"""Issue classification of texts by a fitted model: logistic regression over hashed features, which are
the distinct words and marks of a text and buckets of measures of its surface."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.runtime import cut, ensure_checkpoint_dir

#: Hash buckets, strength of the penalty, and the probability from which a text is an issue.
BUCKETS, PENALTY, THRESHOLD = 1 << 16, 3e-3, 0.7

#: Buckets of a share.
STEPS = 20


def features(text: Column) -> Column:
    """Distinct words in lower case, runs of other characters, and `` name=bucket`` (with a blank, as no
    word has) of the shares of capitals, marks and digits, of distinct words and lines, and the size."""
    low = F.lower(text)
    words = F.regexp_extract_all(low, F.lit(r"\p{L}+"), F.lit(0))
    lines = F.array_remove(F.split(text, "\n"), "")
    chars = F.greatest(F.length(text), F.lit(1))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)) / chars
    distinct = lambda xs: F.size(F.array_distinct(xs)) / F.greatest(F.size(xs), F.lit(1))
    shares = {
        "capitals": count(r"\p{Lu}"), "marks": count(r"[^\p{L}\s]"), "digits": count(r"\p{N}"),
        "words": distinct(words), "lines": distinct(lines), "size": F.log10(F.size(words) + 1) / 6,
    }
    bucket = lambda x: F.least(F.lit(STEPS - 1), F.floor(x * STEPS)).cast("string")
    surface = F.array(*[F.concat(F.lit(f" {name}="), bucket(x)) for name, x in shares.items()])
    tokens = F.array_distinct(F.regexp_extract_all(low, F.lit(r"\p{L}+|[^\s\p{L}]+"), F.lit(0)))
    # no branch: only what every row needs is shared between expressions, and words stand in three of them
    found = F.concat(tokens, surface)
    return F.slice(found, F.lit(1), F.when(F.size(tokens) > 0, F.size(found)).otherwise(F.lit(0)))


def fit(df: DataFrame, text: str = "text", label: str = "label", buckets: int = BUCKETS) -> PipelineModel:
    """A model of the labelled rows (label 0 or 1; others are left out). Fails on one class."""
    rows = df.where(F.col(label).isin(0, 1)).select(
        features(F.coalesce(F.col(text), F.lit(""))).alias("_tokens"), F.col(label).cast("double").alias("_label")
    )
    hashed = HashingTF(numFeatures=buckets, binary=True, inputCol="_tokens", outputCol="_bits")
    data = cut(hashed.transform(rows).select("_bits", "_label"))
    if data.select("_label").distinct().count() < 2:
        raise ValueError("labels of two classes are needed")
    model = LogisticRegression(
        featuresCol="_bits", labelCol="_label", probabilityCol="_p", predictionCol="_guess",
        rawPredictionCol="_raw", regParam=PENALTY, maxIter=50,
    ).fit(data)
    # a stored model is read back without the summary of its training, which holds the session and
    # so cannot be sent to tasks
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/classifier-{uuid.uuid4().hex}"
    PipelineModel([hashed, model]).write().save(path)
    return PipelineModel.load(path)


def classify(df: DataFrame, model: PipelineModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with probability, is_positive (from ``threshold`` on) and confidence: high where the
    probability is as far from a half as the threshold or further. Empty texts are negative."""
    kept = df.columns
    tokens = df.withColumn("_tokens", features(F.coalesce(F.col(text), F.lit(""))))
    p = F.when(F.size("_tokens") > 0, F.get(vector_to_array("_p"), F.lit(1))).otherwise(F.lit(0.0))
    return model.transform(tokens).select(*kept, p.alias("probability")).select(
        "*",
        (F.col("probability") >= threshold).alias("is_positive"),
        F.when(F.abs(F.col("probability") - 0.5) >= abs(threshold - 0.5), "high").otherwise("low").alias("confidence"),
    )


def scores(classified: DataFrame, label: str = "label") -> DataFrame:
    """One row: rows, accuracy, precision and recall of ``is_positive`` against ``label``; 0 without rows."""
    yes, hit = F.col(label) == 1, F.col("is_positive")
    n = F.count(F.lit(1))
    share = lambda a, b: F.when(F.count_if(b) > 0, F.count_if(a & b) / F.count_if(b)).otherwise(F.lit(0.0))
    return classified.where(F.col(label).isNotNull()).agg(
        n.alias("n"),
        F.when(n > 0, F.count_if(hit == yes) / n).otherwise(F.lit(0.0)).alias("accuracy"),
        share(yes, hit).alias("precision"),
        share(hit, yes).alias("recall"),
    )
