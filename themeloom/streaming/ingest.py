"""Structured Streaming: ingest of landed files, drift watch, assignment of new texts.

All sinks write one folder per micro-batch, overwritten on a retry, so a batch replayed
after a failure leaves no duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from themeloom.functions import text as tx
from themeloom.operators import drift
from themeloom.operators.embed import mean_vector
from themeloom.operators.rows import extract_texts
from themeloom.plans import analysis
from themeloom.runtime import cut, widen
from themeloom.sources import bundle
from themeloom.sources.scan import path_exists


def landed_stream(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """Rows of the CSV files arriving in ``folder``, each file once."""
    return (
        spark.readStream.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("pathGlobFilter", "*.csv")
        .csv(folder)
    )


def clean_stream(rows: DataFrame, column: str, row_id: str) -> DataFrame:
    """(row_id, text): usable texts, cleaned. Stateless, so it runs on streams as it is."""
    texts = extract_texts(rows, column, row_id)
    return texts.select("row_id", tx.clean_text(F.col("text")).alias("text"))


def _batches(stream: DataFrame, write, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ingest(stream: DataFrame, column: str, row_id: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append cleaned texts of every micro-batch to the table ``out``."""

    def write(batch: DataFrame, number: int) -> None:
        clean_stream(batch, column, row_id).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return _batches(stream, write, checkpoint)


def watch_drift(
    vectors: DataFrame, model_folder: str, log: str, checkpoint: str, threshold: float = 0.1
) -> StreamingQuery:
    """Append the drift decision of every micro-batch of (row_id, embedding) to ``log``.
    The training mean is computed once, not per batch."""
    spark = vectors.sparkSession
    train_mean = cut(mean_vector(bundle.load(spark, model_folder).training))

    def write(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        score = drift.drift_from_means(mean_vector(batch), train_mean)
        drift.drift_decision(score, threshold).write.mode("overwrite").parquet(
            f"{log}/batch={number}"
        )

    return _batches(vectors, write, checkpoint)


def assign_stream(vectors: DataFrame, model_folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append (row_id, point, cluster_id) of every micro-batch to ``out``."""
    model = bundle.load(vectors.sparkSession, model_folder)

    def write(batch: DataFrame, number: int) -> None:
        analysis.predict_assign(batch, model).write.mode("overwrite").parquet(
            f"{out}/batch={number}"
        )

    return _batches(vectors, write, checkpoint)


def current_version(spark: SparkSession, root: str, number: int) -> tuple[int, str]:
    """(version, folder) of the model that holds before micro-batch ``number``: what the log of
    earlier batches says, else version 1. A batch that is replayed finds what it found before."""
    if not path_exists(spark, f"{root}/log"):
        return 1, f"{root}/version=1"
    log = spark.read.parquet(f"{root}/log").where(F.col("batch") < number)
    last = log.orderBy(F.desc("batch")).select("version", "folder").first()
    return (last["version"], last["folder"]) if last else (1, f"{root}/version=1")


def recluster_stream(
    vectors: DataFrame, root: str, out: str, checkpoint: str, options: analysis.Options, threshold: float = 0.1
) -> StreamingQuery:
    """Append (row_id, point, cluster_id, version) of every micro-batch of (row_id, embedding) to
    ``out``, and cluster anew where the vectors have moved away.

    The model of version 1 lies in ``root/version=1``. A batch whose drift from the training vectors
    of the current model passes the threshold is added to them, and a bundle of the next version is
    trained and saved; that batch and the later ones are assigned by it. ``root/log`` keeps a row for
    every batch: rows, drift_score, retrained, version and its folder. A model is swapped only
    between batches, and its folder carries the batch, so that a replay writes the same places.
    """
    spark = vectors.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        # a batch may be one file, read by one task: all that follows takes as many as there are cores
        batch = cut(widen(batch.select("row_id", "embedding"), "row_id"))
        n = batch.count()
        if not n:
            return
        version, folder = current_version(spark, root, number)
        model = bundle.load(spark, folder)
        found = drift.drift_decision(drift.drift_score(batch, model.training), threshold).first()
        if found["needs_retraining"]:
            version, folder = version + 1, f"{root}/version={version + 1}-batch={number}"
            grown = cut(model.training.select("row_id", "embedding").unionByName(batch))
            reducer, points = analysis.train(grown, options)
            analysis.save_model(folder, reducer, grown, points, options)
            model = bundle.load(spark, folder)
        done = analysis.predict_assign(batch, model).withColumn("version", F.lit(version))
        done.write.mode("overwrite").parquet(f"{out}/batch={number}")
        spark.range(1).select(
            F.lit(n).cast("bigint").alias("rows"), F.lit(found["drift_score"]).alias("drift_score"),
            F.lit(found["needs_retraining"]).alias("retrained"), F.lit(version).alias("version"), F.lit(folder).alias("folder"),
        ).write.mode("overwrite").parquet(f"{root}/log/batch={number}")

    return _batches(vectors, write, checkpoint)
