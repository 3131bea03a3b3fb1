"""Parameter search: trials are rows, scores are columns."""

from __future__ import annotations

import logging

from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeloom.functions import fixed
from themeloom.operators import density, quality, report
from themeloom.operators.merge_tree import cut_trees
from themeloom.operators.reduce import fit_reducer, reduce
from themeloom.runtime import cut

log = logging.getLogger(__name__)


def best_trial(trials: DataFrame) -> DataFrame:
    """The row with the highest score, ties to the lowest trial_id."""
    return trials.orderBy(F.desc("score"), "trial_id").limit(1)


def trial_statistics(trials: DataFrame) -> DataFrame:
    return trials.agg(
        F.count(F.lit(1)).alias("n_trials"),
        F.avg("score").alias("mean_score"),
        F.stddev_samp("score").alias("std_score"),
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
    )


def random_trials(spark: SparkSession, n: int = 100, seed: int = 42) -> DataFrame:
    """``n`` seeded draws from the search space, one row per trial."""
    out = spark.range(n).withColumnRenamed("id", "trial_id")
    for i, (name, (low, high)) in enumerate(fixed.SEARCH_SPACE.items()):
        draw = F.rand(seed + i)
        if isinstance(low, int):
            value = F.floor(F.lit(low) + draw * (high - low + 1)).cast("int")
        else:
            value = F.lit(low) + draw * (high - low)
        out = out.withColumn(name, value)
    return out


def grid_trials(spark: SparkSession, **values: list) -> DataFrame:
    """Every combination of the listed values, one row per trial."""
    out = spark.range(1).drop("id")
    for name, options in values.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in options])))
    w = Window.orderBy(*values)
    return out.withColumn("trial_id", (F.row_number().over(w) - 1).cast("bigint"))


def run_trials(vectors: DataFrame, trials: DataFrame, metric: str = "euclidean") -> DataFrame:
    """Trials with their ``score``; a trial whose parameters do not suit the data scores -1.

    Trials that share n_components, min_samples and n_neighbors share everything that costs: one
    reduction, one spanning tree, one tree of merges cut by the table of their min_cluster_size and
    epsilon, and one pass of scoring. The driver only walks these groups. ``n_neighbors`` is the
    least length of the neighbour lists behind the tree; ``min_dist`` shapes no linear reduction and
    is only carried along.
    """
    rows = [r.asDict() for r in trials.collect()]
    groups: dict[tuple, list[dict]] = {}
    for r in rows:
        if r["min_cluster_size"] >= 2 and r["min_samples"] >= 1:
            groups.setdefault((r["n_components"], r["min_samples"], r.get("n_neighbors") or 16), []).append(r)
    reduced, scores = {}, {}
    for (d, samples, k), group in sorted(groups.items()):
        try:
            if d not in reduced:
                model = fit_reducer(vectors, d)
                reduced = {d: cut(reduce(vectors, model).select("row_id", "point"))}
            scores |= _scores(reduced[d], group, samples, k, metric)
        except (ValueError, IllegalArgumentException) as e:
            log.warning("trials %s failed: %s", [r["trial_id"] for r in group], e)
    schema = T.StructType([*trials.schema.fields, T.StructField("score", T.DoubleType())])
    scored = [{**r, "score": scores.get(r["trial_id"], -1.0)} for r in rows]
    return trials.sparkSession.createDataFrame(
        [tuple(s[f.name] for f in schema.fields) for s in scored], schema
    )


def _scores(points: DataFrame, group: list[dict], samples: int, k: int, metric: str) -> dict:
    """Score by trial_id of trials over the same points and neighbour counts."""
    nodes, edges = density.spanning_tree(points, samples, k=k)
    # equal settings give equal labels: they are cut and scored once
    cases = sorted({(r["min_cluster_size"], r["epsilon"]) for r in group})
    labels = cut(cut_trees(nodes, edges, [(i, m, e) for i, (m, e) in enumerate(cases)]))
    distinct = nodes.select("pid", "point", F.col("copies").alias("weight"))
    scored = quality.trial_scores(distinct, labels, points.count(), list(range(len(cases))), metric)
    found = {cases[r["trial"]]: float(r["score"]) for r in scored.select("trial", "score").collect()}
    return {r["trial_id"]: found[r["min_cluster_size"], r["epsilon"]] for r in group}


def best_parameters(scored: DataFrame) -> dict:
    """Parameters of the best trial for ``density_clusters`` and the reducer."""
    row = best_trial(scored).first()
    if row is None:
        raise ValueError("Must run the trials before asking for the best parameters")
    keys = ("n_components", "min_cluster_size", "min_samples", "epsilon")
    return {k: row[k] for k in keys if k in row}


def optimization_report(scored: DataFrame) -> DataFrame:
    """Report lines of scored trials: their statistics and the best one's parameters."""
    scores = {
        name: report.number(F.col(f"{name}_score"), 4) for name in ("mean", "std", "min", "max")
    }
    best = best_trial(scored)
    chosen = {c: F.col(c) for c in best.columns if c not in ("score", "trial_id")}
    return report.ordered(
        report.facts(0, "trials", trial_statistics(scored), {"count": F.col("n_trials"), **scores}),
        report.facts(1, "best", best, {"score": report.number(F.col("score"), 4), **chosen}),
    )
