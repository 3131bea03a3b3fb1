"""The full analysis and its file-level companions."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.functions import text as tx
from themeloom.operators import (
    clusters,
    compare,
    density,
    drift,
    embed,
    lexical,
    profile,
    quality,
    rows,
    themes,
    tuning,
)
from themeloom.operators.reduce import fit_reducer, reduce
from themeloom.runtime import cut
from themeloom.sources import bundle, registry, scan


@dataclass(frozen=True)
class Options:
    """Everything a run can be told."""

    n_components: int = 2
    min_cluster_size: int = 5
    min_samples: int = 3
    epsilon: float = 0.1
    dim: int = embed.DIM
    samples: int = 10
    repair: bool = True
    silhouette_metric: str = "euclidean"
    model_folder: str | None = None
    force_retrain: bool = False
    tuning: DataFrame | None = field(default=None, compare=False)
    retrain_threshold: float = 0.1


@dataclass
class Analysis:
    """Tables of one run."""

    records: DataFrame
    points: DataFrame
    centroids: DataFrame
    sizes: DataFrame
    samples: DataFrame
    themes: DataFrame
    quality: DataFrame
    silhouette_metric: str
    trials: DataFrame | None = None
    reused_model: bool = False
    texts: DataFrame | None = None

    @cached_property
    def processed(self) -> DataFrame:
        """The full record of every text: cleaned text, sentences, lemmas, key phrases, language
        and counts; worked out when first asked for."""
        return cut(lexical.preprocess(self.texts))

    @cached_property
    def corpus(self) -> DataFrame:
        """Totals and means of the processed records."""
        return lexical.corpus_statistics(self.processed)

    @cached_property
    def statistics(self) -> DataFrame:
        """Counts, silhouette and quality label, worked out when first asked for."""
        return quality.clustering_statistics(self.points, self.silhouette_metric)


def clean_records(df: DataFrame, column: str = "text", repair: bool = True) -> DataFrame:
    """(row_id, text, words): cleaned texts without leading boilerplate and their non-stop
    words; every row is kept."""
    base = rows.fill_empty(df, column)
    cleaned = base.select(
        "row_id", tx.remove_boilerplate(tx.clean_text(F.col("text"), repair)).alias("text")
    )
    # tokens are kept: weighting, hashing and naming all read them
    return cleaned.withColumn("words", tx.words_of_clean(F.col("text")))


def embed_records(
    records: DataFrame, dim: int = embed.DIM, provider: embed.Provider | None = None
) -> DataFrame:
    """(row_id, embedding) from the given provider or the local one."""
    if provider:
        return embed.embed_with_provider(records, provider, dim).select("row_id", "embedding")
    model = embed.fit_hashing(records, "text", dim)
    return embed.embed_hashing(records, model).select("row_id", "embedding")


def tuned(vectors: DataFrame, trials: DataFrame, folder: str, options: Options = Options()) -> Options:
    """Options with the parameters of the best trial: trials are run, saved below ``folder`` and
    read back, so that later runs may start from them."""
    bundle.save_trials(tuning.run_trials(vectors, trials, options.silhouette_metric), folder)
    best = tuning.best_parameters(bundle.load_trials(vectors.sparkSession, folder))
    return Options(**{**options.__dict__, **best})


def train(vectors: DataFrame, options: Options) -> tuple[PipelineModel, DataFrame]:
    """Reducer and (row_id, point, cluster_id)."""
    reducer = fit_reducer(vectors, options.n_components)
    points = cut(reduce(vectors, reducer).select("row_id", "point"))
    labels = density.density_clusters(
        points, options.min_cluster_size, options.min_samples, options.epsilon
    )
    return reducer, cut(points.join(labels, "row_id"))


def save_model(
    folder: str, reducer: PipelineModel, vectors: DataFrame, points: DataFrame, options: Options
) -> None:
    centers = cut(clusters.centroids(points))
    bundle.save(
        folder,
        reducer,
        {
            "min_cluster_size": options.min_cluster_size,
            "min_samples": options.min_samples,
            "epsilon": options.epsilon,
            "dim": options.dim,
        },
        vectors.select("row_id", "embedding"),
        clusters.cluster_radii(points, centers),
    )


def fit_or_reuse(vectors: DataFrame, options: Options) -> tuple[DataFrame, bool]:
    """Points with labels. A stored model is reused unless retraining is forced: its
    reducer places the rows and they are clustered anew, as are the centroids later on."""
    spark = vectors.sparkSession
    folder = options.model_folder
    if folder and not options.force_retrain and bundle.exists(spark, folder):
        # tuned parameters go before the stored ones
        return predict_refit(vectors, bundle.load(spark, folder), options if options.tuning is not None else None), True
    reducer, points = train(vectors, options)
    if folder:
        save_model(folder, reducer, vectors, points, options)
    return points, False


def predict_refit(vectors: DataFrame, model: bundle.Bundle, options: Options | None = None) -> DataFrame:
    """Labels from clustering the new rows alone (ids unrelated to training), with the stored
    parameters or those of ``options``."""
    points = cut(reduce(vectors, model.reducer).select("row_id", "point"))
    p = model.parameters if options is None else options.__dict__
    labels = density.density_clusters(points, p["min_cluster_size"], p["min_samples"], p["epsilon"])
    return cut(points.join(labels, "row_id"))


def predict_assign(vectors: DataFrame, model: bundle.Bundle) -> DataFrame:
    """Labels of the nearest training centroid, noise beyond its training radius."""
    return clusters.predict_assign(
        reduce(vectors, model.reducer).select("row_id", "point"), model.centroids
    )


def analyze(
    df: DataFrame,
    column: str = "text",
    options: Options = Options(),
    provider: embed.Provider | None = None,
    **responders,
) -> Analysis:
    """Clean, embed, cluster and describe the texts of (row_id, ``column``)."""
    records = cut(clean_records(df, column, options.repair))
    vectors = cut(embed_records(records, options.dim, provider))
    trials = None
    if options.tuning is not None:
        trials = cut(tuning.run_trials(vectors, options.tuning, options.silhouette_metric))
        best = tuning.best_parameters(trials)
        options = Options(**{**options.__dict__, **best})
    points, reused = fit_or_reuse(vectors, options)
    samples = cut(clusters.cluster_samples(points, records, options.samples))
    sizes = cut(clusters.cluster_sizes(points))
    named = themes.theme_names(
        records.select("row_id", "words").join(points.where(F.col("cluster_id") != -1).select("row_id", "cluster_id"), "row_id")
    )
    return Analysis(
        records=records,
        points=points,
        centroids=clusters.centroids(points),
        sizes=sizes,
        samples=samples,
        themes=themes.theme_table(samples, named, sizes, **responders),
        quality=rows.quality_share(records),
        silhouette_metric=options.silhouette_metric,
        trials=trials,
        reused_model=reused,
        texts=rows.fill_empty(df, column),
    )


# ------------------------------------------------------------------ files


def _input(spark: SparkSession, path: str, column: str | None) -> tuple[DataFrame, str]:
    df, name = scan.load(spark, path, column)
    return cut(df), name


def run_analysis(
    spark: SparkSession,
    path: str,
    column: str | None = None,
    options: Options = Options(),
    store: str | None = None,
    **providers,
) -> tuple[str, Analysis]:
    """Analyse a CSV file; with ``store`` the themes are kept under the analysis id."""
    df, name = _input(spark, path, column)
    result = analyze(df, name, options, **providers)
    key = registry.analysis_id_of(spark, path, name)
    if store:
        registry.put(result.themes, store, key)
    return key, result


def file_vectors(
    spark: SparkSession, path: str, column: str | None = None, dim: int = embed.DIM, provider=None
) -> DataFrame:
    df, name = _input(spark, path, column)
    return cut(embed_records(cut(clean_records(df, name)), dim, provider))


def profile_file(
    spark: SparkSession, path: str, column: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(facts, validation) of a file, its size included; an empty file is reported, not refused."""
    df = cut(scan.read_csv(spark, path))
    name = column or profile.detect_text_column(df)
    facts = cut(profile.profile(df, name, scan.file_bytes(spark, path)))
    return facts, profile.validate(facts)


def compare_file_themes(
    spark: SparkSession,
    left: str,
    right: str,
    options: Options = Options(),
    threshold: float = 0.8,
    provider: embed.Provider | None = None,
) -> DataFrame:
    """One row (shared_themes, unique_themes) for two files.

    Each file is clustered by itself; themes are compared by the mean vectors of their texts,
    for which one set of word weights serves both files.
    """
    sides = []
    for path in (left, right):
        df, name = _input(spark, path, None)
        sides.append(clean_records(df, name, options.repair))
    both = [s.withColumn("side", F.lit(i)) for i, s in enumerate(sides)]
    records = cut(both[0].unionByName(both[1]))
    if provider:
        vectors = embed.embed_with_provider(records, provider, options.dim)
    else:
        vectors = embed.embed_hashing(records, embed.fit_hashing(records, "text", options.dim))
    vectors = cut(vectors.select("side", "row_id", "embedding"))
    themes_of = []
    for i in range(2):
        mine = vectors.where(F.col("side") == i).drop("side")
        points = train(mine, options)[1].where(F.col("cluster_id") != -1)
        themes_of.append(
            cut(
                embed.mean_vector(
                    mine.join(points.select("row_id", "cluster_id"), "row_id"), by="cluster_id"
                ).select("cluster_id", F.col("mean").alias("centroid"))
            )
        )
    return compare.compare_files(*themes_of, options.dim, threshold)


def tune_file(spark: SparkSession, path: str, trials: DataFrame, **how) -> DataFrame:
    return tuning.run_trials(file_vectors(spark, path, **how), trials)


def predict_file(spark: SparkSession, path: str, folder: str, mode: str = "assign", **how):
    """(points, statistics) of a file under a stored model."""
    model = bundle.load(spark, folder)
    vectors = file_vectors(spark, path, dim=model.parameters["dim"], **how)
    found = predict_assign(vectors, model) if mode == "assign" else predict_refit(vectors, model)
    found = cut(found)
    return found, clusters.prediction_statistics(found)


def drift_of_file(
    spark: SparkSession, path: str, folder: str, threshold: float = 0.1, **how
) -> DataFrame:
    model = bundle.load(spark, folder)
    vectors = file_vectors(spark, path, dim=model.parameters["dim"], **how)
    return drift.drift_decision(drift.drift_score(vectors, model.training), threshold)


def retrain(spark: SparkSession, path: str, options: Options, **providers) -> tuple[str, Analysis]:
    forced = Options(**{**options.__dict__, "force_retrain": True})
    return run_analysis(spark, path, options=forced, **providers)
