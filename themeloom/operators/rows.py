"""Row-level projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeloom.functions import fixed, vector


def normalize_na(df: DataFrame, tokens: list[str] | None = None) -> DataFrame:
    """Turn missing-value tokens of every string column into NULL."""
    tokens = fixed.NA_TOKENS if tokens is None else tokens
    out = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            col = F.when(~col.isin(*tokens), col).alias(field.name)
        out.append(col)
    return df.select(*out)


def extract_texts(df: DataFrame, column: str, row_id: str = "row_id") -> DataFrame:
    """(row_id, text) of usable texts; an unknown column gives no rows."""
    if column not in df.columns:
        return df.sparkSession.createDataFrame([], "row_id bigint, text string")
    text = F.col(f"`{column}`").cast("string")
    return df.where(text.isNotNull() & ~F.lower(text).isin(*fixed.EMPTY_TEXTS)).select(
        F.col(row_id).alias("row_id"), text.alias("text")
    )


def fill_empty(df: DataFrame, column: str, row_id: str = "row_id") -> DataFrame:
    """(row_id, text) of every row, NULL as ''."""
    text = F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))
    return df.select(F.col(row_id).alias("row_id"), text.alias("text"))


def analysis_dataset(processed: DataFrame, source: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Processed rows with their source columns, prefixed ``original_``.

    ``processed`` carries row_id, original, cleaned, processed, language, length. A
    source column whose prefixed name is taken gets ``src_`` instead.
    """
    base = processed.select(
        F.col("row_id").alias("original_index"),
        F.col("original").alias("original_summary"),
        F.col("cleaned").alias("cleaned_summary"),
        F.col("processed").alias("processed_summary"),
        "language",
        F.col("length").alias("summary_length"),
    )
    taken = set(base.columns)
    picked = []
    for name in source.columns:
        if name == row_id:
            continue
        wanted = f"original_{name}"
        picked.append(F.col(f"`{name}`").alias(f"src_{name}" if wanted in taken else wanted))
    right = source.select(F.col(row_id).alias("_rid"), *picked)
    return base.join(right, F.col("original_index") == F.col("_rid"), "left").drop("_rid")


def quality_branch(text: Column) -> Column:
    """'short', 'keyword' or NULL, the first rule that holds."""
    low = F.lower(text)
    return F.when(F.length(F.trim(text)) < 10, F.lit("short")).when(
        low.contains("error") | low.contains("null"), F.lit("keyword")
    )


def quality_share(df: DataFrame, text: str = "text") -> DataFrame:
    """One row: flagged texts, their percentage, all texts."""
    flagged = F.count(quality_branch(F.col(text)))
    total = F.count(F.lit(1))
    return df.agg(
        flagged.alias("data_quality_count"),
        F.when(total > 0, flagged / total * 100)
        .otherwise(F.lit(0.0))
        .alias("data_quality_percentage"),
        total.alias("total_texts"),
    )


def is_valid_text(text: Column, min_length: int = 10) -> Column:
    return F.coalesce(F.length(text) >= min_length, F.lit(False))


def truncate_text(text: Column, max_length: int = 2000) -> Column:
    return F.substring(text, 1, max_length)


def language_filter(df: DataFrame, languages=("en",), column: str = "language") -> DataFrame:
    return df.where(F.col(column).isin(*languages))


def lower_case(text: Column) -> Column:
    return F.lower(text)


def dedupe(df: DataFrame, text: str = "text", row_id: str = "row_id") -> DataFrame:
    """Keep the first row of each distinct text.

    Texts are compared by digest: digests that occur again, with their first id, are a map-side
    combined aggregate, and only the rows to drop, ids alone, meet the table. While these are few
    enough to broadcast the texts stay where they are.
    """
    digest = F.coalesce(F.sha2(F.col(text), 256), F.lit(""))
    own = df.select(row_id, digest.alias("_digest"))
    again = own.groupBy("_digest").agg(F.min(row_id).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    gone = own.join(again.drop("_n"), "_digest").where(F.col(row_id) > F.col("_first")).select(row_id)
    return df.join(gone, row_id, "left_anti")


def valid_embeddings(df: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    return df.withColumn("is_valid", vector.is_valid(F.col(column), dim))


def theme_list(themes: DataFrame) -> DataFrame:
    """The seven fields a theme listing shows."""
    return themes.select(
        F.col("cluster_id").alias("theme_id"),
        F.col("name").alias("theme_name"),
        "description",
        "sample_count",
        "data_quality_issues",
        "data_quality_percentage",
        F.col("samples").alias("representative_examples"),
    )


def theme_detail(themes: DataFrame) -> DataFrame:
    """First three examples and the issue rate at one decimal."""
    return themes.select(
        "cluster_id",
        "name",
        F.slice("samples", 1, 3).alias("examples"),
        F.when(
            F.col("sample_count") > 0,
            F.round(F.col("data_quality_issues") / F.col("sample_count") * 100, 1),
        )
        .otherwise(F.lit(0.0))
        .alias("issue_rate"),
    )


def themes_with_issues(themes: DataFrame) -> DataFrame:
    return themes.where(F.col("data_quality_issues") > 0)


def overview(texts: DataFrame, themes: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: records, themes, clusters and quality issues, from scalar subqueries."""
    t = texts.agg(
        F.count(F.lit(1)).alias("total_records"),
    )
    n_themes = themes.agg(F.count(F.lit(1)).alias("n")).scalar()
    issues = themes.agg(F.coalesce(F.sum("data_quality_issues"), F.lit(0)).alias("n")).scalar()
    clusters = (
        labels.where(F.col("cluster_id") != -1)
        .agg(F.countDistinct("cluster_id").alias("n"))
        .scalar()
    )
    return t.select(
        "total_records",
        n_themes.alias("total_themes"),
        clusters.alias("total_clusters"),
        issues.cast("bigint").alias("quality_issues"),
    )


def cluster_result(points: DataFrame, stats: DataFrame) -> DataFrame:
    """Points with their labels plus the run's statistics on every row."""
    one = stats.select(
        F.struct("num_clusters", "num_noise_points", "total_points").alias("s")
    ).scalar()
    return points.select("row_id", "point", "cluster_id", one.alias("statistics"))
