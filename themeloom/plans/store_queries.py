"""Registered round trips: CSV, sinks, stored models, results by id, trials and streams.

Each writes what Spark derives from a given table below ``spark.checkpoint.dir`` and reads it
back, so the checks see what was stored.
"""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.ml.feature import Normalizer
from pyspark.sql import functions as F

from themeloom.functions import fixed
from themeloom.functions import text as tx
from themeloom.operators import drift, themes, tuning
from themeloom.operators.profile import detect_text_column
from themeloom.operators.reduce import reduce
from themeloom.plans import analysis
from themeloom.plans import sqltext as q
from themeloom.plans import tables as t
from themeloom.plans.theme_queries import SQL as THEME_SQL
from themeloom.plans.theme_queries import theme_frame
from themeloom.plans.vector_queries import SQL as VECTOR_SQL
from themeloom.plans.vector_queries import DIM, _order_trials, dist
from themeloom.runtime import ensure_checkpoint_dir, tidy
from themeloom.sources import bundle, registry, scan, sinks
from themeloom.streaming import ingest

RUN, SQL = {}, {}


def query(name, sql=None):
    def keep(fn):
        RUN[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return keep


def _folder(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ CSV and sinks

_NA = ", ".join(q.quote(x) for x in fixed.NA_TOKENS)


@query(
    "csv_round_trip",
    f"""SELECT doc_id, CASE WHEN text NOT IN ({_NA}) THEN text END AS text,
      CASE WHEN lang NOT IN ({_NA}) THEN lang END AS lang, n_chars FROM documents""",
)
def _csv(spark, sf_dir):
    """Whole documents, line breaks and quotes included, through the CSV sink and scan."""
    d = t.read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    path = _folder(spark, "documents") + ".csv"
    sinks.write_csv(d, path)
    return scan.read_csv(spark, path, d.schema).drop("row_id")


@query(
    "profile_file",
    f"""SELECT count(*) AS total_rows, 3::BIGINT AS total_columns, 'doc_id,text,n_chars' AS column_names,
      'text' AS summary_column, count(*) FILTER (text NOT IN ({_NA})) AS summary_count,
      count(*) - count(*) FILTER (text NOT IN ({_NA})) AS empty_summaries, true AS measured,
      true AS is_valid FROM documents""",
)
def _profile_file(spark, sf_dir):
    """Facts and validity of a CSV file."""
    path = _folder(spark, "profile") + ".csv"
    sinks.write_csv(t.read(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"), path)
    facts, validation = analysis.profile_file(spark, path)
    return facts.select(
        "*",
        (F.col("file_size") > F.col("total_rows")).alias("measured"),
        validation.select("is_valid").scalar().alias("is_valid"),
    ).drop("file_size")


@query(
    "sink_clustering",
    "SELECT point[1] AS x, point[2] AS y, cluster_id::BIGINT AS cluster "
    f"FROM {t.POINTS}",
)
def _sink_clustering(spark, sf_dir):
    folder = _folder(spark, "results")
    sinks.write_clustering(t.points(spark, sf_dir), folder)
    return scan.read_csv(
        spark,
        f"{folder}/clustering_results.csv",
        spark.range(0).selectExpr("0D AS x", "0D AS y", "0L AS cluster").schema,
    ).drop("row_id")


@query("registry_round_trip", "SELECT source, count(*) AS n, (SELECT count(DISTINCT source) "
       "FROM documents) AS stored FROM documents GROUP BY source")
def _registry(spark, sf_dir):
    """Two results are stored, one is deleted; what is left, beside the listing's count."""
    root = _folder(spark, "registry")
    d = t.read(spark, sf_dir, "documents")
    kept = registry.analysis_id_of(spark, "documents", "source")
    gone = registry.analysis_id_of(spark, "documents", "lang")
    for key, column in ((kept, "source"), (gone, "lang")):
        registry.put(d.groupBy(column).agg(F.count(F.lit(1)).alias("n")), root, key)
    registry.delete(spark, root, gone)
    stored = registry.listing(spark, root).agg(F.sum("rows").alias("n")).scalar()
    return registry.get(spark, root, kept).select("source", "n", stored.alias("stored"))


@query("stored_trials", VECTOR_SQL["best_trial"])
def _stored_trials(spark, sf_dir):
    folder = _folder(spark, "trials")
    bundle.save_trials(_order_trials(spark, sf_dir), folder)
    best = tuning.best_trial(bundle.load_trials(spark, folder))
    return best.withColumn("score", tidy(F.col("score")))


# ------------------------------------------------------------------ landed files

_LANGS = ("de", "en", "fr")


def _language_files(spark, sf_dir):
    """A CSV folder for each of some languages, under the text column's own name in each."""
    d = t.read(spark, sf_dir, "documents")
    base = _folder(spark, "files")
    names = dict(zip(_LANGS, ("summary", "bug_text", "Description")))
    for lang, column in names.items():
        sinks.write_csv(d.where(F.col("lang") == lang).select("n_chars", F.col("text").alias(column)), f"{base}/{lang}.csv")
    return base


@query(
    "land_csv",
    f"""SELECT lang || '.csv' AS file_name, count(*) AS rows, true AS same_size FROM documents
      WHERE lang IN {_LANGS} GROUP BY lang""",
)
def _land(spark, sf_dir):
    """Files are landed one by one and reported; what lies there has the reported size and all rows."""
    base, out = _language_files(spark, sf_dir), None
    for lang in _LANGS:
        told = scan.land_csv(spark, f"{base}/{lang}.csv", f"{base}/landed").first()
        same = scan.file_bytes(spark, told["path"]) == told["file_size"] > 0
        held = scan.read_csv(spark, told["path"])
        one = held.agg(
            F.lit(told["file_name"]).alias("file_name"), F.count(F.lit(1)).alias("rows"), F.lit(same).alias("same_size")
        )
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "read_files",
    f"""SELECT lang || '.csv' AS file_name, CASE WHEN text NOT IN ({_NA}) THEN text END AS text
      FROM documents WHERE lang IN {_LANGS}""",
)
def _read_files(spark, sf_dir):
    """Files whose text columns have different names, as one table with the file's name."""
    base = _language_files(spark, sf_dir)
    return scan.read_files(spark, [f"{base}/{lang}.csv" for lang in _LANGS]).drop("row_id")


@query(
    "sink_processed",
    f"""SELECT doc_id, {q.clean('text')} AS cleaned_text, to_json({q.content_words('text')})::VARCHAR AS words
      FROM documents WHERE {q.clean('text')} NOT IN ({_NA})""",
)
def _sink_processed(spark, sf_dir):
    """Processed rows, arrays as JSON, written and read back."""
    d = t.texts(spark, sf_dir)
    words = tx.drop_stop_words(tx.word_tokens(F.col("text")))
    folder = _folder(spark, "results")
    sinks.write_processed(d.select(F.col("row_id").alias("doc_id"), tx.clean_text(F.col("text")).alias("cleaned_text"), words.alias("words")), folder)
    back = scan.read_csv(spark, f"{folder}/processed_summaries.csv", spark.range(0).selectExpr(
        "id AS doc_id", "'' AS cleaned_text", "'' AS words").schema)
    return back.drop("row_id").where("cleaned_text IS NOT NULL")


@query(
    "sink_themes",
    f"""SELECT cluster_id, name AS theme_name, description, sample_count, data_quality_issues,
      round(data_quality_percentage, 6) + 0.0 AS data_quality_percentage FROM ({THEME_SQL['theme_table']})""",
)
def _sink_themes(spark, sf_dir):
    folder = _folder(spark, "results")
    sinks.write_themes(theme_frame(spark, sf_dir), folder)
    back = scan.read_csv(spark, f"{folder}/theme_analysis.csv", spark.range(0).selectExpr(
        "0 AS cluster_id", "'' AS theme_name", "'' AS description", "0L AS sample_count", "0L AS data_quality_issues",
        "0D AS data_quality_percentage").schema)
    return back.drop("row_id").withColumn("data_quality_percentage", tidy(F.col("data_quality_percentage")))


@query("sink_report", f"SELECT value FROM ({THEME_SQL['theme_summary']})")
def _sink_report(spark, sf_dir):
    """The theme summary as a text file, line by line."""
    path = f"{_folder(spark, 'results')}/analysis_report.txt"
    sinks.write_lines(themes.theme_summary(theme_frame(spark, sf_dir)), path)
    return spark.read.text(path)


@query(
    "text_columns",
    """WITH p AS (SELECT avg(length(url)) AS url, avg(length(html)) AS html FROM (SELECT * FROM pages ORDER BY page_id LIMIT 10))
      SELECT 'documents' AS source, 'text' AS longest, 'text' AS first FROM p UNION ALL
      SELECT 'pages', CASE WHEN html >= url THEN 'html' ELSE 'url' END, CASE WHEN url > 20 THEN 'url' WHEN html > 20 THEN 'html' END FROM p""",
)
def _text_columns(spark, sf_dir):
    """The text column that both policies find: by its name, and by the lengths of its values."""
    out = []
    for name, key in (("documents", "doc_id"), ("pages", "page_id")):
        d = t.read(spark, sf_dir, name).withColumnRenamed(key, "row_id")
        out.append((name, *(detect_text_column(d, policy) for policy in ("longest", "first"))))
    return spark.createDataFrame(out, "source string, longest string, first string")


# ------------------------------------------------------------------ stored model

_UNIT = """(SELECT vec_id AS row_id, label, CASE WHEN label = 0 THEN -1 ELSE label END AS cluster_id,
  list_transform(v, lambda x: x / n) AS point FROM (SELECT *, sqrt(list_sum(list_transform(v,
  lambda x: x * x))) AS n FROM (SELECT *, embedding::DOUBLE[] AS v FROM embeddings)))"""
_OLD = f"(SELECT * FROM {_UNIT} WHERE label < 5)"
_STORED = f"""u AS MATERIALIZED (SELECT * FROM {_UNIT}),
  c AS MATERIALIZED ({q.means(f'(SELECT * FROM {_OLD} WHERE cluster_id <> -1)', 'cluster_id', 'point')}),
  rad AS (SELECT o.cluster_id, max({dist('o.point', 'c.v')}) AS radius FROM {_OLD} o
    JOIN c USING (cluster_id) GROUP BY o.cluster_id),
  near AS (SELECT row_id, arg_min(c.cluster_id, struct_pack(d := {dist('u.point', 'c.v')},
    i := c.cluster_id)) AS nearest, min({dist('u.point', 'c.v')}) AS d FROM u, c GROUP BY row_id),
  got AS (SELECT row_id, CASE WHEN d <= radius THEN nearest ELSE -1 END AS cluster_id
    FROM near JOIN rad ON rad.cluster_id = nearest)"""


def _vectors(spark, sf_dir):
    e = t.read(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label"
    )


def _stored_model(spark, sf_dir):
    """A bundle of the low labels; its reducer is the unit length, label 0 is noise."""
    old = _vectors(spark, sf_dir).where(F.col("label") < 5)
    unit = PipelineModel([Normalizer(inputCol="_v", outputCol="_pc", p=2.0)])
    label = F.when(F.col("label") == 0, F.lit(-1)).otherwise(F.col("label")).cast("int")
    points = reduce(old, unit).select("row_id", "point", label.alias("cluster_id"))
    folder = _folder(spark, "model")
    analysis.save_model(folder, unit, old, points, analysis.Options(dim=64))
    return folder


@query("stored_assign", f"WITH {_STORED} SELECT row_id, cluster_id FROM got")
def _stored_assign(spark, sf_dir):
    model = bundle.load(spark, _stored_model(spark, sf_dir))
    return analysis.predict_assign(_vectors(spark, sf_dir), model).select("row_id", "cluster_id")


@query("stored_drift", VECTOR_SQL["drift_decision"])
def _stored_drift(spark, sf_dir):
    model = bundle.load(spark, _stored_model(spark, sf_dir))
    new = _vectors(spark, sf_dir).where(F.col("label") >= 5)
    found = drift.drift_decision(drift.drift_score(new, model.training))
    return found.withColumn("drift_score", tidy(F.col("drift_score")))


@query(
    "stored_info",
    """SELECT count(*) AS n_training_samples, count(DISTINCT label) FILTER (label <> 0) AS n_clusters,
      (SELECT string_agg(label::VARCHAR, ',' ORDER BY label) FROM (SELECT DISTINCT label FROM embeddings
      WHERE label BETWEEN 1 AND 4)) AS cluster_ids, count(*) AS training_samples, '1.0' AS model_version
      FROM embeddings WHERE label < 5""",
)
def _stored_info(spark, sf_dir):
    return bundle.info(spark, _stored_model(spark, sf_dir)).select(
        "n_training_samples",
        "n_clusters",
        "cluster_ids",
        "model_metadata.training_samples",
        "model_metadata.model_version",
    )


@query(
    "export_info",
    """SELECT unnest(['model.training rows = ' || count(*), 'model.clusters = ' || count(DISTINCT label) FILTER (label <> 0),
      'model.cluster ids = ' || (SELECT string_agg(label::VARCHAR, ',' ORDER BY label) FROM (SELECT DISTINCT label
      FROM embeddings WHERE label BETWEEN 1 AND 4))]) AS value FROM embeddings WHERE label < 5""",
)
def _export_info(spark, sf_dir):
    """What a stored model holds, as the text file tells; lines with paths and times are left out."""
    path = f"{_folder(spark, 'info')}/model.txt"
    bundle.export_info(spark, _stored_model(spark, sf_dir), path)
    return spark.read.text(path).where(F.col("value").rlike("^model[.](training rows|clusters|cluster ids) = "))


# ------------------------------------------------------------------ streams


def _arriving(spark, vectors):
    """A stream over the vectors, landed as files."""
    folder = _folder(spark, "arriving")
    vectors.select("row_id", "embedding").write.parquet(folder)
    return spark.readStream.schema("row_id bigint, embedding array<double>").parquet(folder)


@query(
    "stream_ingest",
    f"""SELECT doc_id AS row_id, {q.clean('text')} AS text FROM documents
      WHERE text IS NOT NULL AND lower(text) NOT IN ('nan', 'none', '')""",
)
def _stream_ingest(spark, sf_dir):
    """Documents land as CSV files and are cleaned as they arrive; a second run finds none."""
    d = t.read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    base = _folder(spark, "landing")
    sinks.write_csv(d, f"{base}/in")
    for _ in range(2):
        stream = ingest.landed_stream(spark, f"{base}/in", d.schema)
        ingest.ingest(stream, "text", "doc_id", f"{base}/out", f"{base}/mark").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("row_id", "text")


@query("stream_drift", VECTOR_SQL["drift_decision"])
def _stream_drift(spark, sf_dir):
    model = _stored_model(spark, sf_dir)
    new = _arriving(spark, _vectors(spark, sf_dir).where(F.col("label") >= 5))
    log = _folder(spark, "drift")
    ingest.watch_drift(new, model, log, f"{log}-mark").awaitTermination()
    found = spark.read.parquet(log).drop("batch")
    return found.withColumn("drift_score", tidy(F.col("drift_score")))


@query("stream_assign", SQL["stored_assign"])
def _stream_assign(spark, sf_dir):
    model = _stored_model(spark, sf_dir)
    out = _folder(spark, "assigned")
    stream = _arriving(spark, _vectors(spark, sf_dir))
    ingest.assign_stream(stream, model, out, f"{out}-mark").awaitTermination()
    return spark.read.parquet(out).select("row_id", "cluster_id")


def _three_batches(spark, sf_dir):
    """Low labels, then twice the high ones, arrive at a model of the low labels, which follows drift
    above 0.1: (log folder, folder of assignments)."""
    v = _vectors(spark, sf_dir)
    base = _folder(spark, "recluster")
    options = analysis.Options(dim=DIM, epsilon=0.0)
    old = v.where(F.col("label") < 5).select("row_id", "embedding")
    unit = PipelineModel([Normalizer(inputCol="_v", outputCol="_pc", p=2.0)])
    label = F.when(F.col("label") == 0, F.lit(-1)).otherwise(F.col("label")).cast("int")
    points = reduce(v.where(F.col("label") < 5), unit).select("row_id", "point", label.alias("cluster_id"))
    analysis.save_model(f"{base}/models/version=1", unit, old, points, options)
    for part in (old, *[v.where(F.col("label") >= 5).select("row_id", "embedding")] * 2):
        # one file a batch
        part.coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema("row_id bigint, embedding array<double>").parquet(f"{base}/in")
        ingest.recluster_stream(stream, f"{base}/models", f"{base}/out", f"{base}/mark", options).awaitTermination()
    return f"{base}/models/log", f"{base}/out"


@query(
    "stream_recluster",
    f"""WITH lo AS ({q.means('(SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE label < 5)', None, 'v')}),
      hi AS ({q.means('(SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE label >= 5)', None, 'v')}),
      al AS ({q.means('(SELECT embedding::DOUBLE[] AS v FROM embeddings)', None, 'v')}),
      n AS (SELECT count(*) FILTER (label < 5) AS lo, count(*) FILTER (label >= 5) AS hi FROM embeddings),
      d AS (SELECT 1 - {q.cosine('hi.v', 'lo.v')} AS one, 1 - {q.cosine('hi.v', 'al.v')} AS two FROM lo, hi, al),
      s AS (SELECT one, CASE WHEN one > 0.1 THEN two ELSE one END AS next FROM d),
      l AS (SELECT 0 AS batch, lo AS rows, 0.0::DOUBLE AS drift FROM n UNION ALL SELECT 1, hi, one FROM n, s
        UNION ALL SELECT 2, hi, next FROM n, s)
      SELECT batch::BIGINT AS batch, rows, round(drift, 6) + 0.0 AS drift_score, drift > 0.1 AS retrained,
        1 + count(*) FILTER (drift > 0.1) OVER (ORDER BY batch) AS version, rows AS assigned FROM l""",
)
def _stream_recluster(spark, sf_dir):
    """What the log says of each batch, and the rows that its version assigned."""
    log, out = _three_batches(spark, sf_dir)
    done = spark.read.parquet(out).groupBy("batch", "version").agg(F.count(F.lit(1)).alias("assigned"))
    found = spark.read.parquet(log).drop("folder").join(done, ["batch", "version"])
    return found.select(
        F.col("batch").cast("bigint").alias("batch"), "rows", tidy(F.col("drift_score")).alias("drift_score"),
        "retrained", F.col("version").cast("bigint").alias("version"), "assigned",
    )
