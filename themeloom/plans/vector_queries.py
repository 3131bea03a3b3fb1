"""Registered queries over vectors, clusters, scores and drift."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from themeloom.functions import fixed, vector
from themeloom.operators import clusters, drift, embed, graph, neighbors, quality, rows, tuning
from themeloom.plans import sqltext as q
from themeloom.plans import tables as t
from themeloom.runtime import ensure_checkpoint_dir, tidy

RUN, SQL = {}, {}
DIM = 64


def query(name, sql=None):
    def keep(fn):
        RUN[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return keep


def _tidied(df, *names):
    return df.withColumns({n: tidy(F.col(n)) for n in names})


def _flat_vector(df, keys, column):
    """(keys, pos, value): a vector column as rows, rounded."""
    return df.select(*keys, F.posexplode(column).alias("pos", "value")).select(
        *keys, F.col("pos").cast("bigint").alias("pos"), tidy(F.col("value")).alias("value")
    )


def _flat_sql(source, keys, column):
    k = "".join(f"{x}, " for x in keys)
    return f"""SELECT {k}pos - 1 AS pos, round(x, 6) + 0.0 AS value FROM (SELECT {k}unnest({column})
      AS x, generate_subscripts({column}, 1) AS pos FROM {source})"""


E64 = "(SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
CENTERS = f"({q.means(f'(SELECT * FROM {t.POINTS} WHERE cluster_id <> -1)', 'cluster_id', 'point')})"
DIST = "sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"


def dist(a, b):
    return DIST.format(a=a, b=b)


# ------------------------------------------------------------------ vectors


@query(
    "cosine_pairs",
    f"""WITH m AS ({q.means(E64, 'label', 'v')})
      SELECT vec_id, round({q.cosine('e.v', 'm.v')}, 6) + 0.0 AS similarity
      FROM {E64} e JOIN m USING (label)""",
)
def _cosine_pairs(spark, sf_dir):
    e = t.read(spark, sf_dir, "embeddings")
    m = embed.mean_vector(e, "embedding", "label")
    return e.join(m, "label").select(
        "vec_id",
        tidy(vector.cosine(vector.as_double(F.col("embedding")), F.col("mean"))).alias("similarity"),
    )


@query(
    "euclidean",
    f"""WITH m AS ({q.means(E64, 'label', 'v')})
      SELECT vec_id, round({dist('e.v', 'm.v')}, 6) + 0.0 AS distance
      FROM {E64} e JOIN m USING (label)""",
)
def _euclidean(spark, sf_dir):
    e = t.read(spark, sf_dir, "embeddings")
    m = embed.mean_vector(e, "embedding", "label")
    return e.join(m, "label").select(
        "vec_id",
        tidy(vector.euclidean(vector.as_double(F.col("embedding")), F.col("mean"))).alias("distance"),
    )


@query("mean_vector", _flat_sql(f"({q.means(E64, None, 'v')})", [], "v"))
def _mean_vector(spark, sf_dir):
    return _flat_vector(embed.mean_vector(t.read(spark, sf_dir, "embeddings")), [], "mean")


@query(
    "top_k",
    f"""WITH m AS ({q.means(E64, None, 'v')})
      SELECT vec_id AS index, round({q.cosine('e.v', 'm.v')}, 6) + 0.0 AS similarity
      FROM {E64} e, m ORDER BY {q.cosine('e.v', 'm.v')} DESC, vec_id LIMIT 5""",
)
def _top_k(spark, sf_dir):
    e = t.read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "row_id")
    found = neighbors.most_similar(e, embed.mean_vector(e).scalar(), 5)
    return _tidied(found, "similarity")


@query(
    "top_k_all",
    f"""WITH m AS ({q.means(E64, 'label', 'v')}),
      s AS (SELECT m.label AS row_id, vec_id AS neighbor_id, {q.cosine('e.v', 'm.v')} AS s
            FROM {E64} e, m),
      r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY s DESC, neighbor_id) AS rank
            FROM s)
      SELECT row_id::BIGINT AS row_id, neighbor_id, rank, round(s, 6) + 0.0 AS similarity
      FROM r WHERE rank <= 5""",
)
def _top_k_all(spark, sf_dir):
    e = t.read(spark, sf_dir, "embeddings")
    asked = embed.mean_vector(e, "embedding", "label").select(
        F.col("label").cast("bigint").alias("row_id"), F.col("mean").alias("point")
    )
    held = e.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("point"))
    found = neighbors.cosine_top_k(asked, held, DIM, 5)
    return _tidied(found.withColumn("rank", F.col("rank").cast("bigint")), "similarity")


@query(
    "embed_meta",
    """SELECT e.vec_id AS index, d.text, l.quality::VARCHAR AS quality, len(e.embedding) AS dim
      FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id
      JOIN labels l ON l.doc_id = e.vec_id""",
)
def _embed_meta(spark, sf_dir):
    e = t.read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "row_id")
    embedded = e.join(t.texts(spark, sf_dir).select("row_id", "text"), "row_id")
    meta = t.read(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("row_id"),
        F.create_map(F.lit("quality"), F.col("quality").cast("string")).alias("metadata"),
    )
    return embed.with_metadata(embedded, meta).select(
        "index",
        "text",
        F.col("metadata")["quality"].alias("quality"),
        F.size("embedding").cast("bigint").alias("dim"),
    )


@query(
    "knn_graph",
    f"""WITH p AS (SELECT * FROM {t.POINTS}),
      r AS (SELECT a.row_id, b.row_id AS neighbor_id, {dist('a.point', 'b.point')} AS d FROM p a, p b
            WHERE a.row_id <> b.row_id),
      w AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d, neighbor_id) AS rank FROM r)
      SELECT row_id, neighbor_id, rank, round(d, 6) + 0.0 AS distance FROM w WHERE rank <= 5""",
)
def _knn_graph(spark, sf_dir):
    found = neighbors.knn_graph(t.points(spark, sf_dir), 5)
    return _tidied(found.withColumn("rank", F.col("rank").cast("bigint")), "distance")


@query("ann_top_k")
def _ann(spark, sf_dir):
    e = t.read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "row_id")
    model = neighbors.fit_cells(e, 8)
    mean = embed.mean_vector(e).first()["mean"]
    index = neighbors.place_in_cells(e, model)
    return neighbors.search_index(index, model, list(mean), 5, probes=4)


@query("ann_all_cells", SQL["top_k"])
def _ann_all(spark, sf_dir):
    """Every cell probed: the index must answer as the exact search does."""
    e = t.read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "row_id")
    model = neighbors.fit_cells(e, 8)
    mean = embed.mean_vector(e).first()["mean"]
    found = neighbors.search_index(neighbors.place_in_cells(e, model), model, list(mean), 5, probes=8)
    return _tidied(found, "similarity")


def _written_index(spark, sf_dir, cells=8):
    e = t.read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "row_id")
    model = neighbors.fit_cells(e, cells)
    path = f"{ensure_checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    neighbors.write_index(e, model, path)
    asked = e.select("row_id", F.col("embedding").cast("array<double>").alias("point"))
    return spark.read.parquet(f"{path}/vectors"), neighbors.cell_centers(spark, model), asked


@query(
    "ann_batch",
    f"""WITH r AS (SELECT a.vec_id AS row_id, b.vec_id AS neighbor_id, {q.cosine('a.v', 'b.v')} AS s FROM {E64} a, {E64} b),
      w AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY s DESC, neighbor_id) AS rank FROM r)
      SELECT row_id, neighbor_id, rank, round(s, 6) + 0.0 AS similarity FROM w WHERE rank <= 5""",
)
def _ann_batch(spark, sf_dir):
    """Every vector as a query on a written index, all cells probed: the exact answer."""
    found = neighbors.search_many(*_written_index(spark, sf_dir), DIM, 5, probes=8)
    return _tidied(found.withColumn("rank", F.col("rank").cast("bigint")), "similarity")


@query("ann_recall")
def _ann_recall(spark, sf_dir):
    """Share of the five nearest that six of eight cells hold, every vector as a query."""
    index, centers, asked = _written_index(spark, sf_dir)
    found = neighbors.search_many(index, centers, asked, DIM, 5, probes=6)
    return neighbors.recall(found, neighbors.cosine_top_k(asked, asked, DIM, 5))


@query("knn_graph_cells", SQL["knn_graph"])
def _knn_cells(spark, sf_dir):
    """Blocks of near points, which larger tables take."""
    found = neighbors.knn_graph(t.points(spark, sf_dir), 5, small_bytes=0, cell_rows=64)
    return _tidied(found.withColumn("rank", F.col("rank").cast("bigint")), "distance")


_NEAREST = f"""p AS MATERIALIZED (SELECT * FROM {t.POINTS}),
  r AS MATERIALIZED (SELECT a.row_id AS a, arg_min(b.row_id, struct_pack(d := {dist('a.point', 'b.point')},
    i := b.row_id)) AS b FROM p a, p b WHERE a.row_id <> b.row_id GROUP BY a.row_id)"""
_COMPONENTS = f"""WITH RECURSIVE {_NEAREST},
  link AS MATERIALIZED (SELECT a, b FROM r UNION SELECT b, a FROM r),
  walk AS (SELECT a AS node, a AS comp FROM link UNION
    SELECT link.b, walk.comp FROM walk JOIN link ON link.a = walk.node)
  SELECT node, min(comp) AS comp FROM walk GROUP BY node"""


def _nearest_pairs(spark, sf_dir):
    found = neighbors.knn_graph(t.points(spark, sf_dir), 1, small_bytes=0, cell_rows=64)
    return found.select(F.col("row_id").alias("a"), F.col("neighbor_id").alias("b"))


@query("components", _COMPONENTS)
def _components(spark, sf_dir):
    """Groups of vectors that nearest-neighbour links hold together."""
    return graph.connected_components(_nearest_pairs(spark, sf_dir))


@query("components_stars", _COMPONENTS)
def _components_stars(spark, sf_dir):
    """The same with stars of few edges, so that the contraction takes all rounds."""
    return graph.connected_components(_nearest_pairs(spark, sf_dir), task_rows=4)


# ------------------------------------------------------------------ clusters


@query(
    "cluster_result",
    f"""SELECT row_id, cluster_id, num_clusters, num_noise_points, total_points FROM {t.POINTS},
      (SELECT count(DISTINCT CASE WHEN cluster_id <> -1 THEN cluster_id END) AS num_clusters,
      count(*) FILTER (cluster_id = -1) AS num_noise_points, count(*) AS total_points
      FROM {t.POINTS})""",
)
def _cluster_result(spark, sf_dir):
    p = t.points(spark, sf_dir)
    return rows.cluster_result(p, clusters.cluster_counts(p)).select(
        "row_id", "cluster_id", "statistics.*"
    )


@query("centroids", _flat_sql(CENTERS, ["cluster_id"], "v"))
def _centroids(spark, sf_dir):
    return _flat_vector(clusters.centroids(t.points(spark, sf_dir)), ["cluster_id"], "centroid")


@query(
    "cluster_sizes",
    f"SELECT cluster_id, count(*) AS size FROM {t.POINTS} WHERE cluster_id <> -1 GROUP BY cluster_id",
)
def _sizes(spark, sf_dir):
    return clusters.cluster_sizes(t.points(spark, sf_dir))


_COUNTS = f"""SELECT count(DISTINCT CASE WHEN cluster_id <> -1 THEN cluster_id END) AS num_clusters,
  count(*) FILTER (cluster_id = -1) AS num_noise_points, count(*) AS total_points FROM {t.POINTS}"""

def _silhouette_sql(source, d=dist("a.point", "b.point")):
    return f"""
  m AS (SELECT * FROM {source} WHERE cluster_id <> -1),
  pair AS (SELECT a.row_id, a.cluster_id AS mine, b.cluster_id AS other, sum({d}) AS total,
           count(*) AS n FROM m a, m b GROUP BY ALL),
  ab AS (SELECT row_id, max(CASE WHEN mine = other AND n > 1 THEN total / (n - 1) END) AS a,
         min(CASE WHEN mine <> other THEN total / n END) AS b FROM pair GROUP BY row_id),
  sil AS (SELECT coalesce(avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0.0
          ELSE (b - a) / greatest(a, b) END), 0.0) AS s FROM ab)"""


_SIL = _silhouette_sql(t.POINTS)
_LABEL = f"""CASE WHEN num_clusters = 0 THEN '{fixed.Q_NONE}'
  WHEN num_noise_points / total_points > 0.5 THEN '{fixed.Q_NOISE}'
  WHEN s < 0.1 THEN '{fixed.Q_LOW}' WHEN s < 0.3 THEN '{fixed.Q_MID}' ELSE '{fixed.Q_HIGH}' END"""


@query("silhouette", f"WITH {_SIL} SELECT round(s, 6) + 0.0 AS silhouette_score FROM sil")
def _silhouette(spark, sf_dir):
    return _tidied(quality.silhouette(t.points(spark, sf_dir)), "silhouette_score")


@query(
    "silhouette_squared",
    f"WITH {_silhouette_sql(t.POINTS, 'pow(' + dist('a.point', 'b.point') + ', 2)')} "
    "SELECT round(s, 6) + 0.0 AS silhouette_score FROM sil",
)
def _silhouette_squared(spark, sf_dir):
    return _tidied(quality.silhouette_squared(t.points(spark, sf_dir)), "silhouette_score")


@query(
    "cluster_stats",
    f"""WITH {_SIL}, c AS ({_COUNTS})
      SELECT c.*, round(s, 6) + 0.0 AS silhouette_score, 'euclidean' AS silhouette_metric,
      {_LABEL} AS clustering_quality FROM c, sil""",
)
def _stats(spark, sf_dir):
    return _tidied(quality.clustering_statistics(t.points(spark, sf_dir)), "silhouette_score")


@query(
    "quality_label",
    f"""SELECT cluster_id, {_LABEL} AS label FROM (
      SELECT cluster_id, cluster_id AS num_clusters, count(*) AS total_points,
      count(*) FILTER (list_sum(point) < 0) AS num_noise_points,
      0.35 - count(*) / 400 AS s FROM (SELECT label AS cluster_id, embedding::DOUBLE[] AS point
      FROM embeddings) GROUP BY cluster_id)""",
)
def _quality_label(spark, sf_dir):
    e = t.read(spark, sf_dir, "embeddings").select(
        F.col("label").alias("cluster_id"),
        F.aggregate(
            F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x
        ).alias("s"),
    )
    per = e.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("s") < 0).alias("noise")
    )
    return per.select(
        "cluster_id",
        quality.quality_label(
            F.col("cluster_id"), F.col("noise"), F.col("n"), 0.35 - F.col("n") / 400
        ).alias("label"),
    )


@query(
    "cluster_samples",
    f"""SELECT cluster_id, string_agg(text, '|' ORDER BY row_id) AS samples FROM (
      SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY row_id) AS rn FROM {t.THEMED})
      WHERE rn <= 10 GROUP BY cluster_id""",
)
def _samples(spark, sf_dir):
    s = clusters.cluster_samples(t.themed_texts(spark, sf_dir))
    return s.select("cluster_id", F.concat_ws("|", "samples").alias("samples"))


@query(
    "cluster_summary",
    f"""WITH c AS {CENTERS},
      p AS (SELECT p.*, d.text FROM {t.POINTS} p JOIN documents d ON d.doc_id = p.row_id),
      s AS (SELECT cluster_id, string_agg(text, '|' ORDER BY row_id) AS sample_texts FROM (
        SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY row_id) AS rn FROM p)
        WHERE rn <= 5 GROUP BY cluster_id)
      SELECT p.cluster_id, count(*) AS size, round(avg({dist('p.point', 'c.v')}), 6) + 0.0
      AS avg_distance_to_centroid, any_value(sample_texts) AS sample_texts
      FROM {t.POINTS} p JOIN c USING (cluster_id) JOIN s USING (cluster_id) GROUP BY p.cluster_id""",
)
def _summary(spark, sf_dir):
    p = t.points(spark, sf_dir)
    samples = clusters.cluster_samples(p, t.texts(spark, sf_dir))
    s = clusters.cluster_summary(p, clusters.centroids(p), samples)
    return _tidied(s, "avg_distance_to_centroid").select(
        "cluster_id",
        "size",
        "avg_distance_to_centroid",
        F.concat_ws("|", "sample_texts").alias("sample_texts"),
    )


@query(
    "similar_clusters",
    f"""WITH c AS {CENTERS}, s AS (SELECT b.cluster_id, {q.cosine('a.v', 'b.v')} AS s
      FROM c a, c b WHERE a.cluster_id = 1 AND b.cluster_id <> 1)
      SELECT cluster_id, round(s, 6) + 0.0 AS similarity FROM s WHERE s >= -0.1""",
)
def _similar(spark, sf_dir):
    found = clusters.similar_clusters(clusters.centroids(t.points(spark, sf_dir)), 1, -0.1)
    return _tidied(found, "similarity")


_NEAR = f"""c AS {CENTERS},
  near AS (SELECT row_id, any_value(p.cluster_id) AS mine,
    arg_min(c.cluster_id, struct_pack(d := {dist('p.point', 'c.v')}, i := c.cluster_id)) AS nearest,
    min({dist('p.point', 'c.v')}) AS distance FROM {t.POINTS} p, c GROUP BY row_id)"""
_ASSIGN = f"""{_NEAR},
  rad AS (SELECT p.cluster_id, max({dist('p.point', 'c.v')}) AS radius FROM {t.POINTS} p
    JOIN c USING (cluster_id) GROUP BY p.cluster_id),
  got AS (SELECT row_id, CASE WHEN distance <= radius THEN nearest ELSE -1 END AS cluster_id
    FROM near JOIN rad ON rad.cluster_id = nearest)"""


@query(
    "nearest_cluster",
    f"""WITH {_NEAR} SELECT row_id, nearest AS nearest_cluster, round(distance, 6) + 0.0 AS distance
      FROM near""",
)
def _nearest(spark, sf_dir):
    p = t.points(spark, sf_dir)
    found = clusters.nearest_cluster(p, clusters.centroids(p))
    return _tidied(found.select("row_id", "nearest_cluster", "distance"), "distance")


@query("predict_assign", f"WITH {_ASSIGN} SELECT row_id, cluster_id FROM got")
def _predict(spark, sf_dir):
    p = t.points(spark, sf_dir)
    radii = clusters.cluster_radii(p, clusters.centroids(p))
    return clusters.predict_assign(p, radii).select("row_id", "cluster_id")


@query(
    "predict_stats",
    f"""WITH {_ASSIGN} SELECT *, CASE WHEN num_noise_points / total_points < 0.3 THEN 'Good'
      ELSE 'Fair' END AS prediction_quality FROM ({_COUNTS.replace(t.POINTS, 'got')})""",
)
def _predict_stats(spark, sf_dir):
    p = t.points(spark, sf_dir)
    radii = clusters.cluster_radii(p, clusters.centroids(p))
    return clusters.prediction_statistics(clusters.predict_assign(p, radii))


@query(
    "model_stats",
    f"""SELECT (SELECT count(*) FROM {t.POINTS}) AS n_training_samples, count(*) AS n_clusters,
      string_agg(cluster_id::VARCHAR, ',' ORDER BY cluster_id) AS cluster_ids FROM {CENTERS}""",
)
def _model_stats(spark, sf_dir):
    p = t.points(spark, sf_dir)
    return clusters.model_statistics(p, clusters.centroids(p))


@query(
    "cluster_report",
    f"""WITH {_SIL}, c AS ({_COUNTS}), k AS (SELECT c.*, s, {_LABEL} AS label FROM c, sil)
      SELECT 0 AS part, 0::BIGINT AS line, 'clustering.points = ' || total_points AS value FROM k UNION ALL
      SELECT 0, 1, 'clustering.clusters = ' || num_clusters FROM k UNION ALL
      SELECT 0, 2, 'clustering.noise = ' || num_noise_points FROM k UNION ALL
      SELECT 0, 3, printf('clustering.noise share = %.1f%%', num_noise_points * 100.0 / total_points)
        FROM k UNION ALL
      SELECT 0, 4, printf('clustering.silhouette = %.3f', s) FROM k UNION ALL
      SELECT 0, 5, 'clustering.quality = ' || label FROM k UNION ALL
      SELECT 1, cluster_id, printf('cluster %d: points %d, share %.1f%%', cluster_id, count(*),
        count(*) * 100.0 / (SELECT count(*) FROM {t.POINTS})) FROM {t.POINTS}
        WHERE cluster_id <> -1 GROUP BY cluster_id""",
)
def _report(spark, sf_dir):
    p = t.points(spark, sf_dir)
    return clusters.report_lines(quality.clustering_statistics(p), clusters.cluster_sizes(p))


# ------------------------------------------------------------------ scores

_CH = f"""
  mm AS (SELECT * FROM {t.POINTS} WHERE cluster_id <> -1),
  cc AS (SELECT c.cluster_id, c.v, z.n FROM {CENTERS} c JOIN (SELECT cluster_id, count(*) AS n FROM mm
        GROUP BY cluster_id) z USING (cluster_id)),
  gg AS ({q.means('mm', None, 'point')}),
  ch AS (SELECT ((SELECT sum(n * pow({dist('cc.v', 'gg.v')}, 2)) FROM cc, gg)
        / ((SELECT count(*) FROM cc) - 1))
        / ((SELECT sum(pow({dist('mm.point', 'cc.v')}, 2)) FROM mm JOIN cc USING (cluster_id))
        / ((SELECT count(*) FROM mm) - (SELECT count(*) FROM cc))) AS ch)"""
_BAL = f"""bal AS (SELECT 1 - stddev_pop(n) / avg(n) AS b FROM (SELECT cluster_id, count(*) AS n
  FROM {t.POINTS} WHERE cluster_id <> -1 GROUP BY cluster_id))"""
_CNT = f"""cs AS (SELECT 1 - num_noise_points / total_points AS p, 1 / (1 + abs(num_clusters - 10)) AS k
  FROM ({_COUNTS}))"""


@query("calinski_harabasz", f"WITH {_CH} SELECT round(ch, 6) + 0.0 AS calinski_harabasz FROM ch")
def _calinski(spark, sf_dir):
    return _tidied(quality.calinski_harabasz(t.points(spark, sf_dir)), "calinski_harabasz")


@query("balance", f"WITH {_BAL} SELECT round(b, 6) + 0.0 AS cluster_balance FROM bal")
def _balance(spark, sf_dir):
    return _tidied(quality.balance(t.points(spark, sf_dir)), "cluster_balance")


@query(
    "count_score",
    f"""WITH {_CNT} SELECT round(p, 6) + 0.0 AS noise_penalty, round(k, 6) + 0.0
      AS cluster_count_score FROM cs""",
)
def _count_score(spark, sf_dir):
    s = quality.count_score(t.points(spark, sf_dir))
    return _tidied(s, "noise_penalty", "cluster_count_score")


@query(
    "composite_score",
    f"""WITH {_SIL}, {_CH}, {_BAL}, {_CNT}
      SELECT round(s, 6) + 0.0 AS silhouette, round(ch, 6) + 0.0 AS calinski_harabasz,
      round(b, 6) + 0.0 AS cluster_balance, round(p, 6) + 0.0 AS noise_penalty,
      round(k, 6) + 0.0 AS cluster_count_score,
      round(0.4 * s + 0.2 * ch / 1000 + 0.2 * b + 0.1 * p + 0.1 * k, 6) + 0.0 AS score
      FROM sil, ch, bal, cs""",
)
def _composite(spark, sf_dir):
    s = quality.composite_score(t.points(spark, sf_dir))
    return _tidied(s, *s.columns)


def _order_trials(spark, sf_dir):
    """Orders as trials: the priority is the parameter, the scaled price the score."""
    return t.read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("trial_id"),
        F.col("o_orderpriority").alias("priority"),
        (F.col("o_totalprice") / 1000000).alias("score"),
    )


_TRIALS = """(SELECT o_orderkey AS trial_id, o_orderpriority AS priority,
  o_totalprice / 1000000 AS score FROM orders)"""


@query(
    "best_trial",
    f"""SELECT trial_id, priority, round(score, 6) + 0.0 AS score FROM {_TRIALS}
      ORDER BY {_TRIALS[:0]}score DESC, trial_id LIMIT 1""",
)
def _best(spark, sf_dir):
    return _tidied(tuning.best_trial(_order_trials(spark, sf_dir)), "score")


@query(
    "trial_stats",
    f"""SELECT count(*) AS n_trials, round(avg(score), 6) + 0.0 AS mean_score,
      round(stddev_samp(score), 6) + 0.0 AS std_score, round(min(score), 6) + 0.0 AS min_score,
      round(max(score), 6) + 0.0 AS max_score FROM {_TRIALS}""",
)
def _trial_stats(spark, sf_dir):
    s = tuning.trial_statistics(_order_trials(spark, sf_dir))
    return _tidied(s, "mean_score", "std_score", "min_score", "max_score")


@query(
    "trials_report",
    f"""WITH s AS (SELECT count(*) AS n, avg(score) AS a, stddev_samp(score) AS d, min(score) AS lo,
        max(score) AS hi FROM {_TRIALS}),
      b AS (SELECT * FROM {_TRIALS} ORDER BY score DESC, trial_id LIMIT 1)
      SELECT 0 AS part, unnest(range(5)) AS line, 'trials.' || unnest(['count = ' || n,
        printf('mean = %.4f', a::DOUBLE), printf('std = %.4f', d::DOUBLE), printf('min = %.4f', lo::DOUBLE),
        printf('max = %.4f', hi::DOUBLE)]) AS value FROM s UNION ALL
      SELECT 1, unnest(range(2)), 'best.' || unnest([printf('score = %.4f', score::DOUBLE),
        'priority = ' || priority]) FROM b""",
)
def _trials_report(spark, sf_dir):
    return tuning.optimization_report(_order_trials(spark, sf_dir))


# ------------------------------------------------------------------ drift

OLD = "(SELECT * FROM embeddings WHERE label < 5)"
NEW = "(SELECT * FROM embeddings WHERE label >= 5)"
_DRIFT = f"""a AS ({q.means('(SELECT embedding::DOUBLE[] AS v FROM ' + NEW + ')', None, 'v')}),
  b AS ({q.means('(SELECT embedding::DOUBLE[] AS v FROM ' + OLD + ')', None, 'v')}),
  dr AS (SELECT 1 - {q.cosine('a.v', 'b.v')} AS d FROM a, b)"""


def _old_new(spark, sf_dir):
    """Low labels as the training vectors, high labels as the new ones."""
    e = t.read(spark, sf_dir, "embeddings")
    return e.where(F.col("label") < 5), e.where(F.col("label") >= 5)


@query("drift", f"WITH {_DRIFT} SELECT round(d, 6) + 0.0 AS drift_score FROM dr")
def _drift(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    return _tidied(drift.drift_score(new, old), "drift_score")


@query(
    "drift_decision",
    f"""WITH {_DRIFT} SELECT round(d, 6) + 0.0 AS drift_score, 0.1::DOUBLE AS threshold,
      d > 0.1 AS needs_retraining, CASE WHEN d > 0.2 THEN 'High' WHEN d > 0.1 THEN 'Medium'
      ELSE 'Low' END AS drift_severity FROM dr""",
)
def _drift_decision(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    return _tidied(drift.drift_decision(drift.drift_score(new, old)), "drift_score")


@query(
    "update_union",
    f"""WITH {_DRIFT} SELECT vec_id, label FROM {OLD} UNION ALL
      SELECT vec_id, label FROM {NEW} WHERE (SELECT d FROM dr) > 0.1""",
)
def _update(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    return drift.update_training(new, old).select("vec_id", "label")
