"""Registered queries over density clustering, reduction, tuning and the full analysis."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from themeloom.functions import vector
from themeloom.operators import density, merge_tree, neighbors, quality, tuning
from themeloom.operators.reduce import fit_reducer, reduce
from themeloom.plans import analysis
from themeloom.plans import tables as t
from themeloom.plans.vector_queries import dist
from themeloom.runtime import cut, ensure_checkpoint_dir, tidy

RUN, SQL = {}, {}


def query(name, sql=None):
    def keep(fn):
        RUN[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return keep


#: Distances in two coordinates and in all.
EPS, EPS_ALL = 0.015, 1.14


def _eps_sql(source, eps):
    return f"""WITH RECURSIVE p AS MATERIALIZED (SELECT * FROM {source}),
      near AS MATERIALIZED (SELECT a.row_id AS a, b.row_id AS b FROM p a, p b
        WHERE {dist('a.point', 'b.point')} <= {eps}),
      core AS MATERIALIZED (SELECT a FROM near GROUP BY a HAVING count(*) >= 3),
      link AS MATERIALIZED (SELECT near.a, near.b FROM near JOIN core x ON x.a = near.a
        JOIN core y ON y.a = near.b),
      walk AS (SELECT a AS node, a AS comp FROM core UNION
        SELECT link.b, walk.comp FROM walk JOIN link ON link.a = walk.node),
      lab AS (SELECT node, min(comp) AS comp FROM walk GROUP BY node),
      big AS (SELECT comp FROM lab GROUP BY comp HAVING count(*) >= 5)
      SELECT p.row_id, coalesce(big.comp, -1) AS cluster_id FROM p
      LEFT JOIN lab ON lab.node = p.row_id LEFT JOIN big ON big.comp = lab.comp"""


@query("eps_components", _eps_sql(t.POINTS, EPS_ALL))
def _eps(spark, sf_dir):
    """All coordinates: blocks of near points meet."""
    return density.eps_components(t.points(spark, sf_dir), EPS_ALL, 3, 5, block_rows=64)


@query("eps_components_flat", _eps_sql(t.FLAT, EPS))
def _eps_flat(spark, sf_dir):
    """Two coordinates: the grid."""
    return density.eps_components(t.flat_points(spark, sf_dir), EPS, 3, 5)


_REACH = f"""p AS MATERIALIZED (SELECT row_number() OVER (ORDER BY row_id) AS i, row_id, point
    FROM source_points),
  d AS MATERIALIZED (SELECT a.i, b.i AS j, {dist('a.point', 'b.point')} AS d FROM p a, p b),
  core AS MATERIALIZED (SELECT i, list_sort(list(d))[3] AS core FROM d WHERE i <> j GROUP BY i)"""
_REACH_FLAT = _REACH.replace("source_points", t.FLAT)
_REACH = _REACH.replace("source_points", t.POINTS)


def _tree(spark, sf_dir, **options):
    return density.spanning_tree(t.points(spark, sf_dir), 3, **options)


@query(
    "core_distances",
    f"WITH {_REACH} SELECT row_id, round(core, 6) + 0.0 AS core FROM p JOIN core USING (i)",
)
def _core(spark, sf_dir):
    """Distance to the third neighbour of every vector, on all coordinates: copies have a row each, and a
    row without a vector has no distance."""
    points = t.points(spark, sf_dir)
    folded = cut(density.fold_copies(points))
    held = folded.select(F.col("pid").alias("row_id"), "point")
    near = neighbors.knn_join(held, held, 3, True, small_bytes=0, cell_rows=64)
    nodes = density.core_distances(folded, near, 3)
    every = points.select("row_id", vector.as_double(F.col("point")).alias("point"))
    return every.join(nodes.select("point", "core"), "point", "left").select("row_id", tidy(F.col("core")).alias("core"))


def _tree_sql(reach, rounds=11, jumps=11):
    """Boruvka rounds written out: each takes every group's lightest edge and renames the groups
    by following these edges to the smaller end of the pair that chose each other."""
    parts = [
        reach,
        """w AS MATERIALIZED (SELECT d.i, d.j, greatest(d.d, x.core, y.core) AS w FROM d
          JOIN core x ON x.i = d.i JOIN core y ON y.i = d.j WHERE d.i <> d.j)""",
        "l0 AS MATERIALIZED (SELECT i, i AS c FROM p)",
    ]
    for r in range(rounds):
        parts += [
            f"""n{r} AS MATERIALIZED (SELECT a.c, min(struct_pack(w := w.w, lo := least(w.i, w.j),
              hi := greatest(w.i, w.j), o := b.c)) AS e FROM w JOIN l{r} a ON a.i = w.i
              JOIN l{r} b ON b.i = w.j WHERE a.c <> b.c GROUP BY a.c)""",
            f"""j{r}_0 AS MATERIALIZED (SELECT x.c, CASE WHEN x.c < x.e.o AND y.e.o = x.c THEN x.c
              ELSE x.e.o END AS t FROM n{r} x JOIN n{r} y ON y.c = x.e.o)""",
        ]
        for k in range(jumps):
            parts.append(
                f"""j{r}_{k + 1} AS MATERIALIZED (SELECT x.c, y.t FROM j{r}_{k} x
                  JOIN j{r}_{k} y ON y.c = x.t)"""
            )
        parts.append(
            f"""l{r + 1} AS MATERIALIZED (SELECT l.i, coalesce(j.t, l.c) AS c FROM l{r} l
              LEFT JOIN j{r}_{jumps} j ON j.c = l.c)"""
        )
    taken = " UNION ".join(f"SELECT e.w, e.lo, e.hi FROM n{r}" for r in range(rounds))
    return ", ".join([*parts, f"e AS MATERIALIZED ({taken})"])


_EDGES = _tree_sql(_REACH)
_TREE = f"WITH {_EDGES} SELECT round(w, 6) + 0.0 AS weight, count(*) AS edges FROM e GROUP BY ALL"


def _clusters_sql(settings, edges=_EDGES):
    """Labels of settings (trial, min_cluster_size, epsilon), from the definition: every state of the
    merging is a list of component numbers, and a cluster is a side of a merge whose sides both have
    the size."""
    table = ", ".join(f"({i}, {m}, {e})" for i, m, e in settings)
    return f"""WITH RECURSIVE {edges},
      t AS MATERIALIZED (SELECT * FROM (VALUES {table}) v(trial, m, epsilon)),
      s AS MATERIALIZED (SELECT DISTINCT m FROM t),
      o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY w, lo, hi) AS r FROM e),
      step AS (SELECT 0::BIGINT AS r, list(i ORDER BY i) AS c FROM p UNION ALL
        SELECT o.r, list_transform(c, lambda x: CASE WHEN x = greatest(c[lo], c[hi])
          THEN least(c[lo], c[hi]) ELSE x END) FROM step JOIN o ON o.r = step.r + 1),
      pos AS MATERIALIZED (SELECT r, unnest(c) AS c, generate_subscripts(c, 1) AS i FROM step),
      n AS MATERIALIZED (SELECT r, c, count(*) AS n FROM pos GROUP BY ALL),
      two AS MATERIALIZED (SELECT o.r, o.w, x.c AS a, y.c AS b, nx.n AS na, ny.n AS nb FROM o
        JOIN pos x ON x.r = o.r - 1 AND x.i = o.lo JOIN pos y ON y.r = o.r - 1 AND y.i = o.hi
        JOIN n nx ON nx.r = x.r AND nx.c = x.c JOIN n ny ON ny.r = y.r AND ny.c = y.c),
      k AS MATERIALIZED (SELECT m, r, w, c, size, row_number() OVER (PARTITION BY m ORDER BY r, c) AS k FROM (
        SELECT m, r, w, a AS c, na AS size FROM two, s WHERE na >= m AND nb >= m UNION ALL
        SELECT m, r, w, b, nb FROM two, s WHERE na >= m AND nb >= m)),
      mem AS MATERIALIZED (SELECT k.m, k.k, pos.i FROM k JOIN pos ON pos.r = k.r - 1 AND pos.c = k.c),
      enter AS MATERIALIZED (SELECT s.m, pos.i, min(pos.r) AS r FROM pos JOIN n ON n.r = pos.r AND n.c = pos.c
        JOIN s ON n.n >= s.m GROUP BY ALL),
      own AS MATERIALIZED (SELECT m, i, min(k) AS k FROM mem GROUP BY ALL),
      up AS MATERIALIZED (SELECT a.m, a.k, min(b.k) AS up FROM (SELECT m, k, min(i) AS i FROM mem GROUP BY ALL) a
        JOIN mem b ON b.m = a.m AND b.i = a.i AND b.k > a.k GROUP BY ALL),
      anc AS (SELECT m, k, k AS a FROM k UNION ALL SELECT anc.m, anc.k, up.up FROM anc JOIN up ON up.m = anc.m AND up.k = anc.a),
      gain AS MATERIALIZED (
        SELECT m, k, sum(x) AS x FROM (
          SELECT own.m, own.k, 1 / greatest(o.w, 1e-12) AS x FROM own JOIN enter USING (m, i) JOIN o USING (r) UNION ALL
          SELECT up.m, up.up, k.size / greatest(k.w, 1e-12) FROM up JOIN k ON k.m = up.m AND k.k = up.k) GROUP BY ALL),
      st AS MATERIALIZED (SELECT k.m, k.k, k.w, gain.x - k.size / greatest(k.w, 1e-12) AS s,
        (SELECT list(up.k) FROM up WHERE up.m = k.m AND up.up = k.k) AS kids FROM k JOIN gain USING (m, k)),
      val AS (SELECT m, 0::BIGINT AS k, []::DOUBLE[] AS v, true AS good FROM s UNION ALL
        SELECT st.m, st.k, list_append(v, greatest(st.s, coalesce(list_sum(list_transform(kids, lambda j: v[j])), 0))),
          st.s >= coalesce(list_sum(list_transform(kids, lambda j: v[j])), 0) * (1 - 1e-9)
        FROM val JOIN st ON st.m = val.m AND st.k = val.k + 1),
      best AS MATERIALIZED (SELECT anc.m, anc.k, max(val.k) AS top FROM anc JOIN val ON val.m = anc.m AND val.k = anc.a
        WHERE good GROUP BY ALL),
      pick AS MATERIALIZED (SELECT DISTINCT t.trial, t.m, CASE WHEN k.w < t.epsilon THEN (
          SELECT min(anc.a) FROM anc JOIN k y ON y.m = anc.m AND y.k = anc.a LEFT JOIN up ON up.m = y.m AND up.k = y.k
          WHERE anc.m = best.m AND anc.k = best.top AND (y.w > t.epsilon OR up.up IS NULL)) ELSE best.top END AS k
        FROM best JOIN t USING (m) JOIN k ON k.m = best.m AND k.k = best.top),
      put AS (SELECT pick.trial, mem.i, max(pick.k) AS k FROM pick JOIN mem ON mem.m = pick.m AND mem.k = pick.k GROUP BY ALL),
      name AS (SELECT trial, k, min(p.row_id) AS cluster_id FROM put JOIN p USING (i) GROUP BY ALL)
      SELECT t.trial::BIGINT AS trial, p.row_id, coalesce(name.cluster_id, -1) AS cluster_id FROM t CROSS JOIN p
      LEFT JOIN put ON put.trial = t.trial AND put.i = p.i LEFT JOIN name ON name.trial = put.trial AND name.k = put.k"""


@query("spanning_tree", _TREE)
def _spanning_tree(spark, sf_dir):
    """Edge weights of the mutual reachability tree of the vectors, on all coordinates."""
    return _weights(_tree(spark, sf_dir)[1])


@query("spanning_tree_rounds", _TREE)
def _spanning_tree_rounds(spark, sf_dir):
    """The same by the joins and cells that larger tables take."""
    return _weights(_tree(spark, sf_dir, cell_rows=32, small_bytes=0, task_rows=150)[1])


def _weights(edges):
    return edges.groupBy(tidy(F.col("w")).alias("weight")).agg(F.count(F.lit(1)).alias("edges"))


@query("density_cluster", f"SELECT row_id, cluster_id FROM ({_clusters_sql([(0, 5, 0.1)])})")
def _density(spark, sf_dir):
    """Clusters of the vectors on all coordinates."""
    return density.density_clusters(t.points(spark, sf_dir), 5, 3, 0.1)


#: trial, min_cluster_size, epsilon
SETTINGS = [(0, 5, 0.0), (1, 5, 0.9), (2, 2, 0.0), (3, 2, 0.8), (4, 3, 0.0), (5, 20, 0.0)]


#: The same for two coordinates, in which there are many small clusters.
FLAT_SETTINGS = [(0, 5, 0.0), (1, 5, 0.012), (2, 2, 0.0), (3, 2, 0.012), (4, 3, 0.02), (5, 20, 0.0)]


def _cut_by_table(points, settings, **options):
    nodes, edges = density.spanning_tree(points, 3)
    found = merge_tree.cut_trees(nodes, edges, settings, **options)
    trials = F.explode(F.array(*[F.lit(s[0]).cast("bigint") for s in settings])).alias("trial")
    every = density.homes(points, nodes).select("row_id", "pid", trials)
    return every.join(found, ["trial", "pid"], "left").select(
        "trial", "row_id", F.coalesce("cluster_id", F.lit(-1)).cast("bigint").alias("cluster_id")
    )


@query("density_trials", _clusters_sql(SETTINGS))
def _density_trials(spark, sf_dir):
    """One tree of merges on all coordinates, cut by a table of settings."""
    return _cut_by_table(t.points(spark, sf_dir), SETTINGS)


@query("density_trials_bands", _clusters_sql(FLAT_SETTINGS, _tree_sql(_REACH_FLAT)))
def _density_bands(spark, sf_dir):
    """Two coordinates, and a tree in many bands, as longer trees have them."""
    return _cut_by_table(t.flat_points(spark, sf_dir), FLAT_SETTINGS, band_rows=60)


def _scored_sql(labelled):
    """Composite scores of (trial, row_id, point, cluster_id)."""
    return f"""x AS MATERIALIZED ({labelled}), m AS MATERIALIZED (SELECT * FROM x WHERE cluster_id <> -1),
      one AS (SELECT DISTINCT row_id, point FROM x),
      dd AS MATERIALIZED (SELECT a.row_id, b.row_id AS o, {dist('a.point', 'b.point')} AS d FROM one a, one b),
      pair AS (SELECT a.trial, a.row_id, a.cluster_id AS mine, b.cluster_id AS other, sum(dd.d) AS total, count(*) AS n
        FROM m a JOIN m b ON a.trial = b.trial JOIN dd ON dd.row_id = a.row_id AND dd.o = b.row_id GROUP BY ALL),
      ab AS (SELECT trial, row_id, max(CASE WHEN mine = other AND n > 1 THEN total / (n - 1) END) AS a,
        min(CASE WHEN mine <> other THEN total / n END) AS b FROM pair GROUP BY ALL),
      sil AS (SELECT trial, avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0.0
        ELSE (b - a) / greatest(a, b) END) AS s FROM ab GROUP BY trial),
      dim AS (SELECT trial, cluster_id, row_id, unnest(point) AS v, generate_subscripts(point, 1) AS j FROM m),
      cen AS (SELECT trial, cluster_id, j, avg(v) AS c, count(*) AS n FROM dim GROUP BY ALL),
      grand AS (SELECT trial, j, avg(v) AS g FROM dim GROUP BY ALL),
      bet AS (SELECT trial, sum(n * (c - g) * (c - g)) AS b FROM cen JOIN grand USING (trial, j) GROUP BY trial),
      wit AS (SELECT trial, sum((v - c) * (v - c)) AS w FROM dim JOIN cen USING (trial, cluster_id, j) GROUP BY trial),
      z AS (SELECT trial, cluster_id, count(*) AS n FROM m GROUP BY ALL),
      c AS (SELECT trial, sum(n) AS n, count(*) AS k, CASE WHEN count(*) > 1 THEN 1 - stddev_pop(n) / avg(n) ELSE 0 END AS bal
        FROM z GROUP BY trial),
      f AS (SELECT trial, coalesce(c.n, 0) AS n, coalesce(c.k, 0) AS k, total,
        CASE WHEN c.n > 1 AND c.k > 1 THEN s ELSE 0 END AS silhouette,
        CASE WHEN c.k >= 2 AND c.n > c.k THEN (b / (c.k - 1)) / (w / (c.n - c.k)) ELSE 0 END AS ch, coalesce(bal, 0) AS bal
        FROM (SELECT trial, count(*) AS total FROM x GROUP BY trial) LEFT JOIN c USING (trial) LEFT JOIN sil USING (trial)
        LEFT JOIN bet USING (trial) LEFT JOIN wit USING (trial)),
      scored AS (SELECT *, CASE WHEN n >= 2 AND k >= 2 THEN 0.4 * silhouette + 0.2 * ch / 1000 + 0.2 * bal + 0.1 * n / total
          + 0.1 / (1 + abs(k - 10)) ELSE 0.0 END AS score FROM f)"""


#: Labellings of the vectors by trial; -1 is noise.
LABELLINGS = {
    0: "label",
    1: "CASE WHEN label = 0 THEN -1 ELSE label END",
    2: "label % 3",
    3: "CASE WHEN label < 9 THEN -1 ELSE 9 END",
    4: "-1",
}
_LABELLED = " UNION ALL ".join(
    f"SELECT {i}::BIGINT AS trial, row_id, point, ({c})::BIGINT AS cluster_id FROM (SELECT vec_id AS row_id, "
    f"embedding::DOUBLE[] AS point, label FROM embeddings)"
    for i, c in LABELLINGS.items()
)


@query(
    "trial_scores",
    f"""WITH {_scored_sql(_LABELLED)}
      SELECT trial, round(silhouette, 6) + 0.0 AS silhouette, round(ch, 6) + 0.0 AS calinski_harabasz,
        round(bal, 6) + 0.0 AS cluster_balance, round(n / total, 6) + 0.0 AS noise_penalty,
        round(1 / (1 + abs(k - 10)), 6) + 0.0 AS cluster_count_score, round(score, 6) + 0.0 AS score FROM scored""",
)
def _trial_scores(spark, sf_dir):
    """Several labellings of all vectors, scored in one pass."""
    e = t.read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "row_id")
    points = e.select(F.col("row_id").alias("pid"), F.col("embedding").cast("array<double>").alias("point"), F.lit(1).alias("weight"))
    labels = None
    for i, c in LABELLINGS.items():
        one = e.select(F.lit(i).cast("bigint").alias("trial"), F.col("row_id").alias("pid"), F.expr(c).cast("bigint").alias("cluster_id"))
        labels = one if labels is None else labels.unionByName(one)
    found = quality.trial_scores(points, labels.where("cluster_id <> -1"), points.count(), list(LABELLINGS))
    return found.select("trial", *[tidy(F.col(c)).alias(c) for c in found.columns if c != "trial"])


@query("pca_reduce")
def _pca(spark, sf_dir):
    e = t.read(spark, sf_dir, "embeddings")
    return reduce(e, fit_reducer(e, 2)).select("vec_id", "point")


@query("pca_apply")
def _pca_apply(spark, sf_dir):
    """A reducer learnt on the low labels, applied to all vectors."""
    e = t.read(spark, sf_dir, "embeddings")
    return reduce(e, fit_reducer(e.where(F.col("label") < 5), 2)).select("vec_id", "point")


@query("tune")
def _tune(spark, sf_dir):
    e = t.read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "row_id")
    trials = tuning.grid_trials(
        spark,
        n_components=[2],
        min_samples=[3],
        min_cluster_size=[5, 15],
        epsilon=[0.0, 0.05],
    )
    return tuning.run_trials(e.select("row_id", "embedding"), trials)


#: Settings of the trials below; all coordinates are kept, so that the reduction only turns them.
_GRID = [(0, 2, 0.0), (1, 2, 0.9), (2, 5, 0.0), (3, 5, 0.9)]
_UNIT_POINTS = """(SELECT vec_id AS row_id, list_transform(v, lambda x: x / n) AS point FROM (SELECT vec_id, v,
  sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)))"""
_UNIT_EDGES = _tree_sql(_REACH.replace(t.POINTS, _UNIT_POINTS))


_TRIED = f"""lab AS MATERIALIZED ({_clusters_sql(_GRID, _UNIT_EDGES)}),
  {_scored_sql(f"SELECT trial, row_id, point, cluster_id FROM lab JOIN {_UNIT_POINTS} USING (row_id)")}"""


def _grid_rows(spark, sf_dir):
    e = t.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding")
    trials = tuning.grid_trials(
        spark, n_components=[64], min_samples=[3], min_cluster_size=[2, 5], epsilon=[0.0, 0.9]
    )
    return e, trials


@query(
    "tune_all",
    f"""WITH {_TRIED} SELECT trial AS trial_id, 64 AS n_components, 3 AS min_samples,
      CASE WHEN trial < 2 THEN 2 ELSE 5 END AS min_cluster_size, CASE WHEN trial % 2 = 0 THEN 0.0 ELSE 0.9 END::DOUBLE AS epsilon,
      round(score, 6) + 0.0 AS score FROM scored""",
)
def _tune_all(spark, sf_dir):
    """Trials on all coordinates: one tree, one table of settings, one pass of scoring."""
    scored = tuning.run_trials(*_grid_rows(spark, sf_dir))
    return scored.withColumn("score", tidy(F.col("score")))


@query(
    "tuned_run",
    f"""WITH {_TRIED}, best AS (SELECT trial FROM scored ORDER BY score DESC, trial LIMIT 1),
      got AS (SELECT row_id, cluster_id FROM lab JOIN best USING (trial))
      SELECT run, reused, row_id, cluster_id FROM got, (VALUES (0, false), (1, true), (2, false)) v(run, reused)""",
)
def _tuned_run(spark, sf_dir):
    """Search, save, reload and build with the best parameters; then the stored model is reused, then
    trained anew by force. All three give the best trial's clusters."""
    vectors, trials = _grid_rows(spark, sf_dir)
    base = f"{ensure_checkpoint_dir(spark)}/tuned-{uuid.uuid4().hex}"
    options = analysis.tuned(vectors, trials, f"{base}/trials", analysis.Options(model_folder=f"{base}/model"))
    out = None
    for run, forced in enumerate((False, False, True)):
        points, reused = analysis.fit_or_reuse(vectors, analysis.Options(**{**options.__dict__, "force_retrain": forced}))
        part = points.select(F.lit(run).alias("run"), F.lit(reused).alias("reused"), "row_id", "cluster_id")
        out = part if out is None else out.unionByName(part)
    return out


@query("full_analysis")
def full(spark, sf_dir):
    """Clean, embed, cluster and name all documents; one row per theme."""
    options = analysis.Options(min_cluster_size=15, min_samples=5, epsilon=0.0)
    return analysis.analyze(t.texts(spark, sf_dir), "text", options).themes
