"""Registered queries over themes: naming, classification, comparison, context."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from themeloom.functions import fixed, vector
from themeloom.functions import text as tx
from themeloom.operators import classify, clusters, compare, embed, lexical, rows, themes
from themeloom.plans import sqltext as q
from themeloom.plans import tables as t
from themeloom.plans.vector_queries import CENTERS, DIM, _tidied
from themeloom.runtime import cut, ensure_checkpoint_dir, tidy

RUN, SQL = {}, {}


def query(name, sql=None):
    def keep(fn):
        RUN[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return keep


_SMP = f"""smp AS (SELECT cluster_id, list(text ORDER BY row_id) AS samples FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY row_id) AS rn FROM {t.THEMED})
  WHERE rn <= 10 GROUP BY cluster_id)"""


def _bullets(x, n):
    return f"array_to_string(list_transform({x}[1:{n}], lambda s: '- ' || s), chr(10))"


def _terms_sql(k):
    return f"""
  tok AS (SELECT cluster_id, unnest({q.content_words('text')}) AS term FROM {t.THEMED}),
  tc AS (SELECT cluster_id, term, count(*) AS n FROM tok WHERE length(term) > 2 GROUP BY ALL),
  tf AS (SELECT term, sum(n) AS f FROM tc GROUP BY term),
  av AS (SELECT sum(n) / count(DISTINCT cluster_id) AS a FROM tc),
  sc AS (SELECT cluster_id, term, round(n * ln(1 + a / f), 6) AS score FROM tc JOIN tf USING (term), av),
  tt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id
    ORDER BY score DESC, term) AS rank FROM sc) WHERE rank <= {k})"""


_ISSUE = f"regexp_matches(lower(x), '{'|'.join(fixed.DQ_TERMS)}')"
_THEMES = f"""{_SMP}, {_terms_sql(3)},
  nm AS (SELECT cluster_id, string_agg(term, ' ' ORDER BY rank) AS name FROM tt GROUP BY cluster_id),
  sz AS (SELECT cluster_id, count(*) AS size FROM {t.THEMED} GROUP BY cluster_id),
  dq AS (SELECT cluster_id, count(*) AS total, count(*) FILTER ({_ISSUE}) AS hits FROM (
    SELECT cluster_id, unnest(samples) AS x FROM smp) GROUP BY cluster_id),
  th AS (SELECT cluster_id, coalesce(name, 'Unknown Theme') AS name,
    printf('%d texts about %s; %.1f%% of the samples name a data quality issue', size,
      coalesce(name, 'Unknown Theme'), hits / total * 100) AS description,
    total AS sample_count, hits AS data_quality_issues,
    hits / total * 100 AS data_quality_percentage, samples[1:5] AS samples, size AS cluster_size
    FROM smp LEFT JOIN nm USING (cluster_id) LEFT JOIN sz USING (cluster_id)
    LEFT JOIN dq USING (cluster_id))"""


def theme_frame(spark, sf_dir):
    d = t.themed_texts(spark, sf_dir)
    return themes.theme_table(
        clusters.cluster_samples(d), themes.theme_names(d), clusters.cluster_sizes(d)
    )


@query("prompt_block", f"WITH {_SMP} SELECT cluster_id, {_bullets('samples', 10)} AS block FROM smp")
def _prompt(spark, sf_dir):
    return themes.prompt_blocks(clusters.cluster_samples(t.themed_texts(spark, sf_dir)))


@query(
    "theme_terms",
    f"WITH {_terms_sql(10)} SELECT cluster_id, rank, term, score + 0.0 AS score FROM tt",
)
def _terms(spark, sf_dir):
    found = themes.top_terms(themes.term_counts(t.themed_texts(spark, sf_dir)), 10)
    return _tidied(found.withColumn("rank", F.col("rank").cast("bigint")), "score")


@query(
    "theme_name",
    f"""WITH {_terms_sql(3)} SELECT cluster_id, string_agg(term, ' ' ORDER BY rank) AS name
      FROM tt GROUP BY cluster_id""",
)
def _names(spark, sf_dir):
    return themes.theme_names(t.themed_texts(spark, sf_dir))


@query(
    "theme_table",
    f"""WITH {_THEMES} SELECT cluster_id, name, description, sample_count, data_quality_issues,
      round(data_quality_percentage, 6) + 0.0 AS data_quality_percentage,
      array_to_string(samples, '|') AS samples, cluster_size FROM th""",
)
def _themes(spark, sf_dir):
    return _tidied(theme_frame(spark, sf_dir), "data_quality_percentage").withColumn(
        "samples", F.concat_ws("|", "samples")
    )


@query(
    "theme_summary",
    f"""WITH {_THEMES} SELECT 0 AS part, 0::BIGINT AS line, 'themes.count = ' || count(*) AS value FROM th
      UNION ALL SELECT 0, 1, 'themes.issues = ' || coalesce(sum(data_quality_issues), 0)::BIGINT FROM th
      UNION ALL SELECT 1, cluster_id, 'theme ' || cluster_id || ': named ' || name || ', about ' || description
        || ', samples ' || sample_count || ', issues ' || data_quality_issues
        || printf(', issue share %.1f%%', data_quality_percentage) FROM th""",
)
def _theme_summary(spark, sf_dir):
    return themes.theme_summary(theme_frame(spark, sf_dir))


@query(
    "theme_list",
    f"""WITH {_THEMES} SELECT cluster_id AS theme_id, name AS theme_name, description, sample_count,
      data_quality_issues, round(data_quality_percentage, 6) + 0.0 AS data_quality_percentage,
      array_to_string(samples, '|') AS representative_examples FROM th""",
)
def _theme_list(spark, sf_dir):
    listed = rows.theme_list(theme_frame(spark, sf_dir))
    return _tidied(listed, "data_quality_percentage").withColumn(
        "representative_examples", F.concat_ws("|", "representative_examples")
    )


@query(
    "theme_detail",
    f"""WITH {_THEMES} SELECT cluster_id, name, array_to_string(samples[1:3], '|') AS examples,
      round(data_quality_issues / sample_count * 100, 1) + 0.0 AS issue_rate FROM th""",
)
def _theme_detail(spark, sf_dir):
    found = rows.theme_detail(theme_frame(spark, sf_dir))
    return found.select(
        "cluster_id",
        "name",
        F.concat_ws("|", "examples").alias("examples"),
        tidy(F.col("issue_rate"), 1).alias("issue_rate"),
    )


def _flagged_themes_sql():
    return f"""(SELECT cluster_id, count(*) AS sample_count,
      count(*) FILTER (length(trim(text)) < 10) AS data_quality_issues FROM {t.THEMED}
      GROUP BY cluster_id)"""


def _flagged_themes(spark, sf_dir):
    d = t.themed_texts(spark, sf_dir)
    return d.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.count(F.when(rows.quality_branch(F.col("text")) == "short", 1)).alias(
            "data_quality_issues"
        ),
    )


@query(
    "themes_with_issues",
    f"SELECT * FROM {_flagged_themes_sql()} WHERE data_quality_issues > 0",
)
def _with_issues(spark, sf_dir):
    return rows.themes_with_issues(_flagged_themes(spark, sf_dir))


@query(
    "overview",
    f"""SELECT (SELECT count(*) FROM documents) AS total_records,
      (SELECT count(*) FROM {_flagged_themes_sql()}) AS total_themes,
      (SELECT count(DISTINCT cluster_id) FROM {t.POINTS} WHERE cluster_id <> -1) AS total_clusters,
      (SELECT sum(data_quality_issues)::BIGINT FROM {_flagged_themes_sql()}) AS quality_issues""",
)
def _overview(spark, sf_dir):
    return rows.overview(
        t.texts(spark, sf_dir), _flagged_themes(spark, sf_dir), t.points(spark, sf_dir)
    )


@query(
    "clean_response",
    f"""SELECT conv_id, turn, translate({q.edges("concat(' \"', text, '''s\" ')")}, '\"''', '')
      AS result FROM conversations""",
)
def _clean_response(spark, sf_dir):
    said = F.concat(F.lit(' "'), F.col("text"), F.lit("'s\" "))
    return t.read(spark, sf_dir, "conversations").select(
        "conv_id", "turn", tx.strip_quotes(said).alias("result")
    )


_REPLY = """CASE role WHEN 'assistant' THEN ' Yes ' WHEN 'system' THEN NULL ELSE
  CASE WHEN turn = 0 THEN 'no' WHEN turn = 2 THEN 'maybe' ELSE 'TRUE' END END"""


@query(
    "parse_yes_no",
    f"""SELECT conv_id, turn, coalesce(trim(r), 'Error') AS response,
      coalesce(lower(trim(r)) IN ('yes', 'true', '1'), false) AS is_positive,
      CASE WHEN r IS NULL THEN 'low' WHEN lower(trim(r)) IN ('yes', 'no') THEN 'high'
      ELSE 'medium' END AS confidence FROM (SELECT conv_id, turn, {_REPLY} AS r FROM conversations)""",
)
def _yes_no(spark, sf_dir):
    c = t.read(spark, sf_dir, "conversations")
    reply = (
        F.when(F.col("role") == "assistant", " Yes ")
        .when(F.col("role") == "system", F.lit(None))
        .when(F.col("turn") == 0, "no")
        .when(F.col("turn") == 2, "maybe")
        .otherwise("TRUE")
    )
    return themes.parse_yes_no(c.select("conv_id", "turn", reply.alias("response")))


_ISSUE_TEXT = "CASE event_type WHEN 'error' THEN 'Missing value' ELSE event_type END"


@query(
    "dq_share",
    f"""SELECT user_id, count(*) AS total_summaries, count(*) FILTER ({_ISSUE}) AS data_quality_count,
      round(count(*) FILTER ({_ISSUE}) / count(*) * 100, 6) + 0.0 AS data_quality_percentage
      FROM (SELECT user_id, {_ISSUE_TEXT} AS x FROM events) GROUP BY user_id""",
)
def _dq_share(spark, sf_dir):
    e = t.read(spark, sf_dir, "events").select(
        "user_id",
        F.when(F.col("event_type") == "error", "Missing value")
        .otherwise(F.col("event_type"))
        .alias("text"),
    )
    share = themes.issue_share(e, themes.names_issue(F.col("text")), "user_id")
    return _tidied(share, "data_quality_percentage")


@query(
    "compare_terms",
    f"""WITH {_terms_sql(10)},
      tl AS (SELECT cluster_id, list(term) AS terms FROM tt GROUP BY cluster_id),
      pr AS (SELECT a.cluster_id AS theme1, b.cluster_id AS theme2, a.terms AS x, b.terms AS y
        FROM tl a JOIN tl b ON b.cluster_id > a.cluster_id AND list_has_any(a.terms, b.terms))
      SELECT theme1, theme2,
      array_to_string(list_sort(list_filter(x, lambda s: list_contains(y, s))), ' ') AS shared,
      array_to_string(list_sort(list_filter(x, lambda s: NOT list_contains(y, s))), ' ') AS only1,
      array_to_string(list_sort(list_filter(y, lambda s: NOT list_contains(x, s))), ' ') AS only2
      FROM pr""",
)
def _compare_terms(spark, sf_dir):
    terms = themes.term_lists(themes.top_terms(themes.term_counts(t.themed_texts(spark, sf_dir)), 10))
    found = themes.compare_terms(terms)
    return found.select(
        "theme1", "theme2", *[F.concat_ws(" ", c).alias(c) for c in ("shared", "only1", "only2")]
    )


_FILES = f"""lf AS (SELECT * FROM {CENTERS} WHERE cluster_id < 5),
  rf AS (SELECT * FROM {CENTERS} WHERE cluster_id >= 5),
  best AS (SELECT lf.cluster_id, max({q.cosine('lf.v', 'rf.v')}) AS s,
    arg_max(rf.cluster_id, {q.cosine('lf.v', 'rf.v')}) AS match_id FROM lf, rf GROUP BY lf.cluster_id),
  back AS (SELECT rf.cluster_id, max({q.cosine('lf.v', 'rf.v')}) AS s FROM lf, rf
    GROUP BY rf.cluster_id)"""


def _two_files(spark, sf_dir):
    """Clusters of the low labels as one file's themes, of the high labels as another's."""
    c = clusters.centroids(t.points(spark, sf_dir))
    return c.where(F.col("cluster_id") < 5), c.where(F.col("cluster_id") >= 5)


@query(
    "compare_files_shared",
    f"""WITH {_FILES} SELECT cluster_id::BIGINT AS cluster_id, match_id::BIGINT AS match_id, round(s, 6) + 0.0 AS similarity FROM best
      WHERE s >= 0.2""",
)
def _shared(spark, sf_dir):
    left, right = _two_files(spark, sf_dir)
    return _tidied(compare.shared_themes(left, right, DIM, 0.2), "similarity")


@query("compare_files_exclusive", f"WITH {_FILES} SELECT cluster_id FROM best WHERE s < 0.2")
def _exclusive(spark, sf_dir):
    left, right = _two_files(spark, sf_dir)
    return compare.exclusive_themes(left, right, DIM, 0.2)


@query(
    "compare_files",
    f"""WITH {_FILES} SELECT (SELECT count(*) FROM best WHERE s >= 0.2) AS shared_themes,
      (SELECT count(*) FROM best WHERE s < 0.2) + (SELECT count(*) FROM back WHERE s < 0.2)
      AS unique_themes""",
)
def _compare_files(spark, sf_dir):
    left, right = _two_files(spark, sf_dir)
    return compare.compare_files(left, right, DIM, 0.2)


_CTX = f"""ctx AS (SELECT p.row_id, d.text, {q.cosine('c.v', 'p.point')} AS s FROM {t.POINTS} p
  JOIN documents d ON d.doc_id = p.row_id, {CENTERS} c WHERE p.cluster_id = 3 AND c.cluster_id = 4
  ORDER BY s DESC, p.row_id LIMIT 10)"""


def _context(spark, sf_dir):
    p = t.points(spark, sf_dir)
    both = p.join(t.texts(spark, sf_dir).select("row_id", "text"), "row_id")
    asked = clusters.centroids(p).where(F.col("cluster_id") == 4).select("centroid").scalar()
    return themes.theme_context(both, asked, 3, 10, "point")


@query("theme_context", f"WITH {_CTX} SELECT row_id, text, round(s, 6) + 0.0 AS similarity FROM ctx")
def _theme_context(spark, sf_dir):
    return _tidied(_context(spark, sf_dir), "similarity")


@query(
    "context_block",
    f"""WITH {_CTX} SELECT string_agg('- ' || text, chr(10) ORDER BY s DESC, row_id) AS block
      FROM ctx""",
)
def _context_block(spark, sf_dir):
    return themes.context_block(_context(spark, sf_dir))


@query(
    "add_examples",
    f"""WITH al AS (SELECT row_id, text, cluster_id FROM {t.THEMED} UNION ALL
      SELECT -1 - item_id, text, 0 FROM benchmark)
      SELECT cluster_id, count(*) AS size, string_agg(text, '|' ORDER BY row_id)
        FILTER (rn <= 10) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id
        ORDER BY row_id) AS rn FROM al) GROUP BY cluster_id""",
)
def _add_examples(spark, sf_dir):
    """Benchmark texts added to a stored state; the same as a state of all rows."""
    given = t.read(spark, sf_dir, "benchmark").select(
        (-1 - F.col("item_id")).alias("row_id"), "text", F.lit(0).alias("cluster_id")
    )
    path = f"{ensure_checkpoint_dir(spark)}/state-{uuid.uuid4().hex}"
    themes.write_state(themes.cluster_state(t.themed_texts(spark, sf_dir)), path)
    grown = themes.add_examples(spark, path, given)
    return grown.select(
        "cluster_id", "size", F.concat_ws("|", F.transform("firsts", lambda f: f["text"])).alias("samples")
    )


@query(
    "state_terms",
    f"""WITH al AS (SELECT text, cluster_id FROM {t.THEMED} UNION ALL SELECT text, 3 FROM benchmark),
      w AS (SELECT cluster_id, unnest({q.content_words('text')}) AS term FROM al)
      SELECT cluster_id, term, count(*) AS n FROM w WHERE length(term) > 2 GROUP BY ALL""",
)
def _state_terms(spark, sf_dir):
    """Word counts of all clusters after examples were added to one."""
    given = t.read(spark, sf_dir, "benchmark").select(
        (-1 - F.col("item_id")).alias("row_id"), "text", F.lit(3).alias("cluster_id")
    )
    path = f"{ensure_checkpoint_dir(spark)}/state-{uuid.uuid4().hex}"
    themes.write_state(themes.cluster_state(t.themed_texts(spark, sf_dir)), path)
    return themes.add_examples(spark, path, given).select("cluster_id", F.inline("terms"))


def _issue_rows(spark, sf_dir):
    """All documents; the labelled ones are issues if their quality is low."""
    labels = t.read(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("label"))
    return t.read(spark, sf_dir, "documents").select("doc_id", "text").join(labels, "doc_id", "left")


@query("issue_classes")
def _issue_classes(spark, sf_dir):
    """A model of the labelled documents with an even id, applied to all documents."""
    rows_ = _issue_rows(spark, sf_dir)
    model = classify.fit(rows_.where("doc_id % 2 = 0"))
    return classify.classify(rows_, model).select("doc_id", "is_positive", "confidence", tidy(F.col("probability"), 3).alias("probability"))


@query("issue_scores")
def _issue_scores(spark, sf_dir):
    """The same model on the labelled documents with an odd id, which it has not seen."""
    rows_ = _issue_rows(spark, sf_dir)
    model = classify.fit(rows_.where("doc_id % 2 = 0"))
    return classify.scores(classify.classify(rows_.where("doc_id % 2 = 1"), model))


def _embedded(spark, sf_dir):
    """Vectors of all documents, whose words are made once, for the fit and for the vectors."""
    d = cut(embed.with_words(t.texts(spark, sf_dir).select("row_id", "text")).drop("text"))
    return embed.embed_hashing(d, embed.fit_hashing(d))


@query("embed_texts")
def _embed(spark, sf_dir):
    return _embedded(spark, sf_dir).select("row_id", "embedding")


@query(
    "embed_lengths",
    f"""SELECT row_id, 256 AS dim, CASE WHEN len({q.content_words('text')}) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS length
      FROM {t.TEXTS}""",
)
def _embed_lengths(spark, sf_dir):
    """Vectors of all documents have the asked dimension and unit length, or none without words."""
    made = _embedded(spark, sf_dir)
    return made.select("row_id", F.size("embedding").alias("dim"), tidy(vector.norm(F.col("embedding"))).alias("length"))
