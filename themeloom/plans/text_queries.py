"""Registered queries over texts: scans, rows, profiles, text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from themeloom.functions import fixed
from themeloom.functions import text as tx
from themeloom.functions import vector
from themeloom.operators import embed, lexical, profile, rows
from themeloom.plans import sqltext as q
from themeloom.plans import tables as t
from themeloom.runtime import cut, tidy

RUN, SQL = {}, {}


def query(name, sql=None):
    def keep(fn):
        RUN[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return keep


def _long(*names):
    return [F.col(n).cast("bigint").alias(n) for n in names]


# ------------------------------------------------------------------ text scalars


def _scalar(name, column, sql_expr, table="documents", key="doc_id", source="text"):
    @query(name, f"SELECT {key}, {sql_expr(source)} AS result FROM {table}")
    def run(spark, sf_dir):
        return t.read(spark, sf_dir, table).select(key, column(F.col(source)).alias("result"))


_scalar("clean_text", tx.clean_text, q.clean)
_scalar("strip_html", tx.strip_html, q.html, "pages", "page_id", "html")
_scalar("strip_urls", tx.strip_urls, q.urls)
_scalar("strip_emails", tx.strip_emails, q.emails)
_scalar("keep_chars", tx.keep_chars, q.chars)
_scalar("normalize_ws", tx.normalize_space, q.blanks)
_scalar("clean_pages", tx.clean_text, q.clean, "pages", "page_id", "html")
_scalar("lower_case", rows.lower_case, lambda x: f"lower({x})")
_scalar("truncate_text", rows.truncate_text, lambda x: f"substring({x}, 1, 2000)")
_scalar("valid_text", rows.is_valid_text, lambda x: f"coalesce(length({x}) >= 10, false)")
_scalar(
    "sentences",
    lambda c: F.concat_ws("\n", tx.sentences(c)),
    lambda x: f"array_to_string({q.sentences(x)}, chr(10))",
)
_scalar(
    "word_tokens",
    lambda c: F.concat_ws(" ", tx.word_tokens(c)),
    lambda x: f"array_to_string({q.words(x)}, ' ')",
)
_scalar(
    "stop_words",
    lambda c: F.concat_ws(" ", tx.drop_stop_words(tx.word_tokens(c))),
    lambda x: f"array_to_string({q.content_words(x)}, ' ')",
)

PREFIX = [("en", "Issue: Summary: "), ("de", " BUG # "), ("fr", "Steps to reproduce: ")]
_PREFIX_SQL = (
    "concat(CASE lang "
    + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in PREFIX)
    + " ELSE 'Environment : ' END, text)"
)


@query("boilerplate", f"SELECT doc_id, {q.boilerplate(_PREFIX_SQL)} AS result FROM documents")
def _boilerplate(spark, sf_dir):
    prefix = F.lit(None).cast("string")
    for lang, words in reversed(PREFIX):
        prefix = F.when(F.col("lang") == lang, words).otherwise(prefix)
    prefixed = F.concat(F.coalesce(prefix, F.lit("Environment : ")), F.col("text"))
    return t.read(spark, sf_dir, "documents").select(
        "doc_id", tx.remove_boilerplate(prefixed).alias("result")
    )


_MARKS = "chr(101) || chr(769)"  # a letter and a combining mark


@query(
    "repair_encoding",
    f"""SELECT doc_id, translate(nfc_normalize(CASE doc_id % 4 WHEN 0 THEN '日本 ' || text
      WHEN 1 THEN CASE WHEN contains(text, '<') THEN replace(replace(text, 'é', '&eacute;'), 'ü', '&#252;') ELSE text END
      WHEN 2 THEN text || ' ' || {_MARKS} ELSE 'a' || text END), '‘’‚‛“”„‟', '''''''''""""') AS result FROM documents""",
)
def _repair(spark, sf_dir):
    """Documents with the damage that repair undoes: UTF-8 read as Latin-1 behind other letters,
    entities, decomposed letters, control characters."""
    d = t.read(spark, sf_dir, "documents")
    x = F.col("text")
    escaped = F.replace(F.replace(x, F.lit("é"), F.lit("&eacute;")), F.lit("ü"), F.lit("&#252;"))
    damaged = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("日本 "), F.decode(F.encode(x, "UTF-8"), "ISO-8859-1")))
        .when(F.col("doc_id") % 4 == 1, escaped)
        .when(F.col("doc_id") % 4 == 2, F.concat(x, F.lit(" e\u0301")))
        .otherwise(F.concat(F.lit("a\x07\x00"), x))
    )
    return d.select("doc_id", tx.repair_encoding(damaged).alias("result"))


# ------------------------------------------------------------------ corpus-level text

_TOK = (
    f"tok AS (SELECT row_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM "
    f"(SELECT row_id, {q.content_words('text')} AS w FROM {t.TEXTS}))"
)
_RULES = " UNION ALL ".join(
    f"SELECT word, {i} AS rule, left(word, length(word) - {len(a)}) || '{b}' AS lemma FROM voc "
    f"WHERE suffix(word, '{a}') AND length(word) > {len(a)}"
    for i, (a, b) in enumerate(fixed.NOUN_ENDINGS)
)
_LEM = f"""
 voc AS (SELECT DISTINCT word FROM tok),
 opt AS (SELECT * FROM ({_RULES}) WHERE lemma IN (SELECT word FROM voc)),
 lem AS (SELECT word, first(lemma ORDER BY length(lemma), rule) AS lemma FROM opt GROUP BY word),
 full_tok AS (SELECT tok.row_id, tok.pos, tok.word, coalesce(lem.lemma, tok.word) AS lemma
              FROM tok LEFT JOIN lem USING (word))"""
_PHR = """
 cnt AS (SELECT row_id, lemma AS phrase, count(*) AS n, min(pos) AS p FROM full_tok
         WHERE length(lemma) > 2 GROUP BY ALL),
 phr AS (SELECT row_id, rank, phrase, n FROM (SELECT *, row_number() OVER
         (PARTITION BY row_id ORDER BY n DESC, p) AS rank FROM cnt) WHERE rank <= 10)"""


@query(
    "lemmas",
    f"WITH {_TOK}, {_LEM} SELECT lemma, count(*) AS n, count(DISTINCT word) AS forms "
    "FROM full_tok GROUP BY lemma",
)
def _lemmas(spark, sf_dir):
    return lexical.lemma_counts(lexical.row_words(t.texts(spark, sf_dir)))


@query("key_phrases", f"WITH {_TOK}, {_LEM}, {_PHR} SELECT * FROM phr")
def _key_phrases(spark, sf_dir):
    words = cut(lexical.row_words(t.texts(spark, sf_dir)))
    found = lexical.key_phrases(lexical.lemmatize(words))
    return found.select("row_id", *_long("rank"), "phrase", "n")


@query(
    "source_terms",
    f"""WITH tok AS (SELECT source, unnest({q.content_words(q.clean('text'))}) AS term
      FROM documents),
      cnt AS (SELECT source, term, count(*) AS n FROM tok WHERE length(term) > 2 GROUP BY ALL)
      SELECT source, rank, term, n FROM (SELECT *, row_number() OVER
        (PARTITION BY source ORDER BY n DESC, term) AS rank FROM cnt) WHERE rank <= 10""",
)
def source_terms(spark, sf_dir):
    found = lexical.group_terms(t.read(spark, sf_dir, "documents"), "source")
    return found.select("source", *_long("rank"), "term", "n")


_ODD_SQL = f"(SELECT * FROM {t.TEXTS} WHERE row_id % 2 = 1)"
_MODEL = f"""
 lt AS (SELECT lang, unnest({q.letters('text')}) AS token FROM documents),
 c AS (SELECT lang, token, count(*) AS n FROM lt GROUP BY ALL),
 tot AS (SELECT lang, sum(n) AS total FROM c GROUP BY lang),
 v AS (SELECT count(DISTINCT token) AS v FROM c),
 dt AS (SELECT row_id, token, count(*) AS k FROM (SELECT row_id, unnest({q.letters('text')})
        AS token FROM {t.TEXTS}) GROUP BY ALL),
 s AS (SELECT dt.row_id, tot.lang, sum(k * ln((coalesce(c.n, 0) + 1) / (tot.total + v.v))) AS s
       FROM dt CROSS JOIN tot CROSS JOIN v
       LEFT JOIN c ON c.lang = tot.lang AND c.token = dt.token GROUP BY ALL),
 d AS (SELECT t.row_id, coalesce(first(s.lang ORDER BY s.s DESC, s.lang), 'en') AS language
       FROM {t.TEXTS} t LEFT JOIN s ON s.row_id = t.row_id GROUP BY t.row_id)"""


@query("detect_language", f"WITH {_MODEL} SELECT * FROM d")
def _detect(spark, sf_dir):
    d = t.texts(spark, sf_dir)
    return lexical.detect_language(d, lexical.train_language_model(d))


@query(
    "detect_language_split",
    f"""WITH {_MODEL.replace("FROM documents)", "FROM documents WHERE doc_id % 2 = 0)", 1).replace(t.TEXTS, _ODD_SQL)}
      SELECT * FROM d""",
)
def _detect_split(spark, sf_dir):
    """Learnt from the even documents, told of the odd ones."""
    d = t.texts(spark, sf_dir)
    model = lexical.train_language_model(d.where("row_id % 2 = 0"))
    return lexical.detect_language(d.where("row_id % 2 = 1"), model)


@query("language_dist", f"WITH {_MODEL} SELECT language, count(*) AS n FROM d GROUP BY language")
def _language_dist(spark, sf_dir):
    return profile.language_counts(_detect(spark, sf_dir))


_B = q.boilerplate(q.clean("text"))
_REC = f"""
 base AS (SELECT row_id, {_B} AS cleaned_text FROM {t.TEXTS}),
 tok AS (SELECT row_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM
        (SELECT row_id, {q.content_words('cleaned_text')} AS w FROM base)),
 {_LEM}, {_PHR},
 wl AS (SELECT row_id, string_agg(lemma, ' ' ORDER BY pos) AS words, count(*) AS n FROM full_tok
        GROUP BY row_id),
 pl AS (SELECT row_id, string_agg(phrase, ' ' ORDER BY rank) AS key_phrases FROM phr
        GROUP BY row_id),
 rec AS (SELECT row_id, cleaned_text, coalesce(words, '') AS words,
        coalesce(key_phrases, '') AS key_phrases, coalesce(n, 0) AS word_count,
        len({q.sentences('cleaned_text')}) AS sentence_count
        FROM base LEFT JOIN wl USING (row_id) LEFT JOIN pl USING (row_id))"""


_CLEANED = f"(SELECT row_id, {q.clean('text')} AS text FROM {t.TEXTS})"


@query(
    "preprocess_record",
    f"""WITH {_REC}, {_MODEL.replace(t.TEXTS, _CLEANED)}
      SELECT rec.*, array_to_string({q.sentences('cleaned_text')}, chr(10)) AS sentences, language
      FROM rec JOIN d USING (row_id)""",
)
def _record(spark, sf_dir):
    d = t.texts(spark, sf_dir)
    rec = lexical.preprocess(d, model=lexical.train_language_model(d), repair=False)
    return rec.select(
        "row_id",
        "cleaned_text",
        F.concat_ws("\n", "sentences").alias("sentences"),
        "language",
        F.concat_ws(" ", "words").alias("words"),
        F.concat_ws(" ", "key_phrases").alias("key_phrases"),
        *_long("word_count", "sentence_count"),
    )


@query(
    "corpus_stats",
    f"""WITH {_REC} SELECT count(*) AS total_texts, sum(word_count)::BIGINT AS total_words,
      sum(sentence_count)::BIGINT AS total_sentences,
      round(sum(word_count) / count(*), 6) AS avg_words_per_text,
      round(sum(sentence_count) / count(*), 6) AS avg_sentences_per_text FROM rec""",
)
def _corpus_stats(spark, sf_dir):
    s = lexical.corpus_statistics(lexical.record_sizes(t.texts(spark, sf_dir), repair=False))
    return s.select(
        "total_texts",
        "total_words",
        "total_sentences",
        tidy(F.col("avg_words_per_text")).alias("avg_words_per_text"),
        tidy(F.col("avg_sentences_per_text")).alias("avg_sentences_per_text"),
    )


# ------------------------------------------------------------------ rows

_HOLES_SQL = """(SELECT doc_id AS row_id, lang, CASE source WHEN 'src1' THEN NULL WHEN 'src2'
  THEN 'NaN' WHEN 'src3' THEN '' WHEN 'src4' THEN '  ' ELSE text END AS text FROM documents)"""


def _holes(spark, sf_dir):
    s = F.col("source")
    text = (
        F.when(s == "src1", F.lit(None))
        .when(s == "src2", "NaN")
        .when(s == "src3", "")
        .when(s == "src4", "  ")
        .otherwise(F.col("text"))
    )
    return t.read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"), "lang", text.alias("text")
    )


@query(
    "extract_texts",
    f"SELECT row_id, text FROM {_HOLES_SQL} WHERE text IS NOT NULL "
    "AND lower(text) NOT IN ('nan', 'none', '')",
)
def _extract(spark, sf_dir):
    return rows.extract_texts(_holes(spark, sf_dir), "text")


@query("fill_empty", f"SELECT row_id, coalesce(text, '') AS text FROM {_HOLES_SQL}")
def _fill(spark, sf_dir):
    return rows.fill_empty(_holes(spark, sf_dir), "text")


@query(
    "na_tokens",
    f"""SELECT row_id, lang, CASE WHEN text IN ({', '.join(q.quote(x) for x in fixed.NA_TOKENS)})
      THEN NULL ELSE text END AS text FROM {_HOLES_SQL}""",
)
def _na(spark, sf_dir):
    return rows.normalize_na(_holes(spark, sf_dir))


@query(
    "analysis_dataset",
    f"""SELECT doc_id AS original_index, text AS original_summary,
      {q.clean('text')} AS cleaned_summary, lower({q.clean('text')}) AS processed_summary,
      lang AS language, length({q.clean('text')}) AS summary_length, lang AS original_lang,
      source AS original_source, n_chars AS original_n_chars FROM documents""",
)
def _dataset(spark, sf_dir):
    d = t.texts(spark, sf_dir)
    clean = tx.clean_text(F.col("text"))
    done = d.select(
        "row_id",
        F.col("text").alias("original"),
        clean.alias("cleaned"),
        F.lower(clean).alias("processed"),
        F.col("lang").alias("language"),
        F.length(clean).cast("bigint").alias("length"),
    )
    return rows.analysis_dataset(done, d.drop("text"))


_DQ_TEXT_SQL = "concat('event of type ', event_type)"
_DQ_BRANCH = """CASE WHEN length(trim(x)) < 10 THEN 'short' WHEN contains(lower(x), 'error')
  OR contains(lower(x), 'null') THEN 'keyword' END"""


@query(
    "dq_flags",
    f"""SELECT id, branch FROM (
      SELECT event_id AS id, {_DQ_BRANCH.replace('x)', _DQ_TEXT_SQL + ')')} AS branch FROM events
      UNION ALL
      SELECT -1 - doc_id AS id, {_DQ_BRANCH.replace('x)', 'text)')} AS branch FROM documents)""",
)
def _dq_flags(spark, sf_dir):
    e = t.read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.concat(F.lit("event of type "), "event_type").alias("text")
    )
    d = t.read(spark, sf_dir, "documents").select((-1 - F.col("doc_id")).alias("id"), "text")
    return e.unionByName(d).select("id", rows.quality_branch(F.col("text")).alias("branch"))


@query(
    "dq_row_share",
    f"""SELECT count(b) AS data_quality_count,
      round(count(b) / count(*) * 100, 6) AS data_quality_percentage, count(*) AS total_texts
      FROM (SELECT {_DQ_BRANCH.replace('x)', _DQ_TEXT_SQL + ')')} AS b FROM events)""",
)
def _dq_share(spark, sf_dir):
    e = t.read(spark, sf_dir, "events").select(
        F.concat(F.lit("event of type "), "event_type").alias("text")
    )
    s = rows.quality_share(e)
    return s.withColumn("data_quality_percentage", tidy(F.col("data_quality_percentage")))


@query("language_filter", "SELECT doc_id, lang FROM documents WHERE lang IN ('en')")
def _language_filter(spark, sf_dir):
    d = t.read(spark, sf_dir, "documents").select("doc_id", "lang")
    return rows.language_filter(d, ("en",), "lang")


@query(
    "dedupe",
    "SELECT doc_id, text FROM documents WHERE doc_id IN "
    "(SELECT min(doc_id) FROM documents GROUP BY text)",
)
def _dedupe(spark, sf_dir):
    d = t.read(spark, sf_dir, "documents").select("doc_id", "text")
    return rows.dedupe(d, "text", "doc_id")


@query(
    "valid_embedding",
    """SELECT vec_id, label, coalesce(len(v) = 64 AND len(list_filter(v, lambda x: x IS NULL
       OR isnan(x) OR isinf(x))) = 0, false) AS is_valid FROM (
       SELECT vec_id, label, CASE label WHEN 1 THEN NULL
         WHEN 2 THEN list_append(embedding::DOUBLE[], 'nan'::DOUBLE)
         WHEN 3 THEN list_concat(embedding[1:63]::DOUBLE[], ['nan'::DOUBLE])
         WHEN 4 THEN list_concat(embedding[1:63]::DOUBLE[], ['inf'::DOUBLE])
         WHEN 5 THEN list_concat(embedding[1:63]::DOUBLE[], [NULL::DOUBLE])
         ELSE embedding::DOUBLE[] END AS v FROM embeddings)""",
)
def _valid_embedding(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    head = F.slice(v, 1, 63)
    add = lambda x: F.concat(head, F.array(F.lit(x).cast("double")))
    lab = F.col("label")
    spoilt = (
        F.when(lab == 1, F.lit(None))
        .when(lab == 2, F.concat(v, F.array(F.lit(float("nan")))))
        .when(lab == 3, add(float("nan")))
        .when(lab == 4, add(float("inf")))
        .when(lab == 5, add(None))
        .otherwise(v)
    )
    e = t.read(spark, sf_dir, "embeddings").select("vec_id", "label", spoilt.alias("embedding"))
    return rows.valid_embeddings(e, 64).drop("embedding")


# ------------------------------------------------------------------ profiles


@query(
    "preview",
    "SELECT 'doc_id,text,lang,source,n_chars' AS column_names, count(*) AS total_rows "
    "FROM documents",
)
def _preview(spark, sf_dir):
    from themeloom.sources.scan import preview

    return preview(t.read(spark, sf_dir, "documents"))


@query(
    "documents_struct",
    """SELECT d.doc_id AS row_id, text AS page_content, coalesce(quality::VARCHAR, '') AS quality,
       CASE WHEN quality IS NULL THEN 0 ELSE 1 END AS entries
       FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def _documents(spark, sf_dir):
    meta = t.read(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("row_id"),
        F.create_map(F.lit("quality"), F.col("quality").cast("string")).alias("metadata"),
    )
    docs = embed.documents(t.texts(spark, sf_dir).select("row_id", "text"), meta)
    m = F.col("document.metadata")
    return docs.select(
        "row_id",
        F.col("document.text").alias("page_content"),
        F.coalesce(m["quality"], F.lit("")).alias("quality"),
        F.size(m).alias("entries"),
    )


_PROFILE_SQL = f"""SELECT count(*) AS total_rows, 2::BIGINT AS total_columns,
  'lang,text' AS column_names, 'text' AS summary_column, count(text) AS summary_count,
  count(*) - count(text) AS empty_summaries, 0::BIGINT AS file_size FROM {_HOLES_SQL}"""


@query("profile", _PROFILE_SQL)
def _profile(spark, sf_dir):
    d = _holes(spark, sf_dir)
    return profile.profile(d, profile.detect_text_column(d))


@query(
    "missing_by_column",
    f"""SELECT 'lang' AS column_name, 'string' AS data_type, count(*) - count(lang) AS missing FROM {_HOLES_SQL} UNION ALL
      SELECT 'text', 'string', count(*) - count(text) FROM {_HOLES_SQL}""",
)
def _missing(spark, sf_dir):
    return profile.missing_by_column(_holes(spark, sf_dir))


@query(
    "validate",
    """SELECT true AS is_valid, CASE WHEN 1 - n / c > 0.5 THEN 'High missing data ratio: ' ||
      printf('%.1f', (c - n) / c * 100) || '%' ELSE '' END AS warnings, '' AS errors,
      round(n / c, 6) AS completeness, c AS row_count, n AS summary_count, 1::BIGINT AS column_count
      FROM (SELECT count(*) AS c, count(CASE WHEN lang = 'en' THEN text END) AS n FROM documents)""",
)
def _validate(spark, sf_dir):
    d = t.texts(spark, sf_dir).select(
        "row_id", F.when(F.col("lang") == "en", F.col("text")).alias("text")
    )
    v = profile.validate(profile.profile(d, "text"))
    return v.select(
        "is_valid",
        F.concat_ws("|", "warnings").alias("warnings"),
        F.concat_ws("|", "errors").alias("errors"),
        tidy(F.col("quality_metrics.completeness")).alias("completeness"),
        "quality_metrics.row_count",
        "quality_metrics.summary_count",
        "quality_metrics.column_count",
    )


@query(
    "data_summary",
    """WITH c AS (SELECT count(*) AS n, count(text) AS k FROM documents),
      v AS (SELECT unnest(['name = documents.parquet', 'bytes = 0', 'rows = ' || n, 'columns = 1',
        'text column = text', 'texts = ' || k, 'empty texts = ' || (n - k)]) AS value,
        unnest(range(7)) AS line FROM c)
      SELECT 0 AS part, line, 'file.' || value AS value FROM v UNION ALL
      SELECT 1, unnest(range(4)), 'checks.' || unnest(['valid = true',
        printf('complete = %.1f%%', k / n * 100), 'warnings = ', 'errors = ']) FROM c""",
)
def _data_summary(spark, sf_dir):
    facts = profile.profile(t.texts(spark, sf_dir).select("row_id", "text"), "text")
    return profile.data_summary(facts, profile.validate(facts), "documents.parquet")


@query(
    "longest_text_column",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(avg(length({c})), 6) AS mean_length FROM "
        f"(SELECT {c} FROM documents WHERE {c} IS NOT NULL ORDER BY doc_id LIMIT 10)"
        for c in ("text", "lang", "source")
    ),
)
def _longest(spark, sf_dir):
    found = profile.column_lengths(t.texts(spark, sf_dir), "row_id")
    return found.withColumn("mean_length", tidy(F.col("mean_length")))


@query(
    "length_stats",
    f"""SELECT count(*) AS total, count(*) FILTER (length(text) >= 10) AS valid,
      count(*) FILTER (coalesce(length(text), 0) < 10) AS invalid, min(length(text)) AS min_length,
      max(length(text)) AS max_length, round(avg(length(text)), 6) AS avg_length
      FROM {_HOLES_SQL}""",
)
def _length_stats(spark, sf_dir):
    s = profile.length_stats(_holes(spark, sf_dir))
    return s.withColumn("avg_length", tidy(F.col("avg_length")))
