"""Corpus-level text operators: language, lemmas, key phrases, preprocessing records."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from themeloom.functions import fixed
from themeloom.functions import text as tx
from themeloom.runtime import BROADCAST_BYTES, cut, fits, sized_broadcast

#: Rough bytes of a (token, language, two doubles) row in a broadcast hash table.
TOKEN_ROW_BYTES = 160

#: Languages that a row is scored for at once, and steps of a unit of gain in which common tokens are told.
MOST_LANGUAGES, BANDS = 1000, 16

#: Tokens and rows of an Arrow batch that are looked up at once.
TOKENS_AT_ONCE, ROWS_AT_ONCE = 1_000_000, 4096


# ---------------------------------------------------------------- language


def train_language_model(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(token, lang, gain, cost): scores with add-one smoothing, in long form.

    ``gain`` is the log of the token's count in the language plus one; ``cost``, charged for
    every token of a text, the log of the language's tokens plus the vocabulary. Each language
    also has a row with a NULL token and no gain. Any number of languages will do.
    """
    counts = cut(
        df.where(F.col(lang).isNotNull())
        .select(F.col(lang).alias("lang"), F.explode(tx.letter_runs(F.col(text))).alias("token"))
        .groupBy("lang", "token")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if counts.isEmpty():
        raise ValueError("no labelled text to learn from")
    vocabulary = counts.agg(F.countDistinct("token").alias("v")).scalar()
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    costs = cut(totals.select("lang", F.log(F.col("total") + vocabulary).alias("cost")))
    seen = counts.join(costs, "lang").select("token", "lang", F.log1p("n").alias("gain"), "cost")
    bare = costs.select(F.lit(None).cast("string").alias("token"), "lang", F.lit(0.0).alias("gain"), "cost")
    return cut(seen.unionByName(bare))


def detect_language(
    df: DataFrame, model: DataFrame, text: str = "text", row_id: str = "row_id", default: str = "en"
) -> DataFrame:
    """(row_id, language): highest summed token score, ``default`` without tokens; ties to the
    first language by name."""
    runs = df.select(F.col(row_id).alias("row_id"), tx.letter_runs(F.col(text)).alias("_runs"))
    return with_language(runs, model, default).select("row_id", "language")


def with_language(df: DataFrame, model: DataFrame, default: str = "en") -> DataFrame:
    """``df`` with ``language``, told by the letter runs in its column ``_runs``, which goes; written once.

    The model's commonest tokens, as many as may be broadcast, are looked up row by row in Arrow
    batches. A rarer token gains no more than the rarest of them, so most rows are told by these alone;
    only the other rows' rarer tokens are joined with the rest of the model. No text is shuffled.
    """
    if fits(model, TOKEN_ROW_BYTES):
        return cut(_looked_up(df, model, 0.0, default).drop("_rare", "_loss"))
    if not fits(model.where("token IS NULL"), 1, MOST_LANGUAGES):
        return _language_by_join(df, model, default)
    tokens = cut(
        model.where("token IS NOT NULL")
        .groupBy("token")
        .agg(F.max("gain").alias("top"), F.collect_list(F.struct("lang", "gain")).alias("entries"))
        .withColumn("band", F.floor(F.col("top") * BANDS).cast("bigint"))
    )
    # bands of gains, the highest first, as long as their rows fit
    floor, room = None, BROADCAST_BYTES // TOKEN_ROW_BYTES
    bands = tokens.groupBy("band").agg(F.sum(F.size("entries")).alias("rows")).collect()  # some 20 a unit of a logarithm
    for r in sorted(bands, key=lambda r: -r["band"]):
        room -= r["rows"]
        if room < 0:
            break
        floor = r["band"]
    least = F.lit(False) if floor is None else F.col("band") >= floor
    rare = tokens.where(~least)
    common = tokens.where(least).select("token", F.inline("entries")).join(F.broadcast(model.where("token IS NULL").select("lang", "cost")), "lang")
    common = common.select("token", "lang", "gain", "cost").unionByName(model.where("token IS NULL").select("token", "lang", "gain", "cost"))
    most = rare.agg(F.max("top")).first()[0] or 0.0
    looked = cut(_looked_up(df.withColumn("_row", F.monotonically_increasing_id()), common, most, default))
    open_ = looked.where("_rare IS NOT NULL")
    gains = (
        open_.select("_row", F.explode("_rare").alias("token"))
        .groupBy("_row", "token")
        .agg(F.count(F.lit(1)).alias("_k"))
        .join(rare.select("token", "entries"), "token")
        .select("_row", "_k", F.inline("entries"))
        .groupBy("_row", "lang")
        .agg(F.sum(F.col("_k") * F.col("gain")).alias("more"))
    )
    losses = open_.select("_row", F.inline("_loss")).join(gains, ["_row", "lang"], "left")
    loss = F.struct((F.col("loss") - F.coalesce("more", F.lit(0.0))).alias("loss"), F.col("lang"))
    told = cut(losses.groupBy("_row").agg(F.min(loss)["lang"].alias("_told")))
    told = sized_broadcast(told, 64)
    kept = [F.col(c) for c in df.columns if c != "_runs"]
    return looked.join(told, "_row", "left").select(*kept, F.coalesce("language", "_told").alias("language"))


def _looked_up(df: DataFrame, model: DataFrame, most: float, default: str) -> DataFrame:
    """``df`` without ``_runs``, with ``language`` where a model that is small enough to broadcast tells
    it, however much up to ``most`` every token unknown to it may gain; elsewhere with these tokens
    ``_rare`` and the ``_loss`` of every language."""
    rows = model.toArrow()
    known = rows.filter(pc.is_valid(rows["token"]))
    bare = rows.filter(pc.is_null(rows["token"])).sort_by("lang")
    langs, cost = bare["lang"].to_pylist(), bare["cost"].to_numpy()
    known = known.append_column("l", pc.index_in(known["lang"], value_set=bare["lang"])).sort_by([("token", "ascending"), ("l", "ascending")])
    token = known["token"].combine_chunks()
    names = token.unique()
    starts = np.r_[0, np.flatnonzero(np.diff(np.asarray(pc.index_in(token, value_set=names)))) + 1, len(token)]
    share = df.sparkSession.sparkContext.broadcast(
        (names, starts, known["l"].to_numpy(), known["gain"].to_numpy(), langs, cost)
    )
    kept = [c for c in df.columns if c != "_runs"]
    lost = T.StructType([T.StructField("lang", T.StringType()), T.StructField("loss", T.DoubleType())])
    added = T.StructType([
        T.StructField("language", T.StringType()), T.StructField("_rare", T.ArrayType(T.StringType())), T.StructField("_loss", T.ArrayType(lost)),
    ])
    schema = T.StructType([*(df.schema[c] for c in kept), *added.fields])
    kinds = to_arrow_schema(added)

    def told(runs: pa.ListArray) -> list[pa.Array]:
        names, starts, lang, gain, langs, cost = share.value
        many = np.asarray(pc.fill_null(pc.list_value_length(runs), 0)).astype(np.int64)
        row = np.repeat(np.arange(len(runs)), many)
        flat = runs.flatten()
        at = pc.index_in(flat, value_set=names)
        seen = np.asarray(pc.is_valid(at))
        unseen = np.flatnonzero(~seen)
        far = np.bincount(row[unseen], minlength=len(runs)) * most
        behind = row[unseen]
        at, row = np.asarray(pc.fill_null(at, 0)).astype(np.int64)[seen], row[seen]
        width = starts[at + 1] - starts[at]
        entry = np.arange(width.sum()) + np.repeat(starts[at] - (np.cumsum(width) - width), width)
        cell = np.repeat(row, width) * len(langs) + lang[entry]
        total = np.bincount(cell, gain[entry], len(runs) * len(langs)).reshape(len(runs), len(langs))
        loss = many[:, None] * cost - total
        best = loss.argmin(axis=1)
        second = np.partition(loss, 1, axis=1)[:, 1] if len(langs) > 1 else np.full(len(runs), np.inf)
        # room for rounding, since the order of sums differs
        left = (far > 0) & (second - loss.min(axis=1) <= far + 1e-9 * (1 + many * cost.max(initial=0)))
        said = [None if o else langs[i] if n else default for i, n, o in zip(best.tolist(), many.tolist(), left.tolist())]
        mine = left[behind]
        ends = np.r_[0, np.cumsum(np.bincount(behind[mine], minlength=len(runs)))]
        rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.take(pa.array(unseen[mine])), mask=pa.array(~left))
        lost = [[{"lang": x, "loss": y} for x, y in zip(langs, r)] if o else None for r, o in zip(loss.tolist(), left.tolist())]
        return [pa.array(said, pa.string()), rare.cast(kinds.field("_rare").type), pa.array(lost, kinds.field("_loss").type)]

    rows_at_once = max(1, ROWS_AT_ONCE // (1 + len(langs) // MOST_LANGUAGES))

    def run(batches):
        for big in batches:
            many = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(big["_runs"]), 0)))
            at = 0
            while at < big.num_rows:
                done = many[at - 1] if at else 0
                size = max(1, int(np.searchsorted(many, done + TOKENS_AT_ONCE)) - at)
                b = big.slice(at, min(size, rows_at_once))
                at += b.num_rows
                yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), *told(b["_runs"])], [*kept, *kinds.names])

    return df.select(*kept, "_runs").mapInArrow(run, schema)


def _language_by_join(df: DataFrame, model: DataFrame, default: str) -> DataFrame:
    """Gains fold to one row per text and language that knows one of its tokens. Among the
    languages that know none, the cheapest is the best, so one language stands for all of them."""
    known = model.where("token IS NOT NULL")
    cheapest = (
        model.where("token IS NULL").agg(F.min(F.struct("cost", "lang")).alias("least")).scalar()
    )
    tokens = df.select(
        "row_id",
        F.greatest(F.coalesce(F.size("_runs"), F.lit(0)), F.lit(0)).alias("_n"),
        F.explode_outer("_runs").alias("token"),
    )
    folded = tokens.groupBy("row_id", "_n", "token").agg(F.count(F.lit(1)).alias("_k"))
    sums = (
        folded.join(known, "token", "left")
        .groupBy("row_id", "lang")
        .agg(F.max("_n").alias("_n"), F.sum(F.col("_k") * F.col("gain")).alias("gain"), F.max("cost").alias("cost"))
    )
    loss = F.struct((F.col("_n") * F.col("cost") - F.col("gain")).alias("loss"), F.col("lang"))
    best = (
        sums.groupBy("row_id")
        .agg(
            F.max("_n").alias("_n"),
            F.min(F.when(F.col("lang").isNotNull(), loss)).alias("_best"),
        )
        .withColumn("_bare", cheapest)
    )
    rest = F.struct((F.col("_n") * F.col("_bare.cost")).alias("loss"), F.col("_bare.lang").alias("lang"))
    told = best.select(
        "row_id",
        F.when(F.col("_n") > 0, F.least(F.coalesce("_best", rest), rest)["lang"])
        .otherwise(F.lit(default))
        .alias("language"),
    )
    return df.drop("_runs").join(told, "row_id", "left")


# ---------------------------------------------------------------- lemmas


def lemma_map(vocabulary: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """(word, lemma) of the words that have one, both from a distinct ``word`` column.

    A noun ending is replaced only if the result is in the lexicon (the corpus vocabulary
    by default); the shortest result wins, then the earlier rule.
    """
    lexicon = vocabulary if lexicon is None else lexicon
    w = F.col("word")
    options = F.array_compact(
        F.array(
            *[
                F.when(
                    w.endswith(old) & (F.length(w) > len(old)),
                    F.struct(
                        F.lit(i).alias("rule"),
                        F.concat(F.expr(f"left(word, length(word) - {len(old)})"), F.lit(new)).alias(
                            "lemma"
                        ),
                    ),
                )
                for i, (old, new) in enumerate(fixed.NOUN_ENDINGS)
            ]
        )
    )
    candidates = vocabulary.select("word", F.inline(options)).where("lemma <> ''")
    real = candidates.join(
        lexicon.select(F.col("word").alias("lemma")).distinct(), "lemma", "left_semi"
    )
    return real.groupBy("word").agg(
        F.min(F.struct(F.length("lemma").alias("n"), "rule", "lemma"))["lemma"].alias("lemma")
    )


def row_words(
    df: DataFrame, text: str = "text", row_id: str = "row_id", extra_stops: list[str] | None = None
) -> DataFrame:
    """(row_id, words): the non-stop words of every row, in order."""
    words = tx.drop_stop_words(tx.word_tokens(F.col(text)), extra_stops)
    return df.select(F.col(row_id).alias("row_id"), words.alias("words"))


def vocabulary(df: DataFrame, column: str = "words") -> DataFrame:
    """(word, n): the distinct words of an array column; repeats fold before the shuffle."""
    return df.select(F.explode(column).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def lemmatize(df: DataFrame, lexicon: DataFrame | None = None, column: str = "words") -> DataFrame:
    """``df`` with the words of an array column replaced by their lemmas.

    Only the vocabulary is shuffled. A lemma table that is small enough to broadcast is looked up in
    Arrow batches, row by row; a larger one is joined by word and the rows are put together again.
    """
    lemmas = cut(lemma_map(cut(vocabulary(df, column).select("word")), lexicon))
    if not fits(lemmas, 16, BROADCAST_BYTES, F.octet_length("word") + F.octet_length("lemma")):
        return _lemmas_by_join(df, lemmas, column)
    table = lemmas.toArrow()
    share = df.sparkSession.sparkContext.broadcast((table["word"].combine_chunks(), table["lemma"].combine_chunks()))

    def run(batches):
        words, lemma = share.value
        for b in batches:
            lists = b[column]
            flat, many = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0)
            found = pc.coalesce(lemma.take(pc.index_in(flat, value_set=words)), flat)
            ends = pa.array(np.r_[0, np.cumsum(np.asarray(many))], pa.int32())
            done = pa.ListArray.from_arrays(ends, found, mask=pc.is_null(lists))
            yield b.set_column(b.schema.get_field_index(column), column, done)

    return df.mapInArrow(run, df.schema)


def _lemmas_by_join(df: DataFrame, lemmas: DataFrame, column: str) -> DataFrame:
    each = df.select("row_id", F.posexplode(column).alias("pos", "word")).join(lemmas, "word", "left")
    parts = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("lemma", "word").alias("lemma"))))
    lists = each.groupBy("row_id").agg(F.transform(parts, lambda s: s["lemma"]).alias("_done"))
    none = F.when(F.col(column).isNotNull(), F.array().cast("array<string>"))
    joined = df.join(lists, "row_id", "left").withColumn(column, F.coalesce("_done", none))
    return joined.select(*df.columns)


def lemma_counts(df: DataFrame, lexicon: DataFrame | None = None, column: str = "words") -> DataFrame:
    """(lemma, n, forms): occurrences and distinct words of every lemma."""
    seen = cut(vocabulary(df, column))
    lemmas = lemma_map(seen.select("word"), lexicon)
    return (
        seen.join(lemmas, "word", "left")
        .groupBy(F.coalesce("lemma", "word").alias("lemma"))
        .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("forms"))
    )


# ---------------------------------------------------------------- key phrases


def ranked_words(words: Column, k: int = 10) -> Column:
    """The k most frequent words longer than two letters as structs (phrase, n), ties by first
    appearance. Counted within the row: sorted words, and the places where the word changes."""
    long = F.filter(words, lambda w: F.length(w) > 2)
    ordered = F.array_sort(F.transform(long, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def changes(s):
        place = F.sequence(F.lit(0), F.size(s) - 1)
        new = F.filter(place, lambda i: (i == 0) | (F.get(s, i)["w"] != F.get(s, i - 1)["w"]))
        return F.struct(s.alias("s"), F.when(F.size(s) > 0, new).otherwise(F.array().cast("array<int>")).alias("b"))

    def counted(x):
        def one(i, j):
            word = F.get(x["s"], i)
            less = i - F.coalesce(F.get(x["b"], j + 1), F.size(x["s"]))
            return F.struct(less.alias("less"), word["i"].alias("first"), word["w"].alias("phrase"))

        best = F.slice(F.array_sort(F.transform(x["b"], one)), 1, k)
        return F.transform(best, lambda r: F.struct(r["phrase"].alias("phrase"), (-r["less"]).cast("bigint").alias("n")))

    return tx.bound(tx.bound(ordered, changes), counted)


def key_phrases(df: DataFrame, k: int = 10, words: str = "words") -> DataFrame:
    """(row_id, rank, phrase, n): ``ranked_words`` as rows."""
    ranked = df.select("row_id", F.posexplode(ranked_words(F.col(words), k)).alias("rank", "_p"))
    return ranked.select("row_id", (F.col("rank") + 1).alias("rank"), "_p.phrase", "_p.n")


def group_terms(df: DataFrame, group: str, text: str = "text", k: int = 10) -> DataFrame:
    """(group, rank, term, n): leading words of each group of texts.

    Counts combine before the shuffle and the ranking keeps k rows per group and task
    before it moves anything, so one group may hold most of the texts.
    """
    words = tx.drop_stop_words(tx.word_tokens(tx.clean_text(F.col(text))))
    counts = (
        df.select(F.col(group), F.explode(words).alias("term"))
        .where(F.length("term") > 2)
        .groupBy(group, "term")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    w = Window.partitionBy(group).orderBy(F.desc("n"), "term")
    return (
        counts.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .select(group, "rank", "term", "n")
    )


# ---------------------------------------------------------------- preprocessing


def preprocess(
    df: DataFrame,
    text: str = "text",
    row_id: str = "row_id",
    model: DataFrame | None = None,
    lexicon: DataFrame | None = None,
    extra_stops: list[str] | None = None,
    repair: bool = True,
    max_phrases: int = 10,
) -> DataFrame:
    """Full record per text: cleaned_text, sentences, words, key_phrases, language,
    word_count, sentence_count. NULL or '' gives the empty record.

    Language is told on the cleaned text before boilerplate goes; without a model it is
    ``en``. Texts are tokenised once and stay where they are; only the vocabulary is shuffled.
    """
    told = [] if model is None else [tx.letter_runs(F.col("_clean")).alias("_runs")]
    base = _cleaned(df, text, row_id, repair, *told)
    words = tx.drop_stop_words(tx.word_tokens(F.col("cleaned_text")), extra_stops)
    base = base.withColumn("words", words)
    out = with_language(base, model) if model is not None else cut(base).withColumn("language", F.lit("en"))
    out = lemmatize(out, lexicon)
    return out.select(
        "row_id",
        "cleaned_text",
        tx.sentences(F.col("cleaned_text")).alias("sentences"),
        "words",
        F.transform(ranked_words(F.col("words"), max_phrases), lambda p: p["phrase"]).alias("key_phrases"),
        "language",
    ).select(
        "*",
        F.size("words").alias("word_count"),
        F.size("sentences").alias("sentence_count"),
    )


def _cleaned(df: DataFrame, text: str, row_id: str, repair: bool, *more: Column) -> DataFrame:
    cleaned = df.select(
        F.col(row_id).alias("row_id"), tx.clean_text(F.col(text), repair).alias("_clean")
    )
    return cleaned.select("row_id", tx.remove_boilerplate(F.col("_clean")).alias("cleaned_text"), *more)


def record_sizes(
    df: DataFrame, text: str = "text", row_id: str = "row_id", extra_stops: list[str] | None = None, repair: bool = True
) -> DataFrame:
    """(row_id, word_count, sentence_count) of the records of ``preprocess``; lemmas change neither."""
    base = _cleaned(df, text, row_id, repair)
    words = tx.drop_stop_words(tx.word_tokens(F.col("cleaned_text")), extra_stops)
    return base.select(
        "row_id", F.size(words).alias("word_count"), F.size(tx.sentences(F.col("cleaned_text"))).alias("sentence_count")
    )


def corpus_statistics(records: DataFrame) -> DataFrame:
    """One row: totals and means per text (0 without texts)."""
    n = F.count(F.lit(1))
    words, sents = F.sum("word_count"), F.sum("sentence_count")
    per_text = lambda s: F.when(n > 0, s / n).otherwise(F.lit(0.0))
    return records.agg(
        n.alias("total_texts"),
        F.coalesce(words, F.lit(0)).cast("bigint").alias("total_words"),
        F.coalesce(sents, F.lit(0)).cast("bigint").alias("total_sentences"),
        per_text(words).alias("avg_words_per_text"),
        per_text(sents).alias("avg_sentences_per_text"),
    )
