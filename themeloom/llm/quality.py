"""Quality rules whose cut-offs have a proven risk.

A base rule drops short and repetitive texts. Further rules compare shares of a text (symbols,
capitals, exclamation marks, repeated words, repeated lines) with cut-offs that are chosen from
labelled documents for each stratum (language). Half of the labelled good documents propose
cut-offs, as quantiles, at several joint levels of strictness; the other half is the holdout. A
level is certified when the exact binomial tail P(Bin(n, risk) <= k), for k false rejections of n
by all rules together, is at most ``error`` divided by the number of strata, and all levels before
it are certified (fixed-sequence testing). With chance 1 - ``error``, no stratum's rules then
reject more than ``risk`` of its good documents. A stratum without a certified level has no
further rules.

Cases: null and empty texts have no words and fail the base rule; a null language is a stratum of
its own; rows that repeat a doc_id are judged one by one; labels that repeat one count once, with
the lower quality; an empty table gives an empty result; other columns pass untouched.
Trigrams are compared by 64-bit hash within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.llm.common import table
from themeloom.runtime import cut, fits, sized_broadcast

RISK, ERROR = 0.01, 0.05
#: Bytes of a labelled id, for broadcasts.
ID_BYTES = 16
#: Share of good documents at or below the cut-offs of a level, lenient to strict.
LEVELS = (0.9999, 0.9998, 0.9995, 0.999, 0.998, 0.997, 0.996, 0.995, 0.994, 0.993, 0.992, 0.99)
#: Rules and the values below which a cut-off never goes.
FLOORS = {"symbols": 0.02, "capitals": 0.3, "shouts": 0.05, "repeats": 0.3, "lines": 0.3}

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def left_out(text: Column, chars: str) -> Column:
    """Code points of a text without those of a set."""
    return F.char_length(F.translate(text, chars, ""))


def measures(docs: DataFrame) -> DataFrame:
    """The rows with a struct ``m``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    and the shares that the rules compare. Everything happens within the row: trigram hashes are
    sorted only where one repeats, and the words that repeated windows cover are counted once."""
    text = F.coalesce(F.col("row.text"), F.lit(""))
    words = F.array_remove(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), "")
    lines = F.filter(F.split(text, "\n"), lambda x: left_out(x, BLANKS) > 0)
    a = docs.select(F.struct(*docs.columns).alias("row")).select("row", words.alias("w"), lines.alias("l"))
    n = F.size("w")
    grams = F.when(
        n >= 3,
        F.transform(
            F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    b = a.select(
        "row",
        n.alias("n"),
        F.size("l").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).alias("dup"),
        grams.alias("g"),
    )
    pairs = F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    c = b.select(
        "row", "n", "n_lines", "dup", F.when(F.size(F.array_distinct("g")) < F.size("g"), pairs).alias("s")
    )
    twice = F.filter(
        F.col("s"),
        lambda e, j: e.x.eqNullSafe(F.get("s", j - 1)["x"]) | e.x.eqNullSafe(F.get("s", j + 1)["x"]),
    )
    d = c.select("row", "n", "n_lines", "dup", F.sort_array(F.transform(twice, lambda e: e.i)).alias("at"))
    covered = F.aggregate(
        F.transform("at", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("at", j + 1) - p, F.lit(3)))),
        F.lit(0),
        lambda s, x: s + x,
    )
    e = d.select(
        "row",
        "n",
        "n_lines",
        "dup",
        F.coalesce(covered, F.lit(0)).alias("rep"),
        left_out(text, BLANKS).alias("chars"),
        (F.char_length(text) - left_out(text, SYMBOLS)).alias("sym"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).alias("caps"),
        (F.char_length(text) - left_out(text, "!")).alias("bang"),
    )

    def share(x: str, of: str) -> Column:
        return F.col(x) / F.greatest(F.col(of), F.lit(1))

    shares = {
        "symbols": share("sym", "chars"),
        "capitals": share("caps", "chars"),
        "shouts": share("bang", "chars"),
        "repeats": share("rep", "n"),
        "lines": share("dup", "n_lines"),
    }
    return e.select(
        "row",
        F.struct(
            F.col("n").cast("long").alias("n_words"),
            F.col("chars").cast("long").alias("word_chars"),
            F.col("sym").cast("long").alias("n_symbols"),
            F.col("dup").cast("long").alias("n_dup_lines"),
            F.col("rep").cast("long").alias("n_repeat_words"),
            F.array(*[shares[f] for f in FLOORS]).alias("shares"),
        ).alias("m"),
    )


def base_failed() -> Column:
    return (F.col("m.n_words") < 50) | (F.col("m.n_repeat_words") * 100 > F.col("m.n_words") * 50)


def over(shares: Column, cuts: Column) -> Column:
    return F.exists(F.arrays_zip(shares.alias("v"), cuts.alias("c")), lambda x: x["v"] > x["c"])


def tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exactly, summed from its terms; 1 where k is above the mean."""
    odds = F.log(F.lit(p / (1 - p)))
    first = F.struct((n * F.log(F.lit(1 - p))).alias("t"), F.exp(n * F.log(F.lit(1 - p))).alias("s"))

    def add(acc, j):
        t = acc["t"] + F.log((n - j + 1) / j) + odds
        return F.struct(t.alias("t"), (acc["s"] + F.exp(t)).alias("s"))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.aggregate(terms, first, add)["s"])


def certify(good: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, cuts, level, n, k, p): the strictest certified level of every stratum.

    ``good`` has (stratum, half, shares) of labelled good documents, half 0 proposes.
    """
    floors = list(FLOORS.values())
    propose, hold = good.where("half = 0"), good.where("half = 1")
    # how often each share occurs; of those up to the floor only the greatest can decide a cut-off
    rules = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f).alias("floor"), F.col("shares")[i].alias("v")) for i, f in enumerate(floors)])
    seen = propose.select("stratum", F.inline(rules)).groupBy("stratum", "i", "floor", "v").agg(F.count("*").alias("n"))
    low = seen.where("v <= floor").groupBy("stratum", "i").agg(F.max("v").alias("v"), F.sum("n").alias("n"))
    seen = low.unionByName(seen.where("v > floor").select("stratum", "i", "v", "n"))
    q = seen.groupBy("stratum", "i").agg(F.percentile("v", F.lit(list(LEVELS)), F.col("n")).alias("q"))
    levels = q.groupBy("stratum").agg(*[F.max(F.when(F.col("i") == i, F.col("q"))).alias(f"q{i}") for i in range(len(floors))])
    cuts = levels.select(
        "stratum",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(t).alias("level"),
                        F.array(*[F.greatest(F.lit(f), F.col(f"q{i}")[t]) for i, f in enumerate(floors)]).alias("cuts"),
                    )
                    for t in range(len(LEVELS))
                ]
            )
        ).alias("c"),
    ).select("stratum", "c.*")
    held = (
        hold.join(cuts, "stratum")
        .groupBy("stratum", "level")
        .agg(
            F.count("*").alias("n"),
            F.sum(over(F.col("shares"), F.col("cuts")).cast("long")).alias("k"),
            F.first("cuts").alias("cuts"),
        )
        .withColumn("p", tail(F.col("n"), F.col("k"), risk))
    )
    so_far = Window.partitionBy("stratum").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    # a row for each stratum and level
    tested = held.withColumn("place", F.dense_rank().over(Window.orderBy("stratum")))
    tested = tested.withColumn("strata", F.max("place").over(Window.partitionBy())).withColumn("worst", F.max("p").over(so_far))
    sure = tested.where(F.col("worst") <= error / F.col("strata"))
    best = sure.groupBy("stratum").agg(F.max_by(F.struct("level", "cuts", "n", "k", "p"), "level").alias("b"))
    return best.select("stratum", "b.*")


def stratum(lang: Column) -> Column:
    return F.coalesce(lang.cast("string"), F.lit(""))


def good_ids(labels: DataFrame) -> DataFrame:
    """(doc_id): documents that are labelled good and nothing else."""
    marked = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return cut(marked.where("quality = 1").select("doc_id"))


def measured(docs: DataFrame) -> DataFrame:
    """(row, m) without the texts, written: a few numbers a document."""
    return cut(measures(docs.select("doc_id", "text", "lang")).select(F.struct("row.doc_id", "row.lang").alias("row"), "m"))


def fit_measured(held: DataFrame, ids: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Cut-offs from all measured documents whose id is in ``ids``."""
    known = held.select("*", F.col("row.doc_id").alias("doc_id")).join(sized_broadcast(ids, ID_BYTES), "doc_id", "left_semi")
    good = known.where(~base_failed()).select(
        stratum(F.col("row.lang")).alias("stratum"),
        F.pmod(F.xxhash64("row.doc_id", F.lit(1)), F.lit(2)).alias("half"),
        F.col("m.shares").alias("shares"),
    )
    return cut(certify(cut(good), risk, error))


def fit(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Cut-offs from all documents that are labelled good. More of these than a broadcast holds meet
    the measures of all documents, so that no text is shuffled."""
    ids = good_ids(labels)
    some = docs.join(F.broadcast(ids), "doc_id", "left_semi") if fits(ids, ID_BYTES) else docs
    return fit_measured(measured(some), ids, risk, error)


def judge(docs: DataFrame, cuts: DataFrame) -> DataFrame:
    """(row, m, base_failed, kept) of every document."""
    return verdicts(measures(docs), cuts)


def verdicts(held: DataFrame, cuts: DataFrame) -> DataFrame:
    """(row, m, base_failed, kept) of measured documents; ``cuts`` has a row a stratum."""
    small = sized_broadcast(cuts.select(F.col("stratum").alias("of"), "cuts"), 64, extra=F.length("of"))
    m = held.withColumn("stratum", stratum(F.col("row.lang")))
    bad = base_failed()
    rejected = F.coalesce(over(F.col("m.shares"), F.col("cuts")), F.lit(False))
    return m.join(small, F.col("stratum") == F.col("of"), "left").select(
        "row", "m", bad.alias("base_failed"), (bad.cast("int") + rejected.cast("int") == 0).alias("kept")
    )


def quality(docs: DataFrame, labels: DataFrame, **fitted) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    held = measured(docs)
    return verdicts(held, fit_measured(held, good_ids(labels), **fitted)).select(
        "row.doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", "base_failed", "kept"
    )


def kept_documents(docs: DataFrame, labels: DataFrame, **fitted) -> DataFrame:
    """The documents that pass, with all their columns."""
    return judge(docs, fit(docs, labels, **fitted)).where("kept").select("row.*")


def query(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
