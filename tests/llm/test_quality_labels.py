from pyspark.sql import functions as F

from themeloom.llm import quality


def test_cut_offs_come_from_every_labelled_document(spark):
    """45,000 good documents, and the share of capitals among them that the whole table has."""
    n = 45_000
    ids = spark.range(n).withColumnRenamed("id", "doc_id")
    # words of five letters; in one text of 500 a tenth of the letters beyond the floor are capitals
    words = F.concat(F.lit("w"), F.pmod(F.xxhash64("doc_id"), F.lit(1000)).cast("string"), F.lit(" "))
    docs = ids.select("doc_id", F.repeat(words, 3).alias("text"), F.lit("en").alias("lang"))
    labels = ids.select("doc_id", F.lit(1).alias("quality"))
    assert quality.good_ids(labels).count() == n
    half = ids.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).alias("half"))
    held = docs.select(
        F.struct("doc_id", "lang").alias("row"),
        F.struct(
            F.lit(60).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_repeat_words"),
            F.array(*[(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(10_000)) / 10_000).alias("v")] * 5).alias("shares"),
        ).alias("m"),
    )
    cuts = quality.fit_measured(held, quality.good_ids(labels)).first()
    assert cuts["n"] == half.where("half = 1").count()
    shares = held.join(half, F.col("row.doc_id") == F.col("doc_id")).where("half = 0")
    at = quality.LEVELS[cuts["level"]]
    want = shares.agg(F.percentile(F.col("m.shares")[0], at)).first()[0]
    assert abs(cuts["cuts"][0] - max(0.02, want)) < 1e-12
