"""Mix sources to target weights with hash-threshold histograms.

Sizes are word counts (null text: 0). A source's target is its share of all sizes by weight,
at most ``limit`` times its own size; what is above is shared again by weight. Whole copies
cover the integer part of target / size; for the rest a document is taken once more when the
hash of its id lies under its source's threshold. The threshold comes from sums of sizes by
(source, hash bucket): the bucket in which the budget ends is refined, nothing else is, and no
rows are sorted. The document at the end of the budget goes where the sum is nearer.

Cases: a null source is a source of its own, last in order; rows that repeat a doc_id share its
hash and are taken or left together; a null doc_id hashes as the empty text; a source of size 0
has target 0; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom.llm.common import WORD, unit_bits
from themeloom.runtime import cut

#: Hash bits dropped at each refinement of the 60-bit hash; a histogram has at most 2^16 buckets
#: of one source until the last level, where one bucket holds 2^-30 of its documents.
SHIFTS = (46, 30, 0)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], limit: int) -> DataFrame:
    """(key, source_size, target) from (key, source, source_size), one row a source.

    Sources in order of limit * size / weight: as long as the level that is left over for the
    rest lies above a source's limit, the source gets its limit; from the first other one on,
    all share the level. This equals resharing until nothing is above its limit.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn(
        "weight", F.get(F.lit(list(weights)), (F.row_number().over(by_name) - 1) % len(weights))
    ).withColumn("most", F.col("source_size") * limit)
    order = Window.orderBy(F.col("most") / F.col("weight"), "key")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    w = w.select(
        "key",
        "source_size",
        "weight",
        "most",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))).alias("left"),
        F.sum("weight").over(after).alias("sharing"),
    )
    open_ = F.col("left").cast("double") * F.col("weight") / F.col("sharing") <= F.col("most")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    level = F.first(F.when(open_, F.struct("left", "sharing")), ignorenulls=True).over(so_far)
    return w.withColumn("level", level).select(
        "key",
        "source_size",
        F.when(
            F.col("level").isNotNull(),
            F.col("level.left").cast("double") * F.col("weight") / F.col("level.sharing"),
        )
        .otherwise(F.col("most").cast("double"))
        .alias("target"),
    )


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(key, source_size, target, copies, edge, edge_in): the hash at which the budget ends."""
    plan = targets.select(
        "*",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
        .otherwise(0)
        .alias("copies"),
    ).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    plan = cut(plan)
    at = plan.select("key", "rest", F.lit(0).cast("long").alias("below"), F.lit(None).cast("long").alias("bucket"))
    last = None
    for shift in SHIFTS:
        part = sized.select("key", "size", "h")
        if last is None:
            part = part.join(at.select("key", "rest", "below"), "key")
        else:
            inside = at.select("key", "rest", "below", "bucket")
            part = part.withColumn("bucket", F.shiftright("h", last)).join(inside, ["key", "bucket"]).drop("bucket")
        summed = part.groupBy("key", F.shiftright("h", shift).alias("bucket")).agg(
            F.sum("size").alias("held"), F.first("rest").alias("rest"), F.first("below").alias("below")
        )
        upto = Window.partitionBy("key").orderBy("bucket")
        run = summed.withColumn("end", F.col("below") + F.sum("held").over(upto))
        at = run.where((F.col("end") > F.col("rest")) & (F.col("end") - F.col("held") <= F.col("rest"))).select(
            "key", "rest", (F.col("end") - F.col("held")).alias("below"), "bucket", "held"
        )
        at, last = cut(at), shift
    edge = at.select(
        "key",
        F.col("bucket").alias("edge"),
        (F.col("below") + F.col("held") - F.col("rest") < F.col("rest") - F.col("below")).alias("edge_in"),
    )
    return cut(plan.join(edge, "key", "left").select("key", "source_size", "target", "copies", "edge", "edge_in"))


def source_key(source: str = "source"):
    """Text form of a source that keeps null apart."""
    return F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source)))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: int = 3, salt: str = "") -> DataFrame:
    """The thresholds of a table (doc_id, text, source)."""
    sized = cut(
        docs.select(
            "source",
            source_key().alias("key"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            unit_bits(F.col("doc_id"), salt).alias("h"),
        )
    )
    per = cut(sized.groupBy("key", "source").agg(F.sum("size").alias("source_size")))
    return thresholds(sized, source_targets(per, weights, limit))


def copies_of(h, copies, edge, edge_in):
    """How often the mix takes a document."""
    more = (h < edge) | ((h == edge) & edge_in)
    return F.coalesce(copies, F.lit(0)) + F.when(more, 1).otherwise(0)


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: int = 3, salt: str = "") -> DataFrame:
    """doc_id, size, source_size, target, taken, one row a document."""
    edges = plan_mix(docs, weights, limit, salt)
    sized = docs.select(
        "doc_id",
        source_key().alias("key"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        unit_bits(F.col("doc_id"), salt).alias("h"),
    )
    n = copies_of(F.col("h"), F.col("copies"), F.col("edge"), F.col("edge_in"))
    return sized.join(edges, "key").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * n).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: int = 3, salt: str = "") -> DataFrame:
    """The documents of the mix with all their columns, repeated as often as they are taken."""
    edges = plan_mix(docs, weights, limit, salt)
    row = docs.select(
        F.struct(*docs.columns).alias("row"),
        source_key().alias("key"),
        unit_bits(F.col("doc_id"), salt).alias("h"),
    )
    n = copies_of(F.col("h"), F.col("copies"), F.col("edge"), F.col("edge_in")).cast("int")
    return (
        row.join(edges, "key")
        .select("row", n.alias("n"))
        .select("row", F.explode(F.array_repeat(F.lit(0), F.col("n"))))
        .select("row.*")
    )


SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source),
run AS (
  SELECT *, 3 * source_size AS most,
         (SELECT sum(source_size) FROM per) - coalesce(sum(3 * source_size) OVER o - 3 * source_size, 0) AS remaining,
         (SELECT sum(weight) FROM per) - (sum(weight) OVER o - weight) AS sharing
  FROM per WINDOW o AS (ORDER BY 3 * source_size / weight, source NULLS FIRST ROWS UNBOUNDED PRECEDING)),
first_open AS (
  SELECT remaining, sharing FROM run WHERE remaining::DOUBLE * weight / sharing <= most
  ORDER BY most / weight, source NULLS FIRST LIMIT 1),
targets AS (
  SELECT r.source, r.source_size,
         CASE WHEN r.most::DOUBLE / r.weight >= f.remaining::DOUBLE / f.sharing
              THEN f.remaining::DOUBLE * r.weight / f.sharing ELSE r.most::DOUBLE END AS target
  FROM run r CROSS JOIN first_open f),
spent AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS copies,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h RANGE UNBOUNDED PRECEDING) AS upto,
         sum(s.size) OVER (PARTITION BY s.source, s.h) AS held
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
rest AS (SELECT *, target - copies * source_size AS rest, upto - held AS below FROM spent)
SELECT doc_id, size, source_size, target,
       (size * (copies + CASE WHEN upto <= rest THEN 1
                              WHEN below <= rest AND upto - rest < rest - below THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rest
"""


def query(spark, sf_dir):
    from themeloom.llm.common import table

    return mix(table(spark, sf_dir, "documents"))
