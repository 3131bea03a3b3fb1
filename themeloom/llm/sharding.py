"""Shards of near-equal bytes from sampled splitters.

Records are ordered by (hash of the text, hash of the id). Key samples, drawn with a chance
proportional to the record's bytes, give quantile boundaries of many small ranges; a text that
alone outweighs a range gets one of its own. The bytes of every range are then counted exactly, and
whole ranges go to shards in order, each to the shard in which its middle byte falls. Equal texts
are in one range and so share a shard. Only a text that, with its copies, outweighs a sixteenth of a
shard is divided, by the id hash, since sizes could not come near each other otherwise.

Cases: a null text has no bytes, size 8 and CRC 0; a null doc_id is kept; repeated rows take
slots of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom.llm.common import interval, table, unit_bits
from themeloom.runtime import cut

#: Ranges for each shard, and samples for each range: they bound the sample and the splitters. The
#: part of a shard from which one text is divided.
RANGES, SAMPLES, WHOLE = 128, 16, 1 / 16
SPAN = 1 << 60


def splitters(base: DataFrame, total: int, ranges: int) -> list[int]:
    """Ascending boundaries of at most 3 * ranges key ranges, from size-weighted samples.

    The sample has ranges * SAMPLES draws in the mean, whatever the size of the table.
    """
    rate = ranges * SAMPLES / max(total, 1)
    chance = unit_bits(F.col("doc_id"), "draw") / float(SPAN)
    drawn = base.select("k", F.floor(F.col("size") * rate + chance).alias("n")).where("n > 0")
    keys = drawn.groupBy("k").agg(F.sum("n").alias("n"))
    at = keys.select(
        "k",
        "n",
        F.sum("n").over(Window.orderBy("k")).alias("end"),
        F.sum("n").over(Window.partitionBy()).alias("all"),
    ).select("k", "n", "all", (F.col("end") - F.col("n")).alias("begin"), "end")
    step = F.col("all") / ranges
    first, after = F.floor(F.col("begin") / step), F.floor(F.col("end") / step)
    hot = F.col("n") >= step
    got = at.where((first < after) | hot).select("k", hot.alias("hot")).collect()
    return sorted({k for r in got for k in ((r.k, r.k + 1) if r.hot else (r.k,))})


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, one row a document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = cut(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            unit_bits(F.col("text")).alias("k"),
            unit_bits(F.col("doc_id"), "place").alias("d"),
        )
    )
    total = base.agg(F.sum("size").alias("b")).first().b or 0
    ranges = shards * RANGES
    bounds = splitters(base, total, ranges)
    placed = base.withColumn("r", interval(bounds, F.col("k")))

    most = max(1.0, total / shards * WHOLE)
    held = placed.groupBy("r").agg(F.sum("size").alias("b"), (F.min("k") == F.max("k")).alias("single"))
    divided = F.when(F.col("single") & (F.col("b") > most), F.ceil(F.col("b") / most)).otherwise(F.lit(1))
    parts = F.broadcast(held.select("r", divided.alias("parts")))
    cell = F.floor(F.col("d") / float(SPAN) * F.col("parts")).cast("long")
    cells = placed.join(parts, "r").withColumn("s", cell).drop("parts")

    order = Window.orderBy("r", "s")
    counted = cells.groupBy("r", "s").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    end = F.sum("b").over(order)
    middle = (end - F.col("b") / 2) * shards / float(max(total, 1))
    homes = counted.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle)).cast("int"))
    inside = Window.partitionBy("shard").orderBy("r", "s")
    homes = cut(homes.select("r", "s", "shard", (F.sum("n").over(inside) - F.col("n")).alias("first_slot")))

    row = F.row_number().over(Window.partitionBy("r", "s").orderBy("k", "d", "doc_id")) - 1
    return (
        cells.withColumn("row", row)
        .join(F.broadcast(homes), ["r", "s"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("first_slot") + F.col("row")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def query(spark, sf_dir):
    return shard(table(spark, sf_dir, "documents"))
