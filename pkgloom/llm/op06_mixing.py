"""Mixing sources to target weights by capped water-filling.

Targets: each source wants its share of the total; a source that would exceed its cap (epochs times its size) is
clamped there, and what it leaves goes to the others in proportion to their weights, until none is above. Repetitions:
every document is taken whole floor(target / size) times; the fractional repetition walks the source's documents in a
seeded order until the target is met, so that only the last one is taken in part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settled, stored, table

WORD = r"[^\x20\x09-\x0D]+"
#: Buckets of a source's seeded order; sums of buckets find the one bucket in which the fractional repetition ends.
ORDER_BUCKETS = 4096


def water_fill(sizes: list[int], weights: list[float], total: float, epochs: float) -> list[float]:
    """Targets: proportional to weights, clamped at epochs * size, the excess reshared until none is above."""
    target, free, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0 and weights[i] > 0], float(total)
    while free:
        per = left / sum(weights[i] for i in free)
        over = [i for i in free if weights[i] * per > epochs * sizes[i]]
        for i in over or free:
            target[i] = epochs * sizes[i] if over else weights[i] * per
        left -= sum(epochs * sizes[i] for i in over)
        free = [i for i in free if i not in set(over)] if over else []
    return target


def sized(docs: DataFrame, text: str = "text", id: str = "doc_id", source: str = "source") -> DataFrame:
    return docs.select(F.col(id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def mix_sources(spark: SparkSession, rows: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, epochs: float = 2.0, seed: int = 0) -> DataFrame:
    """rows (doc_id, source, size) with source_size, target and taken.

    Sources in code point order, null last, get the weights in turn. The totals by source (one row each) are the only
    thing that comes to the driver. A source of size 0 has target 0 and takes nothing; ties in the seeded order go by
    doc_id and size; an empty table gives an empty result.
    """
    rows = stored(spark, rows)
    sums = rows.groupBy("source").agg(F.sum("size").alias("size")).collect()
    sums.sort(key=lambda r: (r[0] is None, (r[0] or "").encode()))
    targets = water_fill([r[1] for r in sums], [weights[i % len(weights)] for i in range(len(sums))], share * sum(r[1] for r in sums), epochs)
    plan = spark.createDataFrame([(r[0], r[1], float(t)) for r, t in zip(sums, targets, strict=True)], "p_source string, source_size long, target double")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("rest", F.greatest(F.lit(0), F.round(F.col("target")).cast("long") - F.col("whole") * F.col("source_size")))
    order = F.xxhash64(F.lit(seed), "doc_id", "size")
    rows = rows.withColumn("h", order).withColumn("b", F.pmod("h", F.lit(ORDER_BUCKETS)))
    by = W.partitionBy("source").orderBy("b")
    cut = (
        rows.groupBy("source", "b").agg(F.sum("size").alias("n"))
        .withColumn("before", F.sum("n").over(by) - F.col("n"))
        .join(plan, F.col("source").eqNullSafe(F.col("p_source"))).select(F.col("source").alias("c_source"), F.col("b").alias("c_b"), "before", "n", "source_size", "target", "whole", "rest")
    )
    rows = rows.join(cut, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("b") == F.col("c_b")))
    left = F.col("rest") - F.col("before")
    plain = rows.where((left <= 0) | (left >= F.col("n"))).withColumn("part", F.when(left <= 0, F.lit(0)).otherwise(F.col("size")).cast("long"))
    inside = W.partitionBy("source", "b").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    ends = rows.where((left > 0) & (left < F.col("n"))).withColumn("part", F.greatest(F.lit(0), F.least("size", left - F.coalesce(F.sum("size").over(inside), F.lit(0)))).cast("long"))
    return plain.unionByName(ends).withColumn("taken", F.col("whole") * F.col("size") + F.col("part")).select("doc_id", "source", "size", "source_size", "target", "taken")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, lambda: mix_sources(spark, sized(table(spark, sf_dir, "documents")))).select("doc_id", "size", "source_size", "target", "taken")
