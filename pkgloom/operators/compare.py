"""Comparison of methods against a truth, and of measured values against stated ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def platform_matches(truth: DataFrame, found: DataFrame, tools: DataFrame) -> DataFrame:
    """(tool, entry, platform, n_truth, n_found, result) for each of tools (tool) and each platform of truth (entry, platform,
    name): exact_match, partial_match or no_match of its names with those of found (tool, entry, platform, name)."""
    # dealt out by entry before names are collected, so that a task holds its entries' names, not those of a file's split
    want = truth.repartition("entry").groupBy("entry", "platform").agg(F.array_sort(F.collect_set("name")).alias("want"))
    have = found.repartition("entry").groupBy("tool", "entry", "platform").agg(F.array_sort(F.collect_set("name")).alias("have"))
    # methods are a short list, which travels with every platform
    every = want.crossJoin(F.broadcast(tools.select("tool").distinct()))
    # merged, as names that are found grow with the entries, while their file can be small enough for a broadcast
    rows = every.join(have.hint("merge"), ["tool", "entry", "platform"], "left")
    n = F.coalesce(F.size(F.array_intersect("want", "have")), F.lit(0))
    n = F.greatest(n, F.lit(0))
    result = F.when(F.col("have").isNotNull() & (F.col("want") == F.col("have")), "exact_match").when(n > 0, "partial_match").otherwise("no_match")
    return rows.select("tool", "entry", "platform", F.size("want").alias("n_truth"), n.alias("n_found"), result.alias("result"))


def overall(matches: DataFrame) -> DataFrame:
    """(tool, exact, partial, none, total, exact_rate, total_rate) of platform_matches(), rates in per cent, best first by rank."""
    counts = matches.groupBy("tool").agg(*(F.count_if(F.col("result") == r).alias(n) for n, r in (("exact", "exact_match"), ("partial", "partial_match"), ("none", "no_match"))), F.count("*").alias("total"))
    rate = lambda x: F.round(100.0 * x / F.col("total"), 6)
    rows = counts.withColumns({"exact_rate": rate(F.col("exact")), "total_rate": rate(F.col("exact") + F.col("partial"))})
    # one row a method: the order is a list of all of them, with what is said of each, so that matches are made once
    rest = [c for c in rows.columns if c != "tool"]
    order = F.array_sort(F.collect_list(F.struct((-F.col("exact_rate")).alias("r"), "tool", *rest)))
    ranks = rows.groupBy().agg(order.alias("o")).select(F.posexplode("o").alias("rank", "x"))
    return ranks.select("x.tool", *(f"x.{c}" for c in rest), (F.col("rank") + 1).alias("rank")).where("tool IS NOT NULL")


def repository_scores(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(tool, entry, precision, recall, f1) of the sets of repositories, of entries for which both sides have any."""
    want = truth.select("entry", "platform").distinct()
    have = found.select("tool", "entry", "platform").distinct()
    n_want = want.groupBy("entry").agg(F.count("*").alias("t"))
    both = have.join(want.withColumn("hit", F.lit(1)), ["entry", "platform"], "left").groupBy("tool", "entry").agg(F.count("*").alias("p"), F.count("hit").alias("tp")).join(n_want, "entry")
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (F.col("p") + F.col("t"))).otherwise(0.0)
    return both.select("tool", "entry", (F.col("tp") / F.col("p")).alias("precision"), (F.col("tp") / F.col("t")).alias("recall"), f1.alias("f1"))


def extras(found: DataFrame, verified: DataFrame, matches: DataFrame) -> DataFrame:
    """(tool, entries, extra, unverified, rate, rate_of_entries): of a tool's found platforms (tool, entry, platform) how many
    the truth lacks, how many of all are not verified (tool, entry, platform), and in per cent of the extra ones and of all."""
    place = ["tool", "entry", "platform"]
    none = F.lit(None).cast("int")
    rows = found.select(*place, none.alias("v"), F.lit(1).alias("f")).unionByName(verified.dropna(subset=place).select(*place, F.lit(1).alias("v"), none.alias("f")))
    # both sides in one pass, dealt out by entry first
    rows = rows.repartition("entry").groupBy(*place).agg(F.max("v").alias("v"), F.max("f").alias("f")).where("f = 1")
    right = matches.where("result <> 'no_match'").groupBy("tool").agg(F.count("*").alias("right"))
    sums = rows.groupBy("tool").agg(F.count("*").alias("entries"), F.count("v").alias("n_verified")).join(right, "tool", "left")
    extra, unverified = F.col("entries") - F.coalesce("right", F.lit(0)), F.col("entries") - F.col("n_verified")
    return sums.select("tool", "entries", extra.alias("extra"), unverified.alias("unverified"), F.when(extra > 0, F.round(100.0 * unverified / extra, 6)).alias("rate"), F.round(100.0 * unverified / F.col("entries"), 6).alias("rate_of_entries"))


def check_claims(rows: DataFrame, claims: dict[str, tuple[Column, float]], tolerance: float = 1e-9) -> DataFrame:
    """(claim, stated, measured, holds) of claims: name to (aggregate over rows, stated value). All are measured in one pass
    over rows, by what Spark observes of it. A claim without rows to measure does not hold."""
    seen = Observation("claims")
    rows.observe(seen, *(F.coalesce(c.cast("double"), F.lit(float("nan"))).alias(n) for n, (c, _) in claims.items())).write.format("noop").mode("overwrite").save()
    got = seen.get
    out = [(n, float(stated), None if got[n] != got[n] else got[n], got[n] == got[n] and abs(got[n] - stated) <= tolerance) for n, (_, stated) in claims.items()]
    return rows.sparkSession.createDataFrame(out, "claim string, stated double, measured double, holds boolean")
