"""Why the packages of one entry are named differently in different repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N


def inconsistencies(packages: DataFrame) -> DataFrame:
    """(entry, causes) of the entries of packages (entry, repo_key, platform, bin_name) that are named inconsistently.

    Only entries of two platforms or more with one package in every repository are looked at. causes, sorted: affixation
    where fewer names differ once affixes are gone, evolution where fewer differ once versions and marks are gone as
    well, policy where names differ still; unknown where none holds.
    """
    name = N.bare_name(F.col("bin_name"))
    plain = N.without_affixes(name)
    bare = F.when(plain != "", N.without_evolution(plain))
    whole = F.nullif(N.clean_name(N.without_evolution(N.bare_name(bare)), version=True, special=False), F.lit(""))
    # dealt out by entry first: no task holds more of the names than its entries have, and none is counted in copies of the rows
    levels = packages.repartition("entry").select("entry", "repo_key", "platform", "bin_name", name.alias("l1"), plain.alias("l2"), bare.alias("l3"), whole.alias("l4"))
    different = lambda c: F.size(F.collect_set(c))
    per = levels.groupBy("entry").agg(
        F.count("bin_name").alias("n"), different("repo_key").alias("repos"), different("platform").alias("platforms"), F.count_if(F.col("bin_name").isNull()).alias("nameless"),
        *(different(c).alias(c) for c in ("l1", "l2", "l3", "l4")),
    )
    causes = F.array_compact(F.array(F.when(F.col("l2") < F.col("l1"), "affixation"), F.when(F.col("l3") < F.col("l2"), "evolution"), F.when(F.col("l4") > 1, "policy")))
    asked = per.where("nameless = 0 AND n = repos AND platforms > 1 AND l1 > 1")
    return asked.select("entry", F.when(F.size(causes) == 0, F.array(F.lit("unknown"))).otherwise(causes).alias("causes"))


def pair_matrix(packages: DataFrame) -> DataFrame:
    """Of each entry of packages (entry, platform, bin_name, filelist) every pair of platforms with the sizes of their file
    sets, of what these share and hold together, and their similarity; of a platform's packages the first by name
    counts. An entry has as many platforms as are configured, so the pairs of one are few."""
    first = packages.groupBy("entry", "platform").agg(F.array_distinct(F.min_by("filelist", "bin_name")).alias("files"))
    a, b = (first.select("entry", F.col("platform").alias(f"platform{i}"), F.coalesce("files", F.array().cast("array<string>")).alias(f"f{i}")) for i in (1, 2))
    both, either = F.size(F.array_intersect("f1", "f2")), F.size(F.array_union("f1", "f2"))
    pairs = a.join(b, "entry").where("platform1 < platform2")
    return pairs.select("entry", "platform1", "platform2", F.size("f1").alias("file_count1"), F.size("f2").alias("file_count2"), both.alias("shared"), either.alias("together"), F.when(either > 0, both / either).otherwise(0.0).alias("similarity"))
