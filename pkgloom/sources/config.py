"""Configurations as tables: the systems that one supports, and its hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _supported(entries: DataFrame) -> DataFrame:
    rows = entries.where("section = 'supported_versions'")
    return rows.select("file", "line", F.col("name").alias("os_name"), F.coalesce(F.from_json("doc", "array<string>"), F.array().cast("array<string>")).alias("versions"))


def targets(entries: DataFrame) -> DataFrame:
    """(file, os_name, os_version, ver_ord) of configuration files (yaml_index entries, split by supported_versions), in the order of the list."""
    return _supported(entries).select("file", "os_name", F.posexplode("versions").alias("ver_ord", "os_version")).select("file", "os_name", "os_version", "ver_ord")


def hashes(entries: DataFrame) -> DataFrame:
    """(file, config_hash): the MD5 of the supported versions as JSON, systems and versions sorted."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col("os_name").alias("k"), F.array_sort("versions").alias("v"))))
    return _supported(entries).groupBy("file").agg(F.md5(F.to_json(F.map_from_entries(pairs))).alias("config_hash"))


def systems(targets: DataFrame) -> DataFrame:
    """(file, os_names): the systems of targets(), sorted, but for those that aren't of an operating system."""
    return targets.where(~F.col("os_name").isin("pypi", "ros")).groupBy("file").agg(F.array_sort(F.collect_set("os_name")).alias("os_names"))
