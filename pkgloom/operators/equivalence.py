"""The mapping: for baselines of any number the equivalent packages of every repository, in one plan.

Candidates are found by shared files, by contained descriptions, by spellings of the name and as upstream siblings, then
merged, scored and selected. Baselines that are alike in all that counts are mapped once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions.names import repo_key
from ..sources.shared import drop, stored
from . import mapping, resolve, select

TARGET = ["src_name", "bin_name", "description", "filelist"]
_ENTRY = ["os_name", "os_version", "os_arch", "source_ord", "row_ord", "name", "source_name", "binary_name", "description", "filelist"]


def distinct_targets(baselines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(target_id, TARGET) of baselines (baseline_id, TARGET), and (baseline_id, target_id)."""
    key = F.struct(*TARGET)
    rows = baselines.select("baseline_id", *TARGET, F.xxhash64(F.to_json(key)).alias("h"))
    targets = rows.groupBy("h", *TARGET).agg(F.min("baseline_id").alias("target_id"))
    same = [rows[c].eqNullSafe(targets[c]) for c in TARGET]
    on = rows["h"] == targets["h"]
    for x in same:
        on = on & x
    return targets.select("target_id", *TARGET), rows.join(targets, on).select("baseline_id", "target_id")


def candidates(targets: DataFrame, entries: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """(target_id, entry columns, source, prio) of targets (target_id, TARGET[, repo]).

    Of each place and name the first entry in scan order stands; a candidate that several ways find is tagged by the
    first of them: files, description, name. With projects (see resolve.siblings) upstream siblings of a target's repo
    and name follow, as far as entries has them. Empty descriptions, `none` and `unknown` find nothing.
    """
    probe = F.col("target_id").alias("probe_id")
    place = [*resolve.PLACE, "name"]
    rows = entries.select(*_ENTRY)

    by_file = resolve.shared_files(targets.select(probe, "filelist"), rows).select("probe_id", *place, "source_ord", "row_ord", F.lit("filelist").alias("tag"), F.lit(1).alias("prio"))
    # each different description once on both sides: pairs of descriptions, not of packages
    texts = targets.select(F.col("description").alias("needle")).distinct()
    about = resolve.contained(texts, rows.select("description").distinct(), "needle", "description")
    pairs = targets.select(probe, F.col("description").alias("needle")).join(about, "needle").select("probe_id", "description")
    first = rows.groupBy(*place, "description").agg(F.min(F.struct("source_ord", "row_ord")).alias("o")).select(*place, "description", "o.*")
    by_text = pairs.join(first, "description").groupBy("probe_id", *place).agg(F.min(F.struct("source_ord", "row_ord")).alias("o")).select("probe_id", *place, "o.*", F.lit("description").alias("tag"), F.lit(2).alias("prio"))
    names = mapping.name_variants(targets.select("target_id", F.col("bin_name").alias("name")), "target_id")
    by_name = resolve.first_match_everywhere(names.select(probe, F.col("variant").alias("probe_name")), rows).select("probe_id", *place, "source_ord", "row_ord", F.lit("name").alias("tag"), F.lit(3).alias("prio"))
    found = by_file.unionByName(by_text).unionByName(by_name)
    if projects is not None:
        kin = resolve.siblings(targets.select(probe, "repo", F.col("bin_name").alias("binname")), projects)
        # a sibling that several projects share is looked for once
        kin = kin.select("probe_id", F.col("binname").alias("probe_name"), F.col("repo").alias("only")).distinct()
        kin = resolve.first_match_everywhere(kin, rows)
        found = found.unionByName(kin.select("probe_id", *place, "source_ord", "row_ord", F.lit("upstream").alias("tag"), F.lit(4).alias("prio")))
    return found.select(F.col("probe_id").alias("target_id"), "prio", F.array("tag").alias("source"), "source_ord", "row_ord", *place).join(rows, [*place, "source_ord", "row_ord"])


_PLACED = ["baseline_id", "repo_name", "repo_version", "bin_name", "cand_ord"]


def featured(baselines: DataFrame, entries: DataFrame, projects: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Every candidate of the baselines' targets (baseline_id is the target) with what its score is made of, as
    select.parts() takes it, and coverage; and (baseline_id, target_id)."""
    if projects is None:
        targets, members = distinct_targets(baselines)
    else:
        targets, members = baselines.withColumnRenamed("baseline_id", "target_id"), baselines.select("baseline_id", F.col("baseline_id").alias("target_id"))
    rows = candidates(targets, entries, projects)
    rows = rows.select(
        F.col("target_id").alias("baseline_id"), F.col("source_name").alias("src_name"), F.col("binary_name").alias("bin_name"), F.col("os_name").alias("repo_name"), F.col("os_version").alias("repo_version"),
        F.struct("prio", "source_ord", "row_ord").alias("cand_ord"), "description", "filelist", "source", F.lit(1.0).alias("confidence"),
    )
    merged = select.merge(rows)
    features = ["core", "plain_src", "roles", "versions"]
    names = select.name_features(entries.select(F.col("source_name").alias("src_name"), F.col("binary_name").alias("bin_name")).union(targets.select("src_name", "bin_name")))
    own = targets.join(names, ["src_name", "bin_name"], "left").select(F.col("target_id").alias("baseline_id"), *(F.col(c).alias(f"t_{c}") for c in ("description", "filelist", *features)))
    theirs = merged.join(names, ["src_name", "bin_name"], "left").select("baseline_id", "repo_name", "repo_version", "bin_name", "cand_ord", *(F.col(c).alias(f"c_{c}") for c in ("description", "filelist", "source", *features)))
    return theirs.join(own, "baseline_id").withColumn("coverage", S.coverage(F.col("t_filelist"), F.col("c_filelist"))), members


def detect(baselines: DataFrame, entries: DataFrame, projects: DataFrame | None = None, w: float = 0.7, k: int = 1) -> DataFrame:
    """(baseline_id, repo_name, repo_version, bin_name, score, rank): the best k packages of every repository for each of
    the baselines (baseline_id, src_name, bin_name, description, filelist[, repo])."""
    rows, members = featured(baselines, entries, projects)
    # written first, as three passes read it; only what can be among the best is compared letter by letter
    kept = stored(select.gated(rows))
    close = select.contenders(kept, w, k)
    scored = close.select(*_PLACED, F.round(select.weighed(w, *select.parts()), 6).alias("score"))
    best = select.ranked(scored, k).select(F.col("baseline_id").alias("target_id"), "repo_name", "repo_version", "bin_name", "score", "rank")
    out = stored(members.join(best, "target_id").drop("target_id"))
    drop(kept)
    return out


def sweep(baselines: DataFrame, entries: DataFrame, weights: list[float], projects: DataFrame | None = None, k: int = 1) -> DataFrame:
    """detect() for each of the weights, as column w: candidates are found and measured once, and stored; a weight costs a
    sum and, for the best of each group, an aggregate. The stored table goes once the result, which is stored too, is there."""
    rows, members = featured(baselines, entries, projects)
    first, second = select.parts()
    kept = stored(rows.select(*_PLACED, "coverage", first.alias("first"), second.alias("second")))
    scores = {w: F.round(select.weighed(w, F.col("first"), F.col("second")), 6) for w in weights}
    best = select.top_k(kept, k, ("w",), scores).select("w", F.col("baseline_id").alias("target_id"), "repo_name", "repo_version", "bin_name", "score", "rank")
    out = stored(members.join(best, "target_id").drop("target_id"))
    drop(kept)
    return out


#: Where a baseline is looked for first; places that aren't named come last, by name.
PRIORITY = ("ubuntu", "debian", "fedora", "gentoo")


def baselines(keywords: DataFrame, entries: DataFrame) -> DataFrame:
    """(baseline_id, keyword_id, TARGET, repo) of keywords (keyword_id, keyword): the packages that have the keyword's name
    in the first place that has any, by PRIORITY, then by name and version. Keywords that no place has are left out."""
    probes = keywords.select(F.col("keyword_id").alias("probe_id"), F.col("keyword").alias("probe_name"))
    found = resolve.first_match_everywhere(probes, entries.select(*_ENTRY))
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("os_name")), F.lit(0))
    order = F.struct(F.when(rank > 0, rank).otherwise(len(PRIORITY) + 1), "os_name", "os_version", "source_ord", "row_ord")
    fields = {"src_name": "source_name", "bin_name": "binary_name", "description": "description", "filelist": "filelist", "repo": "os_name"}
    first = found.groupBy("probe_id").agg(F.min_by(F.struct(*(F.col(c).alias(n) for n, c in fields.items())), order).alias("e"))
    return first.select(F.col("probe_id").alias("baseline_id"), F.col("probe_id").alias("keyword_id"), "e.*")


def tables(keywords: DataFrame, entries: DataFrame, projects: DataFrame | None = None, w: float = 0.7) -> DataFrame:
    """From keywords (keyword_id, keyword) to their tables of packages: keyword_id, repo_key, packages (sorted), best score.
    The baseline's own repository is in the table with what it has."""
    base = baselines(keywords, entries)
    found = detect(base.drop("keyword_id") if projects is not None else base.drop("keyword_id", "repo"), entries, projects, w)
    rows = found.select(F.col("baseline_id").alias("keyword_id"), repo_key(F.col("repo_name"), F.col("repo_version")).alias("repo_key"), "bin_name", "score")
    return rows.groupBy("keyword_id", "repo_key").agg(F.array_sort(F.collect_set("bin_name")).alias("packages"), F.max("score").alias("score"))
