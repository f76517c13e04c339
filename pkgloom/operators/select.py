"""Merging, scoring and selecting candidates, for all baselines at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions.names import clean_name, roles

IDENTITY = ["src_name", "bin_name", "repo_name", "repo_version"]
GROUP = ["baseline_id", "repo_name", "repo_version"]


def merge(candidates: DataFrame) -> DataFrame:
    """One row for each baseline and package: first non-empty values in cand_ord, all sources in order, best confidence."""
    rest = [c for c in candidates.columns if c not in {"baseline_id", *IDENTITY, "cand_ord", "source", "confidence"}]
    first = [F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col("cand_ord"))).alias(c) for c in rest]
    tags = F.array_sort(F.collect_list(F.struct("cand_ord", "source")))
    return candidates.groupBy("baseline_id", *IDENTITY).agg(
        F.min("cand_ord").alias("cand_ord"), *first, F.array_distinct(F.flatten(F.transform(tags, lambda x: x["source"]))).alias("source"), F.max("confidence").alias("confidence")
    )


def name_features(names: DataFrame) -> DataFrame:
    """names (src_name, bin_name), each once, with what score() compares: core, plain_src, roles, versions."""
    own = names.select("src_name", "bin_name").distinct()
    return own.select("src_name", "bin_name", S.core_name(F.col("bin_name")).alias("core"), clean_name(F.col("src_name"), version=True).alias("plain_src"), roles(F.col("bin_name")).alias("roles"), S.versions(F.col("bin_name")).alias("versions"))


def parts(text: Column | None = None) -> tuple[Column, Column]:
    """What a score weighs against each other, of columns t_* (target) and c_* (name_features(), description, filelist, and
    c_source): name + source + files, and roles + versions + description, each up to 3."""
    t, c = (lambda x: F.col(f"t_{x}")), (lambda x: F.col(f"c_{x}"))
    name = F.coalesce(S.lcs_ratio(t("core"), c("core")), F.lit(0.0))
    source = F.when(F.array_contains(c("source"), "upstream"), 1.0).when(t("plain_src") == c("plain_src"), 1.0).otherwise(0.0)
    files = F.coalesce(S.coverage(t("filelist"), c("filelist")), F.lit(0.0))
    kind = S.role_similarity(t("roles"), c("roles"))
    version = S.version_similarity(t("versions"), c("versions"))
    same = F.trim(t("description")) == F.trim(c("description"))
    about = F.coalesce(F.when((F.trim(t("description")) == "") | (F.trim(c("description")) == ""), 0.0).when(same, 1.0).otherwise(text if text is not None else S.lcs_ratio(t("description"), c("description"))), F.lit(0.0))
    return name + source + files, kind + version + about


def weighed(w: float | Column, first: Column, second: Column) -> Column:
    w = w if isinstance(w, Column) else F.lit(w)
    return w / 3 * first + (1 - w) / 3 * second


def score(w: float, text: Column | None = None) -> Column:
    """w/3 * (name + source + files) + (1 - w)/3 * (roles + versions + description), of the columns of parts()."""
    first, second = parts(text)
    return F.lit(w / 3) * first + F.lit((1 - w) / 3) * second


def bounds(w: float) -> tuple[Column, Column]:
    """The least and the most that score(w) can be, from all but the common subsequences: a ratio is 1 for equal texts, 0
    where one is missing or empty, and else at most what the lengths allow. The columns of parts()."""
    t, c = (lambda x: F.col(f"t_{x}")), (lambda x: F.col(f"c_{x}"))

    def ratio(a: Column, b: Column, same: Column) -> tuple[Column, Column]:
        none = a.isNull() | b.isNull() | (F.trim(a) == "") | (F.trim(b) == "")
        most = 2.0 * F.least(F.length(a), F.length(b)) / (F.length(a) + F.length(b))
        return F.when(none, 0.0).when(same, 1.0).otherwise(0.0), F.when(none, 0.0).when(same, 1.0).otherwise(most)

    name = ratio(t("core"), c("core"), t("core") == c("core"))
    about = ratio(t("description"), c("description"), F.trim(t("description")) == F.trim(c("description")))
    source = F.when(F.array_contains(c("source"), "upstream"), 1.0).when(t("plain_src") == c("plain_src"), 1.0).otherwise(0.0)
    files = F.coalesce(S.coverage(t("filelist"), c("filelist")), F.lit(0.0))
    rest = S.role_similarity(t("roles"), c("roles")) + S.version_similarity(t("versions"), c("versions"))
    return tuple(weighed(w, name[i] + source + files, rest + about[i]) for i in (0, 1))


def gated(rows: DataFrame, per: tuple[str, ...] = ()) -> DataFrame:
    """Where several compete for a baseline and repository (and the columns per) and one covers more than half of the
    target's files, without those that cover none (column coverage)."""
    group = W.partitionBy(*GROUP, *per)
    seen = rows.withColumn("_best", F.max("coverage").over(group)).withColumn("_n", F.count("*").over(group))
    return seen.where((F.col("_n") == 1) | (F.col("_best") <= 0.5) | (F.col("coverage") > 0)).drop("_best", "_n")


def contenders(rows: DataFrame, w: float, k: int = 1) -> DataFrame:
    """The rows that can be among the best k of their group: whose most reaches the k-th highest least. Scores are rounded
    to 6 digits, so what is nearer than that stays."""
    low, high = bounds(w)
    order = W.partitionBy(*GROUP).orderBy(F.desc("_low")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.withColumns({"_low": low, "_high": high})
    return rows.withColumn("_kth", F.nth_value("_low", k).over(order)).where("_kth IS NULL OR _high >= _kth - 2e-6").drop("_low", "_high", "_kth")


def ranked(rows: DataFrame, k: int = 1, per: tuple[str, ...] = ()) -> DataFrame:
    """The best k of each group with a score above 0 (columns score, cand_ord), with their rank."""
    rank = F.row_number().over(W.partitionBy(*GROUP, *per).orderBy(F.desc("score"), "cand_ord"))
    return rows.where("score > 0").withColumn("rank", rank).where(F.col("rank") <= k)


def best_by(rows: DataFrame, name: str, scores: dict[float, Column]) -> DataFrame:
    """(GROUP, name, score, cand_ord, bin_name): of each group and each of scores, by name, the row with the highest above 0,
    the first in cand_ord of equal ones. An aggregate a score over the group's rows, of which there are no copies."""
    first = lambda s: F.min(F.when(s > 0, F.struct((-s).alias("s"), "cand_ord", "bin_name")))
    best = rows.groupBy(*GROUP).agg(*(first(s).alias(f"_{i}") for i, s in enumerate(scores.values())))
    each = F.inline(F.array(*(F.struct(F.lit(v).alias(name), F.col(f"_{i}").alias("_best")) for i, v in enumerate(scores))))
    return best.select(*GROUP, each).where("_best IS NOT NULL").select(*GROUP, name, (-F.col("_best.s")).alias("score"), "_best.cand_ord", "_best.bin_name")


def top_k(rows: DataFrame, k: int = 1, per: tuple[str, ...] = (), scores: dict[float, Column] | None = None) -> DataFrame:
    """The best k of each baseline and repository (and of the columns per) with a score above 0 (columns score, coverage, cand_ord).

    Where several compete and one covers more than half of the target's files, those that cover none are out. With scores,
    several by name, each row competes by all of them, and per is the column that names them.
    """
    if scores is not None and k == 1:
        # who is out is the same by all scores, and of the others only the best by each goes on
        return ranked(best_by(gated(rows), *per, scores), k, per)
    if scores is not None:
        rows = rows.select("*", F.inline(F.array(*(F.struct(F.lit(v).alias(*per), s.alias("score")) for v, s in scores.items()))))
    return ranked(gated(rows, per), k, per)


def first_packages(table: DataFrame, places: DataFrame) -> DataFrame:
    """places (repo_name, repo_version) with the first package of each by name, else that of ros with the same version."""
    rows = table.select(F.col("repo_name").alias("r"), "repo_version", "bin_name")
    own = F.col("r") == F.col("repo_name")
    met = places.select("repo_name", "repo_version").distinct().join(rows, "repo_version").where(own | (F.col("r") == "ros"))
    return met.groupBy("repo_name", "repo_version").agg(F.min_by("bin_name", F.struct((~own).alias("other"), "bin_name")).alias("bin_name"))
