"""Defects of an index: missing, unavailable, invalid and badly prioritised definitions, for all keys and targets at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import lookup_key, platform_name
from .mapping import pip_counterparts

_OUT = ["rosdep_key", "os_name", "os_version", "type", "reason", "package_name", "expected"]
#: Kinds of rows of an audit: a state's package, a proposed package, a key that is wanted or exempt.
_RULE, _FOUND, _WANTED, _EXEMPT = range(4)


def audit(states: DataFrame, found: DataFrame, existing: DataFrame, targets: DataFrame, wanted: DataFrame | None = None, distributions: DataFrame | None = None) -> DataFrame:
    """(rosdep_key, os_name, os_version, type, reason, package_name, expected).

    With wanted (rosdep_key), keys without any rule are A.1, and B.2a as well where a pip counterpart of theirs has rules;
    keys of which the mapping knows nothing at all are B.1a and nothing else. distributions (rosdep_key) are exempt from
    both, and B.2b where a platform's first version has a package of their name.

    states: as rules.lookup() gives them; found: (rosdep_key, os_name, os_version, bin_name), the packages that the
    mapping proposes; existing: (os_name, os_version, package), what repositories have; targets: (os_name, os_version,
    ver_ord). After the first version of a platform with a pip definition that the system could serve, later versions
    of that platform are not looked at.

    All that is said of a place meets in one task, sorted by place once: what a place, a platform and a key say as a whole
    are windows over that order, so that neither states nor found are made more than once and no table of places is held.
    Of keys, places and packages there are as many as the index has, and files of them are far smaller than their rows:
    joins are merged, so that no estimate sends one side through the driver.
    """
    place = ["rosdep_key", "os_name", "os_version"]
    none = F.lit(None).cast("string")
    # a row for each package of a state, or for a state without any
    rows = states.join(targets.withColumn("aimed", F.lit(True)), ["os_name", "os_version"], "left")
    rows = rows.select(*place, "state", "package_manager", "ver_ord", "aimed", F.explode_outer(F.when(F.col("state") == "LISTED", F.col("packages"))).alias("package"))
    # rows without a package are dealt out by their keys
    rows = rows.withColumn("look", F.coalesce("package", F.concat(F.lit("\u0001"), "rosdep_key")))
    present = existing.select("os_name", "os_version", F.col("package").alias("look")).distinct().withColumn("there", F.lit(True))
    rows = rows.join(present.hint("merge"), ["os_name", "os_version", "look"], "left")
    rows = rows.select(*place, F.lit(_RULE).alias("kind"), "state", "package_manager", "ver_ord", "aimed", "package", F.when(F.col("package").isNotNull(), F.coalesce("there", F.lit(False))).alias("there"))
    of_kind = lambda kind, table, os_name, os_version, package: table.select("rosdep_key", os_name.alias("os_name"), os_version.alias("os_version"), F.lit(kind).alias("kind"), package.alias("package"))
    rows = rows.unionByName(of_kind(_FOUND, found, F.col("os_name"), F.col("os_version"), F.col("bin_name")), allowMissingColumns=True)
    if wanted is not None:
        exempt = distributions.select("rosdep_key") if distributions is not None else wanted.select("rosdep_key").limit(0)
        for kind, keys in ((_WANTED, wanted), (_EXEMPT, exempt)):
            rows = rows.unionByName(of_kind(kind, keys, none, none, none), allowMissingColumns=True)
    rows = rows.repartition("rosdep_key").sortWithinPartitions(*place, "kind")
    in_place, of_platform, of_key = W.partitionBy(*place).orderBy("kind"), W.partitionBy("rosdep_key", "os_name"), W.partitionBy("rosdep_key")
    of_place = in_place.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    is_rule, is_found, listed = F.col("kind") == _RULE, F.col("kind") == _FOUND, (F.col("kind") == _RULE) & F.col("package").isNotNull()
    first = lambda c: F.first(c, ignorenulls=True).over(of_place).alias(c)
    any_of = lambda kind, over: F.max(F.col("kind") == kind).over(over)
    names = lambda of: F.collect_set(F.when(of, platform_name(F.col("package"), F.col("os_name")))).over(of_place)
    rows = rows.select(
        *place, "kind", "package", "there", *map(first, ["state", "package_manager", "ver_ord", "aimed"]), F.row_number().over(in_place).alias("row"),
        F.when(F.col("rosdep_key").isNotNull(), F.min(F.when(is_found, F.col("package"))).over(of_place)).alias("expected"), F.min(F.when(listed, F.col("package"))).over(of_place).alias("least"),
        F.coalesce(F.min("there").over(of_place), F.lit(True)).alias("all_there"), names(is_rule).alias("listed_names"), names(is_found).alias("expected_names"),
        any_of(_WANTED, of_place).alias("wanted"), F.max(F.col("state").isNotNull()).over(of_key).alias("ruled"), any_of(_FOUND, of_key).alias("any_known"), any_of(_EXEMPT, of_key).alias("any_exempt"),
    )
    has, is_listed = F.col("expected").isNotNull(), F.col("state") == "LISTED"
    pip = is_listed & F.col("all_there") & (F.col("package_manager") == "pip") & has & F.col("aimed")
    rows = rows.withColumn("stop", F.min(F.when(pip, F.col("ver_ord"))).over(of_platform))
    # what is said of a place as a whole is said by its first row
    head = F.col("row") == 1
    rows = rows.where(head | listed)

    def out(kind: str, reason: str, name=none, expected=F.col("expected")):
        return F.struct(F.lit(kind).alias("type"), F.lit(reason).alias("reason"), name.alias("package_name"), expected.alias("expected"))

    def when(*tests):
        """The defects whose tests hold."""
        return F.array_compact(F.array(*(F.when(test, defect) for test, defect in tests)))

    def taken(defects, rows: DataFrame) -> DataFrame:
        # outer, as Spark otherwise makes the defects once more for a filter on their number
        return rows.select(*place, F.inline_outer(defects)).where("type IS NOT NULL").select(*_OUT)

    differs = is_listed & F.col("all_there") & (F.coalesce("package_manager", F.lit("")) != "pip") & has & (F.sort_array("listed_names") != F.sort_array("expected_names"))
    at_place = when(
        (head & (F.col("state") == "NULL") & has, out("A.2", "missing")), (head & (F.col("state") == "EMPTY") & has, out("B.1b", "empty_list")),
        (listed & ~F.col("there"), out("B.1a", "not_found", F.col("package"))), (listed & pip, out("B.2a", "pip", F.col("package"))),
        (head & differs, out("B.1b", "differs", F.col("least"))),
    )
    told = F.col("aimed") & (F.col("stop").isNull() | (F.col("ver_ord") <= F.col("stop")))
    if wanted is None:
        return taken(at_place, rows.where(told))
    at_key = when((~F.col("ruled"), out("A.1", "absent", expected=none)), (F.col("ruled") & ~F.col("any_known"), out("B.1a", "no_info", expected=none)))
    defects = F.when(told & (F.col("any_known") | F.col("any_exempt")), at_place).when(head & F.col("wanted") & ~F.col("any_exempt"), at_key)
    return taken(defects, rows).unionByName(_of_keys(states, existing, targets, wanted, exempt))


def _of_keys(states: DataFrame, existing: DataFrame, targets: DataFrame, wanted: DataFrame, exempt: DataFrame) -> DataFrame:
    """What is said of whole keys by other keys or packages: those that their names lead to."""
    none = F.lit(None).cast("string")
    # only Python keys have counterparts, and these end with -pip
    keys = wanted.select("rosdep_key", F.lit("w").alias("flag")).unionByName(exempt.select("rosdep_key", F.lit("e").alias("flag"))).unionByName(states.select("rosdep_key", F.lit("r").alias("flag")))
    keys = keys.where("startswith(rosdep_key, 'py') OR endswith(rosdep_key, '-pip')").groupBy("rosdep_key").agg(*(F.bool_or(F.col("flag") == f).alias(f) for f in "wer"))
    pip = pip_counterparts(keys.where("w AND NOT e AND NOT r")).join(keys.where("r").select(F.col("rosdep_key").alias("counterpart")).hint("merge"), "counterpart")
    pip = pip.groupBy("rosdep_key").agg(F.min_by("counterpart", "ord").alias("package_name"))
    pip = pip.select("rosdep_key", none.alias("os_name"), none.alias("os_version"), F.lit("B.2a").alias("type"), F.lit("pip_counterpart").alias("reason"), "package_name", none.alias("expected"))
    first = targets.groupBy("os_name").agg(F.min_by("os_version", "ver_ord").alias("os_version"))
    there = existing.join(first, ["os_name", "os_version"]).select("os_name", "os_version", "package", lookup_key(F.col("package")).alias("k"))
    served = exempt.distinct().withColumn("k", lookup_key(F.col("rosdep_key"))).join(there.hint("merge"), "k").groupBy("rosdep_key", "os_name", "os_version").agg(F.min("package").alias("package_name"))
    return pip.unionByName(served.select("rosdep_key", "os_name", "os_version", F.lit("B.2b").alias("type"), F.lit("in_platform").alias("reason"), "package_name", none.alias("expected")))
