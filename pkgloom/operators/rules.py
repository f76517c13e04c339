"""Index rules (rosdep_key, platform, os_version, package_manager, package, is_null) and their three-state lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the package manager of a platform that names none
MANAGERS = {
    "alpine": "apk", "arch": "pacman", "debian": "apt", "fedora": "dnf", "freebsd": "pkg", "gentoo": "portage",
    "macports": "macports", "openembedded": "opkg", "opensuse": "zypper", "osx": "homebrew", "rhel": "yum", "ubuntu": "apt",
}


def default_manager(platform: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in MANAGERS.items() for x in kv))[platform], F.lit("apt"))


#: Targets that may be broadcast.
MOST_TARGETS = 10_000


def lookup(rules: DataFrame, targets: DataFrame) -> DataFrame:
    """Every key and target (os_name, os_version) with state and packages.

    state is NULL (nothing said), EMPTY (said to be unavailable) or LISTED. A platform's own rules come before those of
    '*', and within the platform that applies its version before '*'. Every key is answered for every target, which are a
    configuration's short list and are broadcast while they are (MOST_TARGETS). A key's rules, its places in the index,
    meet once and are looked up for all targets.
    """
    listed = rules.groupBy("rosdep_key", "platform", "os_version").agg(
        F.array_sort(F.collect_set(F.when(~F.col("is_null"), F.col("package")))).alias("packages"), F.min("package_manager").alias("package_manager")
    )
    keys = listed.groupBy("rosdep_key").agg(F.collect_list(F.struct("platform", "os_version", "packages", "package_manager")).alias("said"))
    targets = targets.select("os_name", "os_version").distinct()
    few = targets.limit(MOST_TARGETS + 1).count() <= MOST_TARGETS
    want = keys.crossJoin(F.broadcast(targets) if few else targets)
    own = F.coalesce(F.exists("said", lambda r: r["platform"] == F.col("os_name")), F.lit(False))
    want = want.withColumn("platform", F.when(own, F.col("os_name")).otherwise("*"))
    of = lambda version: F.get(F.filter("said", lambda r: (r["platform"] == F.col("platform")) & (r["os_version"] == version)), F.lit(0))
    best = want.withColumn("d", F.when(F.col("rosdep_key").isNotNull(), F.coalesce(of(F.col("os_version")), of(F.lit("*")))))
    state = F.when(F.col("d").isNull(), "NULL").when(F.size("d.packages") == 0, "EMPTY").otherwise("LISTED")
    return best.select("rosdep_key", "os_name", "os_version", state.alias("state"), "d.packages", "d.package_manager")


def is_manager(name: Column) -> Column:
    """Whether a key of a rule names a package manager."""
    # fixed values: the names that count
    return name.isin(
        "apt", "apt-cyg", "brew", "dnf", "homebrew", "macports", "pacman", "pip", "pkg_add", "port", "portage", "slackpkg", "slackware", "source", "yum", "zypper",
    )


def managers(rules: DataFrame) -> DataFrame:
    """(rosdep_key, platform, os_version, managers, manager): the managers that a rule lists; manager where it is one."""
    names = F.array_sort(F.collect_set(F.when(~F.col("is_null"), F.col("package_manager"))))
    out = rules.groupBy("rosdep_key", "platform", "os_version").agg(names.alias("managers"))
    return out.withColumn("manager", F.when(F.size("managers") == 1, F.col("managers")[0]))


def configured(rules: DataFrame, targets: DataFrame) -> DataFrame:
    """The targets for which a key lists packages, with all of these and the first manager by name."""
    found = lookup(rules, targets.select("os_name", "os_version")).where("state = 'LISTED'")
    return found.select("rosdep_key", "os_name", "os_version", "package_manager", "packages")


def available_managers(rules: DataFrame) -> DataFrame:
    """(rosdep_key, platform, managers): the known managers of version '*', else of the first version (by name) that lists
    any; empty where none does."""
    listed = managers(rules).withColumn("known", F.filter("managers", lambda m: is_manager(m)))
    order = F.when(F.size("managers") > 0, F.struct(F.col("os_version") != "*", "os_version"))
    return listed.groupBy("rosdep_key", "platform").agg(F.coalesce(F.min_by("known", order), F.array().cast("array<string>")).alias("managers"))


def matched(rules: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of each wanted (rosdep_key, os_name, os_version) the platform and version under which its rule stands, or nulls."""
    places = rules.select("rosdep_key", "platform", "os_version").distinct()
    own = places.select("rosdep_key", F.col("platform").alias("os_name"), F.lit(True).alias("own")).distinct()
    want = wanted.join(own.hint("merge"), ["rosdep_key", "os_name"], "left").withColumn("platform", F.when(F.col("own"), F.col("os_name")).otherwise("*")).drop("own")
    exact = places.withColumn("exact", F.col("os_version"))
    star = places.where("os_version = '*'").select("rosdep_key", "platform", F.lit("*").alias("star"))
    hit = want.join(exact.hint("merge"), ["rosdep_key", "platform", "os_version"], "left").join(star.hint("merge"), ["rosdep_key", "platform"], "left")
    version = F.coalesce("exact", "star")
    return hit.select("rosdep_key", "os_name", "os_version", F.when(version.isNotNull(), F.col("platform")).alias("entry_platform"), version.alias("entry_version"))


def verify(rules: DataFrame, targets: DataFrame, entries: DataFrame, found: bool = False) -> DataFrame:
    """(os_name, os_version, os_arch, rosdep_key, package) of the rules' packages that a target (os_name, os_version,
    os_arch) lacks among entries of these and name; with found, of all, and whether each is there.

    Version '*' stands for the target's versions that the key's platform doesn't list itself. Packages of another manager
    than the platform's own, platform '*' and versions without a target are not looked up.
    """
    listed = rules.select("rosdep_key", F.col("platform").alias("os_name"), "os_version").distinct()
    named = rules.where("NOT is_null").where(F.col("package_manager") == default_manager(F.col("platform"))).select("rosdep_key", F.col("platform").alias("os_name"), "os_version", "package")
    exact = named.join(targets, ["os_name", "os_version"])
    star = named.where("os_version = '*'").drop("os_version").join(targets, "os_name").join(listed.hint("merge"), ["rosdep_key", "os_name", "os_version"], "left_anti")
    wanted = exact.unionByName(star).select("os_name", "os_version", "os_arch", "rosdep_key", "package").distinct()
    on = ["os_name", "os_version", "os_arch", "package"]
    there = entries.select("os_name", "os_version", "os_arch", F.col("name").alias("package")).distinct()
    if not found:
        return wanted.join(there.hint("merge"), on, "left_anti")
    return wanted.join(there.withColumn("found", F.lit(True)).hint("merge"), on, "left").withColumn("found", F.coalesce("found", F.lit(False)))
