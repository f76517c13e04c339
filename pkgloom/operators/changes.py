"""What a change does to an index: kinds of changes to rule documents, and the audit of what they change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import drop, stored
from . import audit, rules
from .mapping import normalised, rule_payloads


def as_of(probes: DataFrame, versions: DataFrame, by: list[str], on: str, value: str) -> DataFrame:
    """probes with the value of the last version (by, on, value) that stands before them in the order of on; null where
    there is none. Of versions at one place the greatest value counts; a null on comes before all."""
    order = [F.col(on), F.col("_kind"), F.col(value)]
    rows = probes.withColumns({"_kind": F.lit(0), value: F.lit(None).cast(versions.schema[value].dataType)})
    rows = rows.unionByName(versions.select(*by, on, value, F.lit(1).alias("_kind")).dropna(subset=[value]), allowMissingColumns=True)
    last = F.last(value, ignorenulls=True).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn(value, last).where("_kind = 0").drop("_kind")


def entry_maps(docs: DataFrame, *ids: str) -> DataFrame:
    """docs (ids, rosdep_key, doc) with entry: platform to version to (details, manager); details spell the managers with
    their packages, and are empty where it is said to be unavailable; manager is the only one. Keys without any platform
    have an empty entry."""
    place = [*ids, "rosdep_key"]
    # one exchange for all groups
    rows = rule_payloads(docs, *ids, keys=True).repartition(*place)
    rows = rows.groupBy(*place, "platform", "os_version").agg(F.array_sort(F.collect_list(F.struct("package_manager", "packages"))).alias("all"))
    known = F.filter("all", lambda x: x["packages"].isNotNull())
    details = F.when(F.size(known) > 0, F.to_json(known)).otherwise("")
    rows = rows.withColumn("x", F.struct(details.alias("details"), F.when(F.size(known) == 1, F.get(known, F.lit(0))["package_manager"]).alias("manager")))
    rows = rows.groupBy(*place, "platform").agg(F.collect_list(F.struct("os_version", "x")).alias("m"))
    of = F.when(F.col("platform").isNotNull(), F.struct("platform", F.map_from_entries("m").alias("m")))
    return rows.groupBy(*place).agg(F.map_from_entries(F.collect_list(of)).alias("entry"))


def _match(entry: Column, platform: Column, version: Column) -> Column:
    """The place that applies: the platform's own versions before those of '*', its version before '*'."""
    of = F.coalesce(entry[platform], entry["*"])
    return F.coalesce(of[version], of["*"])


def _any(entry: Column, test) -> Column:
    """Whether test(platform, version, place) holds anywhere."""
    return F.exists(F.map_entries(entry), lambda p: F.exists(F.map_entries(p["value"]), lambda v: F.coalesce(test(p["key"], v["key"], v["value"]), F.lit(False))))


def kinds(before: DataFrame, after: DataFrame, affected: DataFrame | None = None, moved: DataFrame | None = None) -> DataFrame:
    """(change_id, rosdep_key, kinds) of the keys that a change adds, removes or edits.

    before, after: the rule documents (change_id, rosdep_key, doc) around each change; affected (change_id, rosdep_key): the
    keys at its lines, without any all keys count; moved (change_id): changes that edit the distribution too.

    A new key is B.2a if its -pip form is removed or edited, else A.1. A removed -pip key is B.2a where its plain form is not
    added and the distribution changes. An edited key is A.2 where a platform or version is new and not covered by '*',
    B.2a where pip gives way to another manager, B.1a where what applies differs, seen from either side.
    """
    place = ["change_id", "rosdep_key"]
    old, new = (entry_maps(d, "change_id").withColumnRenamed("entry", name) for d, name in ((before, "old"), (after, "new")))
    both = old.join(new, place, "full_outer")
    if affected is not None:
        scope = affected.select(*place).distinct().withColumn("meant", F.lit(True))
        some = affected.select("change_id").distinct().withColumn("some", F.lit(True))
        both = both.join(scope, place, "left").join(some, "change_id", "left").where("some IS NULL OR meant").drop("some", "meant")
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("edited")
    # kept, as the other form of a key is looked for in it twice
    kept = stored(both.withColumn("state", state))
    out = stored(_judged(kept, kept.withColumn("edits", _edits(F.col("old"), F.col("new"))), moved))
    drop(kept)
    return out


def _edits(old: Column, new: Column) -> Column:
    """The kinds of an edit between two entries."""
    starred = F.array_contains(F.map_keys(old), "*")
    platform = F.exists(F.map_keys(new), lambda p: ~F.array_contains(F.map_keys(old), p))
    version = _any(new, lambda p, v, _: old[p][v].isNull() & old[p]["*"].isNull())
    by_pip = _any(new, lambda p, v, x: (_match(old, p, v)["manager"] == "pip") & (F.coalesce(x["manager"], F.lit("")) != "pip"))
    differs = _any(new, lambda p, v, x: _match(old, p, v)["details"] != x["details"]) | _any(old, lambda p, v, x: _match(new, p, v)["details"] != x["details"])
    return F.array_compact(F.array(F.when(~starred & (platform | version), "A.2"), F.when(differs, "B.1a"), F.when(by_pip, "B.2a")))


def _judged(states: DataFrame, rows: DataFrame, moved: DataFrame | None) -> DataFrame:
    """(change_id, rosdep_key, state, kinds) of rows (change_id, rosdep_key, state, edits); states has their states."""
    place = ["change_id", "rosdep_key"]
    # the other form of a key in the same change
    pip = states.where("state <> 'added' AND endswith(rosdep_key, '-pip')").select("change_id", F.expr("substring(rosdep_key, 1, length(rosdep_key) - 4)").alias("rosdep_key"), F.lit(True).alias("was_pip"))
    added = states.where("state = 'added'").select("change_id", F.col("rosdep_key").alias("plain"), F.lit(True).alias("plain_added"))
    both = rows.join(pip, place, "left").withColumn("plain", F.replace("rosdep_key", F.lit("-pip"), F.lit(""))).join(added, ["change_id", "plain"], "left")
    both = both.join(moved.select("change_id").distinct().withColumn("moves", F.lit(True)), "change_id", "left") if moved is not None else both.withColumn("moves", F.lit(None).cast("boolean"))
    of_key = [
        F.when(F.col("state") == "added", F.when(F.col("was_pip"), "B.2a").otherwise("A.1")),
        F.when((F.col("state") == "removed") & F.col("rosdep_key").endswith("-pip") & F.col("plain_added").isNull() & F.col("moves"), "B.2a"),
    ]
    found = F.when(F.col("state") == "edited", F.coalesce("edits", F.array().cast("array<string>"))).otherwise(F.array_compact(F.array(*of_key)))
    return both.select(*place, "state", found.alias("kinds"))


def kinds_of_documents(both: DataFrame, moved: DataFrame | None = None) -> DataFrame:
    """As kinds(), for both (change_id, rosdep_key, old, new), a key's documents around the change, null where there is none,
    each key once. What an edit is depends on the two documents alone, and changes that have the same two share it."""
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("edited")
    kept = stored(both.withColumn("state", state))
    edits = kept.where("state = 'edited'").select("old", "new").distinct()
    maps = stored(entry_maps(edits.select(F.explode(F.array("old", "new")).alias("doc")).distinct().select(F.col("doc").alias("rosdep_key"), "doc")))
    of = lambda side: maps.select(F.col("rosdep_key").alias(side), F.col("entry").alias(f"{side}_entry"))
    edits = stored(edits.join(of("old"), "old").join(of("new"), "new").select("old", "new", _edits(F.col("old_entry"), F.col("new_entry")).alias("edits")))
    out = stored(_judged(kept, kept.join(edits, ["old", "new"], "left"), moved))
    drop(kept, maps, edits)
    return out


def of_change(kinds: DataFrame) -> DataFrame:
    """(change_id, kinds) of kinds(): all of a change's kinds, sorted."""
    return kinds.groupBy("change_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("kinds"))


def main_type(kind: Column) -> Column:
    """B.1a and B.1b are B.1."""
    return F.regexp_replace(kind, r"^([A-Z]\.[0-9]+)[a-z]$", "$1")


def match_status(found: Column, expected: Column) -> Column:
    """How two sets of types agree."""
    both = F.size(F.array_intersect(found, expected))
    return (
        F.when((both == F.size(found)) & (both == F.size(expected)), "exact_match").when(both == F.size(expected), "match_with_extra").when(both > 0, "partial_match").otherwise("mismatch")
    )


#: Characters of a document that stands in a key; a digest has as many.
LONG = 64


def audited(changes: DataFrame, touched: DataFrame, versions: DataFrame, configs: DataFrame, found: DataFrame, existing: DataFrame) -> DataFrame:
    """(change_id, found, expected, status): what the audit says of the keys that each change touches, on their documents
    and the configuration in force before it, against what is expected. One plan for all changes.

    changes (change_id, at, expected: types); touched (change_id, rosdep_key); versions (rosdep_key, at, doc: null where it
    is removed); configs (config, at, os_name, os_version, ver_ord: a configuration's targets); found and existing as audit.audit() takes them.
    Keys without a document at the time are A.1. Changes that expect nothing have the status no_valid_expected_types.
    """
    docs = versions.select("rosdep_key", "at", F.coalesce("doc", F.lit("")).alias("doc"))
    probes = touched.distinct().join(changes.select("change_id", "at"), "change_id")
    asked = as_of(probes, docs, ["rosdep_key"], "at", "doc")
    starts = configs.select(F.lit(0).alias("one"), "at", "config").distinct()
    # configurations are few: their times are compared, not joined by a window over all changes
    starts = F.broadcast(starts.groupBy().agg(F.array_sort(F.collect_list(F.struct("at", "config"))).alias("starts")))
    asked = asked.join(starts).withColumn("config", F.element_at(F.filter("starts", lambda s: s["at"] <= F.col("at")), -1)["config"]).drop("starts")
    # a key's document under a configuration is a key of its own, which the changes that meet it share; a long document is
    # named by its digest, as all rows of the audit carry the key
    doc = F.when(F.length("doc") > LONG, F.sha2("doc", 256)).otherwise(F.col("doc"))
    asked = stored(asked.select("change_id", "rosdep_key", "config", "doc", F.to_json(F.array("rosdep_key", F.col("config").cast("string"), doc)).alias("own")))
    meant = asked.select("change_id", "own")
    kept, asked = asked, stored(asked.select("rosdep_key", "config", "doc", "own").distinct())
    rule = normalised(asked.where("doc <> ''").select(F.col("own").alias("rosdep_key"), "doc"))
    targets = configs.groupBy("os_name", "os_version").agg(F.min("ver_ord").alias("ver_ord"))
    served = configs.select("config", "os_name", "os_version").distinct()
    states = rules.lookup(rule, targets.select("os_name", "os_version")).withColumnRenamed("rosdep_key", "own")
    states = states.join(asked.select("own", "config"), "own").join(F.broadcast(served), ["config", "os_name", "os_version"], "left_semi").drop("config").withColumnRenamed("own", "rosdep_key")
    proposed = found.join(asked.select("rosdep_key", "own", "config"), "rosdep_key").join(F.broadcast(served), ["config", "os_name", "os_version"], "left_semi").drop("rosdep_key", "config").withColumnRenamed("own", "rosdep_key")
    defects = audit.audit(states, proposed, existing, targets, asked.select(F.col("own").alias("rosdep_key")))
    per = defects.select(F.col("rosdep_key").alias("own"), main_type(F.col("type")).alias("t")).groupBy("own").agg(F.collect_set("t").alias("ts")).join(meant.hint("merge"), "own").select("change_id", F.explode("ts").alias("t")).groupBy("change_id").agg(F.array_sort(F.collect_set("t")).alias("found"))
    out = changes.select("change_id", F.array_sort(F.array_distinct(F.transform("expected", main_type))).alias("expected")).join(per, "change_id", "left")
    out = out.withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    status = F.when(F.size("expected") == 0, "no_valid_expected_types").otherwise(match_status(F.col("found"), F.col("expected")))
    out = stored(out.select("change_id", "found", "expected", status.alias("status")))
    drop(kept, asked)
    return out
