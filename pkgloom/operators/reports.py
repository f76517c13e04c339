"""What an audit, a history of changes and a comparison of sources say, as texts and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import change_log_name

# fixed values: the wording of reports
_TITLES = {
    "A.1": "Entry not found in database", "A.2": "Missing platform/version in entry", "B.1a": "Package not found in repository", "B.1b": "Package name differs from expected",
    "B.2a": "Using pip when OS repo has it", "B.2b": "Distribution entry exists in OS repo",
}
_MESSAGES = {
    "A.1": "Entry '{key}' not found in database", "A.2": "Entry '{key}' missing version '{version}' for platform '{os}'; suggested package: '{expected}'",
    "B.1a not_found": "Package '{package}' not found in {os} {version}", "B.1a detected": "Package '{package}' not found in {os} {version}; detected existing package: '{expected}'",
    "B.1a": "No distribution info found for entry '{key}'", "B.1b differs": "Package '{package}' differs from expected '{expected}' in {os} {version}",
    "B.1b empty_list": "Empty package list for {os} {version}; expected package: '{expected}'", "B.2a": "Entry '{key}' using pip but package '{expected}' available in {os} {version}",
    "B.2b": "Distribution entry '{key}' exists in {os} {version} as '{package}'",
}


def defect_message(defects: DataFrame) -> Column:
    """The sentence for a row of audit.audit(); nulls are empty. Of a key that only a counterpart has by pip there is no place."""
    fields = {"key": "rosdep_key", "os": "os_name", "version": "os_version", "package": "package_name", "expected": "expected"}
    values = {n: F.coalesce(defects[c], F.lit("")) for n, c in fields.items()}

    def filled(text: str) -> Column:
        # cut at the fields, so that a value that looks like one is let be
        parts, rest = [], text
        while "{" in rest:
            before, _, rest = rest.partition("{")
            name, _, rest = rest.partition("}")
            parts += [F.lit(before), values[name]]
        return F.concat(*parts, F.lit(rest))

    kind = F.when(defects["type"] == "B.1a", F.when(defects["reason"] != "not_found", "B.1a").when(F.coalesce(defects["expected"], F.lit("")) != "", "B.1a detected").otherwise("B.1a not_found"))
    kind = kind.when(defects["type"] == "B.1b", F.concat(F.lit("B.1b "), defects["reason"])).otherwise(defects["type"])
    out = F.concat(F.lit("Defect "), defects["type"], F.lit(" for entry '"), values["key"], F.lit("'"))
    for name, text in _MESSAGES.items():
        out = F.when(kind == name, filled(text)).otherwise(out)
    return out


def defect_reports(keys: DataFrame, defects: DataFrame) -> DataFrame:
    """(rosdep_key, value): a Markdown section for each of keys (rosdep_key) on its defects, by type and then by message."""
    rows = defects.select("rosdep_key", "type", defect_message(defects).alias("m"))
    each = rows.groupBy("rosdep_key", "type").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    titles = F.coalesce(F.create_map(*(F.lit(x) for kv in _TITLES.items() for x in kv))[F.col("type")], F.col("type"))
    part = F.concat(F.lit("- **Type "), "type", F.lit("**: "), titles, F.lit("\n"), F.array_join(F.transform("ms", lambda m: F.concat(F.lit("  - "), m)), "\n"), F.lit("\n"))
    body = each.groupBy("rosdep_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type", part.alias("p")))), lambda x: x["p"]), "\n").alias("body"))
    head = F.concat(F.lit("\n### Entry: `"), "rosdep_key", F.lit("`\n\n"))
    return keys.select("rosdep_key").distinct().join(body.hint("merge"), "rosdep_key", "left").select("rosdep_key", F.concat(head, F.coalesce("body", F.lit("- No issues detected\n"))).alias("value"))


def broken_summary(broken: DataFrame) -> DataFrame:
    """(platform, value): a paragraph for each system and architecture of broken (os_name, os_version, os_arch, rosdep_key,
    package) with the packages that it lacks, each once and sorted."""
    os = F.when(F.coalesce("os_version", F.lit("")) != "", F.concat_ws(" ", "os_name", "os_version")).otherwise(F.col("os_name"))
    rows = broken.select(F.concat(os, F.lit(" on "), "os_arch").alias("platform"), F.concat(F.lit("- Package "), "package", F.lit(" for rosdep key "), "rosdep_key").alias("m"))
    each = rows.groupBy("platform").agg(F.array_sort(F.collect_set("m")).alias("ms"))
    head = F.concat(F.lit("* The following "), F.size("ms").cast("string"), F.lit(" packages were not found for "), "platform", F.lit(":\n"))
    return each.select("platform", F.concat(head, F.array_join("ms", "\n")).alias("value"))


def latex_lines(rows: DataFrame, cells: dict[str, Column], order: str, best: str | None = None) -> DataFrame:
    """A LaTeX table as lines (part, sort_key, value): the header, a row each and the end. Signs that mean something to
    LaTeX are escaped; the greatest value of the column best is bold."""
    special = r"([&%$#_{}])"
    text = {n: F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), special, r"\\$1") for n, c in cells.items()}
    if best is not None:
        top = rows.groupBy().agg(F.max(cells[best]).alias("_top"))
        rows = rows.crossJoin(F.broadcast(top))
        text[best] = F.when(cells[best] == F.col("_top"), F.concat(F.lit("\\textbf{"), text[best], F.lit("}"))).otherwise(text[best])
    line = F.concat(F.concat_ws(" & ", *text.values()), F.lit(" \\\\"))
    fixed = [(0, "", f"\\begin{{tabular}}{{{'l' * len(cells)}}}"), (1, "", f"{' & '.join(cells)} \\\\"), (2, "", "\\hline"), (4, "", "\\end{tabular}")]
    head = rows.sparkSession.createDataFrame(fixed, "part int, sort_key string, value string")
    return head.unionByName(rows.select(F.lit(3).alias("part"), F.col(order).cast("string").alias("sort_key"), line.alias("value")))


# ---- histories


def name_growth(packages: DataFrame) -> DataFrame:
    """(change_id, key, raw_grows, plain_grows) of the packages of a key before and after a change (change_id, key, side:
    before or after, name): whether it has more different names after, as they are and without their packagings' marks.
    A key that is new grows where it has several; keys that are gone are left out."""
    # dealt out by change once; a name, then a spelling without marks, is a row with what it counts for, and nothing is
    # counted as a set or in copies of the rows
    sides = ("before", "after")
    names = packages.repartition("change_id").groupBy("change_id", "key", "name").agg(*(F.max((F.col("side") == s).cast("int")).alias(s) for s in sides))
    plain = F.nullif(change_log_name(F.col("name")), F.lit(""))
    spelt = names.groupBy("change_id", "key", plain.alias("plain")).agg(*(F.sum(F.when(F.col("name").isNotNull(), F.col(s)).otherwise(0)).alias(f"raw_{s}") for s in sides), *(F.max(s).alias(s) for s in sides))
    per = spelt.groupBy("change_id", "key").agg(*(F.sum(f"raw_{s}").alias(f"raw_{s}") for s in sides), *(F.sum(F.when(F.col("plain").isNotNull(), F.col(s)).otherwise(0)).alias(f"plain_{s}") for s in sides))
    grows = lambda n: (F.col(f"{n}_after") > 1) & (F.col(f"{n}_after") > F.col(f"{n}_before"))
    return per.where("raw_after > 0").select("change_id", "key", grows("raw").alias("raw_grows"), grows("plain").alias("plain_grows"))


def growing_changes(growth: DataFrame, flagged: DataFrame) -> DataFrame:
    """(flagged, n, raw, plain) of name_growth(): how many changes there are, and let a key's names grow, among those of
    flagged (change_id) and the others."""
    per = growth.groupBy("change_id").agg(F.bool_or("raw_grows").alias("raw"), F.bool_or("plain_grows").alias("plain"))
    per = per.join(flagged.select("change_id", F.lit(True).alias("flagged")).distinct(), "change_id", "left")
    return per.groupBy(F.coalesce("flagged", F.lit(False)).alias("flagged")).agg(F.count("*").alias("n"), F.count_if("raw").alias("raw"), F.count_if("plain").alias("plain"))


def chained_class(types: Column) -> Column:
    """What later commits of a change were about: linter, rule, or null for none, an error or other things."""
    none = types.isin("No modifications found", "ERROR")
    return F.when(none, None).when(types.contains("lint"), "linter").when(types.contains("."), "rule")


def overlap(keys: DataFrame, others: DataFrame, category: str) -> DataFrame:
    """(category, n, both, share) of keys (key, category): how many of a category are among others (key), in per cent, and
    of all as category 'all'."""
    rows = keys.join(others.select("key").distinct().withColumn("_both", F.lit(1)), "key", "left")
    share = F.round(100.0 * F.count_distinct(F.when(F.col("_both") == 1, F.col("key"))) / F.count_distinct("key"), 6)
    sums = [F.count_distinct("key").alias("n"), F.count_distinct(F.when(F.col("_both") == 1, F.col("key"))).alias("both"), share.alias("share")]
    return rows.groupBy(F.col(category).alias("category")).agg(*sums).unionByName(rows.groupBy().agg(*sums).where("n > 0").withColumn("category", F.lit("all")))


def compare_sources(results: DataFrame) -> DataFrame:
    """(source, entries, packages, only) of results (source, key, package): what each source has, and how many packages no other has."""
    each = results.dropna(subset=["key", "package"]).distinct()
    alone = each.groupBy("key", "package").agg(F.count("*").alias("c"), F.min("source").alias("source")).where("c = 1").groupBy("source").agg(F.count("*").alias("only"))
    sums = each.groupBy("source").agg(F.count_distinct("key").alias("entries"), F.count("*").alias("packages"))
    return sums.join(alone, "source", "left").withColumn("only", F.coalesce("only", F.lit(0)))


# ---- truth and studies


def ground_truth(modified: DataFrame, definitions: DataFrame, least: int = 2, needed: str = "ubuntu_noble") -> DataFrame:
    """(key, repo_key, package) of the keys that changes modify (change_id, at, key), but for those that begin with python-:
    as the last change leaves them in definitions (change_id, key, repo_key, package). Keys stay that have the needed repository and at least so many."""
    last = modified.where("NOT startswith(key, 'python-')").groupBy("key").agg(F.max_by("change_id", F.struct("at", "change_id")).alias("change_id"))
    rows = definitions.join(last, ["change_id", "key"]).select("key", "repo_key", "package").distinct()
    good = rows.groupBy("key").agg(F.bool_or(F.col("repo_key") == needed).alias("has"), F.count_distinct("repo_key").alias("n")).where(F.col("has") & (F.col("n") >= least))
    return rows.join(good.select("key"), "key", "left_semi")


def cross_platform(packages: DataFrame) -> DataFrame:
    """The rows of packages (key, repo_key, package) of keys that have one package in each repository and two systems or more."""
    one = packages.groupBy("key", "repo_key").agg(F.count_distinct("package").alias("n"))
    good = one.groupBy("key").agg(F.max("n").alias("most"), F.count_distinct(F.substring_index("repo_key", "_", 1)).alias("systems")).where("most = 1 AND systems >= 2")
    return packages.join(good.select("key"), "key", "left_semi")


def study_changes(changes: DataFrame, touched: DataFrame, index: DataFrame, ignored: DataFrame) -> DataFrame:
    """(change_id, at, keys) of a study: changes (change_id, at, load_ord) each as it was loaded last, without ignored ones, all
    of whose keys (touched: change_id, key) the index (key) has."""
    last = changes.groupBy("change_id").agg(F.max_by("at", "load_ord").alias("at")).join(ignored.select("change_id"), "change_id", "left_anti")
    keys = touched.distinct().join(index.select("key").distinct().withColumn("_in", F.lit(True)), "key", "left")
    whole = keys.groupBy("change_id").agg(F.bool_and(F.coalesce("_in", F.lit(False))).alias("all_in"), F.array_sort(F.collect_set("key")).alias("keys")).where("all_in")
    return last.join(whole.drop("all_in"), "change_id").select("change_id", "at", "keys")
