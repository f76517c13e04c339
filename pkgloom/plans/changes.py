"""Rule, distribution and configuration files, and changes to them, as queries over text that is made of the tables."""

from __future__ import annotations

import difflib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes, mapping
from ..sources import config, formats, shared, yaml_index
from .domain import read


def _written(texts: DataFrame, kind: str) -> str:
    """A folder with a YAML file for each file number of texts (file, ord, value: a piece of the file)."""
    path = shared.new_path(texts.sparkSession, kind)
    texts.repartition("file").sortWithinPartitions("file", "ord").select("file", "value").write.partitionBy("file").text(path)
    return path


def _filled(template: str, **by: Column) -> Column:
    out = F.lit(template)
    for name, value in by.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), value)
    return out


def _case(by: Column, values: list[Column]) -> Column:
    out = F.when(by == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(by == i, v)
    return out


# ---- rule files

#: Shapes of a rule in a file.
_RULES = [
    "k{k}:\n  ubuntu:\n    '*': null\n  debian: [{n}, {n}-dev]\n  fedora: null", "k{k}:\n  osx:\n    homebrew:\n      packages: [{n}]\n      depends: [x]", "k{k}:  # a comment\n  rhel:\n    8: null\n    '9': [{n}]",
    "k{k}:\n  '*':\n    pip:\n      packages: [{n}]\n    apt: [y]", "k{k}:\n  gentoo: [cat/{n}]\n  ubuntu:\n    focal:\n      apt:\n        packages:\n        - {n}\n        - \"{n}2\"",
]


def s25_rule_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rules in files of a thousand; files that are loaded later give every fiftieth part another rule."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.floor(F.col("p_partkey") / 1000).alias("file"), F.col("p_partkey").cast("string").alias("k"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("n"), F.col("p_size") % 5)
    texts = part.select("file", "ord", _case(F.col("(p_size % 5)"), [_filled(t, k=F.col("k"), n=F.col("n")) for t in _RULES]).alias("value"))
    later = part.where("ord % 50 = 0").select("file", "ord", _filled("k{k}:\n  arch: [{n}]", k=F.col("k"), n=F.col("n")).alias("value"))
    entries = yaml_index.read(spark, [_written(texts, "rules"), _written(later, "later")], "*.txt")
    return mapping.normalised(mapping.loaded(entries))


S25 = """WITH p AS (SELECT 'k' || p_partkey AS k, replace(p_name, ' ', '-') AS n, p_partkey % 50 = 0 AS later, p_size % 5 AS m FROM part)
SELECT k AS rosdep_key, platform, os_version, package_manager, package, package IS NULL AS is_null FROM (
SELECT k, 'arch' AS platform, '*' AS os_version, 'pacman' AS package_manager, n AS package FROM p WHERE later
UNION ALL SELECT k, 'ubuntu', '*', 'apt', NULL FROM p WHERE NOT later AND m = 0 UNION ALL SELECT k, 'fedora', '*', 'dnf', NULL FROM p WHERE NOT later AND m = 0
UNION ALL SELECT k, 'debian', '*', 'apt', n || e FROM p, (VALUES (''), ('-dev')) t(e) WHERE NOT later AND m = 0
UNION ALL SELECT k, 'osx', '*', 'homebrew', n FROM p WHERE NOT later AND m = 1
UNION ALL SELECT k, 'rhel', '8', 'yum', NULL FROM p WHERE NOT later AND m = 2 UNION ALL SELECT k, 'rhel', '9', 'yum', n FROM p WHERE NOT later AND m = 2
UNION ALL SELECT k, '*', '*', 'pip', n FROM p WHERE NOT later AND m = 3
UNION ALL SELECT k, 'gentoo', '*', 'portage', 'cat/' || n FROM p WHERE NOT later AND m = 4 UNION ALL SELECT k, 'ubuntu', 'focal', 'apt', n || e FROM p, (VALUES (''), ('2')) t(e) WHERE NOT later AND m = 4)"""


def s25_bad_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a nation as a file of keys; files of every third nation break off, and of the next hold a list."""
    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("file"), F.col("c_custkey").alias("ord"), (F.col("c_nationkey") % 3).alias("m"))
    value = _case(F.col("m"), [F.format_string("k%d: [a, {", "ord"), F.format_string("- k%d", "ord"), F.format_string("k%d: {ubuntu: [n]}", "ord")])
    files = yaml_index.read(spark, _written(c.select("file", "ord", value.alias("value")), "bad"), "*.txt")
    number = F.regexp_extract("file", "/file=([0-9]+)/", 1).cast("int").alias("nation")
    return files.select(number, "name", "error").groupBy("nation").agg(F.count("name").alias("n_keys"), F.count("error").alias("n_errors"), F.bool_or(F.coalesce(F.col("error") == "not a mapping", F.lit(False))).alias("not_a_mapping"))


S25B = """SELECT c_nationkey AS nation, sum(CASE WHEN c_nationkey % 3 = 2 THEN 1 ELSE 0 END) AS n_keys, CASE WHEN c_nationkey % 3 = 2 THEN 0 ELSE 1 END AS n_errors, c_nationkey % 3 = 1 AS not_a_mapping
FROM customer GROUP BY c_nationkey"""


def _distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a nation as the repositories of its distribution file."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("file"), F.col("s_suppkey").alias("ord"), F.col("s_suppkey").cast("string").alias("k"))
    two = "  repo{k}:\n    release:\n      packages: [pkg_{k}_a, pkg_{k}]\n      version: 1.10\n    status: maintained"
    value = F.when(F.col("ord") % 3 == 0, _filled("  repo{k}:\n    source: {type: git, url: 'u{k}'}", k=F.col("k"))).otherwise(_filled(two, k=F.col("k")))
    tops = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("file"), F.lit(-1).cast("long").alias("ord"), F.when(F.col("n_nationkey") % 2 == 0, "release_platforms:\n  ubuntu: [noble, jammy]\n  rhel: ['9']\ntype: distribution\nrepositories:").otherwise("release_platforms:\n  debian:\n  - bookworm\nrepositories:").alias("value"))
    path = _written(s.select("file", "ord", value.alias("value")).union(tops), "distribution")
    return yaml_index.read(spark, path, "*.txt", split=("release_platforms", "repositories"))


def s26_distribution_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that distribution files stand for (P06)."""
    return mapping.distribution_rules(_distribution(spark, sf_dir)).drop("is_null")


S26 = """WITH k AS (SELECT s_nationkey AS f, 'repo' || s_suppkey AS repo, unnest(CASE WHEN s_suppkey % 3 = 0 THEN ['repo' || s_suppkey] ELSE ['pkg-' || s_suppkey || '-a', 'pkg-' || s_suppkey] END) AS key FROM supplier)
SELECT key AS rosdep_key, 'osx' AS platform, '*' AS os_version, 'brew' AS package_manager, repo AS package, repo AS source_key FROM k
UNION ALL SELECT key, 'ubuntu', v, 'apt', key, repo FROM k, (VALUES ('noble'), ('jammy')) t(v) WHERE f % 2 = 0
UNION ALL SELECT key, 'rhel', '9', 'yum', key, repo FROM k WHERE f % 2 = 0 UNION ALL SELECT key, 'debian', 'bookworm', 'apt', key, repo FROM k WHERE f % 2 = 1"""


def p30_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, source and packages of the repositories of distribution files, by repository (P07, P30)."""
    r = mapping.repositories(_distribution(spark, sf_dir))
    return r.select(F.col("name").alias("repo"), "status", "source_url", F.size("packages").alias("n_packages"), "version")


P30 = """SELECT 'repo' || s_suppkey AS repo, CASE WHEN s_suppkey % 3 = 0 THEN 'unknown' ELSE 'maintained' END AS status, CASE WHEN s_suppkey % 3 = 0 THEN 'u' || s_suppkey END AS source_url,
CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 2 END AS n_packages, CASE WHEN s_suppkey % 3 > 0 THEN '1.10' END AS version FROM supplier"""


def s27_config_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of a region as the supported systems of its configuration; the hash doesn't depend on their order."""
    n = read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("file"), (-F.col("n_nationkey")).cast("long").alias("ord"), F.concat(F.lit("  "), F.lower("n_name"), F.lit(": ['"), (F.col("n_nationkey") % 7).cast("string"), F.lit("', '1', '0x']")).alias("value"))
    top = n.select("file").distinct().select("file", F.lit(-100).cast("long").alias("ord"), F.lit("package_sources: {}\nsupported_versions:").alias("value"))
    entries = yaml_index.read(spark, _written(n.union(top), "config"), "*.txt", split=("supported_versions",))
    targets = config.targets(entries).groupBy("file").agg(F.count("*").alias("n_targets"))
    out = config.hashes(entries).join(targets, "file")
    return out.select(F.regexp_extract("file", "/file=([0-9]+)/", 1).cast("int").alias("region"), "n_targets", "config_hash")


S27 = """WITH v AS (SELECT n_regionkey AS r, lower(n_name) AS n, list_sort([CAST(n_nationkey % 7 AS VARCHAR), '1', '0x']) AS v FROM nation)
SELECT r AS region, CAST(sum(len(v)) AS BIGINT) AS n_targets, md5('{' || string_agg('"' || n || '":["' || array_to_string(v, '","') || '"]', ',' ORDER BY n) || '}') AS config_hash FROM v GROUP BY r"""


def j24_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of rule files and a distribution file, where keys of the latter replace the former's: keys by kind."""
    part = read(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 1000).alias("file"), F.col("p_partkey").alias("ord"), F.concat(F.when(F.col("p_partkey") % 10 == 0, F.concat(F.lit("repo"), F.col("p_partkey").cast("string"))).otherwise(F.concat(F.lit("k"), F.col("p_partkey").cast("string"))), F.lit(": {ubuntu: [n]}")).alias("value"))
    entries = yaml_index.read(spark, _written(part, "rules"), "*.txt")
    index = mapping.assembled(entries, _distribution(spark, sf_dir))
    return index.groupBy("rosdep_key").agg(F.bool_or("from_distribution").alias("from_distribution"), F.count("*").alias("n_rules"))


J24 = """WITH d AS (SELECT s_nationkey % 2 AS f, unnest(CASE WHEN s_suppkey % 3 = 0 THEN ['repo' || s_suppkey] ELSE ['pkg-' || s_suppkey || '-a', 'pkg-' || s_suppkey] END) AS k FROM supplier),
p AS (SELECT CASE WHEN p_partkey % 10 = 0 THEN 'repo' ELSE 'k' END || p_partkey AS k FROM part)
SELECT k AS rosdep_key, true AS from_distribution, CASE f WHEN 0 THEN 4 ELSE 2 END AS n_rules FROM d UNION ALL SELECT k, false, 1 FROM p WHERE k NOT IN (SELECT k FROM d)"""


# ---- changes

#: Before, after and whether the distribution changes too. {k} is a number.
_CHANGES = [
    ("aa: {ubuntu: [a]}\nzz: {ubuntu: [z]}\n", "aa: {ubuntu: [a]}\nk{k}:\n  ubuntu: [n]\nzz: {ubuntu: [z]}\n", False),
    ("aa: {ubuntu: [a]}\nk{k}-pip:\n  ubuntu:\n    pip: [n]\nzz: {ubuntu: [z]}\n", "aa: {ubuntu: [a]}\nk{k}:\n  ubuntu: [n]\nzz: {ubuntu: [z]}\n", False),
    ("aa: {ubuntu: [a]}\nk{k}-pip:\n  ubuntu:\n    pip: [n]\n", "aa: {ubuntu: [a]}\n", True),
    ("aa: {ubuntu: [a]}\nk{k}-pip:\n  ubuntu:\n    pip: [n]\n", "aa: {ubuntu: [a]}\n", False),
    ("k{k}:\n  ubuntu: [n]\nzz: {ubuntu: [z]}\n", "k{k}:\n  fedora: [n]\n  ubuntu: [n]\nzz: {ubuntu: [z]}\n", False),
    ("k{k}:\n  ubuntu:\n    focal: [n]\nzz: {ubuntu: [z]}\n", "k{k}:\n  ubuntu:\n    focal: [n]\n    noble: [n]\nzz: {ubuntu: [z]}\n", False),
    ("k{k}:\n  ubuntu:\n    pip:\n      packages: [n]\n", "k{k}:\n  ubuntu:\n    apt:\n      packages: [n]\n", False),
    ("k{k}:\n  ubuntu: [n]\nzz: {ubuntu: [z]}\n", "k{k}:\n  ubuntu: [n, m]\nzz: {ubuntu: [z]}\n", False),
    ("k{k}:\n  '*':\n    pip: [n]\n", "k{k}:\n  '*':\n    pip: [n]\n  ubuntu: [n]\n", False),
    ("k{k}:\n  ubuntu:\n    '*': [n]\n    focal: [m]\n", "k{k}:\n  ubuntu:\n    '*': [n]\n", False),
    ("k{k}:\n  ubuntu:\n    '*': [n]\n", "k{k}:\n  ubuntu:\n    '*': [n]\n    focal: null\n", False),
]


def _diff(old: str, new: str, moved: bool) -> str:
    out = "\n".join(difflib.unified_diff(old.splitlines(), new.splitlines(), "a/rosdep/base.yaml", "b/rosdep/base.yaml", lineterm="", n=0))
    return out + ("\n--- a/distribution.yaml\n+++ b/distribution.yaml\n@@ -1 +1 @@\n-a\n+b" if moved else "")


def _tasks(spark: SparkSession) -> int:
    """A fixed number of tasks, which small ones are not put together from."""
    return 4 * spark.sparkContext.defaultParallelism


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as changes (change_id, k, m: see _text()). They are dealt out by key, as their file is small enough for few tasks
    to read, and the reading of what is made of them is not."""
    return read(spark, sf_dir, "orders").repartition(_tasks(spark), "o_orderkey").select(F.col("o_orderkey").alias("change_id"), F.col("o_custkey").cast("string").alias("k"), (F.col("o_orderkey") % len(_CHANGES)).alias("m"))


def _text(of) -> Column:
    """A text of each change, where k and m are its number and its place among the shapes."""
    return _case(F.col("m"), [_filled(of(c), k=F.col("k")) for c in _CHANGES])


def _change_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a change: its files before and after, and the diff."""
    return _orders(spark, sf_dir).select("change_id", _text(lambda c: c[0]).alias("before"), _text(lambda c: c[1]).alias("after"), _text(lambda c: _diff(*c)).alias("value"))


def _affected(rows: DataFrame) -> DataFrame:
    """(doc_id, line, path) of the changed lines: doc_id is the change and the side, added in what is new, removed in what was."""
    lines = formats.changed_lines(rows.select(F.col("change_id").alias("diff_id"), "value")).where("path = 'rosdep/base.yaml'")
    lines = lines.select(F.concat_ws(" ", F.col("diff_id").cast("string"), "side").alias("doc_id"), F.explode("lines").alias("line"))
    sides = F.inline(F.array(F.struct(F.lit("added").alias("side"), F.col("after").alias("text")), F.struct(F.lit("removed").alias("side"), F.col("before").alias("text"))))
    docs = rows.select("change_id", sides).select(F.concat_ws(" ", F.col("change_id").cast("string"), "side").alias("doc_id"), "text")
    return yaml_index.changed_paths(docs, lines)


def s35_changed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed lines of diffs (S34) placed at the nodes of the files (S35) that hold them (P29)."""
    return _affected(_change_rows(spark, sf_dir)).select("doc_id", "line", F.array_join("path", "/").alias("path"))


S35 = """WITH v(m, side, line, path) AS (VALUES (0, 'added', 2, 'k'), (0, 'added', 3, 'k/ubuntu'), (1, 'removed', 2, 'k-pip'), (1, 'removed', 3, 'k-pip/ubuntu'), (1, 'removed', 4, 'k-pip/ubuntu/pip'), (1, 'added', 2, 'k'), (1, 'added', 3, 'k/ubuntu'),
(2, 'removed', 2, 'k-pip'), (2, 'removed', 3, 'k-pip/ubuntu'), (2, 'removed', 4, 'k-pip/ubuntu/pip'), (3, 'removed', 2, 'k-pip'), (3, 'removed', 3, 'k-pip/ubuntu'), (3, 'removed', 4, 'k-pip/ubuntu/pip'), (4, 'added', 2, 'k/fedora'),
(5, 'added', 4, 'k/ubuntu/noble'), (6, 'removed', 3, 'k/ubuntu/pip'), (6, 'added', 3, 'k/ubuntu/apt'), (7, 'removed', 2, 'k/ubuntu'), (7, 'added', 2, 'k/ubuntu'), (8, 'added', 4, 'k/ubuntu'), (9, 'removed', 4, 'k/ubuntu/focal'), (10, 'added', 4, 'k/ubuntu/*'))
SELECT concat(o_orderkey, ' ', side) AS doc_id, line, replace('/' || path, '/k', '/k' || o_custkey)[2:] AS path FROM orders JOIN v ON m = o_orderkey % 11"""


def c06_change_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of each change (J19) from its diff and its files before and after."""
    o = _orders(spark, sf_dir)
    diffs = o.select("change_id", _text(lambda c: _diff(*c)).alias("value"))
    lines = formats.changed_lines(diffs.withColumnRenamed("change_id", "diff_id")).where("path = 'rosdep/base.yaml'")
    side = lambda name: F.flatten(F.collect_list(F.when(F.col("side") == name, F.col("lines")))).alias(name)
    lines = lines.groupBy(F.col("diff_id").alias("change_id")).agg(side("removed"), side("added"))
    # changes of one key stand beside each other, as they have texts in common
    near = o.join(lines.hint("merge"), "change_id", "left").repartition(_tasks(spark), "k").sortWithinPartitions("k")
    both = mapping.documents_around(near.select("change_id", "removed", "added", _text(lambda c: c[0]).alias("before"), _text(lambda c: c[1]).alias("after")))
    moved = diffs.where("contains(value, '+++ b/distribution.yaml')").select("change_id")
    found = changes.of_change(changes.kinds_of_documents(both, moved))
    return found.select("change_id", F.array_join("kinds", ",").alias("kinds"))


C06 = """SELECT o_orderkey AS change_id, ['A.1', 'B.2a', 'B.2a', '', 'A.2', 'A.2', 'B.1a,B.2a', 'B.1a', 'B.1a,B.2a', 'B.1a', 'B.1a'][o_orderkey % 11 + 1] AS kinds FROM orders"""


def j19_before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two whole indexes: parts of even and odd thirds as rules before and after one change."""
    p = read(spark, sf_dir, "part").select(F.lit(1).alias("change_id"), F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("rosdep_key"), "p_partkey", "p_size", F.replace("p_name", F.lit(" "), F.lit("-")).alias("n"))
    one = F.format_string('{"ubuntu":["%s"]}', "n")
    after = F.when(F.col("p_size") % 4 == 0, one).when(F.col("p_size") % 4 == 1, F.format_string('{"ubuntu":{"pip":{"packages":["%s"]}}}', "n")).when(F.col("p_size") % 4 == 2, F.format_string('{"ubuntu":["%s"],"arch":null}', "n")).otherwise(F.format_string('{"ubuntu":["%s","x"]}', "n"))
    found = changes.kinds(p.where("p_partkey % 3 <> 0").select("change_id", "rosdep_key", one.alias("doc")), p.where("p_partkey % 3 <> 1").select("change_id", "rosdep_key", after.alias("doc")))
    return found.select("rosdep_key", "state", F.array_join("kinds", ",").alias("kinds"))


J19 = """SELECT 'k' || p_partkey AS rosdep_key, ['added', 'removed', 'edited'][p_partkey % 3 + 1] AS state, CASE p_partkey % 3 WHEN 0 THEN 'A.1' WHEN 1 THEN '' ELSE ['', 'B.1a', 'A.2', 'B.1a'][p_size % 4 + 1] END AS kinds FROM part"""


def c07_change_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order changes its customer's rule; it is audited on the rule and the configuration in force before it."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("change_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("rosdep_key"), "o_custkey", F.col("o_orderdate").alias("at"))
    n = F.concat(F.lit("p"), F.col("o_custkey").cast("string"))
    m = F.col("change_id") % 5
    doc = _case(m, [F.lit('{"ubuntu":null}'), F.format_string('{"ubuntu":{"pip":{"packages":["%s"]}}}', n), F.format_string('{"ubuntu":["%s"]}', n), F.format_string('{"ubuntu":["%s","%s-dev"]}', n, n), F.format_string('{"fedora":{"41":["%s"]}}', n)])
    versions = o.select("rosdep_key", "at", F.concat(doc, F.format_string("  %020d", "change_id")).alias("doc"))  # of one day the last order counts
    versions = versions.groupBy("rosdep_key", "at").agg(F.max_by("doc", F.substring("doc", -20, 20)).alias("doc"))
    versions = versions.withColumn("doc", F.expr("substring(doc, 1, length(doc) - 22)"))
    expected = _case(F.col("change_id") % 4, [F.array(F.lit("A.1")), F.array(F.lit("B.1a"), F.lit("A.2")), F.array(F.lit("B.1b")), F.array().cast("array<string>")])
    late = F.to_timestamp(F.lit("1996-01-01"))
    configs = spark.createDataFrame([(0, "ubuntu", "jammy", 0), (0, "fedora", "41", 0), (1, "ubuntu", "jammy", 0), (1, "ubuntu", "noble", 1), (1, "fedora", "41", 0)], "config int, os_name string, os_version string, ver_ord int")
    configs = configs.withColumn("at", F.when(F.col("config") == 0, F.to_timestamp(F.lit("1900-01-01"))).otherwise(late))
    names = read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("rosdep_key"), "c_custkey", F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("n"))
    found = names.select("rosdep_key", F.explode(F.array(*(F.struct(F.lit(a).alias("os_name"), F.lit(b).alias("os_version")) for a, b in (("ubuntu", "jammy"), ("ubuntu", "noble"), ("fedora", "41"))))).alias("t"), F.when(F.col("c_custkey") % 3 > 0, F.col("n")).otherwise(F.concat(F.lit("python3-"), "n")).alias("bin_name"))
    found = found.select("rosdep_key", "t.*", "bin_name")
    has = lambda condition, a, b, name: names.where(condition).select(F.lit(a).alias("os_name"), F.lit(b).alias("os_version"), name.alias("package"))
    there = has("c_custkey % 2 = 0", "ubuntu", "jammy", F.col("n")).union(has("c_custkey % 5 > 0", "ubuntu", "noble", F.col("n"))).union(has("c_custkey % 2 = 1", "fedora", "41", F.col("n"))).union(has("c_custkey % 4 = 0", "ubuntu", "jammy", F.concat("n", F.lit("-dev")))).union(has("c_custkey % 4 = 0", "ubuntu", "noble", F.concat("n", F.lit("-dev"))))
    out = changes.audited(o.select("change_id", "at", expected.alias("expected")), o.select("change_id", "rosdep_key"), versions, configs, found, there)
    return out.select("change_id", F.array_join("found", ",").alias("found"), F.array_join("expected", ",").alias("expected"), "status")


C07 = """WITH d AS (SELECT o_custkey AS c, o_orderdate AS at, arg_max(o_orderkey % 5, o_orderkey) AS m FROM orders GROUP BY 1, 2),
a AS (SELECT o_orderkey AS id, o_custkey AS c, o_orderdate >= TIMESTAMP '1996-01-01' AS late, d.m FROM orders o ASOF LEFT JOIN d ON o.o_custkey = d.c AND o.o_orderdate > d.at),
g(o, v, ord) AS (VALUES ('ubuntu', 'jammy', 0), ('ubuntu', 'noble', 1), ('fedora', '41', 0)),
e AS (SELECT a.*, g.*, c % 3 = 0 AS py, CASE WHEN (o = 'ubuntu') = (m < 4) THEN CASE WHEN m = 0 THEN 'EMPTY' ELSE 'LISTED' END ELSE 'NULL' END AS state,
  CASE v WHEN 'jammy' THEN c % 2 = 0 WHEN 'noble' THEN c % 5 > 0 ELSE c % 2 = 1 END AS n_there, o = 'ubuntu' AND c % 4 = 0 AS dev_there FROM a, g WHERE m IS NOT NULL AND (late OR v <> 'noble') AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = a.c)),
f AS (SELECT *, n_there AND (m <> 3 OR dev_there) AS all_there, min(CASE WHEN state = 'LISTED' AND m = 1 AND n_there THEN ord END) OVER (PARTITION BY id, o) AS stop FROM e),
r AS (SELECT * FROM f WHERE stop IS NULL OR ord <= stop),
t AS (SELECT id, 'A.1' AS t FROM a WHERE m IS NULL UNION SELECT id, 'A.2' FROM r WHERE state = 'NULL' UNION SELECT id, 'B.1' FROM r WHERE state = 'EMPTY' OR (state = 'LISTED' AND NOT all_there) OR (state = 'LISTED' AND m <> 1 AND all_there AND (m = 3 OR py))
  UNION SELECT id, 'B.2' FROM r WHERE state = 'LISTED' AND m = 1 AND n_there),
s AS (SELECT o_orderkey AS id, [['A.1'], ['A.2', 'B.1'], ['B.1'], []][o_orderkey % 4 + 1] AS x, list_sort(list(t) FILTER (WHERE t IS NOT NULL)) AS f FROM orders LEFT JOIN t ON t.id = o_orderkey GROUP BY 1, 2),
b AS (SELECT id, x, coalesce(f, []) AS f, len(list_intersect(x, coalesce(f, []))) AS n FROM s)
SELECT id AS change_id, array_to_string(f, ',') AS found, array_to_string(x, ',') AS expected,
  CASE WHEN len(x) = 0 THEN 'no_valid_expected_types' WHEN n = len(x) AND n = len(f) THEN 'exact_match' WHEN n = len(x) THEN 'match_with_extra' WHEN n > 0 THEN 'partial_match' ELSE 'mismatch' END AS status FROM b"""

#: Query: (function, SQL).
ALL = {"j19_before_after": (j19_before_after, J19), "c07_change_audit": (c07_change_audit, C07)}
if yaml_index.yaml is not None:
    ALL |= {
        "s25_rule_files": (s25_rule_files, S25), "s25_bad_files": (s25_bad_files, S25B), "s26_distribution_files": (s26_distribution_files, S26), "p30_repositories": (p30_repositories, P30), "s27_config_files": (s27_config_files, S27),
        "j24_assembled_index": (j24_index, J24), "s35_changed_nodes": (s35_changed_nodes, S35), "c06_change_kinds": (c06_change_kinds, C06),
    }
