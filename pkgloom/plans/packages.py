"""Further operators of the domain as queries: metadata scans, keys and versions of packages, rules and set tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import similarity as S
from ..operators import resolve, rules
from ..sources import formats
from .domain import _RULES_SQL, _rules, _targets, of_parts, parts_sql, read


_APK = [
    ("P:{n}{k}\nV:1.3\no:{n}-src\nT:compression\np:so:lib{n}.so.1=1 pc:{n}=1.3 {n}-compat{k}=1.3", "{n}{k},{n}-compat{k}", "1.3", "{n}-src", "{n}{k}", "compression"), ("P:{n}{k}\nV:5.{k}", "{n}{k}", "5.{k}", "{n}{k}", "{n}{k}", None),
    ("P:{n}{k}\nV:1\nT:a:b\np:cmd:x", "{n}{k}", "1", "{n}{k}", "{n}{k}", "a:b"),
]


def s11_apkindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.apk_packages(formats.block_fields(of_parts(spark, sf_dir, [r[:1] for r in _APK], "value").select("value")))


S11 = f"SELECT unnest(string_split(names, ',')) AS name, version, source_name, binary_name, description FROM {parts_sql([r[1:] for r in _APK], 'names version source_name binary_name description')}"


_PACMAN = [
    ("%NAME%\n{n}{k}\n\n%VERSION%\n1.3-1\n\n%BASE%\n{n}-src\n\n%DESC%\ncompression\n\n%PROVIDES%\nlib{n}.so=1-64\n{n}-compat\n", "{n}{k},lib{n}.so=1-64,{n}-compat", "1.3-1", "{n}-src", "{n}{k}", "compression"),
    ("%NAME%\n{n}{k}\n\n%VERSION%\n5.{k}-1\n\n%DESC%\na shell\n", "{n}{k}", "5.{k}-1", "{n}{k}", "{n}{k}", "a shell"),
]


def s14_pacman_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.pacman_packages(formats.sections(of_parts(spark, sf_dir, [r[:1] for r in _PACMAN], "value").select("value")))


S14 = f"SELECT unnest(string_split(names, ',')) AS name, version, source_name, binary_name, description FROM {parts_sql([r[1:] for r in _PACMAN], 'names version source_name binary_name description')}"


_DIFF = "diff --git a/x.yaml b/x.yaml\n--- a/x{n}.yaml\n+++ b/x{n}.yaml\n@@ -1,3 +1,4 @@\n one\n-two\n+2\n+2b\n three\n@@ -10 +11,2 @@ ctx\n ten\n+eleven\n--- a/gone.yaml\n+++ /dev/null\n@@ -1 +0,0 @@\n-all\n"


def s34_changed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = of_parts(spark, sf_dir, [(_DIFF,), ("--- a/y\n+++ b/y\n@@ -0,0 +1 @@\n+{n}",), ("no diff",)], "value")
    return formats.changed_lines(t.withColumnRenamed("p_partkey", "diff_id")).select("diff_id", "path", "side", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"))


S34 = f"""SELECT p_partkey AS diff_id, path, 'added' AS side, added AS lines FROM {parts_sql([("x{n}.yaml", "2,3,12"), ("y", "1"), (None, None)], "path added")} WHERE path IS NOT NULL
UNION ALL SELECT p_partkey, path, 'removed', '2' FROM {parts_sql([("x{n}.yaml",), (None,), (None,)], "path")} WHERE path IS NOT NULL"""


_FILES = [("lib{n}.so.4.8.0", "lib{n}.so"), ("lib{n}X-1.2.so", "lib{n}x.so"), ("_{n}.cpython-312-x86_64-linux-gnu.so", "_{n}.so"), ("{n}-31.1-jre.jar", "{n}.jar"), ("README{k}", "README{k}"), ("{n}.abi3.so", "{n}.so")]


def f05_base_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = of_parts(spark, sf_dir, [r[:1] for r in _FILES], "name")
    return t.select("p_partkey", "name", N.base_name(F.col("name")).alias("base"))


F05 = f"SELECT * FROM {parts_sql(_FILES, 'name base')}"


def f10_change_log_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names in the spelling of four packagings; all come back to one name."""
    p = read(spark, sf_dir, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("-")).alias("n"))
    spelt = F.array(F.concat(F.lit("lib"), "n", F.lit("-dev")), F.concat(F.lit("cmake("), "n", F.lit(")")), F.concat(F.lit("python3-"), "n"), F.concat("n", F.lit("-devel")))
    return p.select("p_partkey", F.explode(spelt).alias("n")).groupBy("p_partkey").agg(F.countDistinct(N.change_log_name(F.col("n"))).alias("n_names"), F.min(N.change_log_name(F.col("n"))).alias("name"))


F10 = "SELECT p_partkey, count(DISTINCT m) AS n_names, min(m) AS name FROM (SELECT p_partkey, replace(replace(lower(p_name), ' ', '_'), '-', '_') AS m FROM part) x GROUP BY p_partkey"


def f25_multilabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.filter(F.transform(F.split(F.concat_ws(" , ", "o_orderstatus", F.lit(""), "o_orderpriority"), ","), lambda x: F.trim(x)), lambda x: x != "")
    return read(spark, sf_dir, "orders").select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


F25 = "SELECT label, count(*) AS n FROM (SELECT unnest([o_orderstatus, o_orderpriority]) AS label FROM orders) x WHERE trim(label) <> '' GROUP BY label"


def m01_iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times written as ISO-Z are read back; those that aren't times are skipped."""
    text = F.when(F.col("event_id") % 7 == 0, "ERROR").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    at = F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return read(spark, sf_dir, "events").select("event_id", F.unix_seconds(at.cast("timestamp")).alias("s")).where("s IS NOT NULL")


M01 = "SELECT event_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS s FROM events WHERE event_id % 7 <> 0"


def m09_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("value") - 10) / 50)), 6).alias("score"))


M09 = "SELECT event_id, round(greatest(0.0, least(1.0, (value - 10) / 50)), 6) AS score FROM events"


def w09_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem").select("l_partkey", F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("."), F.col("l_linenumber").cast("string")).alias("version"))
    return line.groupBy("l_partkey").agg(F.max_by("version", N.version_key(F.col("version"))).alias("latest"), F.max("version").alias("by_text"))


W09 = "SELECT l_partkey, concat(max(k) // 100, '.', max(k) % 100) AS latest, max(concat(k // 100, '.', k % 100)) AS by_text FROM (SELECT l_partkey, CAST(l_quantity AS INT) * 100 + l_linenumber AS k FROM lineitem) x GROUP BY l_partkey"


def j02_stripped_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages of two distributions that are one once the distribution's prefix is gone."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_size", F.replace("p_name", F.lit(" "), F.lit("-")).alias("n"))
    a, b = p.where("p_size <= 25").select(F.col("p_partkey").alias("a"), "n"), p.where("p_size > 25").select(F.col("p_partkey").alias("b"), "n")
    # a generated column, which Spark makes no filter of the rows from
    key = lambda prefix: lambda blocks: blocks.withColumn("k", F.explode(F.array(N.ros_name(F.concat(F.lit(prefix), "n")))))
    return resolve.met_in_blocks(a, b, ["k"], "a", "b", raw=["n"], made=(key("ros-jazzy-"), key("ros-humble-")))


J02 = "SELECT x.p_partkey AS a, y.p_partkey AS b FROM part x JOIN part y ON x.p_name = y.p_name WHERE x.p_size <= 25 AND y.p_size > 25"


def c12_disjoint_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each unordered pair of repositories of one entry whose file lists share nothing."""
    p = read(spark, sf_dir, "part").select("p_type", "p_size", "p_partkey", F.split("p_name", " ").alias("w"))
    counts = {"file_count1": F.size(F.array_distinct("l")), "file_count2": F.size(F.array_distinct("r"))}
    pairs = resolve.met_in_blocks(p, p.withColumnRenamed("p_partkey", "other"), ["p_type", "p_size"], "p_partkey", "other", "w", counts, S.jaccard(F.col("l"), F.col("r")) == 0)
    return pairs.where("p_partkey < other")


C12 = "WITH p AS (SELECT *, list_distinct(string_split(p_name, ' ')) AS w FROM part) SELECT x.p_partkey, y.p_partkey AS other, CAST(len(x.w) AS INT) AS file_count1, CAST(len(y.w) AS INT) AS file_count2 FROM p x JOIN p y USING (p_type, p_size) WHERE x.p_partkey < y.p_partkey AND NOT list_has_any(x.w, y.w)"


def u04_set_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    of = lambda r: F.coalesce(F.collect_set(F.when(F.col("event_id") % 2 == r, F.col("event_type"))), F.array().cast("array<string>"))
    sets = e.groupBy("user_id").agg(of(0).alias("a"), of(1).alias("b"))
    return sets.select("user_id", (F.size(F.array_except("a", "b")) == 0).alias("is_subset"), (~F.arrays_overlap("a", "b")).alias("is_disjoint"), (F.array_sort("a") == F.array_sort("b")).alias("is_equal"))


U04 = """SELECT user_id, max(CASE WHEN a AND NOT b THEN 1 ELSE 0 END) = 0 AS is_subset, max(CASE WHEN a AND b THEN 1 ELSE 0 END) = 0 AS is_disjoint, max(CASE WHEN a <> b THEN 1 ELSE 0 END) = 0 AS is_equal
FROM (SELECT user_id, event_type, bool_or(event_id % 2 = 0) AS a, bool_or(event_id % 2 = 1) AS b FROM events GROUP BY user_id, event_type) x GROUP BY user_id"""


def p26_repo_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    repo, version = F.when(F.col("p_size") % 5 == 0, "arch").otherwise(F.lower("p_brand")), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_size").cast("string"))
    return p.select(N.repo_key(repo, version).alias("repo_key"), "p_name").groupBy("repo_key").agg(F.countDistinct("p_name").alias("n_packages"))


P26 = "SELECT CASE WHEN p_size % 5 = 0 THEN 'arch' WHEN p_size % 3 = 0 THEN lower(p_brand) ELSE concat(lower(p_brand), '_', p_size) END AS repo_key, count(DISTINCT p_name) AS n_packages FROM part GROUP BY 1"


def p10_managers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.managers(_rules(spark, sf_dir)).select("rosdep_key", "platform", "os_version", F.array_join("managers", ",").alias("managers"), "manager", F.coalesce(rules.is_manager(F.col("manager")), F.lit(False)).alias("known"), rules.default_manager(F.col("platform")).alias("by_default"))


P10 = f"""WITH {_RULES_SQL} SELECT k AS rosdep_key, p AS platform, v AS os_version, coalesce(string_agg(DISTINCT m, ',') FILTER (WHERE NOT n), '') AS managers, min(m) FILTER (WHERE NOT n) AS manager,
min(m) FILTER (WHERE NOT n) IS NOT NULL AS known, CASE p WHEN 'fedora' THEN 'dnf' ELSE 'apt' END AS by_default FROM r GROUP BY k, p, v"""


def p14_configured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.configured(_rules(spark, sf_dir), _targets(spark)).select("rosdep_key", "os_name", "os_version", "package_manager", F.array_join("packages", ",").alias("packages"))


P14 = f"WITH {_RULES_SQL} SELECT k AS rosdep_key, o AS os_name, v AS os_version, m AS package_manager, packages FROM s WHERE np > 0"


def p15_with_manager(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p14_configured(spark, sf_dir).where("package_manager = 'pip'")


P15 = f"{P14} AND m = 'pip'"

#: Query: (function, SQL).
ALL = {
    "s11_apkindex": (s11_apkindex, S11), "s14_pacman_desc": (s14_pacman_desc, S14), "s34_changed_lines": (s34_changed_lines, S34), "f05_base_name": (f05_base_name, F05), "f10_change_log_name": (f10_change_log_name, F10),
    "f25_multilabel": (f25_multilabel, F25), "m01_iso_times": (m01_iso_times, M01), "m09_clamp": (m09_clamp, M09), "w09_latest_version": (w09_latest_version, W09), "j02_stripped_key": (j02_stripped_key, J02),
    "c12_disjoint_pairs": (c12_disjoint_pairs, C12), "u04_set_tests": (u04_set_tests, U04), "p26_repo_key": (p26_repo_key, P26), "p10_managers": (p10_managers, P10), "p14_configured": (p14_configured, P14), "p15_with_manager": (p15_with_manager, P15),
}
