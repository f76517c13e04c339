"""Reports, histories and studies as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import reports
from ..sources import config, formats, shared, sinks
from .domain import C11, c11_index_scan, of_parts, parts_sql, read

_TYPES = {"A.1": "Entry not found in database", "A.2": "Missing platform/version in entry", "B.1a": "Package not found in repository", "B.1b": "Package name differs from expected", "B.2a": "Using pip when OS repo has it", "B.2b": "Distribution entry exists in OS repo"}
_MESSAGE = """CASE type WHEN 'A.1' THEN 'Entry ''' || k || ''' not found in database' WHEN 'A.2' THEN 'Entry ''' || k || ''' missing version ''' || v || ''' for platform ''' || o || '''; suggested package: ''' || e || ''''
WHEN 'B.1a' THEN CASE WHEN reason <> 'not_found' THEN 'No distribution info found for entry ''' || k || '''' ELSE 'Package ''' || p || ''' not found in ' || o || ' ' || v || CASE WHEN e <> '' THEN '; detected existing package: ''' || e || '''' ELSE '' END END
WHEN 'B.1b' THEN CASE reason WHEN 'differs' THEN 'Package ''' || p || ''' differs from expected ''' || e || ''' in ' || o || ' ' || v ELSE 'Empty package list for ' || o || ' ' || v || '; expected package: ''' || e || '''' END
WHEN 'B.2a' THEN 'Entry ''' || k || ''' using pip but package ''' || e || ''' available in ' || o || ' ' || v ELSE 'Distribution entry ''' || k || ''' exists in ' || o || ' ' || v || ' as ''' || p || '''' END"""
_TOLD = f"""d AS ({C11}), n AS (SELECT type, reason, rosdep_key AS k, coalesce(os_name, '') AS o, coalesce(os_version, '') AS v, coalesce(package_name, '') AS p, coalesce(expected, '') AS e FROM d), m AS (SELECT k, type, {_MESSAGE} AS m FROM n)"""


def f29_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    defects = c11_index_scan(spark, sf_dir)
    return defects.select("rosdep_key", "type", reports.defect_message(defects).alias("message"))


F29 = f"WITH {_TOLD} SELECT k AS rosdep_key, type, m AS message FROM m"


def k05_defect_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = read(spark, sf_dir, "part").select(F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("rosdep_key"))
    return reports.defect_reports(keys, c11_index_scan(spark, sf_dir))


K05 = f"""WITH {_TOLD}, t AS (SELECT k, type, '- **Type ' || type || '**: ' || CASE type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TYPES.items())} END || chr(10) || string_agg('  - ' || m, chr(10) ORDER BY m) || chr(10) AS s FROM m GROUP BY k, type),
b AS (SELECT k, string_agg(s, chr(10) ORDER BY type) AS b FROM t GROUP BY k)
SELECT 'k' || p_partkey AS rosdep_key, chr(10) || '### Entry: `k' || p_partkey || '`' || chr(10) || chr(10) || coalesce(b, '- No issues detected' || chr(10)) AS value FROM part LEFT JOIN b ON b.k = 'k' || p_partkey"""


def k11_broken_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").where("l_quantity > 45")
    broken = lines.select(F.concat(F.lit("os"), F.col("l_returnflag")).alias("os_name"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber").cast("string")).alias("os_version"), F.lower("l_linestatus").alias("os_arch"), F.concat(F.lit("k"), F.col("l_suppkey").cast("string")).alias("rosdep_key"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("package"))
    return reports.broken_summary(broken)


K11 = """WITH m AS (SELECT DISTINCT 'os' || l_returnflag || CASE WHEN l_linenumber % 2 = 0 THEN ' ' || l_linenumber ELSE '' END || ' on ' || lower(l_linestatus) AS platform, '- Package p' || l_partkey || ' for rosdep key k' || l_suppkey AS m FROM lineitem WHERE l_quantity > 45)
SELECT platform, '* The following ' || count(*) || ' packages were not found for ' || platform || ':' || chr(10) || string_agg(m, chr(10) ORDER BY m) AS value FROM m GROUP BY platform"""


def k08_latex_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = read(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.count_if(F.col("p_size") > 25).alias("large"))
    cells = {"Brand": F.col("p_brand"), "Parts": F.col("n"), "Share": F.concat(F.floor(100 * F.col("large") / F.col("n")).cast("string"), F.lit("%"))}
    return reports.latex_lines(brand, cells, order="p_brand", best="Parts")


K08 = r"""WITH b AS (SELECT p_brand, count(*) AS n, count(*) FILTER (WHERE p_size > 25) AS large FROM part GROUP BY 1)
SELECT 0 AS part, '' AS sort_key, '\begin{tabular}{lll}' AS value UNION ALL SELECT 1, '', 'Brand & Parts & Share \\' UNION ALL SELECT 2, '', '\hline' UNION ALL SELECT 4, '', '\end{tabular}'
UNION ALL SELECT 3, p_brand, replace(p_brand, '#', '\#') || ' & ' || CASE WHEN n = (SELECT max(n) FROM b) THEN '\textbf{' || n || '}' ELSE CAST(n AS VARCHAR) END || ' & ' || (100 * large // n) || '\% \\' FROM b"""


def _changed_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as the packages of keys: even lines were there before, all are after, in the spellings of packagings."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("change_id"), (F.col("l_suppkey") % 3).cast("string").alias("key"), "l_linenumber", F.concat(F.lit("p"), (F.col("l_partkey") % 7).cast("string")).alias("n"), F.pmod("l_linenumber", F.lit(3)).alias("m"))
    name = F.when(F.col("m") == 0, F.concat(F.lit("lib"), "n", F.lit("-dev"))).when(F.col("m") == 1, F.concat("n", F.lit("-devel"))).otherwise(F.col("n"))
    sides = F.when(F.col("l_linenumber") % 2 == 0, F.array(F.lit("before"), F.lit("after"))).otherwise(F.array(F.lit("after")))
    return lines.select("change_id", "key", F.explode(sides).alias("side"), name.alias("name"))


def a11_name_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes that let the names of a key grow, among those that are still open and the others."""
    growth = reports.name_growth(_changed_packages(spark, sf_dir))
    return reports.growing_changes(growth, read(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("change_id")))


A11 = """WITH l AS (SELECT l_orderkey AS c, l_suppkey % 3 AS k, 'p' || l_partkey % 7 AS n, l_linenumber % 3 AS m, l_linenumber % 2 = 0 AS b FROM lineitem),
g AS (SELECT c, k, count(DISTINCT n || m) AS ra, count(DISTINCT n || m) FILTER (WHERE b) AS rb, count(DISTINCT n) AS pa, count(DISTINCT n) FILTER (WHERE b) AS pb FROM l GROUP BY 1, 2),
p AS (SELECT c, bool_or(ra > 1 AND ra > rb) AS r, bool_or(pa > 1 AND pa > pb) AS p FROM g GROUP BY 1)
SELECT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = c AND o_orderstatus = 'O') AS flagged, count(*) AS n, count(*) FILTER (WHERE r) AS raw, count(*) FILTER (WHERE p) AS plain FROM p GROUP BY 1"""


def a12_chained_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of later commits by the priority of an order, whose number says what they were about."""
    texts = F.element_at(F.array(*map(F.lit, ("No modifications found", "ERROR", "lint, A.1", "B.1a", "key", "yamllint"))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    kind = reports.chained_class(texts)
    rows = read(spark, sf_dir, "orders").select("o_orderpriority", kind.alias("kind"))
    return rows.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "linter").alias("linter"), F.count_if(F.col("kind") == "rule").alias("rule"))


A12 = "SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_orderkey % 6 IN (2, 5)) AS linter, count(*) FILTER (WHERE o_orderkey % 6 = 3) AS rule FROM orders GROUP BY 1"


def a14_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source that labels call toxic or not."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "source")
    return reports.overlap(docs, read(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("key")), "source")


A14 = """WITH d AS (SELECT doc_id, source, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS b FROM documents)
SELECT source AS category, count(DISTINCT doc_id) AS n, count(DISTINCT doc_id) FILTER (WHERE b) AS both, round(100.0 * count(DISTINCT doc_id) FILTER (WHERE b) / count(DISTINCT doc_id), 6) AS share FROM d GROUP BY 1
UNION ALL SELECT 'all', count(DISTINCT doc_id), count(DISTINCT doc_id) FILTER (WHERE b), round(100.0 * count(DISTINCT doc_id) FILTER (WHERE b) / count(DISTINCT doc_id), 6) FROM d"""


def a18_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return flags as sources, orders as entries, parts as packages."""
    return reports.compare_sources(read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("source"), (F.col("l_orderkey") % 500).cast("string").alias("key"), (F.col("l_partkey") % 50).cast("string").alias("package")))


A18 = """WITH r AS (SELECT DISTINCT l_returnflag AS s, l_orderkey % 500 AS k, l_partkey % 50 AS p FROM lineitem), c AS (SELECT *, count(*) OVER (PARTITION BY k, p) AS c FROM r)
SELECT s AS source, count(DISTINCT k) AS entries, count(*) AS packages, count(*) FILTER (WHERE c = 1) AS "only" FROM c GROUP BY 1"""


def c09_truth_of_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as changes of their customer's key, their lines as what they leave; keys of every seventh customer are python ones."""
    key = F.concat(F.when(F.col("o_custkey") % 7 == 0, "python-c").otherwise("c"), F.col("o_custkey").cast("string"))
    changes = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("change_id"), F.col("o_orderdate").alias("at"), key.alias("key"))
    repo = F.element_at(F.array(*map(F.lit, ("ubuntu_noble", "debian_12", "fedora_41", "arch"))), (F.col("l_suppkey") % 4 + 1).cast("int"))
    left = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("change_id"), repo.alias("repo_key"), F.col("l_partkey").cast("string").alias("package")).join(changes.select("change_id", "key"), "change_id")
    return reports.ground_truth(changes, left)


C09 = """WITH o AS (SELECT o_orderkey AS c, o_orderdate AS ts, CASE WHEN o_custkey % 7 = 0 THEN 'python-c' ELSE 'c' END || o_custkey AS k FROM orders), z AS (SELECT k, arg_max(c, CAST(ts AS VARCHAR) || lpad(CAST(c AS VARCHAR), 20, '0')) AS c FROM o WHERE k NOT LIKE 'python-%' GROUP BY 1),
r AS (SELECT DISTINCT k AS "key", ['ubuntu_noble', 'debian_12', 'fedora_41', 'arch'][l_suppkey % 4 + 1] AS repo_key, CAST(l_partkey AS VARCHAR) AS package FROM lineitem JOIN z ON c = l_orderkey)
SELECT * FROM r WHERE "key" IN (SELECT "key" FROM r GROUP BY 1 HAVING bool_or(repo_key = 'ubuntu_noble') AND count(DISTINCT repo_key) >= 2)"""


def p24_cross_platform_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("key"), F.concat_ws("_", F.concat(F.lit("os"), (F.col("l_suppkey") % 4).cast("string")), F.col("l_linestatus")).alias("repo_key"), (F.col("l_partkey") % 20).cast("string").alias("package"))
    return reports.cross_platform(lines).distinct()


P24 = """WITH r AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS "key", 'os' || l_suppkey % 4 || '_' || l_linestatus AS repo_key, CAST(l_partkey % 20 AS VARCHAR) AS package FROM lineitem),
o AS (SELECT "key", repo_key, count(*) AS n FROM r GROUP BY 1, 2) SELECT * FROM r WHERE "key" IN (SELECT "key" FROM o GROUP BY 1 HAVING max(n) = 1 AND count(DISTINCT split_part(repo_key, '_', 1)) >= 2)"""


def c10_study_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that two loads give, the second with later dates; those whose lines are all of parts of the index."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("change_id"), F.col("o_orderdate").alias("at"), "o_orderstatus")
    loads = o.select("change_id", "at", F.lit(0).alias("load_ord")).union(o.where("o_orderstatus <> 'F'").select("change_id", F.timestamp_add("DAY", F.lit(1), "at"), F.lit(1)))
    touched = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("change_id"), F.col("l_partkey").cast("string").alias("key"))
    index = read(spark, sf_dir, "part").where("p_size < 45").select(F.col("p_partkey").cast("string").alias("key"))
    out = reports.study_changes(loads, touched, index, o.where("change_id % 100 = 7").select("change_id"))
    return out.select("change_id", "at", F.array_join("keys", ",").alias("keys"))


C10 = """SELECT o_orderkey AS change_id, CASE WHEN o_orderstatus <> 'F' THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END AS at, string_agg(DISTINCT CAST(l_partkey AS VARCHAR), ',' ORDER BY CAST(l_partkey AS VARCHAR)) AS keys
FROM orders JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey AND p_size < 45 WHERE o_orderkey % 100 <> 7 GROUP BY o_orderkey, o_orderdate, o_orderstatus HAVING count(*) = count(p_partkey)"""


def s31_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written as CSV with commas, quotes and line breaks in their fields, and read back."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("key"), F.concat(F.lit('a "'), "p_name", F.lit('", b')).alias("quoted"), F.when(F.col("p_size") % 2 == 0, F.concat("p_type", F.lit("\\n"), "p_brand")).alias("broken"))
    path = shared.new_path(spark, "csv")
    sinks.write_csv(part, path)
    return formats.csv_rows(spark, path, "key string, quoted string, broken string")


S31 = """SELECT CAST(p_partkey AS VARCHAR) AS "key", 'a "' || p_name || '", b' AS quoted, CASE WHEN p_size % 2 = 0 THEN p_type || '\\n' || p_brand END AS broken FROM part"""


def s20_portage_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand as the listing of a category's page: folders are packages, if their name may be one."""
    part = read(spark, sf_dir, "part").select(F.lower(F.regexp_replace("p_brand", "#", "-")).alias("category"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("n"), "p_partkey", (F.col("p_partkey") % 6).alias("m"))
    href = F.when(F.col("m") == 0, F.concat("n", F.lit("/"))).when(F.col("m") == 1, F.concat(F.lit("/"), "n", F.lit("/"))).when(F.col("m") == 2, F.col("n")).when(F.col("m") == 3, F.lit("../")).when(F.col("m") == 4, F.concat(F.lit("_"), "n", F.lit("/"))).otherwise(F.concat("n", F.lit("+"), F.col("p_partkey").cast("string"), F.lit("/")))
    pages = part.groupBy("category").agg(F.array_join(F.collect_list(F.concat(F.lit('<a href="'), href, F.lit('">x</a>'))), "<br>").alias("html"))
    return formats.portage_packages(pages).select("name", "version", "source_name")


S20 = """SELECT DISTINCT n AS name, 'unknown' AS version, c || '/' || n AS source_name FROM (SELECT lower(replace(p_brand, '#', '-')) AS c, replace(p_name, ' ', '-') || CASE WHEN p_partkey % 6 = 5 THEN '+' || p_partkey ELSE '' END AS n FROM part WHERE p_partkey % 6 IN (0, 5))"""

def s24_ros_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of a robotics distribution: packages under its name and others."""
    rows = [("Package: ros-jazzy-{n}-{k}\nVersion: {k}\nDescription: d",), ("Package: {n}{k}\nVersion: 1",), ("Package: ros-jazzy-{n}{k}\nSource: ros-{n}\nVersion: 2",)]
    text = of_parts(spark, sf_dir, rows, "value").select("value")
    return formats.ros_packages(formats.block_fields(text)).select("name", "key", "version", "source_name")


S24 = f"""SELECT * FROM {parts_sql([("ros-jazzy-{n}-{k}", "{n}-{k}", "{k}", "ros-jazzy-{n}-{k}"), (None, None, None, None), ("ros-jazzy-{n}{k}", "{n}{k}", "2", "ros-{n}")], "name key version source_name")} WHERE name IS NOT NULL"""
S24 = S24.replace("SELECT * FROM", 'SELECT name, "key", version, source_name FROM', 1)


def p23_relevant_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = of_parts(spark, sf_dir, [("{n}",), ("{n}-debuginfo",), ("{n}-debugsource",), ("{n}-debug",)], "name")
    return t.where(~N.is_debug(F.col("name")))


P23 = f"SELECT * FROM {parts_sql([('{n}',), (None,), (None,), ('{n}-debug',)], 'name')} WHERE name IS NOT NULL"

_SPLIT = [("ubuntu_{k}", "ubuntu", "{k}"), ("nix_stable_{k}", "nix_stable_{k}", ""), ("arch", "arch", ""), ("_{k}", "", "{k}")]


def p27_split_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = of_parts(spark, sf_dir, [r[:1] for r in _SPLIT], "repo_key")
    return t.select("p_partkey", "repo_key", N.split_key(F.col("repo_key")).alias("x")).select("p_partkey", "repo_key", "x.*")


P27 = f"SELECT p_partkey, repo_key, platform, version FROM {parts_sql(_SPLIT, 'repo_key platform version')}"


def p28_system_platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of a region as the systems of its configuration, with two that are none."""
    n = read(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("file"), F.when(F.col("c_custkey") % 5 == 0, "pypi").when(F.col("c_custkey") % 5 == 1, "ros").otherwise(F.lower("c_mktsegment")).alias("os_name"))
    return config.systems(n).select("file", F.array_join("os_names", ",").alias("os_names"))


P28 = "SELECT CAST(c_nationkey AS VARCHAR) AS file, string_agg(DISTINCT lower(c_mktsegment), ',' ORDER BY lower(c_mktsegment)) AS os_names FROM customer WHERE c_custkey % 5 > 1 GROUP BY 1"

#: Query: (function, SQL).
ALL = {
    "f29_messages": (f29_messages, F29), "k05_defect_reports": (k05_defect_reports, K05), "k11_broken_summary": (k11_broken_packages, K11), "k08_latex_table": (k08_latex_table, K08), "a11_name_growth": (a11_name_growth, A11), "a12_chained_changes": (a12_chained_changes, A12),
    "a14_overlap_shares": (a14_overlap, A14), "a18_source_counts": (a18_sources, A18), "c09_truth_of_changes": (c09_truth_of_changes, C09), "p24_cross_platform_keys": (p24_cross_platform_keys, P24), "c10_study_changes": (c10_study_changes, C10),
    "s24_ros_index": (s24_ros_index, S24), "p23_relevant_names": (p23_relevant_names, P23), "p27_split_repo_keys": (p27_split_keys, P27), "p28_systems": (p28_system_platforms, P28), "s31_csv_round_trip": (s31_csv_rows, S31), "s20_portage_listings": (s20_portage_listings, S20),
}
