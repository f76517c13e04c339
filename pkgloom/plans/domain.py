"""The domain's operators as queries: on the benchmark tables where they fit, else on small inline tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import similarity as S
from ..operators import audit, equivalence, resolve, rules, select
from ..sources import formats


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def dealt(part: DataFrame) -> DataFrame:
    """part dealt out by key, as its file is small enough for one task to read, and what is made of a row is not."""
    return part.repartition("p_partkey")


def of_parts(spark: SparkSession, sf_dir: str, rows: list[tuple], columns: str) -> DataFrame:
    """p_partkey and columns of part, where each part takes its turn among rows; {n} in a text stands for the part's name
    without spaces, {k} for its number."""
    names = columns.split()
    shapes = F.broadcast(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{c} string" for c in names)))
    part = read(spark, sf_dir, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("")).alias("_n"), (F.col("p_partkey") % len(rows)).cast("int").alias("i"))
    filled = lambda c: F.replace(F.replace(c, F.lit("{n}"), F.col("_n")), F.lit("{k}"), F.col("p_partkey").cast("string")).alias(c)
    return dealt(part).join(shapes, "i").select("p_partkey", *map(filled, names))


def parts_sql(rows: list[tuple], columns: str) -> str:
    """The same as a subquery."""
    cell = lambda v: "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"
    values = ", ".join(f"({i}, {', '.join(map(cell, r))})" for i, r in enumerate(rows))
    filled = ", ".join(f"replace(replace({c}, '{{n}}', replace(p_name, ' ', '')), '{{k}}', CAST(p_partkey AS VARCHAR)) AS {c}" for c in columns.split())
    return f"(SELECT p_partkey, {filled} FROM part JOIN (VALUES {values}) v(i, {', '.join(columns.split())}) ON i = p_partkey % {len(rows)})"


def _entries(part: DataFrame) -> DataFrame:
    """part as a package index: the brand is the repository, the type the description."""
    return part.select(
        F.col("p_brand").alias("os_name"), F.lit("").alias("os_version"), F.lit("").alias("os_arch"), F.lit(0).alias("source_ord"), F.col("p_partkey").alias("row_ord"),
        F.col("p_name").alias("name"), F.col("p_name").alias("source_name"), F.col("p_name").alias("binary_name"), F.col("p_type").alias("description"), F.split("p_name", " ").alias("filelist"),
    )


def j01_first_match_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    probes = part.select(F.col("p_partkey").alias("probe_id"), F.col("p_brand").alias("os_name"), F.lit("").alias("os_version"), F.lit("").alias("os_arch"), F.concat(F.lit("-"), F.upper("p_name"), F.lit("-")).alias("probe_name"))
    return resolve.first_match(probes, _entries(part)).select("probe_id", "os_name", F.col("row_ord").alias("found"))


J01 = "SELECT p.p_partkey AS probe_id, p.p_brand AS os_name, min(e.p_partkey) AS found FROM part p JOIN part e ON e.p_brand = p.p_brand AND trim(lower(e.p_name), '-') = trim(lower('-' || upper(p.p_name) || '-'), '-') GROUP BY 1, 2"


def j05_file_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    base = part.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("probe_id"), F.split("p_name", " ").alias("filelist"))
    return resolve.shared_files(base, _entries(part)).select("probe_id", "os_name", "name", F.col("row_ord").alias("first_row"), "n_shared")


J05 = """WITH w AS (SELECT p_partkey, p_brand, p_size, p_name, unnest(list_distinct(string_split(p_name, ' '))) AS f FROM part)
SELECT b.p_partkey AS probe_id, e.p_brand AS os_name, e.p_name AS name, min(e.p_partkey) AS first_row, count(DISTINCT e.f) AS n_shared FROM w b JOIN w e USING (f) WHERE b.p_partkey % 20 = 0 GROUP BY 1, 2, 3"""


def j06_containment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("needle"))
    return resolve.contained(items, read(spark, sf_dir, "documents").select("doc_id", "text"), "needle", "text").select("item_id", "doc_id")


J06 = "SELECT item_id, doc_id FROM (SELECT item_id, lower(trim(text)) AS n FROM benchmark) b JOIN documents d ON contains(lower(trim(d.text)), n) WHERE n <> ''"


def f16_lcs_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("n"))
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("n").alias("m"))
    return p.join(q, "p_partkey").select("p_partkey", F.round(S.lcs_ratio(F.col("n"), F.col("m")), 6).alias("ratio"))


F16 = """WITH RECURSIVE p AS (SELECT p_partkey AS k, p_name AS a FROM part), q AS (SELECT x.k, x.a, y.a AS b FROM p x JOIN p y ON y.k = x.k + 1),
t AS (SELECT k, a, b, 0 AS i, list_transform(range(length(b) + 1), lambda z: 0) AS r FROM q
  UNION ALL SELECT k, a, b, i + 1, list_reduce(range(1, length(b) + 1), lambda done, j: list_append(done, CASE WHEN substr(a, i + 1, 1) = substr(b, CAST(j AS INT), 1) THEN r[j] + 1 ELSE greatest(r[j + 1], done[-1]) END), [0]) FROM t WHERE i < length(a))
SELECT k AS p_partkey, round(CASE WHEN a = b THEN 1.0 ELSE 2.0 * r[-1] / (length(a) + length(b)) END, 6) AS ratio FROM t WHERE i = length(a)"""


def f20_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    a, b = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("a"), "embedding", "label"), e.select(F.col("vec_id").alias("b"), "embedding", "label")
    return resolve.cosines(a, b, ["label"], "a", "b", "embedding", 4).where("a <> b")


F20 = "SELECT x.vec_id AS a, y.vec_id AS b, round(greatest(0, least(1, list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])))), 4) AS cosine FROM embeddings x JOIN embeddings y USING (label) WHERE x.vec_id % 20 = 0 AND x.vec_id <> y.vec_id"


def m06_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", F.split("p_name", " ").alias("w"))
    pairs = resolve.met_in_blocks(p, p.withColumnRenamed("p_partkey", "other"), ["p_brand", "p_size"], "p_partkey", "other", "w", {"jaccard": F.round(S.jaccard(F.col("l"), F.col("r")), 6)})
    return pairs.where("p_partkey < other")


M06 = "WITH p AS (SELECT p_partkey, p_brand, p_size, list_distinct(string_split(p_name, ' ')) AS w FROM part) SELECT x.p_partkey, y.p_partkey AS other, round(len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))), 6) AS jaccard FROM p x JOIN p y USING (p_brand, p_size) WHERE x.p_partkey < y.p_partkey"


def a02_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("baseline_id"), F.col("event_type").alias("src_name"), F.col("event_type").alias("bin_name"), F.lit("r").alias("repo_name"), F.lit("").alias("repo_version"), F.col("event_id").alias("cand_ord"), "props", F.array("event_type").alias("source"), F.col("value").alias("confidence"))
    return select.merge(rows).select("baseline_id", "bin_name", "cand_ord", "props", F.array_join("source", ",").alias("source"), "confidence")


A02 = "SELECT user_id AS baseline_id, event_type AS bin_name, min(event_id) AS cand_ord, arg_min(props, event_id) FILTER (WHERE props <> '') AS props, event_type AS source, max(value) AS confidence FROM events GROUP BY user_id, event_type"


def c02_w01_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mapping on part: for each part the best package of every brand, by shared words, descriptions and names."""
    part = read(spark, sf_dir, "part")
    base = part.select(F.col("p_partkey").alias("baseline_id"), F.col("p_name").alias("src_name"), F.col("p_name").alias("bin_name"), F.col("p_type").alias("description"), F.split("p_name", " ").alias("filelist"))
    return equivalence.detect(base, _entries(part)).select("baseline_id", "repo_name", "bin_name", "score")


C02 = """WITH RECURSIVE t AS (SELECT DISTINCT p_name AS tn, p_type AS td FROM part), e AS (SELECT p_brand AS brand, p_name AS cn, min(p_partkey) AS k, arg_min(p_type, p_partkey) AS cd FROM part GROUP BY 1, 2),
files AS (SELECT t.tn, t.td, e.brand, e.cn, 1 AS prio, e.k, e.cd FROM t JOIN e ON list_has_any(string_split(t.tn, ' '), string_split(e.cn, ' '))),
about AS (SELECT t.tn, t.td, p.p_brand AS brand, p.p_name AS cn, 2 AS prio, min(p.p_partkey) AS k, t.td AS cd FROM t JOIN part p ON contains(lower(p.p_type), lower(t.td)) GROUP BY 1, 2, 3, 4),
c AS (SELECT tn, td, brand, cn, arg_min(cd, prio) AS cd, min(prio) AS prio, arg_min(k, prio) AS k FROM (SELECT * FROM files UNION ALL SELECT * FROM about) GROUP BY 1, 2, 3, 4),
q AS (SELECT DISTINCT tn AS a, cn AS b FROM c UNION SELECT DISTINCT td, cd FROM c),
l AS (SELECT a, b, 0 AS i, list_transform(range(length(b) + 1), lambda z: 0) AS r FROM q
  UNION ALL SELECT a, b, i + 1, list_reduce(range(1, length(b) + 1), lambda done, j: list_append(done, CASE WHEN substr(a, i + 1, 1) = substr(b, CAST(j AS INT), 1) THEN r[j] + 1 ELSE greatest(r[j + 1], done[-1]) END), [0]) FROM l WHERE i < length(a)),
s AS (SELECT a, b, 2.0 * r[-1] / (length(a) + length(b)) AS ratio FROM l WHERE i = length(a)),
x AS (SELECT c.*, len(list_intersect(string_split(tn, ' '), string_split(cn, ' '))) / len(list_distinct(string_split(tn, ' '))) AS cov, n.ratio AS nr, d.ratio AS dr FROM c JOIN s n ON n.a = tn AND n.b = cn JOIN s d ON d.a = td AND d.b = cd),
y AS (SELECT *, round(0.7 / 3 * (nr + CASE WHEN tn = cn THEN 1 ELSE 0 END + cov) + 0.3 / 3 * (2 + dr), 6) AS score, max(cov) OVER g AS best, count(*) OVER g AS n FROM x WINDOW g AS (PARTITION BY tn, td, brand)),
z AS (SELECT *, row_number() OVER (PARTITION BY tn, td, brand ORDER BY score DESC, prio, k) AS r FROM y WHERE (n = 1 OR best <= 0.5 OR cov > 0) AND score > 0)
SELECT p.p_partkey AS baseline_id, z.brand AS repo_name, z.cn AS bin_name, z.score FROM part p JOIN z ON z.tn = p.p_name AND z.td = p.p_type WHERE z.r = 1"""


def j08_upstream_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as packages of upstream projects, named by a word and a size: the siblings of every twentieth."""
    part = read(spark, sf_dir, "part")
    none = F.lit(None).cast("string")
    projects = part.select(F.concat(F.substring_index("p_name", " ", 1), F.col("p_size").cast("string")).alias("project"), F.col("p_brand").alias("repo"), F.col("p_name").alias("binname"), none.alias("srcname"), none.alias("binnames"))
    probes = part.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("probe_id"), F.col("p_brand").alias("repo"), F.col("p_name").alias("binname"))
    return resolve.siblings(probes, projects).select("probe_id", "project", "repo", "binname")


J08 = """WITH f AS (SELECT DISTINCT split_part(p_name, ' ', 1) || p_size AS project, p_brand AS repo, p_name AS binname FROM part)
SELECT DISTINCT p.p_partkey AS probe_id, b.project, b.repo, b.binname FROM part p JOIN f a ON a.repo = p.p_brand AND a.binname = p.p_name JOIN f b ON b.project = a.project WHERE p.p_partkey % 20 = 0"""


def w02_first_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    table = part.select(F.when(F.col("p_size") % 7 == 0, "ros").otherwise(F.col("p_brand")).alias("repo_name"), F.col("p_type").alias("repo_version"), F.col("p_name").alias("bin_name"))
    return select.first_packages(table, part.select(F.col("p_brand").alias("repo_name"), F.col("p_type").alias("repo_version")))


W02 = """WITH t AS (SELECT CASE WHEN p_size % 7 = 0 THEN 'ros' ELSE p_brand END AS r, p_type AS v, p_name AS n FROM part), p AS (SELECT DISTINCT p_brand AS r, p_type AS v FROM part),
f AS (SELECT r, v, min(n) AS n FROM t GROUP BY 1, 2)
SELECT p.r AS repo_name, p.v AS repo_version, coalesce(a.n, b.n) AS bin_name FROM p LEFT JOIN f a ON a.r = p.r AND a.v = p.v LEFT JOIN f b ON b.r = 'ros' AND b.v = p.v WHERE coalesce(a.n, b.n) IS NOT NULL"""


_NAMES = [
    ("python39-{n}", "{n}", "python39-{n}", "py3x"), ("lib{n}-dev", "{n}", "lib{n}-dev", "dev,runtime-lib"), ("dev-python/{n}", "{n}", "{n}", "application"), ("python3-{n}", "{n}", "python3-{n}", "py3"),
    ("golang-x-{n}-dev", "x-{n}", "golang-x-{n}-dev", "dev,go"), ("libreoffice-core", "libreoffice", "libreoffice-core", "core,lib-prefix"), ("{n}@layer", "{n}", "{n}", "application"), ("rubygem-{n}-doc", "{n}", "rubygem-{n}-doc", "doc,ruby"),
]


def f06_clean_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = of_parts(spark, sf_dir, [r[:1] for r in _NAMES], "name")
    return t.select("p_partkey", "name", N.clean_name(F.col("name")).alias("clean"), N.special_name(F.col("name")).alias("special"), F.array_join(N.roles(F.col("name")), ",").alias("roles"))


F06 = f"SELECT * FROM {parts_sql(_NAMES, 'name clean special roles')}"


#: The rules of four keys; each part has those of one of them.
_RULES = [
    ("boost", "ubuntu", "*", "apt", "libboost-dev", False), ("boost", "fedora", "41", "dnf", "boost-devel", False), ("boost", "fedora", "42", "dnf", None, True), ("numpy", "*", "*", "pip", "numpy", False),
    ("numpy", "ubuntu", "noble", "apt", "python3-numpy", False), ("yaml", "ubuntu", "*", "pip", "pyyaml", False), ("gone", "ubuntu", "*", "apt", "libgone", False),
]
_KEYS = ["boost", "numpy", "yaml", "gone"]


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.broadcast(spark.createDataFrame([(_KEYS.index(r[0]), *r) for r in _RULES], "i int, k string, platform string, os_version string, package_manager string, package string, is_null boolean"))
    part = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 4).cast("int").alias("i"))
    return part.join(rows, "i").select(F.concat_ws("-", "k", "p_partkey").alias("rosdep_key"), "platform", "os_version", "package_manager", "package", "is_null")


def _targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("ubuntu", "jammy", 0), ("ubuntu", "noble", 1), ("fedora", "41", 0), ("fedora", "42", 1)], "os_name string, os_version string, ver_ord int")


def p08_three_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.lookup(_rules(spark, sf_dir), _targets(spark).select("os_name", "os_version"))
    return out.select("rosdep_key", "os_name", "os_version", "state", F.coalesce(F.array_join("packages", ","), F.lit("")).alias("packages"))


_RULES_SQL = f"""r(k, p, v, m, pkg, n) AS (SELECT concat(k, '-', p_partkey), p, v, m, pkg, n FROM part JOIN (VALUES {", ".join(f"({_KEYS.index(k)}, '{k}', '{p}', '{v}', '{m}', {f"'{g}'" if g else 'NULL'}, {n})" for k, p, v, m, g, n in _RULES)}) q(i, k, p, v, m, pkg, n) ON i = p_partkey % 4),
t(o, v, ord) AS (VALUES ('ubuntu', 'jammy', 0), ('ubuntu', 'noble', 1), ('fedora', '41', 0), ('fedora', '42', 1)),
w AS (SELECT k.k, t.o, t.v, t.ord, CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.k = k.k AND r.p = t.o) THEN t.o ELSE '*' END AS p FROM (SELECT DISTINCT k FROM r) k, t),
u AS (SELECT w.k, w.o, w.v, w.ord, w.p, CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.k = w.k AND r.p = w.p AND r.v = w.v) THEN w.v ELSE '*' END AS rv FROM w),
s AS (SELECT u.k, u.o, u.v, u.ord, count(r.k) AS n, count(r.pkg) AS np, coalesce(string_agg(r.pkg, ',' ORDER BY r.pkg), '') AS packages, min(r.m) AS m FROM u LEFT JOIN r ON r.k = u.k AND r.p = u.p AND r.v = u.rv GROUP BY 1, 2, 3, 4)"""
P08 = f"WITH {_RULES_SQL} SELECT k AS rosdep_key, o AS os_name, v AS os_version, CASE WHEN n = 0 THEN 'NULL' WHEN np = 0 THEN 'EMPTY' ELSE 'LISTED' END AS state, packages FROM s"


def c03_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = _targets(spark)
    found = spark.createDataFrame([
        ("boost", "ubuntu", "noble", "libboost-dev"), ("boost", "fedora", "42", "boost-devel"), ("numpy", "fedora", "41", "python3-numpy"), ("numpy", "fedora", "42", "python3-numpy"),
        ("yaml", "ubuntu", "jammy", "python3-yaml"), ("yaml", "ubuntu", "noble", "python3-yaml"), ("yaml", "fedora", "41", "python3-pyyaml"), ("numpy", "ubuntu", "noble", "python3-numpy-abi9"), ("gone", "ubuntu", "noble", "gone2"),
    ], "k string, os_name string, os_version string, bin_name string")
    there = spark.createDataFrame([("ubuntu", "noble", "libboost-dev"), ("ubuntu", "jammy", "libboost-dev"), ("fedora", "41", "boost-devel"), ("fedora", "41", "numpy"), ("fedora", "42", "numpy"), ("ubuntu", "jammy", "pyyaml"), ("ubuntu", "noble", "pyyaml"), ("ubuntu", "noble", "python3-numpy"), ("ubuntu", "jammy", "numpy")], "os_name string, os_version string, package string")
    index = _rules(spark, sf_dir)
    keys = index.select("rosdep_key", F.substring_index("rosdep_key", "-", 1).alias("k")).distinct()
    return audit.audit(rules.lookup(index, targets.select("os_name", "os_version")), keys.join(F.broadcast(found), "k").drop("k"), there, targets)


C03 = """SELECT concat(k, '-', p_partkey) AS rosdep_key, os_name, os_version, type, reason, package_name, expected FROM part JOIN (VALUES (0, 'boost', 'fedora', '42', 'B.1b', 'empty_list', NULL, 'boost-devel'), (1, 'numpy', 'fedora', '41', 'B.2a', 'pip', 'numpy', 'python3-numpy'),
(2, 'yaml', 'ubuntu', 'jammy', 'B.2a', 'pip', 'pyyaml', 'python3-yaml'), (2, 'yaml', 'fedora', '41', 'A.2', 'missing', NULL, 'python3-pyyaml'), (3, 'gone', 'ubuntu', 'jammy', 'B.1a', 'not_found', 'libgone', NULL),
(3, 'gone', 'ubuntu', 'noble', 'B.1a', 'not_found', 'libgone', 'gone2'), (1, 'numpy', 'ubuntu', 'noble', 'B.1b', 'differs', 'python3-numpy', 'python3-numpy-abi9')
) t(i, k, os_name, os_version, type, reason, package_name, expected) ON i = p_partkey % 4"""


def c11_index_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of a whole index made of part: rules, mapping and repositories by size, type and number of each part."""
    part = read(spark, sf_dir, "part").select(F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("rosdep_key"), F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), F.col("p_partkey").cast("string")).alias("n"), "p_partkey", F.pmod("p_size", F.lit(5)).alias("m"), "p_type")
    null = F.lit(None).cast("string")
    rule = lambda platform, version, manager, package, empty=False: F.struct(F.lit(platform).alias("platform"), F.lit(version).alias("os_version"), F.lit(manager).alias("package_manager"), package.alias("package"), F.lit(empty).alias("is_null"))
    n, dev = F.col("n"), F.concat("n", F.lit("-dev"))
    some = (
        F.when(F.col("m") == 0, F.array(rule("ubuntu", "*", "apt", null, True))).when(F.col("m") == 1, F.array(rule("ubuntu", "*", "pip", n)))
        .when(F.col("m") == 2, F.array(rule("ubuntu", "*", "apt", n))).when(F.col("m") == 3, F.array(rule("ubuntu", "*", "apt", n), rule("ubuntu", "*", "apt", dev))).otherwise(F.array(rule("fedora", "41", "dnf", n)))
    )
    held = part.where("p_partkey % 7 <> 0")
    index = held.select("rosdep_key", F.inline(some))
    targets = spark.createDataFrame([("ubuntu", "jammy", 0), ("ubuntu", "noble", 1), ("fedora", "41", 0)], "os_name string, os_version string, ver_ord int")
    expected = F.when(F.col("p_type").isin("LARGE", "SMALL"), n).otherwise(F.concat(F.lit("python3-"), n))
    found = part.where("p_type <> 'PROMO'").select("rosdep_key", F.explode(F.array(*(F.struct(F.lit(o).alias("os_name"), F.lit(v).alias("os_version")) for o, v in (("ubuntu", "jammy"), ("ubuntu", "noble"), ("fedora", "41"))))).alias("t"), expected.alias("bin_name")).select("rosdep_key", "t.*", "bin_name")
    has = lambda condition, o, v, name: part.where(condition).select(F.lit(o).alias("os_name"), F.lit(v).alias("os_version"), name.alias("package"))
    there = has("p_partkey % 2 = 0", "ubuntu", "jammy", n).union(has("p_partkey % 3 = 0", "ubuntu", "noble", n)).union(has("p_partkey % 2 = 1", "fedora", "41", n)).union(has("p_partkey % 4 = 0", "ubuntu", "jammy", dev)).union(has("p_partkey % 4 = 0", "ubuntu", "noble", dev))
    there = there.union(has("p_partkey % 11 = 0", "ubuntu", "jammy", F.col("rosdep_key")))
    states = rules.lookup(index, targets.select("os_name", "os_version"))
    return audit.audit(states, found, there, targets, part.select("rosdep_key"), part.where("p_partkey % 5 = 0").select("rosdep_key"))


C11 = """WITH p AS (SELECT 'k' || p_partkey AS key, p_partkey AS i, replace(p_name, ' ', '-') || '-' || p_partkey AS n, p_size % 5 AS m, p_type AS t, p_partkey % 7 <> 0 AS ruled, p_partkey % 5 = 0 AS dist FROM part),
g(o, v, ord) AS (VALUES ('ubuntu', 'jammy', 0), ('ubuntu', 'noble', 1), ('fedora', '41', 0)),
e AS (SELECT p.*, g.*, t <> 'PROMO' AS has, CASE WHEN t IN ('LARGE', 'SMALL') THEN n ELSE 'python3-' || n END AS x,
  CASE WHEN (o = 'ubuntu') = (m < 4) THEN CASE WHEN m = 0 THEN 'EMPTY' ELSE 'LISTED' END ELSE 'NULL' END AS state,
  CASE v WHEN 'jammy' THEN i % 2 = 0 WHEN 'noble' THEN i % 3 = 0 ELSE i % 2 = 1 END AS n_there, o = 'ubuntu' AND i % 4 = 0 AS dev_there FROM p, g WHERE ruled AND (t <> 'PROMO' OR dist)),
f AS (SELECT *, n_there AND (m <> 3 OR dev_there) AS all_there, min(CASE WHEN state = 'LISTED' AND m = 1 AND n_there AND has THEN ord END) OVER (PARTITION BY key, o) AS stop FROM e),
r AS (SELECT * FROM f WHERE stop IS NULL OR ord <= stop)
SELECT key AS rosdep_key, o AS os_name, v AS os_version, 'A.2' AS type, 'missing' AS reason, NULL AS package_name, x AS expected FROM r WHERE state = 'NULL' AND has
UNION ALL SELECT key, o, v, 'B.1b', 'empty_list', NULL, x FROM r WHERE state = 'EMPTY' AND has
UNION ALL SELECT key, o, v, 'B.1a', 'not_found', n, CASE WHEN has THEN x END FROM r WHERE state = 'LISTED' AND NOT n_there
UNION ALL SELECT key, o, v, 'B.1a', 'not_found', n || '-dev', CASE WHEN has THEN x END FROM r WHERE state = 'LISTED' AND m = 3 AND NOT dev_there
UNION ALL SELECT key, o, v, 'B.2a', 'pip', n, x FROM r WHERE state = 'LISTED' AND m = 1 AND n_there AND has
UNION ALL SELECT key, o, v, 'B.1b', 'differs', n, x FROM r WHERE state = 'LISTED' AND m <> 1 AND all_there AND has AND (m = 3 OR x <> n)
UNION ALL SELECT key, NULL, NULL, 'A.1', 'absent', NULL, NULL FROM p WHERE NOT ruled AND NOT dist
UNION ALL SELECT key, NULL, NULL, 'B.1a', 'no_info', NULL, NULL FROM p WHERE ruled AND NOT dist AND t = 'PROMO'
UNION ALL SELECT key, 'ubuntu', 'jammy', 'B.2b', 'in_platform', key, NULL FROM p WHERE dist AND i % 11 = 0"""


def s20_href_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", F.explode(formats.links(F.col("html"))).alias("href")).groupBy("page_id").agg(F.count("*").alias("n"), F.countDistinct("href").alias("n_distinct"))


S20 = "SELECT page_id, count(*) AS n, count(DISTINCT href) AS n_distinct FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY page_id"


def s23_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


S23 = "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"


_TOKENS = [("so:lib{n}.so.6=6", "so", "lib{n}.so.6", "6"), ("{n}", None, "{n}", None), ("cmd:{n}", "cmd", "{n}", None), ("{n}=1.{k}", None, "{n}", "1.{k}")]


def s12_dep_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = of_parts(spark, sf_dir, [r[:1] for r in _TOKENS], "token")
    return t.select("p_partkey", "token", formats.dependency(F.col("token")).alias("d")).select("p_partkey", "token", F.col("d.type").alias("type"), F.col("d.name").alias("name"), F.col("d.version").alias("version"))


S12 = f"SELECT * FROM {parts_sql(_TOKENS, 'token type name version')}"


_BLOCKS = [
    ("Package: {n}{k}g\nSource: {n}\nVersion: 1.3\nDescription: compression\n library", "{n}{k}g", "1.3", "{n}", "{n}{k}g", "compression library"), ("Package: {n}{k}\nVersion: 5.{k}", "{n}{k}", "5.{k}", "{n}{k}", "{n}{k}", None),
    ("Package: x\nVersion: 1\nPackage: {n}{k}\nno field\nDescription: a:b", "{n}{k}", "1", "{n}{k}", "{n}{k}", "a:b"),
]


def s03_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.debian_packages(formats.block_fields(of_parts(spark, sf_dir, [r[:1] for r in _BLOCKS], "value").select("value")))


S03 = f"SELECT name, version, source_name, binary_name, description FROM {parts_sql([r[1:] for r in _BLOCKS], 'name version source_name binary_name description')}"


_CONTENTS = [("usr/lib/lib{n}{k}.so.1   libs/{n}1g:amd64,libs/{n}2", "/usr/lib/lib{n}{k}.so.1", "{n}1g,{n}2"), ("usr/share/a {k} c  doc/{n}", "/usr/share/a {k} c", "{n}"), ("no package", None, "")]


def s05_contents_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.contents(of_parts(spark, sf_dir, [r[:1] for r in _CONTENTS], "value").select("value").where("value <> 'no package'"))


S05 = f"SELECT unnest(string_split(packages, ',')) AS package, path FROM {parts_sql([r[1:] for r in _CONTENTS], 'path packages')} WHERE path IS NOT NULL"


_VERSIONS = [("python3-{n}2", "{n}2-dev", "1", "{n}"), ("{n}2", "{n}3", "0", "{n}"), ("{n}", "bar", "1", "{n}"), ("{n}2", "{n}", "0", "{n}")]


def f18_version_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = of_parts(spark, sf_dir, [r[:2] for r in _VERSIONS], "a b")
    return t.select("p_partkey", "a", "b", S.version_similarity(S.versions(F.col("a")), S.versions(F.col("b"))).alias("same"), S.core_name(F.col("a")).alias("core"))


F18 = f"SELECT p_partkey, a, b, CAST(same AS DOUBLE) AS same, core FROM {parts_sql(_VERSIONS, 'a b same core')}"


#: Query: (function, SQL or None).
ALL = {
    "j01_first_match_lookup": (j01_first_match_lookup, J01), "j05_file_overlap": (j05_file_overlap, J05), "j06_containment_join": (j06_containment_join, J06), "f16_lcs_ratio": (f16_lcs_ratio, F16),
    "f20_cosine": (f20_cosine, F20), "m06_jaccard": (m06_jaccard, M06), "a02_merge_dedup": (a02_merge_dedup, A02), "c02_w01_best_match": (c02_w01_best_match, C02), "f06_clean_name": (f06_clean_name, F06),
    "p08_three_state": (p08_three_state, P08), "c03_defects": (c03_defects, C03), "c11_index_scan": (c11_index_scan, C11), "j08_upstream_siblings": (j08_upstream_siblings, J08), "w02_first_package": (w02_first_package, W02), "s20_href_scan": (s20_href_scan, S20), "s23_json_props": (s23_json_props, S23), "s12_dep_tokens": (s12_dep_tokens, S12),
    "s03_blocks": (s03_blocks, S03), "s05_contents_lines": (s05_contents_lines, S05), "f18_version_sim": (f18_version_sim, F18),
}
