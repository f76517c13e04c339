"""Archives, resumable tables, comparisons of methods and checks of claims as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare, equivalence, mapping
from ..sources import archives, shared, sinks
from .domain import C02, _entries, dealt, read


def s13_archive_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive for each part; only those that a tenth of the orders' lines ask for are opened."""
    part = dealt(read(spark, sf_dir, "part"))
    files = F.concat(F.transform(F.split("p_name", " "), lambda w: F.concat(F.lit("usr/share/"), w)), F.array(F.lit("usr/share/"), F.concat(F.lit("usr/bin/p"), F.col("p_partkey").cast("string"))))
    index = shared.stored(archives.write(part.select(F.concat(F.lit("pkg-"), F.col("p_partkey").cast("string")).alias("name"), files.alias("files")), shared.new_path(spark, "archives")))
    asked = read(spark, sf_dir, "lineitem").where("l_orderkey % 10 = 0").select(F.concat(F.lit("pkg-"), F.col("l_partkey").cast("string")).alias("name"))
    return archives.hit_lists(index, asked).select("name", F.array_join("files", ",").alias("files"), "error")


S13 = """SELECT 'pkg-' || p_partkey AS name, array_to_string(list_sort(list_distinct(list_transform(string_split(p_name, ' '), lambda w: '/usr/share/' || w) || ['/usr/bin/p' || p_partkey])), ',') AS files, CAST(NULL AS VARCHAR) AS error
FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey % 10 = 0)"""


def k04_resumed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defects of parts, appended twice: first of a third of the parts, then of all; parts of a size fail and are left out."""
    part = read(spark, sf_dir, "part").select(F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("rosdep_key"), "p_partkey", "p_size", "p_type")
    defects = part.where("p_size % 2 = 0").select("rosdep_key", F.explode(F.when(F.col("p_size") % 4 == 0, F.array(F.lit("B.2a"), F.lit("A.2"))).otherwise(F.array(F.lit("B.1a")))).alias("type"), F.col("p_type").alias("package_name"))
    rows = sinks.defect_rows(part, defects, part.where("p_size = 7"))
    table = sinks.ResumableTable(spark, shared.new_path(spark, "defects"), ["rosdep_key"])
    table.append(rows.join(part.where("p_partkey % 3 = 0").select("rosdep_key"), "rosdep_key", "left_semi"))
    table.append(rows)
    return table.read(rows.schema)


K04 = """SELECT 'k' || p_partkey AS rosdep_key, t AS type, CASE WHEN t <> '' THEN p_type END AS package_name, CASE WHEN t = '' THEN 'no_issues' ELSE 'ok' END AS status
FROM (SELECT *, unnest(CASE WHEN p_size % 2 = 1 THEN [''] WHEN p_size % 4 = 0 THEN ['B.2', 'A.2'] ELSE ['B.1a'] END) AS t FROM part WHERE p_size <> 7)"""

_SYSTEMS = ("ubuntu", "debian", "fedora", "gentoo", "arch", "alpine")


def c01_keyword_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From names to tables of packages: parts as an index of six systems, their names as keywords, upstream projects by
    type and size."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size", F.element_at(F.array(*map(F.lit, _SYSTEMS)), (F.col("p_partkey") % 6 + 1).cast("int")).alias("os"))
    entries = _entries(part.withColumn("p_brand", F.col("os")))
    keywords = part.select(F.col("p_name").alias("keyword")).distinct().withColumn("keyword_id", F.crc32("keyword"))
    projects = part.select(F.concat_ws("-", "p_type", "p_size").alias("project"), F.col("os").alias("repo"), F.col("p_name").alias("binname"), F.col("p_name").alias("srcname"), F.lit(None).cast("string").alias("binnames"))
    out = equivalence.tables(keywords, entries, projects)
    return out.join(keywords, "keyword_id").select("keyword", "repo_key", F.array_join("packages", ",").alias("packages"), "score")


def _tables_sql() -> str:
    """C02 from the first system's package of each name, and with the projects' other packages as candidates."""
    head, _, rest = C02.partition("files AS (")
    middle, _, _ = rest.partition("z AS (SELECT")
    parts = f"(SELECT p_partkey, p_name, p_type, p_size, [{', '.join(repr(x) for x in _SYSTEMS)}][p_partkey % 6 + 1] AS p_brand FROM part)"
    about = middle.partition("c AS (")[0].replace("JOIN part p", "JOIN q0 p")
    tail = middle.partition("c AS (")[2]
    tail = tail.replace("arg_min(k, prio) AS k FROM (SELECT * FROM files UNION ALL SELECT * FROM about) GROUP BY 1, 2, 3, 4)", "arg_min(k, prio) AS k, max(prio) = 4 AS up FROM (SELECT * FROM files UNION ALL SELECT * FROM about UNION ALL SELECT * FROM kin) GROUP BY 1, 2, 3, 4)")
    tail = tail.replace("CASE WHEN tn = cn THEN 1 ELSE 0 END", "CASE WHEN tn = cn OR up THEN 1 ELSE 0 END")
    return f"""WITH RECURSIVE q0 AS {parts}, b AS (SELECT p_name AS tn, arg_min({{'td': p_type, 'os': p_brand}}, p_partkey % 6 * 100000000 + p_partkey) AS x FROM q0 GROUP BY 1),
b1 AS (SELECT tn, (CASE (SELECT min(p_partkey % 6) FROM q0 WHERE p_name = b.tn AND p_brand NOT IN ('arch', 'alpine')) IS NULL WHEN true THEN (SELECT arg_min({{'td': p_type, 'os': p_brand}}, CASE p_brand WHEN 'alpine' THEN 0 ELSE 1 END * 100000000 + p_partkey) FROM q0 WHERE p_name = b.tn) ELSE x END) AS x FROM b),
t AS (SELECT tn, x.td AS td, x.os AS os FROM b1), e AS (SELECT p_brand AS brand, p_name AS cn, min(p_partkey) AS k, arg_min(p_type, p_partkey) AS cd FROM q0 GROUP BY 1, 2),
files AS ({about}kin AS (SELECT DISTINCT t.tn, t.td, o.p_brand AS brand, o.p_name AS cn, 4 AS prio, e.k, e.cd FROM t JOIN q0 m ON m.p_name = t.tn AND m.p_brand = t.os JOIN q0 o ON o.p_type = m.p_type AND o.p_size = m.p_size JOIN e ON e.brand = o.p_brand AND e.cn = o.p_name),
c AS ({tail}z AS (SELECT *, row_number() OVER (PARTITION BY tn, td, brand ORDER BY score DESC, prio, k) AS r FROM y WHERE (n = 1 OR best <= 0.5 OR cov > 0) AND score > 0)
SELECT tn AS keyword, brand AS repo_key, cn AS packages, score FROM z WHERE r = 1"""


_WEIGHTS = [round(0.1 * i, 1) for i in range(11)]


def _swept(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Found and true packages of every twentieth part, and the methods: the mapping with each weight."""
    part = read(spark, sf_dir, "part")
    base = part.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("baseline_id"), F.col("p_name").alias("src_name"), F.col("p_name").alias("bin_name"), F.col("p_type").alias("description"), F.split("p_name", " ").alias("filelist"))
    found = equivalence.sweep(base, _entries(part), _WEIGHTS)
    found = found.select(F.concat(F.lit("w"), F.col("w").cast("string")).alias("tool"), F.col("baseline_id").alias("entry"), F.col("repo_name").alias("platform"), F.col("bin_name").alias("name"))
    first = part.groupBy("p_brand", "p_type").agg(F.min("p_name").alias("name"))
    truth = base.select(F.col("baseline_id").alias("entry"), F.col("description").alias("p_type")).join(first, "p_type").select("entry", F.col("p_brand").alias("platform"), "name")
    tools = spark.createDataFrame([(f"w{w}",) for w in _WEIGHTS], "tool string")
    return found, truth, tools


def c08_weight_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mapping with eleven weights against the truth: match rates and their rank (J15, A16, L02), one scan of candidates."""
    found, truth, tools = _swept(spark, sf_dir)
    return compare.overall(compare.platform_matches(truth, found, tools))


def _sweep_sql() -> str:
    """C02 for every weight, and what its packages match."""
    head, _, _ = C02.partition("y AS (SELECT")
    head = head.replace("t AS (SELECT DISTINCT p_name AS tn, p_type AS td FROM part)", "t AS (SELECT DISTINCT p_name AS tn, p_type AS td FROM part WHERE p_partkey % 20 = 0)")
    return f"""{head}g(w) AS (VALUES {', '.join(f'({w}::DOUBLE)' for w in _WEIGHTS)}),
y AS (SELECT *, round(w / 3 * (nr + CASE WHEN tn = cn THEN 1 ELSE 0 END + cov) + (1 - w) / 3 * (2 + dr), 6) AS score, max(cov) OVER g AS best, count(*) OVER g AS n FROM x, g WINDOW g AS (PARTITION BY tn, td, brand, w)),
z AS (SELECT *, row_number() OVER (PARTITION BY tn, td, brand, w ORDER BY score DESC, prio, k) AS r FROM y WHERE (n = 1 OR best <= 0.5 OR cov > 0) AND score > 0),
f AS (SELECT 'w' || z.w AS tool, p.p_partkey AS entry, z.brand AS platform, z.cn AS name FROM part p JOIN z ON z.tn = p.p_name AND z.td = p.p_type WHERE z.r = 1 AND p.p_partkey % 20 = 0),
h AS (SELECT p_brand, p_type, min(p_name) AS name FROM part GROUP BY 1, 2), u AS (SELECT p.p_partkey AS entry, h.p_brand AS platform, h.name FROM part p JOIN h USING (p_type) WHERE p.p_partkey % 20 = 0),
m AS (SELECT 'w' || g.w AS tool, u.entry, u.platform, u.name = f.name AS hit FROM u CROSS JOIN g LEFT JOIN f ON f.tool = 'w' || g.w AND f.entry = u.entry AND f.platform = u.platform),
o AS (SELECT tool, count(*) FILTER (WHERE hit) AS exact, CAST(0 AS BIGINT) AS partial, count(*) FILTER (WHERE hit IS NULL OR NOT hit) AS none, count(*) AS total FROM m GROUP BY 1)
SELECT tool, exact, partial, none, total, round(100.0 * exact / total, 6) AS exact_rate, round(100.0 * exact / total, 6) AS total_rate, CAST(row_number() OVER (ORDER BY round(100.0 * exact / total, 6) DESC, tool) AS INT) AS rank FROM o"""


def a15_repository_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of the brands that suppliers' lines name, for each order and return flag as a method."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("tool"), F.col("l_orderkey").alias("entry"), (F.col("l_suppkey") % 10).cast("string").alias("platform"))
    truth = read(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("entry"), (F.col("l_partkey") % 10).cast("string").alias("platform"))
    out = compare.repository_scores(truth, lines)
    return out.select("tool", "entry", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


A15 = """WITH h AS (SELECT DISTINCT l_returnflag AS tool, l_orderkey AS entry, l_suppkey % 10 AS p FROM lineitem), w AS (SELECT DISTINCT l_orderkey AS entry, l_partkey % 10 AS p FROM lineitem WHERE l_linestatus = 'O'),
t AS (SELECT entry, count(*) AS t FROM w GROUP BY 1), b AS (SELECT h.tool, h.entry, count(*) AS p, count(w.p) AS tp FROM h LEFT JOIN w ON w.entry = h.entry AND w.p = h.p GROUP BY 1, 2)
SELECT tool, b.entry, round(tp / p, 6) AS "precision", round(tp / t, 6) AS recall, round(2.0 * tp / (p + t), 6) AS f1 FROM b JOIN t ON t.entry = b.entry"""


def j21_extra_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as what methods found, those of even parts verified, the truth by the lines that are still open (A17, J21)."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("tool"), F.col("l_orderkey").alias("entry"), (F.col("l_suppkey") % 10).cast("string").alias("platform"), F.col("l_partkey").cast("string").alias("name"), "l_linestatus")
    truth = lines.where("l_linestatus = 'O'").select("entry", "platform", "name")
    matches = compare.platform_matches(truth, lines.select("tool", "entry", "platform", "name"), lines.select("tool"))
    return compare.extras(lines, lines.where("name % 2 = 0"), matches)


J21 = """WITH l AS (SELECT l_returnflag AS tool, l_orderkey AS entry, l_suppkey % 10 AS p, l_partkey AS n, l_linestatus AS s FROM lineitem),
w AS (SELECT entry, p, list_sort(list(DISTINCT n)) AS want FROM l WHERE s = 'O' GROUP BY 1, 2), h AS (SELECT tool, entry, p, list_sort(list(DISTINCT n)) AS have, max(CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END) AS v FROM l GROUP BY 1, 2, 3),
r AS (SELECT h.tool, count(*) AS n_right FROM h JOIN w ON w.entry = h.entry AND w.p = h.p WHERE len(list_intersect(want, have)) > 0 GROUP BY 1),
s AS (SELECT h.tool, count(*) AS entries, count(*) - any_value(coalesce(n_right, 0)) AS extra, count(*) - sum(v) AS unverified FROM h LEFT JOIN r ON r.tool = h.tool GROUP BY 1)
SELECT tool, entries, extra, CAST(unverified AS BIGINT) AS unverified, CASE WHEN extra > 0 THEN round(100.0 * unverified / extra, 6) END AS rate, round(100.0 * unverified / entries, 6) AS rate_of_entries FROM s"""


def c13_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stated of the order lines against what one pass over them measures; the last claim is false."""
    line = read(spark, sf_dir, "lineitem")
    claims = {
        "least line number": (F.min("l_linenumber"), 1), "most quantity": (F.max("l_quantity"), 50), "discounts over a tenth": (F.count_if(F.col("l_discount") > 0.1), 0), "share of known flags": (F.avg(F.col("l_returnflag").isin("A", "N", "R").cast("double")), 1),
        "lines without a part": (F.count_if(F.col("l_partkey").isNull()), 0), "lines without a supplier": (F.count_if(F.col("l_suppkey") < 0), 0), "most line number": (F.max("l_linenumber"), 99),
    }
    return compare.check_claims(line, claims)


C13 = """SELECT claim, CAST(stated AS DOUBLE) AS stated, CAST(measured AS DOUBLE) AS measured, measured = stated AS holds FROM (
SELECT 'least line number' AS claim, 1 AS stated, CAST(min(l_linenumber) AS DOUBLE) AS measured FROM lineitem UNION ALL SELECT 'most quantity', 50, max(l_quantity) FROM lineitem
UNION ALL SELECT 'discounts over a tenth', 0, count(*) FILTER (WHERE l_discount > 0.1) FROM lineitem UNION ALL SELECT 'share of known flags', 1, avg(CASE WHEN l_returnflag IN ('A', 'N', 'R') THEN 1.0 ELSE 0.0 END) FROM lineitem
UNION ALL SELECT 'lines without a part', 0, count(*) FILTER (WHERE l_partkey IS NULL) FROM lineitem UNION ALL SELECT 'lines without a supplier', 0, count(*) FILTER (WHERE l_suppkey < 0) FROM lineitem
UNION ALL SELECT 'most line number', 99, max(l_linenumber) FROM lineitem)"""


def c04_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as the tables of packages that entries are made of: five repositories by size."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("group_id"), "p_size", F.replace("p_name", F.lit(" "), F.lit("-")).alias("n"))
    m = F.col("p_size") % 4
    row = lambda key, ord, name: F.struct(F.lit(key).alias("repo_key"), F.lit(ord).alias("ord"), name.alias("package"))
    n, dev, none = F.col("n"), F.concat("n", F.lit("-dev")), F.lit(None).cast("string")
    rows = (
        F.when(m == 0, F.array(row("ubuntu_noble", 1, n), row("ubuntu_jammy", 0, dev), row("fedora_41", 2, n), row("fedora_42", 3, n)))
        .when(m == 1, F.array(row("arch", 0, n), row("pypi", 1, n), row("debian_12", 2, none)))
        .when(m == 2, F.array(row("debian", 0, n), row("debian", 1, dev), row("haiku_r1", 2, n))).otherwise(F.array(row("nixos_unstable", 0, none)))
    )
    out = mapping.entry_documents(part.select("group_id", F.inline(rows)), ["arch", "ubuntu", "fedora"])
    return out.select("group_id", "rosdep_key", "doc", F.array_join("issues", ",").alias("issues"))


C04 = """SELECT p_partkey AS group_id, CASE WHEN p_size % 4 = 0 THEN n || '-dev' ELSE n END AS rosdep_key, CASE p_size % 4
  WHEN 0 THEN '{"fedora":["' || n || '"],"ubuntu":{"jammy":["' || n || '-dev"],"noble":["' || n || '"]}}' WHEN 1 THEN '{"arch":["' || n || '"],"fedora":{"pip":{"packages":["' || n || '"]}},"ubuntu":{"pip":{"packages":["' || n || '"]}}}'
  ELSE '{"debian":["' || n || '","' || n || '-dev"]}' END AS doc, CASE WHEN p_size % 4 = 2 THEN 'Unknown distribution: haiku' ELSE '' END AS issues FROM (SELECT *, replace(p_name, ' ', '-') AS n FROM part WHERE p_size % 4 < 3)"""


def j23_long_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys whose names lead on over six steps: as many lib before them as the part's size says, up to six."""
    p = read(spark, sf_dir, "part").select("p_partkey", F.least(F.col("p_size") % 7, F.lit(6)).alias("n"))
    keys = p.select(F.concat(F.repeat(F.lit("lib"), F.col("n")), F.lit("x"), F.col("p_partkey").cast("string"), F.lit("-dev")).alias("key"))
    have = p.select(F.concat(F.lit("cmake(x"), F.col("p_partkey").cast("string"), F.lit(")")).alias("name"))
    return mapping.suggestions(keys, have)


J23 = "SELECT repeat('lib', CAST(p_size % 7 AS INT)) || 'x' || p_partkey || '-dev' AS key, 'cmake(x' || p_partkey || ')' AS suggestion FROM part"

#: Query: (function, SQL).
ALL = {
    "c01_keyword_tables": (c01_keyword_tables, _tables_sql()), "s13_archive_lists": (s13_archive_lists, S13), "k04_resumed_table": (k04_resumed_table, K04), "c08_weight_sweep": (c08_weight_sweep, _sweep_sql()), "a15_repository_scores": (a15_repository_scores, A15), "j21_extra_rates": (j21_extra_rates, J21),
    "c13_claims": (c13_claims, C13), "c04_entries": (c04_entries, C04), "j23_long_chains": (j23_long_chains, J23),
}
