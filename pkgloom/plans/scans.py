"""Scans, accessors and exports as queries: metadata is written from the tables and read back by the library's functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import naming, rules
from ..sources import formats, sinks
from .domain import dealt, read


def _dashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(read(spark, sf_dir, "part")).withColumn("n", F.replace("p_name", F.lit(" "), F.lit("-")))


def s06_expand_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.concat("url", F.lit("/$distname/$releasever/$basearch/$basearch"))
    arch = F.when(F.col("page_id") % 2 == 0, "x86_64").otherwise("aarch64")
    return read(spark, sf_dir, "pages").select("page_id", formats.expand_tokens(base, F.lit("fedora"), F.col("page_id").cast("string"), arch).alias("url"))


S06 = "SELECT page_id, concat(url, '/fedora/', page_id, '/', a, '/', a) AS url FROM (SELECT *, CASE WHEN page_id % 2 = 0 THEN 'x86_64' ELSE 'aarch64' END AS a FROM pages) x"


def s07_repomd(spark: SparkSession, sf_dir: str) -> DataFrame:
    href = lambda kind: F.format_string(f'<data type="{kind}"><location href="repodata/%s-{kind}.xml.gz"/></data>', "n")
    xml = F.concat(F.lit("<repomd><revision>1</revision>"), href("other"), F.when(F.col("p_size") % 3 > 0, href("filelists")).otherwise(""), href("primary"), F.lit("</repomd>"))
    doc = _dashed(spark, sf_dir).select("p_partkey", xml.alias("x"))
    return doc.select("p_partkey", formats.repomd_href(F.col("x"), "primary").alias("primary_href"), formats.repomd_href(F.col("x"), "filelists").alias("filelists_href"))


S07 = """SELECT p_partkey, concat('repodata/', n, '-primary.xml.gz') AS primary_href, CASE WHEN p_size % 3 > 0 THEN concat('repodata/', n, '-filelists.xml.gz') END AS filelists_href
FROM (SELECT *, replace(p_name, ' ', '-') AS n FROM part) x"""


def s08_rpm_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_size") % 7 == 0, "srpm").otherwise("rpm")
    head = F.format_string('<package type="%s"><name>%s</name><version epoch="%d" ver="%d" rel="1"/><summary>%s</summary><format><rpm:sourcerpm>%s-src-%d-1.src.rpm</rpm:sourcerpm>', kind, "n", F.col("p_size") % 2, "p_size", "p_type", "n", "p_size")
    given = F.format_string('<rpm:provides><rpm:entry name="lib%s" flags="EQ" epoch="0" ver="%d" rel="2"/><rpm:entry name="any-%d" flags="GE" ver="1"/></rpm:provides></format></package>', "n", "p_partkey", "p_partkey")
    doc = _dashed(spark, sf_dir).select(F.from_xml(F.concat(head, given), formats.PRIMARY, {"attributePrefix": "_"}).alias("p"))
    return formats.rpm_rows(doc.select("p.*"))


S08 = """WITH p AS (SELECT *, replace(p_name, ' ', '-') AS n FROM part WHERE p_size % 7 <> 0)
SELECT n AS name, concat(CASE WHEN p_size % 2 = 1 THEN '1:' ELSE '' END, p_size, '-1') AS version, concat(n, '-src') AS source_name, n AS binary_name, p_type AS description FROM p
UNION ALL SELECT n, concat(p_partkey, '-2'), concat(n, '-src'), concat('lib', n), p_type FROM p UNION ALL SELECT n, NULL, concat(n, '-src'), concat('any-', p_partkey), p_type FROM p"""


def s09_rpm_filelists(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = '<file type="dir">/usr/%d</file><file> /usr/%d/%s </file><file>/opt/%d/</file><file>/usr/%d/%s</file><file>/etc/%s.conf</file>'
    xml = F.format_string(f'<package pkgid="0" name="%s"><version ver="1"/>{files}</package>', "n", "p_size", "p_size", "n", "p_size", "p_size", "n", "n")
    return formats.file_rows(_dashed(spark, sf_dir).select(F.from_xml(xml, formats.FILELISTS).alias("p")).select("p.*"))


S09 = "WITH p AS (SELECT *, replace(p_name, ' ', '-') AS n FROM part) SELECT n AS package, concat('/usr/', p_size, '/', n) AS path FROM p UNION SELECT n, concat('/etc/', n, '.conf') FROM p"


def s15_pacman_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _dashed(spark, sf_dir).withColumn("pkgdir", F.concat_ws("-", "n", "p_partkey"))
    described = part.select("pkgdir", F.format_string("%%NAME%%\n%s\n\n%%VERSION%%\n1-%d\n", "n", "p_size").alias("value"))
    listed = part.select("pkgdir", F.format_string("%%FILES%%\nusr/\nusr/lib/\nusr/lib/%s.so\nusr/bin/%d\n\n%%BACKUP%%\netc/%s.conf\n", "n", "p_size", "n").alias("value"))
    return formats.pacman_files(formats.sections(described), formats.sections(listed))


S15 = "WITH p AS (SELECT *, replace(p_name, ' ', '-') AS n FROM part) SELECT n AS package, concat('usr/lib/', n, '.so') AS path FROM p UNION SELECT n, concat('usr/bin/', p_size) FROM p"


def s22_layer_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as layers, suppliers as branches of layers, parts as recipes."""
    layers = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.lower("n_name").alias("name"))
    branches = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("layer"))
    given = F.when(F.col("p_size") % 4 == 0, "").otherwise(F.concat(F.lit("virtual/"), F.col("p_size").cast("string"), F.lit("  "), "p_brand"))
    recipes = _dashed(spark, sf_dir).select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 17).alias("layerbranch"), F.col("n").alias("pn"), F.col("p_size").cast("string").alias("pv"), F.col("p_type").alias("summary"), given.alias("provides"))
    return formats.recipe_packages(layers, branches, recipes)


S22 = """WITH r AS (SELECT replace(p_name, ' ', '-') AS pn, CAST(p_size AS VARCHAR) AS pv, p_size, p_brand, p_type, lower(n_name) AS l FROM part JOIN supplier ON s_suppkey = p_partkey % 17 JOIN nation ON n_nationkey = s_nationkey)
SELECT pn || '@' || l AS name, pv AS version, pn || '@' || l AS source_name, pn || '@' || l AS binary_name, p_type AS description FROM r
UNION ALL SELECT x || '@' || l, pv, pn || '@' || l, x || '@' || l, p_type FROM (SELECT *, unnest(['virtual/' || pv, p_brand]) AS x FROM r WHERE p_size % 4 <> 0) y"""


def s32_result_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as result files: a list of as many entries as the type's name has letters, one that isn't a list, and some broken."""
    text = F.to_json(F.struct(F.split("event_type", "").alias("a"), F.array("event_id").alias("b"), F.col("event_type").alias("c")))
    files = read(spark, sf_dir, "events").select("user_id", F.when(F.col("event_id") % 5 == 0, F.lit("{broken")).otherwise(text).alias("t"))
    return files.groupBy("user_id").agg(F.count("*").alias("total_packages"), F.sum(formats.listed_entries(F.col("t"))).alias("total_entries"))


S32 = "SELECT user_id, count(*) AS total_packages, CAST(sum(CASE WHEN event_id % 5 = 0 THEN 0 ELSE length(event_type) + 1 END) AS BIGINT) AS total_entries FROM events GROUP BY user_id"


def s33_summary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a summary table with the tools' keys (F28), counts and rates; its header and rule are left out."""
    tool = F.element_at(F.array(*map(F.lit, ("🔍 PackageDistributionDetector (w=0.7)", "🗺️ RepologyMapper", "🤖 LLMDetector (gpt-large)", "Tool"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    line = F.format_string("| %s | %d | %d |  | 0.5%% |", tool, "p_partkey", "p_size")
    lines = read(spark, sf_dir, "part").select(F.explode(F.array(line, F.lit("|---|:---:|"), F.lit("text"))).alias("line"))
    cells = lines.select(formats.table_cells(F.col("line")).alias("c")).select(N.tool_key(F.get("c", F.lit(0))).alias("tool"), F.get("c", F.lit(1)).try_cast("int").alias("exact"), F.get("c", F.lit(2)).try_cast("int").alias("partial"), F.size("c").alias("cells"))
    return cells.where("tool IS NOT NULL")


S33 = "SELECT ['detector_w07', 'mapper', 'llm_gpt_large'][p_partkey % 4 + 1] AS tool, CAST(p_partkey AS INT) AS exact, p_size AS partial, 4 AS cells FROM part WHERE p_partkey % 4 < 3"


def f09_without_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names in three spellings of distributions, without affixes (F08) and without versions and marks (F09)."""
    spelt = F.explode(F.array(F.concat(F.lit("x_"), "n", F.lit("t64-dev")), F.concat(F.lit("python3-x-"), "n", F.lit("-2.0alpha")), F.concat(F.lit("x-"), "n", F.lit("-*")))).alias("name")
    return _dashed(spark, sf_dir).select("p_partkey", spelt).select("p_partkey", "name", N.without_affixes(F.col("name")).alias("plain"), N.without_evolution(F.col("name")).alias("bare"))


F09 = """WITH p AS (SELECT p_partkey, replace(p_name, ' ', '-') AS n FROM part), b AS (SELECT *, 'x-' || replace(replace(replace(n, 'rc', ''), 'alpha', ''), 'beta', '') AS bare FROM p)
SELECT p_partkey, 'x_' || n || 't64-dev' AS name, 'x-' || n || 't64' AS plain, bare FROM b UNION ALL SELECT p_partkey, 'python3-x-' || n || '-2.0alpha', 'x-' || n || '-2.0alpha', bare FROM b
UNION ALL SELECT p_partkey, 'x-' || n || '-*', 'x-' || n || '-*', bare FROM b"""


def f30_export_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws("_", "p_brand", F.when(F.col("p_size") % 3 > 0, F.col("p_size").cast("string")), F.when(F.col("p_size") % 2 > 0, "x"))
    name = F.concat(F.when(F.col("p_size") % 2 == 0, "python3-").otherwise("python-"), "n", F.lit("-dev"))
    return _dashed(spark, sf_dir).select("p_partkey", N.key_parts(key)["os"].alias("os"), N.key_parts(key)["version"].alias("version"), N.pip_name(name).alias("pip_name"))


F30 = "SELECT p_partkey, lower(p_brand) AS os, CASE WHEN p_size % 3 > 0 THEN CAST(p_size AS VARCHAR) WHEN p_size % 2 > 0 THEN 'x' END AS version, replace(p_name, ' ', '_') AS pip_name FROM part"


def f31_report_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = read(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("s"))
    n = F.size("s")
    result = F.when(n == 4, "exact_match").when(n > 1, "partial_match").otherwise("no_match")
    return types.select("user_id", N.short_list(F.col("s")).alias("names"), N.match_status(result, n, F.lit(4)).alias("status"))


F31 = """WITH t AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS s, count(DISTINCT event_type) AS n FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN n <= 3 THEN '`' || array_to_string(s, ', ') || '`' ELSE '`' || array_to_string(s[1:2], ', ') || ', ...` (' || n || ')' END AS names,
CASE WHEN n = 4 THEN '✅ Exact match' WHEN n > 1 THEN '⚠️ Partial match' ELSE '❌ No match' END || ' (' || n || '/4)' AS status FROM t"""


def p18_upstream_platform(spark: SparkSession, sf_dir: str) -> DataFrame:
    platform = F.element_at(F.array(*map(F.lit, ("nixos", "ubuntu", "arch", "debian"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    code = F.when(F.col("p_size") % 5 == 0, "unstable").when(F.col("p_size") % 5 == 1, F.lit(None)).otherwise("noble")
    number = F.when(F.col("p_size") % 5 > 2, F.concat(F.col("p_size").cast("string"), F.lit(".04")))
    return read(spark, sf_dir, "part").select("p_partkey", N.upstream_platform(platform, number, code).alias("platform"))


P18 = """SELECT p_partkey, CASE WHEN p = 'arch' THEN p WHEN p = 'nixos' AND c = 'unstable' THEN 'nix_unstable' ELSE concat(CASE p WHEN 'nixos' THEN 'nix_stable' ELSE p END, CASE WHEN coalesce(v, c) IS NULL THEN '' ELSE concat('_', coalesce(v, c)) END) END AS platform
FROM (SELECT p_partkey, ['nixos', 'ubuntu', 'arch', 'debian'][p_partkey % 4 + 1] AS p, CASE p_size % 5 WHEN 0 THEN 'unstable' WHEN 1 THEN NULL ELSE 'noble' END AS c, CASE WHEN p_size % 5 > 2 THEN concat(p_size, '_04') END AS v FROM part) x"""


def _part_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rules of their brand: three platforms and any, versions 1 to 3 and any, two known managers and one unknown."""
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    key, size = F.col("p_partkey"), F.col("p_size")
    is_null = size % 5 == 0
    return read(spark, sf_dir, "part").select(
        F.concat("p_brand", F.substring_index("p_type", " ", 1)).alias("rosdep_key"), pick(("ubuntu", "debian", "fedora", "*"), key).alias("platform"), pick(("1", "2", "3", "*"), size).alias("os_version"),
        pick(("apt", "pip", "opkg"), F.floor(key / 4)).alias("package_manager"), F.when(~is_null, F.col("p_name")).alias("package"), is_null.alias("is_null"),
    )


_PART_RULES = """r AS (SELECT concat(p_brand, split_part(p_type, ' ', 1)) AS k, ['ubuntu', 'debian', 'fedora', '*'][p_partkey % 4 + 1] AS p, ['1', '2', '3', '*'][p_size % 4 + 1] AS v,
['apt', 'pip', 'opkg'][p_partkey // 4 % 3 + 1] AS m, CASE WHEN p_size % 5 > 0 THEN p_name END AS pkg FROM part)"""


def p09_matched_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the rule of every brand, platform and version of three stands."""
    rule = _part_rules(spark, sf_dir)
    wanted = rule.select("rosdep_key").distinct().select("rosdep_key", F.explode(F.array(*map(F.lit, ("ubuntu", "fedora", "arch")))).alias("os_name")).withColumn("os_version", F.explode(F.array(*map(F.lit, ("1", "2", "9")))))
    return rules.matched(rule, wanted)


P09 = f"""WITH {_PART_RULES}, d AS (SELECT DISTINCT k, p, v FROM r), w AS (SELECT k, o, v FROM (SELECT DISTINCT k FROM r), (VALUES ('ubuntu'), ('fedora'), ('arch')) a(o), (VALUES ('1'), ('2'), ('9')) b(v)),
x AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM d WHERE d.k = w.k AND d.p = w.o) THEN o ELSE '*' END AS ep FROM w),
y AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM d WHERE d.k = x.k AND d.p = x.ep AND d.v = x.v) THEN v WHEN EXISTS (SELECT 1 FROM d WHERE d.k = x.k AND d.p = x.ep AND d.v = '*') THEN '*' END AS ev FROM x)
SELECT k AS rosdep_key, o AS os_name, v AS os_version, CASE WHEN ev IS NOT NULL THEN ep END AS entry_platform, ev AS entry_version FROM y"""


def p11_available_managers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.available_managers(_part_rules(spark, sf_dir)).select("rosdep_key", "platform", F.array_join("managers", ",").alias("managers"))


P11 = f"""WITH {_PART_RULES}, g AS (SELECT k, p, v, coalesce(string_agg(DISTINCT m, ',' ORDER BY m) FILTER (WHERE m <> 'opkg'), '') AS known FROM r WHERE pkg IS NOT NULL GROUP BY 1, 2, 3),
f AS (SELECT k, p, arg_min(known, CASE v WHEN '*' THEN '0' ELSE v END) AS known FROM g GROUP BY 1, 2)
SELECT a.k AS rosdep_key, a.p AS platform, coalesce(known, '') AS managers FROM (SELECT DISTINCT k, p FROM r) a LEFT JOIN f ON f.k = a.k AND f.p = a.p"""


def j22_missing_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules against the parts of even keys, on two architectures."""
    targets = spark.createDataFrame([(o, v, a) for o in ("ubuntu", "debian") for v in "123" for a in ("amd64", "arm64")], "os_name string, os_version string, os_arch string")
    there = read(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.lit("ubuntu").alias("os_name"), (F.col("p_partkey") % 3).cast("string").alias("os_version"), F.lit("amd64").alias("os_arch"), F.col("p_name").alias("name"))
    return rules.verify(_part_rules(spark, sf_dir), targets, there, found=True)


J22 = f"""WITH {_PART_RULES}, t AS (SELECT o, v, a FROM (VALUES ('ubuntu'), ('debian')) x(o), (VALUES ('1'), ('2'), ('3')) y(v), (VALUES ('amd64'), ('arm64')) z(a)),
w AS (SELECT DISTINCT t.o, t.v, t.a, r.k, r.pkg FROM r JOIN t ON t.o = r.p WHERE r.pkg IS NOT NULL AND r.m = 'apt' AND (r.v = t.v OR (r.v = '*' AND NOT EXISTS (SELECT 1 FROM r q WHERE q.k = r.k AND q.p = r.p AND q.v = t.v))))
SELECT o AS os_name, v AS os_version, a AS os_arch, k AS rosdep_key, pkg AS package, o = 'ubuntu' AND a = 'amd64' AND EXISTS (SELECT 1 FROM part WHERE p_name = pkg AND p_partkey % 2 = 0 AND CAST(p_partkey % 3 AS VARCHAR) = v) AS found FROM w"""


def p29_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a document's nodes, a changed line of each order: the node that holds it."""
    line = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 10).alias("line")).agg(F.min("l_partkey").alias("k"))
    nodes = line.select("doc_id", "line", F.lit(0).alias("ord"), F.concat_ws(".", F.lit("root"), "k").alias("path"))
    return formats.at_lines(nodes, read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 75).cast("int").alias("line")))


P29 = """WITH n AS (SELECT l_orderkey AS d, l_linenumber * 10 AS l, min(l_partkey) AS k FROM lineitem GROUP BY 1, 2)
SELECT d AS doc_id, CAST(o_custkey % 75 AS INT) AS line, concat('root.', arg_max(k, l)) AS path FROM (SELECT DISTINCT o_orderkey, o_custkey FROM orders) o JOIN n ON d = o_orderkey AND l <= o_custkey % 75 GROUP BY 1, 2"""


def _record(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _dashed(spark, sf_dir)
    return part.select("p_partkey", F.struct(F.col("n").alias("bin_name"), F.array_sort(F.split("p_name", " ")).alias("filelist"), F.lower("p_brand").alias("repo_name"), F.col("p_size").alias("size")).alias("r"))


def k07_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as lines of JSON (M13: sets as sorted lists), and their fields read back (M12)."""
    lines = _record(spark, sf_dir).select("p_partkey", "r", F.to_json("r").alias("value"))
    back = F.from_json("value", "bin_name string, filelist array<string>, repo_name string, size int")
    return lines.select("p_partkey", "value", (back == F.col("r")).alias("same"))


K07 = """SELECT p_partkey, '{"bin_name":"' || replace(p_name, ' ', '-') || '","filelist":["' || array_to_string(list_sort(string_split(p_name, ' ')), '","') || '"],"repo_name":"' || lower(p_brand) || '","size":' || p_size || '}' AS value, true AS same FROM part"""


def k06_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's table: parts of each brand, how many are large, and their share in whole per cent."""
    brand = read(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.count_if(F.col("p_size") > 25).alias("large"))
    cells = [F.col("p_brand"), F.col("n"), F.col("large"), F.concat(F.floor(100 * F.col("large") / F.col("n")).cast("string"), F.lit("%"))]
    return sinks.table_lines(brand, {"Brand": cells[0], "Parts": cells[1], "Large": cells[2], "Share": cells[3]}, order="p_brand")


K06 = """SELECT 0 AS part, '' AS sort_key, '| Brand | Parts | Large | Share |' AS value UNION ALL SELECT 1, '', '|---|---|---|---|'
UNION ALL SELECT 2, p_brand, concat('| ', p_brand, ' | ', count(*), ' | ', sum(CASE WHEN p_size > 25 THEN 1 ELSE 0 END), ' | ', 100 * sum(CASE WHEN p_size > 25 THEN 1 ELSE 0 END) // count(*), '% |') FROM part GROUP BY p_brand"""


def s02_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.element_at(F.array(*map(F.lit, (".gz", ".xz?a=.gz", ".zst#x", ".zck", ".br", ""))), (F.col("page_id") % 6 + 1).cast("int"))
    return read(spark, sf_dir, "pages").select("page_id", formats.codec(F.concat(F.lit("https://x.org/"), F.col("page_id").cast("string"), end), F.when(F.col("page_id") % 12 == 5, "gzip")).alias("codec"))


S02 = "SELECT page_id, CASE WHEN page_id % 12 = 5 THEN 'gzip' ELSE ['gzip', 'lzma', 'zstd', 'zstd', 'brotli', 'plain'][page_id % 6 + 1] END AS codec FROM pages"


def s04_debian_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a package index with the files that its contents index lists."""
    source = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Source: src-"), "n", F.lit("\n"))).otherwise("")
    part = _dashed(spark, sf_dir).withColumn("n", F.concat_ws("-", "n", "p_partkey"))
    text = part.select(F.concat(F.lit("Package: "), "n", F.lit("\nVersion: 2:"), F.col("p_size").cast("string"), F.lit("-1\n"), source, F.lit("Description: "), "p_type", F.lit("\n more of it")).alias("value"))
    lines = part.where("p_size % 3 > 0").select(F.concat(F.lit("usr/bin/x"), F.col("p_size").cast("string"), F.lit("   libs/"), "n", F.lit(",utils/"), "n").alias("value"))
    files = formats.contents(lines).groupBy(F.col("package").alias("name")).agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("files"))
    return formats.debian_packages(formats.block_fields(text)).join(files, "name", "left")


S04 = """SELECT n AS name, concat('2:', p_size, '-1') AS version, CASE WHEN p_size % 2 = 0 THEN concat('src-', n) ELSE n END AS source_name, n AS binary_name, concat(p_type, ' more of it') AS description,
CASE WHEN p_size % 3 > 0 THEN concat('/usr/bin/x', p_size) END AS files FROM (SELECT *, concat(replace(p_name, ' ', '-'), '-', p_partkey) AS n FROM part) x"""


def s23_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as documents of one attribute each, under packages or at the top."""
    one = F.format_string('{"pkgs.%s-%d":{"pname":"%s","version":"%d","meta":{"description":"%s","free":true}}}', "n", "p_partkey", "n", "p_size", "p_type")
    return formats.attribute_rows(_dashed(spark, sf_dir).select(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('{"version":2,"packages":'), one, F.lit("}"))).otherwise(one).alias("value")))


S23 = "SELECT concat('pkgs.', n, '-', p_partkey) AS name, CAST(p_size AS VARCHAR) AS version, n AS source_name, concat('pkgs.', n, '-', p_partkey) AS binary_name, p_type AS description FROM (SELECT *, replace(p_name, ' ', '-') AS n FROM part) x"


def a13_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three parts in a row as an entry's packages on three platforms, spelt bare, with affixes and with a version."""
    base = F.when(F.col("p_size") % 3 > 0, "tin").otherwise(F.lower(F.element_at(F.split("p_type", " "), -1)))
    k = F.col("p_partkey") % 3
    spelt = F.when(k == 0, base).when(k == 1, F.concat(F.lit("lib"), base, F.when(F.col("p_size") % 2 == 0, "-dev").otherwise(""))).otherwise(F.concat(base, F.when(F.col("p_size") % 2 == 0, "-1.2").otherwise("@layer")))
    packages = read(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 3).alias("entry"), k.cast("string").alias("repo_key"), k.cast("string").alias("platform"), spelt.alias("bin_name"))
    return naming.inconsistencies(packages).select("entry", F.array_join("causes", ",").alias("causes"))


A13 = """WITH p AS (SELECT p_partkey // 3 AS entry, p_partkey % 3 AS k, p_size % 2 = 0 AS even, CASE WHEN p_size % 3 > 0 THEN 'tin' ELSE lower(string_split(p_type, ' ')[-1]) END AS b FROM part),
l AS (SELECT entry, CASE k WHEN 0 THEN b WHEN 1 THEN 'lib' || b || CASE WHEN even THEN '-dev' ELSE '' END ELSE b || CASE WHEN even THEN '-1.2' ELSE '' END END AS l1, CASE WHEN k = 2 AND even THEN b || '-1.2' ELSE b END AS l2, b FROM p),
g AS (SELECT entry, count(*) AS n, count(DISTINCT l1) AS l1, count(DISTINCT l2) AS l2, count(DISTINCT b) AS l3 FROM l GROUP BY entry HAVING count(*) > 1 AND count(DISTINCT l1) > 1)
SELECT entry, CASE WHEN l2 >= l1 AND l3 >= l2 AND l3 = 1 THEN 'unknown' ELSE concat_ws(',', CASE WHEN l2 < l1 THEN 'affixation' END, CASE WHEN l3 < l2 THEN 'evolution' END, CASE WHEN l3 > 1 THEN 'policy' END) END AS causes FROM g"""


def j16_pair_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' types as entries on platforms named by brand, their names' words as files."""
    packages = read(spark, sf_dir, "part").select(F.col("p_type").alias("entry"), F.col("p_brand").alias("platform"), F.format_string("%020d", "p_partkey").alias("bin_name"), F.split("p_name", " ").alias("filelist"))
    return naming.pair_matrix(packages).withColumn("similarity", F.round("similarity", 6))


J16 = """WITH f AS (SELECT p_type AS e, p_brand AS p, list_distinct(string_split(arg_min(p_name, p_partkey), ' ')) AS w FROM part GROUP BY 1, 2),
x AS (SELECT a.e AS entry, a.p AS platform1, b.p AS platform2, CAST(len(a.w) AS INT) AS file_count1, CAST(len(b.w) AS INT) AS file_count2, CAST(len(list_intersect(a.w, b.w)) AS INT) AS shared FROM f a JOIN f b ON a.e = b.e AND a.p < b.p)
SELECT *, file_count1 + file_count2 - shared AS together, round(shared / (file_count1 + file_count2 - shared), 6) AS similarity FROM x"""


#: Query: (function, SQL).
ALL = {
    "s02_codec": (s02_codec, S02), "s04_debian_packages": (s04_debian_packages, S04), "s23_attributes": (s23_attributes, S23), "a13_naming": (a13_naming, A13), "j16_pair_jaccard": (j16_pair_jaccard, J16),
    "s06_expand_tokens": (s06_expand_tokens, S06), "s07_repomd": (s07_repomd, S07), "s08_rpm_primary": (s08_rpm_primary, S08), "s09_rpm_filelists": (s09_rpm_filelists, S09), "s15_pacman_files": (s15_pacman_files, S15),
    "s22_layer_index": (s22_layer_index, S22), "s32_result_counts": (s32_result_counts, S32), "s33_summary_table": (s33_summary_table, S33), "f09_without_evolution": (f09_without_evolution, F09), "f30_export_helpers": (f30_export_helpers, F30),
    "f31_report_cells": (f31_report_cells, F31), "p09_matched_rule": (p09_matched_rule, P09), "p11_available_managers": (p11_available_managers, P11), "p18_upstream_platform": (p18_upstream_platform, P18), "p29_snippets": (p29_snippets, P29),
    "j22_missing_rules": (j22_missing_rules, J22), "k06_report": (k06_report, K06), "k07_json_lines": (k07_json_lines, K07),
}
