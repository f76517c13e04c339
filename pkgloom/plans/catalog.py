"""Operators on files, rule documents and spellings as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import files
from ..functions import names as N
from ..functions import similarity as S
from ..operators import mapping, resolve
from .domain import of_parts, parts_sql, read


# fixed values: paths and the components that they stand for
COMPONENTS = [
    ("/usr/share/libvncserver/examples/client/ppmtest", "libvncserver/examples/client/*"), ("/usr/bin/clang-format", "clang-format"), ("/usr/bin/core_perl/perl", "core_perl/perl"), ("/usr/local/bin/cmake", "cmake"),
    ("/usr/lib64/libcurl.so.4.8.0", "libcurl.so"), ("/usr/lib64/libz.so.1", "libz.so"), ("/usr/include/openssl/ssl.h", "openssl/ssl.h"), ("/usr/include/zlib.h", "zlib.h"), ("/etc/nginx/nginx.conf", None),
    ("/etc/sshd_config", "sshd_config"), ("/usr/lib/systemd/system/docker.service", "systemd/system/docker.service"), ("/usr/lib64/libavcodec.a", "libavcodec.a"), ("/usr/share/doc/nginx/README", None),
    ("/usr/lib64/qt6/qml/QtQuick/Dialogs/Dialog.qml", "qt6/qml/qtquick/dialogs/*.qml"), ("/usr/lib64/qt6/qml/QtQuick/Dialogs/libqtquickdialogsplugin.so", "libqtquickdialogsplugin.so"), ("/usr/lib/systemd/system/docker.d", None),
    ("/etc/X11/app-defaults/XBarrel", "x11/app-defaults/xbarrel"), ("/usr/lib/python3/dist-packages/bson/_cbson.cpython-312-x86_64-linux-gnu.so", "_cbson.so"), ("/usr/lib/python3/dist-packages/bson/code.py", "bson/code.py"),
    ("/usr/lib/.build-id/3a/a0a0a6f98f668a3c635153764b917f5b4ee7d6", None), ("/lib64/python3.14/site-packages/gi/_gi_cairo.cpython-314-x86_64-linux-gnu.so", "_gi_cairo.so"),
    ("/usr/include/x86_64-linux-gnu/qt6/QtCore/6.4.2/QtCore/private/qcoffpeparser_p.h", "qt6/qtcore/qtcore/private/*.h"), ("/usr/share/man/man1/ls.1.gz", None), ("/usr/share/locale/zh_CN/LC_MESSAGES/wget.mo", None),
    ("/usr/share/icons/hicolor/48x48/apps/firefox.png", None), ("/usr/lib/debug/usr/bin/ls.debug", None), ("/usr/lib/python3/dist-packages/pip/__init__.py", None), ("/usr/share/doc/curl/COPYING", None),
    ("/etc/X11/Xsession.d/99x11-common_start", None), ("/usr/lib64/.build-id/4b/e2d752f573b051340b4ccb70868e8842f6c664", None), ("pymongo-4.16.0.dist-info/licenses/LICENSE", None), ("/usr/share/lintian/overrides/libqt5quick5", None),
    ("/usr/include/x86_64-linux-gnu/atlas/atlas_csysinfo.h", "atlas/atlas_csysinfo.h"), ("/usr/include/atlas-aarch64-base/zmm.h", "atlas/zmm.h"), ("/usr/include/aarch64/atlas/atlas_csysinfo.h", "atlas/atlas_csysinfo.h"),
    ("/usr/lib/x86_64-linux-gnu/qt6/qml/QtQml/libqmlplugin.so", "libqmlplugin.so"), ("/usr/lib/qt6/qml/QtQml/libqmlplugin.so", "libqmlplugin.so"), ("orjson/orjson.cpython-310-darwin.so", "orjson.so"),
    ("/usr/lib/python3.6/site-packages/fabric/__pycache__/__init__.cpython-36.pyc", "fabric/__pycache__/__init__.cpython-36.pyc"), ("/usr/lib/python3.6/site-packages/fabric/__pycache__/__main__.cpython-36.pyc", "fabric/__pycache__/__main__.cpython-36.pyc"),
    ("/usr/share/icons/Adwaita/16x16/actions/call-stop-symbolic.symbolic.png", "icons/adwaita/16x16/actions/*.png"), ("/usr/share/icons/adwaita/cursors/alias", "icons/adwaita/cursors/*"), ("/usr/lib64/libSDL_ttf-2.0.so.0", "libsdl_ttf.so"),
    ("/usr/share/java/mockito-core-2.23.0.jar", "mockito-core.jar"), ("/usr/share/java/mockito/mockito-core-2.23.0.jar", "mockito-core.jar"), ("/usr/lib/python3/dist-packages/PyQt6/QtWebEngineCore.abi3.so", "QtWebEngineCore.so"), ("", None),
]


def f01_component_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.component_id(of_parts(spark, sf_dir, [(p,) for p, _ in COMPONENTS], "path"))


F01 = f"SELECT * FROM {parts_sql(COMPONENTS, 'path component')}"


def f02_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths made of part names: which of them say nothing about a package."""
    p = read(spark, sf_dir, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("/")).alias("n"), "p_size")
    path = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("/usr/share/doc/"), "n")).when(F.col("p_size") % 4 == 1, F.concat(F.lit("/usr/lib/"), "n", F.lit(".conf"))).when(F.col("p_size") % 4 == 2, F.concat(F.lit("/usr/bin/"), "n")).otherwise(F.concat(F.lit("/etc/x.d/"), "n"))
    return p.select("p_partkey", files.is_noise(path).alias("noise"))


F02 = "SELECT p_partkey, p_size % 4 <> 2 AS noise FROM part"


def f04_component_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that two distributions keep in different places meet by their component."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_size", F.replace("p_name", F.lit(" "), F.lit("/")).alias("n"))
    a, b = p.where("p_size <= 25").select(F.col("p_partkey").alias("a"), "n"), p.where("p_size > 25").select(F.col("p_partkey").alias("b"), "n")
    component = lambda folder: lambda blocks: files.component_id(blocks.withColumn("path", F.concat(F.lit(folder), "n", F.lit(".h"))))
    return resolve.met_in_blocks(a, b, ["component"], "a", "b", raw=["n"], made=(component("/usr/lib/x86_64-linux-gnu/"), component("/usr/lib64/")))


F04 = "SELECT x.p_partkey AS a, y.p_partkey AS b FROM part x JOIN part y ON x.p_name = y.p_name WHERE x.p_size <= 25 AND y.p_size > 25"


_ROLES = [("{n}-dev", "{n}-devel", "1"), ("{n}", "{n}-dev", "0.5"), ("{n}-doc", "{n}-examples", "0"), ("{n}-doc", "{n}", "0"), ("python3-{n}", "{n}", "0.5")]


def f13_role_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = of_parts(spark, sf_dir, [r[:2] for r in _ROLES], "a b")
    return t.select("p_partkey", "a", "b", S.role_similarity(N.roles(F.col("a")), N.roles(F.col("b"))).alias("score"))


F13 = f"SELECT p_partkey, a, b, CAST(score AS DOUBLE) AS score FROM {parts_sql(_ROLES, 'a b score')}"


def f15_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-data")).alias("name"))
    return mapping.name_variants(p, "p_partkey")


F15 = """WITH p AS (SELECT p_partkey, replace(p_name, ' ', '-') AS b, replace(p_name, ' ', '') AS c FROM part), kinds(s) AS (VALUES ('-assets'), ('-data'), ('-fonts'), ('-icons'), ('-media'), ('-resources'), ('-themes'), ('')),
more(h, t) AS (VALUES ('', ''), ('', '-dev'), ('', '-devel'), ('', '-development'), ('', '-full'), ('', '-runtime'), ('', '-lib'), ('', '-libs'), ('', '-compat'), ('compat-', ''), ('compat-', '-full'), ('cmake(', ')'), ('pkgconfig(', ')')),
py(h) AS (VALUES ('py-'), ('python-'), ('py3-'), ('python3-'), ('python3Packages.')), full_or_not(t) AS (VALUES (''), ('-full'))
SELECT p_partkey, b || s AS variant FROM p, kinds UNION SELECT p_partkey, replace(b || '-data', '-', '_') FROM p UNION SELECT p_partkey, 'cmake(' || b || ')' FROM p UNION SELECT p_partkey, 'pkgconfig(' || b || ')' FROM p
UNION SELECT p_partkey, h || c || t FROM p, more UNION SELECT p_partkey, h || c || t FROM p, py, full_or_not"""


_PLATFORM_NAMES = [("python312-{n}", "opensuse", "python3-{n}"), ("python3Packages.{n}", "nixos", "{n}"), ("dev-python/{n}", "gentoo", "{n}"), ("{n}@layer", "openembedded", "{n}")]


def f23_platform_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = of_parts(spark, sf_dir, [r[:2] for r in _PLATFORM_NAMES], "name platform")
    return t.select("p_partkey", "name", N.platform_name(F.col("name"), F.col("platform")).alias("plain"))


F23 = f"SELECT p_partkey, name, plain FROM {parts_sql(_PLATFORM_NAMES, 'name platform plain')}"


def f27_fenced_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The object in an answer: that of the fenced block, else what the outermost braces hold."""
    e = read(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```\ndone {x}"))).otherwise(F.concat(F.lit("it is "), "props", F.lit(" .")))
    found = F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit("")), F.regexp_extract(text, r"(?s)(\{.*\})", 1))
    return e.select("event_id", F.from_json(found, "k long")["k"].alias("k"))


F27 = "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"


def j03_either_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_partkey", "p_size", F.replace("p_name", F.lit(" "), F.lit("-")).alias("n"))
    probes = p.select(F.col("p_partkey").alias("probe_id"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("python312Packages."), "n")).otherwise(F.col("n")).alias("name"))
    entries = p.select(F.col("p_partkey").alias("row_ord"), F.when(F.col("p_size") > 25, F.concat(F.lit("python3Packages."), "n")).otherwise(F.col("n")).alias("name"))
    return mapping.either_key(probes, entries, ".")


J03 = "SELECT a.p_partkey AS probe_id, min(b.p_partkey) AS found FROM part a JOIN part b ON a.p_name = b.p_name AND (a.p_size % 2 = 0) = (b.p_size > 25) GROUP BY 1"


def j04_layer_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_partkey", "p_brand", F.concat(F.lit("python3-"), F.replace("p_name", F.lit(" "), F.lit("-"))).alias("n"))
    return mapping.either_key(p.select(F.col("p_partkey").alias("probe_id"), F.col("n").alias("name")), p.select(F.col("p_partkey").alias("row_ord"), F.concat("n", F.lit("@"), "p_brand").alias("name")), "@")


J04 = "SELECT a.p_partkey AS probe_id, min(b.p_partkey) AS found FROM part a JOIN part b ON a.p_name = b.p_name GROUP BY 1"


def j11_dashboards(spark: SparkSession, sf_dir: str) -> DataFrame:
    boards = [(r"https?://([^/]+)/de/([0-9]+)", "https://board.example/german/$1/$2"), (r"https://([^/]+)/", "https://board.example/$1")]
    return read(spark, sf_dir, "pages").select("page_id", mapping.linked(F.col("url"), boards).alias("link"))


J11 = r"SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^/]+/de/[0-9]') THEN regexp_replace(url, '^https?://([^/]+)/de/([0-9]+).*$', 'https://board.example/german/\1/\2') WHEN url LIKE 'https://%/%' THEN regexp_replace(url, '^https://([^/]+)/.*$', 'https://board.example/\1') ELSE url END AS link FROM pages"


_PIP = [("python3-{n}{k}", "{n}{k}-pip,python-{n}{k}-pip", "{n}{k}-pip"), ("python-{n}{k}", "python3-{n}{k}-pip", "python3-{n}{k}-pip"), ("py{n}{k}", "python3-py{n}{k}-pip", "python3-py{n}{k}-pip"), ("{n}{k}", "{n}{k}-pip", None), ("python3-{n}{k}-pip", "", None)]


def j20_pip_counterparts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first counterpart that the rules have."""
    t = of_parts(spark, sf_dir, [r[:2] for r in _PIP], "rosdep_key have")
    have = t.select(F.explode(F.split("have", ",")).alias("counterpart")).where("counterpart <> ''").distinct()
    return mapping.pip_counterparts(t.select("rosdep_key")).join(have, "counterpart").groupBy("rosdep_key").agg(F.min_by("counterpart", "ord").alias("counterpart"))


J20 = f"SELECT rosdep_key, counterpart FROM {parts_sql(_PIP, 'rosdep_key have counterpart')} WHERE counterpart IS NOT NULL"


def j23_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("n"), "p_size")
    have = p.select(F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("cmake("), "n", F.lit(")"))).when(F.col("p_size") % 3 == 1, F.concat("n", F.lit("-devel"))).otherwise(F.concat(F.lit("lib"), "n", F.lit("-dev"))).alias("name"))
    return mapping.suggestions(p.select(F.concat(F.lit("lib"), "n", F.lit("-dev")).alias("key")).distinct(), have)


J23 = """WITH p AS (SELECT replace(p_name, ' ', '_') AS n, bool_or(p_size % 3 = 2) AS as_is, bool_or(p_size % 3 = 1) AS devel, bool_or(p_size % 3 = 0) AS cm FROM part GROUP BY 1)
SELECT 'lib' || n || '-dev' AS key, CASE WHEN as_is THEN 'lib' || n || '-dev' WHEN devel THEN n || '-devel' ELSE 'cmake(' || n || ')' END AS suggestion FROM p"""


_DOCS = [
    ("list{k}", '{"ubuntu": ["{n}", "libb"], "fedora": null}'), ("versions{k}", '{"ubuntu": {"noble": ["{n}"], "jammy": null, "focal": {"pip": {"packages": ["p"]}, "other": ["z"]}}}'),
    ("managers{k}", '{"slackware": {"slackpkg": {"packages": ["apr"], "depends": []}, "note": "x"}}'), ("any{k}", '{"*": {"pip": ["q"], "apt": ["r"]}}'), ("odd{k}", '{"ubuntu": "bare", "debian": {"bookworm": {"apt": {"names": ["{n}"]}}}}'), ("none{k}", "{}"),
]


def p01_normalised_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.normalised(of_parts(spark, sf_dir, _DOCS, "rosdep_key doc").select("rosdep_key", "doc"))


P01 = """SELECT k || p_partkey AS rosdep_key, platform, os_version, package_manager, CASE package WHEN '{n}' THEN replace(p_name, ' ', '') ELSE package END AS package, is_null FROM part JOIN (VALUES (0, 'list', 'ubuntu', '*', 'apt', '{n}', false), (0, 'list', 'ubuntu', '*', 'apt', 'libb', false), (0, 'list', 'fedora', '*', 'dnf', NULL, true), (1, 'versions', 'ubuntu', 'noble', 'apt', '{n}', false), (1, 'versions', 'ubuntu', 'jammy', 'apt', NULL, true),
(1, 'versions', 'ubuntu', 'focal', 'pip', 'p', false), (2, 'managers', 'slackware', '*', 'slackpkg', 'apr', false), (3, 'any', '*', '*', 'pip', 'q', false), (4, 'odd', 'debian', 'bookworm', 'apt', '{n}', false)) t(i, k, platform, os_version, package_manager, package, is_null) ON i = p_partkey % 6"""


def p16_name_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    table = {("Brand#1", "7"): {"widget": "gadget", "gadget": "thing"}, ("Brand#2", "8"): {"rod": "bar"}}
    return p.select("p_partkey", mapping.replaced(F.col("p_name"), F.col("p_brand"), (F.col("p_size") % 10).cast("string"), table).alias("name"))


P16 = "SELECT p_partkey, CASE WHEN p_brand = 'Brand#1' AND p_size % 10 = 7 THEN replace(replace(p_name, 'widget', 'gadget'), 'gadget', 'thing') WHEN p_brand = 'Brand#2' AND p_size % 10 = 8 THEN replace(p_name, 'rod', 'bar') ELSE p_name END AS name FROM part"


_REPOS = [("ubuntu_24_{k}", "ubuntu", "24.{k}"), ("nix_stable_24_{k}", "nixos", "24.{k}"), ("nix_unstable", "nixos", "unstable"), ("arch", "arch", ""), ("fedora_{k}", "fedora", "{k}")]


def p17_repo_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = of_parts(spark, sf_dir, [r[:1] for r in _REPOS], "repo")
    return t.select("p_partkey", "repo", mapping.repo_parts(F.col("repo")).alias("x")).select("p_partkey", "repo", "x.name", "x.version")


P17 = f"SELECT * FROM {parts_sql(_REPOS, 'repo name version')}"


_RELEASES = [
    ("ubuntu", "24_04", "noble", "true"), ("ubuntu", "24_04", "jammy", "false"), ("debian", "12", "bookworm", "true"), ("fedora", "{k}", "{k}", "true"), ("fedora", "{k}", "{k}0", "false"), ("arch", "{k}", "b", "true"),
    ("opensuse", "leap_15_{k}", "15.{k}", "true"), ("alpine", "unknown", "edge", "true"),
]


def p19_same_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = of_parts(spark, sf_dir, [r[:3] for r in _RELEASES], "os_name a b")
    return t.select("p_partkey", "os_name", "a", "b", mapping.same_release(F.col("os_name"), F.col("a"), F.col("b")).alias("same"))


P19 = f"SELECT p_partkey, os_name, a, b, CAST(same AS BOOLEAN) AS same FROM {parts_sql(_RELEASES, 'os_name a b same')}"


_STORED = [
    ('{"ubuntu": {"*": {"apt": {"packages": ["{n}"]}}}}', "true"), ('{"ubuntu": ["{n}"]}', "false"), ('{"ubuntu": {"*": {"apt": ["{n}"]}}}', "false"), ('{"ubuntu": {"*": {"apt": {"names": []}}}}', "false"), ('{"ubuntu": {"*": "{n}"}}', "false"),
    ('{"ubuntu": {"{k}": {"apt": {"packages": [], "depends": []}}, "*": {}}}', "true"), ("{n}", "false"),
]


def p13_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_parts(spark, sf_dir, [r[:1] for r in _STORED], "doc").select("p_partkey", mapping.is_valid(F.col("doc")).alias("valid"))


P13 = f"SELECT p_partkey, CAST(valid AS BOOLEAN) AS valid FROM {parts_sql([r[1:] for r in _STORED], 'valid')}"


_TABLES = [("k{k}", "ubuntu,noble,{n}b;ubuntu,noble,{n}a;ubuntu,jammy,{n}a;pypi,,p", '{"*":{"*":{"pip":{"packages":["p"]}}},"ubuntu":{"jammy":{"apt":{"packages":["{n}a"]}},"noble":{"apt":{"packages":["{n}a","{n}b"]}}}}'), ("f{k}", "fedora,41,{n}", '{"fedora":{"41":{"dnf":{"packages":["{n}"]}}}}')]


def c04_rule_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = of_parts(spark, sf_dir, [r[:2] for r in _TABLES], "rosdep_key packages").select("rosdep_key", F.explode(F.split("packages", ";")).alias("x")).withColumn("x", F.split("x", ","))
    return mapping.rule_documents(t.select("rosdep_key", F.col("x")[0].alias("repo_name"), F.nullif(F.col("x")[1], F.lit("")).alias("repo_version"), F.col("x")[2].alias("name")))


C04 = f"SELECT rosdep_key, doc FROM {parts_sql([(r[0], r[2]) for r in _TABLES], 'rosdep_key doc')}"


def c05_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as packages of ubuntu releases, written as rule documents and read back as rules."""
    p = read(spark, sf_dir, "part").select(F.col("p_brand").alias("rosdep_key"), F.lit("ubuntu").alias("repo_name"), F.col("p_type").alias("repo_version"), F.col("p_name").alias("name"))
    return mapping.normalised(mapping.rule_documents(p)).select("rosdep_key", "os_version", "package_manager", "package")


C05 = "SELECT DISTINCT p_brand AS rosdep_key, p_type AS os_version, 'apt' AS package_manager, p_name AS package FROM part"


def m10_json_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.array_sort(F.collect_set("l_returnflag"))).alias("json"))
    return sets.select("l_orderkey", "json", F.size(F.from_json("json", "array<string>")).cast("long").alias("n"))


M10 = """SELECT l_orderkey, '["' || string_agg(DISTINCT l_returnflag, '","' ORDER BY l_returnflag) || '"]' AS json, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY l_orderkey"""


def k03_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key for what a search was asked: the same names in any order give the same key."""
    p = read(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("types"))
    return p.select("p_brand", F.md5(F.to_json(F.struct("p_brand", "types"))).alias("cache_key"))


K03 = """SELECT p_brand, md5('{"p_brand":"' || p_brand || '","types":["' || string_agg(DISTINCT p_type, '","' ORDER BY p_type) || '"]}') AS cache_key FROM part GROUP BY p_brand"""

#: Query: (function, SQL).
ALL = {
    "f01_component_id": (f01_component_id, F01), "f02_noise": (f02_noise, F02), "f04_component_join": (f04_component_join, F04), "f13_role_score": (f13_role_score, F13), "f15_variants": (f15_variants, F15),
    "f23_platform_name": (f23_platform_name, F23), "f27_fenced_json": (f27_fenced_json, F27), "j03_either_key": (j03_either_key, J03), "j04_layer_key": (j04_layer_key, J04), "j11_dashboards": (j11_dashboards, J11),
    "j20_pip_counterparts": (j20_pip_counterparts, J20), "j23_suggestions": (j23_suggestions, J23), "p01_normalised_rules": (p01_normalised_rules, P01), "p13_validity": (p13_validity, P13), "p16_name_replacements": (p16_name_replacements, P16),
    "p17_repo_parts": (p17_repo_parts, P17), "p19_same_release": (p19_same_release, P19), "c04_rule_documents": (c04_rule_documents, C04), "c05_round_trip": (c05_round_trip, C05), "m10_json_sets": (m10_json_sets, M10), "k03_cache_key": (k03_cache_key, K03),
}
