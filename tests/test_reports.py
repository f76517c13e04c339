"""Messages, reports, histories and studies on small inputs: nulls, ties, empty tables."""

from pyspark.sql import functions as F

from pkgloom.operators import reports
from pkgloom.sources import formats

DEFECTS = "rosdep_key string, os_name string, os_version string, type string, reason string, package_name string, expected string"


def test_defect_reports(spark):
    rows = [
        ("k{os}", "u", "1", "A.2", "missing", None, "e"), ("k", "u", "1", "B.1a", "not_found", "p", None), ("k", "u", "1", "B.1a", "not_found", "p", "x"), ("k", None, None, "B.1a", "no_info", None, None), ("k", "u", "1", "B.1b", "differs", "p", "e"),
        ("k", "u", "1", "B.1b", "empty_list", None, "e"), ("k", "u", "1", "B.1b", "odd", None, None), ("k", None, None, "Z", None, None, None), ("k", None, None, "A.1", "absent", None, None),
    ]
    defects = spark.createDataFrame(rows, DEFECTS)
    got = [r[0] for r in defects.select(reports.defect_message(defects)).collect()]
    assert got == ["Entry 'k{os}' missing version '1' for platform 'u'; suggested package: 'e'", "Package 'p' not found in u 1", "Package 'p' not found in u 1; detected existing package: 'x'", "No distribution info found for entry 'k'",
                   "Package 'p' differs from expected 'e' in u 1", "Empty package list for u 1; expected package: 'e'", "Defect B.1b for entry 'k'", "Defect Z for entry 'k'", "Entry 'k' not found in database"]
    keys = spark.createDataFrame([("k",), ("none",), ("none",)], "rosdep_key string")
    text = {r["rosdep_key"]: r["value"] for r in reports.defect_reports(keys, defects).collect()}
    assert text["none"] == "\n### Entry: `none`\n\n- No issues detected\n"
    assert text["k"].startswith("\n### Entry: `k`\n\n- **Type A.1**: Entry not found in database\n  - Entry 'k' not found in database\n\n- **Type B.1a**: ") and text["k"].endswith("- **Type Z**: Z\n  - Defect Z for entry 'k'\n")
    assert reports.defect_reports(keys.limit(0), defects).count() == 0 and reports.defect_reports(keys, defects.limit(0)).count() == 2


def test_broken_summary(spark):
    rows = [("u", "1", "x", "k", "p"), ("u", "1", "x", "k", "p"), ("u", "1", "x", "a", "p"), ("g", None, "x", "k", "p"), ("g", "", "x", "k", "q")]
    got = {r["platform"]: r["value"] for r in reports.broken_summary(spark.createDataFrame(rows, "os_name string, os_version string, os_arch string, rosdep_key string, package string")).collect()}
    assert got["u 1 on x"] == "* The following 2 packages were not found for u 1 on x:\n- Package p for rosdep key a\n- Package p for rosdep key k" and got["g on x"].count("\n") == 2


def test_latex(spark):
    rows = spark.createDataFrame([("a_b", 5, "50%"), ("c&d", 7, None), ("e", 7, "{x}")], "n string, v int, s string")
    got = [r["value"] for r in reports.latex_lines(rows, {"Name": F.col("n"), "V": F.col("v"), "S": F.col("s")}, "n", "V").orderBy("part", "sort_key").collect()]
    assert got == ["\\begin{tabular}{lll}", "Name & V & S \\\\", "\\hline", "a\\_b & 5 & 50\\% \\\\", "c\\&d & \\textbf{7} &  \\\\", "e & \\textbf{7} & \\{x\\} \\\\", "\\end{tabular}"]


def test_name_growth(spark):
    rows = [
        (1, "new", "after", "libfoo-dev"), (1, "new", "after", "foo-devel"), (1, "same", "before", "a"), (1, "same", "after", "a"), (1, "gone", "before", "a"), (2, "k", "before", "a"), (2, "k", "after", "a"), (2, "k", "after", "b"), (2, "k", "after", None),
        (3, "k", "before", "a"), (3, "k", "before", "b"), (3, "k", "after", "a"), (None, "k", "after", "a"),
    ]
    growth = reports.name_growth(spark.createDataFrame(rows, "change_id int, key string, side string, name string"))
    got = {(r["change_id"], r["key"]): (r["raw_grows"], r["plain_grows"]) for r in growth.collect()}
    assert got == {(1, "new"): (True, False), (1, "same"): (False, False), (2, "k"): (True, True), (3, "k"): (False, False), (None, "k"): (False, False)}
    flagged = spark.createDataFrame([(1,), (1,), (9,)], "change_id int")
    assert {r["flagged"]: (r["n"], r["raw"], r["plain"]) for r in reports.growing_changes(growth, flagged).collect()} == {True: (1, 1, 0), False: (3, 1, 1)}
    kinds = spark.createDataFrame([("lint A.1",), ("A.1",), ("key",), ("ERROR",), (None,), ("No modifications found",)], "t string").select(reports.chained_class(F.col("t")).alias("k")).collect()
    assert [r["k"] for r in kinds] == ["linter", "rule", None, None, None, None]


def test_overlap_and_sources(spark):
    keys = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "x"), ("c", None)], "key string, category string")
    got = {r["category"]: (r["n"], r["both"], r["share"]) for r in reports.overlap(keys, spark.createDataFrame([("a",), ("a",), ("z",)], "key string"), "category").collect()}
    assert got == {"x": (2, 1, 50.0), "y": (1, 1, 100.0), None: (1, 0, 0.0), "all": (3, 1, round(100 / 3, 6))}
    assert reports.overlap(keys.limit(0), keys, "category").count() == 0
    results = spark.createDataFrame([("s", "k", "p"), ("s", "k", "p"), ("t", "k", "p"), ("t", "k", "q"), ("u", None, "p"), ("u", "k", None)], "source string, key string, package string")
    assert {r["source"]: (r["entries"], r["packages"], r["only"]) for r in reports.compare_sources(results).collect()} == {"s": (1, 1, 0), "t": (1, 2, 1)}


def test_truth_and_studies(spark):
    modified = spark.createDataFrame([(1, 5, "a"), (2, 6, "a"), (3, 6, "a"), (1, 5, "b"), (4, 1, "python-x"), (4, None, "c")], "change_id int, at int, key string")
    left = spark.createDataFrame([(3, "a", "ubuntu_noble", "p"), (3, "a", "debian", "p"), (3, "a", "debian", "p"), (2, "a", "arch", "old"), (1, "b", "ubuntu_noble", "q"), (4, "python-x", "ubuntu_noble", "x"), (4, "python-x", "arch", "x")], "change_id int, key string, repo_key string, package string")
    assert sorted(map(tuple, reports.ground_truth(modified, left).collect())) == [("a", "debian", "p"), ("a", "ubuntu_noble", "p")]
    assert {r["key"] for r in reports.ground_truth(modified, left, least=1).collect()} == {"a", "b"}
    packages = spark.createDataFrame([("a", "u_1", "p"), ("a", "u_1", "p"), ("a", "d_1", "q"), ("b", "u_1", "p"), ("b", "u_2", "p"), ("c", "u_1", "p"), ("c", "d_1", "p"), ("c", "d_1", "r")], "key string, repo_key string, package string")
    assert {r["key"] for r in reports.cross_platform(packages).collect()} == {"a"}
    changes = spark.createDataFrame([(1, 10, 0), (1, 9, 1), (2, 5, 0), (3, 5, 0), (4, 1, 0)], "change_id int, at int, load_ord int")
    touched = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "a"), (2, "zz"), (3, "a")], "change_id int, key string")
    index = spark.createDataFrame([("a",), ("b",), ("b",)], "key string")
    got = reports.study_changes(changes, touched, index, spark.createDataFrame([(3,)], "change_id int")).collect()
    assert [tuple(r) for r in got] == [(1, 9, ["a", "b"])]


def test_portage_listing(spark):
    html = '<a href="ok/">x</a><a href="ok/">again</a><a href="../">up</a><a href="/abs/">x</a><a href="file">x</a><a href="Up/">x</a><a href="a.b+c_d-1/">x</a><a href="-x/">x</a>'
    got = formats.portage_packages(spark.createDataFrame([("dev", html), ("none", None), ("empty", "")], "category string, html string")).collect()
    assert sorted((r["name"], r["source_name"]) for r in got) == [("a.b+c_d-1", "dev/a.b+c_d-1"), ("ok", "dev/ok")]


def test_names_and_systems(spark):
    from pkgloom.functions import names as N
    from pkgloom.sources import config

    rows = spark.createDataFrame([("a_b",), ("a",), ("a_b_c",), ("_",), (None,), ("x-debuginfo",)], "s string")
    got = [(r[0]["platform"], r[0]["version"], r[1]) for r in rows.select(N.split_key(F.col("s")), N.is_debug(F.col("s"))).collect()]
    assert got == [("a", "b", False), ("a", "", False), ("a_b_c", "", False), ("", "", False), (None, "", None), ("x-debuginfo", "", True)]
    targets = spark.createDataFrame([("f", "b"), ("f", "a"), ("f", "a"), ("f", "ros"), ("g", "pypi")], "file string, os_name string")
    assert [tuple(r) for r in config.systems(targets).collect()] == [("f", ["a", "b"])]
    blocks = spark.createDataFrame([("Package: ros-x-y-z\nVersion: 1",), ("Package: y",), ("Version: 3",)], "value string")
    assert [(r["name"], r["key"]) for r in formats.ros_packages(formats.block_fields(blocks)).collect()] == [("ros-x-y-z", "y-z")]
