"""Scans, accessors and sinks on small inputs: nulls, empty tables and files, ties."""

from pyspark.sql import functions as F

from pkgloom.functions import names as N
from pkgloom.operators import rules
from pkgloom.sources import formats, sinks


def test_rpm_files_from_disk(spark, tmp_path):
    primary = """<metadata xmlns="http://linux.duke.edu/metadata/common" xmlns:rpm="http://linux.duke.edu/metadata/rpm" packages="2">
<package type="rpm"><name>a</name><version epoch="0" ver="1" rel="2"/><summary>s</summary><format><rpm:sourcerpm>a-src-1-2.src.rpm</rpm:sourcerpm>
<rpm:provides><rpm:entry name="a" flags="EQ" epoch="3" ver="1" rel="2"/><rpm:entry name="b"/></rpm:provides></format></package>
<package type="rpm"><name>none</name><version epoch="0" ver="1" rel=""/></package></metadata>"""
    (tmp_path / "primary.xml").write_text(primary)
    got = {tuple(r) for r in formats.rpm_packages(spark, f"{tmp_path}/primary.xml").select("name", "version", "source_name", "binary_name", "description").collect()}
    assert got == {("a", "1-2", "a-src", "a", "s"), ("a", "3:1-2", "a-src", "a", "s"), ("a", None, "a-src", "b", "s"), ("none", "1", None, "none", None)}
    (tmp_path / "filelists.xml").write_text('<filelists><package name="a"><file>/x</file><file>/x</file><file type="dir">/d</file><file>/e/</file></package><package name="b"/></filelists>')
    assert [tuple(r) for r in formats.rpm_files(spark, f"{tmp_path}/filelists.xml").collect()] == [("a", "/x")]


def test_csv_rows(spark, tmp_path):
    (tmp_path / "t.csv").write_text('url,defects\nu1,"A.1, ""B.2""\nnext"\nu2,\n')
    assert [tuple(r) for r in formats.csv_rows(spark, f"{tmp_path}/t.csv", "url string, defects string").collect()] == [("u1", 'A.1, "B.2"\nnext'), ("u2", None)]


def test_texts_that_are_not_what_they_should_be(spark):
    texts = [None, "", "[1]", "{", '{"a": [1, null], "b": "[1]", "c": []}', "<repomd/>", "| a | | b |", "|---|"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = rows.select("i", formats.listed_entries(F.col("t")).alias("n"), formats.table_cells(F.col("t")).alias("c"), formats.repomd_href(F.col("t"), "primary").alias("h")).orderBy("i").collect()
    assert [r["n"] for r in got] == [0, 0, 0, 0, 2, 0, 0, 0]
    assert [r["c"] for r in got] == [None] * 6 + [["a", "b"], None]
    assert all(r["h"] is None for r in got)


def test_lines_and_nodes(spark):
    nodes = spark.createDataFrame([(1, 2, 0, "a"), (1, 2, 1, "a.b"), (1, 5, 0, "c"), (2, 9, 0, "z")], "doc_id long, line int, ord int, path string")
    lines = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (1, 4), (1, 99), (2, 3), (3, 1)], "doc_id long, line int")
    assert sorted(tuple(r) for r in formats.at_lines(nodes, lines).collect()) == [(1, 2, "a.b"), (1, 4, "a.b"), (1, 99, "c")]
    assert formats.at_lines(nodes.limit(0), lines).count() == 0 and formats.at_lines(nodes, lines.limit(0)).count() == 0


def test_rule_accessors(spark):
    schema = "rosdep_key string, platform string, os_version string, package_manager string, package string, is_null boolean"
    some = spark.createDataFrame([("k", "ubuntu", "*", "apt", "p", False), ("k", "ubuntu", "2", "apt", None, True), ("k", "fedora", "1", "opkg", "q", False), ("l", "*", "*", "pip", "r", False)], schema)
    assert {(r[0], r[1]): r[2] for r in rules.available_managers(some).collect()} == {("k", "ubuntu"): ["apt"], ("k", "fedora"): [], ("l", "*"): ["pip"]}
    want = spark.createDataFrame([("k", "ubuntu", "2"), ("k", "ubuntu", "9"), ("k", "fedora", "2"), ("k", "arch", "1"), ("l", "arch", "1"), ("none", "arch", "1")], "rosdep_key string, os_name string, os_version string")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in rules.matched(some, want).collect()}
    assert got == {("k", "ubuntu", "2"): ("ubuntu", "2"), ("k", "ubuntu", "9"): ("ubuntu", "*"), ("k", "fedora", "2"): (None, None), ("k", "arch", "1"): (None, None), ("l", "arch", "1"): ("*", "*"), ("none", "arch", "1"): (None, None)}
    targets = spark.createDataFrame([("ubuntu", "1", "x"), ("ubuntu", "2", "x")], "os_name string, os_version string, os_arch string")
    there = spark.createDataFrame([("ubuntu", "1", "x", "other"), ("ubuntu", "1", None, "p")], "os_name string, os_version string, os_arch string, name string")
    assert [tuple(r) for r in rules.verify(some, targets, there).select("rosdep_key", "os_version", "package").collect()] == [("k", "1", "p")]
    assert rules.verify(some.limit(0), targets, there).count() == 0 and rules.verify(some, targets, there.limit(0), found=True).where("found").count() == 0


def test_names_of_nothing(spark):
    row = spark.createDataFrame([(None, None)], "s string, a array<string>")
    got = row.select(N.short_list(F.col("a")), N.pip_name(F.col("s")), N.without_evolution(F.col("s")), N.tool_key(F.col("s")), N.key_parts(F.col("s"))["os"]).first()
    assert tuple(got) == ("None", None, None, None, None)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2), ("a", None)], "k string, n int")
    lines = sinks.table_lines(rows, {"K": F.col("k"), "N": F.col("n")}, order="k")
    sinks.write_report(lines, f"{tmp_path}/report")
    parts = sorted((tmp_path / "report").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == "| K | N |\n|---|---|\n| a |  |\n| b | 2 |\n"
    sinks.write_records(rows, f"{tmp_path}/records", "k")
    assert sorted(tuple(r) for r in spark.read.json(f"{tmp_path}/records").select("k", "n").where("n IS NOT NULL").collect()) == [("b", 2)]
    assert sinks.table_lines(rows.limit(0), {"K": F.col("k")}, order="k").count() == 2


def test_naming_inconsistencies(spark):
    from pkgloom.operators import naming

    rows = [
        ("affix", "u", "ubuntu", "libfoo-dev"), ("affix", "f", "fedora", "foo-devel"), ("evo", "u", "ubuntu", "foo1.2"), ("evo", "f", "fedora", "foo3"), ("policy", "u", "ubuntu", "foo"), ("policy", "f", "fedora", "bar"),
        ("same", "u", "ubuntu", "foo"), ("same", "f", "fedora", "'dev-libs/Foo'"), ("two", "u", "ubuntu", "a"), ("two", "u", "ubuntu", "b"), ("two", "f", "fedora", "c"), ("one", "u", "ubuntu", "a"), ("null", "u", "ubuntu", None), ("null", "f", "fedora", "a"),
    ]
    t = spark.createDataFrame(rows, "entry string, repo_key string, platform string, bin_name string")
    assert {r["entry"]: r["causes"] for r in naming.inconsistencies(t).collect()} == {"affix": ["affixation"], "evo": ["evolution"], "policy": ["policy"]}
    assert naming.inconsistencies(t.limit(0)).count() == 0
