"""Sinks that go on after a kill, archives, fixed points, comparisons and entries on small inputs."""

import io
import tarfile

import pytest
from pyspark.sql import functions as F

from pkgloom.operators import compare, equivalence, mapping
from pkgloom.sources import archives, formats, sinks


def test_resumable_table(spark, tmp_path, monkeypatch):
    schema = "k string, v int"
    rows = lambda *x: spark.createDataFrame(list(x), schema)
    table = sinks.ResumableTable(spark, f"file://{tmp_path}/t", ["k"])
    assert table.read(schema).count() == 0
    table.append(rows(("a", 1), ("a", 2), (None, 3)))
    # killed between the batch and its commit: nothing of it is read, and a run that begins again writes it once
    with monkeypatch.context() as m:
        m.setattr(table, "_commit", lambda batch: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            table.append(rows(("b", 4)))
    again = sinks.ResumableTable(spark, f"file://{tmp_path}/t", ["k"])
    assert sorted(map(tuple, again.read(schema).collect()), key=str) == [("a", 1), ("a", 2), (None, 3)]
    for _ in range(2):
        again.append(rows(("a", 9), ("b", 4), (None, 5), ("c", 6)))
    assert sorted(map(tuple, again.read(schema).collect()), key=str) == [("a", 1), ("a", 2), ("b", 4), ("c", 6), (None, 3)]
    assert len(again._names("batches")) == len(again._names("manifest")) == 3
    again.append(rows().limit(0) if False else spark.createDataFrame([], schema))
    assert again.read(schema).count() == 5


def test_defect_rows_and_csv(spark, tmp_path):
    keys = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), ("d",)], "rosdep_key string")
    defects = spark.createDataFrame([("a", "B.2a", 'x, "y"\nz'), ("a", "A.2", None)], "rosdep_key string, type string, note string")
    rows = sinks.defect_rows(keys, defects, spark.createDataFrame([("c",)], "rosdep_key string"))
    want = sorted([("a", "B.2", 'x, "y"\nz', "ok"), ("a", "A.2", None, "ok"), ("b", "", None, "no_issues"), ("d", "", None, "no_issues")], key=str)
    assert sorted((tuple(r) for r in rows.collect()), key=str) == want
    sinks.write_csv(rows.orderBy("rosdep_key"), f"file://{tmp_path}/csv")
    back = formats.csv_rows(spark, f"file://{tmp_path}/csv", "rosdep_key string, type string, note string, status string")
    assert sorted((r["rosdep_key"], r["type"] or "", r["note"], r["status"]) for r in back.collect() if r["rosdep_key"] == "a") == sorted((w for w in want if w[0] == "a"), key=lambda w: w[1])


def test_archives_are_opened_only_where_asked_for(spark, tmp_path):
    index = archives.write(spark.createDataFrame([("a", ["usr/bin/a", "usr/", "usr/bin/a"]), ("none", None), ("bad", ["x"]), ("lost", ["x"]), ("other", ["x"])], "name string, files array<string>"), f"file://{tmp_path}/apk")
    rows = index.collect()
    (tmp_path / "apk" / "bad.apk").write_bytes(b"no archive")
    (tmp_path / "apk" / "lost.apk").unlink()
    (tmp_path / "apk" / "other.apk").unlink()
    index = spark.createDataFrame(rows, "name string, uri string").union(spark.createDataFrame([("null", None)], "name string, uri string"))
    asked = spark.createDataFrame([("a",), ("a",), ("none",), ("bad",), ("lost",), ("unknown",), ("null",), (None,)], "name string")
    got = {r["name"]: (r["files"], r["error"]) for r in archives.hit_lists(index, asked).collect()}
    # the archive that nobody asks for isn't there, and nothing minds
    assert sorted(got) == ["a", "bad", "lost", "none", "null"]
    assert got["a"] == (["/usr/bin/a"], None) and got["none"] == ([], None) and got["null"] == ([], None)
    assert got["bad"] == ([], "ReadError") and got["lost"] == ([], "FileNotFoundError")
    assert archives.hit_lists(index.limit(0), asked).count() == 0 and archives.hit_lists(index, asked.limit(0)).count() == 0
    out = io.BytesIO()
    with tarfile.open(mode="w:gz", fileobj=out) as tar:
        tar.addfile(tarfile.TarInfo("./a/b"))
    assert archives.members(out.getvalue()) == ["/a/b"]


def plain_suggestion(key, have, seen=()):
    """The first name that is there, depth first."""
    import re

    if key in seen:
        return None
    if key in have:
        return key
    steps = []
    if key.endswith("-dev"):
        steps.append(key[:-4] + "-devel")
    if key.startswith("lib"):
        steps.append(key[3:])
    if key.endswith("-devel"):
        steps += [f"cmake({key[:-6]})", f"pkgconfig({key[:-6]})"]
    if m := re.match(r"^python(\d)-(.+)$", key):
        steps.append(f"python{m[1]}dist({m[2]})")
        if "-" in m[2]:
            steps.append(f"python{m[1]}dist({m[2].replace('-', '_')})")
    for s in steps:
        if found := plain_suggestion(s, have, (*seen, key)):
            return found
    return None


def test_suggestions_to_the_end(spark):
    keys = ["libliblibliblibliblibx-dev", "libx-dev", "x-dev", "lib", "liblib", "python3-a-b", "python3-", "libpython3-a-b-dev", "-dev", "", "lib-dev", "z"]
    for have in (["cmake(x)"], ["x-devel", "libx-devel"], ["python3dist(a_b)"], ["pkgconfig()", "cmake(lib)"], ["python3dist(a_b-dev)", "python3dist(a-b-devel)"], ["libx-dev", "x-dev"], []):
        rows = spark.createDataFrame([(k,) for k in [*keys, None, keys[0]]], "key string")
        got = {r["key"]: r["suggestion"] for r in mapping.suggestions(rows, spark.createDataFrame([(h,) for h in [*have, None]], "name string")).collect()}
        assert got == {k: s for k in keys if (s := plain_suggestion(k, have)) is not None}, have


def test_variants_of_variants(spark):
    """Names that lose a version by losing another one are followed to the last."""
    names = spark.createDataFrame([(1, "libfoo2-1.0-dev"), (2, None), (3, ""), (4, "bar")], "id int, name string")
    got = {}
    for r in mapping.name_variants(names, "id").collect():
        got.setdefault(r["id"], set()).add(r["variant"])
    again = spark.createDataFrame([(9, s) for s in got[1]], "id int, name string")
    seeds = {r["s"] for r in mapping._seeds(names.where("id = 1").select("name")).collect()}
    more = {r["s"] for r in mapping._seeds(spark.createDataFrame([(s,) for s in seeds], "name string")).collect()}
    assert more == seeds and "foo-dev" in got[1] and 2 not in got and {"bar", "bar-dev"} <= got[4] and again.count() > 10


def test_comparison(spark):
    truth = spark.createDataFrame([(1, "u", "a"), (1, "u", "b"), (1, "f", "a"), (2, "u", "x"), (2, "u", "x"), (None, "u", "n")], "entry int, platform string, name string")
    found = spark.createDataFrame([("t", 1, "u", "b"), ("t", 1, "u", "a"), ("t", 1, "f", "z"), ("t", 2, "u", "y"), ("t", 2, "u", "x"), ("t", 3, "u", "q"), ("s", 1, "u", "a")], "tool string, entry int, platform string, name string")
    tools = spark.createDataFrame([("t",), ("s",), ("none",)], "tool string")
    matches = compare.platform_matches(truth, found, tools)
    got = {(r["tool"], r["entry"], r["platform"]): (r["result"], r["n_found"]) for r in matches.collect()}
    assert got["t", 1, "u"] == ("exact_match", 2) and got["t", 1, "f"] == ("no_match", 0) and got["t", 2, "u"] == ("partial_match", 1) and got["s", 1, "u"] == ("partial_match", 1) and got["none", 1, "u"] == ("no_match", 0) and len(got) == 12
    sums = {r["tool"]: r for r in compare.overall(matches).collect()}
    assert (sums["t"]["exact"], sums["t"]["partial"], sums["t"]["none"], sums["t"]["exact_rate"], sums["t"]["rank"]) == (1, 1, 2, 25.0, 1) and sums["none"]["rank"] == 2
    # ties in rate go by the name
    assert sums["s"]["rank"] == 3
    scores = {(r["tool"], r["entry"]): (r["precision"], r["recall"]) for r in compare.repository_scores(truth, found).collect()}
    assert scores == {("t", 1): (1.0, 1.0), ("t", 2): (1.0, 1.0), ("s", 1): (1.0, 0.5)}
    rates = {r["tool"]: r for r in compare.extras(found, found.where("entry = 1"), matches).collect()}
    assert (rates["t"]["entries"], rates["t"]["extra"], rates["t"]["unverified"], rates["t"]["rate"]) == (4, 2, 2, 100.0) and rates["s"]["rate"] is None
    assert compare.overall(compare.platform_matches(truth.limit(0), found, tools)).count() == 0


def test_claims(spark):
    rows = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    claims = {"sum": (F.sum("x"), 4), "null": (F.count_if(F.col("x").isNull()), 2), "nothing": (F.max(F.when(F.col("x") > 9, 1)), 0)}
    got = {r["claim"]: (r["measured"], r["holds"]) for r in compare.check_claims(rows, claims).collect()}
    assert got == {"sum": (4.0, True), "null": (1.0, False), "nothing": (None, False)}
    assert {r["holds"] for r in compare.check_claims(rows.limit(0), claims).collect()} == {False}


def test_entries(spark):
    rows = [
        ("a", "ubuntu_noble", 0, "n"), ("a", "ubuntu_jammy", 1, "n"), ("a", "debian", 2, "d1"), ("a", "debian", 3, "d2"), ("a", "debian_12", 4, "d1"), ("b", "fedora_41", 0, "f"), ("b", "fedora_42", 1, "g"), ("b", "fedora_41", 2, "last"),
        ("c", "PyPI", 0, "p"), ("c", "arch", 1, ""), ("d", "arch", 0, None), ("e", "odd_1", 0, "o"), ("f", "debian", 0, "x"), ("f", "debian_12", 1, "x"), ("f", "debian_13", 2, "x"), (None, "arch", 0, 'q"'),
    ]
    got = {r["group_id"]: (r["rosdep_key"], r["doc"], r["issues"]) for r in mapping.entry_documents(spark.createDataFrame(rows, "group_id string, repo_key string, ord int, package string"), ["arch", "ubuntu"]).collect()}
    assert got["a"] == ("n", '{"debian":{"12":["d1"]},"ubuntu":["n"]}', []) and got["b"] == ("f", '{"fedora":{"41":["last"],"42":["g"]}}', [])
    assert got["c"] == ("p", '{"arch":{"pip":{"packages":["p"]}},"ubuntu":{"pip":{"packages":["p"]}}}', []) and got["e"] == ("o", "{}", ["Unknown distribution: odd", "Entry is empty"])
    assert got["f"] == ("x", '{"debian":["x"]}', []) and "d" not in got and got[None] == ('q"', '{"arch":["q\\""]}', [])


def test_sweep_is_detect_for_each_weight(spark):
    schema = "os_name string, os_version string, os_arch string, source_ord int, row_ord int, name string, source_name string, binary_name string, description string, filelist array<string>"
    entry = lambda os, n, name, about, files: (os, "1", "x", 0, n, name, name, name, about, files)
    entries = spark.createDataFrame([entry("f", 0, "foo-devel", "text of foo", ["a"]), entry("f", 1, "bar", "a text of foo here", ["a", "b"]), entry("g", 2, "libfoo", None, None), entry("g", 3, "baz", "none", ["b"])], schema)
    base = spark.createDataFrame([(1, "libfoo", "libfoo-dev", "text of foo", ["a", "b"]), (2, "libfoo", "libfoo-dev", "text of foo", ["a", "b"]), (3, None, None, None, None)], "baseline_id long, src_name string, bin_name string, description string, filelist array<string>")
    swept = sorted((r["w"], r["baseline_id"], r["repo_name"], r["bin_name"], r["score"]) for r in equivalence.sweep(base, entries, [0.0, 0.5, 1.0]).collect())
    each = sorted((w, r["baseline_id"], r["repo_name"], r["bin_name"], r["score"]) for w in (0.0, 0.5, 1.0) for r in equivalence.detect(base, entries, w=w).collect())
    assert swept == each and swept
