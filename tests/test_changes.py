"""YAML files, nodes with lines, kinds of changes and their audit: nulls, ties, empty tables, bad files."""

import json
import random

import pytest

from pkgloom.operators import changes, mapping
from pkgloom.sources import config, formats, yaml_index

yaml = pytest.importorskip("yaml")
DOCS = "change_id long, rosdep_key string, doc string"


def test_files_from_disk(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("one: [x]\ntwo:\n  ubuntu: {20.10: [y], 8: null}\nzwei: &z {p: 'é'}\ndrei: *z\nvier: {<<: *z, q: 1}\none: [last]\n")
    (tmp_path / "b.yaml").write_text("one: [later]\nnone:\n")
    for name, raw in {"bad.yaml": b"a: [1\nb", "list.yaml": b"- a", "empty.yaml": b"", "latin.yaml": b"\xff\xfe\x00", "two.yaml": b"a: 1\n---\nb: 2\n", "deep.yaml": b"a: " + b"[" * 3000, "tag.yaml": b"u: !deb_base_url http://x\n"}.items():
        (tmp_path / name).write_bytes(raw)
    (tmp_path / "no.txt").write_text("x: 1")
    rows = yaml_index.read(spark, f"file://{tmp_path}").collect()
    of = lambda f: [(r["name"], r["line"], json.loads(r["doc"])) for r in rows if r["file"].endswith(f"/{f}") and r["error"] is None]
    assert of("a.yaml") == [("two", 2, {"ubuntu": {"20.10": ["y"], "8": None}}), ("zwei", 4, {"p": "é"}), ("drei", 5, {"p": "é"}), ("vier", 6, {"p": "é", "q": "1"}), ("one", 7, ["last"])]
    assert of("b.yaml") == [("one", 1, ["later"]), ("none", 2, None)] and of("tag.yaml") == [("u", 1, "http://x")]
    bad = {r["file"].rsplit("/", 1)[1]: r["error"] for r in rows if r["error"]}
    assert sorted(bad) == ["bad.yaml", "deep.yaml", "empty.yaml", "latin.yaml", "list.yaml", "two.yaml"] and bad["list.yaml"] == bad["empty.yaml"] == "not a mapping"
    # the last file that is loaded has the last word
    last = mapping.loaded(yaml_index.read(spark, [f"file://{tmp_path}/b.yaml", f"file://{tmp_path}/a.yaml"]))
    assert {r["rosdep_key"]: r["doc"] for r in last.collect()}["one"] == '["last"]'
    assert yaml_index.read(spark, f"file://{tmp_path}", "*.none").count() == 0


def test_unfolding_is_bounded():
    bomb = "a: &a [x, x, x, x, x, x, x, x, x, x]\n" + "".join(f"{b}: &{b} [{', '.join([f'*{a}'] * 10)}]\n" for a, b in zip("abcdefg", "bcdefgh", strict=True))
    with pytest.raises(ValueError, match="too many"):
        yaml_index.entries(bomb)


def plain_nodes(value, path=()):
    """Keys of a loaded document, a key before what is in it."""
    for k, v in value.items():
        yield [*path, k], "map" if isinstance(v, dict) else "list" if isinstance(v, list) else "scalar"
        if isinstance(v, dict):
            yield from plain_nodes(v, (*path, k))


def test_nodes(spark):
    rng = random.Random(1)

    def some(depth):
        kind = rng.randrange(4 if depth else 2)
        return rng.choice(["x", "y z", "'q'"]) if kind == 0 else [rng.choice("ab") for _ in range(rng.randrange(1, 4))] if kind == 1 else {f"k{i}": some(depth - 1) for i in range(rng.randrange(1, 4))}

    docs = [(i, yaml.safe_dump({f"t{j}": some(3) for j in range(rng.randrange(1, 5))}, default_flow_style=rng.choice([None, False]), sort_keys=False)) for i in range(60)]
    table = spark.createDataFrame([*docs, (100, None), (101, "a: ["), (102, ""), (103, "- x")], "doc_id long, text string")
    got = {}
    for r in yaml_index.nodes(table).orderBy("doc_id", "ord").collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sorted(got) == list(range(60))
    for i, text in docs:
        assert [(r["path"], r["kind"]) for r in got[i]] == list(plain_nodes(yaml.safe_load(text)))
        lines = text.split("\n")
        assert all(r["path"][-1] in lines[r["line"] - 1] for r in got[i])


def snippet(value, line):
    """The path that a line isolates: at each level the last mapping or list that begins at the line or above."""
    for k, (at, node) in reversed(list(value.items())):
        if at <= line and not isinstance(node, str):
            return [k, *(snippet(node, line) if isinstance(node, dict) else [])]
    return []


def test_changed_lines_of_nodes(spark):
    text = "aa:\n  u: [x]\n  v:\n    w: [y]\n    s: plain\nbb: text\ncc:\n- l\n"
    tree = {"aa": (1, {"u": (2, ["x"]), "v": (3, {"w": (4, ["y"]), "s": (5, "plain")})}), "bb": (6, "text"), "cc": (7, ["l"])}
    docs = spark.createDataFrame([("d", text), ("e", None)], "doc_id string, text string")
    lines = spark.createDataFrame([("d", i) for i in range(0, 12)] + [("e", 1), ("none", 1)], "doc_id string, line int")
    got = {r["line"]: r["path"] for r in yaml_index.changed_paths(docs, lines).collect()}
    assert got == {i: snippet(tree, i) for i in range(1, 12)}


def test_kinds(spark):
    old = [(1, "same", '{"ubuntu":["a"]}'), (1, "order", '{"ubuntu":["a","b"]}'), (1, "gone", "{}"), (1, "gone-pip", "{}"), (1, "empty", "{}"), (1, "other", '{"ubuntu":{"jammy":{"foo":["x"]}}}'), (2, "x-pip", '{"*":{"pip":["x"]}}'), (None, "n", '{"ubuntu":["a"]}'), (3, "null", None)]
    new = [(1, "same", '{"ubuntu":["a"]}'), (1, "order", '{"ubuntu":["b","a"]}'), (1, "new", '{"ubuntu":["a"]}'), (1, "empty", '{"arch":["a"]}'), (1, "other", '{"ubuntu":{"jammy":{"foo":["x"]}}}'), (2, "x", '{"ubuntu":["x"]}'), (2, "x-pip", '{"*":{"pip":["x"]}}'), (3, "null", None), (4, "only", "{}")]
    before, after = spark.createDataFrame(old, DOCS), spark.createDataFrame(new, DOCS)
    got = {(r["change_id"], r["rosdep_key"]): (r["state"], r["kinds"]) for r in changes.kinds(before, after).collect()}
    assert got[1, "same"] == ("edited", []) and got[1, "order"] == ("edited", ["B.1a"]) and got[1, "new"] == ("added", ["A.1"]) and got[1, "gone"] == ("removed", [])
    assert got[1, "gone-pip"] == ("removed", []) and got[1, "empty"] == ("edited", ["A.2"]) and got[1, "other"] == ("edited", []) and got[3, "null"] == ("edited", []) and got[4, "only"] == ("added", ["A.1"])
    # the -pip form is only edited, which is enough
    assert got[2, "x"] == ("added", ["B.2a"]) and len(got) == 12
    moved = spark.createDataFrame([(1,), (1,)], "change_id long")
    affected = spark.createDataFrame([(1, "gone-pip"), (1, "gone-pip"), (1, "unknown")], "change_id long, rosdep_key string")
    few = {(r["change_id"], r["rosdep_key"]): r["kinds"] for r in changes.kinds(before, after, affected, moved).collect()}
    # change 1 is held to the keys at its lines, others have none and count whole
    assert {k for c, k in few if c == 1} == {"gone-pip"} and few[1, "gone-pip"] == ["B.2a"] and few[2, "x"] == ["B.2a"] and (4, "only") in few
    none = before.limit(0)
    assert changes.kinds(none, none).count() == 0 and {r["state"] for r in changes.kinds(none, after).collect()} == {"added"}
    assert {r["change_id"]: r["kinds"] for r in changes.of_change(changes.kinds(before, after)).collect()}[1] == ["A.1", "A.2", "B.1a"]


def test_as_of(spark):
    versions = spark.createDataFrame([("a", 1, "v1"), ("a", 3, "v3"), ("a", 3, "v3b"), ("b", 2, "w"), ("b", 4, None), (None, 1, "n")], "k string, at int, doc string")
    probes = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("a", 3, 2), ("a", 4, 3), ("b", 2, 4), ("b", 9, 5), ("c", 9, 6), (None, 2, 7), ("a", None, 8), ("a", 4, 3)], "k string, at int, id int")
    got = [(r["id"], r["doc"]) for r in changes.as_of(probes, versions, ["k"], "at", "doc").collect()]
    assert sorted(got, key=str) == sorted([(0, None), (1, "v1"), (2, "v1"), (3, "v3b"), (3, "v3b"), (4, None), (5, "w"), (6, None), (7, "n"), (8, None)], key=str)
    assert changes.as_of(probes, versions.limit(0), ["k"], "at", "doc").where("doc IS NULL").count() == 10


def test_match_status(spark):
    F = pytest.importorskip("pyspark.sql.functions")
    pairs = [(["A.1"], ["A.1"]), (["A.1", "B.1"], ["A.1"]), (["A.1"], ["A.1", "B.1"]), (["A.2"], ["A.1"]), ([], ["A.1"])]
    rows = spark.createDataFrame(pairs, "f array<string>, e array<string>").select(changes.match_status(F.col("f"), F.col("e")), changes.main_type(F.lit("B.1a")), changes.main_type(F.lit("A.2"))).collect()
    assert [r[0] for r in rows] == ["exact_match", "match_with_extra", "partial_match", "mismatch", "mismatch"] and tuple(rows[0])[1:] == ("B.1", "A.2")


def test_distribution_and_config(spark):
    schema = "file string, load_ord int, section string, name string, line int, doc string"
    rows = [("f", 0, "repositories", "a_b", 1, '{"release":{"packages":["p_q","p"]}}'), ("f", 0, "repositories", "bare", 1, "null"), ("f", 0, "repositories", "z", 1, '{"release":{"packages":["p"]},"status":"dead"}'), ("f", 0, "release_platforms", "arch", 1, '["x"]'),
            ("g", 1, "repositories", "alone", 1, "{}"), ("g", 1, "", "type", 1, '"x"'), ("c", 2, "supported_versions", "ubuntu", 1, '["2","1"]'), ("c", 2, "supported_versions", "none", 2, "null")]
    entries = spark.createDataFrame(rows, schema)
    got = {tuple(r) for r in mapping.distribution_rules(entries).select("rosdep_key", "platform", "os_version", "package_manager", "package", "source_key").collect()}
    assert ("p-q", "arch", "x", "pacman", "p-q", "a_b") in got and ("p", "osx", "*", "brew", "z", "z") in got and ("bare", "arch", "x", "pacman", "bare", "bare") in got and ("alone", "osx", "*", "brew", "alone", "alone") in got and len(got) == 7
    assert {r["name"]: r["status"] for r in mapping.repositories(entries).collect()} == {"a_b": "unknown", "bare": "unknown", "z": "dead", "alone": "unknown"}
    assert [tuple(r) for r in config.targets(entries).collect()] == [("c", "ubuntu", "2", 0), ("c", "ubuntu", "1", 1)]
    other = spark.createDataFrame([("d", 0, "supported_versions", "none", 9, "[]"), ("d", 0, "supported_versions", "ubuntu", 1, '["1","2"]')], schema)
    assert config.hashes(entries).first()["config_hash"] == config.hashes(other).first()["config_hash"]


def test_blocks_with_a_field_twice(spark):
    text = spark.createDataFrame([("Package: a\nVersion: 1\nVersion: 2\nPackage: b",), ("%NAME%\nx\n\n%NAME%\ny\nz\n",)], "value string")
    assert [r["fields"] for r in formats.block_fields(text.limit(1)).collect()] == [{"Version": "2", "Package": "b"}]
    assert formats.sections(text).collect()[1]["fields"] == {"NAME": ["y", "z"]}


def test_set_join_and_containment(spark, monkeypatch):
    """Shared files and contained texts against all pairs, with nulls, ties, hot files and short needles."""
    from pkgloom.operators import resolve

    monkeypatch.setattr(resolve, "MEET", 3)
    rng = random.Random(4)
    lists = [None, [], ["a"], ["a", None, "a"], [None], ["a", "b"], ["b", "c", "d"], ["d", "e"], ["z"]]
    probes = [(i, rng.choice(lists)) for i in range(40)] + [(3, ["a", "e"]), (None, ["a"])]
    entries = [(rng.choice(["x", "y"]), "1", "", rng.randrange(2), i, rng.choice("pqrs"), rng.choice(lists)) for i in range(60)]
    got = resolve.shared_files(spark.createDataFrame(probes, "probe_id long, filelist array<string>"), spark.createDataFrame(entries, "os_name string, os_version string, os_arch string, source_ord int, row_ord int, name string, filelist array<string>"))
    want = set()
    for i, own in probes:
        met = {}
        for o, v, a, so, ro, n, files in entries:
            if both := ({*(own or [])} & {*(files or [])}) - {None}:
                first, shared = met.get((o, v, a, n), ((so, ro), set()))
                met[o, v, a, n] = (min(first, (so, ro)), shared | both)
        want |= {(i, *k, *first, len(shared)) for k, (first, shared) in met.items()}
    assert sorted(map(repr, {tuple(r) for r in got.collect()})) == sorted(map(repr, want))
    needles = [None, "", " ", "none", "A", "ab", "abc", "Abcd", "x abc y", "bc de", "é", " long needle here ", "dle her", "unknown", "b", "~"]
    texts = [None, "", "abc", "ABCDE", "xx abc yy", "x abc y", "abc de", "a long needle here too", "é", "ab cd", "unknown a", "~ b"] * 2
    left, right = (spark.createDataFrame(list(enumerate(x)), f"{n} int, {n}t string") for x, n in ((needles, "i"), (texts, "j")))
    found = sorted((r["i"], r["j"]) for r in resolve.contained(left, right, "it", "jt").collect())
    tidy = lambda s: s.strip(" ").lower()
    assert found == sorted((i, j) for i, n in enumerate(needles) for j, t in enumerate(texts) if n and t is not None and tidy(n) not in ("", "none", "unknown") and tidy(n) in tidy(t))
    assert resolve.contained(left.limit(0), right, "it", "jt").count() == 0 and resolve.contained(left, right.limit(0), "it", "jt").count() == 0


def test_one_reading_of_a_change_gives_the_kinds_of_documents_and_lines_apart(spark):
    """Odd texts and lines too: null, no mapping, broken off, lines above the first key, keys of the wrong shape, aliases."""
    from pyspark.sql import functions as F

    texts = [
        None, "", "- a\n- b\n", "k: [a, {\n", "a: {ubuntu: [x]}\n", "# c\n\na:\n  ubuntu: [x, y]\nb: text\n", "a-pip:\n  ubuntu:\n    pip: [x]\nb: {fedora: null}\n", "a: &x\n  ubuntu: [x]\nb: *x\n'*': {'*': [y]}\n",
        "b:\n  ubuntu:\n    '*': [n]\n    focal: [m]\n", "b:\n  ubuntu:\n    '*': [n]\n", "a: {ubuntu: [x]}\n" * 2, "? [a, b]\n: {ubuntu: [x]}\n", "b:\n  ubuntu:\n    pip:\n      packages: [n]\n" + "a: {ubuntu: [x]}\n# " + "long" * 4_000 + "\n",
    ]
    lines = [None, [], [1], [2, 5], [99]]
    rows = [(i, before, after, lines[(i + j) % 5], lines[(i // 5 + j) % 5]) for j in range(2) for i, (before, after) in enumerate(((x, y) for x in texts for y in texts), j * 1_000)]
    changed = spark.createDataFrame(rows, "change_id long, before string, after string, removed array<int>, added array<int>")
    moved = changed.where("change_id % 2 = 0").select("change_id")
    got = changes.kinds_of_documents(mapping.documents_around(changed), moved)

    docs = lambda side: mapping.documents(changed.select("change_id", F.col(side).alias("text")))
    sides = [changed.select(F.concat_ws(" ", F.col("change_id").cast("string"), F.lit(s)).alias("doc_id"), F.col(s).alias("text"), F.col(n).alias("n")) for s, n in (("before", "removed"), ("after", "added"))]
    both = sides[0].union(sides[1])
    paths = yaml_index.changed_paths(both.select("doc_id", "text"), both.select("doc_id", F.explode("n").alias("line")))
    affected = paths.select(F.substring_index("doc_id", " ", 1).cast("long").alias("change_id"), yaml_index.top_key(F.col("path")).alias("rosdep_key"))
    want = changes.kinds(docs("before"), docs("after"), affected, moved)
    plain = lambda df: sorted((r["change_id"], r["rosdep_key"], r["state"], sorted(r["kinds"])) for r in df.collect())
    assert plain(got) == plain(want) and {k for r in plain(got) for k in r[3]} == {"A.1", "A.2", "B.1a", "B.2a"}
