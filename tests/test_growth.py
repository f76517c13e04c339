"""What grows with the tables is not sent through the driver, and equal keys do not meet pair by pair where one of them is asked for."""

import re

import pytest

from pkgloom.plans import registry

SF = "/root/testdata/sf0.001"


def planned(df):
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("name", ["c11_index_scan", "f29_messages", "k05_defect_reports"])
def test_keys_of_an_audit_are_not_broadcast(spark, name):
    joins = re.findall(r"BroadcastHashJoin \[([^\]]*)\]", planned(registry.queries()[name](spark, SF)))
    assert not [j for j in joins if re.search(r"rosdep_key|package|counterpart|\bk#", j)]


def joined(spark, df):
    """The rows that df's joins give when it is run."""

    def of(plan):
        metrics, children = plan.metrics(), plan.children()
        own = metrics.apply("numOutputRows").value() if "Join" in plan.nodeName() else 0
        return own + sum(of(children.apply(i)) for i in range(children.size()))

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df.collect()
        return of(df._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.fixture
def alike(spark, tmp_path):
    """400 parts of one name, brand and type."""
    rows = [(i, "red bolt", "Brand#1", "SMALL", i % 50 + 1) for i in range(400)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["j01_first_match_lookup", "j03_either_key", "j04_layer_key"])
def test_a_key_meets_its_first_entry_only(spark, alike, name):
    df = registry.queries()[name](spark, alike)
    assert joined(spark, df) <= 2 * 400
    assert {r["found"] for r in df.collect()} <= ({0} if name != "j03_either_key" else {0, 25})


def test_deep_nesting_is_an_error_not_the_end_of_the_process():
    import subprocess
    import sys

    code = "from pkgloom.sources import yaml_index as y\nfor t in ('k: [a, {' * 60000, '[' * 60000 + ']' * 60000, '- ' * 60000 + 'x'):\n try: y.entries(t)\n except ValueError as e: print(e)"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and done.stdout.split("\n")[:3] == ["nested too deep"] * 3
    from pkgloom.sources import yaml_index

    assert len(yaml_index.entries("\n".join(f"k{i}: [a, {{b: c}}]" for i in range(6000)))) == 6000


@pytest.mark.parametrize("lines", [[(1, "R"), (2, "A"), (None, "R")], [(1, "A"), (None, "R")]])
def test_resume_is_not_in_without_a_broadcast_of_keys(spark, tmp_path, lines):
    import duckdb

    spark.createDataFrame([(1,), (2,), (3,), (None,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = registry.queries()["j18_resume"](spark, str(tmp_path))
        assert "Broadcast" not in planned(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(repr, (r[0] for r in df.collect()))) == sorted(repr(r[0]) for r in con.execute(registry.oracle_sql()["j18_resume"]).fetchall())


@pytest.mark.parametrize("name, pairs", [("f04_component_join", 20_000), ("j02_stripped_key", 20_000), ("m06_jaccard", 39_800), ("c12_disjoint_pairs", 20_000)])
def test_rows_that_are_alike_meet_as_blocks(spark, tmp_path, name, pairs):
    rows = [(i, ("red bolt", "blue nut")[i // 2 % 2], "Brand#1", "SMALL", i % 2 * 30 + 1) for i in range(400)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    df = registry.queries()[name](spark, str(tmp_path))
    assert joined(spark, df) <= 1_000
    assert df.count() == df.distinct().count() == pairs


def test_pairs_of_two_blocks_are_few_and_null_ids_are_kept(spark):
    from pkgloom.operators import resolve

    rows = [(i, "k") for i in range(500)] + [(None, "k")]
    left, right = (spark.createDataFrame(rows, f"{c} long, k string") for c in "ab")
    df = resolve.met_in_blocks(left, right, ["k"], "a", "b")
    assert df.count() == df.distinct().count() == 501 * 501 and df.where("a IS NULL AND b IS NULL").count() == 1
    # what Spark holds at a time of what two blocks give
    sizes = [r["n"] for r in resolve._blocks(left, ["k"], "a", most=resolve.SMALL).selectExpr("size(_ids) AS n").collect()]
    assert sum(sizes) == 501 and max(sizes) <= 2 * resolve.SMALL and resolve.SMALL * resolve.BLOCK <= 100_000


@pytest.mark.parametrize("name", ["f04_component_join", "j02_stripped_key", "m06_jaccard", "c12_disjoint_pairs"])
def test_pairs_are_handed_on_by_one_id_of_a_block(spark, name):
    """What Spark compiles together holds what a row of its input gives: the join and the two steps that make pairs are apart."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    last, first, join = (next(x for x in plan.splitlines() if re.search(what, x)) for what in (r"Generate explode\(_bs", r"Generate explode\(.*_as", r"SortMergeJoin \[.*_at"))
    stage = lambda line: re.findall(r"\*\((\d+)\)", line)
    assert stage(last) and stage(first) != stage(last) != stage(join) != stage(first)


def test_pairs_of_one_key_are_made_by_several_tasks(spark, alike):
    df = registry.queries()["j02_stripped_key"](spark, alike)
    assert df.groupBy().count().first()[0] == 200 * 200
    from pyspark.sql import functions as F

    assert df.select(F.spark_partition_id()).distinct().count() > 1


@pytest.mark.parametrize("name", ["f04_component_join", "j02_stripped_key"])
def test_keys_of_pairs_are_made_once_for_a_block(spark, name):
    lines = planned(registry.queries()[name](spark, SF)).splitlines()
    depth = lambda line: re.search(r"[A-Z]", line).start()
    for i, line in enumerate(lines):
        if re.search(r"Aggregate.*collect_list", line):
            below = lines[i + 1 : next((j for j in range(i + 1, len(lines)) if depth(lines[j]) <= depth(line)), len(lines))]
            assert below and not [x for x in below if "regexp" in x]


def shares(name):
    """How often the query makes an element's fields, and whether parts are dealt out before it does."""
    makers = {"s08_rpm_primary": r"from_xml\("}

    def of(spark):
        plan = planned(registry.queries()[name](spark, SF))
        return len(re.findall(makers.get(name, r"map_from_entries\("), plan)), "REPARTITION" in plan

    return of


@pytest.mark.parametrize("name, times", [("s03_blocks", 1), ("s04_debian_packages", 1), ("s14_pacman_desc", 1), ("s11_apkindex", 1), ("s08_rpm_primary", 1), ("s15_pacman_files", 2), ("s24_ros_index", 2)])
def test_fields_of_an_element_are_made_once_by_tasks_that_grow_with_the_table(spark, name, times):
    made, dealt = shares(name)(spark)
    assert made <= times and dealt


def test_spellings_of_an_id_with_one_name_are_not_held(spark):
    from pkgloom.operators import mapping

    rows = [(i, ("red-bolt-data", "blue-nut")[i % 2]) for i in range(50)] + [(50, "red-bolt-data"), (50, "red-bolt-fonts")]
    df = mapping.name_variants(spark.createDataFrame(rows, "id long, name string"), "id")

    def held(plan):
        children = plan.children()
        own = plan.metrics().apply("numOutputRows").value() if plan.nodeName() == "HashAggregate" and "variant#" in plan.simpleString(99) else 0
        return own + sum(held(children.apply(i)) for i in range(children.size()))

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        n = df.where("id < 50").count() + df.where("id = 50").count()
        assert n == df.distinct().count()
        found = df.collect()
        assert held(df._jdf.queryExecution().executedPlan()) <= 4 * sum(r["id"] == 50 for r in found)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("name, keys", [("a13_naming", "entry"), ("j21_extra_rates", "entry")])
def test_names_are_dealt_out_before_they_are_collected(spark, name, keys):
    plan = planned(registry.queries()[name](spark, SF))
    assert "Expand" not in plan and re.search(rf"Exchange hashpartitioning\({keys}#.*REPARTITION", plan)


def test_small_files_share_tasks_and_large_ones_do_not():
    from pkgloom.sources import yaml_index as y

    assert list(y.batches([10] * 130)) == [list(range(64)), list(range(64, 128)), [128, 129]]
    assert list(y.batches([y.MOST_BYTES, 1, 1, 2 * y.MOST_BYTES, 1])) == [[0], [1, 2], [3], [4]] and list(y.batches([])) == []


def test_a_sibling_of_several_projects_is_looked_for_once(spark, monkeypatch):
    from pkgloom.operators import equivalence, resolve

    entries = spark.createDataFrame([("debian", "", "", 0, i, f"red{i}", f"red{i}", f"red{i}", "d", ["f"]) for i in range(4)], "os_name string, os_version string, os_arch string, source_ord int, row_ord int, name string, source_name string, binary_name string, description string, filelist array<string>")
    projects = spark.createDataFrame([(f"p{k}", "debian", f"red{i}", f"red{i}", None) for k in range(10) for i in range(4)], "project string, repo string, binname string, srcname string, binnames string")
    targets = spark.createDataFrame([(1, "red0", "red0", "x", ["g"], "debian")], "target_id long, src_name string, bin_name string, description string, filelist array<string>, repo string")
    seen, real = [], resolve.first_match_everywhere
    monkeypatch.setattr(resolve, "first_match_everywhere", lambda probes, rows: seen.append(probes) or real(probes, rows))
    found = equivalence.candidates(targets, entries, projects)
    assert [p.count() for p in seen if "only" in p.columns] == [4]
    assert sorted(r["name"] for r in found.where("prio = 4").collect()) == ["red0", "red1", "red2", "red3"]


def test_archives_are_written_by_tasks_that_grow_with_the_table(spark, monkeypatch):
    from pkgloom.plans import studies

    seen, real = [], studies.archives.write
    monkeypatch.setattr(studies.archives, "write", lambda contents, folder: seen.append(planned(contents)) or real(contents, folder))
    registry.queries()["s13_archive_lists"](spark, SF)
    assert "REPARTITION" in seen[0]


@pytest.mark.parametrize("name, most", [("c11_index_scan", 10), ("f29_messages", 10), ("k05_defect_reports", 11)])
def test_an_audit_is_one_pass_over_its_index(spark, name, most):
    assert len(re.findall(r"Join ", planned(registry.queries()[name](spark, SF)))) <= most


def test_changes_that_meet_one_document_share_its_audit(spark, monkeypatch):
    from pkgloom.operators import changes

    seen, real = [], changes.audit.audit
    monkeypatch.setattr(changes.audit, "audit", lambda *a: seen.append(a[4].count()) or real(*a))
    n = registry.queries()["c07_change_audit"](spark, SF).count()
    assert seen and seen[0] < n


def test_kinds_of_changes_are_made_from_one_reading_of_the_files(spark):
    plan = planned(registry.queries()["c06_change_kinds"](spark, SF))
    assert not re.search("Join|Python|Arrow|Pandas", plan)


def test_orders_are_dealt_out_before_their_files_are_read(spark):
    assert re.search(r"Exchange hashpartitioning\(o_orderkey#.*REPARTITION", planned(registry.queries()["s35_changed_nodes"](spark, SF)))


def test_a_document_is_unfolded_once_for_rules_and_keys(spark):
    from pkgloom.operators import changes

    docs = spark.createDataFrame([(1, "a", '{"ubuntu": ["x"]}'), (1, "b", "{}"), (2, "c", "no")], "change_id long, rosdep_key string, doc string")
    df = changes.entry_maps(docs, "change_id")
    assert planned(df).count("Scan ") == 1 and sorted((r["rosdep_key"], len(r["entry"])) for r in df.collect()) == [("a", 1), ("b", 0), ("c", 0)]


def test_names_of_a_change_are_counted_without_sets_or_copies_of_rows(spark):
    plan = planned(registry.queries()["a11_name_growth"](spark, SF))
    assert "Expand" not in plan and "collect_" not in plan and len(re.findall(r"Exchange hashpartitioning\(change_id#.*REPARTITION", plan)) == 1
    assert len(re.findall(r"parquet .*l_orderkey#", plan)) == 1


def test_vectors_meet_as_blocks_and_give_what_cosine_gives(spark):
    from pyspark.sql import functions as F

    from pkgloom.functions import similarity as S
    from pkgloom.operators import resolve

    plan = planned(registry.queries()["f20_cosine"](spark, SF))
    assert "FlatMapCoGroupsInArrow" in plan and "zip_with" not in plan
    shapes = [[1.0, 2.0], [-1.0, 0.5], [0.0, 0.0], [], [3.0], None, [1.0, None], [2.0, 4.0]]
    rows = [(i if i else None, i % 3 if i % 7 else None, shapes[i % len(shapes)]) for i in range(60)]
    left, right = (spark.createDataFrame(rows, f"{c} long, k int, v array<float>") for c in "ab")
    keep = resolve.BLOCK
    resolve.BLOCK = 4
    try:
        found = resolve.cosines(left, right, ["k"], "a", "b", "v", 4).collect()
    finally:
        resolve.BLOCK = keep
    pairs = left.join(right.withColumnRenamed("v", "w"), "k").select("a", "b", F.round(S.cosine(F.col("v"), F.col("w")), 4).alias("cosine")).collect()
    assert len(found) == len(pairs) > 500 and sorted(map(repr, found)) == sorted(map(repr, pairs))


def test_an_edit_of_two_documents_is_judged_once_for_all_changes(spark, monkeypatch):
    from pkgloom.operators import changes
    from pkgloom.sources import yaml_index

    seen, real = [], changes.entry_maps
    monkeypatch.setattr(changes, "entry_maps", lambda docs, *ids: seen.append(docs.count()) or real(docs, *ids))
    # nodes are not made as rows of their own
    monkeypatch.setattr(yaml_index, "nodes", None)
    n = registry.queries()["c06_change_kinds"](spark, SF).count()
    assert n == 1_500 and seen and sum(seen) < 100


def test_rows_of_an_audit_are_sorted_once_and_not_held_as_places(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = registry.queries()["c11_index_scan"](spark, SF)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    dealt = next(i for i, x in enumerate(plan) if re.search(r"Exchange hashpartitioning\(rosdep_key#\d+, \d+\), REPARTITION", x))
    above = plan[:dealt]
    assert len([x for x in above if re.search(r"- Window \[", x)]) == 3 and len([x for x in above if re.search(r"\) Sort \[|- Sort \[", x)]) == 1
    assert not [x for x in above if "Aggregate" in x]


def test_an_audit_of_odd_rows(spark):
    """Null and empty keys, keys and packages twice, null packages, targets without an order and places that are none."""
    from pkgloom.operators import audit

    states = [
        ("a", "u", "1", "LISTED", ["x", "y"], "apt"), ("a", "u", "2", "LISTED", ["x", "x"], "pip"), ("a", "f", "1", "NULL", None, None), ("b", "u", "1", "LISTED", ["q"], "pip"), ("b", "u", "2", "LISTED", ["q"], "apt"), ("b", "f", "1", "EMPTY", [], "dnf"),
        (None, "u", "1", "LISTED", ["x"], "apt"), (None, "u", "2", "NULL", None, None), ("c", "u", "1", "LISTED", [None], "apt"), ("c", "z", "9", "LISTED", ["x"], "apt"), ("e", "u", "1", "LISTED", ["x"], "apt"), ("", None, "1", "NULL", None, None), ("g-pip", "u", "1", "LISTED", ["x"], "pip"),
    ]
    found = [("a", "u", "1", "x"), ("a", "u", "1", "x"), ("a", "u", "1", "z"), ("a", "f", "1", "af"), ("b", "u", "1", "q"), ("b", "u", "2", "bb"), ("b", "f", "1", None), ("b", "f", "1", "b2"), (None, "u", "1", "x"), (None, "u", "2", "n"), ("c", "u", "1", "m"), ("c", "z", "9", "m"), ("h", "u", "1", "hh"), ("", "u", "1", None), ("g-pip", "u", "1", "x")]
    there = [("u", "1", "x"), ("u", "1", "x"), ("u", "2", "x"), ("u", "1", "q"), ("u", "2", "bb"), ("u", "1", None), ("f", "1", "e")]
    place = "rosdep_key string, os_name string, os_version string"
    tables = [
        spark.createDataFrame(rows, schema)
        for rows, schema in (
            (states, f"{place}, state string, packages array<string>, package_manager string"), (found, f"{place}, bin_name string"), (there, "os_name string, os_version string, package string"),
            ([("u", "1", 0), ("u", "2", 1), ("f", "1", None)], "os_name string, os_version string, ver_ord int"),
        )
    ]
    keys = lambda *names: spark.createDataFrame([(k,) for k in names], "rosdep_key string")
    plain = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    of_places = [
        ("a", "f", "1", "A.2", "missing", None, "af"), ("a", "u", "1", "B.1a", "not_found", "y", "x"), ("b", "f", "1", "B.1b", "empty_list", None, "b2"), ("b", "u", "1", "B.2a", "pip", "q", "q"),
        ("c", "u", "1", "B.1b", "differs", None, "m"), ("g-pip", "u", "1", "B.2a", "pip", "x", "x"),
    ]
    absent = lambda k: (k, None, None, "A.1", "absent", None, None)
    wanted = keys("a", "a", "b", "d", None, "e", "h", "pyz", "")
    assert plain(audit.audit(*tables)) == sorted(of_places, key=repr)
    assert plain(audit.audit(*tables, wanted)) == sorted([*of_places, *map(absent, ("d", "h", "pyz")), ("e", None, None, "B.1a", "no_info", None, None)], key=repr)
    assert plain(audit.audit(*tables, wanted, keys("e", "h", None))) == sorted([*of_places, *map(absent, ("d", "pyz"))], key=repr)


def test_a_long_document_is_not_carried_through_the_audit(spark, monkeypatch):
    from datetime import datetime

    from pkgloom.operators import changes

    seen, real = [], changes.audit.audit
    monkeypatch.setattr(changes.audit, "audit", lambda *a: seen.extend(r[0] for r in a[4].collect()) or real(*a))
    docs = ['{"ubuntu":["%s"]}' % ("x" * 500 + e) for e in "ab"] + [None]
    versions = spark.createDataFrame([("k", datetime(2000, 1, 1 + i), d) for i, d in enumerate(docs)] + [(None, datetime(2000, 1, 1), docs[0])], "rosdep_key string, at timestamp, doc string")
    rows = spark.createDataFrame([(i, datetime(2000, 1, 1 + i), ["B.1a"]) for i in range(4)], "change_id long, at timestamp, expected array<string>")
    configs = spark.createDataFrame([(0, datetime(1900, 1, 1), "ubuntu", "noble", 0)], "config int, at timestamp, os_name string, os_version string, ver_ord int")
    found = spark.createDataFrame([("k", "ubuntu", "noble", "x" * 500 + "a")], "rosdep_key string, os_name string, os_version string, bin_name string")
    there = spark.createDataFrame([("ubuntu", "noble", "x" * 500 + "a")], "os_name string, os_version string, package string")
    touched = spark.createDataFrame([(i, "k") for i in range(4)] + [(0, "k"), (3, None), (9, "k")], "change_id long, rosdep_key string")
    out = changes.audited(rows, touched, versions, configs, found, there)
    assert {r["change_id"]: (r["found"], r["status"]) for r in out.collect()} == {0: (["A.1"], "mismatch"), 1: ([], "mismatch"), 2: (["B.1"], "exact_match"), 3: (["A.1", "B.1"], "match_with_extra")}
    assert len(seen) == 5 and max(map(len, seen)) <= changes.LONG + 20


def test_candidates_are_moved_once_for_all_weights(spark, monkeypatch):
    """One exchange by group, of the rows and not of their copies by weight, which only the best become."""
    from pkgloom.operators import equivalence

    seen, real = [], equivalence.select.top_k

    def kept(*a):
        out = real(*a)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            seen.append(out._jdf.queryExecution().executedPlan().toString())
        finally:
            spark.conf.unset("spark.sql.adaptive.enabled")
        return out

    monkeypatch.setattr(equivalence.select, "top_k", kept)
    assert registry.queries()["c08_weight_sweep"](spark, SF).count() == 11
    (plan,) = seen
    assert [re.sub(r"#\d+", "", x) for x in re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plan)] == ["baseline_idL, repo_name, repo_version"]
    assert re.search(r"Generate inline.*Aggregate.*Window.*Sort \[.*Exchange", plan, re.S) and "Generate" not in plan.split("Exchange hash")[1]


@pytest.mark.parametrize("k", [1, 2])
def test_the_best_by_each_weight_is_what_ranks_give(spark, k):
    """Ties in score go by the scan order; null groups, features and names; scores of 0, below and missing; candidates that are out."""
    import random

    from pyspark.sql import functions as F

    from pkgloom.operators import select

    rng = random.Random(7)
    rows = [(rng.choice([1, 2, None]), rng.choice(["f", None]), rng.choice(["1", ""]), rng.choice(["a", "b", None]), (rng.randrange(3), None if i % 9 == 0 else 0, i), rng.choice([0.0, 0.4, 0.6]), rng.choice([None, 0.0, 1.0, 1.0, 2.5, -1.0]), rng.choice([0.0, 1.0, 1.0, 2.0])) for i in range(90)]
    kept = spark.createDataFrame(rows, "baseline_id long, repo_name string, repo_version string, bin_name string, cand_ord struct<prio:int,source_ord:int,row_ord:long>, coverage double, first double, second double")
    weights = [0.0, 0.1, 0.5, 0.7, 1.0]
    out = [*select.GROUP, "w", "bin_name", "cand_ord", "score", "rank"]
    got = select.top_k(kept, k, ("w",), {w: F.round(select.weighed(w, F.col("first"), F.col("second")), 6) for w in weights}).select(*out)
    copies = kept.withColumn("w", F.explode(F.array(*map(F.lit, weights))))
    want = select.top_k(copies.withColumn("score", F.round(select.weighed(F.col("w"), F.col("first"), F.col("second")), 6)), k, ("w",)).select(*out)
    assert got.count() > 20 * k and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert select.top_k(kept.limit(0), k, ("w",), {0.5: F.col("first")}).count() == 0


@pytest.mark.parametrize("name", ["c08_weight_sweep", "j21_extra_rates"])
def test_names_that_are_found_are_not_broadcast(spark, name):
    joins = [x for x in planned(registry.queries()[name](spark, SF)).splitlines() if re.search(r"Join.*entry", x)]
    assert joins and not [x for x in joins if "Broadcast" in x]


def test_matches_are_made_once_for_counts_and_ranks(spark):
    from pkgloom.operators import compare

    truth = spark.createDataFrame([(1, "u", "a"), (2, "u", "b")], "entry int, platform string, name string")
    found = spark.createDataFrame([("t", 1, "u", "a"), ("s", 1, "u", "a"), ("s", 2, "u", "b"), (None, 1, "u", "a")], "tool string, entry int, platform string, name string")
    df = compare.overall(compare.platform_matches(truth, found, spark.createDataFrame([("t",), ("s",), (None,), ("r",), ("t",)], "tool string")))
    assert len(re.findall(r"Join .*entry", planned(df))) == 1
    # a method without a name has a rank that is not given
    assert sorted(map(tuple, df.collect())) == [("r", 0, 0, 2, 2, 0.0, 0.0, 4), ("s", 2, 0, 0, 2, 100.0, 100.0, 1), ("t", 1, 0, 1, 2, 50.0, 50.0, 2)]
