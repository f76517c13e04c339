"""Every query with SQL against DuckDB on the same tables."""

import os

import duckdb
import pytest

from pkgloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = [f[:-8] for f in os.listdir(SF)] if os.path.isdir(SF) else []


def rows(df):
    df = df[sorted(df.columns)]
    plain = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else v
    return sorted((tuple(plain(v.item() if hasattr(v, "item") else v) for v in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.execute(registry.oracle_sql()[name]).df(), registry.queries()[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    assert rows(want) == rows(got)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_best_match_of_every_part(spark, tmp_path):
    names = [(1, "red big bolt", "A", "STEEL ROD", 7), (2, "red bolt", "B", "STEEL RODS", 9), (3, "red nut", "B", "STEEL ROD", 1), (4, "big red bolt", "B", "BRASS", 2)]
    spark.createDataFrame(names, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {(r["baseline_id"], r["repo_name"]): (r["bin_name"], r["score"]) for r in registry.queries()["c02_w01_best_match"](spark, str(tmp_path)).collect()}
    assert set(got) == {(i, b) for i in (1, 2, 3, 4) for b in "AB"}
    # the descriptions 'STEEL RODS' and 'STEEL ROD' share 9 of 19 characters twice; 0.1 is a description's weight
    [(name, score)] = [got[2, "A"]]
    one = spark.createDataFrame([("red bolt", "red big bolt", "STEEL RODS", "STEEL ROD")], "a string, b string, x string, y string")
    from pyspark.sql import functions as F

    from pkgloom.functions import similarity as S
    from pkgloom.operators import select

    names = select.name_features(one.select(F.col("a").alias("src_name"), F.col("a").alias("bin_name")).union(one.select("b", "b")))
    for p, v in (("t", "a"), ("c", "b")):
        one = one.join(names.select(F.col("bin_name").alias(v), *(F.col(c).alias(f"{p}_{c}") for c in ("core", "plain_src", "roles", "versions"))), v)
    cols = {"t_description": F.col("x"), "c_description": F.col("y"), "t_filelist": F.split("a", " "), "c_filelist": F.split("b", " "), "c_source": F.array(F.lit("filelist"))}
    constant = one.withColumns(cols).select(select.score(0.7, text=F.lit(0.0))).first()[0]
    assert name == "red big bolt" and abs(score - constant - 0.1 * 18 / 19) < 1e-5


def test_mapping_finds_by_each_way(spark):
    """By file, by description, by a spelling of the name and as upstream sibling; nulls find nothing and break nothing."""
    from pkgloom.operators import equivalence

    schema = "os_name string, os_version string, os_arch string, source_ord int, row_ord int, name string, source_name string, binary_name string, description string, filelist array<string>"
    entry = lambda os, n, name, about=None, files=None: (os, "1", "x", 0, n, name, name, name, about, files)
    entries = spark.createDataFrame([
        entry("fedora", 0, "foo-devel"), entry("arch", 1, "other", "x", ["libfoo.so"]), entry("debian", 2, "third", "a library for FOO things, and more"), entry("alpine", 3, "kin"),
        entry("gentoo", 4, "nothing", "none"), entry("nixos", 5, None, None, None), entry("fedora", 6, "foo-devel", "again"),
    ], schema)
    base = [(1, "libfoo", "libfoo-dev", "Library for foo things", ["libfoo.so", "foo.h"], "ubuntu"), (2, None, None, None, None, "ubuntu")]
    base = spark.createDataFrame(base, "baseline_id long, src_name string, bin_name string, description string, filelist array<string>, repo string")
    projects = spark.createDataFrame([("p", "ubuntu", "libfoo-dev", None, None), ("p", "alpine", None, None, "kin, kin-doc"), ("q", "gentoo", "nothing", "nothing", None)], "project string, repo string, binname string, srcname string, binnames string")
    got = {(r["baseline_id"], r["repo_name"], r["bin_name"]) for r in equivalence.detect(base, entries, projects).collect()}
    assert got == {(1, "fedora", "foo-devel"), (1, "arch", "other"), (1, "debian", "third"), (1, "alpine", "kin")}
    plain = {(r["baseline_id"], r["repo_name"], r["bin_name"]) for r in equivalence.detect(base.drop("repo"), entries).collect()}
    assert plain == got - {(1, "alpine", "kin")}
    assert equivalence.detect(base.limit(0), entries, projects).count() == 0 and equivalence.detect(base, entries.limit(0)).count() == 0


def test_lcs_ratio(spark):
    """Against the plain table, nulls and empty texts included."""
    import random

    from pyspark.sql import functions as F

    from pkgloom.functions import similarity as S

    rng = random.Random(2)
    word = lambda: rng.choice([None, ""] + ["".join(rng.choice("abcé-") for _ in range(rng.randrange(1, 90))) for _ in range(6)])
    pairs = [(word(), word()) for _ in range(300)]

    def plain(a, b):
        if a is None or b is None:
            return None
        row = [0] * (len(b) + 1)
        for x in a:
            before = row[:]
            for j, y in enumerate(b):
                row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
        return 2 * row[-1] / (len(a) + len(b)) if a and b else 0.0

    got = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").select("i", S.lcs_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert {r["i"]: r["r"] for r in got} == {i: plain(*p) for i, p in enumerate(pairs)}
