"""From rule files to rules and back, and the other ways in which one name leads to another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import clean_name, plain_variants, roles, variant_seeds, variant_templates
from ..sources.shared import stored
from .rules import default_manager, is_manager

# fixed values: releases by number
CODENAMES = {"24.04": "noble", "22.04": "jammy", "20.04": "focal", "18.04": "bionic", "12": "bookworm", "11": "bullseye", "sid": "sid"}

_OBJECT = "map<string,string>"


def rule_payloads(docs: DataFrame, *ids: str, keys: bool = False) -> DataFrame:
    """docs (ids, rosdep_key, doc: a JSON object by platform) as (ids, rosdep_key, platform, os_version, package_manager,
    packages: a list, null where the document says null).

    A platform's value is a list (any version, its default manager), an object of managers (any version), an object of
    versions (each a list, an object of managers or null) or null (unavailable). Under '*' only pip counts. Other values,
    such as bare strings, make no rule. A version whose object has no known manager has neither manager nor packages.
    With keys each document has one more row, whose platform is null.
    """
    place = [*ids, "rosdep_key", "platform", "os_version"]
    said = F.explode(F.from_json("doc", _OBJECT)).alias("platform", "v")
    if keys:
        none = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value")))
        said = F.inline(F.concat(F.coalesce(F.map_entries(F.from_json("doc", _OBJECT)), F.filter(none, lambda _: F.lit(False))), none)).alias("platform", "v")
    rows = docs.select(*ids, "rosdep_key", said).withColumn("m", F.from_json("v", _OBJECT))
    whole = F.col("v").isNull() | F.col("v").startswith("[") | (F.col("platform") == "*") | F.exists(F.map_keys("m"), is_manager)
    rows = rows.withColumn("m", F.when(whole, F.create_map(F.lit("*"), F.col("v"))).otherwise(F.col("m")))
    rows = rows.select(*ids, "rosdep_key", "platform", F.explode("m").alias("os_version", "w"))
    allowed = lambda k, _: is_manager(k) & ((F.col("platform") != "*") | (k == "pip"))
    default = default_manager(F.col("platform"))
    by_manager = F.when(F.col("w").isNull(), F.create_map(default, F.lit(None).cast("string"))).when(F.col("w").startswith("["), F.create_map(default, F.col("w"))).otherwise(F.map_filter(F.from_json("w", _OBJECT), allowed))
    rows = rows.where("w IS NULL OR platform <> '*' OR os_version <> '*' OR size(map_filter(from_json(w, 'map<string,string>'), (k, v) -> k = 'pip')) > 0")
    rows = rows.select(*place, F.explode_outer(by_manager).alias("package_manager", "x"))
    inner = F.from_json("x", _OBJECT)
    payload = F.when(F.col("x").startswith("["), F.col("x")).otherwise(F.coalesce(inner["packages"], F.get(F.map_values(inner), F.lit(0))))
    return rows.select(*place, "package_manager", F.from_json(payload, "array<string>").alias("packages"))


def normalised(docs: DataFrame) -> DataFrame:
    """docs (rosdep_key, doc) as rules, one row for each package of rule_payloads(), and one for each null."""
    rows = rule_payloads(docs).where("package_manager IS NOT NULL").select("*", F.col("packages").isNull().alias("is_null"))
    named = F.when(F.col("is_null"), F.array(F.lit(None).cast("string"))).otherwise(F.col("packages"))
    return rows.select("rosdep_key", "platform", "os_version", "package_manager", F.explode(named).alias("package"), "is_null")


def is_valid(doc: Column) -> Column:
    """Whether a stored rule (JSON) is an object of platforms, of versions and of managers that each have packages; other
    fields of a manager are let be, and what is no object isn't valid."""
    objects = lambda s: F.from_json(F.when(F.ltrim(s).startswith("{"), s), _OBJECT)

    def inside(s: Column, test) -> Column:
        return F.coalesce(F.forall(F.map_values(objects(s)), lambda x: F.coalesce(x.startswith("{"), F.lit(False)) & test(x)), F.lit(False))

    return inside(doc, lambda p: inside(p, lambda v: inside(v, lambda m: F.array_contains(F.map_keys(F.from_json(m, _OBJECT)), "packages"))))


def loaded(entries: DataFrame) -> DataFrame:
    """(rosdep_key, doc) of entries (load_ord, name, doc) of rule files: a key has the document of the last file."""
    rows = entries.where("name IS NOT NULL").groupBy(F.col("name").alias("rosdep_key")).agg(F.max_by(F.struct("doc"), F.struct("load_ord", "doc"))["doc"].alias("doc"))
    return rows


def distribution_rules(entries: DataFrame) -> DataFrame:
    """Rules (rosdep_key, platform, os_version, package_manager, package, is_null, source_key) of distribution files, whose
    entries (load_ord, section, name, doc) are split by release_platforms and repositories.

    Each package of a repository (of its release; without any the repository itself) is a key, with - for _, that every
    platform and version of the file's platforms has under its own name, and osx by the repository's. Of a key that several
    repositories have the last one counts.
    """
    # fixed values: managers of the platforms; all others have apt
    managers = {"ubuntu": "apt", "debian": "apt", "fedora": "dnf", "rhel": "yum", "opensuse": "zypper", "gentoo": "portage", "arch": "pacman", "osx": "brew", "freebsd": "pkg_add", "cygwin": "apt-cyg"}
    packages = F.coalesce(F.from_json("doc", "release struct<packages:array<string>>")["release"]["packages"], F.array("name"))
    keys = entries.where("section = 'repositories'").select("load_ord", F.col("name").alias("source_key"), F.explode(packages).alias("p"))
    keys = keys.groupBy("load_ord", F.translate("p", "_", "-").alias("rosdep_key")).agg(F.max("source_key").alias("source_key"))
    platforms = entries.where("section = 'release_platforms'").groupBy("load_ord").agg(F.collect_list(F.struct(F.col("name").alias("platform"), F.from_json("doc", "array<string>").alias("versions"))).alias("ps"))
    # a file's platforms are a short list, and travel with its keys
    rows = keys.join(platforms, "load_ord", "left")
    own = F.flatten(F.transform("ps", lambda p: F.transform(p["versions"], lambda v: F.struct(p["platform"].alias("platform"), v.alias("os_version"), F.col("rosdep_key").alias("package")))))
    osx = F.array(F.struct(F.lit("osx").alias("platform"), F.lit("*").alias("os_version"), F.col("source_key").alias("package")))
    rows = rows.select("rosdep_key", "source_key", F.inline(F.concat(osx, F.coalesce(own, F.array().cast("array<struct<platform:string,os_version:string,package:string>>")))))
    manager = F.coalesce(F.create_map(*(F.lit(x) for kv in managers.items() for x in kv))[F.col("platform")], F.lit("apt"))
    return rows.select("rosdep_key", "platform", "os_version", manager.alias("package_manager"), "package", F.lit(False).alias("is_null"), "source_key")


#: What reports call the version of a package that names none.
_GENERAL = "general"


def entry_documents(tables: DataFrame, supported: list[str]) -> DataFrame:
    """One entry for each group of tables (group_id, repo_key, ord, package): group_id, rosdep_key, doc, issues.

    The key is the package of ubuntu, ubuntu_jammy, _focal, _bionic, _noble, in this order, else the first. A platform is
    the repository's key up to _, its version what follows. A platform is a list of packages where it names no version, one
    version, or several with the same packages (also as those without a version), else an object of its versions. Where
    the group has a pypi package, supported platforms that it has no other for get it by pip. Platforms that entries don't
    know are left out and named in issues, as is an empty entry. Rows without a package count for nothing; groups without any have no entry.
    """
    # fixed values: platforms of entries by the names of repositories
    platforms = {p: p for p in ("ubuntu", "debian", "fedora", "rhel", "opensuse", "arch", "gentoo", "nixos", "alpine", "freebsd", "osx", "macports", "openembedded")} | {"centos": "rhel"}
    first = ("ubuntu", "ubuntu_jammy", "ubuntu_focal", "ubuntu_bionic", "ubuntu_noble")
    rows = tables.where("coalesce(package, '') <> ''")
    rank = F.coalesce(F.create_map(*(F.lit(x) for i, k in enumerate(first) for x in (k, i)))[F.col("repo_key")], F.lit(len(first)))
    named = rows.groupBy("group_id").agg(F.min_by("package", F.struct(rank, "ord", "package")).alias("rosdep_key"), F.min_by("package", F.when(F.lower("repo_key") == "pypi", F.struct("ord", "package"))).alias("pip"))
    parts = F.split(F.lower("repo_key"), "_")
    system = rows.where("lower(repo_key) <> 'pypi'").select("group_id", F.create_map(*(F.lit(x) for kv in platforms.items() for x in kv))[parts[0]].alias("platform"), parts[0].alias("own"), F.coalesce(F.get(parts, F.lit(1)), F.lit(_GENERAL)).alias("version"), "ord", "package")
    # of a version the last package counts, of none all, in their order
    in_order = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "package"))), lambda x: x["package"]))
    lists = system.where("platform IS NOT NULL").groupBy("group_id", "platform", "version").agg(F.when(F.col("version") == _GENERAL, in_order).otherwise(F.array(F.max_by("package", F.struct("ord", "package")))).alias("p"))
    each = lists.groupBy("group_id", "platform").agg(F.array_sort(F.collect_list(F.struct("version", "p"))).alias("vs"), F.count_distinct("p").alias("n"), F.min("p").alias("p"))
    versions = F.map_from_entries(F.filter("vs", lambda v: v["version"] != _GENERAL))
    each = each.select("group_id", "platform", F.when(F.col("n") == 1, F.to_json("p")).otherwise(F.to_json(versions)).alias("d"))
    whole = each.groupBy("group_id").agg(F.collect_list(F.struct("platform", "d")).alias("ds"))
    unknown = system.where("platform IS NULL").groupBy("group_id").agg(F.array_sort(F.collect_set(F.concat(F.lit("Unknown distribution: "), "own"))).alias("issues"))
    out = named
    for side in (whole, unknown):
        out = out.join(side.withColumnRenamed("group_id", "_g"), F.col("group_id").eqNullSafe(F.col("_g")), "left").drop("_g")
    none = F.array().cast("array<struct<platform:string,d:string>>")
    have = F.transform(F.coalesce("ds", none), lambda x: x["platform"])
    rest = F.filter(F.array(*map(F.lit, supported)).cast("array<string>"), lambda p: ~F.array_contains(have, p))
    pip = F.concat(F.lit('{"pip":{"packages":'), F.to_json(F.array("pip")), F.lit("}}"))
    ds = F.concat(F.coalesce("ds", none), F.when(F.col("pip").isNotNull(), F.transform(rest, lambda p: F.struct(p.alias("platform"), pip.alias("d")))).otherwise(none))
    body = F.array_join(F.transform(F.array_sort(ds), lambda x: F.concat(F.lit('"'), x["platform"], F.lit('":'), x["d"])), ",")
    text = F.concat(F.lit("{"), body, F.lit("}"))
    issues = F.coalesce("issues", F.array().cast("array<string>"))
    return out.select("group_id", "rosdep_key", text.alias("doc"), F.when(text == "{}", F.array_append(issues, "Entry is empty")).otherwise(issues).alias("issues"))


def repositories(entries: DataFrame) -> DataFrame:
    """(load_ord, name, status, source_url, version, packages) of the repositories of distribution files; a status is
    unknown where none is stated, and a repository without a list of packages is one itself."""
    kind = "status string, source struct<url:string,version:string>, release struct<url:string,version:string,packages:array<string>>"
    rows = entries.where("section = 'repositories'").select("load_ord", "name", F.from_json("doc", kind).alias("r"))
    return rows.select("load_ord", "name", F.coalesce("r.status", F.lit("unknown")).alias("status"), F.col("r.source.url").alias("source_url"), F.col("r.release.version").alias("version"), F.coalesce("r.release.packages", F.array("name")).alias("packages"))


def assembled(entries: DataFrame, distribution: DataFrame) -> DataFrame:
    """Rules of rule files and then of distribution files, with from_distribution: a key of the latter replaces the former's."""
    last = distribution_rules(distribution)
    plain = normalised(loaded(entries).join(last.select("rosdep_key").distinct(), "rosdep_key", "left_anti"))
    return plain.withColumn("from_distribution", F.lit(False)).unionByName(last.drop("source_key").withColumn("from_distribution", F.lit(True)))


def documents(texts: DataFrame) -> DataFrame:
    """(change_id, rosdep_key, doc) of texts (change_id, text) in YAML; what is no mapping has none."""
    from ..sources import yaml_index

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, keys, docs = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = yaml_index.entries(text or "")
                except ValueError:
                    continue
                for _, name, _, doc in found:
                    ids.append(i)
                    keys.append(name)
                    docs.append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string()), pa.array(docs, pa.string())], names=["change_id", "rosdep_key", "doc"])

    return texts.select(F.col("change_id").cast("long"), "text").mapInArrow(run, "change_id long, rosdep_key string, doc string")


#: Texts that a task keeps as read, and the characters that these have at most.
KEPT, KEPT_CHARS = 256, 10_000


def documents_around(changed: DataFrame) -> DataFrame:
    """(change_id, rosdep_key, old, new) of changes (change_id, before, after: YAML, removed, added: numbers of their changed
    lines): the documents before and after of the keys that the lines fall in, of all keys where they fall in none; null
    where there is none. A change is one row. A text is read once for its keys and its lines, and for all changes that have
    it where these stand near each other."""
    from ..sources import yaml_index

    def run(batches):
        import functools
        import json

        import pyarrow as pa

        def fresh(text):
            return *yaml_index.around(text), {}

        near = functools.lru_cache(maxsize=KEPT)(fresh)

        def doc(read, name):
            nodes, _, made = read
            if name not in made:
                try:
                    made[name] = json.dumps(yaml_index.plain(nodes[name])) if name in nodes else None
                except (RecursionError, ValueError):
                    made[name] = None
            return made[name]

        for batch in batches:
            out = []
            for i, before, after, removed, added in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                old, new = (near(t) if len(t or "") <= KEPT_CHARS else fresh(t) for t in (before, after))
                touched = yaml_index.keys_at(old[1], removed) | yaml_index.keys_at(new[1], added)
                for name in touched or {**old[0], **new[0]}:
                    both = doc(old, name), doc(new, name)
                    if both != (None, None):
                        out.append((i, name, *both))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string()]
            columns = zip(*out, strict=True) if out else ([],) * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["change_id", "rosdep_key", "old", "new"])

    return changed.select(F.col("change_id").cast("long"), "before", "after", "removed", "added").mapInArrow(run, "change_id long, rosdep_key string, old string, new string")


def replaced(name: Column, os_name: Column, os_version: Column, replacements: dict[tuple[str, str], dict[str, str]]) -> Column:
    """name with the replacements of its place made in order; replacements are configuration."""
    out = name
    for (os, version), pairs in replacements.items():
        s = name
        for needle, by in pairs.items():
            s = F.replace(s, F.lit(needle), F.lit(by))
        out = F.when((os_name == os) & (os_version == version), s).otherwise(out)
    return out


def linked(url: Column, dashboards: list[tuple[str, str]]) -> Column:
    """The page of the first dashboard whose pattern matches from the start of url, with its groups filled in; else url."""
    out = url
    for pattern, page in reversed(dashboards):
        out = F.when(url.rlike(f"^(?:{pattern})"), F.regexp_replace(url, f"^(?:{pattern}).*$", page)).otherwise(out)
    return out


def either_key(probes: DataFrame, entries: DataFrame, separator: str) -> DataFrame:
    """(probe_id, found): the first entry (row_ord, name) with a probe's name, or, where both begin with python, with what
    follows the separator (`.`) or comes before it (`@`). Both keys go through one equi-join, which has a key's first entry only."""

    def keys(df: DataFrame, keep: str) -> DataFrame:
        s = F.regexp_replace(F.lower("name"), "^-+|-+$", "")
        bare = F.regexp_replace(s, r"^[^.]*\.", "") if separator == "." else F.substring_index(s, separator, 1)
        both = F.array(F.concat(F.lit("="), s), F.when(s.startswith("python"), F.concat(F.lit("~"), bare)))
        return df.select(keep, F.explode(F.array_compact(both)).alias("k"))

    first = keys(entries, "row_ord").groupBy("k").agg(F.min("row_ord").alias("row_ord"))
    return keys(probes, "probe_id").join(first.hint("merge"), "k").groupBy("probe_id").agg(F.min("row_ord").alias("found"))


def _seeds(names: DataFrame) -> DataFrame:
    """(name, s): the names that a name's spellings start from: itself and what is left of it without versions, and of that
    again, until nothing new is left."""
    out = level = names.select("name").where("name IS NOT NULL").distinct().withColumn("s", F.col("name"))
    while True:
        more = level.select("name", F.explode(variant_seeds(F.col("s"))).alias("s")).distinct()
        more = stored(more.join(out, ["name", "s"], "left_anti"))
        if more.isEmpty():
            return out
        out, level = out.unionByName(more), more


def name_variants(names: DataFrame, id_col: str) -> DataFrame:
    """(id_col, variant): the spellings that packagings of other kinds and distributions may give each name of names.

    The table of spellings by role is fixed in the code (a few hundred rows), so it is broadcast.
    """
    table = [(role, t) for role, texts in sorted(variant_templates().items()) for t in texts]
    spelt = F.broadcast(names.sparkSession.createDataFrame(table, "role string, t string"))
    seeds = _seeds(names).withColumn("base", clean_name(F.col("s")))
    by_role = seeds.where("base <> ''").select("name", "base", F.explode(roles(F.col("s"))).alias("role")).join(spelt, "role")
    plain = seeds.select("name", F.explode(plain_variants(F.col("s"), F.col("base"))).alias("variant"))
    variants = plain.union(by_role.select("name", F.replace("t", F.lit("%"), F.col("base")))).groupBy("name").agg(F.collect_set("variant").alias("vs"))
    # only an id of several names can have a spelling twice; others pass without being held
    own = names.select(id_col, "name").groupBy(id_col).agg(F.collect_set("name").alias("ns"))
    rows = own.select(id_col, (F.size("ns") > 1).alias("several"), F.explode("ns").alias("name")).join(variants, "name")
    spelt_out = lambda some: rows.where(some).select(id_col, F.explode("vs").alias("variant"))
    return spelt_out(~F.col("several")).union(spelt_out(F.col("several")).distinct())


def pip_counterparts(keys: DataFrame) -> DataFrame:
    """The six keys that may hold the pip form of a Python key, in the order in which they are tried."""
    k = F.col("rosdep_key")
    swap = lambda a, b: F.replace(k, F.lit(a), F.lit(b))
    bare = lambda p: F.when(k.startswith(p), F.substring(k, len(p) + 1, F.length(k))).otherwise(k)
    tries = [bare("python3-"), bare("python-"), swap("python3", "python"), swap("python", "python3"), F.concat(F.lit("python-"), k), F.concat(F.lit("python3-"), k)]
    rows = keys.where(k.startswith("py") & ~k.endswith("-pip"))
    return rows.select("rosdep_key", F.posexplode(F.array(*(F.concat(x, F.lit("-pip")) for x in tries))).alias("ord", "counterpart"))


def suggestions(keys: DataFrame, entries: DataFrame) -> DataFrame:
    """(key, suggestion): of the names that a key's spelling leads to, the first that entries (name) has.

    A path of digits, one a step, orders the names: a name comes before those it leads to, and these in their order. Steps
    go on until they lead to nothing new; a name that comes again counts only by a path before the one it is known by,
    which the paths of a circle never are.
    """
    k = F.col("k")
    step = lambda i, when, to: F.when(when, F.struct(to.alias("k"), F.concat("path", F.lit(str(i))).alias("path")))
    cut = lambda n: F.expr(f"substring(k, 1, length(k) - {n})")
    py, number = F.regexp_extract("k", "^python([0-9])-(.+)$", 2), F.regexp_extract("k", "^python([0-9])-", 1)
    dist = lambda s: F.concat(F.lit("python"), number, F.lit("dist("), s, F.lit(")"))
    more = F.array(
        step(1, k.endswith("-dev"), F.concat(cut(4), F.lit("-devel"))), step(2, k.startswith("lib"), F.substring("k", 4, 1 << 20)),
        step(3, k.endswith("-devel"), F.concat(F.lit("cmake("), cut(6), F.lit(")"))), step(4, k.endswith("-devel"), F.concat(F.lit("pkgconfig("), cut(6), F.lit(")"))),
        step(5, py != "", dist(py)), step(6, py.contains("-"), dist(F.translate(py, "-", "_"))),
    )
    out = level = keys.select("key", F.col("key").alias("k"), F.lit("").alias("path")).where("key IS NOT NULL").distinct()
    while True:
        found = level.select("key", F.explode(F.array_compact(more)).alias("x")).select("key", "x.k", "x.path").groupBy("key", "k").agg(F.min("path").alias("path"))
        known = out.groupBy("key", "k").agg(F.min("path").alias("best"))
        level = stored(found.join(known, ["key", "k"], "left").where("best IS NULL OR path < best").drop("best"))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.join(entries.select(F.col("name").alias("k")).distinct(), "k", "left_semi").groupBy("key").agg(F.min_by("k", "path").alias("suggestion"))


def same_release(os_name: Column, a: Column, b: Column) -> Column:
    """Whether two spellings name one release: equal, or number and codename of a release of ubuntu or debian."""
    names = F.create_map(*(F.lit(x) for kv in CODENAMES.items() for x in kv))

    def release(v: Column) -> Column:
        s = F.translate(v, "_", ".")
        return F.when(os_name.isin("ubuntu", "debian"), F.coalesce(names[s], s)).when(os_name == "opensuse", F.regexp_replace(s, r"^leap\.?", "")).when(os_name.isin("alpine", "openembedded") & (v == "unknown"), F.when(os_name == "alpine", "edge").otherwise("master")).otherwise(v)

    return (a == b) | (os_name == "arch") | (release(a) == release(b))


def repo_parts(repo: Column) -> Column:
    """name and version of an upstream repository such as ubuntu_24_04 or nix_stable_24_05."""
    nix = repo.startswith("nix_")
    rest = F.when(nix, F.regexp_replace(repo, "^nix_(?:stable_)?", "")).otherwise(F.regexp_replace(repo, "^[^_]*_?", ""))
    return F.struct(F.when(nix, "nixos").otherwise(F.substring_index(repo, "_", 1)).alias("name"), F.translate(rest, "_", ".").alias("version"))


def rule_documents(packages: DataFrame) -> DataFrame:
    """packages (rosdep_key, repo_name, repo_version, name) as rule files: one JSON object by platform and version a key.

    pypi goes under '*' as pip; a version holds its manager and the sorted names.
    """
    pypi = F.col("repo_name") == "pypi"
    # fixed values: the managers that written files name
    manager = F.when(pypi, "pip").when(F.col("repo_name") == "fedora", "dnf").when(F.col("repo_name") == "rhel", "yum").when(F.col("repo_name") == "nixos", "nix").otherwise("apt")
    rows = packages.select("rosdep_key", F.when(pypi, "*").otherwise(F.col("repo_name")).alias("platform"), F.when(pypi | (F.coalesce("repo_version", F.lit("")) == ""), "*").otherwise(F.col("repo_version")).alias("os_version"), manager.alias("m"), "name")
    lists = rows.groupBy("rosdep_key", "platform", "os_version", "m").agg(F.array_sort(F.collect_set("name")).alias("p"))
    in_order = lambda m: F.map_from_entries(F.transform(F.array_sort(F.map_keys(m)), lambda k: F.struct(k, m[k])))
    of = lambda key, value: F.map_from_entries(F.collect_list(F.struct(key, value)))
    versions = lists.groupBy("rosdep_key", "platform").agg(of("os_version", F.create_map("m", F.struct(F.col("p").alias("packages"))).alias("v")).alias("vs"))
    versions = versions.withColumn("vs", in_order(F.col("vs")))
    docs = versions.groupBy("rosdep_key").agg(of("platform", "vs").alias("d"))
    return docs.select("rosdep_key", F.to_json(in_order(F.col("d"))).alias("doc"))
