"""Repository metadata as tables: text formats read by Spark's own readers and split by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import ros_name


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of a control file (separated by blank lines), one map of fields each."""
    return block_fields(spark.read.option("lineSep", "\n\n").text(path))


def once(value: Column, use) -> Column:
    """use(value), where value is worked out once a row, however often use names it and wherever filters are moved."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def last_of_each(pairs: Column) -> Column:
    """Pairs (k, v) as a map; of equal keys the last one counts, as a map with an equal key twice would end the scan."""
    ranked = lambda ps: F.array_sort(F.transform(ps, lambda x, i: F.struct(x["k"].alias("k"), i.alias("i"), x["v"].alias("v"))))
    # sorted by key and place, a pair is its key's last where the next one has another key
    last = lambda r: F.filter(r, lambda x, i: ~F.coalesce(F.get(r, i + 1)["k"] == x["k"], F.lit(False)))
    return once(pairs, lambda ps: once(ranked(ps), lambda r: F.map_from_entries(F.transform(last(r), lambda x: F.struct(x["k"], x["v"])))))


def block_fields(text: DataFrame) -> DataFrame:
    """value (a block) as fields: map of name to value; lines that begin with white space go on with the field above, and of
    a field that comes twice the last one counts."""
    lines = F.split(F.regexp_replace("value", r"\n[ \t]+", "\u0001"), "\n")
    lines = F.filter(lines, lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.substring_index(x, ":", 1).alias("k"), F.translate(F.trim(F.regexp_replace(x, "^[^:]*:", "")), "\u0001", "\n").alias("v")))
    # a block has fields where a line has a colon, which is asked of the text, so that the fields are made once
    return text.where(F.contains("value", F.lit(":"))).withColumn("fields", last_of_each(pairs))


def debian_packages(blocks: DataFrame) -> DataFrame:
    f = F.col("fields")
    return blocks.select(f["Package"].alias("name"), f["Version"].alias("version"), F.coalesce(f["Source"], f["Package"]).alias("source_name"), f["Package"].alias("binary_name"), F.translate(f["Description"], "\n", " ").alias("description"))


def ros_packages(blocks: DataFrame) -> DataFrame:
    """debian_packages() of the index of a robotics distribution, whose packages are named after it: only those, with key, the
    name without the distribution, under which rules know them."""
    p = debian_packages(blocks).where("startswith(name, 'ros-')")
    return p.withColumn("key", ros_name(F.col("name")))


def contents(lines: DataFrame) -> DataFrame:
    """Lines `path packages` of a contents index as (package, path), each once."""
    path, names = F.regexp_extract("value", r"^(.*\S)\s+(\S+)$", 1), F.regexp_extract("value", r"^(.*\S)\s+(\S+)$", 2)
    rows = lines.select(F.concat(F.lit("/"), path).alias("path"), F.explode(F.split(names, ",")).alias("p")).where(path != "")
    return rows.select(F.substring_index(F.regexp_replace("p", ":[^:/]*$", ""), "/", -1).alias("package"), "path").distinct()


def dependency(token: Column) -> Column:
    """type:name=version, each part but the name optional."""
    pattern = "^(?:([^:]*):)?([^=]*)(?:=(.*))?$"
    part = lambda i: F.nullif(F.regexp_extract(token, pattern, i), F.lit(""))
    return F.struct(part(1).alias("type"), part(2).alias("name"), part(3).alias("version"))


def codec(url: Column, encoding: Column) -> Column:
    path = F.regexp_replace(url, r"[?#].*$", "")
    return F.when(path.endswith(".gz") | (encoding == "gzip"), "gzip").when(path.endswith(".xz"), "lzma").when(path.rlike(r"\.(zst|zck)$"), "zstd").when(path.endswith(".br") | (encoding == "br"), "brotli").otherwise("plain")


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'))


def portage_packages(pages: DataFrame) -> DataFrame:
    """Listings of categories (category, html) as packages, each once: the relative links to folders whose name may be a
    package's. A listing has no versions."""
    rows = pages.select("category", F.explode(links(F.col("html"))).alias("h")).where(~F.col("h").isin("../", "./") & ~F.col("h").startswith("/") & F.col("h").endswith("/"))
    rows = rows.select("category", F.expr("substring(h, 1, length(h) - 1)").alias("name")).where(F.col("name").rlike("^[a-z0-9][a-z0-9+._-]*$")).distinct()
    return rows.select("name", F.lit("unknown").alias("version"), F.concat_ws("/", "category", "name").alias("source_name"), F.col("name").alias("binary_name"), F.lit(None).cast("string").alias("description"))


def evr(epoch: Column, version: Column, release: Column) -> Column:
    """[epoch:]version[-release], without an epoch of 0."""
    return F.concat(F.when(F.coalesce(epoch, F.lit("0")) != "0", F.concat(epoch, F.lit(":"))).otherwise(""), version, F.when(F.coalesce(release, F.lit("")) != "", F.concat(F.lit("-"), release)).otherwise(""))


#: Elements of a primary.xml and a filelists.xml, as far as they are read.
PRIMARY = """_type string, name string, version struct<_epoch: string, _ver: string, _rel: string>, summary string, format struct<
`rpm:sourcerpm`: string, `rpm:provides`: struct<`rpm:entry`: array<struct<_name: string, _flags: string, _epoch: string, _ver: string, _rel: string>>>>"""
FILELISTS = "_name string, file array<struct<_type: string, _VALUE: string>>"
REPOMD = "data array<struct<_type: string, location: struct<_href: string>>>"


def expand_tokens(url: Column, os_name: Column, code_name: Column, arch: Column) -> Column:
    """The URL of a repository with its three placeholders filled in."""
    for token, by in (("$basearch", arch), ("$distname", os_name), ("$releasever", code_name)):
        url = F.replace(url, F.lit(token), by)
    return url


def repomd_href(xml: Column, kind: str) -> Column:
    """Where a repomd.xml says that its first metadata file of a kind (primary, filelists) is; null where it names none."""
    data = F.from_xml(xml, REPOMD)["data"]
    return F.get(F.filter(data, lambda d: (d["_type"] == kind) & d["location"]["_href"].isNotNull()), F.lit(0))["location"]["_href"]


def rpm_packages(spark: SparkSession, path: str) -> DataFrame:
    return rpm_rows(spark.read.option("rowTag", "package").schema(PRIMARY).xml(path))


def _with_provides(own: Column, provided: Column) -> Column:
    """The row of a package before those of what it provides, which may be null."""
    return F.concat(F.array(own), F.coalesce(provided, F.slice(F.array(own), 1, 0)))


def rpm_rows(packages: DataFrame) -> DataFrame:
    """Package elements (PRIMARY) as rows: one for each binary package and one for everything that it provides, whose
    version is known only where it is stated to be equal. Other types of elements are left out."""
    v = evr(F.col("version._epoch"), F.col("version._ver"), F.col("version._rel"))
    source = F.regexp_replace("format.`rpm:sourcerpm`", r"-[^-]*-[^-]*$", "")
    stated = lambda p: F.when(p["_flags"] == "EQ", evr(p["_epoch"], p["_ver"], p["_rel"]))
    given = F.transform("format.`rpm:provides`.`rpm:entry`", lambda p: F.struct(stated(p).alias("version"), p["_name"].alias("binary_name")))
    # the package and what it provides are rows of one pass, so that an element is parsed once
    every = _with_provides(F.struct(v.alias("version"), F.col("name").alias("binary_name")), given)
    rows = packages.select("name", source.alias("source_name"), F.col("summary").alias("description"), F.explode(F.when(F.col("_type") == "rpm", every)).alias("x"))
    return rows.select("name", "x.version", "source_name", "x.binary_name", "description")


def rpm_files(spark: SparkSession, path: str) -> DataFrame:
    return file_rows(spark.read.option("rowTag", "package").schema(FILELISTS).xml(path))


def file_rows(packages: DataFrame) -> DataFrame:
    """Package elements (FILELISTS) as (package, path), each once; folders are left out."""
    f = packages.select(F.col("_name").alias("package"), F.explode("file").alias("f")).where("lower(coalesce(f._type, '')) <> 'dir'")
    return f.select("package", F.trim("f._VALUE").alias("path")).where("package <> '' AND path <> '' AND NOT endswith(path, '/')").distinct()


def attributes(spark: SparkSession, path: str) -> DataFrame:
    return attribute_rows(spark.read.option("wholetext", True).text(path))


def attribute_rows(doc: DataFrame) -> DataFrame:
    """value (a packages.json: attribute to record, under `packages` or at the top) as packages."""
    record = "struct<pname:string,version:string,meta:struct<description:string>>"
    doc = doc.select(F.coalesce(F.from_json("value", f"struct<packages:map<string,{record}>>")["packages"], F.from_json("value", f"map<string,{record}>")).alias("m"))
    return doc.select(F.explode("m").alias("name", "r")).where("r IS NOT NULL").select("name", "r.version", F.col("r.pname").alias("source_name"), F.col("name").alias("binary_name"), F.col("r.meta.description").alias("description"))


def apk_packages(blocks: DataFrame) -> DataFrame:
    """fields of index blocks as packages: one row for each, and one for every plain name that it provides."""
    f = F.col("fields")
    plain = F.filter(F.split(f["p"], " "), lambda d: (d != "") & ~d.contains(":"))
    every = _with_provides(f["P"], F.transform(plain, lambda d: dependency(d)["name"]))
    return blocks.select(F.explode(every).alias("name"), f["V"].alias("version"), F.coalesce(f["o"], f["P"]).alias("source_name"), f["P"].alias("binary_name"), f["T"].alias("description"))


def sections(text: DataFrame) -> DataFrame:
    """value (%KEY% lines, each followed by its values) as fields: map of key to its list of values, of a key that comes twice the last."""
    lines = F.filter(F.split(F.regexp_replace("value", r"(?m)^%([A-Z0-9]+)%$", "\u0001$1"), "\u0001"), lambda x: x.rlike("^[A-Z0-9]+\n"))
    pairs = F.transform(lines, lambda x: F.struct(F.substring_index(x, "\n", 1).alias("k"), F.filter(F.slice(F.split(x, "\n"), 2, 1 << 30), lambda v: v != "").alias("v")))
    return text.withColumn("fields", last_of_each(pairs))


def pacman_packages(sections: DataFrame) -> DataFrame:
    """One row for each package and one for each of its provides, taken as they are written."""
    f = F.col("fields")
    name = f["NAME"][0]
    return sections.select(F.explode(_with_provides(name, f["PROVIDES"])).alias("name"), f["VERSION"][0].alias("version"), F.coalesce(f["BASE"][0], name).alias("source_name"), name.alias("binary_name"), F.array_join(f["DESC"], " ").alias("description"))


def pacman_files(described: DataFrame, listed: DataFrame) -> DataFrame:
    """(package, path) of the two files of each package folder (pkgdir, fields), each once; folders are left out."""
    named = F.filter(F.slice(F.col("fields")["NAME"], 1, 1), lambda n: n.isNotNull())
    names = described.select("pkgdir", F.explode(named).alias("package"))
    paths = listed.select("pkgdir", F.explode(F.col("fields")["FILES"]).alias("path")).where("path <> '' AND NOT endswith(path, '/')")
    return names.join(paths, "pkgdir").select("package", "path").distinct()


def recipe_packages(layers: DataFrame, layer_branches: DataFrame, recipes: DataFrame) -> DataFrame:
    """Recipes of a layer index as packages `recipe@layer`, one row for each and one for everything that it provides.

    layers (id, name), layer_branches (id, layer) of one branch, recipes (id, layerbranch, pn, pv, summary, provides).
    """
    of_branch = layer_branches.join(layers.withColumnRenamed("id", "layer"), "layer").select(F.col("id").alias("layerbranch"), F.col("name").alias("layer_name"))
    r = recipes.where("id IS NOT NULL AND pn <> ''").join(of_branch, "layerbranch").withColumn("own", F.concat_ws("@", "pn", "layer_name"))
    base = r.select(F.col("own").alias("name"), F.col("pv").alias("version"), F.col("own").alias("source_name"), F.col("own").alias("binary_name"), F.col("summary").alias("description"))
    given = r.withColumn("p", F.explode(F.split("provides", r"\s+"))).where("p <> ''").withColumn("given", F.concat_ws("@", "p", "layer_name"))
    return base.unionByName(given.select(F.col("given").alias("name"), F.col("pv").alias("version"), F.col("own").alias("source_name"), F.col("given").alias("binary_name"), F.col("summary").alias("description")))


#: How CSV files are written: quotes within quoted fields are doubled, and fields may hold line breaks.
CSV = {"quote": '"', "escape": '"'}


def csv_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.options(header=True, multiLine=True, **CSV).schema(schema).csv(path)


def listed_entries(text: Column) -> Column:
    """How many entries the lists at the top level of a JSON object have; 0 for texts that aren't one."""
    fields = F.try_variant_get(F.try_parse_json(text), "$", "map<string, variant>")
    lists = F.transform(F.map_values(fields), lambda v: F.coalesce(F.size(F.try_variant_get(v, "$", "array<variant>")), F.lit(0)))
    return F.coalesce(F.aggregate(lists, F.lit(0), lambda n, k: n + F.greatest(k, F.lit(0))), F.lit(0))


def table_cells(line: Column) -> Column:
    """The cells of a line of a Markdown table, trimmed and without empty ones; null for rules and other lines."""
    cells = F.filter(F.transform(F.split(line, r"\|"), lambda c: F.trim(c)), lambda c: c != "")
    return F.when(F.trim(line).startswith("|") & ~F.trim(line).rlike(r"^[|\s:-]+$"), cells)


def changed_lines(diffs: DataFrame) -> DataFrame:
    """(diff_id, path, side, lines) of unified diffs (diff_id, value): sorted numbers of added lines in the new file and of
    removed lines in the old one; files that the diff deletes are left out. Hunks are numbered apart, so a long diff is
    many small groups."""
    hunk = r"^@@ -([0-9]+)(?:,[0-9]+)? \+([0-9]+)(?:,[0-9]+)? @@"
    files = diffs.select("diff_id", F.explode(F.filter(F.split("value", r"(?m)^(?=--- )"), lambda x: x.startswith("--- "))).alias("f"))
    files = files.withColumn("path", F.regexp_extract("f", r"(?m)^\+\+\+ ([^\t\n]+)", 1)).where("path <> '/dev/null'").withColumn("path", F.regexp_replace("path", "^[ab]/", ""))
    hunks = files.select("diff_id", "path", F.explode(F.filter(F.split("f", r"(?m)^(?=@@ -)"), lambda x: x.startswith("@@ -"))).alias("h"))
    hunks = hunks.select("diff_id", "path", *(F.regexp_extract("h", hunk, i).cast("int").alias(s) for i, s in ((1, "old"), (2, "new"))), F.slice(F.split("h", "\n"), 2, 1 << 30).alias("body"))

    def numbered(first: str, own: str) -> Column:
        # the k-th line that this side has stands at first + k - 1
        side = F.filter("body", lambda x: x.startswith(" ") | x.startswith(own))
        return F.filter(F.transform(side, lambda x, i: F.when(x.startswith(own), i + F.col(first))), lambda n: n.isNotNull())

    rows = hunks.select("diff_id", "path", F.explode(F.array(F.struct(F.lit("added").alias("side"), numbered("new", "+").alias("n")), F.struct(F.lit("removed").alias("side"), numbered("old", "-").alias("n")))).alias("x"))
    return rows.select("diff_id", "path", "x.side", F.explode("x.n").alias("n")).groupBy("diff_id", "path", "side").agg(F.array_sort(F.collect_set("n")).alias("lines"))


def at_lines(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, line, path) of lines (doc_id, line): the last of the document's nodes (doc_id, line, ord, path) that stands
    there or before. In a document nodes stand in the order of their lines, so a path carries its ancestors. Lines
    before the first node are left out."""
    every = nodes.select("doc_id", "line", "ord", "path", F.lit(0).alias("asked")).unionByName(lines.distinct().select("doc_id", "line", F.lit(None).cast("int").alias("ord"), F.lit(None).cast("string").alias("path"), F.lit(1).alias("asked")))
    upto = Window.partitionBy("doc_id").orderBy("line", "asked", "ord")
    return every.withColumn("path", F.last("path", ignorenulls=True).over(upto)).where("asked = 1 AND path IS NOT NULL").select("doc_id", "line", "path")
