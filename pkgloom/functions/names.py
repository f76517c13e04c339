"""Package names as Columns: every rule is one or a few regular expressions, so that it stays inside generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: prefixes and suffixes of package names, and the role that each stands for
PREFIX_ROLES = {
    "python3-": "py3", "python2-": "py2", "python-": "py", "py3-": "py3", "py2-": "py2", "py-": "py", "rubygem-": "ruby", "ruby-": "ruby",
    "nodejs-": "node", "node-": "node", "golang-": "go", "librust-": "rust", "rust-": "rust", "haskell-": "haskell", "perl-": "perl", "php-": "php",
    "lua-": "lua", "erlang-": "erlang", "elixir-": "elixir", "java-": "java", "octave-": "octave", "r-": "r", "ros-": "ros", "texlive-": "tex",
    "lib": "lib-prefix", "compat-": "compat",
}
SUFFIX_ROLES = {
    "-dev": "dev", "-devel": "dev", "-development": "dev", "-headers": "dev-helper", "-static": "dev-helper", "-api": "dev-helper", "-proto": "dev-helper",
    "-debuginfo": "debug", "-debug": "debug", "-dbg": "debug", "-dbgsym": "debug", "-debugsource": "debug-source",
    "-doc": "doc", "-docs": "doc", "-documentation": "doc", "-man": "doc", "-manual": "doc", "-info": "doc",
    "-examples": "examples", "-example": "examples", "-samples": "examples", "-demo": "examples", "-demos": "examples",
    "-data": "data", "-assets": "data", "-resources": "data", "-fonts": "data", "-themes": "data", "-icons": "data", "-media": "data",
    "-test": "test", "-tests": "test", "-testing": "test", "-qa": "test",
    "-locale": "locale", "-locales": "locale", "-translations": "lang", "-lang": "lang", "-i18n": "lang",
    "-common": "common", "-core": "core", "-base": "base", "-runtime": "runtime", "-libs": "runtime-lib", "-lib": "runtime-lib", "-headless": "headless",
    "-bin": "bin", "-cli": "cli", "-gui": "gui", "-utils": "tools", "-util": "tools", "-tools": "tools",
    "-server": "server", "-client": "client", "-daemon": "daemon", "-service": "service", "-agent": "agent",
    "-plugins": "plugins", "-plugin": "plugins", "-addon": "addons", "-addons": "addons", "-extra": "addons", "-extras": "addons", "-contrib": "addons",
    "-extension": "extensions", "-extensions": "extensions", "-module": "modules", "-modules": "modules",
    "-cpp": "cpp", "-java": "java", "-perl": "perl", "-ocaml": "ocaml", "-xml": "xml", "-src": "source", "-source": "source",
    "-full": "application", "-compat": "compat", "-private": "private",
}
VERSIONED_ROLES = {
    r"python3[0-9]+-": "py3x", r"python2[0-9]+-": "py2x", r"ruby[0-9]+-": "ruby", r"node[0-9]+-": "node", r"php[0-9]+-": "php",
    r"python3[0-9]+packages\.": "py3x", r"python3packages\.": "py3", r"python2[0-9]+packages\.": "py2x", r"python2packages\.": "py2", r"pythonpackages\.": "py",
    r"ruby[0-9]*packages\.": "ruby", r"node[0-9]*packages\.": "node", r"php[0-9]*packages\.": "php", r"perl[0-9]*packages\.": "perl",
    r"\$\{?python-pn\}?-": "py3", r"\$\{?python2-pn\}?-": "py2", r"\$\{?pvn\}?-": "pvn",
    r"python%\{?python3-pkgversion\}?": "py3", r"python%\{?python2-pkgversion\}?": "py2", r"python%\{?python-pkgversion\}?": "py", r"python3%\{?python3-pkgversion\}?": "py3",
}
#: lib is part of these names.
LIB_NAMES = ("libreoffice", "librewolf", "librecad", "libtool")
#: Roles that may stand for each other.
RELATED = (
    ("dev", "application", "runtime", "runtime-lib"), ("compat", "application"), ("plugins", "modules", "addons", "extensions"),
    ("server", "client", "daemon", "service", "agent"), ("doc", "examples"), ("lang", "locale"), ("debug", "debug-source"), ("py", "py3", "application", "py3x"),
)

_LIB = "lib(?!" + "|".join(x[3:] for x in LIB_NAMES) + ")"
_by_length = sorted((p for p in PREFIX_ROLES if p != "lib"), key=len, reverse=True)
_HEAD = "|".join([*VERSIONED_ROLES, *map(re.escape, _by_length)]).replace("\\-", "-")
_TAIL = "|".join(x.lstrip("-") for x in SUFFIX_ROLES)


def plain_name(name: Column) -> Column:
    """Lower case, underscores as dashes."""
    return F.translate(F.lower(name), "_", "-")


def special_name(name: Column) -> Column:
    """The bare name: no quotes, layer (@), category (/), wildcard or :version."""
    s = F.regexp_replace(F.lower(name), r"^'(.*)'$", "$1")
    s = F.substring_index(F.substring_index(s, "@", 1), "/", -1)
    return F.substring_index(F.replace(s, F.lit("*"), F.lit("")), ":", 1)


def clean_name(name: Column, version: bool = False, symbols: bool = False, subversion: bool = False, special: bool = True) -> Column:
    """The base name: known suffixes and prefixes stripped until none is left; version and others remove those as well."""
    s = plain_name(special_name(name) if special else name)
    s = F.regexp_replace(s, f"(?:-(?:{_TAIL}))+$", "")
    s = F.regexp_replace(s, f"^(?:{_HEAD}|{_LIB})+", "")
    if version:
        s = F.regexp_replace(F.regexp_replace(s, r"[0-9]+(\.[0-9]+)+", ""), "[0-9]+", "")
    if subversion:
        s = F.regexp_replace(s, r"([0-9]+)(\.[0-9]+)+", "$1")
    if symbols:
        s = F.regexp_replace(s, "[^a-z0-9]", "")
    return F.regexp_replace(F.regexp_replace(s, "^-+|-+$", ""), "-{2,}", "-")


def roles(name: Column) -> Column:
    """The sorted roles that a name's affixes stand for; application where there are none."""
    s = plain_name(name)
    head = F.regexp_extract(s, f"^((?:{_HEAD}|lib)*)", 1)
    rest = F.substring(s, F.length(head) + 1, F.length(s))
    tail = F.regexp_extract(rest, f"((?:-(?:{_TAIL}))+)$", 1)
    fixed = F.create_map(*(F.lit(x) for kv in [*PREFIX_ROLES.items(), *SUFFIX_ROLES.items()] for x in kv))

    def of_head(x: Column) -> Column:
        out = fixed[x]
        for pattern, role in reversed(VERSIONED_ROLES.items()):
            out = F.when(x.rlike(f"^{pattern}$"), role).otherwise(out)
        return out

    found = F.concat(
        F.transform(F.regexp_extract_all(head, F.lit(f"({_HEAD}|lib)")), of_head),
        F.transform(F.regexp_extract_all(tail, F.lit(f"(-(?:{_TAIL})(?=-|$))")), lambda x: fixed[x]),
        F.when(s.contains("-plugin-"), F.array(F.lit("plugins"))).otherwise(F.array().cast("array<string>")),
        F.when(s.rlike(r"^lib[a-z0-9][a-z0-9+\-.]*[0-9]+([.\-][0-9]+)*$"), F.array(F.lit("runtime-lib"))).otherwise(F.array().cast("array<string>")),
    )
    found = F.when(s.rlike(f"^{_LIB}"), F.concat(F.array_remove(found, "lib-prefix"), F.array(F.lit("runtime-lib")))).otherwise(found)
    found = F.array_sort(F.array_distinct(found))
    return F.when(F.size(found) == 0, F.array(F.lit("application"))).otherwise(found)


def variant_templates() -> dict[str, list[str]]:
    """For each role the spellings (% is the base name) of all groups of roles that it is in, or of itself alone."""
    heads = [*PREFIX_ROLES.items(), ("python3Packages.", "py3")]
    out = {}
    for role in {*PREFIX_ROLES.values(), *SUFFIX_ROLES.values(), *VERSIONED_ROLES.values(), "application", "runtime-lib", "plugins"}:
        found = set()
        for group in [g for g in RELATED if role in g] or [(role,)]:
            before, after = ["", *(p for p, r in heads if r in group)], ["", *(p for p, r in SUFFIX_ROLES.items() if r in group)]
            found |= {f"{b}%{a}" for b in before for a in after if not b or b.strip("-") != a.strip("-")}
        out[role] = sorted(found)
    return out


def variant_seeds(name: Column) -> Column:
    """The names whose variants are a name's: itself, and its base name without versions and symbols."""
    base, short, bare = clean_name(name), clean_name(name, subversion=True), clean_name(name, version=True, symbols=True)
    return F.array_distinct(F.array_compact(F.array(name, F.when((short != name) & (short != base), short), F.when(bare != base, bare))))


def plain_variants(name: Column, base: Column) -> Column:
    """The spellings of a name that don't depend on its roles."""
    number, py = F.regexp_extract(name, "^python([0-9])-(.*)", 1), F.regexp_extract(name, "^python([0-9])-(.*)", 2)
    dist = [F.when(number != "", F.concat(F.lit("python"), number, F.lit("dist("), s, F.lit(")"))) for s in (py, F.translate(py, "-", "_"), F.translate(py, "_", "-"))]
    full = F.when(base == "", name).otherwise(base)
    return F.array_distinct(F.array_compact(F.array(name, F.translate(name, "_", "-"), F.translate(name, "-", "_"), base, F.concat(F.lit("cmake("), full, F.lit(")")), F.concat(F.lit("pkgconfig("), full, F.lit(")")), *dist)))


def change_log_name(name: Column) -> Column:
    """The form in which names before and after a change are compared."""
    s = F.lower(name)
    # most names have none of these; a pattern is looked for where its mark is
    inner = s
    for pattern in (r"^cmake\((.*)\)$", r"^pkgconfig\((.*)\)$", r"^python[0-9.]*dist\((.*)\)$"):
        inner = F.regexp_replace(inner, pattern, "$1")
    s = F.when(F.contains(s, F.lit("(")), inner).otherwise(s)
    s = F.regexp_replace(s, r"^(?:python[0-9]*-)?(?:lib)?", "")
    s = F.when(F.contains(s, F.lit("-dev")), F.regexp_replace(F.regexp_replace(s, "-devel$", ""), "-dev$", "")).otherwise(s)
    return F.replace(s, F.lit("-"), F.lit("_"))


def platform_name(name: Column, platform: Column) -> Column:
    """The form in which packages of one platform are compared."""
    s = F.regexp_replace(special_name(name), "^python3[0-9]+", "python3")
    return F.when(platform == "nixos", F.substring_index(s, ".", -1)).otherwise(s)


def main_type(kind: Column) -> Column:
    return F.regexp_replace(kind, r"^([A-Z]\.[0-9]+)[a-z]$", "$1")


def repo_key(repo: Column, version: Column) -> Column:
    return F.when(repo.isin("pypi", "gentoo", "arch") | (F.coalesce(version, F.lit("")) == ""), repo).otherwise(F.concat_ws("_", repo, version))


def lookup_key(name: Column) -> Column:
    """What two names must share to be the same package of one repository."""
    return F.regexp_replace(F.lower(name), "^-+|-+$", "")


def ros_name(name: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(name, "^ros-[^-]*-(.*)$", 1), F.lit("")), name)


def version_key(version: Column) -> Column:
    """A key in whose order versions stand naturally: runs of digits compare as numbers. Sorts and aggregates take it."""
    parts = F.regexp_extract_all(version, F.lit(r"([0-9]+|[^0-9]+)"))
    return F.transform(parts, lambda p: F.struct(F.coalesce(p.try_cast("decimal(38,0)"), F.lit(-1).cast("decimal(38,0)")).alias("n"), p.alias("s")))


def base_name(name: Column) -> Column:
    """A file's name without the version or platform that shared objects, Python extensions and jars carry."""
    # fixed values: where the names carry them
    numbered, versioned = r"^(.+?\.so)(?:\.[0-9]+)+$", r"^(lib.+?)-[0-9][0-9.]*\.so$"
    extension, jar = r"(?i)^(.+?)\.(?:cpython-[0-9]+[a-z]*|abi3|pypy[0-9]+)(?:-[^.]+)*\.so$", r"(?i)^(.+?)-[0-9][\w.\-+]*\.jar$"
    s = F.regexp_replace(name, numbered, "$1")
    return (
        F.when(s.rlike(versioned), F.lower(F.regexp_replace(s, versioned, "$1.so")))
        .when(s.rlike(extension), F.regexp_replace(s, extension, "$1.so"))
        .when(s.rlike(jar), F.regexp_replace(s, jar, "$1.jar")).otherwise(s)
    )


# fixed values: marks of a package's evolution, in the order in which they are taken out
EVOLUTION = ("t64", "0git", "1git", "2git", "rc", "alpha", "beta")


def bare_name(name: Column) -> Column:
    """Lower case, without quotes, layer (@) and category (/)."""
    return F.substring_index(F.substring_index(F.regexp_replace(F.lower(name), r"^'(.*)'$", "$1"), "@", 1), "/", -1)


def without_affixes(name: Column) -> Column:
    """The base name with its versions and symbols; layers and categories are taken as part of it."""
    return clean_name(name, special=False)


def without_evolution(name: Column) -> Column:
    """The base name without versions and marks of its evolution."""
    s = F.lower(name)
    for mark in (*EVOLUTION, "-*"):
        s = F.replace(s, F.lit(mark), F.lit(""))
    return F.replace(clean_name(s, version=True, special=False), F.lit("-*"), F.lit(""))


def upstream_platform(platform: Column, number: Column, code_name: Column) -> Column:
    """A platform as an upstream catalogue names it; number is the version that stands for the code name."""
    v = F.translate(F.coalesce(number, code_name, F.lit("")), ".", "_")
    stem = F.when(platform == "nixos", F.when(code_name == "unstable", "nix_unstable").otherwise("nix_stable")).otherwise(platform)
    bare = platform.isin("pypi", "arch", "gentoo") | (stem == "nix_unstable") | (v == "")
    return F.when(bare, stem).otherwise(F.concat_ws("_", stem, v))


def key_parts(repo_key: Column) -> Column:
    """os and version of a repository's key: its first two parts in lower case."""
    parts = F.split(F.lower(repo_key), "_")
    return F.struct(parts[0].alias("os"), F.get(parts, F.lit(1)).alias("version"))


def split_key(repo_key: Column) -> Column:
    """platform and version of a repository's key that has one _; others are all platform."""
    parts = F.split(repo_key, "_")
    two = F.size(parts) == 2
    return F.struct(F.when(two, parts[0]).otherwise(repo_key).alias("platform"), F.when(two, F.get(parts, F.lit(1))).otherwise("").alias("version"))


def is_debug(name: Column) -> Column:
    """Whether a package holds what another leaves behind for debuggers."""
    return name.endswith("-debuginfo") | name.endswith("-debugsource")


def pip_name(name: Column) -> Column:
    """What a system's package is likely to be called among Python packages."""
    return F.translate(F.regexp_replace(F.regexp_replace(name, "^python3?-", ""), "-dev$", ""), "-", "_")


def short_list(names: Column) -> Column:
    """Sorted names for a table's cell: all of up to three, else the first two and their number."""
    s, n = F.array_sort(names), F.size(names)
    some = F.concat(F.lit("`"), F.array_join(F.slice(s, 1, 2), ", "), F.lit(", ...` ("), n.cast("string"), F.lit(")"))
    return F.when(names.isNull() | (n == 0), "None").when(n <= 3, F.concat(F.lit("`"), F.array_join(s, ", "), F.lit("`"))).otherwise(some)


def match_status(result: Column, found: Column, total: Column) -> Column:
    """The result of a comparison, found of total names, as reports write it."""
    # fixed values: the wording of reports
    word = F.when(result == "exact_match", "✅ Exact match").when(result == "partial_match", "⚠️ Partial match").otherwise("❌ No match")
    return F.concat(word, F.lit(" ("), found.cast("string"), F.lit("/"), total.cast("string"), F.lit(")"))


def tool_key(display: Column) -> Column:
    """The key of a tool that a report displays; null for others."""
    # fixed values: the tools' names and keys
    known = {"PackageDistributionDetector": "detector_w07", "RepologyMapper": "mapper", "RosdepCIMapper": "rosdep_ci"}
    preset = F.trim(F.regexp_extract(display, r"\(([^)]+)\)", 1))
    out = F.when(display.contains("LLMDetector") & (preset != ""), F.concat(F.lit("llm_"), F.translate(preset, "-", "_")))
    for word, key in reversed(known.items()):
        out = F.when(display.contains(word), key).otherwise(out)
    return out
