"""YAML files as tables: a data source whose partitions are a few small files or a large one, and the nodes of a text with their lines.

The parser is PyYAML's, up to its graph of nodes, so tags need no constructors and keys keep their spelling (20.10 is no
number). A file is read by one task; rule and configuration files are small, and an index is many of them.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

try:
    import yaml
except ImportError:  # the queries that need it are then not registered
    yaml = None

#: Values that aliases may unfold to.
MOST_NODES = 1_000_000
#: Levels of nesting; the C parser's graph is built by recursion, which ends the process some tens of thousands deep.
MOST_DEEP = 5_000


def graph(text: str):
    """The node graph of a text's only document; None for a text without one. ValueError where it is nested too deep."""
    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    # a level is a bracket or a column, or a list in its key's column; events are read without recursion
    if text.count("[") + text.count("{") + 2 * max(map(len, text.splitlines()), default=0) > MOST_DEEP:
        deep = 0
        for event in yaml.parse(text, Loader=loader):
            deep += isinstance(event, yaml.CollectionStartEvent) - isinstance(event, yaml.CollectionEndEvent)
            if deep > MOST_DEEP:
                raise ValueError("nested too deep")
    return yaml.compose(text, Loader=loader)


def pairs(node) -> dict[str, tuple]:
    """Keys of a mapping with (line, value node); merged keys stand behind its own, and of equal ones the last counts."""
    own, merged = {}, {}
    for key, value in node.value:
        if key.tag == "tag:yaml.org,2002:merge":
            for one in value.value if isinstance(value, yaml.SequenceNode) else [value]:
                merged = pairs(one) | merged if isinstance(one, yaml.MappingNode) else merged
        else:
            name = key.value if isinstance(key, yaml.ScalarNode) else json.dumps(plain(key))
            own.pop(name, None)
            own[name] = (key.start_mark.line + 1, value)
    return {k: v for k, v in merged.items() if k not in own} | own


def plain(node, budget: list | None = None):
    """The node as text, None, lists and dicts."""
    budget = [MOST_NODES] if budget is None else budget
    budget[0] -= 1
    if budget[0] < 0:
        raise ValueError("too many values")
    if isinstance(node, yaml.MappingNode):
        return {k: plain(v, budget) for k, (_, v) in pairs(node).items()}
    if isinstance(node, yaml.SequenceNode):
        return [plain(v, budget) for v in node.value]
    return None if node.tag == "tag:yaml.org,2002:null" else node.value


def entries(text: str, split: tuple[str, ...] = ()) -> list[tuple[str, str, int, str]]:
    """(section, name, line, doc) of each key at the top of a text, of keys in split one level deeper; doc is its value as
    JSON. ValueError says why a text has none."""
    try:
        top = graph(text)
        if not isinstance(top, yaml.MappingNode):
            raise ValueError("not a mapping")
        out = []
        for name, (line, value) in pairs(top).items():
            inner = pairs(value).items() if name in split and isinstance(value, yaml.MappingNode) else None
            out += [("", name, line, json.dumps(plain(value)))] if inner is None else [(name, k, at, json.dumps(plain(v))) for k, (at, v) in inner]
        return out
    except yaml.YAMLError as e:
        at = getattr(e, "problem_mark", None)
        raise ValueError(f"{getattr(e, 'problem', None) or e}{f' in line {at.line + 1}' if at else ''}") from None
    except RecursionError:
        raise ValueError("nested too deep") from None


def walk(text: str) -> Iterator[tuple[int, int, list[str], str, str | None]]:
    """(line, ord, path, kind, value) of every key, a key before what is in it: kind is map, list or scalar, value a
    scalar's text."""
    yield from _walked(graph(text))


def _walked(top) -> Iterator[tuple[int, int, list[str], str, str | None]]:
    todo = [(line, [name], value) for name, (line, value) in reversed(pairs(top).items())] if isinstance(top, yaml.MappingNode) else []
    n = 0
    while todo and n < MOST_NODES:
        line, path, node = todo.pop()
        kind = "map" if isinstance(node, yaml.MappingNode) else "list" if isinstance(node, yaml.SequenceNode) else "scalar"
        yield line, n, path, kind, plain(node) if kind == "scalar" else None
        n += 1
        if kind == "map":
            todo += [(at, [*path, name], value) for name, (at, value) in reversed(pairs(node).items())]


def around(text: str | None) -> tuple[dict, list[tuple[int, int, str]]]:
    """Of one reading of a text its top keys with their value nodes, and (line, ord, top key) of its mappings and lists in
    the order of their lines. Both are empty for what is no mapping."""
    try:
        top = graph(text or "")
        if not isinstance(top, yaml.MappingNode):
            return {}, []
        return {name: value for name, (_, value) in pairs(top).items()}, sorted((line, n, path[0]) for line, n, path, kind, _ in _walked(top) if kind != "scalar")
    except (yaml.YAMLError, RecursionError, ValueError):
        return {}, []


def keys_at(begins: list[tuple[int, int, str]], lines: list[int] | None) -> set[str]:
    """The top keys that lines fall in: a line belongs to the last mapping or list that begins there or above (see around())."""
    at = [bisect_right(begins, line, key=lambda x: x[0]) for line in lines or []]
    return {begins[i - 1][2] for i in at if i}


# ---- the data source

_SCHEMA = "file string, load_ord int, section string, name string, line int, doc string, error string"


#: Files and bytes that a task reads; a file that is larger has a task of its own.
MOST_FILES, MOST_BYTES = 64, 1 << 20


class FilePartition(InputPartition):
    """Files (uri, load_ord) that one task reads."""

    def __init__(self, files: list[tuple[str, int]]):
        super().__init__(files[0][1])
        self.files = files


def batches(sizes: list[int]) -> Iterator[list[int]]:
    """Places of files in a row, as a task reads them, by the files' sizes."""
    held, total = [], 0
    for i, size in enumerate(sizes):
        if held and (len(held) >= MOST_FILES or total + size > MOST_BYTES):
            yield held
            held, total = [], 0
        held.append(i)
        total += size
    if held:
        yield held


class YamlReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.pattern = options.get("pattern", "*.yaml")
        self.split = tuple(s for s in options.get("split", "").split(",") if s)

    def partitions(self) -> list[FilePartition]:
        from fnmatch import fnmatch

        from pyarrow import fs

        found = []
        for path in self.paths:
            system, top = fs.FileSystem.from_uri(path)
            scheme = path[: path.index("://") + 3] if "://" in path else ""
            info = system.get_file_info(top)
            if info.type == fs.FileType.Directory:
                files = sorted((f.path, f.size) for f in system.get_file_info(fs.FileSelector(top, recursive=True)) if f.type == fs.FileType.File and fnmatch(f.base_name, self.pattern))
            else:
                files = [(top, info.size)]
            found += [(f"{scheme}{f}", size or 0) for f, size in files]
        return [FilePartition([(found[i][0], i) for i in some]) for some in batches([size for _, size in found])]

    def read(self, partition: FilePartition | None) -> Iterator[tuple]:
        from pyarrow import fs

        if partition is None:  # there are no files
            return
        for uri, load_ord in partition.files:
            system, path = fs.FileSystem.from_uri(uri)
            with system.open_input_file(path) as f:
                raw = f.read()
            try:
                for section, name, line, doc in entries(raw.decode(), self.split):
                    yield uri, load_ord, section, name, line, doc, None
            except ValueError as e:
                # what is no text is a ValueError too
                yield uri, load_ord, None, None, None, None, str(e)


class YamlSource(DataSource):
    """Keys at the top of YAML files, with the files in the order in which they are loaded. Options: path (files or folders,
    by commas, in load order; a folder's files by their paths), pattern (of a folder's file names), split (keys that are
    taken apart one level deeper). A file that can't be read as a mapping is one row with an error."""

    @classmethod
    def name(cls) -> str:
        return "yaml_index"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> YamlReader:
        return YamlReader(self.options)


def read(spark: SparkSession, paths: str | list[str], pattern: str = "*.yaml", split: tuple[str, ...] = ()) -> DataFrame:
    spark.dataSource.register(YamlSource)
    return spark.read.format("yaml_index").option("pattern", pattern).option("split", ",".join(split)).load(",".join([paths] if isinstance(paths, str) else paths))


# ---- nodes with lines


@F.udtf(returnType="line int, ord int, path array<string>, kind string, value string")
class YamlNodes:
    """walk() of a text; none for null and for what is no YAML."""

    def eval(self, text: str):
        if text is not None:
            try:
                yield from list(walk(text))
            except (yaml.YAMLError, RecursionError, ValueError):
                return


def nodes(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of docs but text, with line, ord, path, kind and value of each node of the text."""
    return docs.lateralJoin(YamlNodes(F.col(text).outer())).drop(text)


def changed_paths(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, line, path) of changed lines (doc_id, line) of docs (doc_id, text): the last mapping or list that begins at
    the line or above, by its path; lines before the first have none."""
    from .formats import at_lines

    held = nodes(docs).where("kind <> 'scalar'").select("doc_id", "line", "ord", F.to_json("path").alias("path"))
    return at_lines(held, lines).withColumn("path", F.from_json("path", "array<string>"))


def top_key(path: Column) -> Column:
    return F.get(path, F.lit(0))
