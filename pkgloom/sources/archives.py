"""File lists of package archives, read only for the packages that something asks for."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A control file, and how the names of signatures begin.
CONTROL, SIGNATURE = ".PKGINFO", ".SIGN."


def members(raw: bytes) -> list[str]:
    """The paths of the files of a gzipped tar, without folders, control file and signatures."""
    with tarfile.open(mode="r:gz", fileobj=io.BytesIO(raw)) as tar:
        return sorted({f"/{m.name.removeprefix('./')}" for m in tar if not m.isdir() and m.name != CONTROL and not m.name.startswith(SIGNATURE)})


def listed(archives: DataFrame) -> DataFrame:
    """archives (uri, ...) with files, the sorted paths in each, and error: what kept it from being read, with no files then.
    A task opens one archive after the other, by pyarrow's file systems; null addresses open nothing."""
    schema = f"{', '.join(f'`{c}` {t}' for c, t in archives.dtypes)}, files array<string>, error string"
    place = archives.columns.index("uri")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            files, errors = [], []
            for uri in batch.column(place).to_pylist():
                found, error = [], None
                try:
                    if uri is not None:
                        system, path = fs.FileSystem.from_uri(uri)
                        with system.open_input_file(path) as f:
                            found = members(f.read())
                except (OSError, EOFError, tarfile.TarError, pa.ArrowException) as e:
                    error = f"{type(e).__name__}"
                files.append(found)
                errors.append(error)
            columns = [*batch.columns, pa.array(files, pa.list_(pa.string())), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "files", "error"])

    return archives.mapInArrow(run, schema)


def hit_lists(index: DataFrame, lookups: DataFrame) -> DataFrame:
    """(name, uri, files, error) of the packages of index (name, uri) that lookups (name) ask for; no other archive is
    opened. The rows are dealt out evenly, as each costs a file."""
    hits = index.join(lookups.select("name").distinct(), "name", "left_semi").select("name", "uri")
    return listed(hits.repartition("uri"))


def write(contents: DataFrame, folder: str) -> DataFrame:
    """Writes an archive for each row of contents (name, files) into folder; (name, uri)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(folder)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for name, files in zip(names, batch.column(1).to_pylist(), strict=True):
                out = io.BytesIO()
                with tarfile.open(mode="w:gz", fileobj=out) as tar:
                    for path in [CONTROL, f"{SIGNATURE}RSA.x.pub", *files]:
                        info = tarfile.TarInfo(path.lstrip("/"))
                        if path.endswith("/"):
                            info.type = tarfile.DIRTYPE
                        tar.addfile(info)
                with system.open_output_stream(f"{top}/{name}.apk", compression=None) as f:
                    f.write(out.getvalue())
            yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string()), "uri": pa.array([f"{folder}/{n}.apk" for n in names], pa.string())})

    spark = contents.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return contents.select("name", F.coalesce("files", F.array().cast("array<string>"))).mapInArrow(run, "name string, uri string")
