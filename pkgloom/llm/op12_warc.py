"""WARC archives with a two-level capture index.

Tasks write a gzipped record for each page into archive files in the shared folder, and give where it stands. Captures are
sorted by a key, the URL with its host reversed, and the page; each range of the sort becomes an index shard: compressed blocks of BLOCK
captures, then the shard's directory, sparse, with the first key of every block. The shards' own bounds are the top level.
A lookup searches the bounds, the directory and the block by bisection, each read by its range, and then reads the record's
range of the archive; records that stand near each other are read as one.

Files are written and read by ranges through pyarrow's file systems (local, HDFS, S3, GCS), by the address of the shared
folder. A task that is run again writes a file of another name, so only files that a finished task named are ever read.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import uuid
from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, join_skewed, remove, shared_uri, stored, table

#: Payloads of fewer bytes are written again each time.
LEAST_PAYLOAD = 100
#: A new archive file begins after so many bytes.
FILE_BYTES = 1 << 30
#: Captures in a block, and about in a shard; with more than SHARDS shards these are larger.
BLOCK, SHARD, SHARDS = 3_000, 20_000, 4_096
#: Longer keys end in a digest, so the bounds of all shards are SHARDS times this at most.
KEY_CHARS = 400
#: Records with so many bytes between them are read as one, up to so many bytes; bytes of a task's records, about.
GAP, READ, FETCH = 1 << 16, 1 << 22, 1 << 23
#: Blocks that a task of lookups keeps.
CACHE = 4
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1

_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:(?://)?")
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_ID = re.compile(r"<urn:page:(-?\d+|none)>")


def printable(url: str) -> str:
    """url without white space and control characters, which a header or a line of the index can't hold."""
    return _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)


def url_key(url: str | None) -> str:
    """The key that a URL is sorted by: reversed host, port, path and query, without scheme, user and fragment.

    Null is the empty key. A key of more than KEY_CHARS characters is cut and ends in its digest.
    """
    if not url:
        return ""
    rest = printable(url).partition("#")[0]
    rest = _SCHEME.sub("", rest, count=1) if _SCHEME.match(rest) and "://" in rest else rest
    place = re.match(r"[^/?]*", rest)[0]
    host, colon, port = place.rpartition("@")[2].partition(":")
    key = f"{','.join(reversed(host.lower().split('.')))}{colon}{port}){rest[len(place) :] or '/'}"
    return key if len(key) <= KEY_CHARS else f"{key[: KEY_CHARS - 65]}#{hashlib.sha256(key.encode()).hexdigest()}"


# ---- records


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC record; a revisit has the response's headers without its body."""
    name = lambda i: f"<urn:page:{'none' if i is None else i}>"
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {printable(url)}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    else:
        body += payload
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def read_record(raw: bytes) -> dict:
    """What a record holds; the size and digest of a response are those of its payload, which must be as its header says."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    head = dict(x.split(": ", 1) for x in top.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(head["Content-Length"])].partition(b"\r\n\r\n")
    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    number = lambda x: None if (i := _ID.fullmatch(x)[1]) == "none" else int(i)
    out = {"page_id": number(head["WARC-Record-ID"]), "url": head.get("WARC-Target-URI"), "record_type": head["WARC-Type"], "payload_bytes": size, "payload_digest": digest, "refers_to": None, "payload": None}
    if head["WARC-Type"] == "revisit":
        return out | {"refers_to": number(head["WARC-Refers-To"])}
    if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"the record of page {out['page_id']} is damaged")
    return out | {"payload": payload}


def _files(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


_ENTRY = pa.schema([("key", pa.string()), ("pid", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("size", pa.int64())])
_ENTRY_DDL = "key string, pid long, file string, offset long, size long"


def write_archives(spark: SparkSession, pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) as archives into folder and gives each record's place: key, pid, file, offset, size (stored).

    Of pages with equal payloads of LEAST_PAYLOAD bytes or more, that with the smallest page_id is a response and others
    revisit it. Null html is an empty payload, a null url has no target. Pages without a page_id revisit one that has an id;
    where none has, each is a response. Rows that repeat page_id and payload are records of one kind. pid is page_id, or the
    least long where it is null. An empty table writes no file; other columns are not read.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    copies = rows.where(F.octet_length("html") >= LEAST_PAYLOAD).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("uses")).where("uses > 1")
    copies = stored(spark, copies)
    rows = join_skewed(rows, copies, "digest", F.struct("page_id", "url"), pages.count()).drop("uses")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _files(folder)
        part, out, name, at = TaskContext.get().partitionId(), None, "", 0
        try:
            for batch in batches:
                found = {f: [] for f in _ENTRY.names}
                for page_id, url, html, digest, first in zip(*(batch.column(i) for i in range(5)), strict=True):
                    page_id, url, first = page_id.as_py(), url.as_py(), first.as_py()
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"pages-{part:05d}-{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{top}/{name}", compression=None)
                    kind = "response" if first is None or first == page_id else "revisit"
                    raw = gzip.compress(record(kind, page_id, url, html.as_buffer().to_pybytes(), digest.as_py(), first), 6, mtime=0)
                    out.write(raw)
                    for f, v in zip(_ENTRY.names, (url_key(url), _LOW if page_id is None else page_id, name, at, len(raw)), strict=True):
                        found[f].append(v)
                    at += len(raw)
                yield pa.RecordBatch.from_pydict(found, schema=_ENTRY)
        finally:
            if out is not None:
                out.close()

    _files(folder)[0].create_dir(_files(folder)[1])
    entries = stored(spark, rows.select("page_id", "url", "html", "digest", "first").mapInArrow(run, _ENTRY_DDL))
    drop(copies)
    return entries


# ---- index


@dataclass(frozen=True)
class Index:
    """The top level: the folder, and of every shard, in order, its first and last (key, pid), file, and the place of its directory."""

    folder: str
    lows: tuple
    highs: tuple
    shards: tuple


def build_index(spark: SparkSession, entries: DataFrame, folder: str) -> Index:
    """Sorts entries (of write_archives) into index shards in folder. Only the shards' bounds come to the driver."""
    order = ("key", "pid", "file", "offset")
    n = min(SHARDS, max(1, -(-entries.count() // SHARD)))
    rows = entries.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _files(folder)
        name = f"index-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.cdx"
        held, directory, at, last, out = [], [], 0, None, None
        try:
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    held.append(row)
                    last = row[:2]
                    if len(held) == BLOCK:
                        out = out or fs.open_output_stream(f"{top}/{name}", compression=None)
                        at += _put(out, held, directory, at)
                        held = []
            if held:
                out = out or fs.open_output_stream(f"{top}/{name}", compression=None)
                at += _put(out, held, directory, at)
            if out is not None:
                raw = zstandard.compress(json.dumps(directory).encode())
                out.write(raw)
        finally:
            if out is not None:
                out.close()
        if directory:
            first = directory[0]
            row = {"low_key": first[0], "low_pid": first[1], "high_key": last[0], "high_pid": last[1], "file": name, "offset": at, "size": len(raw)}
            yield pa.RecordBatch.from_pylist([row])

    found = rows.mapInArrow(run, "low_key string, low_pid long, high_key string, high_pid long, file string, offset long, size long").collect()
    found.sort(key=lambda r: (r["low_key"], r["low_pid"], r["file"]))
    return Index(folder, tuple((r["low_key"], r["low_pid"]) for r in found), tuple((r["high_key"], r["high_pid"]) for r in found), tuple((r["file"], r["offset"], r["size"]) for r in found))


def _put(out, rows: list[tuple], directory: list, at: int) -> int:
    """Writes a block and notes it in the directory; its size."""
    raw = zstandard.compress("\n".join("\t".join(map(str, r)) for r in rows).encode())
    out.write(raw)
    directory.append((rows[0][0], rows[0][1], at, len(raw)))
    return len(raw)


class _Reader:
    """Lookups of one task; directories and blocks that were read last are kept."""

    def __init__(self, index: Index):
        self.index, self.kept = index, OrderedDict()
        self.fs, self.top = _files(index.folder)

    def _kept(self, name: str, offset: int, size: int, parse):
        if (name, offset) not in self.kept:
            with self.fs.open_input_file(f"{self.top}/{name}") as f:
                self.kept[name, offset] = parse(zstandard.decompress(f.read_at(size, offset)))
            while len(self.kept) > CACHE:
                self.kept.popitem(last=False)
        self.kept.move_to_end((name, offset))
        return self.kept[name, offset]

    @staticmethod
    def _directory(raw: bytes) -> tuple[list, list]:
        rows = json.loads(raw)
        return [(r[0], r[1]) for r in rows], [(r[2], r[3]) for r in rows]

    @staticmethod
    def _block(raw: bytes) -> tuple[list, list]:
        rows = [x.split("\t") for x in raw.decode().split("\n")]
        return [(r[0], int(r[1])) for r in rows], [(r[2], int(r[3]), int(r[4])) for r in rows]

    def find(self, low: tuple, high: tuple) -> Iterator[tuple[tuple, tuple]]:
        """Captures from low to high, both (key, pid) and inclusive: their (key, pid) and place."""
        i = bisect_left(self.index.highs, low)
        while i < len(self.index.lows) and self.index.lows[i] <= high:
            name, offset, size = self.index.shards[i]
            firsts, places = self._kept(name, offset, size, self._directory)
            j = max(0, bisect_left(firsts, low) - 1)
            while j < len(firsts) and firsts[j] <= high:
                keys, at = self._kept(name, *places[j], self._block)
                k = bisect_left(keys, low)
                while k < len(keys) and keys[k] <= high:
                    yield keys[k], at[k]
                    k += 1
                j += 1
            i += 1


def locate(index: Index, wanted: DataFrame, total: int) -> DataFrame:
    """The captures (key, pid, file, offset, size) of wanted rows (url, pid), total in number: that capture of the URL, or all its captures where pid is null.

    Rows are dealt by ranges of key and pid, so a task reads neighbouring blocks, each once. Rows that repeat are looked up
    once; a capture that is wanted by its page and among all of its URL comes for each of the two.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"key": pa.array([url_key(u) for u in batch.column(0).to_pylist()], pa.string()), "pid": batch.column(1)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, before = _Reader(index), None
        for batch in batches:
            out = []
            for want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if want == before:
                    continue
                before = want
                for key, place in reader.find((want[0], _LOW if want[1] is None else want[1]), (want[0], _HIGH if want[1] is None else want[1])):
                    out.append((*key, *place))
                    if len(out) >= 10_000:
                        yield _entries(out)
                        out = []
            yield _entries(out)

    rows = wanted.select("url", F.col("pid").cast("long").alias("pid")).mapInArrow(keyed, "key string, pid long")
    rows = rows.repartitionByRange(max(1, -(-total // SHARD)), "key", "pid").sortWithinPartitions("key", "pid")
    return rows.mapInArrow(run, _ENTRY_DDL)


def _entries(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_ENTRY.types)], names=_ENTRY.names)


_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
_RECORD_DDL = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def fetch(folder: str, entries: DataFrame, total_bytes: int, payload: bool = True) -> DataFrame:
    """The records at entries (file, offset, size; total_bytes together), read by ranges: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload.

    Entries are dealt by file and offset; records less than GAP bytes apart are read at once, up to READ bytes. Revisits, and
    all records without payload asked for, have a null payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _files(folder)
        name, f = None, None
        try:
            for batch in batches:
                rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
                i = 0
                while i < len(rows):
                    file, start, size = rows[i]
                    j, end = i + 1, start + size
                    while j < len(rows) and rows[j][0] == file and rows[j][1] <= end + GAP and rows[j][1] + rows[j][2] - start <= READ:
                        end, j = max(end, rows[j][1] + rows[j][2]), j + 1
                    if file != name:
                        if f is not None:
                            f.close()
                        name, f = file, fs.open_input_file(f"{top}/{file}")
                    raw = f.read_at(end - start, start)
                    out = [read_record(gzip.decompress(raw[a - start : a - start + n])) for _, a, n in rows[i:j]]
                    yield pa.RecordBatch.from_pylist([r if payload else r | {"payload": None} for r in out], schema=_RECORD)
                    i = j
        finally:
            if f is not None:
                f.close()

    rows = entries.select("file", "offset", "size").repartitionByRange(max(1, -(-total_bytes // FETCH)), "file", "offset").sortWithinPartitions("file", "offset")
    return rows.mapInArrow(run, _RECORD_DDL)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages archived, and every capture looked up again by its URL and page."""
    pages, folder = table(spark, sf_dir, "pages"), f"{shared_uri(spark)}/warc-{uuid.uuid4().hex}"
    entries = write_archives(spark, pages, folder)
    index = build_index(spark, entries, folder)
    found = stored(spark, locate(index, pages.select("url", F.coalesce(F.col("page_id").cast("long"), F.lit(_LOW)).alias("pid")), entries.count()))
    size = found.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    out = stored(spark, fetch(folder, found, size, payload=False).drop("payload", "url"))
    drop(entries, found)
    remove(spark, folder)
    return out


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
