"""Archives and their index: an exact round trip, against plain lookups."""

import gzip
import hashlib
import random
import uuid

import pyarrow.fs
import pytest

from pkgloom.llm import common, op12_warc

SCHEMA = "page_id long, url string, html string, key string, pid long, digest string, first long, file string"


def rows():
    rng = random.Random(4)
    body = ["", None, "short", "é" * 49, "é" * 50, "x" * 100, "<p>" + "long " * 100_000, "\r\n\r\nWARC/1.1\r\n\r\n" * 9, *(f"{rng.random()} " * 20 for _ in range(6))]
    urls = [None, "", "http://A.example.com:80/x?q=1#top", "https://user:pw@a.example.com:80/x?q=1", "no scheme", "http://b.example.org", "http://tab\tnew\nline.example/  é", "http://x/" + "p" * 5000, "http://x/" + "p" * 5000 + "q", "mailto:me@x.y"]
    out = [(i, rng.choice(urls), rng.choice(body), "k", 1, "d", 2, "f") for i in range(-40, 300)]
    out += [(None, "http://no.id/", body[6], "k", 1, "d", 2, "f"), (None, None, "only here " * 50, "k", 1, "d", 2, "f"), out[5], out[5], out[50]]
    return out


def expected(pages):
    sums = [(i, u, (h or "").encode()) for i, u, h in (r[:3] for r in pages)]
    first = {}
    for i, _, h in sums:
        if i is not None and len(h) >= 100:
            first[h] = min(first.get(h, i), i)
    return sorted(repr((i, len(h), hashlib.sha256(h).hexdigest(), "revisit" if first.get(h, i) != i else "response", first[h] if first.get(h, i) != i else None)) for i, _, h in sums)


def found(records):
    return sorted(repr((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in records)


@pytest.mark.parametrize("size", [3, 1000])
def test_round_trip(spark, size, monkeypatch):
    for name, value in {"BLOCK": size, "SHARD": 20 * size, "CACHE": 2, "GAP": 0 if size == 3 else 1 << 16}.items():
        monkeypatch.setattr(op12_warc, name, value)
    monkeypatch.setattr(common, "HOT_KEYS", 8)
    pages = rows()
    table = spark.createDataFrame(pages, SCHEMA).repartition(3)
    folder = f"{common.shared_uri(spark)}/warc-{uuid.uuid4().hex}"
    entries = op12_warc.write_archives(spark, table, folder, file_bytes=2000)
    index = op12_warc.build_index(spark, entries, folder)
    fs, top = pyarrow.fs.FileSystem.from_uri(folder)
    files = [f for f in fs.get_file_info(pyarrow.fs.FileSelector(top)) if f.path.endswith(".warc.gz")]
    assert len(files) > 3 and len(index.shards) == (6 if size == 3 else 1)
    # whole archives are plain WARC: each record begins where the one before it ended
    plain = b"".join(gzip.decompress(fs.open_input_file(f.path).read()) for f in files)
    assert plain.count(b"WARC-Type: ") >= len(pages)
    wanted = [(u, op12_warc._LOW if i is None else i) for i, u, *_ in pages] + [("http://absent/", 1), ("http://b.example.org", 10**9), ("http://no.id/", 5)]
    at = op12_warc.locate(index, spark.createDataFrame(wanted, "url string, pid long"), len(wanted))
    out = op12_warc.fetch(folder, at, entries.agg({"size": "sum"}).first()[0]).collect()
    assert found(out) == expected(pages)
    bodies = {i: (h or "").encode() for i, _, h in (r[:3] for r in pages)}
    assert all(bytes(r["payload"]) == bodies[r["page_id"]] for r in out if r["record_type"] == "response" and r["page_id"] is not None)
    # all captures of a URL, whatever its scheme and fragment
    one = op12_warc.locate(index, spark.createDataFrame([("ftp://a.EXAMPLE.com:80/x?q=1#other", None)], "url string, pid long"), 1).collect()
    assert sorted(r["pid"] for r in one) == sorted(r[0] for r in pages if r[1] and "xample.com:80/x" in r[1])


def test_no_pages(spark, tmp_path):
    folder = f"{common.shared_uri(spark)}/warc-{uuid.uuid4().hex}"
    entries = op12_warc.write_archives(spark, spark.createDataFrame([], SCHEMA), folder)
    index = op12_warc.build_index(spark, entries, folder)
    assert index.shards == () and op12_warc.locate(index, spark.createDataFrame([("http://x/", 1)], "url string, pid long"), 1).count() == 0


def test_copies_by_query(spark, tmp_path):
    """The tables given hold no equal payloads, so the query runs on one that does."""
    pages = [(i, f"http://h{i % 3}.x/{i}", f"{'copy' if i % 3 else i} " * 30) for i in range(90)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert found(op12_warc.op12_warc(spark, str(tmp_path)).collect()) == expected(pages)


def test_damaged_record():
    raw = op12_warc.record("response", 7, "http://x/", b"y" * 200, hashlib.sha256(b"y" * 200).hexdigest())
    assert op12_warc.read_record(raw)["payload"] == b"y" * 200
    with pytest.raises(ValueError, match="page 7 is damaged"):
        op12_warc.read_record(raw.replace(b"yy", b"yz", 1))


def test_keys():
    assert op12_warc.url_key("https://user:pw@M.Example.net:8080/en/25?a=b#top") == "net,example,m:8080)/en/25?a=b"
    assert op12_warc.url_key("http://example.org") == "org,example)/" and op12_warc.url_key(None) == ""
    assert len(op12_warc.url_key("http://x/" + "p" * 9999)) == op12_warc.KEY_CHARS
