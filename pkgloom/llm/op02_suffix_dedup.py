"""Repeated byte strings by bucket-pointer refinement of suffixes.

Every suffix starts in the bucket of its first Q bytes. Buckets are refined by sorting on the identifiers of the buckets
found Q bytes later, the refined ones on those found 2Q bytes later, and so on, each step reusing what the last one
updated: after four steps a bucket holds the suffixes that agree in their first LENGTH = 16 Q bytes. Where suffixes of
several tasks have to meet, the same steps run on hashes as identifiers (names), which tasks give alike.

Only part of the suffixes needs to meet in the shuffle. Of the half-length buckets in a window of LENGTH bytes the one
with the least name is its anchor, which equal windows choose alike; the windows of one anchor are consecutive. Rows of
anchors are sorted into buckets, and buckets of one row are done. Where all rows of a bucket agree in all the bytes of
their windows, all windows repeat. What is left are the ends of repeats: there one row for each different context goes
on to be refined to single suffixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PIECE_BYTES, SpanHash, drop, flat, mix, pieces, stored, table

Q, STEPS = 25, 4
LENGTH = Q << STEPS
HALF = LENGTH // 2
#: Suffixes that are named at a time, which bounds memory within a very long text.
BLOCK = 1 << 20
#: Contexts of a bucket that are refined in one task; a larger bucket is split, and its suffixes meet by their names.
MEMBERS = 2048
_LOW = np.uint64((1 << 22) - 1)


def names(raw: np.ndarray, steps: int, first: SpanHash | None = None) -> np.ndarray:
    """The names of the first Q << steps bytes of each suffix that has as many."""
    first = first or SpanHash(raw)
    start = np.arange(max(0, len(raw) - Q + 1))
    name, width = first(start, start + Q), Q
    for _ in range(steps):
        n = max(0, len(name) - width)
        name = mix(name[:n] * np.uint64(0x9E3779B97F4A7C15) + name[width : width + n])
        width *= 2
    return name


def refined(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the suffixes with LENGTH bytes in their row of raw, and the identifier of each one's bucket: equal where
    and only where those bytes are."""
    # identifiers and lengths are fewer than the bytes; four bytes each hold them
    small = np.int32 if len(raw) < 1 << 31 else np.int64
    left = (np.repeat(at[1:], np.diff(at)) - np.arange(len(raw))).astype(small)

    def step(have: np.ndarray, more: np.ndarray, width: int, reach: int) -> np.ndarray:
        start = np.flatnonzero(left >= reach).astype(small)
        key = have[start].astype(np.int64)
        key *= int(more.max(initial=0)) + 1
        key += more[start + small(width)]
        out = np.zeros(len(raw), small)
        out[start] = np.unique(key, return_inverse=True)[1]
        return out

    # the initial buckets, of Q bytes: single bytes doubled, and what is missing added from the bits of Q
    power, whole, width, size = raw.astype(small), None, 0, 1
    while size <= Q:
        if Q & size:
            whole = power if whole is None else step(whole, power, width, width + size)
            width += size
        size *= 2
        if size <= Q:
            power = step(power, power, size // 2, size)
    for k in range(STEPS):
        whole = step(whole, whole, Q << k, Q << k + 1)
    start = np.flatnonzero(left >= LENGTH)
    return start, whole[start].astype(np.int64)


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """The least key of each window of width keys."""
    size = 1
    while size * 2 <= width:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    return np.minimum(key[: len(key) - (width - size)], key[width - size :]) if width > size else key


def anchors(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each anchor: document (row of at), first and last window start in it, the anchor's name, the name of the context."""
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    for base in range(0, max(0, len(raw) - LENGTH + 1), BLOCK):
        part = raw[base : base + BLOCK + LENGTH - 1]
        name = names(part, STEPS - 1)
        key = (name & ~_LOW) | np.arange(len(name), dtype=np.uint64)
        best = (_least(key, HALF + 1) & _LOW).astype(np.int64)  # for each window start
        start = np.arange(len(best))
        doc = np.searchsorted(at, start + base, "right") - 1
        ok = start + base + LENGTH <= at[doc + 1]
        start, doc, best = start[ok], doc[ok], best[ok]
        if not len(start):
            continue
        new = np.ones(len(start), bool)
        new[1:] = (best[1:] != best[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
        head = np.flatnonzero(new)
        lo, hi, p, d = start[head], start[np.append(head[1:], len(start)) - 1], best[head], doc[head]
        context = mix(SpanHash(part, seed=2)(lo, hi + LENGTH) + (p - lo).astype(np.uint64))
        for have, x in zip(out, (d, lo + base - at[d], hi + base - at[d], name[p].view(np.int64), context.view(np.int64)), strict=True):
            have.append(x)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, tk, span, b, c) of rows (doc_id, text, tk); span holds the first window start and how many more windows follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, at in pieces(batch, "text"):
                d, lo, hi, b, c = anchors(raw, at)
                row = pa.array(d)
                yield pa.RecordBatch.from_arrays([rows.column(0).take(row), rows.column(2).take(row), pa.array(lo << 8 | (hi - lo)), pa.array(b), pa.array(c)], names=["doc_id", "tk", "span", "b", "c"])

    return docs.mapInArrow(run, "doc_id long, tk long, span long, b long, c long")


def _contexts(docs: DataFrame) -> DataFrame:
    """The bytes of each of the given spans of docs (doc_id, text, tk, spans: array of (b, salt, hot, span, need))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, edge = flat(batch.column(1))
            out = {k: [] for k in ("b", "salt", "hot", "doc_id", "tk", "span", "need", "bytes")}
            for i, spans in enumerate(batch.column(3).to_pylist()):
                text = raw[edge[i] : edge[i + 1]].tobytes()
                key = {"doc_id": batch.column(0)[i].as_py(), "tk": batch.column(2)[i].as_py()}
                for x in spans:
                    lo = x["span"] >> 8
                    for k, v in (x | key | {"bytes": text[lo : lo + (x["span"] & 255) + LENGTH]}).items():
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=_CONTEXT)

    return docs.mapInArrow(run, "b long, salt int, hot boolean, doc_id long, tk long, span long, need boolean, bytes binary")


_CONTEXT = pa.schema([("b", pa.int64()), ("salt", pa.int32()), ("hot", pa.bool_()), ("doc_id", pa.int64()), ("tk", pa.int64()), ("span", pa.int64()), ("need", pa.bool_()), ("bytes", pa.binary())])


def _refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Refines the contexts of this partition, sorted by bucket, bucket by bucket: rows (done, k1, k2, doc_id, tk, span, need).
    Rows with done are repeats; the others are suffixes of split buckets that may have their equals in other partitions.
    A bucket part has about MEMBERS contexts, and small ones go together up to PIECE_BYTES, which bounds memory."""
    held: list[pa.RecordBatch] = []

    def cut(last: bool) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        b, salt = (rows.column(i).to_numpy() for i in (0, 1))
        edge = np.flatnonzero(np.r_[True, (b[1:] != b[:-1]) | (salt[1:] != salt[:-1]), last])
        held.clear()
        if edge[-1] < len(b):  # the last bucket may go on in the next batch
            held.extend(rows.slice(edge[-1]).to_batches())
        size = np.r_[0, np.cumsum(pc.binary_length(rows.column(7)).to_numpy())]
        first = 0
        while first < len(edge) - 1:
            stop = max(first + 1, int(np.searchsorted(size[edge], size[edge[first]] + PIECE_BYTES, "right")) - 1)
            yield from _refined_rows(rows.slice(edge[first], edge[stop] - edge[first]), np.repeat(np.arange(stop - first), np.diff(edge[first : stop + 1])))
            first = stop

    waiting = 0
    for batch in batches:
        held.append(batch)
        waiting += batch.num_rows
        if waiting >= MEMBERS:
            yield from cut(False)
            waiting = 0
    if held:
        yield from cut(True)


def _refined_rows(rows: pa.Table, bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of whole buckets: rows is in their order, bucket numbers each row's."""
    raw, at = flat(rows.column(7).combine_chunks().view(pa.string()))
    ids, tks, spans, hot, need = (rows.column(i).to_numpy() for i in (3, 4, 5, 2, 6))
    start, place = refined(raw, at)
    row = np.searchsorted(at, start, "right") - 1
    key = np.unique(bucket[row] * (place.max(initial=0) + 1) + place, return_inverse=True)[1]
    several = (np.bincount(key) > 1)[key] if len(key) else np.zeros(0, bool)
    done = np.flatnonzero(several & need[row])
    # of a split bucket one row of each string goes on; where it has its equal here, it only stands for others to find
    first = np.zeros(len(key), bool)
    first[np.unique(key, return_index=True)[1]] = True
    later = np.flatnonzero(first & hot[row])
    pick = np.r_[done, later]
    flag = np.r_[np.ones(len(done), bool), np.zeros(len(later), bool)]
    want = np.r_[np.ones(len(done), bool), need[row[later]] & ~several[later]]
    k1, k2 = np.zeros(len(pick), np.uint64), np.zeros(len(pick), np.uint64)
    if len(later):
        k1[len(done) :] = names(raw, STEPS)[start[later]]
        k2[len(done) :] = SpanHash(raw, seed=3)(start[later], start[later] + LENGTH)
    span = (spans[row] & ~np.int64(255)) + ((start - at[row]) << 8)
    for i in range(0, len(pick), 1 << 17):
        j = slice(i, i + (1 << 17))
        yield pa.RecordBatch.from_arrays([pa.array(flag[j]), pa.array(k1[j].view(np.int64)), pa.array(k2[j].view(np.int64)), pa.array(ids[row[pick[j]]]), pa.array(tks[row[pick[j]]]), pa.array(span[pick[j]]), pa.array(want[j])], names=["done", "k1", "k2", "doc_id", "tk", "span", "need"])


def repeated_spans(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, tk, spans): the window starts of docs (doc_id, text, tk) whose LENGTH bytes start anywhere else too (stored).
    A row is named by doc_id and tk, a hash of its text, so texts under one doc_id are apart."""
    rows = stored(spark, _anchor_rows(docs))
    buckets = rows.groupBy("b").agg(F.count("*").alias("n"), F.min("c").alias("c1"), F.max("c").alias("c2")).where("n > 1")
    # written first, so that the join can split a bucket that holds many rows
    buckets = stored(spark, buckets.select("b", (F.col("c1") == F.col("c2")).alias("pure")))
    met = stored(spark, rows.join(buckets.hint("merge"), "b"))
    drop(rows, buckets)
    mixed, place = met.where("NOT pure"), ("doc_id", "tk", "span")
    contexts = stored(spark, mixed.groupBy("b", "c").agg(F.count("*").alias("n"), F.min(F.struct(*place)).alias("one")))
    whole = mixed.join(contexts.where("n > 1").select("b", "c"), ["b", "c"], "left_semi").select(*place)
    many = contexts.groupBy("b").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))
    ends = contexts.join(many, "b").select(
        "one.doc_id", "one.tk",
        F.struct("b", F.pmod("c", F.col("parts")).cast("int").alias("salt"), (F.col("parts") > 1).alias("hot"), F.col("one.span").alias("span"), (F.col("n") == 1).alias("need")).alias("x"),
    )
    ends = docs.join(ends.groupBy("doc_id", "tk").agg(F.collect_list("x").alias("spans")), ["doc_id", "tk"]).select("doc_id", "text", "tk", "spans")
    suffixes = stored(spark, _contexts(ends).repartition("b", "salt").sortWithinPartitions("b", "salt").mapInArrow(_refine, "done boolean, k1 long, k2 long, doc_id long, tk long, span long, need boolean"))
    split = suffixes.where("NOT done")
    again = split.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").select("k1", "k2")
    single = suffixes.where("done").select(*place).unionByName(split.where("need").join(again, ["k1", "k2"], "left_semi").select(*place))
    found = met.where("pure").select(*place).unionByName(whole).unionByName(single)
    out = stored(spark, found.groupBy("doc_id", "tk").agg(F.collect_list("span").alias("spans")))
    drop(met, contexts, suffixes)
    return out


def drop_repeats(spark: SparkSession, docs: DataFrame, kept: bool = True) -> DataFrame:
    """docs (doc_id, text) as doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the remaining bytes).

    A byte goes if a string of LENGTH bytes covers it that also starts elsewhere, in this text or another; all strings
    are judged on the input. Null counts as empty; shorter texts keep everything; equal rows are each other's repeats,
    also where they share a doc_id; rows without a doc_id, or with another's, are told apart by texts; empty tables are fine, and
    other columns are not read.
    """
    text, with_kept = F.coalesce("text", F.lit("")), kept
    tk = F.xxhash64(text)
    docs = docs.select(F.col("doc_id").cast("long").alias("given"), F.coalesce(F.col("doc_id").cast("long"), tk).alias("doc_id"), text.alias("text"), tk.alias("tk"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, edge = flat(batch.column(1))
            spans = batch.column(2)
            out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_kept else []))}
            for i in range(batch.num_rows):
                text = raw[edge[i] : edge[i + 1]]
                kept, removed, n = text, 0, 0
                if spans[i].is_valid:
                    s = np.array(spans[i].as_py(), np.int64)
                    depth = np.zeros(len(text) + 1, np.int64)
                    np.add.at(depth, s >> 8, 1)
                    np.add.at(depth, (s >> 8) + (s & 255) + LENGTH, -1)
                    gone = np.cumsum(depth)[:-1] > 0
                    kept, removed = text[~gone], int(gone.sum())
                    n = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
                body = kept.tobytes()
                for k, v in zip(out, (len(text), removed, n, hashlib.sha256(body).hexdigest(), body)):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), **out})

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept
    return docs.join(repeated_spans(spark, docs.select("doc_id", "text", "tk")), ["doc_id", "tk"], "left").select("given", "text", "spans").mapInArrow(cut, schema)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(spark, table(spark, sf_dir, "documents"), kept=False)
