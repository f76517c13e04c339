"""Exact dedup against a minimal perfect hash of the digests seen so far.

The distinct digests of the history are cut into buckets by their first bytes. Each bucket becomes one row of an index
table: a levelled minimal perfect hash, whose slots hold the full 32-byte digest and a locator of the winner. Incoming
digests are grouped first (a hot text is then one row), looked up in their bucket and compared byte for byte; members
join the history's group, nonmembers make groups of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, mix, settled, stored, table

#: Digests in a bucket, about; a bucket is one row of the index and one task's work.
BUCKET_DIGESTS = 50_000
MIN_BUCKETS = 48
#: Bits of a level for each digest that is still to be placed.
SPREAD = 2.0
#: The winner of a group in which no row has a doc_id, inside the index; null outside.
NO_ID = (1 << 63) - 1

_INDEX = "bucket int, n long, levels binary, bits binary, slots binary, winners binary, counts binary"
_FOUND = "digest binary, keep_id long, group_size long, member boolean"


def _words(digests) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(x) for x in digests), np.uint8).reshape(-1, 32)


def _place(words: np.ndarray, level: int, size: int) -> np.ndarray:
    parts = words.view(np.uint64)
    return (mix(parts[:, 1] + mix(parts[:, 2] + np.uint64(level + 1))) % np.uint64(size)).astype(np.int64)


def build(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the levels, their bits one after the other, and each digest's slot. The digests are distinct."""
    sizes, bits, slot, left, level, base = [], [], np.empty(len(words), np.int64), np.arange(len(words)), 0, 0
    while len(left):
        size = int(SPREAD * len(left)) + 1
        at = _place(words[left], level, size)
        alone = np.bincount(at, minlength=size) == 1
        fits = alone[at]
        rank = np.cumsum(alone) - 1
        slot[left[fits]] = base + rank[at[fits]]
        base += int(alone.sum())
        sizes.append(size)
        bits.append(alone)
        left, level = left[~fits], level + 1
    return np.array(sizes, np.int64), np.concatenate(bits) if bits else np.zeros(0, bool), slot


def lookup(words: np.ndarray, sizes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The slot that each digest would have; -1 where no level holds it. A digest that was not built in may get any slot."""
    slot, left, start = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
    rank = np.cumsum(bits) - 1
    for level, size in enumerate(sizes):
        at = _place(words[left], level, int(size)) + start
        hit = bits[at]
        slot[left[hit]] = rank[at[hit]]
        left, start = left[~hit], start + int(size)
    return slot


def digest_of(text):
    """SHA-256 of the text with each run of white space as one space; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "), 256))


def digests(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    return docs.select(F.col(id).cast("long").alias("doc_id"), digest_of(F.col(text)).alias("digest"))


def _grouped(rows: DataFrame, n: int) -> DataFrame:
    bucket = F.pmod(F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")
    return rows.groupBy("digest").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("doc_id"), F.count("*").alias("n")).withColumn("bucket", bucket)


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """The index table of the history's distinct digests, a row for each bucket that has any."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        words = _words(pdf["digest"])
        sizes, bits, slot = build(words)
        order = np.argsort(slot)
        return pd.DataFrame([{
            "bucket": pdf["bucket"].iloc[0], "n": len(pdf), "levels": sizes.tobytes(), "bits": np.packbits(bits).tobytes(), "slots": words[order].tobytes(),
            "winners": pdf["doc_id"].to_numpy(np.int64)[order].tobytes(), "counts": pdf["n"].to_numpy(np.int64)[order].tobytes(),
        }])

    return _grouped(history, buckets).groupBy("bucket").applyInPandas(one, _INDEX)


def look_up(index: DataFrame, incoming: DataFrame, buckets: int) -> DataFrame:
    """One row for each distinct digest of history and incoming rows: digest, keep_id, group_size, member (of the history)."""

    def one(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        words = _words(new["digest"]) if len(new) else np.zeros((0, 32), np.uint8)
        ids, counts = new["doc_id"].to_numpy(np.int64), new["n"].to_numpy(np.int64)
        if not len(old):
            return pd.DataFrame({"digest": list(new["digest"]), "keep_id": ids, "group_size": counts, "member": False})
        row = old.iloc[0]
        sizes = np.frombuffer(row["levels"], np.int64)
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=int(sizes.sum())).astype(bool)
        slots = np.frombuffer(row["slots"], np.uint8).reshape(-1, 32)
        winners, sums = np.frombuffer(row["winners"], np.int64).copy(), np.frombuffer(row["counts"], np.int64).copy()
        slot = lookup(words, sizes, bits)
        found = slot >= 0
        found[found] = (slots[slot[found]] == words[found]).all(axis=1)
        np.minimum.at(winners, slot[found], ids[found])
        np.add.at(sums, slot[found], counts[found])
        new_words = words[~found]
        return pd.DataFrame({
            "digest": [x.tobytes() for x in slots] + [x.tobytes() for x in new_words], "keep_id": np.r_[winners, ids[~found]],
            "group_size": np.r_[sums, counts[~found]], "member": np.r_[np.ones(len(slots), bool), np.zeros(len(new_words), bool)],
        })

    return _grouped(incoming, buckets).groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(one, _FOUND)


def exact_dedup(spark: SparkSession, docs: DataFrame, history_below: int | None = None, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Each row of docs with the row that stays for its text: doc_id, digest, keep_id, group_size, kept.

    Rows with doc_id below history_below are the history (by default the lower half of the range of ids), the others
    come in. Null and empty texts are equal; rows that share doc_id and text share one fate; an empty table gives an
    empty result; other columns are not read. A row without doc_id stays only where no row of its group has one.
    """
    rows = stored(spark, digests(docs, text, id))
    low, high, n = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    split = history_below if history_below is not None else (0 if low is None else (low + high + 1) // 2)
    buckets = max(MIN_BUCKETS, -(-n // BUCKET_DIGESTS))
    index = stored(spark, build_index(rows.where(F.col("doc_id") < split), buckets))
    groups = look_up(index, rows.where((F.col("doc_id") >= split) | F.col("doc_id").isNull()), buckets)
    groups = groups.withColumn("keep_id", F.nullif("keep_id", F.lit(NO_ID)))
    return rows.join(groups, "digest").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = settled(spark, lambda: exact_dedup(spark, table(spark, sf_dir, "documents").select("doc_id", "text")))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"), F.col("member").alias("in_history"))


ORACLE = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents),
m AS (SELECT CAST((min(doc_id) + max(doc_id) + 1) // 2 AS BIGINT) AS split FROM documents),
g AS (SELECT h, min(doc_id) AS keep_id, CAST(count(*) AS BIGINT) AS group_size FROM n GROUP BY h)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, n.h AS text_sha256, g.keep_id < m.split AS in_history
FROM n JOIN g USING (h), m
"""
