"""N-gram Jaccard join by grouped prefixes.

Every document becomes the set of its distinct 4-word shingles (64-bit hashes), in one global order: rare first, by the
counts of a sketch over all documents, then by hash. Equal sets are one class. Classes with the same prefix
and size are one group; groups are paired where they share a prefix token and their sizes and positions allow the
threshold, and only then are their members expanded and verified on whole sets.

Pairing runs in two rounds, so that a large group of near copies costs rows in proportion to its members. First every
group is held against one leader, the first group of the tokens it shares most of, and every member against its group's
first; components of these links follow.
Then, at each token that still has members of several components, members of different components are paired. Pairs
within a component need no check, so no link between different texts is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SpanHash, drop, join_skewed, mix, pieces, runs, stored, sum_vectors, table, vector_rows
from .components import components

#: Counters of the sketch that sets the global order, as powers of two: four for each document within these bounds, so that
#: what is broadcast is 256 KB to 16 MB. SLICES: what the sketch is summed in.
LEAST_BITS, MOST_BITS, SLICES = 18, 24, 16
#: Pairs of one text that are verified in one place.
PAIRS = 128
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False


def shingle_sets(raw: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, sorted by row and hash, and each one's row."""
    start, end = runs(NOT_SPACE[raw], at)
    word = SpanHash(raw, lower=True)(start, end)
    first = np.searchsorted(start, at)  # of each row's words, and the end
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(word)) - first[row]
    h = np.zeros(len(word), np.uint64)
    size = np.minimum(count, width)[row] if len(word) else np.zeros(0, np.int64)
    for k in range(width):
        take = k < size
        nxt = np.minimum(np.arange(len(word)) + k, max(0, len(word) - 1))
        h = np.where(take, mix(h * np.uint64(0x9E3779B97F4A7C15) + word[nxt] + np.uint64(k + 1)), h)
    keep = place <= count[row] - size
    h, row = h[keep], row[keep]
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], row[new]


def _sketch(docs: DataFrame, width: int) -> np.ndarray:
    """The order of magnitude (quarters of a power of two) of how many documents' shingles fall on each counter; the sums
    by slice are all that comes to the driver."""
    size = 1 << min(MOST_BITS, max(LEAST_BITS, (4 * docs.count()).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for _, raw, at in pieces(batch, "text"):
                np.add.at(total, (shingle_sets(raw, at, width)[0] % np.uint64(size)).astype(np.int64), 1)
        yield vector_rows(total, SLICES)

    total = sum_vectors(docs.select("text").mapInArrow(count, "slice int, part int, counts binary"), SLICES, size)
    return np.minimum(255, np.round(4 * np.log2(1.0 + total))).astype(np.uint8)


def _sets(docs: DataFrame, width: int, percent: int, order) -> DataFrame:
    """Of each row (doc_id, text, tk): doc_id, tk, n (size of its set), k1 and k2 (hashes of the set), its prefix, p1 and p2 (hashes of that)."""

    def total(values: np.ndarray, row: np.ndarray, n: int, seed: int) -> pa.Array:
        return pa.array(_sums(mix(values + np.uint64(seed)), row, n).view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, at in pieces(batch, "text"):
                h, row = shingle_sets(raw, at, width)
                m = rows.num_rows
                n = np.bincount(row, minlength=m)
                out = {"doc_id": rows.column(0), "tk": rows.column(2), "n": pa.array(n, pa.int64()), "k1": total(h, row, m, 11), "k2": total(h, row, m, 12)}
                by = np.lexsort((h, order.value[(h % np.uint64(len(order.value))).astype(np.int64)], row))
                length = n - -(-percent * n // 100) + 1
                length[n == 0] = 0
                keep = np.arange(len(h)) - np.r_[0, np.cumsum(n)][row] < length[row]
                h, row = h[by][keep], row[keep]
                # a prefix is a sequence, but its members stand in the global order: sums tell prefixes apart as they do sets
                prefix = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)].astype(np.int32)), pa.array(h.view(np.int64)))
                out |= {"p1": total(h, row, m, 13), "p2": total(h, row, m, 14), "prefix": prefix}
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return docs.select("doc_id", "text", "tk").mapInArrow(run, "doc_id long, tk long, n long, k1 long, k2 long, p1 long, p2 long, prefix array<long>")


def _sums(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Sums modulo 2^64 by row; row is sorted."""
    upto = np.r_[np.uint64(0), np.cumsum(values, dtype=np.uint64)]
    edge = np.searchsorted(row, np.arange(n + 1))
    return upto[edge[1:]] - upto[edge[:-1]]


def _verified(texts: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of texts (doc_id, text) whose whole sets reach the threshold.

    Both texts of a pair travel to b's place; a b with many pairs has several places, each with a copy of its text.
    """
    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("parts"))
    roles = pairs.join(many, "b").select(F.col("a").alias("doc_id"), F.col("b").alias("lead"), F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"))
    leads = many.select(F.col("b").alias("doc_id"), F.col("b").alias("lead"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"))
    rows = texts.join(roles.union(leads).hint("merge"), "doc_id").select("doc_id", "text", "lead", "part", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            for rows, raw, at in pieces(batch, "text"):
                h, row = shingle_sets(raw, at, width)
                edge = np.searchsorted(row, np.arange(rows.num_rows + 1))
                ids, to, role = (rows.column(i).to_pylist() for i in (0, 2, 4))
                good = []
                for i in range(rows.num_rows):
                    own = h[edge[i] : edge[i + 1]]
                    if role[i] == 0:
                        lead, held = to[i], own
                    elif to[i] == lead and len(held):
                        both = int((held[np.minimum(np.searchsorted(held, own), len(held) - 1)] == own).sum())
                        if 100 * both >= percent * (len(held) + len(own) - both):
                            good.append((ids[i], lead))
                yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in good], pa.int64()), "b": pa.array([x for _, x in good], pa.int64())})

    return rows.repartition("lead", "part").sortWithinPartitions("lead", "part", "role").mapInArrow(run, "a long, b long")


def _size_ok(small, large, percent: int):
    return 100 * F.col(small) >= percent * F.col(large)


#: Rows of one token that meet the token's rows in one place.
MEET = 1_024


def _one(row: str = ""):
    """What tells a row from others, by order: rows with an id first, then the id, then a hash of the text."""
    return F.struct(F.col(f"{row}doc_id").isNull().alias("none"), F.coalesce(f"{row}doc_id", F.lit(0)).alias("id"), F.col(f"{row}tk").alias("tk"))


def _texts(docs: DataFrame, able: DataFrame) -> DataFrame:
    """(doc_id, text) of the classes able (rep, one): the text of the row that one names. Rows that repeat are put together
    before the shuffle, and the join stays where they are."""
    rows = docs.select(_one().alias("one"), "text").select("one.*", "text").groupBy("none", "id", "tk").agg(F.first("text").alias("text"))
    return able.select("rep", "one.*").hint("merge").join(rows, ["none", "id", "tk"]).select(F.col("rep").alias("doc_id"), "text")


def _met(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (gid_x, comp_x, gid_y, comp_y) of rows (token, gid, n, pos, comp) of one token, in different components, that
    sizes and positions allow. A token of many rows has several places, each with a part of one side and all of the other."""
    parts = rows.groupBy("token").agg(F.ceil(F.count("*") / MEET).cast("int").alias("parts"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    rows = rows.join(parts.select("token", "parts").hint("merge"), "token")
    part = {"x": F.pmod(F.xxhash64("gid", "comp"), F.col("parts")).cast("int"), "y": F.explode(F.sequence(F.lit(0), F.col("parts") - 1))}
    x, y = (rows.select("token", part[s].alias("part"), *(F.col(c).alias(f"{c}_{s}") for c in ("gid", "n", "pos", "comp"))) for s in "xy")
    least = F.ceil(F.lit(percent) * (F.col("n_x") + F.col("n_y")) / F.lit(100 + percent))
    reach = F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y"))
    meet = x.join(y.hint("merge"), ["token", "part"]).where((F.col("comp_x") < F.col("comp_y")) & _size_ok("n_x", "n_y", percent) & _size_ok("n_y", "n_x", percent) & (reach >= least))
    return meet.select("gid_x", "comp_x", "gid_y", "comp_y").distinct()


def similar(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Near-duplicate classes of docs (doc_id, text): one row (doc_id, tk, n_shingles, component_id, stays) for each row of docs.

    Two rows link when 100 * |intersection| >= percent * |union| of their shingle sets. A text of fewer words than width is
    one shingle; null, empty and wordless texts have none and link with nothing. component_id is the smallest doc_id
    reachable. stays marks the first row of each component, by doc_id and then by a hash of the text, tk (xxhash64).

    Every row is compared by its own text: rows that share an id with other texts are apart, and rows without an id link
    like others (component_id is null only where nothing that is reachable has an id); rows that repeat id and text share
    their fate. Empty tables give empty results, and other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tk"))
    order = spark.sparkContext.broadcast(_sketch(docs, width))
    rows = stored(spark, _sets(docs, width, percent, order))
    # equal sets have equal prefixes, so any row's prefix stands for its class, and any class's for its group
    classes = rows.where("n > 0").groupBy("k1", "k2", "n").agg(F.min(_one()).alias("one"), *(F.first(c).alias(c) for c in ("p1", "p2", "prefix")))
    # numbers in the order of the rows: the first row of many near copies is mostly what they were made from, and leads them
    classes = classes.repartitionByRange("one.none", "one.id", "one.tk").sortWithinPartitions("one.none", "one.id", "one.tk")
    classes = stored(spark, classes.withColumn("rep", F.monotonically_increasing_id()))
    group = classes.groupBy("p1", "p2", "n").agg(F.min("rep").alias("gid"), F.count("*").alias("members"), F.first("prefix").alias("prefix"))
    group = stored(spark, group)
    members = stored(spark, classes.select("rep", "n", "p1", "p2").join(group.drop("prefix"), ["p1", "p2", "n"]).select("rep", "n", "gid", "members"))
    tokens = group.select("gid", "n", F.posexplode("prefix").alias("pos", "token"))
    # tokens that only one group has pair nothing
    shared = tokens.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    tokens = stored(spark, tokens.join(shared.hint("merge"), "token"))
    drop(group)

    # texts that can have a partner
    able = members.join(tokens.select("gid").distinct(), "gid", "left_semi").select("rep").union(members.where("members > 1").select("rep")).distinct()
    texts = stored(spark, _texts(docs, classes.select("rep", "one").join(able, "rep", "left_semi")))

    # round 1: leaders are the first groups of a token, for every band of sizes; a group goes to the one that it meets at
    # most tokens, and members of a group go to its first
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(np.log(100 / percent)).cast("double")).cast("int")
    banded = tokens.withColumn("band", band)
    leader = banded.groupBy("token", "band").agg(F.min(F.struct("gid", "n")).alias("l")).select("token", "band", F.col("l.gid").alias("lead"), F.col("l.n").alias("ln"))
    near = leader.union(leader.select("token", F.col("band") + 1, "lead", "ln"))
    stars = banded.join(near, ["token", "band"]).where(F.col("gid") > F.col("lead")).where(_size_ok("n", "ln", percent) & _size_ok("ln", "n", percent))
    stars = stars.groupBy("gid", "lead").agg(F.count("*").alias("k")).groupBy("gid").agg(F.max(F.struct("k", (-F.col("lead")).alias("l")))["l"].alias("l")).select("gid", (-F.col("l")).alias("lead"))
    pairs = stars.select(F.col("gid").alias("a"), F.col("lead").alias("b")).union(members.where("rep <> gid").select(F.col("rep").alias("a"), F.col("gid").alias("b")))
    pairs = stored(spark, pairs)
    links = stored(spark, _verified(texts, pairs, width, percent))
    drop(pairs)
    found = components(spark, links)

    # round 2: members of different components that meet at a token, or in a group
    placed = members.join(found, F.col("rep") == F.col("node"), "left").select("rep", "n", "gid", "members", F.coalesce("component", "rep").alias("comp"))
    placed = stored(spark, placed)
    held = placed.groupBy("gid", "comp").agg(F.count("*").alias("k"))
    at_token = tokens.join(held.select("gid", "comp"), "gid").select("token", "gid", "n", "pos", "comp")
    inside = placed.where("members > 1").select(F.xxhash64("gid", F.lit("group")).alias("token"), "gid", "n", F.lit(0).alias("pos"), "comp").distinct()
    at_token = stored(spark, at_token.union(inside))
    drop(tokens)
    mx, my = (placed.select(F.col("rep").alias(f"rep_{s}"), F.col("gid").alias(f"gid_{s}"), F.col("comp").alias(f"comp_{s}")) for s in "xy")
    more = _met(at_token, percent).join(mx, ["gid_x", "comp_x"]).join(my, ["gid_y", "comp_y"]).select(F.greatest("rep_x", "rep_y").alias("a"), F.least("rep_x", "rep_y").alias("b")).distinct()
    more = stored(spark, more)
    drop(at_token, placed, members)
    final = components(spark, links.union(_verified(texts, more, width, percent)))
    drop(texts, links, more)

    # the first row of each component; most components are one class
    of_class = classes.select("rep", "k1", "k2", "n", "one").join(final, F.col("rep") == F.col("node"), "left").drop("node")
    of_class = stored(spark, of_class.withColumn("component", F.col("component").cast("string")))
    first = of_class.where("component IS NOT NULL").groupBy("component").agg(F.min("one").alias("best"), F.count("*").alias("uses"))
    first = stored(spark, first)
    of_class_first = join_skewed(of_class, first, "component", F.col("rep"), of_class.count()).select("k1", "k2", "n", F.coalesce("best", "one").alias("best"))
    out = rows.drop("p1", "p2", "prefix").join(of_class_first, ["k1", "k2", "n"], "left")
    out = out.select("doc_id", "tk", F.col("n").alias("n_shingles"), F.when(F.col("best").isNull(), F.col("doc_id")).when(~F.col("best.none"), F.col("best.id")).alias("component_id"), (F.col("best").isNull() | (_one() == F.col("best"))).alias("stays"))
    out = stored(spark, out)
    drop(rows, classes, of_class, first)
    return out


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(spark, table(spark, sf_dir, "documents"), width=4, percent=85).select("doc_id", "n_shingles", "component_id")
