"""Benchmark decontamination by winnowing, in DataFrame functions only.

Both sides are cut into words; a k-gram is the hash of K words. Of every T consecutive words (K-grams in a sliding
window of T - K + 1) the minimum k-gram hash is a fingerprint, so any shared span of T words shares one. A document's
fingerprints stand with the run of spans that have them, and are joined to the benchmark's; the T-word spans of the runs
that meet are compared, word for word, with the benchmark's. Items of fewer than T words are found by their longest word
instead. All texts are cut into words once; those with a hit once more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, settled, stored, table

#: Words of a shared span that is always found, and of a k-gram.
T, K = 10, 5
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAK), "")


def _grams(w: Column) -> Column:
    """Hashes of the k-grams of at least K words."""
    return let(
        F.transform(w, lambda x: F.xxhash64(x)),
        lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - K), lambda i: F.xxhash64(*(h[i + k] for k in range(K)))),
    )


def _minima(grams: Column) -> Column:
    """The minimum k-gram hash of each T-word span, in order."""
    return F.transform(F.sequence(F.lit(1), F.size(grams) - (T - K)), lambda j: F.array_min(F.slice(grams, j, T - K + 1)))


def _runs(minima: Column) -> Column:
    """(fp, first, last) of each run of spans with one minimum."""
    n = F.size(minima)
    heads = F.filter(F.sequence(F.lit(0), n - 1), lambda j: (j == 0) | (minima[j] != minima[F.greatest(j - 1, F.lit(0))]))
    return let(heads, lambda h: F.transform(h, lambda j, i: F.struct(minima[j].alias("fp"), j.alias("first"), (F.coalesce(F.get(h, i + 1), n) - 1).alias("last"))))


def _anchor(word: Column) -> Column:
    return F.xxhash64(F.lit("word"), word)


def item_windows(items: DataFrame) -> DataFrame:
    """(item_id, words, length, fp): the spans of benchmark items to look for, and the fingerprint of each."""
    rows = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    long = rows.where(F.size("w") >= T).select("item_id", F.posexplode(_minima_of(F.col("w"))).alias("j", "fp"), "w")
    long = long.select("item_id", F.array_join(F.slice("w", F.col("j") + 1, T), " ").alias("words"), F.lit(T).alias("length"), "fp")
    longest = F.array_max(F.transform("w", lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    short = rows.where(F.size("w") < T).select("item_id", F.array_join("w", " ").alias("words"), F.size("w").alias("length"), _anchor(longest).alias("fp"))
    return long.union(short)


def _minima_of(w: Column) -> Column:
    return let(_grams(w), _minima)


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """Each row of docs (doc_id, text) with tk (a hash of its text), n_words, n_hit, n_items, item_ids and contaminated.

    A document word is hit if it lies in an occurrence of a T-word span of an item, or of a whole item of fewer words.
    Null and empty texts, and texts and items without words, have no words and no hits; rows without a doc_id are read
    like others, and rows that repeat a doc_id are told apart by their text; empty tables are fine, and other columns are
    not read.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("tk"))
    spans = stored(spark, item_windows(items.select("item_id", "text")).distinct())
    short = sorted(r[0] for r in spans.where(F.col("length") < T).select("length").distinct().collect())  # at most T - 1 values

    def print_of(fp: Column, first: Column, last: Column) -> Column:
        return F.struct(fp.alias("fp"), first.cast("int").alias("first"), last.cast("int").alias("last"))

    zero, none = F.lit(0), F.lit(None).cast("long")

    def prints(w: Column) -> Column:
        """The runs of the text, its words where there are short items (first -1), and one row of no fingerprint with the number of words."""
        own = F.array(print_of(none, F.size(w), zero))
        long = F.when(F.size(w) >= T, let(_minima_of(w), _runs)).otherwise(F.array().cast("array<struct<fp:bigint,first:int,last:int>>"))
        words_of = F.transform(F.array_distinct(w), lambda x: print_of(_anchor(x), F.lit(-1), zero))
        return F.concat(own, long, words_of) if short else F.concat(own, long)

    rows = docs.select("doc_id", "tk", F.inline(let(words(F.col("text")), prints)))
    known = spans.select("fp").distinct().withColumn("known", F.lit(True))
    met = rows.join(known, "fp", "left").where("fp IS NULL OR known")
    runs = F.collect_list(F.when(F.col("fp").isNotNull() & (F.col("first") >= 0), F.struct("first", "last")))
    anchors = F.collect_set(F.when(F.col("first") < 0, F.col("fp")))
    count = F.when(F.col("fp").isNull(), F.col("first"))
    # rows repeated with their text are one here, and n_rows again in the end
    seeds = stored(spark, met.groupBy("doc_id", "tk").agg(F.max(count).cast("long").alias("n_words"), F.count(count).alias("n_rows"), runs.alias("runs"), anchors.alias("anchors")))

    def span(w: Column, j: Column, length: int) -> Column:
        return F.struct(j.cast("int").alias("start"), F.lit(length).alias("length"), F.array_join(F.slice(w, j + 1, length), " ").alias("words"))

    def of_length(w: Column, length: int) -> Column:
        """Spans that hold the longest word of an item."""
        held = F.filter(F.sequence(zero, F.size(w) - 1), lambda p: F.array_contains("anchors", _anchor(w[p])))
        near = F.transform(held, lambda p: F.when(F.greatest(p - (length - 1), zero) <= F.least(p, F.size(w) - length), F.sequence(F.greatest(p - (length - 1), zero), F.least(p, F.size(w) - length))))
        return F.transform(F.array_distinct(F.flatten(F.array_compact(near))), lambda j: span(w, j, length))

    def around(w: Column) -> Column:
        """The spans of w that may be a benchmark's, as (start, length, words)."""
        starts = F.flatten(F.transform("runs", lambda r: F.sequence(r["first"], r["last"])))
        out = F.transform(F.array_distinct(starts), lambda j: span(w, j, T))
        for length in short:
            out = F.concat(out, F.when((F.size("anchors") > 0) & (F.size(w) >= length), of_length(w, length)).otherwise(F.array().cast("array<struct<start:int,length:int,words:string>>")))
        return out

    def same(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        right = right.withColumnsRenamed({"doc_id": "r_doc_id", "tk": "r_tk"})
        return left.join(right, left["doc_id"].eqNullSafe(right["r_doc_id"]) & (left["tk"] == right["r_tk"]), how).drop("r_doc_id", "r_tk")

    hit = seeds.where((F.size("runs") > 0) | (F.size("anchors") > 0)).select("doc_id", "tk", "runs", "anchors")
    found = same(docs, hit, "inner").select("doc_id", "tk", F.inline(let(words(F.col("text")), around)))
    found = stored(spark, found.join(spans.select("words", "length", "item_id"), ["words", "length"]).select("doc_id", "tk", "start", "length", "item_id").distinct())
    covered = F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1))))
    per_doc = found.select("doc_id", "tk", "start", "length").distinct().groupBy("doc_id", "tk").agg(F.size(covered).cast("long").alias("n_hit"))
    item_ids = found.groupBy("doc_id", "tk").agg(F.array_sort(F.transform(F.collect_set("item_id"), lambda x: x.cast("string"))).alias("item_ids"))
    hits = same(per_doc, item_ids, "inner")
    each = same(seeds.select("doc_id", "tk", "n_words", F.explode(F.array_repeat(zero, F.col("n_rows").cast("int"))).alias("row")), hits, "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return each.select("doc_id", "tk", "n_words", n_hit.alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), (n_hit > 0).alias("contaminated"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = settled(spark, lambda: decontaminate(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT item_id, least(len(w), 10) AS n, unnest(list_transform(range(greatest(len(w) - 9, 1)), lambda j: array_to_string(w[j + 1 : j + 10], ' '))) AS t FROM b WHERE len(w) > 0),
n AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, j, n, array_to_string(w[j + 1 : j + n], ' ') AS t FROM (SELECT doc_id, w, n.n, unnest(range(len(w) - n.n + 1)) AS j FROM d, n WHERE len(w) >= n.n)),
h AS (SELECT DISTINCT dw.doc_id, dw.j, dw.n, iw.item_id FROM dw JOIN iw USING (n, t)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + n)) AS p FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""
