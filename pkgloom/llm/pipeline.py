"""A corpus pipeline of five operators: quality, exact dedup, near dedup, decontamination, mixing.

A stage takes (spark, docs, sf_dir) and returns the documents it keeps with the columns of documents; the last one
returns the mix instead. Other columns pass through whatever their names; an empty table stays empty in each stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import op03_ngram_join, op04_quality, op05_exact_dedup, op06_mixing, op09_decontamination
from .common import drop, settled, stored, table

#: What a stage puts before the names of its own columns, so that they meet none of documents.
_OWN = "pkgloom_"


def _join(docs: DataFrame, keys: DataFrame, how: str, **by: Column) -> DataFrame:
    """docs by keys, whose columns are named in by and equal (null too) to what stands there of docs."""
    keys = keys.select(*(F.col(k).alias(_OWN + k) for k in by)).distinct()
    on = [c.eqNullSafe(F.col(_OWN + k)) for k, c in by.items()]
    out = on[0]
    for x in on[1:]:
        out = out & x
    return docs.join(keys, out, how)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at its threshold or above; null and empty texts are scored like any other,
    repeated rows alike, and without labels all stay."""
    return op04_quality.keep(spark, docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts one row: that with the smallest doc_id, of repeats of that row one.

    Null texts are equal to empty ones. A row without a doc_id stays only where no row of its text has one; texts that
    stand under one doc_id are judged apart.
    """
    out = stored(spark, op05_exact_dedup.exact_dedup(spark, docs).select("doc_id", "digest", "kept"))
    ids = out.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or("kept").alias("kept"))
    plain = _join(docs, ids.where("n > 1 OR NOT kept"), "left_anti", doc_id=docs["doc_id"])
    digest = _OWN + "digest_of"
    many = _join(docs, ids.where("n > 1"), "left_semi", doc_id=docs["doc_id"]).withColumn(digest, op05_exact_dedup.digest_of(F.col("text")))
    many = _join(many, out.where("kept"), "left_semi", doc_id=many["doc_id"], digest=F.col(digest))
    first = W.partitionBy("doc_id", digest).orderBy(*(c for c, t in docs.dtypes if t in ("string", "bigint", "int")))
    many = many.withColumn(_OWN + "n", F.row_number().over(first)).where(F.col(_OWN + "n") == 1)
    return plain.unionByName(many.select(*docs.columns))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the document with the smallest doc_id.

    Documents without a word stay. Rows are compared by their own texts whatever their ids; those without a doc_id come
    after those with one. Rows that repeat id and text share their fate.
    """
    gone = op03_ngram_join.similar(spark, docs.select("doc_id", "text")).where("NOT stays")
    return _join(docs, gone.select("doc_id", "tk"), "left_anti", doc_id=docs["doc_id"], tk=F.xxhash64("text"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage; rows without a doc_id, and texts under one doc_id, are judged by their text."""
    found = op09_decontamination.decontaminate(spark, docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    return _join(docs, stored(spark, found.select("doc_id", "tk")), "left_anti", doc_id=docs["doc_id"], tk=F.xxhash64("text"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: doc_id, source, size, source_size, target, taken of every document; null sources are one source, and texts
    without words take nothing."""
    return op06_mixing.mix_sources(spark, op06_mixing.sized(docs))


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", decontaminated), ("mixing", mixed)]

#: The classifier's scores can't be written as SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        drop(*before)
        before = [docs]
    return docs
