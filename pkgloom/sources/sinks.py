"""Reports and records written by Spark's own writers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import qualified, remove


def table_lines(rows: DataFrame, cells: dict[str, Column], order: str) -> DataFrame:
    """A Markdown table as lines (part, sort_key, value): the header, the rule and a line for each row, by the column
    order. A null cell is empty."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(c.cast("string"), F.lit("")) for c in cells.values())), F.lit(" |"))
    head = rows.sparkSession.createDataFrame([(0, "", f"| {' | '.join(cells)} |"), (1, "", f"|{'---|' * len(cells)}")], "part int, sort_key string, value string")
    return head.unionByName(rows.select(F.lit(2).alias("part"), F.col(order).cast("string").alias("sort_key"), line.alias("value")))


def write_report(lines: DataFrame, path: str) -> None:
    """The lines of table_lines() as text files, whose names follow their order."""
    lines.orderBy("part", "sort_key").select("value").write.mode("overwrite").text(path)


def write_records(rows: DataFrame, path: str, by: str) -> None:
    """Rows as lines of JSON in a folder for each value of by; null fields are left out."""
    rows.write.mode("overwrite").partitionBy(by).json(path)


class ResumableTable:
    """Rows in a folder that are written once for each key, however often a run breaks off and begins again.

    An append writes its rows as a batch, by Spark's own commit, and then names the batch in the manifest by one new file,
    whose creation is the commit. A batch that the manifest doesn't name was cut off: it is not read, and goes with the next
    append. One append at a time.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, qualified(spark, path), keys
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.fs = self.hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self.hadoop.Path(f"{self.path}/{folder}")
        return sorted(f.getPath().getName() for f in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def read(self, schema) -> DataFrame:
        """The rows of all batches that are committed."""
        batches = [f"{self.path}/batches/{b}" for b in self._names("manifest")]
        return self.spark.read.schema(schema).parquet(*batches) if batches else self.spark.createDataFrame([], schema)

    def missing(self, rows: DataFrame) -> DataFrame:
        """The rows whose keys no committed batch has."""
        done = self.read(rows.schema).select(*(F.col(k).alias(f"_{k}") for k in self.keys)).distinct()
        on = F.lit(True)
        for k in self.keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
        return rows.join(done, on, "left_anti")

    def append(self, rows: DataFrame) -> None:
        """Adds the rows of keys that are not there yet; all rows of a key come in one append."""
        named = set(self._names("manifest"))
        for cut_off in set(self._names("batches")) - named:
            remove(self.spark, f"{self.path}/batches/{cut_off}")
        batch = uuid.uuid4().hex
        self.missing(rows).write.parquet(f"{self.path}/batches/{batch}")
        self._commit(batch)

    def _commit(self, batch: str) -> None:
        self.fs.mkdirs(self.hadoop.Path(f"{self.path}/manifest"))
        self.fs.create(self.hadoop.Path(f"{self.path}/manifest/{batch}"), False).close()


def defect_rows(keys: DataFrame, defects: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Rows of a defect table: the defects (rosdep_key, type, ...) with status ok, B.2a as B.2, and one row with status
    no_issues for a key without any; keys that failed have none, so that they are tried again."""
    keys = keys.select("rosdep_key").distinct()
    if failed is not None:
        keys = keys.join(failed.select("rosdep_key"), "rosdep_key", "left_anti")
    kind = F.when(F.col("type") == "B.2a", "B.2").otherwise(F.coalesce("type", F.lit("")))
    rows = keys.join(defects.withColumn("_is", F.lit(True)), "rosdep_key", "left")
    return rows.withColumns({"type": kind, "status": F.when(F.col("_is"), "ok").otherwise("no_issues")}).drop("_is")


def write_csv(rows: DataFrame, path: str) -> None:
    """Rows as CSV files with a header, quoted as formats.csv_rows() reads them."""
    from .formats import CSV

    rows.write.mode("overwrite").options(header=True, **CSV).csv(path)
