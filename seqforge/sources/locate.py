"""Where a bad row came from: its file and line number.

A file is read in blocks (one, if its compression cannot be split). A line's number is the number of lines in the blocks of
its file before its own, plus its place in the block: rows of a block are numbered one after the other by
``monotonically_increasing_id``. So only a row per block is counted ahead, and only bad rows meet those counts.
A record is a line: quoted line ends inside CSV fields are not looked through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqforge.operators.project import CORRUPT


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                        F.monotonically_increasing_id().alias("id"), "value")


def located(spark: SparkSession, path: str, wanted) -> DataFrame:
    """(file, line from 1, value) of the lines for which ``wanted(value)`` holds."""
    rows = _lines(spark, path)
    blocks = rows.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return (rows.where(wanted(F.col("value"))).join(starts, ["file", "block"])
            .select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), "value"))


def _parsed(value: Column, schema: T.StructType, kind: str) -> Column:
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return F.from_json(value, full, options) if kind == "json" else F.from_csv(value, full.simpleString()[7:-1].replace(":", " "), options)


def bad_lines(spark: SparkSession, path: str, schema: T.StructType, kind: str = "json") -> DataFrame:
    """(file, line, value) of the lines that do not parse; blank lines are none. ``kind``: ``json`` (a record a line) or ``csv``
    (without its first line, the header)."""
    bad = located(spark, path, lambda v: (F.trim(v) != "") & _parsed(v, schema, kind)[CORRUPT].isNotNull())
    return bad.where("line > 1") if kind == "csv" else bad


def bad_report(spark: SparkSession, path: str, schema: T.StructType, kind: str = "json", first: int = 9) -> DataFrame:
    """The first bad lines of the whole input in (file, line) order, as an extraction run logs them."""
    return bad_lines(spark, path, schema, kind).orderBy("file", "line").limit(first)
