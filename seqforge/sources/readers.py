"""Sources (S1-S7): compressed CSV and nested JSONL scans with explicit schemas, malformed-row
tolerance, first-N heads and the byte-range slice.

zstd files are not splittable: one task decodes one file. Readers therefore repartition right
after the scan (``partitions``), and a many-file input is preferred over one large file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqforge.operators.ordering import running_total
from seqforge.operators.project import CORRUPT

MIB = 1024 * 1024

PUZZLE_CSV_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in
                                  ("PuzzleId", "FEN", "Moves", "Rating", "Themes", "GameUrl", "OpeningTags")])

PV = T.StructType([T.StructField("cp", T.IntegerType()), T.StructField("mate", T.IntegerType()),
                   T.StructField("line", T.StringType())])
EVAL = T.StructType([T.StructField("depth", T.IntegerType()), T.StructField("knodes", T.LongType()),
                     T.StructField("pvs", T.ArrayType(PV))])
EVAL_RECORD_SCHEMA = T.StructType([T.StructField("fen", T.StringType()),
                                   T.StructField("evals", T.ArrayType(EVAL))])
LINE_SCHEMA = T.StructType([T.StructField("fen", T.StringType()), T.StructField("line", T.StringType()),
                            T.StructField("depth", T.IntegerType()), T.StructField("knodes", T.LongType())])


def _spread(df: DataFrame, partitions: int | None) -> DataFrame:
    return df.repartition(partitions) if partitions else df


def scan_csv(spark: SparkSession, path: str, schema: T.StructType = PUZZLE_CSV_SCHEMA,
             partitions: int | None = None) -> DataFrame:
    """Header CSV (zstd or plain, by extension), all columns string; typing happens later (P1). A row
    with too few or too many fields has its raw text in ``_corrupt_record``; P1 makes it an error row if
    moves or themes are among what it lacks."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    df = (spark.read.schema(full).option("header", True).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", CORRUPT)
          .option("columnPruning", False).csv(path))     # a reader that skips columns does not see a short row
    return _spread(df, partitions)


def scan_jsonl(spark: SparkSession, path: str, schema: T.StructType = EVAL_RECORD_SCHEMA,
               partitions: int | None = None) -> DataFrame:
    """JSON lines with an explicit schema (no inference pass). Blank lines give no row; a
    malformed line gives a row with only ``_corrupt_record`` set."""
    full = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType())])
    df = (spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
          .json(path))
    return _spread(df, partitions)


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows without the corrupt column, bad rows with the raw text). Both are filters over the
    scan; nothing is persisted.

    Spark refuses a raw-file query whose only column is the corrupt one (a count of bad rows is such a
    query), so the test reads one more column, in a part that is always true.
    """
    other = next(c for c in df.columns if c != CORRUPT)
    bad = F.col(CORRUPT).isNotNull() & (F.xxhash64(other) >= F.lit(-(1 << 63)))
    return df.where(~bad).drop(CORRUPT), df.where(bad)


def scan_lines(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """S3: line records (M5); absent knodes -> 0."""
    df = spark.read.schema(LINE_SCHEMA).json(path)
    return _spread(df.withColumn("knodes", F.coalesce("knodes", F.lit(0).cast("bigint"))), partitions)


def scan_examples(spark: SparkSession, path: str, columns: list[str] | None = None,
                  predicate: Column | None = None) -> DataFrame:
    """An already built example table (parquet). Projection and predicate reach the scan."""
    df = spark.read.parquet(path)
    if predicate is not None:
        df = df.where(predicate)
    return df.select(*columns) if columns else df


def head_n(df: DataFrame, n: int, order: Column) -> DataFrame:
    """The first n records on a stable order key (the reference reads the file head)."""
    return df.orderBy(order).limit(n)


def byte_slice(df: DataFrame, order_col: str, record_bytes: Column, skip_mb: float = 0,
               target_mb: float = 500) -> DataFrame:
    """Records whose newline offset o (0-based, decompressed stream) is in [S, S+T), with S and T
    rounded up to whole 1 MiB reads, as a chunked reader sees them. ``order_col`` must be unique.

    Offsets come from (key, size) alone. The slice is a range of keys, so the records are fetched by a filter on
    the scan; only those of the slice meet their offsets."""
    import math
    s = math.ceil(skip_mb * MIB / MIB) * MIB
    t = math.ceil(target_mb * MIB / MIB) * MIB
    sizes = running_total(df.select(order_col, record_bytes.cast("bigint").alias("_size")), order_col, F.col("_size"), "_end")
    part = sizes.select(order_col, (F.col("_end") - 1).alias("newline_offset")).where((F.col("newline_offset") >= s) & (F.col("newline_offset") < s + t))
    ends = part.agg(F.min(order_col).alias("lo"), F.max(order_col).alias("hi"))
    inside = F.col(order_col).between(ends.select("lo").scalar(), ends.select("hi").scalar())
    return df.where(inside).join(part, order_col)
