"""Shared pieces of the training-data operators: text folding, row chunks, written tables, crc32 splits."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqforge.session import stored

__all__ = ["ASCII_UPPER", "ASCII_LOWER", "WORD", "chunks", "held_out", "offsets", "small_batches", "stored", "texts", "word_count"]

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
#: A word is a run of characters other than space and U+0009 to U+000D.
WORD = "[^\\x20\\x09-\\x0D]+"


def chunks(batches: Iterator[pa.RecordBatch], rows: int = 256, size: int = 1 << 22, name: str = "text") -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to a few rows, so that the Python objects made from them stay small; where there is a
    column ``name`` of strings, also to about ``size`` bytes of it (or one row)."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            part = batch.slice(i, rows)
            if name not in part.schema.names or not pa.types.is_string(part.schema.field(name).type):
                yield part
                continue
            n = offsets(pc.fill_null(pc.binary_length(part.column(name)), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < part.num_rows:
                upto = max(int(np.searchsorted(n, n[at] + size, "right")) - 1, at + 1)
                yield part.slice(at, upto - at)
                at = upto


def reach(spark: SparkSession) -> None:
    """Let the Python workers import this package, wherever the driver was started: by the search path on one
    machine, by shipping the package's files on a cluster (unless PYTHONPATH names its folder already)."""
    root, sc = Path(__file__).resolve().parents[2], spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    if re.fullmatch(r"local(\[.*\])?", sc.master):
        paths = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
        sc.environment["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([*paths, str(root)]))
    elif not getattr(sc, "_package_sent", False):
        package = __name__.split(".")[0]
        name = f"{tempfile.mkdtemp()}/{package}.zip"     # read by the driver alone, which serves it to the executors
        with zipfile.ZipFile(name, "w") as z:
            for f in (root / package).rglob("*.py"):
                z.write(f, f.relative_to(root))
        sc.addPyFile(name)
        sc._package_sent = True


def small_batches(df: DataFrame, rows: int = 1024) -> DataFrame:
    """``df``; whole texts go to Python at most ``rows`` at a time from now on (a setting of the session), so
    that neither side of the pipe holds many long texts."""
    reach(df.sparkSession)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(key, "10000")) <= rows:
        conf.set(key, str(rows))
    return df


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column's strings; null counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def offsets(lengths) -> np.ndarray:
    """0, then the running sums of ``lengths``."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id as text leaves ``remainder``; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def word_count(text: Column) -> Column:
    """Number of words (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def with_row_id(df: DataFrame, label: str) -> DataFrame:
    """``df`` written with a unique ``row_id`` (fixed by the writing)."""
    return stored(df.withColumn("row_id", F.monotonically_increasing_id()), label)
