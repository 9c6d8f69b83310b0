"""Sinks and progress counters.

Writes are parallel (one file per task, ``maxRecordsPerFile`` caps file size) and counted in the
same job through ``Observation`` rather than a second scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, max_records_per_file: int = 1_000_000, mode: str = "overwrite",
                compression: str | None = None) -> dict:
    """JSON lines into a directory. Returns the manifest (rows written, path)."""
    obs = Observation("write_jsonl")
    w = df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode(mode).option(
        "maxRecordsPerFile", max_records_per_file)
    if compression:
        w = w.option("compression", compression)
    w.json(path)
    return {"path": path, "rows": obs.get["rows"]}


def observed(df: DataFrame, name: str = "progress", **metrics) -> tuple[DataFrame, Observation]:
    """Attach named counters (records, valid, bytes ...) to a plan; read ``obs.get`` after an action."""
    obs = Observation(name)
    cols = [c.alias(k) for k, c in metrics.items()] or [F.count(F.lit(1)).alias("records")]
    return df.observe(obs, *cols), obs


def line_progress(records: DataFrame, valid_col: str = "line") -> tuple[DataFrame, Observation]:
    """S16 for extraction: records, valid lines and decompressed bytes of the kept lines."""
    return observed(records, "extract_progress",
                    records=F.count(F.lit(1)),
                    valid=F.count(F.col(valid_col)),
                    bytes=F.coalesce(F.sum(F.octet_length(F.col(valid_col)) + 1), F.lit(0)))
