"""Spark fixture views that are compositions of library operators (typed puzzles, best lines)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqforge.operators import project, sequences
from seqforge.plans import fixtures as fx


def v_puz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.good_rows(project.type_puzzles(fx.v_raw(spark, sf_dir)))


def v_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.min_len(sequences.best_line(fx.v_eval(spark, sf_dir)))
