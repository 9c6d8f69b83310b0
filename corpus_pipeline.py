"""Training corpus from documents: language, near-duplicates, secrets, mixing, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. All but the last return the columns of
``documents``; every result is written as Parquet and read again as the next stage's ``docs``. Further
columns of the input are dropped, so none can clash. Rows that repeat exactly count as one document in
``near_duplicates`` and as so many in the other stages; a null doc_id is kept like any other.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqforge.llm import langid, mixing, packing, secrets, simhash
from seqforge.llm.common import WORD, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SCORE = 0.5      # a document whose language is less likely than that is rejected
KEYS = ["_k1", "_k2"]
ORACLE_SQL = None      # fitted models and tokenizers: tests/llm/test_pipeline.py checks every stage


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with a 128-bit hash of the whole row."""
    docs = docs.select(*COLUMNS)
    return docs.withColumns({"_k1": F.xxhash64(*COLUMNS), "_k2": F.xxhash64(F.lit(1), *reversed(COLUMNS))})


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those whose language is unsure; a null lang becomes the
    predicted one. Without any labelled document nothing can be told and all documents with text stay."""
    docs = docs.select(*COLUMNS)
    model = langid.fit(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike("\\p{L}"))
    told = langid.predict(docs, model, tuple(COLUMNS))
    return (told.where((F.col("lang_pred") != langid.UND) & (F.col("score") >= LEAST_SCORE))
            .withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest doc_id stays (an id goes before null;
    equal ids: the smallest row hash)."""
    keyed = _keyed(docs)
    classes = simhash.classes(keyed, keep=("doc_id", *KEYS))
    first = (classes.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *KEYS)).alias("f"))
             .select(*[F.col(f"f.{k}").alias(k) for k in KEYS]))
    kept = keyed.dropDuplicates(KEYS).join(first.hint("shuffle_hash"), KEYS, "left_semi")
    return kept.select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret found; no document is dropped."""
    return secrets.redact(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: a document appears once for each round that takes all of it; a round that takes only
    its beginning gives those words, space-joined (one document for each source and round at most)."""
    keyed = _keyed(docs)
    taken = mixing.mix(keyed, ("doc_id", *KEYS)).select(*KEYS, "size", F.explode(F.array("taken0", "taken1")).alias("taken")).where("taken > 0")
    rows = keyed.dropDuplicates(KEYS).join(taken.hint("shuffle_hash"), KEYS)
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("taken").cast("int")), " ")
    whole = F.col("taken") == F.col("size")
    text = F.when(whole, F.col("text")).otherwise(part)
    chars = F.when(whole, F.col("n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return rows.select("doc_id", text.alias("text"), "lang", "source", chars.alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the encoded documents and their places in the sequences."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("language_id", language), ("simhash_dedup", near_duplicates), ("secret_scan", secret_scan),
          ("mix_sources", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
