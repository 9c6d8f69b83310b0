"""Language identification (operator 2): sparse multinomial logistic regression on TF-IDF character
n-grams, trained by follow-the-regularised-leader with elastic-net penalties, then temperature-calibrated.

* Features: the text in lower case, every character that is not a letter taken as a space, runs of
  spaces as one; n-grams of one to three characters, hashed to ``BUCKETS`` buckets, weighted
  (1 + ln tf) * idf, each text scaled to length one.
* Document frequencies come from all training documents (one pass; a row per bucket and task, summed).
* The regression is fitted on a bounded sample of labelled rows: about ``sample_per_lang`` texts of each
  language, and ``SAMPLE`` of all, by hash of the row. A fifth of the sample is kept for the temperature.
* Prediction reads whole texts and needs no shuffle.

Defined results: ``und`` with score 0 for a text that is null, empty or has no letter; a table without a
labelled training text gives ``und`` everywhere; rows with a null lang train nothing; repeated rows each
give a row; a null doc_id counts as a training row.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqforge.llm.common import chunks, held_out, small_batches, texts

BUCKETS = 1 << 16
SAMPLE_PER_LANG, SAMPLE = 2000, 16_000
UND = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code point -> itself if a letter, else space."""
    t = np.full(sys.maxunicode + 1, 32, np.uint32)
    for c in range(sys.maxunicode + 1):
        if chr(c).isalpha():
            t[c] = c
    return t


def _hash(parts: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(parts[0]), len(parts), np.uint32)
    for p in parts:
        h = (h ^ p) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
    return (h * np.uint32(0x9E3779B1)) >> np.uint32(16)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's n-grams, ascending, and how often each occurs; none if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = _letters()[points]
    points = np.concatenate([[np.uint32(32)], points, [np.uint32(32)]]).astype(np.uint32)
    points = points[(points != 32) | np.concatenate([[True], points[:-1] != 32])]
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = [points, points[:-1], points[1:], points[:-2], points[1:-1], points[2:]]
    total = np.bincount(np.concatenate([_hash(grams[:1]), _hash(grams[1:3]), _hash(grams[3:])]), minlength=BUCKETS)
    at = np.nonzero(total)[0]
    return at, total[at]


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = counts(text)
    x = (1 + np.log(n)) * idf[at]
    length = np.sqrt((x * x).sum())
    return at, x / length if length > 0 else x


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents holding each bucket, over all rows of ``docs``, and the number of rows with a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS + 1, np.int64), 0
        for b in chunks(batches):
            for t in texts(b):
                at, _ = counts(t)
                df[at] += 1
                n += len(at) > 0
        df[BUCKETS] = n
        at = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["bucket", "n"])

    rows = small_batches(docs.select("text")).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS + 1, np.int64)
    got = rows.toPandas()   # at most BUCKETS + 1 rows
    out[got["bucket"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out[:BUCKETS], int(out[BUCKETS])


class Ftrl:
    """Follow the regularised leader (proximal) for a multinomial logistic regression."""

    def __init__(self, classes: int, alpha: float = 0.1, beta: float = 1.0, l1: float = 0.01, l2: float = 0.1):
        self.z, self.n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[y] -= 1
        g = x[:, None] * p[None, :]
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden-section search on its logarithm."""
    if not len(y):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))
        return -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).mean()

    a, b, g = np.log(0.05), np.log(20.0), (5 ** 0.5 - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


class Model:
    """Fitted languages, idf, weights and temperature; small enough to go to every task (its size is
    BUCKETS * languages numbers)."""

    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, t: float):
        self.langs, self.idf, self.weights, self.t = langs, idf.astype(np.float64), weights.astype(np.float32), t

    def predict(self, text: str) -> tuple[str, float]:
        at, x = features(text, self.idf)
        if not len(at) or not self.langs:
            return UND, 0.0
        p = softmax((x @ self.weights[at]) / self.t)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def fit(train: DataFrame, sample_per_lang: int = SAMPLE_PER_LANG, epochs: int = 4) -> Model:
    """Fit on ``train`` (text, lang). All its rows give the document frequencies; the regression takes a
    sample of about ``sample_per_lang`` rows of each language (fewer if there are so many languages that it
    would pass ``SAMPLE``), by hash of text and lang; equal ones are one row of it, so the bound holds whatever repeats."""
    train = train.select("text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    per_lang = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    df, n = document_frequencies(train)
    idf = np.log((1 + n) / (1 + df)) + 1
    langs = sorted(per_lang)
    if not langs or not n:
        return Model([], idf, np.zeros((BUCKETS, 1)), 1.0)
    most = min(sample_per_lang, max(1, SAMPLE // len(langs)))
    unit = F.shiftrightunsigned(F.xxhash64("text", "lang"), 11) / F.lit(float(1 << 53))
    share = F.lit(0.0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, most / per_lang[lang]))).otherwise(share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            got = [features(t, idf) for t in texts(b)]
            yield pa.RecordBatch.from_arrays(
                [b.column("unit"), b.column("lang"), pa.array([a.tolist() for a, _ in got], pa.list_(pa.int32())),
                 pa.array([x.tolist() for _, x in got], pa.list_(pa.float32()))], ["unit", "lang", "at", "x"])

    rows = (train.withColumn("unit", unit).where(F.col("unit") < share).select("unit", "lang", "text").dropDuplicates(["unit", "lang"])
            .mapInArrow(run, "unit double, lang string, at array<int>, x array<float>").toArrow())
    order = np.argsort(rows["unit"].to_numpy() * len(langs) % 1.0, kind="stable")   # mixed, the same every time
    at = rows["at"].combine_chunks()
    cut, at = at.offsets.to_numpy(), at.values.to_numpy()
    x = rows["x"].combine_chunks().values.to_numpy()     # single precision: only a row at a time is widened
    y = np.array([langs.index(v) for v in rows["lang"].to_pylist()], np.int64)
    del rows
    pa.default_memory_pool().release_unused()
    keep = [int(i) for i in order if cut[i + 1] > cut[i]]
    calib, learn = keep[::5], [i for k, i in enumerate(keep) if k % 5] or keep
    model = Ftrl(len(langs))
    for _ in range(epochs):
        for i in learn:
            s = slice(cut[i], cut[i + 1])
            model.learn(at[s], x[s].astype(np.float64), y[i])
    w = model.weights()
    logits = np.array([x[cut[i]:cut[i + 1]].astype(np.float64) @ w[at[cut[i]:cut[i + 1]]] for i in calib]).reshape(-1, len(langs))
    return Model(langs, idf, w, temperature(logits, y[calib]))


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, ``lang_pred`` and ``score`` of every row; only the column text is looked at."""
    src = small_batches(docs.select(*[F.col(c) for c in keep], F.col("text").alias("_text")))
    schema = docs.select(*keep).withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in chunks(batches):
            got = [m.predict(t) for t in texts(b, "_text")]
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in keep] + [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                [*keep, "lang_pred", "score"])

    return src.mapInArrow(run, schema)


def is_held_out(doc_id: Column) -> Column:
    return held_out(doc_id, 4, 2)


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(~is_held_out(F.col("doc_id"))))
    return predict(docs, model).withColumn("held_out", is_held_out(F.col("doc_id")))
