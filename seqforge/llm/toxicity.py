"""Toxicity by a weighted lexicon (operator 10).

* Folding: lower case; compatibility forms, Cyrillic and Greek look-alikes to Latin; zero-width characters
  out; digits and signs that stand for letters to those letters (0 o, 1 i, 3 e, 4 a, 5 s, 7 t, 8 b, @ a,
  $ s, and ! within a word i); l and | to i, since 1 stands for both. Lexicon and texts are folded alike.
* Lexicon: beginnings of words (``PREFIX`` letters) and whole words, learned from labelled documents. Their
  weight is the lower confidence bound of the log odds of being in a toxic document; nested beginnings are
  reduced to the telling one. Near copies would count as many witnesses for the same words, so of documents
  that agree in one of ``SIGNATURES`` min-hashes of five-word shingles one teaches.
* Exception phrases: the word of a hit, alone or with the word before or after it, if several clean
  documents show it and no toxic one does. A word inside an exception phrase does not count, neither when a
  text is scored nor when the weights are learned: entries that lean towards toxic documents at all give the
  phrases, then all entries are counted again without them.
* Matching: an Aho-Corasick automaton over the folded text; a hit must begin a word; of the hits that begin
  at one place the heaviest counts, and the same word counts once.
* Score: a logistic curve over the logarithms of the summed weight and of the summed weight by length
  (per 1,000 words), fitted on labelled documents that the lexicon has not seen.

The lexicon is learned from a bounded sample, about ``SAMPLE`` labelled documents of either label (by hash
of the id); its ids are broadcast, so no document is shuffled. Every document is scored on its whole text.

Defined results: a null or empty text scores as a text without hits; a null doc_id is scored and teaches
nothing; an id labelled more than once counts as toxic if any label says so; labels other than 0 and 1 are
left out; without labels every score is 0; repeated rows each give a row; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqforge.llm.common import chunks, held_out, small_batches, stored, texts

SAMPLE = 8000           # labelled documents of either label, about
PREFIX = range(3, 9)
LEAST_WEIGHT, LEAST_DOCS = 2.5, 3
SIGNATURES, SHINGLE = 3, 5
LEANING, EXCEPTION_DOCS = 0.5, 5
THRESHOLD = 0.7

# Look-alikes and substitutions.
CYRILLIC, CYRILLIC_AS = "абвгдеёзикмнорстухіјѕһԁԛԝѵ", "a6brdee3ukmhopctyxijshdqwv"
GREEK, GREEK_AS = "αβγεηικνορτυχω", "abyenikvoptuxw"
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "l": "i", "|": "i"}

_ALIKE = str.maketrans(CYRILLIC + GREEK, CYRILLIC_AS + GREEK_AS)
_FOREIGN = re.compile("[Ͱ-ϿЀ-ԯ]")
_COMPATIBLE = re.compile("[ª²³¹ºʰ-ʸᴀ-ᶿ⁰-ₜ℀-⅏①-⓿ﬀ-ﬆ！-～\U0001d400-\U0001d7ff\U0001f130-\U0001f189]")
_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_WITHIN = re.compile(r"(?<=\w)!(?=\w)")
_WORD = re.compile(r"\w+")
END = "\n"              # marks the end of a whole-word entry


def fold(text: str) -> str:
    if not text.isascii():
        if _HIDDEN.search(text):
            text = _HIDDEN.sub("", text)
        if _COMPATIBLE.search(text):
            text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if not text.isascii() and _FOREIGN.search(text):
        text = text.translate(_ALIKE)
    if "!" in text:
        text = _WITHIN.sub("i", text)
    for a, b in SIGNS.items():
        text = text.replace(a, b)
    return text


def entries(text: str, spared: list[tuple[int, int]] = ()) -> set[str]:
    """Beginnings of the folded text's words, and the words themselves with ``END``; words inside the places
    ``spared`` are left out."""
    words = {m[0] for m in _WORD.finditer(text) if not _inside(m.start(), spared)} if spared else set(_WORD.findall(text))
    out = {w[:k] for w in words for k in PREFIX if len(w) >= k}
    out.update(w + END for w in words if len(w) >= PREFIX[0])
    return out


def _inside(place: int, spans: list[tuple[int, int]]) -> bool:
    return any(a <= place <= b for a, b in spans)


class Lexicon:
    """Weights of entries, exception phrases, and the logistic curve's three numbers."""

    def __init__(self, weights: dict[str, float], exceptions: set[str], curve: tuple[float, float, float] | None):
        self.weights, self.exceptions, self.curve = weights, exceptions, curve
        self._automaton = None

    def __getstate__(self):
        return self.weights, self.exceptions, self.curve

    def __setstate__(self, state):
        self.weights, self.exceptions, self.curve = state
        self._automaton = None

    def _search(self, text: str):
        if self._automaton is None:
            a = ahocorasick.Automaton()
            kinds: dict[str, list] = {}
            for e, w in self.weights.items():
                kinds.setdefault(e.removesuffix(END), []).append((w, e.endswith(END)))
            for p in self.exceptions:
                kinds.setdefault(p, []).append((None, True))
            for p, k in kinds.items():
                a.add_word(p, (len(p), k))
            a.make_automaton()
            self._automaton = a
        return self._automaton.iter(text)

    def found(self, text: str) -> tuple[dict[int, float], list[tuple[int, int]]]:
        """In a folded text: the heaviest weight at each place where entries begin, and the (first, last)
        places of exception phrases."""
        if not self.weights and not self.exceptions:
            return {}, []
        inside = lambda i: 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for last, (n, kinds) in self._search(text):
            start = last - n + 1
            if inside(start - 1):
                continue
            for w, whole in kinds:
                if whole and inside(last + 1):
                    continue
                if w is None:
                    spared.append((start, last))
                else:
                    best[start] = max(w, best.get(start, 0.0))
        return best, spared

    def hits(self, text: str) -> list[tuple[int, float]]:
        """Places and weights of the hits in a folded text."""
        best, spared = self.found(text)
        return sorted((s, w) for s, w in best.items() if not _inside(s, spared))

    def measures(self, text: str) -> tuple[float, float]:
        """Logarithms of the summed weight, and of the summed weight for 1,000 words, of a raw text."""
        text = fold(text)
        total = sum({_WORD.match(text, at)[0]: w for at, w in self.hits(text)}.values())
        if not total:
            return 0.0, 0.0
        return float(np.log1p(total)), float(np.log1p(1000 * total / max(len(text.split()), 1)))

    def score(self, text: str) -> float:
        if self.curve is None:
            return 0.0
        a, b, c = self.curve
        x, y = self.measures(text)
        return float(1 / (1 + np.exp(-np.clip(a + b * x + c * y, -500, 500))))


def _phrases(text: str, place: int) -> list[str]:
    """The word at ``place``, alone, with the word before, with the word after."""
    word = _WORD.match(text, place)
    after = _WORD.search(text, word.end())
    before = None
    for before in _WORD.finditer(text, max(0, place - 60), place):   # noqa: B007 - the last one counts
        pass
    out = [word[0]]
    if before and not text[before.end():place].strip(" "):
        out.append(text[before.start():word.end()])
    if after and not text[word.end():after.start()].strip(" "):
        out.append(text[place:after.end()])
    return out


def signatures(text: str) -> list[int]:
    """Min-hashes of the text's shingles of words (fewer words: the whole text)."""
    words = text.encode("utf-8", "surrogatepass").split()
    parts = [b" ".join(words[i:i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))]
    return [min(xxhash.xxh64_intdigest(p, seed) for p in parts) >> 1 for seed in range(SIGNATURES)]


def _one_of_each(rows: DataFrame) -> DataFrame:
    """(text, toxic) of ``rows``: one of the documents of a label that share a signature."""
    names = [f"s{i}" for i in range(SIGNATURES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            got = [signatures(t) for t in texts(b)]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array([g[i] for g in got], pa.int64()) for i in range(SIGNATURES)]], [*b.schema.names, *names])

    signed = rows.mapInArrow(run, "text string, toxic int, " + ", ".join(f"{n} bigint" for n in names))
    for n in names:
        signed = signed.dropDuplicates(["toxic", n])
    return signed.select("text", "toxic")


def _counted(rows: DataFrame, of) -> DataFrame:
    """How many documents of each label have each key that ``of`` gives for a folded text; counted in the
    task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()

        def flush():
            keys = [*n]
            out = pa.RecordBatch.from_arrays([pa.array([k for _, k in keys], pa.string()), pa.array([y for y, _ in keys], pa.int32()),
                                              pa.array([n[k] for k in keys], pa.int64())], ["key", "toxic", "n"])
            n.clear()
            return out

        for b in chunks(batches, 64):
            for y, t in zip(b.column("toxic").to_pylist(), texts(b), strict=True):
                n.update((y, k) for k in of(fold(t)))
            if len(n) > 400_000:
                yield flush()
        yield flush()

    return rows.mapInArrow(run, "key string, toxic int, n bigint").groupBy("key", "toxic").agg(F.sum("n").alias("n"))


def _telling(weights: dict[str, float], toxic: dict[str, int]) -> dict[str, float]:
    """Of nested beginnings: the longest that toxic documents have as often; then no longer one unless it is
    clearly heavier than a shorter one kept."""
    kept = dict(weights)
    for e in sorted(weights, key=len, reverse=True):
        up = e[:-1]
        if up in kept and not e.endswith(END) and toxic[e] >= 0.95 * toxic[up]:
            del kept[up]
    for e in sorted(kept, key=len, reverse=True):
        body = e.removesuffix(END)
        ups = [body[:k] for k in PREFIX if k < len(body) or (e.endswith(END) and k == len(body))]
        if any(u in kept and kept[u] >= kept[e] - 0.5 for u in ups):
            del kept[e]
    return kept


def _passing(counted: DataFrame, n_toxic: int, n_clean: int, least: float) -> tuple[dict[str, int], dict[str, int]]:
    """Toxic and clean documents of every entry of ``counted`` that reaches the weight ``least``; all entries
    are weighed in Spark, and those that pass are bounded by the labelled sample."""
    t, c = (F.coalesce(F.sum(F.when(F.col("toxic") == y, F.col("n"))), F.lit(0)) for y in (1, 0))
    both = counted.groupBy("key").agg(t.alias("t"), c.alias("c")).where(F.col("t") >= LEAST_DOCS)
    t, c = F.col("t") + 0.5, F.col("c") + 0.5
    weight = F.log(t / F.lit(n_toxic + 1)) - F.log(c / F.lit(n_clean + 1)) - F.sqrt(1 / t + 1 / c)
    got = both.where(weight >= least - 1e-6).collect()     # _weights decides at the border
    return {r["key"]: r["t"] for r in got}, {r["key"]: r["c"] for r in got}


def _weights(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int, least: float = LEAST_WEIGHT) -> dict[str, float]:
    out = {}
    for e, t in toxic.items():
        c = clean.get(e, 0)
        odds = np.log((t + 0.5) / (n_toxic + 1)) - np.log((c + 0.5) / (n_clean + 1))
        w = odds - np.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
        if t >= LEAST_DOCS and w >= least:
            out[e] = float(w)
    return _telling(out, toxic)


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression with a small quadratic penalty, by Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        ridge = np.array([1e-6, 1e-3, 1e-3])
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge), a.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1]), float(w[2])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """A lexicon from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic): about ``sample`` labelled ids of
    either label; three quarters teach the entries, the rest the curve."""
    spark = small_batches(docs).sparkSession
    named = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    n = {r["toxic"]: r["n"] for r in named.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n:
        return Lexicon({}, set(), None)
    unit = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(10)), 11) / F.lit(float(1 << 53))
    share = F.when(F.col("toxic") == 1, F.lit(sample / n.get(1, 1))).otherwise(F.lit(sample / n.get(0, 1)))
    few = named.where(unit < share).select("doc_id", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(4)) > 0).alias("teaches"))
    # About 2 * sample ids, whatever the table's size, and one text of each (the least hash), written once.
    rows = stored(docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").groupBy("doc_id", "toxic", "teaches")
                  .agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "toxic", "teaches"), "labelled")
    teach, rest = stored(_one_of_each(rows.where("teaches").select("text", "toxic")), "teaching"), _one_of_each(rows.where(~F.col("teaches")).select("text", "toxic"))
    size = {r["toxic"]: r["n"] for r in teach.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    size = size.get(1, 0), size.get(0, 0)
    toxic, clean = _passing(_counted(teach, entries), *size, LEANING)
    leaning = spark.sparkContext.broadcast(Lexicon(_weights(toxic, clean, *size, LEANING), set(), None))
    around = _counted(teach, lambda t: {p for at, _ in leaning.value.hits(t) for p in _phrases(t, at)})
    around = around.groupBy("key").pivot("toxic", [0, 1]).agg(F.sum("n"))
    exceptions = {r["key"] for r in around.where((F.col("0") >= EXCEPTION_DOCS) & F.col("1").isNull()).select("key").collect()}
    if exceptions:
        plain = spark.sparkContext.broadcast(Lexicon({}, exceptions, None))
        toxic, clean = _passing(_counted(teach, lambda t: entries(t, plain.value.found(t)[1])), *size, LEAST_WEIGHT)
    lexicon = Lexicon(_weights(toxic, clean, *size), exceptions, None)
    sent = spark.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            got = [sent.value.measures(t) for t in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64())], ["toxic", "x", "y"])

    got = rest.select("toxic", "text").mapInArrow(run, "toxic int, x double, y double").toPandas()
    lexicon.curve = _curve(got[["x", "y"]].to_numpy(), got["toxic"].to_numpy(float))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, and the score of every whole text."""
    src = small_batches(docs.select(*[F.col(c) for c in keep], F.col("text").alias("_text")))
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            got = [sent.value.score(t) for t in texts(b, "_text")]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(got, pa.float64())], [*keep, "score"])

    return src.mapInArrow(run, docs.select(*keep).withColumn("score", F.lit(0.0)).schema)


def is_held_out(doc_id: Column) -> Column:
    return held_out(doc_id, 3, 1)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    lexicon = learn(docs, labels.where(~is_held_out(F.col("doc_id"))))
    return score(docs, lexicon).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score",
                                       (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
