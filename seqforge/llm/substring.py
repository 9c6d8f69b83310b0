"""Substring dedup over sliding sentence spans (operator 4).

A sentence ends after a full stop, exclamation or question mark followed by white space, or at a line end. As a
sentence may be of any length, and its ends may be joined to other text, it is cut further at points that its
content alone defines: after every word of exactly ``CUT`` letters. What lies between two cuts is a unit. The spans
are the runs of consecutive units, one from every unit on: the shortest with ``WORDS`` words or more, which may be a single
long unit. So a passage that two documents share holds a span wherever ``WORDS`` words of it lie between two common cuts, be
it one long sentence, a list of short lines, or sentences of which only the middle is whole; ``OP4_SQL`` defines the same
spans. Spans are compared as words joined by single spaces, by their 64-bit hash.

Every run is hashed in one pass; spans that a document repeats itself are settled there. All hashes then
meet in one aggregation (smallest doc_id and count; a hash that a third of all documents share is reduced
in the tasks before it is shuffled) and one join that gives the documents with a non-first span. Every
sentence under a non-first span is cut out of its text; the first document by doc_id keeps it.

Defined results: null text counts as empty; rows with the same doc_id count as one document, so a span
they share is no repeat; rows with a null doc_id likewise, and they come after all ids; rows equal in
doc_id and text get the same result; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqforge.llm.common import chunks, offsets, small_batches, stored, texts

WORDS, CUT = 20, 7
_END = re.compile(f"[.!?][\\x20\\x09-\\x0d]+|\\n|(?<![^\\x20\\x09-\\x0d])[^\\x20\\x09-\\x0d]{{{CUT}}}[\\x20\\x09\\x0b-\\x0d]+")
_SPACE = re.compile("[\\x20\\x09-\\x0d]+")


def sentences(text: str) -> tuple[list[tuple[int, int]], list[str]]:
    """(start, end) of each unit in the text, with the white space after it, and its words joined by
    single spaces. Units without a word are left out."""
    cuts = [0, *(m.end() for m in _END.finditer(text)), len(text)]
    at, plain = [], []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        words = _SPACE.sub(" ", text[a:b]).strip(" ")
        if words:
            at.append((a, b))
            plain.append(words)
    return at, plain


def runs(plain: list[str]) -> Iterator[tuple[int, int, int]]:
    """(hash, first unit, number of units) of every span."""
    total = offsets([p.count(" ") + 1 for p in plain]).tolist()
    upto, n = 0, len(plain)
    for i in range(n):
        while upto <= n and total[min(upto, n)] - total[i] < WORDS:
            upto += 1
        if upto > n:
            return
        yield _hash(plain[i:upto]), i, upto - i


def _hash(parts: list[str]) -> int:
    h = xxhash.xxh64_intdigest("\n".join(parts).encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def spans(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, text_hash, n_sentences, the hashes of its distinct spans with their
    places (first unit * 64 + number of units, which is at most ``WORDS``), and the places of spans it repeats itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            count, hashes, places, again = [], [], [], []
            for t in texts(b):
                _, plain = sentences(t)
                first: dict[int, int] = {}
                own = []
                for h, i, n in runs(plain):
                    if h in first:
                        own.append(64 * i + n)
                    else:
                        first[h] = 64 * i + n
                count.append(len(plain))
                hashes.append(list(first))
                places.append(list(first.values()))
                again.append(own)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array(count, pa.int64()), pa.array(hashes, longs), pa.array(places, longs), pa.array(again, longs)],
                ["doc_id", "text_hash", "n_sentences", "hashes", "places", "again"])

    src = small_batches(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"))
    return src.mapInArrow(run, "doc_id bigint, text_hash bigint, n_sentences bigint, hashes array<bigint>, places array<bigint>, again array<bigint>")


def repeated(found: DataFrame) -> DataFrame:
    """doc_id, text_hash and place of every non-first span, from written ``spans``."""
    each = found.select("doc_id", "text_hash", F.explode(F.arrays_zip("hashes", "places")).alias("s")).select(
        "doc_id", "text_hash", F.col("s.hashes").alias("hash"), F.col("s.places").alias("place"))
    many = each.groupBy("hash").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("hash", "first")
    later = each.join(many, "hash").where(~F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "text_hash", "place")
    return later.unionByName(found.select("doc_id", "text_hash", F.explode("again").alias("place")))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_removed (both count units) and the remaining text of every document."""
    found = stored(spans(docs), "sentence-spans")
    cut = (repeated(found).groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("place")).alias("cut"))
           .withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"}))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    rows = rows.join(cut, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            left, total, removed = [], [], []
            for t, places in zip(texts(b), b.column("cut").to_pylist(), strict=True):
                at, _ = sentences(t)
                gone = np.zeros(len(at), bool)
                for p in places or ():
                    gone[p // 64:p // 64 + p % 64] = True
                parts, pos = [], 0
                for i in np.nonzero(gone)[0].tolist():
                    parts.append(t[pos:at[i][0]])
                    pos = at[i][1]
                left.append("".join([*parts, t[pos:]]))
                total.append(len(at))
                removed.append(int(gone.sum()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(left, pa.string())],
                                             ["doc_id", "n_sentences", "n_removed", "text"])

    return rows.select("doc_id", "text", "cut").mapInArrow(run, "doc_id bigint, n_sentences bigint, n_removed bigint, text string")


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


# A word of CUT letters with the blanks after it; run twice, as two such words share the blank between them.
_WORD_CUT = f"(^|[\\x20\\x09-\\x0d\\x01])([^\\x20\\x09-\\x0d\\x01]{{{CUT}}}[\\x20\\x09\\x0b-\\x0d]+)"
OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m1 AS (SELECT r, doc_id, regexp_replace(text, '([.!?][\\x20\\x09-\\x0d]+|\\n)', '\\1' || chr(1), 'g') AS t FROM d),
m2 AS (SELECT r, doc_id, regexp_replace(t, '{_WORD_CUT}', '\\1\\2' || chr(1), 'g') AS t FROM m1),
m3 AS (SELECT r, doc_id, regexp_replace(t, '{_WORD_CUT}', '\\1\\2' || chr(1), 'g') AS t FROM m2),
p AS (SELECT r, doc_id, unnest(string_split(t, chr(1))) AS piece, generate_subscripts(string_split(t, chr(1)), 1) AS k FROM m3),
q AS (SELECT *, trim(regexp_replace(piece, '[\\x20\\x09-\\x0d]+', ' ', 'g'), ' ') AS plain FROM p),
s AS (SELECT r, doc_id, k, plain, len(string_split(plain, ' ')) AS n, row_number() OVER (PARTITION BY r ORDER BY k) AS i FROM q WHERE plain <> ''),
w AS (SELECT *, sum(n) OVER (PARTITION BY r ORDER BY i) AS upto FROM s),
l AS (SELECT r, list(plain ORDER BY i) AS units FROM s GROUP BY r),
x AS (SELECT a.r, a.doc_id, a.i, b.i - a.i + 1 AS len, array_to_string(list_slice(l.units, a.i, b.i), chr(10)) AS span
      FROM w a JOIN w b ON b.r = a.r AND b.i BETWEEN a.i AND a.i + {WORDS} - 1
        AND b.upto - (a.upto - a.n) >= {WORDS} AND b.upto - b.n - (a.upto - a.n) < {WORDS} JOIN l ON l.r = a.r),
y AS (SELECT *, min(doc_id) OVER (PARTITION BY span) AS first, row_number() OVER (PARTITION BY r, span ORDER BY i) AS nth FROM x),
gone AS (SELECT DISTINCT r, unnest(range(i, i + len)) AS i FROM y WHERE doc_id IS DISTINCT FROM first OR nth > 1),
kept AS (SELECT q.r, string_agg(q.piece, '' ORDER BY q.k) AS text FROM q LEFT JOIN s USING (r, k) LEFT JOIN gone ON gone.r = q.r AND gone.i = s.i
         WHERE gone.i IS NULL GROUP BY q.r),
c AS (SELECT r, count(*) AS n_sentences FROM s GROUP BY r), g AS (SELECT r, count(*) AS n_removed FROM gone GROUP BY r)
SELECT doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_removed, 0) AS n_removed, coalesce(kept.text, '') AS text
FROM d LEFT JOIN c USING (r) LEFT JOIN g USING (r) LEFT JOIN kept USING (r)
"""
