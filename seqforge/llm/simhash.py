"""SimHash near-duplicates by bit-sliced comparison (operator 1).

1. ``fingerprints``: a 64-bit SimHash per document, one pass, no shuffle.
2. Equal fingerprints become one representative (partial aggregation, so a group of copies with a third
   of all rows shrinks before it is shuffled).
3. ``links``: representatives within ``max_bits`` differing bits. The 64 bits are cut into
   ``max_bits + 2`` blocks; two fingerprints that differ in at most ``max_bits`` bits agree in at least
   two blocks, so every pair of blocks is a join key and no link is lost. Keys with many members are cut
   into tiles of bounded size, each pair of tiles being one piece of work.
   Within a key the fingerprints lie as vertical bit planes, 64 rows to a word: one XOR compares a row
   with 64 others in one bit, carry-save counters hold the distances, and a word whose 64 distances have
   all passed the radius is abandoned. Only a spanning forest of the links found is passed on (the
   classes do not need all pairs).
4. ``classes``: connected components by alternating large-star and small-star steps, each step cut by a
   written table; nothing is gathered on the driver but a count.

Defined results: null text counts as empty (fingerprint zero, linked like any other); a null doc_id keeps
its row and never becomes a class id unless its class has no other id; repeated rows each give a row; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqforge.llm.common import chunks, offsets, reach, small_batches, stored, texts

SEED = 42
TILE = 2048          # rows of a key compared with one another in one piece of work
BLOCKS_SLAB = 1 << 18  # compared words held in memory at once
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def simhash(text: str, shingle: int = 3, seed: int = SEED) -> int:
    """Fingerprint of one text, as an unsigned 64-bit integer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()   # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        at = offsets([len(w) + 1 for w in words]).tolist()
        view, digest = memoryview(joined), xxhash.xxh64_intdigest
        hashes = [digest(view[a:b - 1], seed) for a, b in zip(at[:-shingle], at[shingle:], strict=True)]
    counts = np.zeros(64, np.int64)
    h = np.array(hashes, np.uint64)
    for i in range(0, len(h), 1 << 16):   # bounded memory for very long texts
        part = h[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``fp`` (the fingerprint's 64 bits as a signed long)."""
    src = small_batches(docs.select(*[F.col(c) for c in keep], F.col(text).alias("_text")))
    schema = docs.select(*keep).withColumn("fp", F.lit(0).cast("bigint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            fp = np.array([simhash(t, shingle) for t in texts(b, "_text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(fp)], [*keep, "fp"])

    return src.mapInArrow(run, schema)


def _planes(fp: np.ndarray) -> np.ndarray:
    """(64, words): bit b of the fingerprints in vertical form, row r at bit r % 64 of word r // 64."""
    pad = -len(fp) % 64
    rows = np.concatenate([fp, np.zeros(pad, np.uint64)])
    bits = np.unpackbits(rows.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")   # (rows, 64)
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64)


def _near(planes: np.ndarray, fp: np.ndarray, q: np.ndarray, w: np.ndarray, lanes: np.ndarray, radius: int):
    """Pairs (row, row) with at most ``radius`` differing bits among the blocks: query row ``q[i]`` against
    the rows ``lanes[i]`` of word ``w[i]``."""
    n = int(radius).bit_length()
    digits = [np.zeros(len(q), np.uint64) for _ in range(n)]   # carry-save digits of the 64 distances
    over = ~lanes                                              # lanes whose distance has passed the radius
    for bit in range(64):
        mask = np.uint64(0) - ((fp[q] >> np.uint64(bit)) & np.uint64(1))
        carry = planes[bit][w] ^ mask
        for d in digits:
            d ^= carry
            carry &= ~d          # a digit that fell from 1 to 0 carries on
        over |= carry            # past 2**n - 1
        if bit % 8 == 7:
            limit, above, equal = radius, np.zeros(len(q), np.uint64), np.full(len(q), ONES)
            for k in range(n - 1, -1, -1):
                if not limit >> k & 1:
                    above |= equal & digits[k]
                    equal &= ~digits[k]
                else:
                    equal &= digits[k]
            over |= above
            alive = over != ONES
            if not alive.all():   # abandon blocks in which every distance exceeds the radius
                q, w, over = q[alive], w[alive], over[alive]
                digits = [d[alive] for d in digits]
                if not len(q):
                    break
    hits = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") if len(q) else np.zeros((0, 64), np.uint8)
    i, lane = np.nonzero(hits)
    return q[i], w[i] * 64 + lane


def compare(fp: np.ndarray, first: np.ndarray, last: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of rows with at most ``radius`` differing bits; row a is compared with the rows
    ``first[a] <= b < last[a]``."""
    planes = _planes(fp)
    words = np.where(last > first, (last + 63) // 64 - first // 64, 0)
    rows = np.nonzero(words)[0]
    found_a, found_b = [], []
    ends = np.cumsum(words[rows])
    start = 0
    while start < len(rows):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + BLOCKS_SLAB, "right")))
        part = rows[start:stop]
        count = words[part]
        q = np.repeat(part, count)
        w = np.arange(len(q)) - np.repeat(offsets(count)[:-1], count) + np.repeat(first[part] // 64, count)
        lo = np.clip(first[q] - w * 64, 0, 64)
        hi = np.clip(last[q] - w * 64, 0, 64)
        below = lambda k: np.where(k >= 64, ONES, (np.uint64(1) << np.minimum(k, 63).astype(np.uint64)) - np.uint64(1))
        a, b = _near(planes, fp, q, w, below(hi) & ~below(lo), radius)
        found_a.append(a)
        found_b.append(b)
        start = stop
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (np.zeros(0, np.int64),) * 2


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row of each row's component under the links (a, b): label spreading with pointer jumps."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        live = ra != rb
        if not live.any():
            break
        a, b, ra, rb = a[live], b[live], ra[live], rb[live]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _keys(max_bits: int):
    """Bit ranges of the ``max_bits + 2`` blocks, and the pairs of blocks that serve as keys."""
    n = max_bits + 2
    cut = [64 * i // n for i in range(n + 1)]
    return cut, list(combinations(range(n), 2))


def links(reps: DataFrame, max_bits: int = 3, tile: int = TILE) -> DataFrame:
    """Links (a, b), a > b, between the distinct fingerprints ``reps.fp``: for every key a spanning forest
    of the pairs within ``max_bits`` bits, so that their transitive closure is that of all such pairs."""
    cut, pairs = _keys(max_bits)
    reach(reps.sparkSession)

    def block(i: int):
        width = cut[i + 1] - cut[i]
        return F.shiftrightunsigned(F.col("fp"), cut[i]).bitwiseAND(F.lit((1 << width) - 1))

    keys = [(F.lit(k).cast("bigint") * (1 << 52)) + block(i) * (1 << 26) + block(j) for k, (i, j) in enumerate(pairs)]
    keyed = stored(reps.select("fp", F.explode(F.array(*keys)).alias("key")), "simhash-keys")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = keyed.join(sizes, "key")
    # Members of a key fall into parts of about ``tile`` rows; each pair of parts is one piece of work.
    parts = F.ceil(F.col("n") / tile)
    mine = F.pmod(F.xxhash64("fp"), parts)
    rows = (rows.withColumn("parts", parts).withColumn("mine", mine)
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
            .select("key", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "fp"))
    dealt = (rows.repartition(F.col("key"), F.col("x"), F.col("y"))
             .sortWithinPartitions("key", "x", "y", "mine", "fp"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush(rows: np.ndarray):
            """``rows``: whole pieces of work, columns key, x, y, mine, fp."""
            n = len(rows)
            piece = np.ones(n, bool)
            piece[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
            starts = np.nonzero(piece)[0]
            end = np.append(starts[1:], n)[np.cumsum(piece) - 1]
            # Within one part: the rows after it; between two parts: from x to all rows of y.
            split = np.ones(n, bool)
            split[1:] = piece[1:] | (rows[1:, 3] != rows[:-1, 3])
            part_end = np.append(np.nonzero(split)[0][1:], n)[np.cumsum(split) - 1]
            first = np.where(rows[:, 1] == rows[:, 2], np.arange(n) + 1, part_end)
            fp = rows[:, 4].copy().view(np.uint64)
            a, b = compare(fp, first, end, max_bits)
            root = forest(n, a, b)
            i = np.nonzero(root != np.arange(n))[0]
            x, y = rows[i, 4], rows[root[i], 4]
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], ["a", "b"])

        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "x", "y", "mine", "fp")], axis=1))
            rows = np.concatenate(held)
            cuts = np.nonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1))[0]
            if len(cuts) and len(rows) >= 1 << 14:
                done = cuts[-1] + 1
                yield flush(rows[:done])
                rows = rows[done:]
            held = [rows]
        if held and len(rows := np.concatenate(held)):
            yield flush(rows)

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): ``root`` is the smallest node of its component.
    Alternating large-star and small-star steps; the number of steps grows with the logarithm of the
    component's size. Every step is written to the shared folder."""
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = (both.join(least, both.a == least.k).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        down = large.join(low, large.a == low.k)
        small = (down.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
                 .union(low.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct())
        nxt = stored(small, "links")
        # Done when every node has one link, to a node that has none downwards.
        deep = nxt.join(nxt.select(F.col("a").alias("k")).distinct(), F.col("b") == F.col("k"), "left_semi").select("a")
        forked = nxt.groupBy("a").count().where("count > 1").select("a")
        if deep.union(forked).isEmpty():
            return nxt.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now = nxt


def classes(docs: DataFrame, shingle: int = 3, max_bits: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: the columns ``keep`` (``doc_id`` among them), ``fp``, ``root`` (smallest
    fingerprint, as a signed number, of the class) and ``component_id`` (its smallest doc_id)."""
    prints = stored(fingerprints(docs, shingle, keep=keep), "fingerprints")
    reps = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "representatives")
    comp = components(links(reps, max_bits))
    rooted = (reps.join(comp, reps.fp == comp.node, "left")
              .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.select("fp", "root").join(named, "root")
    return prints.join(by_fp, "fp").select(*keep, "fp", "root", "component_id")


def op1_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classes(docs.select("doc_id", "text")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
