"""Token-id files with Re-Pair grammar compression (operator 3).

``write`` sorts documents by id over range partitions, encodes them, and compresses shards of about
``SHARD`` ids: again and again frequent pairs of neighbouring ids are replaced by new symbols
(nonterminals), the most frequent first: each round takes the pairs down to 1 / ``STEP`` of the most
frequent one's count, left to right and without overlap, until no pair occurs ``MIN_PAIR`` times. A pair
never crosses the end of a document, so each document starts at a symbol.

A shard is one binary record (kept as a row of a Parquet table, so that any store Spark reaches can hold
it). Symbols are numbered densely, first the ids in use, then the rules, and every array is packed with as many bits as its
largest number needs: the ids in use, the rules (two symbols each), the number of ids each rule expands to, the symbols, the
documents' numbers of symbols and of ids, and the place of every ``SAMPLED``-th symbol among the ids. So a document
(``Shard.document``) or a span of ids (``Shard.span``) is decoded from its own symbols and the rules they reach.

``read`` decodes the files again and numbers the ids of all documents in ascending doc_id order.

Defined results: null text counts as empty and gives only the end id; null doc_ids sort first; documents
with the same id are ordered by text, repeated rows each keep a record; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqforge.llm.common import chunks, offsets, reach, small_batches, stored
from seqforge.llm.tokens import encoder

SHARD = 1 << 19       # ids of a shard; a longer document makes a longer shard
MIN_PAIR = 32         # a pair is replaced if it occurs so often in the shard
STEP = 64             # a round takes pairs down to this part of the most frequent one
SLOT_BITS = 18
TEXTS, MEMO = 2048, 600_000   # texts encoded at once, pieces a worker keeps
FIRST_RULE = 1 << 24  # symbols from here on are nonterminals
SAMPLED = 256         # symbols from one stored place to the next
MAGIC, VERSION = b"RPID", 2
NULL_ID = -(1 << 63)


def _alternate(at: np.ndarray) -> np.ndarray:
    """Indices into ``at`` (ascending): of each run of adjoining positions the first, third, fifth and so on."""
    start = np.ones(len(at), bool)
    start[1:] = np.diff(at) > 1
    begin = np.maximum.accumulate(np.where(start, at, 0))
    return np.nonzero((at - begin) & 1 == 0)[0]


def compress(ids: np.ndarray, starts: np.ndarray, min_pair: int = MIN_PAIR):
    """Re-Pair of ``ids``; documents begin at ``starts``. Returns symbols, their document starts, the
    rules and the expansion lengths of the rules.

    Pairs are counted in hash slots, for the pair that each slot stands for; pairs that share a slot with
    another wait for a later round, whose hash differs. When no slot has a frequent pair any more, an exact
    count decides whether one is left."""
    seq, starts = ids.astype(np.int32), starts.astype(np.int64)
    last = np.zeros(len(seq), bool)          # symbols that end a document: no pair begins there
    last[starts[starts > 0] - 1] = True
    last[-1:] = True
    rules: list[np.ndarray] = []
    made = rounds = 0
    while len(seq) > 1:
        rounds += 1
        left, right = seq[:-1].view(np.uint32), seq[1:].view(np.uint32)
        slot = (left * np.uint32(0x9E3779B1 + 2 * rounds) ^ right * np.uint32(0x85EBCA6B + 4 * rounds)) >> np.uint32(32 - SLOT_BITS)
        slot[last[:-1]] = 0                  # slot 0 takes the ends of documents, and no pair
        rough = np.bincount(slot, minlength=1 << SLOT_BITS)
        rough[0] = 0
        likely = np.nonzero((rough >= min_pair)[slot])[0]
        if not len(likely):
            break
        slot, code = slot[likely], seq[likely].astype(np.int64) << 32 | seq[likely + 1]
        stands = np.empty(1 << SLOT_BITS, np.int64)
        stands[slot] = code
        every, same = likely, np.nonzero(stands[slot] == code)[0]
        slot, likely = slot[same], likely[same]
        n = np.bincount(slot, minlength=1 << SLOT_BITS)
        best = int(n.max())
        if best < min_pair:                  # only pairs that share a slot look frequent: count them exactly
            stands, slot, n = np.unique(code, return_inverse=True, return_counts=True)
            likely, best = every, int(n.max())
            if best < min_pair:
                break
        chosen = np.nonzero(n >= max(min_pair, best // STEP))[0]
        symbol = np.full(len(n), -1, np.int32)
        symbol[chosen] = FIRST_RULE + made + np.arange(len(chosen), dtype=np.int32)
        new = symbol[slot]
        hit = np.nonzero(new >= 0)[0]
        first = _alternate(likely[hit])
        at = likely[hit][first]
        taken = stands[chosen]
        rules.append(np.stack([taken >> 32, taken & 0xFFFFFFFF], axis=1))
        made += len(taken)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq[at] = new[hit][first]
        last[at] = last[at + 1]
        seq, last = seq[keep], last[keep]
    ends = np.nonzero(last)[0]
    filled = np.diff(np.append(starts, len(ids))) > 0      # an empty document has no symbol
    sizes = np.zeros(len(starts), np.int64)
    sizes[filled] = np.diff(np.append(-1, ends))
    first = offsets(sizes)[:-1]
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    return seq.astype(np.uint32), first, table.astype(np.uint32), _rule_lengths(table)


def _rule_lengths(table: np.ndarray) -> np.ndarray:
    """Ids each rule expands to; a rule refers to earlier rules only."""
    n = np.full(len(table), -1, np.int64)
    while (n < 0).any():   # one pass for each level of the grammar
        known = np.concatenate([n, [1]])
        part = known[np.where(table >= FIRST_RULE, table.astype(np.int64) - FIRST_RULE, len(n))]
        ready = (n < 0) & (part >= 0).all(axis=1)
        n[ready] = part[ready].sum(axis=1)
    return n


def bit_pack(values: np.ndarray) -> bytes:
    """Number of values, bits of each (at most 32), and the values."""
    v = np.asarray(values, np.int64)
    width = max(int(v.max(initial=0)).bit_length(), 1)
    bits = np.unpackbits(v.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return struct.pack("<QI", len(v), width) + np.packbits(bits, bitorder="little").tobytes()


class Packed:
    """An array of ``bit_pack``, read where it lies."""

    def __init__(self, blob: bytes, at: int):
        self.n, self.width = struct.unpack_from("<QI", blob, at)
        size = -(-self.n * self.width // 8)
        self.raw = np.frombuffer(blob, np.uint8, size, at + 12)
        self.end = at + 12 + size

    def all(self) -> np.ndarray:
        bits = np.unpackbits(self.raw, count=self.n * self.width, bitorder="little").reshape(-1, self.width)
        wide = np.zeros((self.n, 32), np.uint8)
        wide[:, :self.width] = bits
        return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel().astype(np.int64)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        """The values at some places."""
        first = np.asarray(at, np.int64) * self.width
        byte, out = first >> 3, np.zeros(len(first), np.uint64)
        for k in range(5):
            out |= self.raw[np.minimum(byte + k, len(self.raw) - 1)].astype(np.uint64) << np.uint64(8 * k)
        return ((out >> (first & 7).astype(np.uint64)) & np.uint64((1 << self.width) - 1)).astype(np.int64)


class Shard:
    """A shard in memory, from ``pack``'s bytes. ``rules_read`` counts the rules looked up by random access."""

    def __init__(self, blob: bytes):
        magic, version, n_docs = struct.unpack_from("<4sIQ", blob)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a shard of token ids")
        at = 16
        self.doc_ids = np.frombuffer(blob, "<i8", n_docs, at)
        self.null_ids = np.frombuffer(blob, "u1", n_docs, at + 8 * n_docs).astype(bool)
        at += 9 * n_docs
        parts = []
        for _ in range(7):
            parts.append(Packed(blob, at))
            at = parts[-1].end
        used, self._rules, self._lengths, self._symbols, in_symbols, in_ids, sampled = parts
        self.used, self.sampled = used.all(), sampled.all()
        self.first_symbol, self.first_id = offsets(in_symbols.all()), offsets(in_ids.all())
        self.rules_read = 0
        self._whole: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        self._pool: tuple[np.ndarray, np.ndarray] | None = None

    def _names(self, dense: np.ndarray) -> np.ndarray:
        """Ids and rules (from ``FIRST_RULE`` on) for dense numbers."""
        rule = dense >= len(self.used)
        return np.where(rule, dense - len(self.used) + FIRST_RULE, self.used[np.where(rule, 0, dense)] if len(self.used) else 0)

    def _unpacked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self._whole is None:
            self._whole = self._names(self._rules.all()).reshape(-1, 2), self._lengths.all(), self._names(self._symbols.all())
        return self._whole

    rules = property(lambda self: self._unpacked()[0])
    lengths = property(lambda self: self._unpacked()[1])
    symbols = property(lambda self: self._unpacked()[2])

    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """All rules expanded, end to end, and where each begins."""
        if self._pool is None:
            start = offsets(self.lengths)
            # Spell out every rule by replacing symbols level by level.
            out, depth = self.rules.reshape(-1), 0
            while (rule := out >= FIRST_RULE).any():
                depth += 1
                wide = np.where(rule, 2, 1)
                to = offsets(wide)[:-1]
                nxt = np.empty(int(wide.sum()), np.int64)
                nxt[to] = np.where(rule, self.rules[np.where(rule, out - FIRST_RULE, 0), 0] if len(self.rules) else out, out)
                nxt[to[rule] + 1] = self.rules[out[rule] - FIRST_RULE, 1]
                out = nxt
            self._pool = out, start
        return self._pool

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        pool, start = self._expansions()
        rule = symbols >= FIRST_RULE
        index = np.where(rule, symbols - FIRST_RULE, 0)
        n = np.where(rule, self.lengths[index], 1) if len(self.lengths) else np.ones(len(symbols), np.int64)
        begin = np.where(rule, start[index], len(pool) + np.arange(len(symbols)))
        both = np.concatenate([pool, symbols]).astype("<u4")   # plain ids are taken from the symbols themselves
        to = offsets(n)
        at = np.repeat((begin - to[:-1]).astype(np.int32), n)
        at += np.arange(to[-1], dtype=np.int32)
        return both[at]

    def _spelled(self, out: np.ndarray) -> np.ndarray:
        """The ids of some symbols (dense numbers): the rules reached are replaced level by level."""
        n = len(self.used)
        while (rule := out >= n).any():
            wide = np.where(rule, 2, 1)
            to = offsets(wide)[:-1]
            nxt = np.empty(int(wide.sum()), np.int64)
            at = out[rule] - n
            self.rules_read += len(np.unique(at))
            nxt[to] = out
            nxt[to[rule]], nxt[to[rule] + 1] = self._rules[2 * at], self._rules[2 * at + 1]
            out = nxt
        return self.used[out].astype("<u4") if len(out) else np.zeros(0, "<u4")

    def document(self, k: int) -> np.ndarray:
        """The ids of the shard's k-th document."""
        return self._spelled(self._symbols[np.arange(self.first_symbol[k], self.first_symbol[k + 1])])

    def span(self, start: int, stop: int) -> np.ndarray:
        """The ids at positions start to stop - 1 of the shard, from the symbols that cover them."""
        a = max(int(np.searchsorted(self.sampled, start, "right")) - 1, 0)
        b = int(np.searchsorted(self.sampled, stop, "left"))
        some = self._symbols[np.arange(a * SAMPLED, min(b * SAMPLED, self._symbols.n))]
        rule = some >= len(self.used)
        n = np.ones(len(some), np.int64)
        n[rule] = self._lengths[some[rule] - len(self.used)]
        at = int(self.sampled[a]) + offsets(n)
        i, j = int(np.searchsorted(at, start, "right")) - 1, int(np.searchsorted(at, stop, "left"))
        return self._spelled(some[i:j])[start - at[i]:stop - at[i]]


def pack(doc_ids: list[int | None], docs: list[bytes], min_pair: int = MIN_PAIR) -> bytes:
    """A shard's bytes: ``docs`` are the ids of each document as little-endian 32-bit integers."""
    first = offsets([len(d) // 4 for d in docs])
    symbols, starts, rules, lengths = compress(np.frombuffer(b"".join(docs), "<u4"), first[:-1], min_pair)
    symbols = np.asarray(symbols, np.int64)
    names = np.array([NULL_ID if d is None else d for d in doc_ids], "<i8")
    rules, lengths = np.asarray(rules, np.int64).reshape(-1), np.asarray(lengths, np.int64)
    every = np.concatenate([symbols, rules])
    used = np.unique(every[every < FIRST_RULE])

    def dense(x: np.ndarray) -> np.ndarray:
        return np.where(x >= FIRST_RULE, x - FIRST_RULE + len(used), np.searchsorted(used, x))

    n = np.ones(len(symbols), np.int64)
    n[symbols >= FIRST_RULE] = lengths[symbols[symbols >= FIRST_RULE] - FIRST_RULE]
    parts = [used, dense(rules), lengths, dense(symbols), np.diff(np.append(starts, len(symbols))), np.diff(first), offsets(n)[:-1][::SAMPLED]]
    return b"".join([struct.pack("<4sIQ", MAGIC, VERSION, len(docs)), names.tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(), *map(bit_pack, parts)])


def write(docs: DataFrame, tokenizer: str, end_id: int = 1, spaced: bool = False, shard: int = SHARD, min_pair: int = MIN_PAIR) -> DataFrame:
    """The shards of all ``docs`` (doc_id, text), written to the shared folder: part and seq (their order),
    n_ids and blob."""
    dealt = (docs.select("doc_id", "text").repartitionByRange(F.col("doc_id"), F.xxhash64("text"))
             .sortWithinPartitions("doc_id", F.xxhash64("text"), "text").withColumn("part", F.spark_partition_id()))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, spaced, MEMO)
        names, ids, held, seq, part = [], [], 0, 0, 0

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([held // 4], pa.int64()),
                 pa.array([pack(names, ids, min_pair)], pa.binary())], ["part", "seq", "n_ids", "blob"])

        for b in chunks(batches, TEXTS):
            part = b.column("part")[0].as_py() if b.num_rows else part
            for name, got in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text")), strict=True):
                got += end
                if held and held + len(got) > 4 * shard:
                    yield flush()
                    names, ids, held, seq = [], [], 0, seq + 1
                names.append(name)
                ids.append(got)
                held += len(got)
        if names:
            yield flush()

    return stored(small_batches(dealt, TEXTS).mapInArrow(run, "part int, seq int, n_ids bigint, blob binary"), "token-shards")


def read(shards: DataFrame) -> DataFrame:
    """From written shards, per document: doc_id, start (ids of all documents before it), n_tokens and
    ids_crc32."""
    reach(shards.sparkSession)
    # Two small tables: a row per part, then a row per shard.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
             .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start")))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    heads = (shards.select("part", "seq", "n_ids").withColumn("shard_start", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
             .join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("shard_start")).alias("base")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, 1):
            s = Shard(b.column("blob")[0].as_py())
            ids = s.expand(s.symbols)
            first = s.first_id
            crc = [zlib.crc32(ids[i:j]) for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            n = len(crc)
            yield pa.RecordBatch.from_arrays(
                [pa.array([b.column("part")[0].as_py()] * n, pa.int32()), pa.array([b.column("seq")[0].as_py()] * n, pa.int32()),
                 pa.array(s.doc_ids, pa.int64(), mask=s.null_ids), pa.array(first[:-1]), pa.array(np.diff(first)),
                 pa.array(crc, pa.int64())], ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = shards.select("part", "seq", "blob").mapInArrow(
        run, "part int, seq int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(heads, ["part", "seq"]).select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op3_token_ids(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read(write(docs, public_tokenizers.path("word_bpe_49k.json")))
