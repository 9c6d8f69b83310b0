"""Alignment of two tokenizers' tokens, counted over the corpus, as an Arrow-native pipeline (operator 11).

1. A task encodes the texts of a block (up to ``BYTES``) with both tokenizers. Everything after that is Arrow: id lists are
   flattened, their parent indices name the document, cumulative sums of the tokens' bytes, taken off at each document's
   start, give the ends, and one search of a side's ascending (document, end) keys in the other's gives the cuts. A token's group is the
   first cut at or after its end. Of each kind of group (the same ids) one is taken: both sides' distinct ids, with how often
   they occur, are joined on the kind: its links. ``Table.group_by`` counts the kinds per document, adds up the links per
   document and pair, and counts each pair's documents in the block.
2. Spark merges the blocks' partial counts, a row per block and pair, and finds the highest count of each A id.
3. Each block gets back the counts of its own pairs. A task reads them in order, then the block's links, and adds up
   each document's sums.

A frequent pair is one row per block, whatever it occurs there; nothing is collected or broadcast. The blocks' links
are written once (packed), so steps 2 and 3 do not encode again.

Defined results: null, empty and not exactly rebuilt texts (one whose joined bytes differ from a space and the text, as when
a text holds U+2581) have no tokens: zeros and no hash; null and repeated doc_ids are kept, a row each, and each row
counts as a document; special tokens' texts are plain text; a text of any length is a block of its own beyond ``BYTES``;
the links of a group are all pairs of its distinct ids, so a group without an inner
cut of n different tokens on each side holds n * n rows in its task; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqforge.llm.common import chunks, offsets, small_batches, stored
from seqforge.llm.counts import byte_letters
from seqforge.llm.tokens import MEMO, Encoder, encoder

BYTES = 1 << 22              # text of a block
BLOCK_SCHEMA = ("block bigint, doc_ids array<bigint>, n_a array<int>, n_b array<int>, n_groups array<int>, n_links array<bigint>, "
                "hashes array<string>, pairs array<bigint>, held array<int>, links binary")


class Pair:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        self.a = encoder(path_a, True, None, True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.words = Words(self.b)
        byte = {c: b for b, c in byte_letters().items()}
        vocab = self.a.tokenizer.get_vocab(with_added_tokens=True)
        plain = self.a.tokenizer.get_vocab(with_added_tokens=False)
        names = dict.fromkeys(range(max(vocab.values()) + 1), b"")
        names |= {i: bytes(byte[c] for c in t) if t in plain else t.encode() for t, i in vocab.items()}
        self.bytes_a = pa.array([names[i] for i in range(len(names))], pa.large_binary())
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = pa.array([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)], pa.large_binary())
        self.cut = not any("▁" in p.lstrip("▁") for p in pieces)      # a space never joins the word before it

    def ids_a(self, texts: pa.Array) -> pa.Array:
        raw = self.a.encode(after_space(texts))
        return lists(np.frombuffer(b"".join(raw), "<u4"), [len(r) // 4 for r in raw])

    def ids_b(self, texts: pa.Array) -> pa.Array:
        if self.cut:
            ids, cut = self.words.of(after_space(texts))
            return lists(ids, np.diff(cut))
        each = [np.array(self.b.encode(t), np.uint32) for t in texts.to_pylist()]
        return lists(np.concatenate([np.zeros(0, np.uint32), *each]), [len(e) for e in each])


class Words(Encoder):
    """The second tokenizer's ids of words, each with the spaces before it, kept like those of the first. It puts a
    space before what it encodes, so a word's first one is left off."""

    def __init__(self, processor):
        self.processor, self.most = processor, MEMO
        self._empty()

    def _pieces(self, texts: pa.Array) -> pa.Array:
        return pc.split_pattern(pc.replace_substring_regex(texts, "([^ \x01]) ", "\\1\x01 "), "\x01")

    def _new(self, pieces: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        each = self.processor.encode([p[1:] for p in pieces], num_threads=1)
        each = [e if p != " " else [self.processor.piece_to_id("▁")] for p, e in zip(pieces, each, strict=True)]
        return pieces, np.array([t for e in each for t in e], np.uint32), np.array([len(e) for e in each], np.int64)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of texts that begin with a space, end to end, and where each text begins."""
        odd = pc.match_substring(texts, "\x01").to_numpy(zero_copy_only=False)     # the mark itself
        if not odd.any():
            return self._sure(texts)
        ids, cut = self._sure(texts.filter(pa.array(~odd)))
        plain = iter(np.split(ids, cut[1:-1]) if (~odd).any() else [])
        each = [np.array(self.processor.encode(t[1:]), np.uint32) if o else next(plain) for t, o in zip(texts.to_pylist() if odd.any() else [], odd.tolist(), strict=True)]
        return np.concatenate(each), offsets([len(e) for e in each])


@lru_cache(2)
def pair(path_a: str, path_b: str) -> Pair:
    """One pair of tokenizers for each worker process."""
    return Pair(path_a, path_b)


def _large(text: str) -> pa.Scalar:
    return pa.scalar(text, pa.large_string())


def after_space(texts: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(_large(""), texts, _large(" "))


def lists(values, lengths) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(offsets(lengths)), pa.array(values) if isinstance(values, np.ndarray) else values)


def table(**columns) -> pa.Table:
    return pa.table({k: pa.array(v) if isinstance(v, np.ndarray) else v for k, v in columns.items()})


def rebuilt(ids: pa.Array, names: pa.Array) -> pa.Array:
    """The joined bytes of each list of ids."""
    return pc.binary_join(pa.LargeListArray.from_arrays(ids.offsets, names.take(ids.values)), pa.scalar(b"", pa.large_binary()))


def ends(ids: pa.Array, names: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(flat ids, their documents, (document, end) keys): ends are running sums that begin anew in each document."""
    flat, doc = pc.list_flatten(ids), pc.list_parent_indices(ids)
    upto = pc.cumulative_sum(pc.cast(pc.binary_length(names), pa.int64()).take(flat))
    before = pa.concat_arrays([pa.array([0], pa.int64()), upto]).take(ids.offsets.slice(0, len(ids)))
    return flat, doc, pc.add(pc.shift_left(doc, 32), pc.subtract(upto, before.take(doc)))


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys that both ascending arrays hold (as often as an inner join gives them), and each key's place: the number of
    cuts before it."""
    at = np.searchsorted(b, a)
    hit = b[np.minimum(at, len(b) - 1)] == a if len(b) else np.zeros(len(a), bool)
    if (a[1:] == a[:-1]).any() or (b[1:] == b[:-1]).any():      # tokens without bytes
        cuts = np.repeat(a[hit], np.searchsorted(b, a[hit], "right") - at[hit])
        return cuts, np.searchsorted(cuts, a), np.searchsorted(cuts, b)
    hit_b = np.zeros(len(b), bool)
    hit_b[at[hit]] = True
    return a[hit], np.cumsum(hit) - hit, np.cumsum(hit_b) - hit_b


def align(texts: pa.Array, both: Pair) -> tuple[dict, pa.Table]:
    """Of texts without nulls: the documents' columns, and their links (doc, pair, n), pair = A id << 32 | B id."""
    wanted = pc.cast(after_space(texts), pa.large_binary())
    a, b = both.ids_a(texts), both.ids_b(texts)
    exact = pc.and_(pc.and_(pc.equal(rebuilt(a, both.bytes_a), wanted), pc.equal(rebuilt(b, both.bytes_b), wanted)), pc.greater(pc.binary_length(texts), 0))
    if not pc.all(exact).as_py():
        a, b = (lists(pc.list_flatten(x.filter(exact)), pc.if_else(exact, pc.list_value_length(x), 0).to_numpy(zero_copy_only=False)) for x in (a, b))
    flat_a, doc_a, key_a = ends(a, both.bytes_a)
    flat_b, doc_b, key_b = ends(b, both.bytes_b)
    cuts, group_a, group_b = common_ends(key_a.to_numpy(), key_b.to_numpy())
    cut_doc = cuts >> 32
    # Every group as text; equal groups have equal links, so one of each is joined.
    joined = [pc.binary_join(lists(pc.cast(flat, pa.large_string()), np.bincount(g, minlength=len(cuts))), _large(",")) for flat, g in ((flat_a, group_a), (flat_b, group_b))]
    told = pc.binary_join_element_wise(*joined, _large("|"))
    kind = told.dictionary_encode().indices.to_numpy()
    first = np.zeros(int(kind.max(initial=-1)) + 1, np.int64)
    first[kind[::-1]] = np.arange(len(kind))[::-1]
    one = np.zeros(len(cuts), bool)
    one[first] = True
    sides = [table(kind=kind[g[one[g]]], id=flat.filter(pa.array(one[g]))).group_by(["kind", "id"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["kind", name, f"n_{name}"])
             for g, flat, name in ((group_a, flat_a, "a"), (group_b, flat_b, "b"))]
    met = sides[0].join(sides[1], "kind", join_type="inner", use_threads=False)
    met = table(kind=met.column("kind"), pair=pc.add(pc.shift_left(pc.cast(met.column("a"), pa.int64()), 32), pc.cast(met.column("b"), pa.int64())),
                each=pc.multiply(met.column("n_a"), met.column("n_b")))
    held = table(doc=cut_doc, kind=kind).group_by(["doc", "kind"], use_threads=False).aggregate([([], "count_all")])
    link = held.join(met, "kind", join_type="inner", use_threads=False)
    link = table(doc=link.column("doc"), pair=link.column("pair"), n=pc.multiply(link.column("count_all"), link.column("each")))
    link = link.group_by(["doc", "pair"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["doc", "pair", "n"]).sort_by([("doc", "ascending"), ("pair", "ascending")])
    n = len(texts)
    groups = np.bincount(cut_doc, minlength=n)
    told = pc.binary_join(lists(told, groups), _large(";"))
    columns = {"n_a": pc.list_value_length(a), "n_b": pc.list_value_length(b), "n_groups": groups,
               "n_links": np.bincount(link.column("doc").to_numpy(), link.column("n").to_numpy(), n).astype(np.int64),
               "hashes": [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in told.to_pylist()]}
    return columns, link


def packed(link: pa.Table, pairs: np.ndarray) -> bytes:
    """The links as (document, place of the pair in the sorted ``pairs``, number), compressed."""
    cols = [link.column("doc").to_numpy(), np.searchsorted(pairs, link.column("pair").to_numpy()), link.column("n").to_numpy()]
    sink = pa.BufferOutputStream()
    kinds = [pa.int32(), pa.int32(), pa.int64()]
    batch = pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(cols, kinds, strict=True)], ["doc", "place", "n"])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def blocks(docs: DataFrame, path_a: str, path_b: str, size: int = BYTES) -> DataFrame:
    """The aligned blocks of all ``docs`` (doc_id, text), written."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, block = pair(path_a, path_b), TaskContext.get().partitionId() << 33
        for b in chunks(batches, 1 << 20, size):
            columns, link = align(pc.fill_null(pc.cast(b.column("text"), pa.large_string()), ""), both)
            count = link.group_by("pair", use_threads=False).aggregate([([], "count_all")]).sort_by("pair")
            columns |= {"block": block, "doc_ids": b.column("doc_id"), "pairs": count.column("pair").combine_chunks(),
                        "held": count.column("count_all").combine_chunks(), "links": packed(link, count.column("pair").to_numpy())}
            block += 1
            pa.default_memory_pool().release_unused()
            cols = []
            for f in FIELDS:
                v = columns[f.name]
                if pa.types.is_list(f.type):
                    v = v if isinstance(v, pa.Array) else pa.array(v)
                    cols.append(pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v.cast(f.type.value_type)))
                else:
                    cols.append(pa.array([v], f.type))
            yield pa.RecordBatch.from_arrays(cols, schema=FIELDS)

    return stored(small_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).mapInArrow(run, BLOCK_SCHEMA), "aligned")


def _field(text: str) -> pa.Field:
    name, kind = text.split(" ", 1)
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.field(name, pa.list_(kinds[kind[6:-1]]) if kind.startswith("array") else kinds[kind])


FIELDS = pa.schema([_field(f) for f in BLOCK_SCHEMA.split(", ")])


def pair_counts(held: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked) and best (no pair of its A id is in more), from ``blocks``."""
    each = held.select(F.explode(F.arrays_zip("pairs", "held")).alias("p")).select("p.pairs", "p.held")
    counts = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("held").alias("n")).withColumn("a", F.shiftright("pair", 32))
    top = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(top, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def document_sums(held: DataFrame, counts: DataFrame) -> DataFrame:
    """A row per document, from ``blocks`` and :func:`pair_counts`."""
    told = held.select("block", F.explode("pairs").alias("pair")).join(counts, "pair").select("block", "pair", "n", "best")
    columns = [f.name for f in FIELDS if f.name not in ("block", "pairs", "held")]
    stream = (told.unionByName(held.select("block", F.struct(*columns).alias("docs")), allowMissingColumns=True)
              .repartition("block").sortWithinPartitions("block", F.col("docs").isNotNull(), "pair"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, best = [], []
        for b in batches:
            at, docs = 0, b.column("docs")
            for i in [*np.nonzero(docs.is_valid().to_numpy(zero_copy_only=False))[0].tolist(), b.num_rows]:
                n.append(b.column("n").slice(at, i - at))
                best.append(b.column("best").slice(at, i - at))
                if i == b.num_rows:
                    break
                yield sums(docs[i], pa.concat_arrays(n), pa.concat_arrays(best))
                n, best, at = [], [], i + 1

    return stream.mapInArrow(run, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")


def sums(docs: pa.StructScalar, n: pa.Array, best: pa.Array) -> pa.RecordBatch:
    """A block's documents; ``n`` and ``best`` are those of its pairs, in their order."""
    with pa.ipc.open_stream(docs["links"].as_py()) as r:
        link = r.read_all()
    place, times = link.column("place"), link.column("n")
    per_doc = (table(doc=link.column("doc"), n_best=pc.multiply(times, pc.cast(best, pa.int64()).take(place)), count_sum=pc.multiply(times, n.take(place)))
               .group_by("doc", use_threads=False).aggregate([("n_best", "sum"), ("count_sum", "sum")]))
    rows = len(docs["doc_ids"].values)
    out = {k: np.zeros(rows, np.int64) for k in ("n_best", "count_sum")}
    for k, v in out.items():
        v[per_doc.column("doc").to_numpy()] = per_doc.column(f"{k}_sum").to_numpy()
    given = {"doc_id": "doc_ids", "n_a": "n_a", "n_b": "n_b", "n_groups": "n_groups", "n_links": "n_links", "groups_sha256": "hashes"}
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return pa.RecordBatch.from_arrays(
        [pa.array(out[c]) if c in out else docs[given[c]].values.cast(pa.string() if c == "groups_sha256" else pa.int64()) for c in names], names)


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = blocks(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return document_sums(held, pair_counts(held))
