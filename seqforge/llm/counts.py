"""Token counts of whole texts by compiled finite-state transducers (operator 12), for byte-level BPE files.

Two deterministic transducers in a row:

* **Cutter**, over letters. Eight states (what the current piece is made of); an input symbol is a letter's kind and
  what its next two letters tell (a blank before a word, an apostrophe of a contraction). A transition says whether
  a piece begins at the letter.
* **Counter**, over bytes; a piece's first byte starts it anew. Let b(p) be the tokens of a prefix p of a piece. A
  later token can only begin where the rest of p is the beginning of some token, so a state is, for each such
  place, the rest (a node of the vocabulary's trie), the last token before it and how many tokens p has since. A
  token may follow another if the two, encoded together, stay two; exactly one token that ends at a byte may
  follow the last token before it. A transition is annotated with the tokens it adds (fewer than none if tokens
  merge); their sum over a text is its number of tokens. Transitions are compiled the first time they are
  met; beyond ``STATES`` states all are dropped and compiled anew, which changes no result.

Texts lie end to end as bytes, cut into chunks of ``CHUNK`` that run side by side, one array operation for a letter of
every chunk. The cutter's chunks are maps from all its states to states, composed by a parallel prefix scan. The
counter's chunks are maps from the states that can enter: a chunk in which a piece begins leaves one state
whatever enters; for a chunk inside a piece the entries are run from guesses until the exits of one chunk
are entries of the next, and the right ones are found by pointer doubling.

Defined results: null text counts as empty and has no token; a special token's own text inside a text is one token,
as the tokenizer's default has it; null and repeated doc_ids are kept, a row each; a text of any length passes in
slabs of ``SLAB`` bytes with the states carried over; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqforge.llm.common import chunks, offsets, small_batches

SLAB, CHUNK, STATES = 1 << 22, 256, 300_000
LIMIT = 1024

# Kinds of letters; of the input symbols of the cutter, with what the next letters tell.
LETTER, DIGIT, SIGN, SPACE, BLANK, UNKNOWN = 0, 1, 2, 3, 4, 255
S_LETTER, S_DIGIT, S_SIGN, S_SHORT, S_LONG, S_SPACE_WORD, S_BLANK_WORD, S_BLANK = range(8)   # S_SHORT: 's, S_LONG: 're
FRESH = 8                                                                                     # added to the first letter of a text
# Letters after an apostrophe that make a contraction with it (fixed by the tokenizer's cutting pattern).
SHORT, LONG = ("s", "t", "m", "d"), ("re", "ve", "ll")
# States of the cutter: nothing open, inside letters, digits, signs, after a blank that joins, one or two letters of a
# contraction to come, inside blanks.
OPEN, IN_LETTERS, IN_DIGITS, IN_SIGNS, JOINS, ONE_MORE, TWO_MORE, IN_BLANKS = range(8)


def _cutter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, a piece begins), by symbol and state."""
    goes, begins = np.zeros((16, 8), np.uint8), np.ones((16, 8), bool)
    inside = {S_LETTER: IN_LETTERS, S_DIGIT: IN_DIGITS, S_SIGN: IN_SIGNS}
    for symbol, state in inside.items():
        goes[symbol] = state
        begins[symbol, [state, JOINS]] = False
    goes[S_LETTER, [ONE_MORE, TWO_MORE]] = [OPEN, ONE_MORE]
    begins[S_LETTER, [ONE_MORE, TWO_MORE]] = False
    for symbol, state in ((S_SHORT, ONE_MORE), (S_LONG, TWO_MORE)):
        goes[symbol] = state
        goes[symbol, [IN_SIGNS, JOINS]] = IN_SIGNS
        begins[symbol, [IN_SIGNS, JOINS]] = False
    goes[S_SPACE_WORD], goes[S_BLANK_WORD], goes[S_BLANK] = JOINS, OPEN, IN_BLANKS
    begins[S_BLANK, IN_BLANKS] = False
    goes[FRESH:] = goes[:FRESH, [OPEN]]
    return goes, begins


GOES, BEGINS = _cutter()


class Kinds:
    """The kind of each letter, asked of the tokenizer's own cutting the first time it is met."""

    def __init__(self, pre_tokenizer):
        self.pre, self.of = pre_tokenizer, np.full(0x110000, UNKNOWN, np.uint8)

    def __call__(self, letters: np.ndarray) -> np.ndarray:
        out = self.of[letters]
        if (out == UNKNOWN).any():
            for c in np.unique(letters[out == UNKNOWN]).tolist():
                joins = [k for k, before in ((LETTER, "a"), (DIGIT, "1"), (SIGN, "!")) if len(self.pre.pre_tokenize_str(before + chr(c))) == 1]
                self.of[c] = SPACE if c == 32 else joins[0] if joins else BLANK
            out = self.of[letters]
        return out


class Counter:
    """The counter's states and transitions so far; ``move`` takes many steps at once."""

    def __init__(self, tokenizer):
        model = json.loads(tokenizer.to_str())["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            raise ValueError("only byte-level BPE files can be compiled")
        self.tokenize, self.names = tokenizer.model.tokenize, {v: k for k, v in model["vocab"].items()}
        byte = {c: b for b, c in byte_letters().items()}
        self.child: dict[int, int] = {}        # node * 256 + byte -> node
        self.token, self.inner = [-1], [True]  # of each node: the token it spells, and whether longer tokens begin so
        for name, i in model["vocab"].items():
            if [t.id for t in self.tokenize(name)] != [i]:
                continue                       # never a result of the merges
            node = 0
            for c in name:
                step = node * 256 + byte[c]
                self.inner[node] = True
                node = self.child.setdefault(step, len(self.token))
                if node == len(self.token):
                    self.token.append(-1)
                    self.inner.append(False)
            self.token[node] = i
        self.start = array("i", (0, -1, 0)).tobytes()
        self.forget()

    def forget(self) -> None:
        self.number, self.entries = {self.start: 0}, [self.start]
        self.pairs: dict[int, bool] = {}
        self.slots(16)

    def slots(self, bits: int) -> None:
        """Empty tables of transitions: open addressing over state * 256 + byte."""
        self.bits, self.held = bits, 0
        self.key, self.to, self.adds = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int8)

    def state(self, entry: bytes) -> int:
        n = self.number.setdefault(entry, len(self.entries))
        if n == len(self.entries):
            self.entries.append(entry)
        return n

    def follows(self, last: int, token: int) -> bool:
        if last < 0:
            return True
        pair = last << 32 | token
        if (ok := self.pairs.get(pair)) is None:
            got = self.tokenize(self.names[last] + self.names[token])
            ok = self.pairs[pair] = len(got) == 2 and got[0].id == last and got[1].id == token
        return ok

    def compile(self, step: int) -> tuple[int, int]:
        """(state, added tokens) of a transition met for the first time."""
        state, byte = divmod(step, 256)
        entry, found, rest = array("i"), None, []
        entry.frombytes(self.entries[state])
        for i in range(0, len(entry), 3):
            node = self.child.get(entry[i] * 256 + byte)
            if node is None:
                continue
            token = self.token[node]
            if token >= 0 and found is None and self.follows(entry[i + 1], token):
                found = token, 1 - entry[i + 2]
            if self.inner[node]:
                rest.append((node, entry[i + 1], entry[i + 2]))
        token, added = found
        flat = array("i", [v for node, last, since in rest for v in (node, last, since + added)])
        flat.extend((0, token, 0))
        return self.state(flat.tobytes()), added

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The keys' slots, and which keys are not there (their slot is a free one)."""
        slot = self._slot(key)
        there = self.key[slot]
        open_ = np.nonzero((there != key) & (there >= 0))[0]
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.key) - 1)
            there[open_] = self.key[slot[open_]]
            open_ = open_[(there[open_] != key[open_]) & (there[open_] >= 0)]
        return slot, there < 0

    def _put(self, key: np.ndarray, to: np.ndarray, adds: np.ndarray) -> None:
        if 2 * (self.held + len(key)) > len(self.key):
            at = np.nonzero(self.key >= 0)[0]
            key, to, adds = (np.concatenate(pair) for pair in ((self.key[at], key), (self.to[at], to), (self.adds[at], adds)))
            self.slots(max(self.bits + 1, int(2 * len(key) - 1).bit_length()))
        left = np.arange(len(key))
        self.held += len(key)
        while len(left):                      # keys that want the same free slot: the last one gets it, the others look on
            slot, _ = self._find(key[left])
            self.key[slot] = key[left]
            got = self.key[slot] == key[left]
            self.to[slot[got]], self.adds[slot[got]] = to[left[got]], adds[left[got]]
            left = left[~got]

    def move(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, added tokens)."""
        key = state.astype(np.int64) * 256 + byte
        slot, absent = self._find(key)
        if absent.any():
            new = np.unique(key[absent])
            made = [self.compile(k) for k in new.tolist()]
            self._put(new, np.array([m[0] for m in made], np.int32), np.array([m[1] for m in made], np.int8))
            slot, _ = self._find(key)
        return self.to[slot], self.adds[slot]


def byte_letters() -> dict[int, str]:
    """How byte-level vocabularies spell each byte: printable Latin-1 letters as they are, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in plain else next(others)) for b in range(256)}


def scan_maps(maps: np.ndarray) -> np.ndarray:
    """Of maps from all states to states, the compositions of each with all before it, by doubling."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = np.take_along_axis(out[step:], out[:-step], axis=1)
        step *= 2
    return out


def in_chunks(values: np.ndarray, fill, width: int) -> np.ndarray:
    """The values as (place in chunk, chunk), the last chunk filled up."""
    out = np.full(-(-len(values) // width) * width, fill, values.dtype)
    out[:len(values)] = values
    return np.ascontiguousarray(out.reshape(-1, width).T)


class Transducers:
    """Token counts of many texts."""

    def __init__(self, path: str, states: int = STATES, slab: int = SLAB, chunk: int = CHUNK):
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        pre = json.loads(tokenizer.to_str())
        if pre["normalizer"] or pre["pre_tokenizer"].get("type") != "ByteLevel" or not pre["pre_tokenizer"].get("use_regex") or pre["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("only byte-level BPE files can be compiled")
        if any(t.lstrip or t.rstrip or t.single_word for t in tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("special tokens that take in blanks around them cannot be compiled")
        self.special = [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()]
        self.any_special = re.compile(b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or b"(?!)")
        self.kinds, self.counter = Kinds(tokenizer.pre_tokenizer), Counter(tokenizer)
        self.states, self.slab, self.chunk = states, slab, chunk

    # ---- cutter ---------------------------------------------------------------------------------

    def symbols(self, data: np.ndarray, at: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """The cutter's input for the letters that begin ``at`` (those that are first in a text: ``fresh``)."""
        letter = data[at].astype(np.int32)
        lead = letter.copy()
        for low, high, more, mask in ((0xC0, 0xE0, 1, 0x1F), (0xE0, 0xF0, 2, 0x0F), (0xF0, 0xF8, 3, 0x07)):
            many = np.nonzero((lead >= low) & (lead < high))[0]
            if len(many):
                value = lead[many] & mask
                for k in range(1, more + 1):
                    value = value << 6 | (data[at[many] + k] & 0x3F)
                letter[many] = value
        kind = self.kinds(letter)
        end = np.append(fresh[1:], True)                        # nothing of the same text follows
        next_kind = np.append(kind[1:], BLANK)
        word_next = ~end & (next_kind < SPACE)
        out = np.where(kind < SPACE, kind, np.where(word_next, np.where(kind == SPACE, S_SPACE_WORD, S_BLANK_WORD), S_BLANK)).astype(np.uint8)
        quote = np.nonzero((letter == 39) & ~end)[0]
        if len(quote):
            one = letter[quote + 1]
            third = np.minimum(quote + 2, len(letter) - 1)
            two = np.where((quote + 2 < len(letter)) & ~fresh[third], letter[third], 0)
            out[quote[np.isin(one, [ord(c) for c in SHORT])]] = S_SHORT
            out[quote[np.isin(one * 256 + np.minimum(two, 255), [ord(c[0]) * 256 + ord(c[1]) for c in LONG]) & (two < 256) & (one < 256)]] = S_LONG
        return out + np.where(fresh, FRESH, 0).astype(np.uint8)

    def cut(self, symbols: np.ndarray, state: int) -> tuple[np.ndarray, int]:
        """Whether a piece begins at each letter, and the state after them."""
        lanes = in_chunks(symbols, S_LETTER, self.chunk)
        maps = np.tile(np.arange(8, dtype=np.uint8), (lanes.shape[1], 1))
        for row in lanes:
            maps = GOES[row[:, None], maps]
        now = np.append([state], scan_maps(maps)[:-1, state]).astype(np.uint8)
        begins = np.empty(lanes.shape, bool)
        last = (len(symbols) - 1) % self.chunk
        for i, row in enumerate(lanes):
            begins[i] = BEGINS[row, now]
            now = GOES[row, now]
            if i == last:
                state = int(now[-1])
        return begins.T.ravel()[:len(symbols)], state

    # ---- counter --------------------------------------------------------------------------------

    def run(self, lanes: np.ndarray, begins: np.ndarray, chunk: np.ndarray, state: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunks from their place ``first`` to before ``last``, entered in ``state``: the added tokens of each place, and
        the states they leave."""
        adds, state = np.zeros((len(lanes), len(chunk)), np.int8), state.astype(np.int32)
        for i in range(int(first.min(initial=0)), int(last.max(initial=0))):
            on = np.nonzero((first <= i) & (i < last))[0]
            if not len(on):
                continue
            at = chunk[on]
            state[on], adds[i, on] = self.counter.move(np.where(begins[i, at], 0, state[on]), lanes[i, at])
        return adds, state

    def count(self, data: np.ndarray, begins: np.ndarray, state: int) -> tuple[np.ndarray, int]:
        """The tokens added by each byte, and the state after them."""
        width, n = self.chunk, len(data)
        lanes, begins = in_chunks(data, 0, width), in_chunks(begins, False, width)
        k = lanes.shape[1]
        length = np.full(k, width)
        length[-1] = n - (k - 1) * width
        starts = begins.any(axis=0)
        head = np.where(starts, begins.argmax(axis=0), length)       # places before the first piece that begins here
        adds, leaves = self.run(lanes, begins, np.arange(k), np.zeros(k), head, length)
        # (chunk, entry) nodes: known entries after a chunk that begins a piece, else a guess, then every exit found.
        entry = np.append([state], np.where(starts, leaves, 0)[:-1])
        chunk, found = np.arange(k), {}
        while len(chunk):
            got, out = self.run(lanes, begins, chunk, entry, np.zeros(len(chunk), int), head[chunk])
            out = np.where(starts[chunk], leaves[chunk], out)
            found.update({(c, e): (o, got[:, j]) for j, (c, e, o) in enumerate(zip(chunk.tolist(), entry.tolist(), out.tolist(), strict=True))})
            new = {(c + 1, o) for c, o in zip(chunk.tolist(), out.tolist(), strict=True) if c + 1 < k and (c + 1, o) not in found}
            chunk, entry = (np.array(v, int) for v in zip(*sorted(new), strict=True)) if new else (np.zeros(0, int),) * 2
        nodes = list(found)
        number = {node: i for i, node in enumerate(nodes)}
        jump = np.array([number.get((c + 1, found[c, e][0]), -1) for c, e in nodes])
        right = np.zeros(len(nodes), bool)                             # the nodes reached from the slab's entry
        right[number[0, state]] = True
        while (jump >= 0).any():                                       # by pointer doubling
            right[jump[right & (jump >= 0)]] = True
            jump = np.where(jump >= 0, jump[jump], -1)
        for i in np.nonzero(right)[0].tolist():
            (c, _), (out, got) = nodes[i], found[nodes[i]]
            adds[:head[c], c] = got[:head[c]]
            if c == k - 1:
                state = out
        return adds.T.ravel()[:n], int(state)

    # ---- texts ----------------------------------------------------------------------------------

    def __call__(self, texts: pa.Array) -> np.ndarray:
        """The number of tokens of each text (no nulls)."""
        texts = texts.cast(pa.large_string())
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]]
        bounds = bounds - bounds[0]
        total = np.zeros(len(texts) + 1, np.int64)        # tokens up to each bound
        fresh = np.zeros(len(data) + 1, bool)
        fresh[bounds] = True
        plain, special = self._without_special(data, fresh, bounds)
        total += special
        data, fresh, bounds = plain
        cutting, counting, at = OPEN, self.counter.start, 0
        added = np.zeros(len(data) + 1, np.int64)
        while at < len(data):
            upto = min(at + self.slab, len(data))
            while upto < len(data) and data[upto] & 0xC0 == 0x80:
                upto += 1
            beyond = min(upto + 8, len(data))             # at least two letters more, to look at
            while beyond < len(data) and data[beyond] & 0xC0 == 0x80:
                beyond += 1
            letters = np.nonzero(data[at:beyond] & 0xC0 != 0x80)[0] + at
            symbols = self.symbols(data, letters, fresh[letters])[:np.searchsorted(letters, upto)]
            letters = letters[:len(symbols)]
            begins, cutting = self.cut(symbols, cutting)
            marks = np.zeros(upto - at, bool)
            marks[letters[begins] - at] = True
            if len(self.counter.entries) > self.states:
                self.counter.forget()
            adds, state = self.count(data[at:upto], marks, self.counter.state(counting))
            counting = self.counter.entries[state]
            np.cumsum(adds, out=added[at + 1:upto + 1])
            added[at + 1:upto + 1] += added[at]
            at = upto
        return np.diff(total + added[bounds])

    def _without_special(self, data: np.ndarray, fresh: np.ndarray, bounds: np.ndarray):
        """((bytes without the special tokens' texts, where a text begins, bounds), special tokens up to each bound)."""
        raw, spans = data.tobytes(), []
        if any(s in raw for s in self.special):
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                spans += [(a + m.start(), a + m.end()) for m in self.any_special.finditer(raw[a:b])]
        if not spans:
            return (data, fresh, bounds), np.zeros(len(bounds), np.int64)
        lo, hi = np.array(spans).T
        keep = np.ones(len(data), bool)
        for a, b in spans:
            keep[a:b] = False
        fresh = fresh.copy()
        fresh[hi] = True                                   # what follows is cut by itself
        place = offsets(keep)
        moved = np.zeros(int(place[-1]) + 1, bool)
        moved[place[np.nonzero(fresh)[0]]] = True
        return (data[keep], moved, place[bounds]), np.searchsorted(hi, bounds, "right")


@lru_cache(2)
def transducers(path: str) -> Transducers:
    """One set of transducers for each worker process and file."""
    return Transducers(path)


def token_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_bytes and n_tokens of each row of ``docs`` (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = transducers(tokenizer)
        for b in chunks(batches, 1024):
            texts = pc.fill_null(b.column("text"), "")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(count(texts))],
                                             ["doc_id", "n_bytes", "n_tokens"])

    return small_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")


def op12_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return (token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
            .withColumn("over_limit", F.col("n_tokens") > LIMIT))
