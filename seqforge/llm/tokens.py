"""Whole-text encoding with a given tokenizer file, for the operators on token ids.

Texts are cut where the tokenizer certainly cuts (between words, and between a letter and a sign after
it; where white space matters, before a run of blanks and before its last blank, if a word follows). The
distinct pieces of many texts are found with Arrow, those that the worker has not met
are encoded with the tokenizer, and the ids of the pieces, in order, are the ids of the texts. Where these
cuts are not certain (control characters, rare white space, anything like a special token), a text is cut only at
single spaces between two letters, which no tokenizer of these kinds joins, into parts of about ``PART`` letters;
the parts that hold such a letter go to the tokenizer ``CALL`` letters at a time, so a call's memory does not grow
with the rows.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from seqforge.llm.common import offsets

MEMO = 300_000   # pieces kept by a worker; beyond it those met once are dropped
TOGETHER = 200   # pieces encoded as one text, where their cuts are certain
_RARE = r"[\x00-\x08\x0b\x0c\x0e-\x1f]|<\||\x{85}|\x{a0}|\x{1680}|\x{180e}|[\x{2000}-\x{200f}]|[\x{2028}-\x{202f}]|[\x{205f}-\x{206f}]|\x{3000}|\x{feff}"
PART, CALL = 1 << 9, 1 << 18   # letters of a part of a text with rare letters, and of the parts of one call
_BLANK, _NO_BLANK = r"[ \t\r\n]", r"[^ \t\r\n]"
_BLANKS = rf"[\t\r]|{_BLANK}{_BLANK}|^{_BLANK}|{_BLANK}$"
_LETTER_SIGN = r"([a-zA-Z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}])([!-/:-@\[-`{-~])"
_CUT = "\x01"
_BETWEEN = re.compile("(?<=[a-zA-Z]) (?=[a-zA-Z])")


class Encoder:
    """ids of whole texts. ``spaced``: white space matters (byte-level BPE with a leading space as part of
    the word); else it only separates, and case does not matter. ``plain``: special tokens' texts are plain text."""

    def __init__(self, path: str, spaced: bool, most: int | None = None, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer, self.spaced, self.most = Tokenizer.from_file(path), spaced, most or MEMO
        self.tokenizer.encode_special_tokens = plain
        # Byte-level vocabularies spell each byte as one character; a word's end is not a byte.
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.bytes_of[i] = len(token.removesuffix("</w>")) or len(token)
        self._empty()

    def _empty(self) -> None:
        self.memo: dict[str, int] = {}
        self.pool, self.used = np.empty(1 << 20, np.uint32), 0       # ids of the pieces, end to end
        self.first, self.count, self.met = (np.zeros(1 << 18, np.int64) for _ in range(3))

    def _pieces(self, texts: pa.Array) -> pa.Array:
        if not self.spaced:
            return pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(texts), _LETTER_SIGN, r"\1 \2"))
        t = pc.replace_substring_regex(texts, _LETTER_SIGN, rf"\1{_CUT}\2")
        if not (pc.any(pc.match_substring_regex(texts, _BLANKS)).as_py() or False):   # every blank is before a word
            return pc.split_pattern(pc.replace_substring(pc.replace_substring(t, " ", f"{_CUT} "), "\n", f"{_CUT}\n"), _CUT)
        t = pc.replace_substring_regex(t, rf"({_BLANK}+)({_BLANK})({_NO_BLANK})", rf"{_CUT}\1{_CUT}\2\3")
        return pc.split_pattern(pc.replace_substring_regex(t, rf"([^ \t\r\n{_CUT}])({_BLANK})", rf"\1{_CUT}\2"), _CUT)

    def _new(self, pieces: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """New pieces in another order, their ids end to end, and how many each has. Pieces that are certainly cut from whatever comes before them are
        encoded many to a text; a token's bytes tell which piece it is of. Where the bytes do not add up (the
        tokenizer changes some letters), and where white space matters and a piece does not begin with it
        (after a sign "'s" is no contraction) or is nothing else, one by one."""
        blank = (" ", "\n", "\t", "\r")
        alone = [p for p in pieces if not p.startswith(blank) or p.endswith(blank)] if self.spaced else []
        many = [p for p in pieces if p.startswith(blank) and not p.endswith(blank)] if self.spaced else pieces
        pieces = many + alone
        parts = [many[i:i + TOGETHER] for i in range(0, len(many), TOGETHER)]
        joined = self.tokenizer.encode_batch_fast([("" if self.spaced else " ").join(p) for p in parts], add_special_tokens=False)
        lengths = pc.binary_length(pa.array(many, pa.string())).to_numpy(zero_copy_only=False).astype(np.int64)
        ids, n = [], []
        for k, (part, e) in enumerate(zip(parts, joined, strict=True)):
            got = np.array(e.ids, np.uint32)
            ends, upto = np.cumsum(lengths[k * TOGETHER:k * TOGETHER + len(part)]), np.cumsum(self.bytes_of[got])
            cut = np.searchsorted(upto, ends)
            if not len(upto) or cut[-1] >= len(upto) or (upto[cut] != ends).any():
                got, sizes = self._each(part)
            else:
                sizes = np.diff(cut + 1, prepend=0)
            ids.append(got)
            n.append(sizes)
        if alone:
            got, sizes = self._each(alone)
            ids.append(got)
            n.append(sizes)
        return pieces, np.concatenate(ids), np.concatenate(n)

    def _learn(self, pieces: list[str]) -> None:
        """Add new pieces to the memo."""
        pieces, ids, n = self._new(pieces)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        at, upto = len(self.memo), len(self.memo) + len(pieces)
        while upto > len(self.first):
            self.first, self.count, self.met = (np.concatenate([a, np.zeros_like(a)]) for a in (self.first, self.count, self.met))
        self.pool[self.used:self.used + len(ids)] = ids
        self.first[at:upto], self.count[at:upto], self.met[at:upto] = self.used + offsets(n)[:-1], n, 0
        self.used += len(ids)
        self.memo.update(zip(pieces, range(at, upto), strict=True))

    def _each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces encoded one by one, end to end, and how many each has."""
        each = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.array([t for e in each for t in e], np.uint32), np.array([len(e) for e in each], np.int64)

    def _drop(self) -> None:
        """Keep the pieces met in more than one batch, if that makes room, else none."""
        kept = np.nonzero(self.met[:len(self.memo)] > 1)[0]
        kept = kept if len(kept) < self.most // 2 else kept[:0]
        names = list(self.memo)          # in the order of their numbers
        ids = self._ids(kept)
        n = self.count[kept]
        self.memo = {names[i]: k for k, i in enumerate(kept.tolist())}
        self.pool[:len(ids)], self.used = ids, len(ids)
        self.first[:len(kept)], self.count[:len(kept)], self.met[:len(kept)] = offsets(n)[:-1], n, 1

    def _ids(self, slots: np.ndarray) -> np.ndarray:
        """The ids of pieces, end to end."""
        n = self.count[slots]
        at = offsets(n).astype(np.int32)
        where = np.repeat(self.first[slots].astype(np.int32) - at[:-1], n)
        where += np.arange(at[-1], dtype=np.int32)
        return self.pool[where]

    def _sure(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of texts that can be cut, end to end, and where each text begins."""
        words = self._pieces(texts)
        cut = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        slots = list(map(self.memo.get, pieces))
        if missing := [p for p, s in zip(pieces, slots, strict=True) if s is None]:
            if len(self.memo) + len(missing) > self.most:
                self._drop()
                missing = [p for p in pieces if p not in self.memo]
            if missing:
                self._learn(missing)
            slots = list(map(self.memo.__getitem__, pieces))
        slots = np.array(slots, np.int64)
        self.met[slots] += 1
        slots = slots[coded.indices.to_numpy()]
        return self._ids(slots), offsets(self.count[slots])[cut - cut[0]]

    def _whole(self, parts: list[str]) -> Iterator[bytes]:
        """The ids of parts without certain cuts, ``CALL`` letters (or one part) at a time."""
        i = 0
        while i < len(parts):
            j, size = i + 1, len(parts[i])
            while j < len(parts) and size + len(parts[j]) <= CALL:
                size += len(parts[j])
                j += 1
            for e in self.tokenizer.encode_batch_fast(parts[i:j], add_special_tokens=False):
                yield np.array(e.ids, "<u4").tobytes()
            i = j

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text (null: empty) as little-endian unsigned 32-bit integers."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        unsure = pc.match_substring_regex(texts, _RARE).to_numpy(zero_copy_only=False)
        if unsure.any():
            parts = [at_letters(t) if u else [t] for t, u in zip(texts.to_pylist(), unsure.tolist(), strict=True)]
            ids = iter(self._encode(pa.array([p for each in parts for p in each], pa.string())))
            out = [b"".join(next(ids) for _ in each) for each in parts]
        else:
            out = self._encode(texts)
        pa.default_memory_pool().release_unused()
        return out

    def _encode(self, texts: pa.Array) -> list[bytes]:
        unsure = pc.match_substring_regex(texts, _RARE).to_numpy(zero_copy_only=False)
        blanks = pc.match_substring_regex(texts, _BLANKS).to_numpy(zero_copy_only=False) & ~unsure if self.spaced else np.zeros(len(unsure), bool)
        kinds = [self._cut_up(texts, at) for at in (~unsure & ~blanks, blanks)]
        whole = self._whole(texts.filter(pa.array(unsure)).to_pylist())
        return [next(whole) if u else next(kinds[int(b)]) for u, b in zip(unsure.tolist(), blanks.tolist(), strict=True)]

    def _cut_up(self, texts: pa.Array, at: np.ndarray) -> Iterator[bytes]:
        """The ids of those texts ``at`` which the cuts are certain."""
        if not at.any():
            return iter(())
        ids, cut = self._sure(texts.filter(pa.array(at)))
        raw = ids.astype("<u4", copy=False).tobytes()
        return iter([raw[4 * a:4 * b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)])


def at_letters(text: str, part: int = PART) -> list[str]:
    """The text in parts of ``part`` letters or a little more, cut before single spaces between letters."""
    out, done = [], 0
    while len(text) - done > part and (m := _BETWEEN.search(text, done + part)):
        out.append(text[done:m.start()])
        done = m.start()
    return [*out, text[done:]]


@lru_cache(4)
def encoder(path: str, spaced: bool, most: int | None = None, plain: bool = False) -> Encoder:
    """One encoder for each worker process, file and kind."""
    return Encoder(path, spaced, most, plain)
