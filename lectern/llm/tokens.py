"""Batch tokenisation with the tokenizers library, each distinct piece of text encoded once.

A byte-level BPE of this kind never joins bytes across the start of a word, so a text whose white space is single blanks
and line ends can be cut before each of them, and again behind a line end and before a word's closing punctuation: the ids
of the pieces, put together, are the ids of the text. Pieces recur far more often than texts. Texts with other white space
or special tokens are handed to the library whole. ``Encoder`` checks at its start that the tokenizer's pre-tokenisation is
of that kind, and otherwise encodes every text whole.

A worker remembers the pieces that it has seen as Arrow strings and arrays of ids, ``REMEMBERED`` bytes at most (and those
of the batch at hand); beyond that it starts anew. This bounds memory, not what is encoded.
"""

from __future__ import annotations

import ctypes
import os
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOKENIZER = "byte_bpe_50k.json"

#: Runs of blanks, white space other than a blank and a line end, and the two marks used below.
_ODD = r"[ \n]{2}|[\x{00}\x{01}\x{09}\x{0b}-\x{0d}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
#: Letters that every edition of Unicode has had, the end of a word's letters, and pieces that pre-tokenisation leaves whole.
_LETTER = r"A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}"
_CLOSING = rf"([{_LETTER}])([.,;:!?]+)$"
_WHOLE = rf"^(?: ?[{_LETTER}]+|[.,;:!?]+|\n)$"
REMEMBERED = 24 << 20
#: New pieces that the library gets in one call; for each of their ids it makes an object of some hundred bytes.
AT_ONCE = 8000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    kept = sys.modules.setdefault("_lectern_worker", types.ModuleType("_lectern_worker")).__dict__
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def give_back() -> None:
    """Hand freed memory back to the machine: a Python worker lives on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def _characters() -> str:
    """The character that stands for each byte in a byte-level vocabulary; byte 0, which parts pieces here, for itself."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    table = dict(zip(shown, map(chr, shown), strict=True)) | {b: chr(256 + k) for k, b in enumerate(hidden)} | {0: "\x00"}
    return "".join(table[b] for b in range(256))


class _Growing:
    """An array that doubles its room when it is full."""

    def __init__(self, kind):
        self.room, self.n = np.empty(1 << 12, kind), 0

    def add(self, values: np.ndarray) -> None:
        need = self.n + len(values)
        if need > len(self.room):
            room = np.empty(max(need, 2 * len(self.room)), self.room.dtype)
            room[: self.n] = self.room[: self.n]
            self.room = room
        self.room[self.n : need] = values
        self.n = need

    def get(self) -> np.ndarray:
        return self.room[: self.n]


class Encoder:
    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            text = f.read()
        self.tok, self.remembered = Tokenizer.from_str(text), remembered
        told = json.loads(text)
        pre = told.get("pre_tokenizer") or {}
        self.by_units = told["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not told.get("normalizer")
        self.special = [x["content"] for x in told.get("added_tokens", [])]
        if self.by_units:
            self.model = Tokenizer(self.tok.model)  # the same vocabulary, not a second one
        self.characters = _characters()
        vocab = told["model"].get("vocab") if self.by_units else {}
        size = max(vocab.values(), default=0) + 1
        self.kind = np.uint16 if size <= 1 << 16 else np.uint32
        self.bytes_of = np.zeros(size, np.int64)
        for token, i in vocab.items():
            self.bytes_of[i] = len(token)  # a character for each byte
        del told, vocab, text
        give_back()
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.flat, self.lens, self.starts = _Growing(self.kind), _Growing(np.int32), _Growing(np.int32)

    def held(self) -> int:
        """Bytes of what is remembered."""
        return self.known.nbytes + sum(x.room.nbytes for x in (self.flat, self.lens, self.starts))

    def _add(self, pieces: pa.Array, tok, written) -> None:
        for k in range(0, len(pieces), AT_ONCE):
            part = pieces.slice(k, AT_ONCE)
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part), pa.scalar("\x00", pa.large_string()))[0].as_py()
            ids = np.array(tok.encode_batch_fast([written(text).split("\x00")], is_pretokenized=True, add_special_tokens=False)[0].ids, self.kind)
            # the ids of a piece stand for exactly its bytes, so the bytes tell where a piece's ids end
            ends = np.cumsum(pc.binary_length(part).to_numpy())
            upto = np.searchsorted(np.cumsum(self.bytes_of[ids]), ends, side="right")
            upto[ends == 0] = 0
            base = self.flat.n
            lens = np.diff(upto, prepend=0)
            self.flat.add(ids)
            self.lens.add(lens)
            self.starts.add(base + upto - lens)

    def _mapped(self, pieces: str) -> str:
        return pieces.encode().decode("latin-1").translate(self.characters)

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        """Numbers of distinct pieces, each encoded when it is first seen."""
        if self.held() > self.remembered:
            self.clear()
        at = pc.index_in(pieces, value_set=self.known)
        new = at.is_null()
        out = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int32)
        fresh = pieces.filter(new)
        if len(fresh):
            whole = pc.match_substring_regex(fresh, _WHOLE)
            first, other = fresh.filter(whole), fresh.filter(pc.invert(whole))
            n = len(self.known)
            self._add(first, self.model, self._mapped)
            self._add(other, self.tok, lambda x: x)
            self.known = pa.concat_arrays([self.known, first, other])
            whole = whole.to_numpy(zero_copy_only=False)
            number = np.where(whole, np.cumsum(whole), len(first) + np.cumsum(~whole)) + (n - 1)
            out[new.to_numpy(zero_copy_only=False)] = number
        return out

    def _units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of distinct units one after another, number of ids of each)."""
        cut = pc.replace_substring(pc.replace_substring_regex(units, _CLOSING, "\\1\x01\\2"), "\n", "\n\x01")
        cut = pc.split_pattern(cut, "\x01")
        pieces = cut.flatten().dictionary_encode()
        number = self._numbers(pieces.dictionary)[pieces.indices.to_numpy()]
        ids, lens = _gather(self.flat.get(), self.starts.get()[number], self.lens.get()[number])
        ends = np.concatenate([[0], np.cumsum(lens)])
        return ids, np.diff(ends[cut.offsets.to_numpy()])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each); a null text has none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.by_units:
            odd = np.ones(len(texts), bool)
        else:
            odd = pc.match_substring_regex(texts, _ODD)
            for s in self.special:
                odd = pc.or_(odd, pc.match_substring(texts, s))
            odd = odd.to_numpy(zero_copy_only=False)
        if odd.all():
            return self._each(texts)
        plain = pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), texts) if odd.any() else texts
        # a unit but for the first is written with what stands before it, a blank or a line end
        cut = pc.split_pattern(pc.replace_substring(pc.replace_substring(plain, " ", "\x01 "), "\n", "\x01\n"), "\x01")
        units = cut.flatten().dictionary_encode()
        flat, lens = self._units(units.dictionary)
        at = units.indices.to_numpy()
        lens = lens.astype(np.int32)
        ids, lens = _gather(flat, (np.cumsum(lens) - lens).astype(np.int32)[at], lens[at])
        ends = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
        counts = np.diff(ends[cut.offsets.to_numpy()])
        ids = ids.astype(np.uint32)
        if odd.any():
            own, own_counts = self._each(texts.filter(pa.array(odd)))
            own = np.split(own, np.cumsum(own_counts)[:-1])
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for k, x in zip(np.flatnonzero(odd), own, strict=True):
                parts[k], counts[k] = x, len(x)
            ids = np.concatenate(parts)
        return ids, counts

    def _each(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same, every text by itself."""
        own = [np.array(self.tok.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts.to_pylist()]
        return np.concatenate([np.zeros(0, np.uint32), *own]), np.array([len(x) for x in own], np.int64)


def _gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``flat`` that begin at ``starts``, one after another, and their lengths."""
    ends = np.cumsum(lens, dtype=np.int32)
    at = np.repeat(starts - (ends - lens), lens)
    at += np.arange(len(at), dtype=np.int32)
    return flat[at], lens


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same with id ``end`` behind each text: (ids, counts, offsets of the texts and the total)."""
    counts = counts + 1
    offsets = np.concatenate([[0], np.cumsum(counts)])
    out = np.full(offsets[-1], end, "<u4")
    keep = np.ones(len(out), bool)
    keep[offsets[1:] - 1] = False
    out[keep] = ids
    return out, counts, offsets


def small_batches(batches, size: int = 4 << 20):
    """Cut record batches so that none holds much more than ``size`` bytes, but for a row that is longer alone. Memory that
    the rows before took is given back when the last one is done."""
    for b in batches:
        lengths = np.full(b.num_rows, 16, np.int64)
        for c in b.columns:
            if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) or pa.types.is_binary(c.type):
                lengths += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        at = 0
        upto = np.cumsum(lengths)
        while at < b.num_rows:
            end = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, side="right"))
            end = max(at + 1, end)
            yield b.slice(at, end - at)
            at = end
    give_back()
