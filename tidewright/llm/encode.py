"""Exact, vectorised encoding with the public lower-case word-end BPE vocabulary.

A text's ids are the joined ids of its white-space-separated words, so each worker keeps a bounded
cache from word hash to ids.  Misses are split by the tokenizer's own pattern and merged for all
distinct pieces at once: one matrix a length, the lowest-ranked pair of every row merged each round.
Words with characters outside plain Latin (or that may hold a special token) go to the library.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer

from .tokens import words

CACHE_WORDS = 3_000_000
TEXT_CHUNK = 4 << 20
LONGEST = 48
NONE = np.int32(1 << 30)
_PIECES = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# Bytes of control characters, "<", and of any character from U+0240 on.
_UNSAFE = np.zeros(256, dtype=bool)
_UNSAFE[[*range(32), 60, 127, *range(0xC9, 256)]] = True


def _byte_alphabet() -> list[str]:
    """The printable stand-ins that byte-level BPE uses for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class WordEncoder:
    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        chars = _byte_alphabet()
        end = model.get("end_of_word_suffix") or ""
        self.inner = np.array([vocab[c] for c in chars], dtype=np.int32)
        self.final = np.array([vocab[c + end] for c in chars], dtype=np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        order = np.argsort(key)
        self.key, self.rank, self.made = key[order], order.astype(np.int32), made
        self._clear()

    def _clear(self) -> None:
        self.hashes = np.empty(0, dtype=np.uint64)
        self.at = np.empty(0, dtype=np.int64)
        self.size = np.empty(0, dtype=np.int64)
        self.flat = np.empty(0, dtype=np.int32)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 20 | b
        place = np.searchsorted(self.key, key).clip(max=len(self.key) - 1)
        return np.where((self.key[place] == key) & (a >= 0) & (b >= 0), self.rank[place], NONE)

    def _merge(self, raw: np.ndarray) -> np.ndarray:
        """Ids of pieces of equal length (a matrix of bytes); -1 fills the rows."""
        ids = self.inner[raw]
        ids[:, -1] = self.final[raw[:, -1]]
        out = np.full(ids.shape, -1, dtype=np.int32)
        rows, rank = np.arange(len(raw)), self._ranks(ids[:, :-1], ids[:, 1:])
        while len(rows) and ids.shape[1] > 1:
            j = rank.argmin(axis=1)
            best = rank[np.arange(len(rows)), j]
            more = best != NONE
            if not more.all():
                out[rows[~more], : ids.shape[1]] = ids[~more]
                rows, ids, rank, j, best = rows[more], ids[more], rank[more], j[more], best[more]
                if not len(rows):
                    break
            line, width = np.arange(len(rows)), ids.shape[1] - 1
            keep = np.ones(ids.shape, dtype=bool)
            keep[line, j + 1] = False
            ids = ids[keep].reshape(len(rows), width)
            ids[line, j] = self.made[best]
            keep = np.ones(rank.shape, dtype=bool)
            keep[line, j] = False
            rank = rank[keep].reshape(len(rows), width - 1)
            if width > 1:
                left = np.flatnonzero(j > 0)
                rank[left, j[left] - 1] = self._ranks(ids[left, j[left] - 1], ids[left, j[left]])
                right = np.flatnonzero(j < width - 1)
                rank[right, j[right]] = self._ranks(ids[right, j[right]], ids[right, j[right] + 1])
        out[rows, : ids.shape[1]] = ids
        return out

    def _pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids of distinct pieces with each piece's start and size."""
        length = np.array([len(p) for p in pieces], dtype=np.int64)
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        first = np.cumsum(length) - length
        at, size, flat, used = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64), [], 0
        for n in np.unique(length):
            group = np.flatnonzero(length == n)
            ids = self._merge(data[first[group][:, None] + np.arange(n)])
            good = ids >= 0
            size[group] = good.sum(axis=1)
            at[group] = used + np.cumsum(size[group]) - size[group]
            flat.append(ids[good])
            used += len(flat[-1])
        return np.concatenate(flat) if flat else np.empty(0, np.int32), at, size

    def encode_words(self, found: list[bytes], odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and sizes of words without ASCII white space; ``odd`` ones go to the library."""
        size = np.zeros(len(found), dtype=np.int64)
        plain = np.flatnonzero(~odd)
        index: dict[str, int] = {"\n": 0}
        text = b"\n".join([found[i] for i in plain]).decode().lower()
        seq = np.array([index.setdefault(p, len(index)) for p in _PIECES.findall(text)], dtype=np.int64)
        flat, at, length = self._pieces([p.encode() for p in index])
        word = np.cumsum(seq == 0)[seq != 0]
        seq = seq[seq != 0]
        size[plain] = np.bincount(word, weights=length[seq], minlength=len(plain)).astype(np.int64)[: len(plain)]
        ids = flat[_ranges(at[seq], length[seq])]
        if len(plain) == len(found):
            return ids, size
        own = [x.ids for x in self.library.encode_batch([found[i].decode("utf-8", "replace") for i in np.flatnonzero(odd)], add_special_tokens=False)]
        size[odd] = [len(x) for x in own]
        out = np.empty(size.sum(), dtype=np.int32)
        of_odd = np.repeat(odd, size)
        out[~of_odd] = ids
        out[of_odd] = np.fromiter((k for x in own for k in x), dtype=np.int32)
        return out, size

    def _learn(self, w, distinct: np.ndarray, sample: np.ndarray) -> None:
        if len(self.hashes) + len(distinct) > CACHE_WORDS:
            self._clear()
        place = np.searchsorted(self.hashes, distinct)
        have = np.zeros(len(distinct), dtype=bool)
        if len(self.hashes):
            have = self.hashes[place.clip(max=len(self.hashes) - 1)] == distinct
        new = np.flatnonzero(~have)
        if len(new):
            raw, starts, ends = w.data.tobytes(), w.starts[sample[new]], w.ends[sample[new]]
            unsafe = _UNSAFE[w.data]
            unsafe[:-1] |= (w.data[:-1] == 0xC2) & (w.data[1:] <= 0xA0)
            count = np.concatenate([[0], np.cumsum(unsafe)])
            odd = (count[ends] > count[starts]) | (ends - starts > LONGEST)
            ids, size = self.encode_words([raw[a:z] for a, z in zip(starts.tolist(), ends.tolist())], odd)
            at = len(self.flat) + np.cumsum(size) - size
            self.flat = np.concatenate([self.flat, ids])
            self.hashes = np.insert(self.hashes, place[new], distinct[new])
            self.at = np.insert(self.at, place[new], at)
            self.size = np.insert(self.size, place[new], size)

    def documents(self, column: pa.Array):
        """(position in the column, ids) of every text."""
        for w in words(column, lower=False, limit=TEXT_CHUNK):
            distinct, sample, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
            self._learn(w, distinct, sample)
            entry = np.searchsorted(self.hashes, distinct)[inverse] if len(distinct) else np.empty(0, np.int64)
            size = self.size[entry]
            ends = np.concatenate([[0], np.cumsum(size)])[w.first]
            ids = self.flat[_ranges(self.at[entry], size)]
            for i in range(w.hi - w.lo):
                yield w.lo + i, ids[ends[i] : ends[i + 1]]


def _ranges(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """at[0], at[0] + 1, ... of each range of ``size`` in turn."""
    return np.arange(size.sum()) + np.repeat(at - (np.cumsum(size) - size), size)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder a worker and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
