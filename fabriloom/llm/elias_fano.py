"""Elias-Fano coded sequences and n-gram tries over them, kept in one file that is mapped into memory.

A sequence of n values up to u takes about 2 + log2(u / n) bits a value: low bits are packed, high bits are the places
of ones in a bit string, and a count for each 64 of its bits finds them again. All searches take arrays of queries."""

from __future__ import annotations

import json

import numpy as np

_U = np.uint64
#: Queries searched at a time, so that what a step makes stays in the processor's cache.
CHUNK = 1 << 14
_BITS = np.array([bin(b).count("1") for b in range(256)], np.uint8)
#: place of the j-th one in a byte, by 8 * byte + j
_ONE = np.zeros(256 * 8, np.uint8)
for _b in range(256):
    for _j, _p in enumerate(p for p in range(8) if _b >> p & 1):
        _ONE[_b * 8 + _j] = _p


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """values of width bits one after the other in 64-bit words."""
    out = np.zeros(len(values) * width // 64 + 2, _U)
    if width:
        at = np.arange(len(values), dtype=np.int64) * width
        word, shift = at >> 6, (at & 63).astype(_U)
        low = values << shift
        high = np.where(shift > 0, values >> (_U(64) - np.maximum(shift, _U(1))), _U(0))
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
        if len(first):
            out[word[first]] |= np.bitwise_or.reduceat(low, first)
            out[word[first] + 1] |= np.bitwise_or.reduceat(high, first)
    return out


class Sequence:
    """n values that never fall, as arrays low, bits and ones (each of which may be a mapped file)."""

    def __init__(self, n: int, width: int, low: np.ndarray, bits: np.ndarray, ones: np.ndarray):
        self.n, self.width, self.low, self.bits, self.ones = n, width, low, bits, ones
        self.zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones

    @classmethod
    def of(cls, values: np.ndarray) -> Sequence:
        values = np.ascontiguousarray(values, _U)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, top.bit_length() - max(1, n).bit_length())
        high = (values >> _U(width)).astype(np.int64)
        at = high + np.arange(n)
        size = (top >> width) + n + 2
        raw = np.zeros(-(-size // 64) * 64, bool)
        raw[at] = True
        bits = np.packbits(raw, bitorder="little").view(_U)
        ones = np.r_[0, np.cumsum(_BITS[bits.view(np.uint8)].reshape(-1, 8).sum(axis=1, dtype=np.int64))]
        return cls(n, width, _pack(values & _U((1 << width) - 1), width), bits, ones.astype(np.int64))

    def parts(self) -> dict[str, np.ndarray]:
        return {"low": self.low, "bits": self.bits, "ones": self.ones}

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """The place of the k-th (from 0) one or zero."""
        counts = self.ones if ones else self.zeros
        word = np.searchsorted(counts, k, "right") - 1
        value = np.asarray(self.bits)[word]
        value = value if ones else ~value
        left = (k - counts[word]).astype(np.int64)
        octets = value.view(np.uint8).reshape(-1, 8)
        ends = np.cumsum(_BITS[octets], axis=1, dtype=np.int16)
        byte = (ends <= left[:, None]).sum(axis=1)
        row = np.arange(len(k))
        left -= np.where(byte > 0, ends[row, np.maximum(byte - 1, 0)], 0)
        return word * 64 + byte * 8 + _ONE[octets[row, byte].astype(np.int64) * 8 + left]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), _U)
        at = i.astype(np.int64) * self.width
        word, shift = at >> 6, (at & 63).astype(_U)
        got = self.low[word] >> shift | np.where(shift > 0, self.low[word + 1] << (_U(64) - np.maximum(shift, _U(1))), _U(0))
        return got & _U((1 << self.width) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        i = np.asarray(i, np.int64)
        return (self._select(i, True) - i).astype(_U) << _U(self.width) | self._low(i)

    def successor(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each query the index of the first value that isn't less (n: none), and whether it is equal. The high bits name
        a bucket of values, in which the low bits are searched by halving."""
        q = np.asarray(q, _U)
        if not self.n or not len(q):
            return np.full(len(q), self.n, np.int64), np.zeros(len(q), bool)
        if len(q) > CHUNK:
            parts = [self.successor(q[lo : lo + CHUNK]) for lo in range(0, len(q), CHUNK)]
            return np.concatenate([i for i, _ in parts]), np.concatenate([e for _, e in parts])
        most = int(self.zeros[-1]) - 1
        h = np.minimum(q >> _U(self.width), _U(most)).astype(np.int64)
        lo = np.where(h > 0, self._select(np.maximum(h - 1, 0), False) - np.maximum(h - 1, 0), 0)
        end = hi = self._select(h, False) - h
        want = q & _U((1 << self.width) - 1)
        while (lo < hi).any():
            mid = (lo + hi) >> 1
            less = (self._low(np.minimum(mid, self.n - 1)) < want) & (lo < hi)
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, np.maximum(mid, lo))
        inside = (lo < end) & (q >> _U(self.width) == h.astype(_U))
        equal = inside & (self._low(np.minimum(lo, self.n - 1)) == want)
        return np.where(q >> _U(self.width) > _U(most), self.n, lo), equal


class Trie:
    """Levels of n-grams. words are the sorted roots with their counts; further levels hold each node's children by the
    vocabulary's ids, as one rising sequence of parent * len(vocabulary) + id, with pointers to each parent's first child,
    and codes for each node. open() maps a file that save() wrote."""

    def __init__(self, words: Sequence, counts: np.ndarray, vocabulary: Sequence, levels: list[tuple[Sequence, Sequence, np.ndarray]]):
        self.words, self.counts, self.vocabulary, self.levels = words, counts, vocabulary, levels

    @classmethod
    def of(cls, words: np.ndarray, counts: np.ndarray, vocabulary: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Trie:
        """levels: (parent's index, vocabulary id, codes (rows)) of each node, sorted by parent and id."""
        above, built = len(words), []
        for parent, ident, codes in levels:
            pointers = np.searchsorted(parent, np.arange(above + 1))
            built.append((Sequence.of(parent.astype(_U) * _U(max(1, len(vocabulary))) + ident.astype(_U)), Sequence.of(pointers), codes))
            above = len(parent)
        return cls(Sequence.of(words), counts, Sequence.of(vocabulary), built)

    def save(self, path: str) -> None:
        arrays, about = [], []
        for sequence in (self.words, self.vocabulary, *(s for keys, pointers, _ in self.levels for s in (keys, pointers))):
            about.append([sequence.n, sequence.width])
            arrays += sequence.parts().values()
        arrays += [self.counts, *(codes for _, _, codes in self.levels)]
        head = json.dumps({"about": about, "arrays": [[a.dtype.str, list(a.shape)] for a in arrays]}).encode()
        with open(path, "wb") as out:
            out.write(len(head).to_bytes(8, "little") + head)
            for a in arrays:
                out.write(bytes(-out.tell() % 8))
                out.write(np.ascontiguousarray(a).data)

    @classmethod
    def open(cls, path: str) -> Trie:
        raw = np.memmap(path, np.uint8, "r")
        size = int.from_bytes(raw[:8].tobytes(), "little")
        head, at, arrays = json.loads(raw[8 : 8 + size].tobytes()), 8 + size, []
        for kind, shape in head["arrays"]:
            at += -at % 8
            n = int(np.prod(shape)) * np.dtype(kind).itemsize
            arrays.append(raw[at : at + n].view(kind).reshape(shape))
            at += n
        found = [Sequence(n, width, *arrays[3 * k : 3 * k + 3]) for k, (n, width) in enumerate(head["about"])]
        rest = arrays[3 * len(found) :]
        return cls(found[0], rest[0], found[1], [(found[2 * k + 2], found[2 * k + 3], codes) for k, codes in enumerate(rest[1:])])

    def root(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's index, and whether it is known."""
        return self.words.successor(words)

    def child(self, level: int, parent: np.ndarray, ident: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of each parent's child by its id, and whether there is one: the successor of the id relative to its
        context, which counts if it stands before the next context's first child. Queries are sorted by parent; known says
        for which both parent and id exist."""
        keys, pointers, _ = self.levels[level]
        at, hit = np.zeros(len(parent), np.int64), np.zeros(len(parent), bool)
        some = np.flatnonzero(known)
        if len(some) and keys.n:
            above = parent[some].astype(np.int64)
            found, equal = keys.successor(above.astype(_U) * _U(max(1, self.vocabulary.n)) + ident[some].astype(_U))
            turn = np.r_[True, above[1:] != above[:-1]]
            end = pointers.get(above[turn] + 1).astype(np.int64)[np.cumsum(turn) - 1]
            at[some] = np.minimum(found, keys.n - 1)
            hit[some] = equal & (found < end)
        return at, hit
