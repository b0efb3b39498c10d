"""Whole-block numpy work on the UTF-8 bytes of Arrow text columns: words, shingles and rolling hashes.

Every function takes a block: the concatenated bytes of some rows and the offsets of the rows in them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from fabriloom.llm.common import mix64

#: Odd multipliers of the hashes, and the bytes from which on a span is hashed by blake2b.
SPREAD, TURN, LONG = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), 65


def _table(bytes_of, word: bool = True) -> np.ndarray:
    out = np.full(256, not word)
    out[list(bytes_of)] = word
    return out


#: Word bytes of the two word definitions: everything but space and 09-0D; digits, letters and non-ASCII.
NOT_SPACE = ~_table([0x20, *range(0x09, 0x0E)])
ALNUM = _table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def blocks(column: pa.Array, limit: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for runs of rows of about limit bytes; nulls are empty. What Arrow
    freed of earlier batches goes back to the system first: two Python workers stand beside a full JVM heap."""
    pa.default_memory_pool().release_unused()
    text = column.cast(pa.large_string()).fill_null("")
    n = len(text)
    if not n:
        return
    _, offsets, data = text.buffers()
    at = np.frombuffer(offsets, np.int64)[text.offset : text.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def _runs(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place of a block on, as a number; behind the block come zeros."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes from start to end that does not depend on where they stand: of spans below LONG bytes their
    runs of 8 bytes, scrambled one after the other, so that nothing cancels out; of longer ones blake2b."""
    runs, size = _runs(data), end - start
    own, tail = runs[start], runs[np.maximum(end - 8, start)]
    short = size < 8
    if short.any():
        own[short] &= (np.uint64(1) << (size[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        tail[short] = 0
    total = mix64(own + size.astype(np.uint64) * SPREAD)
    at = np.flatnonzero((size > 16) & (size < LONG))
    for step in range(8, LONG, 8):
        at = at[size[at] > step + 8]
        if not len(at):
            break
        total[at] = mix64(total[at] * TURN + runs[start[at] + step])
    total = mix64(total * TURN + tail)
    if (size >= LONG).any():
        raw = memoryview(np.ascontiguousarray(data))
        for i in np.flatnonzero(size >= LONG):
            total[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]], digest_size=8).digest(), "little")
    return total


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128 bits of blake2b of the bytes from start to end of each span, as a row of two numbers."""
    raw = memoryview(np.ascontiguousarray(data))
    found = b"".join(hashlib.blake2b(raw[a:z], digest_size=16).digest() for a, z in zip(start.tolist(), end.tolist()))
    return np.frombuffer(found, "<u8").reshape(-1, 2)


def grams(data: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A hash of every run of width bytes, 8 or more, of a block: of two halves (which overlap where width is no power of two),
    scrambled at every doubling, so that nothing cancels out."""
    if len(data) < width:
        return np.zeros(0, np.uint64)
    out, have = mix64(_runs(data)[: len(data) - 7] + np.uint64((width * int(TURN) + seed) % 2**64)), 8
    while have < width:
        step = min(have, width - have)
        out = mix64(out[:-step] * SPREAD + (out[step:] ^ (out[step:] >> np.uint64(29))))
        have += step
    return out


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the row it stands in; words never cross rows."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def pieces(data: np.ndarray, is_word: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Cuts of a block into parts of about limit bytes, none of them inside a word."""
    lo = 0
    while lo < len(data):
        hi = min(len(data), lo + limit)
        while hi < len(data):
            gap = np.flatnonzero(~is_word[data[hi : hi + limit]])
            if len(gap):
                hi += int(gap[0])
                break
            hi = min(len(data), hi + limit)
        yield lo, hi
        lo = hi


def word_hashes(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, limit: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start, end) of each word; A-Z count as a-z. Very long texts are worked on in parts."""
    if len(data) > limit and len(offsets) == 2:
        out = [(h, row, start + lo, end + lo) for lo, hi in pieces(LOWER[data], is_word, limit) for h, row, start, end in [word_hashes(data[lo:hi], np.array([0, hi - lo]), is_word, 1 << 62)]]
        return tuple(np.concatenate(x) for x in zip(*out))
    low = LOWER[data]
    start, end, row = word_bounds(low, offsets, is_word)
    return span_hashes(low, start, end), row, start, end


SHINGLE_FACTORS = np.random.default_rng(51).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(words: np.ndarray, rows: np.ndarray, k: int, short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, index of the first word) of each run of k words of a row. With short, a row of fewer words,
    but not none, has one shingle of all its words."""
    n = len(words)
    at = np.flatnonzero(rows[k - 1 :] == rows[: n - k + 1]) if n >= k else np.zeros(0, np.int64)
    total = np.zeros(len(at), np.uint64)
    for j in range(k):
        total += words[at + j] * SHINGLE_FACTORS[j]
    out, out_row, out_at = mix64(total), rows[at], at
    if short and n:
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        many = np.diff(np.r_[first, n])
        for m in range(1, k):
            some = first[many == m]
            if len(some):
                total = np.full(len(some), m, np.uint64) * SHINGLE_FACTORS[-1]
                for j in range(m):
                    total += words[some + j] * SHINGLE_FACTORS[j]
                out, out_row, out_at = np.r_[out, mix64(total)], np.r_[out_row, rows[some]], np.r_[out_at, some]
        order = np.argsort(out_row, kind="stable")
        out, out_row, out_at = out[order], out_row[order], out_at[order]
    return out, out_row, out_at


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
