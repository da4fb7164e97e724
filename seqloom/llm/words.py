"""Words and word shingles of whole Arrow text columns, without a Python loop over words.

A word is a maximal run of characters other than the ASCII white space 0x20 and 0x09-0x0D; A-Z are
lower-cased, nothing else. Every function takes whole texts: none is cut, however long.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
#: Text bytes handled at a time inside a batch, so that temporaries stay bounded. One longer text is a slice of its own.
SLICE_BYTES = 4_000_000

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a fixed bijection on 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def numbers(seed: int, n: int) -> np.ndarray:
    """n fixed 64-bit values that look random."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=_U) + _U(seed) * _U(1_000_003)) * _U(0x9E3779B97F4A7C15))


_BYTE = numbers(1, 256)
_STEP = int(numbers(2, 1)[0]) | 1
OTHER_STEP = int(numbers(4, 1)[0]) | 1
_PLACE = numbers(3, SHINGLE) | _U(1)


def give_back() -> None:
    """Returns freed memory to the system; workers live long and go from one operator to the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library: it keeps what it has
        pass


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """batch in runs of rows of about SLICE_BYTES of text."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(size)
    start = 0
    while start < len(size):
        base = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, base + SLICE_BYTES, "right")))
        yield batch.slice(start, end - start)
        start = end
    give_back()


def split(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(codes, offsets, uniques): text i has the words uniques[codes[offsets[i]:offsets[i + 1]]]; a null has none. Not lower: letters stay as they are."""
    lists = pc.ascii_split_whitespace(pc.fill_null(pc.ascii_lower(texts) if lower else texts, ""))
    off = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(off[0], off[-1] - off[0]) if len(off) else lists.values
    off = off - off[0]
    coded = flat.dictionary_encode()
    codes, uniques = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    empty = np.flatnonzero(pc.equal(uniques, "").to_numpy(zero_copy_only=False))
    if len(empty):
        keep = codes != empty[0]
        off = np.concatenate([[0], np.cumsum(keep)])[off]
        codes = codes[keep]
    return codes, off, uniques


def string_bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array."""
    width = np.int64 if pa.types.is_large_string(strings.type) else np.int32
    _, o, data = strings.buffers()
    off = np.frombuffer(o, width)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(off) else np.zeros(0, np.uint8)
    return raw, off - (off[0] if len(off) else 0)


#: Strings are hashed in pieces of so many bytes, and so many bytes at a time: temporaries do not grow with a string.
PIECE, AT_ONCE = 1 << 16, 1 << 20


def hash_strings(strings: pa.Array, step: int = _STEP) -> np.ndarray:
    """A 64-bit hash of each string: a polynomial in step over random byte values, mixed."""
    if not len(strings):
        return np.zeros(0, _U)
    raw, off = string_bytes(strings)
    length = np.diff(off)
    n = np.maximum(-(-length // PIECE), 1)
    first = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(n)), n)
    number = np.arange(len(owner)) - first[owner]
    start = off[:-1][owner] + number * PIECE
    end = np.minimum(start + PIECE, off[1:][owner])
    sums = np.zeros(len(owner), _U)
    with np.errstate(over="ignore"):
        power = np.ones(PIECE + 1, _U)
        np.multiply.accumulate(np.full(PIECE, step, _U), out=power[1:])
        at = 0
        while at < len(owner):  # pieces stand one after the other in raw
            to = max(at + 1, int(np.searchsorted(end, start[at] + AT_ONCE, "right")))
            size = end[at:to] - start[at:to]
            place = np.arange(end[to - 1] - start[at]) - np.repeat(start[at:to] - start[at], size)
            sums[at:to] = run_sums(_BYTE[raw[start[at] : end[to - 1]]] * power[place], np.append(start[at:to], end[to - 1]) - start[at])
            at = to
        if len(owner) > len(n):
            far = np.ones(int(n.max()), _U)
            np.multiply.accumulate(np.full(len(far) - 1, power[PIECE], _U), out=far[1:])
            sums = np.add.reduceat(sums * far[number], first)
        return mix(sums + length.astype(_U) * _U(0x632BE59BD9B4E019))


def shingles(word_hash: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of the k-word shingles in order, repeats included. A text of 1 to k-1 words gives its whole
    sequence as one shingle; a text without words gives none."""
    n = np.diff(off)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    out_off = np.concatenate([[0], np.cumsum(count)])
    start = np.repeat(off[:-1] - out_off[:-1], count) + np.arange(out_off[-1])
    have = np.minimum(np.repeat(n, count), k)
    padded = np.concatenate([word_hash, np.zeros(k, _U)])
    with np.errstate(over="ignore"):
        s = np.zeros(len(start), _U)
        short = bool(len(have)) and int(have.min()) < k
        for j in range(k):
            part = padded[start + j] * _PLACE[j]
            s += np.where(have > j, part, _U(0)) if short and j else part
        return mix(s + have.astype(_U)), out_off


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the sorted distinct shingle hashes of each text."""
    codes, off, uniques = split(texts)
    s, o = shingles(hash_strings(uniques)[codes], off, k)
    return distinct(s, o)


def distinct(s: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each run of s sorted, without repeats."""
    s = s.copy()
    for a, b in zip(o[:-1].tolist(), o[1:].tolist()):
        s[a:b].sort()
    if not len(s):
        return s, o
    fresh = np.ones(len(s), bool)
    fresh[1:] = s[1:] != s[:-1]
    fresh[o[:-1][np.diff(o) > 0]] = True
    return s[fresh], np.concatenate([[0], np.cumsum(fresh)])[o]


def run_sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The sum of each run, 0 for an empty one; integers wrap."""
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]
