"""Texts of an Arrow batch as flat numpy arrays: code points, lines, words, n-grams and their hashes."""

from __future__ import annotations

import ctypes
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

R = 0x9E3779B97F4A7C15 | 1
R_INV = pow(R, -1, 1 << 64)
_pow: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _pow.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _pow[base] = have = np.multiply.accumulate(have)
    return have[:n]


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order, by a plain sort: many times as fast as np.unique, which hashes, for 64-bit numbers."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]][: len(x)]]


def trim() -> None:
    """Gives memory that isn't in use back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batch: pa.RecordBatch, text: int, max_bytes: int = 1 << 19, max_rows: int = 4096):
    """Cuts a batch into pieces of about max_bytes of text; a longer text stands alone."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64)
    ends = np.cumsum(sizes)
    at, n = 0, len(sizes)
    while at < n:
        base = ends[at - 1] if at else 0
        to = int(np.searchsorted(ends, base + max_bytes, "right"))
        to = min(max(to, at + 1), at + max_rows, n)
        yield batch.slice(at, to - at)
        at = to
    trim()


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets; a null is empty."""
    col = pc.fill_null(col, "").cast(pa.large_string())
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64, len(col) + 1, col.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def codes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and the n + 1 offsets."""
    raw, off = utf8(col)
    out = np.frombuffer(str(memoryview(raw), "utf-8").encode("utf-32-le"), np.uint32)
    if len(out) == len(raw):
        return out, off
    return out, np.r_[0, np.cumsum(np.asarray(pc.utf8_length(pc.fill_null(col, ""))), dtype=np.int64)]


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = R) -> np.ndarray:
    """A 64-bit polynomial hash of each span of values, mixed."""
    inv = pow(base, -1, 1 << 64)
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    x = total[1:]
    x[:] = values
    x += np.uint64(1)
    x *= powers(base, n)
    np.cumsum(x, out=x)
    h = (total[end] - total[start]) * powers(inv, n + 1)[start]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


_WORD = np.zeros(256, bool)
_WORD[128:] = True
for _c in b"0123456789_abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _WORD[_c] = True


def words(col: pa.Array):
    """Words of the lower-cased texts (runs of ASCII letters, digits, _ and all non-ASCII): start, end, row, hash, raw bytes, offsets."""
    raw, off = utf8(pc.utf8_lower(pc.fill_null(col, "")))
    n = len(raw)
    w = np.zeros(n + 1, bool)
    w[:n] = _WORD[raw]
    prev = np.zeros(n + 1, bool)
    prev[1:] = w[:-1]
    prev[off] = False
    start = np.flatnonzero(w & ~prev)
    nxt = np.zeros(n + 1, bool)
    nxt[:n] = w[1:]
    nxt[off[1:] - 1] = False
    end = np.flatnonzero(w & ~nxt) + 1
    row = np.searchsorted(off, start, "right") - 1
    return start, end, row, span_hash(raw, start, end), raw, off


def ngram_hash(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of word n-grams and their rows; a text of fewer than n words, but at least one, gives the gram of all its words."""
    if not len(h):
        return h, row
    out = h * np.uint64(0x9E3779B97F4A7C15)
    whole = np.ones(len(h), bool)
    for k in range(1, n):
        nxt = np.zeros(len(h), np.uint64)
        nxt[:-k] = h[k:]
        same = np.zeros(len(h), bool)
        same[:-k] = row[k:] == row[:-k]
        whole &= same
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + np.where(same, nxt, np.uint64(0))
    count = np.bincount(row)
    first = np.r_[True, row[1:] != row[:-1]]
    keep = whole | (first & (count[row] < n))
    out = out[keep]
    out ^= out >> np.uint64(30)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    return out, row[keep]


_classes: dict[str, np.ndarray] = {}


def classes() -> np.ndarray:
    """By code point: 0 white space, 1 letter, 2 number, 3 anything else."""
    if "k" not in _classes:
        k = np.full(sys.maxunicode + 1, 3, np.uint8)
        for c in range(sys.maxunicode + 1):
            g = unicodedata.category(chr(c))[0]
            if g == "L":
                k[c] = 1
            elif g == "N":
                k[c] = 2
        for c in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
            k[c] = 0
        _classes["k"] = k
    return _classes["k"]


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indices start[0] .. start[0]+length[0]-1, start[1] .. and so on."""
    total = int(length.sum())
    ends = np.cumsum(length)
    return np.arange(total) + np.repeat(start - (ends - length), length)


def packed(*columns: np.ndarray) -> bytes:
    """Arrays of whole numbers of at least 0, or of int64: byte planes, compressed."""
    out = [np.array([len(columns)], "<u4").tobytes()]
    for x in columns:
        x = x.view(np.uint64) if x.dtype == np.int64 else x.astype(np.uint64)
        data = pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T), codec="zstd", asbytes=True) if len(x) else b""
        out += [np.array([len(x), len(data)], "<u4").tobytes(), data]
    return b"".join(out)


def unpacked(data) -> list[np.ndarray]:
    """The arrays, as uint64."""
    data = memoryview(data)
    out, at = [], 4
    for _ in range(int(np.frombuffer(data[:4], "<u4")[0])):
        n, size = (int(x) for x in np.frombuffer(data[at : at + 8], "<u4"))
        at += 8
        out.append(np.ascontiguousarray(np.frombuffer(pa.decompress(data[at : at + size], decompressed_size=8 * n, codec="zstd"), np.uint8).reshape(8, n).T).view(np.uint64).ravel() if n else np.zeros(0, np.uint64))
        at += size
    return out


def most_common(size_a: int, size_b: int, x: bytes, y: bytes) -> int:
    """An upper bound of the overlap of two sets from their parity bitmaps; the longer is folded to the shorter."""
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return (size_a + size_b - int(np.bitwise_count(x ^ y).sum())) // 2
