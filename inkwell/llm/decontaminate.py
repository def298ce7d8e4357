"""Benchmark decontamination by q-gram lemma filtering.

Texts are lower-cased, every run of characters other than letters and numbers becomes one space. Every window of SEGMENT
characters of a benchmark item, at whatever offset, is searched (shorter items are one window). A window of L characters that
occurs in a document with at most k = floor(RATE * L) edits shares at least L - q + 1 - k * q of its q-grams with it, on
diagonals that lie within k of each other. So the q-grams that the whole item shares are gathered in diagonal bands
2 (k + 1) wide that overlap by half; the windows over a band's hits that reach the bound are verified by banded alignment.

Benchmarks of up to SLICE_CHARS characters are sent to the executors as one index; larger ones in several such slices, with
one pass over the documents for each.

Defined cases: null texts and items match nothing; items of fewer than MIN_CHARS normalised characters, whose edit budget would
match clean texts, are searched as they are, from a word's start to a word's end; items without letters and numbers match
nothing; rows with a null doc_id or item_id are ignored; repeated rows are reported once; empty tables
give no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import classes, codes, distinct, ragged, slices
from .shared import only, ready

Q, RATE, SEGMENT, MIN_CHARS = 10, 0.06, 96, 24
SLICE_CHARS = 8 << 20
FILTER_BITS = 22
_B = 0x9E3779B97F4A7C15 | 1


def normalised(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the normalised texts and offsets; a text may end with one space."""
    c, off = codes(pc.utf8_lower(pc.fill_null(col, "")))
    k = classes()[c]
    good = (k == 1) | (k == 2)
    before = np.zeros(len(c), bool)
    before[1:] = good[:-1]
    before[off[:-1][off[:-1] < len(c)]] = False
    keep = good | before
    out = np.where(good, c, np.uint32(32))[keep]
    return out, np.r_[0, np.cumsum(keep)][off]


def gram_hash(c: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q-gram at each position, by doubling."""
    if len(c) < q:
        return np.zeros(0, np.uint64)
    have, size, out, done = c.astype(np.uint64) + np.uint64(1), 1, None, 0
    todo = q
    while todo:
        if todo & 1:
            if out is None:
                out, done = have, size
            else:
                n = len(c) - done - size + 1
                out = out[:n] * np.uint64(pow(_B, size, 1 << 64)) + have[done : done + n]
                done += size
        todo >>= 1
        if todo:
            n = len(have) - size
            have = have[:n] * np.uint64(pow(_B, size, 1 << 64)) + have[size : size + n]
            size *= 2
    out = out[: len(c) - q + 1]
    out ^= out >> np.uint64(32)
    return out * np.uint64(0xD6E8FEB86659FD93)


def build_index(items: list[tuple[int, str]], q: int, rate: float, segment: int, least: int) -> dict:
    """The items and, by q-gram, where it stands in them."""
    item, texts, total, short = [], [], {}, {}
    c, off = normalised(pa.array([t for _, t in items], pa.string()))
    for n, (i, _) in enumerate(items):
        x = c[off[n] : off[n + 1]]
        x = x[:-1] if len(x) and x[-1] == 32 else x
        if len(x) < max(least, q):
            if len(x):
                short.setdefault(len(x), {}).setdefault(int(gram_hash(x, len(x))[0]), set()).add(i)
                total[i] = total.get(i, 0) + 1
            continue
        total[i] = total.get(i, 0) + max(1, len(x) - segment + 1)
        item.append(i)
        texts.append(x)
    length = np.array([len(x) for x in texts], np.int64)
    gram = np.concatenate([gram_hash(x, q) for x in texts]) if texts else np.zeros(0, np.uint64)
    of = np.repeat(np.arange(len(texts)), length - q + 1)
    pos = np.concatenate([np.arange(n - q + 1) for n in length]) if texts else np.zeros(0, np.int64)
    o = np.argsort(gram, kind="stable")
    gram, of, pos = gram[o], of[o], pos[o]
    keys, first = np.unique(gram, return_index=True)
    filt = np.zeros(1 << FILTER_BITS, bool)
    filt[(keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    size = np.minimum(length, segment)
    k = np.floor(rate * size).astype(np.int64)
    text = np.concatenate([*texts, np.zeros(segment, np.uint32)]).astype(np.uint32)
    return {"item": np.array(item, np.int64), "length": length, "size": size, "k": k, "need": np.maximum(size - q + 1 - k * q, 1), "text": text, "begin": np.cumsum(length) - length, "keys": keys, "first": np.r_[first, len(gram)], "of": of, "pos": pos, "filt": filt, "total": total, "q": q, "short": short}


def banded(seg: np.ndarray, size: np.ndarray, k: np.ndarray, text: np.ndarray, start: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: int) -> np.ndarray:
    """Least edits of each segment against its text on the diagonals start .. start + width - 1, free at both ends of the text."""
    n = len(size)
    d = np.arange(width)
    cost = np.zeros((n, width), np.int32)
    best = np.full(n, 1 << 20, np.int32)
    for i in range(int(size.max()) if n else 0):
        at = start[:, None] + d + i
        inside = (at >= lo[:, None]) & (at < hi[:, None])
        char = np.where(inside, text[np.clip(at, 0, len(text) - 1)], np.uint32(0xFFFFFFFF))
        new = cost + (char != seg[:, i : i + 1])
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(new - d, axis=1) + d
        done = size == i + 1
        if done.any():
            best[done] = cost[done].min(1)
    return best


def find(col: pa.Array, ix: dict) -> list[tuple[int, int, int, int]]:
    """(row, item, windows found, least edits) for the texts of a column."""
    c, off = normalised(col)
    found = _windows(c, off, ix)
    if ix["short"]:
        both = {(r, i): (n, e) for r, i, n, e in found}
        for r, i in _whole(c, off, ix["short"]):
            both[r, i] = (both.get((r, i), (0, 0))[0] + 1, 0)
        found = [(r, i, n, e) for (r, i), (n, e) in both.items()]
    return found


def _whole(c: np.ndarray, off: np.ndarray, short: dict) -> set[tuple[int, int]]:
    """(row, item) of the short items that stand in a text from a word's start to a word's end."""
    first = np.flatnonzero((c != 32) & np.r_[True, c[:-1] == 32][: len(c)])
    first = distinct(np.r_[first, off[:-1][off[:-1] < len(c)]])
    row = np.searchsorted(off, first, "right") - 1
    out = set()
    for size, items in short.items():
        to = first + size
        ok = to <= off[row + 1]
        ok[ok] &= (to[ok] == off[row[ok] + 1]) | (c[np.minimum(to[ok], len(c) - 1)] == 32)
        h = gram_hash(c, size)[first[ok]]
        some = np.isin(h, np.array(list(items), np.uint64))
        out |= {(r, i) for r, x in zip(row[ok][some].tolist(), h[some].tolist()) for i in items[x]}
    return out


def _windows(c: np.ndarray, off: np.ndarray, ix: dict) -> list[tuple[int, int, int, int]]:
    q = ix["q"]
    h = gram_hash(c, q)
    hit = np.flatnonzero(ix["filt"][(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
    if not len(hit) or not len(ix["keys"]):
        return []
    key = h[hit]
    at = np.searchsorted(ix["keys"], key)
    at[at == len(ix["keys"])] = 0
    row = np.searchsorted(off, hit, "right") - 1
    ok = (ix["keys"][at] == key) & (hit + q <= off[row + 1])
    hit, at, row = hit[ok], at[ok], row[ok]
    count = ix["first"][at + 1] - ix["first"][at]
    post = ragged(ix["first"][at], count)
    it, pos, row = ix["of"][post], ix["pos"][post], np.repeat(row, count)
    shift = int(ix["length"].max()) + 1
    band = (np.repeat(hit, count) - pos + shift) // (ix["k"][it] + 1)
    key = (it.astype(np.uint64) << np.uint64(44)) | (row.astype(np.uint64) << np.uint64(32)) | band.astype(np.uint64)
    # a hit counts in its band and in the one below, which it is the upper half of
    has = distinct(key)
    low = key - np.uint64(1)
    at = np.minimum(np.searchsorted(has, low), len(has) - 1) if len(has) else np.zeros(0, np.int64)
    low_too = has[at] == low if len(has) else np.zeros(0, bool)
    key, pos = np.r_[key, low[low_too]], np.r_[pos, pos[low_too]]
    o = np.lexsort((pos, key))
    key, pos = key[o], pos[o]
    it = (key >> np.uint64(44)).astype(np.int64)
    # windows over need hits in a row: they begin from lo to hi
    i = np.arange(len(key))
    j = i + ix["need"][it] - 1
    i, j = i[j < len(key)], j[j < len(key)]
    ok = (key[i] == key[j]) & (pos[j] - pos[i] <= ix["size"][it[i]] - q)
    i, j = i[ok], j[ok]
    if not len(i):
        return []
    key, it = key[i], it[i]
    lo, hi = np.maximum(pos[j] - (ix["size"][it] - q), 0), np.minimum(pos[i], ix["length"][it] - ix["size"][it])
    again = np.r_[False, key[1:] == key[:-1]]
    lo[again] = np.maximum(lo[again], hi[:-1][again[1:]] + 1)
    many = np.maximum(hi - lo + 1, 0)
    key, it, begin = np.repeat(key, many), np.repeat(it, many), ragged(lo, many)
    row = ((key >> np.uint64(32)) & np.uint64(0xFFF)).astype(np.int64)
    k, size = ix["k"][it], ix["size"][it]
    start = (key & np.uint64(0xFFFFFFFF)).astype(np.int64) * (k + 1) - shift + begin
    out: dict = {}
    for a in range(0, len(key), 4096):
        s = slice(a, a + 4096)
        top = int(k[s].max())
        wide = ix["text"][(ix["begin"][it[s]] + begin[s])[:, None] + np.arange(int(size[s].max()))]
        edits = banded(wide, size[s], k[s], c, start[s] - top, off[row[s]], off[row[s] + 1], 2 * (top + 1) + 2 * top)
        good = edits <= k[s]
        for r, g, b, e in zip(row[s][good].tolist(), it[s][good].tolist(), begin[s][good].tolist(), edits[good].tolist()):
            x = out.setdefault((r, int(ix["item"][g])), {})
            x[g, b] = min(e, x.get((g, b), e))
    return [(r, i, len(x), min(x.values())) for (r, i), x in out.items()]


def _scan(index):
    def run(batches):
        ix = index.value
        for batch in batches:
            for part in slices(batch, 1):
                found = find(part.column(1), ix)
                if found:
                    r, i, n, e = zip(*found)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(r)), pa.array(i, pa.int64()), pa.array(n, pa.int32()), pa.array([ix["total"][x] for x in i], pa.int32()), pa.array(e, pa.int32())], ["doc_id", "item_id", "segments", "of", "edits"])

    return run


def _clean(index, doc_id: int, text: int):
    """The rows that hold none of the index's items, and those without a doc_id."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                bad = np.zeros(part.num_rows, bool)
                bad[[r for r, *_ in find(part.column(text), index.value)]] = True
                yield part.filter(pa.array(~bad | np.asarray(part.column(doc_id).is_null())))

    return run


def _indexes(spark, benchmark: DataFrame, q: int, rate: float, segment: int, least: int, slice_chars: int) -> list:
    """Broadcast indexes of the benchmark, of about slice_chars characters each."""
    items = only(benchmark, "item_id", "text").filter("item_id is not null and text is not null").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-chars // slice_chars) or 1
    out = []
    for n in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == n).orderBy("item_id", "text").collect()
        out.append(spark.sparkContext.broadcast(build_index([(r[0], r[1]) for r in rows], q, rate, segment, least)))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, segment: int = SEGMENT, least: int = MIN_CHARS, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """(doc_id, item_id, segments, of, edits): documents that hold windows of SEGMENT characters of a benchmark item within
    the edit budget; how many, of how many, and the fewest edits."""
    spark = ready(docs.sparkSession)
    docs = only(docs, "doc_id", "text").filter("doc_id is not null and text is not null")
    out = None
    for index in _indexes(spark, benchmark, q, rate, segment, least, slice_chars):
        one = docs.mapInArrow(_scan(index), "doc_id bigint, item_id bigint, segments int, of int, edits int")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("doc_id", "item_id").agg(F.max("segments").alias("segments"), F.max("of").alias("of"), F.min("edits").alias("edits"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, segment: int = SEGMENT, least: int = MIN_CHARS, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """The rows of docs whose text doesn't leak, and those with a null doc_id; filtered as they are read, so nothing is shuffled. A
    clean text stays whatever other texts its doc_id stands on."""
    spark = ready(docs.sparkSession)
    for index in _indexes(spark, benchmark, q, rate, segment, least, slice_chars):
        docs = docs.mapInArrow(_clean(index, docs.columns.index("doc_id"), docs.columns.index("text")), docs.schema)
    return docs
