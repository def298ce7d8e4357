"""Line dedup: fuzzy lines by MinHash.

A line (between line feeds) is normalised: lower case, white space as single spaces, trimmed. It is the set of its
K-character shingles (a line of fewer characters: itself). 60 minima of multiplied shingle hashes, in BANDS bands of ROWS, give candidates: lines
that agree in a band (0.991 of those with Jaccard 0.8) and in LEAST of the 60 minima by two bits of each (all but 2 in 100,000
of those with Jaccard 0.8: 51 agree on average, with a deviation of 2.8). Candidates whose numbers of shingles and parity bitmaps
allow it are verified by exact Jaccard of their shingle sets, and the verified edges go through distributed union-find; of each component the first line (by doc_id, text
hash, line number) is kept.

Equal normalised lines are one node (a 64-bit hash) throughout. Every line of a band's bucket is first compared with the
bucket's least node; the nodes of a bucket that are then in different components are compared with each other. So every
candidate pair is either verified or already connected, and a bucket of thousands of copies costs thousands of checks. Bands
are shuffled packed, sketches once a line, and texts only of lines whose sketch agrees with another's of their bands.

Defined cases: empty (blank) lines are kept and never compared; a null text stays null; a null doc_id is a document like any
other (least of all); rows that repeat doc_id and text are one document: they lose the same lines; an empty table gives no
rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import codes, distinct, packed, ragged, slices, span_hash, trim, unpacked
from .components import components
from .decontaminate import gram_hash
from .shared import dropped, key_bitmap, may_hold, only, ready, written

K, BANDS, ROWS, THRESHOLD = 5, 12, 5, 0.8
LEAST, BAND_BITS = 40, 44
#: Rows that a task packs at once; pairs that it compares at once.
PACKED, STEP = 1_000_000, 1 << 18
#: Shingles that are multiplied at once.
SHINGLES = 1 << 17
_SPACE = np.zeros(0x3001, bool)
_SPACE[[*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True


def lines(col: pa.Array):
    """Normalised lines: code points (with line feeds), start, end, row and number of each line that isn't blank."""
    c, off = codes(pc.utf8_lower(pc.fill_null(col, "")))
    # the places of white space, line feeds among it
    few = np.flatnonzero((c <= 32) | (c - np.uint32(0x85) <= 0x3000 - 0x85))
    few = few[_SPACE[c[few]]]
    kind = c[few]
    feed = kind == 10
    begins = np.zeros(len(c) + 1, bool)
    begins[off] = True
    # white space goes where white space or a line's start is before it; what then ends a line is trimmed below
    drop = few[~feed & ((np.diff(few, prepend=-1) == 1) | begins[few])]
    odd = few[~feed & (kind != 32)]
    feeds = few[feed]
    if len(odd):
        c = c.copy()
        c[odd] = 32
    if len(drop):
        keep = np.ones(len(c), bool)
        keep[drop] = False
        off = off - np.searchsorted(drop, off)
        feeds = feeds - np.searchsorted(drop, feeds)
        c = c[keep]
    start = distinct(np.concatenate([feeds + 1, off]))
    start = start[start < len(c)]
    if not len(start):
        return c, *[np.zeros(0, np.int64)] * 4
    end = np.r_[start[1:], len(c)]
    row = np.searchsorted(off, start, "right") - 1
    first = np.searchsorted(start, off[:-1])
    number = np.arange(len(start)) - first[row]
    end = end - (c[end - 1] == 10)
    end = end - ((end > start) & (c[np.maximum(end - 1, 0)] == 32))
    some = end > start
    return c, start[some], end[some], row[some], number[some]


_MULT = (np.random.default_rng(11).integers(0, 2**31, BANDS * ROWS // 2, np.uint32) << 1 | 1).astype(np.uint32)


def shingle_hash(c: np.ndarray, k: int = K) -> np.ndarray:
    """A 32-bit hash of c[i : i + k] for each i."""
    c = c.astype(np.uint32, copy=False)
    n = max(len(c) - k + 1, 0)
    h = c[:n].copy()
    for i in range(1, k):
        h *= np.uint32(0x01000193)
        h ^= c[i : n + i]
        h *= np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return h


def signatures(c: np.ndarray, start: np.ndarray, end: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """One value of BAND_BITS bits for each line and band, and two words of two bits for each minimum. A product's least and
    greatest value are minima of two orders."""
    h = shingle_hash(c, k)
    n = len(start)
    out, sketch = np.zeros((n, BANDS), np.uint64), np.zeros((n, 2), np.uint64)
    size = end - start
    short = size < k
    if short.any():
        x = span_hash(c, start[short], end[short])
        for b in range(BANDS):
            out[short, b] = (x + np.uint64(b)) * np.uint64(0x9E3779B97F4A7C15)
        sketch[short, 0] = x >> np.uint64(4)
    idx = np.flatnonzero(~short)
    sig = np.zeros((BANDS * ROWS, len(idx)), np.uint32)
    begin, many = start[idx], size[idx] - k + 1
    total = np.cumsum(many)
    at = 0
    while at < len(idx):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SHINGLES, "right")))
        x = h[ragged(begin[at:to], many[at:to])]
        cuts = total[at:to] - many[at:to] - (total[at - 1] if at else 0)
        y = np.empty_like(x)
        for p, m in enumerate(_MULT):
            np.multiply(x, m, out=y)
            np.minimum.reduceat(y, cuts, out=sig[2 * p, at:to])
            np.maximum.reduceat(y, cuts, out=sig[2 * p + 1, at:to])
        at = to
    x = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], len(idx), axis=1)
    for r in range(ROWS):
        x = (x ^ sig[r::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    out[idx] = x.T
    two = ((sig * np.uint32(0x9E3779B1)) >> np.uint32(30)).astype(np.uint64)
    for p in range(BANDS * ROWS):
        two[p] <<= np.uint64(p // 2 * 2)
    for p in range(2):
        sketch[idx, p] = np.bitwise_or.reduce(two[p::2], axis=0)
    return out >> np.uint64(64 - BAND_BITS), sketch


def agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of how many minima two sketches have the same two bits."""
    t = x ^ y
    return BANDS * ROWS - np.bitwise_count((t | (t >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=-1, dtype=np.int64)


def _once(h: np.ndarray, often: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes in order, a place of each, and whether it is there twice, or repeats as `often` has it."""
    o = np.argsort(h, kind="stable")
    h = h[o]
    new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
    twice = np.diff(new, append=len(h)) > 1
    if often is not None and len(new):
        twice |= np.bitwise_or.reduceat(often[o].astype(bool), new)
    return h[new], o[new], twice


def _bands(parts: int):
    """Packed bands, with their lines, by part of the band's hash; and packed sketches of lines, and whether they repeat, by part of
    the line's hash (parts from `parts` on)."""

    def split(at, part, cols):
        o = np.lexsort((at, part))
        part, at = part[o], at[o]
        cols = [x[o] for x in cols]
        cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
        for a, z in zip(cut[:-1], cut[1:]):
            yield int(part[a]), packed(np.diff(at[a:z], prepend=np.uint64(0)), *[x[a:z] for x in cols])

    def flush(held):
        h, often, band, sketch = (np.concatenate(x) for x in zip(*held))
        h, one, often = _once(h, often)
        band, sketch = band[one], sketch[one]
        b = np.ascontiguousarray(band.T).reshape(-1)
        n = np.uint64(parts)
        out = [*split(b // n, (b % n).astype(np.int64), [np.tile(h, BANDS)]), *((k + parts, x) for k, x in split(h // n, (h % n).astype(np.int64), [sketch[:, 0], sketch[:, 1], often]))]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["part", "rows"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for part in slices(batch, 0):
                c, s, e, _, _ = lines(part.column(0))
                h, one, often = _once(span_hash(c, s, e))
                if len(one):
                    o = np.argsort(one)
                    s, e = s[one[o]], e[one[o]]
                    held.append((h[o], often[o], *signatures(c, s, e)))
                    n += len(one)
                if n * BANDS > PACKED:
                    yield flush(held)
                    held, n = [], 0
        if n:
            yield flush(held)
        del held
        trim()

    return run


def _buckets(parts: int):
    """(band, h, null, null, null) for the lines of bands with two lines or more; (null, h, s0, s1, often), the sketches of all lines
    and whether they are there more than once."""

    def run(batches):
        got: dict[int, list] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1)):
                got.setdefault(k, []).append(x.as_py())
        for k in list(got):
            read = [unpacked(x) for x in got.pop(k)]
            at = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in read])
            cols = [np.concatenate([x[i] for x in read]) for i in range(1, len(read[0]))]
            if k >= parts:
                at, one, often = _once(at, cols.pop())
                h = at * np.uint64(parts) + np.uint64(k - parts)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(h), pa.int64()), pa.array(h.view(np.int64)), *[pa.array(x[one].view(np.int64)) for x in cols], pa.array(often)], ["band", "h", "s0", "s1", "often"])
                continue
            h = cols[0].view(np.int64)
            o = np.lexsort((h, at))
            at, h = at[o], h[o]
            new = np.r_[True, (at[1:] != at[:-1]) | (h[1:] != h[:-1])]
            at, h = at[new], h[new]
            first = np.r_[True, at[1:] != at[:-1], True]
            many = ~(first[:-1] & first[1:])
            n = int(many.sum())
            yield pa.RecordBatch.from_arrays([pa.array((at[many] * np.uint64(parts) + np.uint64(k)).view(np.int64)), pa.array(h[many]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_())], ["band", "h", "s0", "s1", "often"])
        trim()

    return run


def _pairs(star: bool):
    """(a, b), a < b, of lines of a band whose sketches agree in LEAST minima: each with the band's least line, or those of
    different components that aren't such pairs. With the former also (a, a) for lines that agree with another one only: all lines
    that may be compared later are named. The input is sorted by band; a band's lines are held at once, as numbers."""

    def expanded(left, begin, count):
        """Index pairs (left[k], begin[k] .. begin[k] + count[k] - 1), STEP or so at once."""
        total = np.cumsum(count)
        at = 0
        while at < len(left):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + STEP, "right")))
            yield np.repeat(left[at:to], count[at:to]), ragged(begin[at:to], count[at:to])
            at = to

    def of(band, h, root, sketch):
        cut = np.flatnonzero(np.r_[True, band[1:] != band[:-1], True])
        low = np.repeat(cut[:-1], np.diff(cut))
        if star:
            i, j = low, np.arange(len(h))
            ok = (i != j) & (agreement(sketch[i], sketch[j]) >= LEAST)
            yield h[i[ok]], h[j[ok]]
            named = np.zeros(len(h), bool)
            named[i[ok]] = named[j[ok]] = True
            left = np.flatnonzero(~named)
            for i, j in expanded(left, low[left], np.repeat(np.diff(cut), np.diff(cut))[left]):
                ok = (i != j) & (agreement(sketch[i], sketch[j]) >= LEAST)
                x = distinct(np.concatenate([h[i[ok]], h[j[ok]]]))
                yield x, x
            return
        o = np.lexsort((h, root, band))
        least = h[low][o]
        band, h, root, sketch = band[o], h[o], root[o], sketch[o]
        cut = np.flatnonzero(np.r_[True, band[1:] != band[:-1], True])
        ends = np.repeat(cut[1:], np.diff(cut))
        cut = np.flatnonzero(np.r_[True, (band[1:] != band[:-1]) | (root[1:] != root[:-1]), True])
        runs = np.repeat(cut[1:], np.diff(cut))
        left = np.flatnonzero(ends > runs)
        for i, j in expanded(left, runs[left], (ends - runs)[left]):
            ok = (h[i] != least[i]) & (h[j] != least[i])
            i, j = i[ok], j[ok]
            ok = agreement(sketch[i], sketch[j]) >= LEAST
            i, j = i[ok], j[ok]
            yield np.minimum(h[i], h[j]), np.maximum(h[i], h[j])

    def run(batches):
        held = []

        def made(rows):
            band, h, root, s0, s1 = (np.concatenate(x) for x in zip(*rows))
            o = np.lexsort((h, band))
            found = [x for x in of(band[o], h[o], root[o], np.stack([s0, s1], 1).view(np.uint64)[o])]
            a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
            o = np.lexsort((b, a))
            a, b = a[o], b[o]
            new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
            return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            cols = [np.asarray(b.column(k)) for k in range(5)]
            whole = int(np.searchsorted(cols[0], cols[0][-1]))
            if whole or held and held[-1][0][-1] != cols[0][0]:
                yield made([*held, [x[:whole] for x in cols]])
                held = []
            held.append([x[whole:] for x in cols])
        if held:
            yield made(held)
        del held
        trim()

    return run


def parities(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, list[bytes]]:
    """Number of distinct hashes of each row, and in which of 64, 128, 256 or so buckets, no fewer than that, an odd number falls."""
    key = distinct(row.astype(np.uint64) << np.uint64(32) | h)
    row, h = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    size = np.bincount(row, minlength=rows)
    log = np.maximum(6, np.ceil(np.log2(np.maximum(size, 1)))).astype(np.int64)
    out: list[bytes] = [b""] * rows
    for k in np.unique(log):
        some = np.flatnonzero(log == k)
        at = np.full(rows, -1)
        at[some] = np.arange(len(some))
        own = at[row] >= 0
        odd = np.bincount((at[row[own]] << k) | (h[own] & ((1 << k) - 1)), minlength=len(some) << k) & 1
        packed_rows = np.packbits(odd.astype(bool).reshape(len(some), -1), axis=1)
        for i, x in zip(some, packed_rows):
            out[i] = x.tobytes()
    return size, out


def _texts(wanted, often):
    """One pass over (doc_id, doc_hash, text): (h, line, size, parity) of the lines that the bitmap `wanted` may hold, once a slice, of
    their shingles' 32-bit hashes; and (h, doc_id, doc_hash, line_no) of every line that either bitmap may hold."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 2):
                c, s, e, row, number = lines(part.column(2))
                every = span_hash(c, s, e).view(np.int64)
                ok = may_hold(wanted.value, every)
                keep = np.flatnonzero(ok | may_hold(often.value, every))
                some = np.flatnonzero(ok)
                h, one, _ = _once(every[some])
                one = some[one]
                n = np.maximum(e[one] - s[one] - K + 1, 0)
                size, bits = parities(shingle_hash(c)[ragged(s[one], n)], np.repeat(np.arange(len(one)), n), len(one))
                every, row, number = every[keep], row[keep], number[keep]
                k, m = len(one), len(every)
                line = pa.array([c[s[i] : e[i]].tobytes().decode("utf-32-le") for i in one], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(h), line, pa.array(size, pa.int32()), pa.array(bits, pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32())], _NAMES)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(every), pa.nulls(m, pa.string()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), part.column(0).take(at), part.column(1).take(at), pa.array(number, pa.int32())], _NAMES)

    return run


_NAMES = ["h", "line", "size", "parity", "doc_id", "doc_hash", "line_no"]


def odd_ones(x: pa.Array, y: pa.Array) -> np.ndarray:
    """In how many buckets the parity bitmaps x[i] and y[i] differ; the longer is folded to the shorter."""
    out = np.zeros(len(x), np.int64)
    p, q = (np.asarray(pc.binary_length(c)).astype(np.int64) for c in (x, y))
    for key in np.unique(p << 32 | q):
        some = np.flatnonzero((p << 32 | q) == key)
        at = pa.array(some)
        a, b = (np.frombuffer(b"".join(c.take(at).to_pylist()), np.uint64).reshape(len(some), -1) for c in (x, y))
        while a.shape[1] != b.shape[1]:
            if a.shape[1] < b.shape[1]:
                a, b = b, a
            half = a.shape[1] // 2
            a = a[:, :half] ^ a[:, half:]
        out[some] = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    return out


def _may_be_similar(t: float):
    """Pairs whose parity bitmaps allow the overlap; hashes of n shingles may fall together a few times, more so in long lines."""

    def run(batches):
        for b in batches:
            n, m = (np.asarray(b.column(k)).astype(np.int64) for k in (2, 3))
            need = np.ceil(t / (1 + t) * (n + m) - 1e-9) - 2 - np.maximum(n, m).astype(float) ** 2 / 2**31
            yield b.select([0, 1]).filter(pa.array((n + m - odd_ones(b.column(4), b.column(5))) // 2 >= need))

    return run


def shingles(line: str, k: int = K) -> set:
    return {line[i : i + k] for i in range(len(line) - k + 1)} or {line}


def similar(x: pa.Array, y: pa.Array, t: float) -> np.ndarray:
    """Whether the shingle sets of x[i] and y[i], different lines, have a Jaccard similarity of t. Shingles are 52-bit hashes."""

    def keys(col):
        c, off = codes(col)
        h = gram_hash(c, K) >> np.uint64(12) if len(c) >= K else np.zeros(0, np.uint64)
        n = np.maximum(np.diff(off) - K + 1, 0)
        row = np.repeat(np.arange(len(n)), n)
        key = distinct(row.astype(np.uint64) << np.uint64(52) | h[ragged(off[:-1], n)])
        return key, np.bincount((key >> np.uint64(52)).astype(np.int64), minlength=len(n))

    (p, n), (q, m) = keys(x), keys(y)
    both = np.sort(np.concatenate([p, q]), kind="stable")
    same = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(52)).astype(np.int64), minlength=len(n))
    return (same >= t * (n + m - same) - 1e-9) & (same > 0)


def _verify(t: float):
    def run(batches):
        for b in batches:
            for part in slices(b, 2):
                yield part.select([0, 1]).filter(pa.array(similar(part.column(2), part.column(3), t), pa.bool_()))

    return run


def _verified(pairs: DataFrame, texts: DataFrame, t: float) -> DataFrame:
    """The similar pairs: those that the bitmaps leave are verified on their texts."""

    def with_both(pairs, *columns):
        for k in "ba":
            pairs = pairs.join(texts.select(F.col("h").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in columns]), k)
        return pairs.select("a", "b", *[f"{c}_{k}" for c in columns for k in "ab"])

    pairs = with_both(pairs, "size", "parity").withColumn("least", F.least("size_a", "size_b")).filter(F.col("least") + 2 + F.pow("least", F.lit(2)) / 2**31 >= t * F.greatest("size_a", "size_b")).drop("least")
    pairs = pairs.mapInArrow(_may_be_similar(t), "a bigint, b bigint")
    return with_both(pairs, "line").mapInArrow(_verify(t), "a bigint, b bigint")


def similar_lines(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(id, root): the hashes of lines that are similar to others, and of their component's least; and a table with the places of all
    lines that repeat or may be similar to others, and of few more, (h, doc_id, doc_hash, line_no), where line_no isn't null."""
    spark = ready(docs.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = only(docs, "text").filter("text is not null")
    rows = text.mapInArrow(_bands(2 * parts), "part int, rows binary").repartition(parts, "part").mapInArrow(_buckets(2 * parts), "band bigint, h bigint, s0 bigint, s1 bigint, often boolean")
    rows = written(rows, "buckets")
    often = rows.filter("often").select("h")
    often = key_bitmap(often, often.count())
    at = rows.filter("band is not null").select("band", "h").join(rows.filter("band is null").select("h", "s0", "s1"), "h")
    at = written(at, "members")
    dropped(rows)

    def pairs(rows, star):
        rows = rows.select("band", "h", "root", "s0", "s1").repartition(parts, "band").sortWithinPartitions("band")
        return rows.mapInArrow(_pairs(star), "a bigint, b bigint").distinct()

    near = written(pairs(at.withColumn("root", F.col("h")), True), "near")
    nodes = written(near.select(F.explode(F.array("a", "b")).alias("h")).distinct(), "lines")
    bitmap = key_bitmap(nodes, nodes.count())
    keyed = only(docs, "doc_id", "text").filter("text is not null").select("doc_id", F.xxhash64("text").alias("doc_hash"), "text")
    found = written(keyed.mapInArrow(_texts(bitmap, often), "h bigint, line string, size int, parity binary, doc_id bigint, doc_hash bigint, line_no int"), "places")
    texts = found.filter("line is not null").select("h", "line", "size", "parity").join(nodes, "h", "left_semi")
    texts = written(texts.groupBy("h").agg(*[F.first(c).alias(c) for c in ("line", "size", "parity")]), "texts")
    dropped(nodes)
    first = written(_verified(near.filter("a <> b"), texts, threshold), "edges")
    dropped(near)
    roots = written(components(first), "roots")
    apart = at.join(roots, at["h"] == roots["id"], "left").select("band", "h", F.coalesce("root", "h").alias("root"), "s0", "s1")
    # a band whose lines are all connected has nothing left to compare
    second = written(_verified(pairs(apart, False), texts, threshold), "edges")
    dropped(at, texts, roots)
    out = written(components(first.unionByName(second)), "roots")
    dropped(first, second)
    return out, found


def _held(bitmap):
    """Whether the bitmap may hold a text's hash. Only hashes go to Python, not the texts."""

    @F.pandas_udf("boolean")
    def held(key: pd.Series) -> pd.Series:
        return pd.Series(may_hold(bitmap.value, key.to_numpy()))

    return held


def _without(batches):
    """The texts without the lines whose numbers are gone."""
    for b in batches:
        out, total, lost = [], [], []
        for text, gone in zip(b.column(1), b.column(2)):
            parts, gone = text.as_py(), set(gone.as_py() or ())
            parts = parts.split("\n") if parts is not None else None
            out.append(None if parts is None else "\n".join(x for n, x in enumerate(parts) if n not in gone))
            total.append(None if parts is None else len(parts))
            lost.append(len(gone))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array(total, pa.int32()), pa.array(lost, pa.int32())], ["doc_id", "text", "n_lines", "n_removed"])


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text, n_lines, n_removed): docs without the lines that repeat, exactly or nearly, an earlier one.

    Only documents that lose lines (a bitmap, with an exact join behind it) are shuffled."""
    roots, places = similar_lines(docs, threshold)
    keyed = only(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("doc_hash"), "text")
    place = F.struct("doc_id", "doc_hash", "line_no")
    where = places.filter("line_no is not null").select("h", "doc_id", "doc_hash", "line_no")
    where = written(where.join(roots.withColumnRenamed("id", "h"), "h", "left").select(F.coalesce("root", "h").alias("node"), "doc_id", "doc_hash", "line_no"), "places")
    dropped(places)
    first = where.groupBy("node").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    gone = where.join(first, "node").filter(~place.eqNullSafe(F.col("first"))).groupBy("doc_id", "doc_hash").agg(F.collect_set("line_no").alias("gone"))
    gone = written(gone, "gone")
    dropped(where, roots)
    lose = gone.select("doc_hash").distinct()
    bitmap = key_bitmap(lose, lose.count())
    held = _held(bitmap)
    clear = keyed.filter(~held("doc_hash")).select("doc_id", "text", (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("n_lines"), F.lit(0).alias("n_removed"))
    rest = keyed.filter(held("doc_hash")).alias("d").join(gone.alias("g"), F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.doc_hash") == F.col("g.doc_hash")), "left")
    return clear.unionByName(rest.select("d.doc_id", "d.text", "g.gone").mapInArrow(_without, "doc_id bigint, text string, n_lines int, n_removed int"))
