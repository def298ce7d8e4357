"""N-gram Jaccard join: prefix filtering in rare-first order with length, positional and suffix filters.

Texts are lower-cased and cut into words (runs of ASCII letters, digits, _ and all non-ASCII characters); a document is the
set of its word n-grams (a text of 1 to n-1 words: the one gram of all its words). Grams are ordered by corpus count, rare
ones first, then by hash. The counts come from a sketch of fixed size over *all* documents: a collision only changes the
order, which is the same for all documents, so no pair is lost. Grams are 46-bit hashes.

Documents with equal sets form a class and are joined as one. Classes that agree in half of their min-wise grams (of the
middle of the order, where neither a copy's own grams nor common ones stand) with the bucket's least row form a group; this is
a guess that only saves work. The join is on the prefix grams, packed and sorted, and makes pairs of classes of different
groups only: so a group of thousands of near copies makes no pair for each of its grams. Pairs pass the length and positional
filters, the sum of their shared prefix grams has to reach the overlap together with what may lie behind the prefixes, and the
suffix filter bounds that before any whole set is moved: sets whose parity bitmaps (one to two bits a gram) differ in d bits
differ in d grams at least. Groups and the pairs left are united; each united set of classes is verified on whole sets, each
pair once, in blocks of bounded size (BLOCK_DOCS, BLOCK_GRAMS; each class's set travels once for each block it meets). Two
classes alone are bounded by splitting their sets first. The number of links within a group of near copies is quadratic in it,
and so is this last step, as products of bit matrices; nothing is emitted for a pair.

Defined cases: null or wordless texts are in no pair; a null doc_id is in no pair; rows that repeat a doc_id with the same
grams count once; rows that repeat a doc_id with other grams are other texts of that document; an empty table gives no
rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import distinct, most_common, ngram_hash, packed, ragged, slices, trim, unpacked, words
from .components import components
from .shared import dropped, key_bitmap, may_hold, only, ready, written

N, THRESHOLD = 2, 0.65
SKETCH = 1 << 24
CHUNK = 1 << 16
HASH_BITS = 46
_MASK = np.uint64((1 << HASH_BITS) - 1)
#: Min-wise grams of a class.
KEYS = 16
#: Prefix rows that a task packs at once, candidate rows that it holds before it sums them, pairs that it makes at once.
PACKED, HELD, STEP = 1_000_000, 500_000, 1 << 18
#: Classes and grams of a block, about.
BLOCK_DOCS, BLOCK_GRAMS = 1024, 2_000_000


def _overlap(t: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least overlap of sets of a and b members with Jaccard of at least t."""
    return np.ceil(t / (1 + t) * (a + b) - 1e-9).astype(np.int64)


def _grams(col: pa.Array, n: int, order: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams by row, in join order: row, (class of the count << 46 | hash)."""
    _, _, row, h, _, _ = words(col)
    g, row = ngram_hash(h, row, n)
    g &= _MASK
    key = g if order is None else g | (order[(g & np.uint64(SKETCH - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(HASH_BITS))
    key = distinct(key | (row.astype(np.uint64) << np.uint64(HASH_BITS + 6)))
    return (key >> np.uint64(HASH_BITS + 6)).astype(np.int64), key & (_MASK if order is None else np.uint64((1 << (HASH_BITS + 6)) - 1))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _set_hash(row: np.ndarray, g: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and order-free hash of each row's set of grams."""
    size = np.bincount(row, minlength=rows)
    total = np.r_[np.uint64(0), np.cumsum(_mixed(g & _MASK), dtype=np.uint64)]
    ends = np.cumsum(size)
    s = total[ends] - total[ends - size]
    s = (s ^ (s >> np.uint64(30))) * np.uint64(0x94D049BB133111EB) + size.astype(np.uint64)
    return size, s.view(np.int64)


def _profile(n: int):
    """doc_id, class, rows by document; and the task's share of the gram counts."""

    def run(batches):
        counts = np.zeros(SKETCH, np.uint32)
        for batch in batches:
            for part in slices(batch, 1):
                row, g = _grams(part.column(1), n, None)
                np.add.at(counts, (g & np.uint64(SKETCH - 1)).astype(np.int64), np.uint32(1))
                size, sh = _set_hash(row, g, part.num_rows)
                has = (size > 0) & ~np.asarray(part.column(0).is_null())
                m = int(has.sum())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(has)), pa.array(sh[has]), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], ["doc_id", "cls", "block", "counts"])
        if counts.any():
            c = counts.reshape(-1, CHUNK)
            k = len(c)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(np.arange(k), pa.int32()), pa.array([_halves(x) for x in c], pa.binary())], ["doc_id", "cls", "block", "counts"])
        del counts
        trim()

    return run


def _halves(counts: np.ndarray) -> bytes:
    """Counts, 65535 at most (they only order grams), as two planes of bytes."""
    c = np.minimum(counts, 65535).astype("<u2").view(np.uint8).reshape(-1, 2)
    return pa.compress(np.ascontiguousarray(c.T), codec="zstd", asbytes=True)


def _whole(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(pa.decompress(data, decompressed_size=2 * CHUNK, codec="zstd"), np.uint8).reshape(2, -1).T).view("<u2").ravel()


def _order(profile: DataFrame) -> np.ndarray:
    """The sketch's counts by class (log2): SKETCH bytes, whatever the input's size."""

    def add(pdf):
        import pandas as pd

        total = sum(_whole(x).astype(np.int64) for x in pdf["counts"])
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "cls": [np.floor(2 * np.log2(total.astype(float) + 1)).clip(0, 63).astype(np.uint8).tobytes()]})

    out = np.zeros(SKETCH, np.uint8)
    for r in profile.filter("block is not null").select("block", "counts").groupBy("block").applyInPandas(add, "block int, cls binary").collect():
        out[r["block"] * CHUNK : (r["block"] + 1) * CHUNK] = np.frombuffer(r["cls"], np.uint8)
    return out


def _prefixes(n: int, t: float, order):
    """(class, size, prefix, keys, parity): the first size - ceil(t * size) + 1 grams of each set in order, six bytes each; the least
    mixed hashes of its grams from a fifth to three fifths of the order; its parity bitmap."""

    def run(batches):
        rank = order.value
        for batch in batches:
            for part in slices(batch, 0):
                row, g = _grams(part.column(0), n, rank)
                size, sh = _set_hash(row, g, part.num_rows)
                first = np.cumsum(size) - size
                g &= _MASK
                six = g.view(np.uint8).reshape(-1, 8)[:, :6]
                mixed = _mixed(g)
                _, one = np.unique(sh, return_index=True)
                one = one[size[one] > 0]
                take = size[one] - np.ceil(t * size[one] - 1e-9).astype(np.int64) + 1
                keys, bits = [], []
                for k in one:
                    m = mixed[first[k] + size[k] // 5 : first[k] + max(3 * size[k] // 5, 1)]
                    keys.append(np.sort(np.partition(m, KEYS)[:KEYS] if len(m) > KEYS else m).view(np.int64))
                    bits.append(parity(mixed[first[k] : first[k] + size[k]]))
                yield pa.RecordBatch.from_arrays([pa.array(sh[one]), pa.array(size[one], pa.int32()), pa.array([six[first[k] : first[k] + m].tobytes() for k, m in zip(one, take)], pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary())], ["cls", "size", "prefix", "keys", "parity"])

    return run


def parity(mixed: np.ndarray) -> bytes:
    """Which of 64, 128, 256 or so buckets, no fewer than there are grams, hold an odd number of them."""
    n = max(64, 1 << (len(mixed) - 1).bit_length())
    return np.packbits((np.bincount((mixed & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1).astype(bool)).tobytes()


def _may_reach(t: float):
    def run(batches):
        for b in batches:
            size = [np.asarray(b.column(k)).astype(np.int64) for k in (2, 3)]
            need = _overlap(t, *size)
            ok = [min(n, m) >= k and most_common(n, m, x, y) >= k for n, m, k, x, y in zip(size[0].tolist(), size[1].tolist(), need.tolist(), b.column(4).to_pylist(), b.column(5).to_pylist())]
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return run


def _bounded(pairs: DataFrame, rows: DataFrame, t: float) -> DataFrame:
    """Pairs of rows (a, b) as pairs of classes, without those whose sets can't reach the overlap."""
    x, y = (rows.select(F.col("row").alias(k), F.col("cls").alias(f"cls_{k}"), F.col("size").alias(f"size_{k}"), F.col("parity").alias(f"parity_{k}")) for k in "ab")
    both = pairs.join(x, "a").join(y, "b").select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b"), "size_a", "size_b", "parity_a", "parity_b")
    return both.mapInArrow(_may_reach(t), "a bigint, b bigint")


def _keyed(batches):
    """(row, low): each row of a key with the key's least row; the input is partitioned by key."""
    read = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches]
    if read:
        key, row = (np.concatenate(x) for x in zip(*read))
        del read
        o = np.lexsort((row, key))
        key, row = key[o], row[o]
        cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True][: len(key) + 1])
        low = np.repeat(row[cut[:-1]], np.diff(cut))
        more = row != low
        yield pa.RecordBatch.from_arrays([pa.array(row[more]), pa.array(low[more])], ["row", "low"])
    trim()


def _groups(rows: DataFrame, parts: int, t: float) -> DataFrame:
    """(id, root): classes that share at least half of their keys with the least rows of those keys, and may be similar to them."""
    at = rows.select(F.explode("keys").alias("key"), "row").repartition(parts, "key").mapInArrow(_keyed, "row bigint, low bigint")
    near = at.groupBy("row", "low").agg(F.count("*").alias("k")).filter("k > 3").join(rows.select("row", F.size("keys").alias("n")), "row").filter("2 * k >= n")
    return components(_bounded(near.select(F.col("row").alias("a"), F.col("low").alias("b")), rows, t))


def _spread(parts: int):
    """Packs prefix grams by part (the gram modulo parts): grams in order, with their set and position; and the sets, as row, size
    and root (0: none)."""

    def flush(held):
        held.sort(key=lambda x: x[0])
        row, sizes, root = (np.array([x[k] for x in held], np.int64) for k in range(3))
        count = np.array([len(p) // 6 for *_, p in held], np.int64)
        raw = np.zeros((int(count.sum()), 8), np.uint8)
        raw[:, :6] = np.frombuffer(b"".join(p for *_, p in held), np.uint8).reshape(-1, 6)
        g = raw.view(np.uint64).ravel()
        doc = np.repeat(np.arange(len(held)), count)
        pos = np.arange(len(g)) - np.repeat(np.cumsum(count) - count, count)
        part, rest = (g % np.uint64(parts)).astype(np.int64), g // np.uint64(parts)
        o = np.lexsort((rest, part))
        part, rest, doc, pos = part[o], rest[o], doc[o], pos[o]
        cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else [0]
        blobs = []
        for a, z in zip(cut[:-1], cut[1:]):
            docs, at = np.unique(doc[a:z], return_inverse=True)
            blobs.append(packed(np.diff(rest[a:z], prepend=np.uint64(0)), at, pos[a:z], np.diff(row[docs], prepend=0), sizes[docs], root[docs]))
        return pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]], pa.int32()), pa.array(blobs, pa.binary())], ["part", "rows"])

    def run(batches):
        held, n = [], 0
        for b in batches:
            for row, size, root, p in zip(*[b.column(k).to_pylist() for k in range(4)]):
                held.append((row, size, root, p))
                n += len(p) // 6
                if n >= PACKED:
                    yield flush(held)
                    held, n = [], 0
        if held:
            yield flush(held)
        del held
        trim()

    return run


def _counted(a, b, s, n):
    """Sums n by (a, b)."""
    o = np.lexsort((b, a))
    a, b, s, n = a[o], b[o], s[o], n[o]
    cut = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, int)
    return a[cut], b[cut], s[cut], np.add.reduceat(n, cut) if len(a) else n


def _pairs(t: float, blobs):
    """(a, b, sizes, shared prefix grams) of rows of different groups that pass the length filter and the positional filter."""
    read = [unpacked(x) for x in blobs]
    g = np.concatenate([np.cumsum(x[0]) for x in read])
    c, size, root = (np.concatenate([(np.cumsum(x[k]) if k == 3 else x[k])[x[1].astype(np.int64)] for x in read]).view(np.int64) for k in (3, 4, 5))
    # a row without a group is one of its own: rows are numbered from 0
    root = np.where(root == 0, ~c, root)
    pos = np.concatenate([x[2] for x in read]).view(np.int64)
    del read
    o = np.lexsort((c, root, g))
    g, c, size, root, pos = g[o], c[o], size[o], root[o], pos[o]
    keep = np.r_[True, (g[1:] != g[:-1]) | (c[1:] != c[:-1])][: len(g)]
    g, c, size, root, pos = g[keep], c[keep], size[keep], root[keep], pos[keep]
    cut = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True])
    ends = np.repeat(cut[1:], np.diff(cut))
    cut = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (root[1:] != root[:-1]), True])
    runs = np.repeat(cut[1:], np.diff(cut))
    left = np.flatnonzero(ends > runs)
    total = np.cumsum((ends - runs)[left])
    found, held, at = [], 0, 0
    while at < len(left):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + STEP, "right")))
        few = left[at:to]
        i, j = np.repeat(few, (ends - runs)[few]), ragged(runs[few], (ends - runs)[few])
        at = to
        fits = np.minimum(size[i], size[j]) >= t * np.maximum(size[i], size[j]) - 1e-9
        i, j = i[fits], j[fits]
        fits = np.minimum(pos[i], pos[j]) + np.minimum(size[i] - pos[i], size[j] - pos[j]) >= _overlap(t, size[i], size[j])
        i, j = i[fits], j[fits]
        i, j = np.where(c[i] < c[j], i, j), np.where(c[i] < c[j], j, i)
        found.append((c[i], c[j], size[i] << 32 | size[j], np.ones(len(i), np.int64)))
        held += len(i)
        if held > HELD:
            found = [_counted(*[np.concatenate(x) for x in zip(*found)])]
            held = len(found[0][0])
            if held > HELD // 2:
                yield found.pop()
                held = 0
    if found:
        yield _counted(*[np.concatenate(x) for x in zip(*found)])


def _candidates(t: float):
    def run(batches):
        parts: dict[int, list] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1)):
                parts.setdefault(k, []).append(x.as_py())
        for k in list(parts):
            for p in _pairs(t, parts.pop(k)):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in p], ["a", "b", "sizes", "n"])
        trim()

    return run


def _prefix_sums(found: DataFrame, t: float) -> DataFrame:
    """Pairs whose shared prefix grams, with all grams behind the prefix whose last gram comes first, reach the overlap."""
    x = found.groupBy("a", "b").agg(F.first("sizes").alias("s"), F.sum("n").alias("n"))
    x = x.select("a", "b", "n", F.shiftright("s", 32).alias("p"), F.col("s").bitwiseAND(F.lit((1 << 32) - 1)).alias("q"))
    need = F.ceil(t / (1 + t) * (F.col("p") + F.col("q")) - 1e-9)
    rest = F.ceil(t * F.greatest("p", "q") - 1e-9) - 1
    return x.filter(F.col("n") + rest >= need).select("a", "b")


def _sets(n: int, wanted):
    """(doc_id, class, size, grams) of the documents that may stand for a class with candidates: each (doc_id, class) of a slice
    once, as the bitmap also lets documents through that don't."""

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(may_hold(wanted.value, np.asarray(batch.column(0).fill_null(0)))))
            for part in slices(batch, 1):
                row, g = _grams(part.column(1), n, None)
                size, sh = _set_hash(row, g, part.num_rows)
                ends = np.cumsum(size)
                _, one = np.unique(np.stack([sh, np.asarray(part.column(0))]), axis=1, return_index=True)
                one = one[size[one] > 0]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(one)), pa.array(sh[one]), pa.array([packed(np.diff(g[ends[k] - size[k] : ends[k]], prepend=np.uint64(0))) for k in one], pa.binary())], ["doc_id", "cls", "grams"])

    return run


def suffix_bound(x: np.ndarray, y: np.ndarray, depth: int = 3) -> int:
    """An upper bound of the overlap of two ordered sets: split both at the middle gram of one, again and again."""
    if depth == 0 or not len(x) or not len(y):
        return min(len(x), len(y))
    mid = len(x) // 2
    at = int(np.searchsorted(y, x[mid]))
    hit = int(at < len(y) and y[at] == x[mid])
    return suffix_bound(x[:mid], y[:at], depth - 1) + hit + suffix_bound(x[mid + 1 :], y[at + hit :], depth - 1)


def _linked(t: float, sets: list[np.ndarray], side: np.ndarray) -> np.ndarray:
    """Which pairs have a Jaccard similarity of t: of all sets, or of those of side 0 with those of side 1."""
    m = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    need = _overlap(t, size[:, None], size[None, :])
    if m == 2 and suffix_bound(*sets) < need[0, 1]:
        return np.zeros((2, 2), bool)
    _, at, cnt = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), size)
    many = cnt > 1
    name = np.cumsum(many) - 1
    row, at = row[many[at]], name[at[many[at]]]
    o = np.argsort(at, kind="stable")
    row, at = row[o], at[o]
    common = np.zeros((m, m), np.float32)
    width = max(256, (1 << 23) // m)
    for a in range(0, int(many.sum()), width):
        lo, hi = np.searchsorted(at, (a, a + width))
        x = np.zeros((m, min(width, int(many.sum()) - a)), np.float32)
        x[row[lo:hi], at[lo:hi] - a] = 1
        common += x @ x.T
    both = common >= need
    if side.any():
        both &= side[:, None] != side[None, :]
    np.fill_diagonal(both, False)
    return both


def _verify(t: float):
    """(class, root, links): each class of a block, the least class that it is connected with in it, the number of classes that it
    is similar to. The input is sorted by block."""

    def block(rows):
        cls = np.array([r[0] for r in rows], np.int64)
        both = _linked(t, [np.cumsum(unpacked(r[2])[0], dtype=np.uint64) for r in rows], np.array([r[1] for r in rows]))
        root = cls
        while True:
            low = np.minimum(root, np.where(both, root[None, :], np.iinfo(np.int64).max).min(1))
            if (low == root).all():
                break
            root = low
        n = both.sum(1)
        return cls, root, n

    def run(batches):
        key, rows, out = None, [], []

        def made():
            b = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["cls", "root", "links"])
            out.clear()
            return b

        for b in batches:
            for k, i, j, side, cls, grams in zip(*[c.to_pylist() for c in b.columns]):
                if (k, i, j) != key:
                    if len(rows) > 1:
                        out.append(block(rows))
                    key, rows = (k, i, j), []
                rows.append((cls, side, grams))
            if out:
                yield made()
        if len(rows) > 1:
            out.append(block(rows))
            yield made()
        trim()

    return run


def similar_classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(members, linked): (doc_id, cls, rows) for each document with words; (cls, root, links) for classes that are similar to
    others: the least class that each is connected with, and the number of classes that it is similar to."""
    spark = ready(docs.sparkSession)
    docs = only(docs, "doc_id", "text").filter("doc_id is not null and text is not null")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    profile = written(docs.mapInArrow(_profile(n), "doc_id bigint, cls bigint, block int, counts binary"), "profile")
    order = spark.sparkContext.broadcast(_order(profile))
    members = written(profile.filter("block is null").groupBy("doc_id", "cls").agg(F.count("*").alias("rows")), "members")
    dropped(profile)
    rows = docs.select("text").mapInArrow(_prefixes(n, threshold, order), "cls bigint, size int, prefix binary, keys array<bigint>, parity binary")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "prefixes")
    order.unpersist()
    groups = written(_groups(rows, parts, threshold), "groups")
    once = rows.groupBy("cls").agg(*[F.first(c).alias(c) for c in ("row", "size", "prefix")])
    found = once.join(groups, once["cls"] == groups["id"], "left").select("row", "size", F.coalesce("root", F.lit(0)).alias("root"), "prefix")
    found = found.mapInArrow(_spread(2 * parts), "part int, rows binary").repartition(parts, "part").mapInArrow(_candidates(threshold), "a bigint, b bigint, sizes bigint, n bigint")
    found = written(_bounded(_prefix_sums(found, threshold), rows, threshold), "candidates")
    united = written(components(found.unionByName(groups.select(F.col("id").alias("a"), F.col("root").alias("b")))), "united")
    sizes = rows.select("cls", "size").distinct()
    # blocks of the united classes, by the classes' hashes
    whole = F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("size") / BLOCK_GRAMS)).cast("int")
    at = united.join(sizes, united["id"] == sizes["cls"])
    blocks = at.groupBy("root").agg(whole.alias("blocks"))
    at = at.join(blocks, "root").select("cls", "root", "blocks", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int").alias("mine"))
    heads = members.groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    wanted = written(at.join(heads, "cls"), "wanted")
    dropped(rows, groups, found, united)
    bitmap = key_bitmap(wanted.select("doc_id"), wanted.count())
    sets = docs.mapInArrow(_sets(n, bitmap), "doc_id bigint, cls bigint, grams binary").join(wanted, ["doc_id", "cls"])
    # a class occurs once for each slice that holds its document
    sets = sets.groupBy("doc_id", "cls").agg(F.first("root").alias("root"), F.first("blocks").alias("blocks"), F.first("mine").alias("mine"), F.first("grams").alias("grams"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, "mine").alias("i"), F.greatest(o, "mine").alias("j"), (o < F.col("mine")).cast("int").alias("side")))
    sets = sets.select("root", "cls", "grams", F.explode(pairs).alias("p")).select("root", "p.i", "p.j", "p.side", "cls", "grams")
    sets = sets.repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j")
    checked = written(sets.mapInArrow(_verify(threshold), "cls bigint, root bigint, links bigint"), "checked")
    bitmap.unpersist()
    dropped(wanted)
    roots = components(checked.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    links = checked.groupBy("cls").agg(F.sum("links").alias("links")).filter("links > 0")
    linked = written(links.join(roots, links["cls"] == roots["id"]).select("cls", "root", "links"), "linked")
    dropped(checked)
    return members, linked


def jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class, copies, links) for each document that is similar to another: the n-gram sets' Jaccard similarity is at
    least threshold.

    class: the least doc_id of the documents that it is connected with, directly or through others; copies: the number of other
    documents with an equal set; links: the number of other sets that its own is similar to. A doc_id that stands on unlike texts
    has a row for each of their sets that has copies or links.
    """
    members, linked = similar_classes(docs, n, threshold)
    each = members.groupBy("cls").agg(F.min("doc_id").alias("least"), (F.count("*") - 1).alias("copies"))
    each = each.join(linked, "cls", "left").select("cls", "least", "copies", F.coalesce("root", "cls").alias("root"), F.coalesce("links", F.lit(0)).alias("links")).filter("copies > 0 or links > 0")
    least = each.groupBy("root").agg(F.min("least").alias("class"))
    each = each.join(least, "root").select("cls", "class", "copies", "links")
    return members.join(each, "cls").select("doc_id", "class", "copies", "links")


def _with_class(n: int, at: int, text: int, bitmap):
    """The rows whose doc_id the bitmap may hold with _cls, their class, and _stay: whether they have no words (_cls then only spreads
    them)."""

    def run(batches):
        for batch in batches:
            batch = batch.filter(_held(batch.column(at), bitmap))
            for part in slices(batch, text):
                row, g = _grams(part.column(text), n, None)
                size, sh = _set_hash(row, g, part.num_rows)
                stay = (size == 0) | np.asarray(part.column(at).is_null())
                cls = np.where(stay, np.arange(part.num_rows), sh)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cls, pa.int64()), pa.array(stay, pa.bool_())], [*part.schema.names, "_cls", "_stay"])

    return run


def _held(ids: pa.Array, bitmap) -> pa.Array:
    return pa.array(may_hold(bitmap.value, np.asarray(ids.fill_null(0))) & ~np.asarray(ids.is_null()))


def _clear(at: int, bitmap):
    """The rows whose doc_id the bitmap doesn't hold."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pc.invert(_held(batch.column(at), bitmap)))

    return run


def one_of_each(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each group of documents that are similar, directly or through others: of the least doc_id, and of rows that
    repeat it the first by the columns. A doc_id on unlike texts is in the group of each text. Rows with a null doc_id or
    without words stay.

    Only rows whose doc_id has something to lose (a bitmap, with an exact join behind it) are shuffled."""
    members, linked = similar_classes(docs, n, threshold)
    roots = linked.select("cls", "root")
    at = members.join(roots, "cls", "left").select("doc_id", "cls", "rows", F.coalesce("root", "cls").alias("root"))
    groups = at.groupBy("root").agg(F.min(F.struct("doc_id", "cls")).alias("k"))
    at = at.join(groups, "root").select(F.col("doc_id").alias("_id"), F.col("cls").alias("_of"), "rows", (F.struct("doc_id", "cls") == F.col("k")).alias("_kept"))
    fate = written(at, "fate")
    lose = fate.filter("not _kept or rows > 1").select("_id").distinct()
    bitmap = key_bitmap(lose, lose.count())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    where = docs.columns.index("doc_id")
    clear = docs.mapInArrow(_clear(where, bitmap), schema)
    rows = docs.mapInArrow(_with_class(n, where, docs.columns.index("text"), bitmap), schema + ", _cls bigint, _stay boolean")
    rows = rows.join(fate.filter("_kept"), (F.col("doc_id") == F.col("_id")) & (F.col("_cls") == F.col("_of")), "left").filter("_stay or _kept")
    order = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("doc_id", "_cls").orderBy(*order)))
    return clear.unionByName(rows.filter("_stay or _nth = 1").select(*[F.col(f"`{c}`") for c in docs.columns]))
