"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]: all pairwise interactions in time linear in
the number of features (the sum-of-squares identity). Words are hashed into BUCKETS; statistics of the text's structure and
the metadata (language, source) are one-hot features hashed into the same space.

It is fitted on the labelled documents, MAX_LABELLED at most (those with the least hash of doc_id: a documented bound, so that
fitting costs the same at every size), with a fixed seed; all documents are scored, on their whole texts.

Defined cases: a null or empty text is scored on its metadata and the statistics of an empty text; null metadata is a value
of its own; a null doc_id is scored, but never labelled; labels that contradict each other count as 0, null ones not at all;
repeated rows are scored alike; without labels of both kinds every document is kept with score 0.5; an empty table gives no
rows; other columns are ignored (scores) or carried along (accepted) whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import slices, utf8, words
from .shared import only, ready

BITS, RANK, MAX_LABELLED, EPOCHS, RATE, SEED = 16, 8, 6000, 8, 0.1, 7
KEEP = 0.5
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[*b"!#$%&*+/<=>@[\\]^_`{|}~"]] = True
_POINT = np.zeros(256, bool)
_POINT[[*b".,;:?'\"()-"]] = True


def _share(flag: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(flag)]
    return total[off[1:]] - total[off[:-1]]


def features(text: pa.Array, meta: list[pa.Array], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of all non-zero features; each row's values have length 1."""
    n = len(text)
    mask = np.uint64((1 << bits) - 1)
    start, end, row, h, _, _ = words(text)
    raw, off = utf8(text)
    size = np.maximum(np.diff(off), 1)
    count = np.bincount(row, minlength=n)
    length = np.bincount(row, weights=end - start, minlength=n)
    lines = 1 + _share(raw == 10, off)
    keys, cnt = np.unique((row.astype(np.uint64) << np.uint64(bits)) | (h & mask), return_counts=True)
    distinct = np.bincount((keys >> np.uint64(bits)).astype(np.int64), minlength=n)
    log = lambda x: np.minimum(np.log2(1 + x) * 2, 60).astype(np.int64)
    stats = [log(np.diff(off)), np.minimum(length / np.maximum(count, 1) * 2, 60).astype(np.int64), log(lines), log(np.diff(off) / lines)]
    for flag in (_UPPER, _DIGIT, _MARK, _POINT):
        stats.append(log(_share(flag[raw], off) / size * 1000))
    stats.append((distinct / np.maximum(count, 1) * 20).astype(np.int64))
    stats.append(log(count))
    extra = [np.array([zlib.crc32(b"stat %d %d" % (k, v)) for v in range(64)], np.uint64)[s] for k, s in enumerate(stats)]
    for k, m in enumerate(meta):
        d = pc.fill_null(m.cast(pa.string()), "\0").dictionary_encode()
        extra.append(np.array([zlib.crc32(f"meta {k} {v}".encode()) for v in d.dictionary.to_pylist()], np.uint64)[np.asarray(d.indices)] if n else np.zeros(0, np.uint64))
    rows = np.r_[(keys >> np.uint64(bits)).astype(np.int64), np.tile(np.arange(n), len(extra))]
    cols = np.r_[(keys & mask).astype(np.int64), *[(x & mask).astype(np.int64) for x in extra]]
    val = np.r_[1 + np.log(cnt), np.zeros(n * len(extra))]
    weight = np.sqrt(np.bincount(rows[: len(keys)], weights=val[: len(keys)] ** 2, minlength=n))
    val[: len(keys)] /= np.maximum(weight, 1e-9)[rows[: len(keys)]]
    val[len(keys) :] = 1 / np.sqrt(len(extra))
    o = np.argsort(rows, kind="stable")
    return rows[o], cols[o], (val[o] / np.sqrt(2)).astype(np.float32)


def raw_score(model, row, col, val, n):
    """The machine's value for each of n rows."""
    w0, w, v = model
    first = np.searchsorted(row, np.arange(n))
    if not n:
        return np.zeros(0)
    vx = v[col] * val[:, None]
    s = np.add.reduceat(vx, first, axis=0)
    q = np.add.reduceat(vx * vx, first, axis=0)
    return w0 + np.add.reduceat(w[col] * val, first) + 0.5 * (s * s - q).sum(1)


def fit(row, col, val, y, bits=BITS, rank=RANK, epochs=EPOCHS, rate=RATE, seed=SEED):
    """(w0, w, v) by Adagrad on the logistic loss; rows are sorted and 0 .. len(y) - 1."""
    rng = np.random.default_rng(seed)
    w0, w, v = 0.0, np.zeros(1 << bits, np.float32), rng.normal(0, 0.05, (1 << bits, rank)).astype(np.float32)
    g0, gw, gv = 1e-6, np.full_like(w, 1e-6), np.full_like(v, 1e-6)
    first = np.r_[np.searchsorted(row, np.arange(len(y))), len(row)]
    for _ in range(epochs):
        for b in np.array_split(rng.permutation(len(y)), max(1, len(y) // 32)):
            at = np.concatenate([np.arange(first[i], first[i + 1]) for i in b])
            r = np.repeat(np.arange(len(b)), first[b + 1] - first[b])
            c, x = col[at], val[at]
            cut = np.searchsorted(r, np.arange(len(b)))
            vx = v[c] * x[:, None]
            s = np.add.reduceat(vx, cut, axis=0)
            z = w0 + np.add.reduceat(w[c] * x, cut) + 0.5 * (s * s - np.add.reduceat(vx * vx, cut, axis=0)).sum(1)
            e = (1 / (1 + np.exp(-z)) - y[b]).astype(np.float32) / len(b)
            g0 += e.sum() ** 2
            w0 -= rate * e.sum() / np.sqrt(g0)
            u, inv = np.unique(c, return_inverse=True)
            dw = np.bincount(inv, weights=e[r] * x, minlength=len(u)) + 1e-6 * w[u]
            dv = np.zeros((len(u), v.shape[1]), np.float32)
            np.add.at(dv, inv, e[r, None] * x[:, None] * (s[r] - vx))
            dv += 1e-6 * v[u]
            gw[u] += dw**2
            gv[u] += dv**2
            w[u] -= rate * dw / np.sqrt(gw[u])
            v[u] -= rate * dv / np.sqrt(gv[u])
    return float(w0), w, v


def _columns(docs: DataFrame) -> DataFrame:
    return only(docs, "doc_id", "text", "lang", "source")


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED):
    """The model, or None without labels of both kinds."""
    ready(docs.sparkSession)
    some = only(labels, "doc_id", "quality").filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("y"))
    some = some.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def extract(batches):
        for b in batches:
            for part in slices(b, 1):
                row, col, val = features(part.column(1), [part.column(2), part.column(3)])
                cut = np.r_[np.searchsorted(row, np.arange(part.num_rows)), len(row)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(4), pa.array([col[a:z].astype("<i4").tobytes() for a, z in zip(cut, cut[1:])], pa.binary()), pa.array([val[a:z].tobytes() for a, z in zip(cut, cut[1:])], pa.binary())], ["doc_id", "y", "col", "val"])

    # one text for each doc_id, however often it stands in the table: bounded by most
    got = _columns(docs).join(F.broadcast(some), "doc_id").select("doc_id", "text", "lang", "source", F.col("y").cast("int")).mapInArrow(extract, "doc_id bigint, y int, col binary, val binary")
    got = got.groupBy("doc_id").agg(F.min(F.struct("col", "val", "y")).alias("r")).select("doc_id", "r.*")
    rows = sorted(got.collect(), key=lambda r: r["doc_id"])
    y = np.array([r["y"] for r in rows], np.float32)
    if not len(y) or y.min() == y.max():
        return None
    cols = [np.frombuffer(r["col"], "<i4") for r in rows]
    return fit(np.repeat(np.arange(len(rows)), [len(c) for c in cols]), np.concatenate(cols).astype(np.int64), np.concatenate([np.frombuffer(r["val"], np.float32) for r in rows]), y)


def _score(text, lang, source, model) -> np.ndarray:
    if model is None:
        return np.full(len(text), 0.5)
    z = raw_score(model, *features(text, [lang, source]), len(text))
    return np.round(1 / (1 + np.exp(-np.clip(z.astype(np.float64), -50, 50))), 4)


def scores(docs: DataFrame, labels: DataFrame, keep: float = KEEP, most: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, score, keep) for each row of docs; score: probability of good quality."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most))

    def run(batches):
        for b in batches:
            for part in slices(b, 1):
                p = _score(part.column(1), part.column(2), part.column(3), model.value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array(p >= keep)], ["doc_id", "score", "keep"])

    return _columns(docs).mapInArrow(run, "doc_id bigint, score double, keep boolean")


def accepted(docs: DataFrame, labels: DataFrame, keep: float = KEEP, most: int = MAX_LABELLED) -> DataFrame:
    """The rows of docs whose score is at least keep."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most))
    at = {c: docs.columns.index(c) for c in ("text", "lang", "source")}

    def run(batches):
        for b in batches:
            for part in slices(b, at["text"]):
                p = _score(part.column(at["text"]), part.column(at["lang"]), part.column(at["source"]), model.value)
                yield part.filter(pa.array(p >= keep))

    return docs.mapInArrow(run, docs.schema)
