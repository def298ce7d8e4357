"""Token ids in binary: frequency-ranked ids, byte-aligned variable-length coding with separate control bytes.

A public tokenizer's vocabulary (a parameter) gives the tokens; its ids are counted over all documents and replaced by their
rank, so that frequent tokens take one byte. Each id takes 1 to 4 data bytes; four 2-bit lengths go into one control byte,
and control and data bytes are kept apart. Decoding looks up the four lengths of each control byte in a table (numpy).

The result can be decoded from its rows alone: one of them also carries the tokens by rank (token_by_rank, null elsewhere).

Words are found in the code points of many texts at once, each distinct word of a slice is encoded by the tokenizer once.

Defined cases: a null text has null n_tokens, control and data; an empty one has 0 and no bytes; null doc_ids, ties and
repeated rows are encoded like any other row; ranks of equal counts go by token id; an empty table gives no rows; other
columns are ignored whatever their names.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import R, classes, codes, ragged, slices, span_hash
from .shared import only, ready, written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose tokens a worker keeps; others are encoded each time that a slice holds them.
KNOWN = 1 << 18
_R2 = 0xC2B2AE3D27D4EB4F | 1
_state: dict = {}


def tokenizer(path: str):
    """(tiktoken encoding, words known so far) of a worker."""
    if path not in _state:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        _state[path] = (tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), {})
    return _state[path]


def pieces(c: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where the tokenizer's pattern begins a piece. An apostrophe that is alone, not behind a space and before s, t, m, d, re, ve or
    ll takes these letters with it; what letters follow are a piece of their own."""
    n = len(c)
    k = classes()[c]
    cut = np.ones(n, bool)
    cut[1:] = k[1:] != k[:-1]
    first = off[:-1][np.diff(off) > 0]
    cut[first] = True
    inner = np.ones(n, bool)
    inner[first] = False
    after = np.flatnonzero((k[1:] != 0) & (k[:-1] == 0) & inner[1:]) + 1
    cut[after - 1] = True
    cut[after[c[after - 1] == 32]] = False
    mark = np.flatnonzero(c[:-1] == 39)
    mark = mark[cut[mark] & inner[mark + 1]]
    if len(mark):
        a, b = c[mark + 1], c[np.minimum(mark + 2, n - 1)]
        pair = (mark + 2 < n) & inner[np.minimum(mark + 2, n - 1)] & (((b == 101) & ((a == 114) | (a == 118))) | ((a == 108) & (b == 108)))
        size = np.where(np.isin(a, (115, 116, 109, 100)), 1, np.where(pair, 2, 0))
        mark, size = mark[size > 0], size[size > 0]
        cut[mark + 1] = False
        to = mark + 1 + size
        cut[to[to < n]] = True
    return np.flatnonzero(cut)


def encode_all(col: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts, and how many each has."""
    enc, known = tokenizer(path)
    c, off = codes(col)
    rows = len(off) - 1
    if not len(c):
        return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
    start = pieces(c, off)
    end = np.r_[start[1:], len(c)]
    key = span_hash(c, start, end)
    code, uniq = pd.factorize(key)
    first = np.full(len(uniq), -1, np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    length = end - start
    other = span_hash(c, start, end, _R2)
    if not ((other == other[first[code]]) & (length == length[first[code]])).all():
        code, first = np.arange(len(start)), np.arange(len(start))
    s, e = start[first], end[first]
    text = c[ragged(s, e - s)].tobytes().decode("utf-32-le")
    at, ids = 0, []
    for m in (e - s).tolist():
        w = text[at : at + m]
        at += m
        x = known.get(w)
        if x is None:
            x = np.array(enc._core_bpe.encode_ordinary(w), "<u4").tobytes()  # a quarter of a list's memory
            if len(known) < KNOWN:
                known[w] = x
        ids.append(x)
    size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    flat = np.frombuffer(b"".join(ids), "<u4")
    begin = np.cumsum(size) - size
    out = flat[ragged(begin[code], size[code])]
    row = np.searchsorted(off, start, "right") - 1
    count = np.bincount(row, weights=size[code], minlength=rows).astype(np.int64)
    return out, count


def pack(ids: np.ndarray, count: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Control and data bytes of each of several lists of ids below 2**32."""
    length = 1 + (ids >= 1 << 8).astype(np.int64) + (ids >= 1 << 16) + (ids >= 1 << 24)
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    data = raw[np.arange(4) < length[:, None]]
    groups = -(-count // 4)
    slot = ragged((np.cumsum(groups) - groups) * 4, count)
    two = np.zeros(int(groups.sum()) * 4, np.uint8)
    two[slot] = length - 1
    two = two.reshape(-1, 4)
    control = two[:, 0] | two[:, 1] << 2 | two[:, 2] << 4 | two[:, 3] << 6
    ends = np.r_[0, np.cumsum(length)][np.cumsum(count)] if len(count) else np.zeros(0, int)
    cb, db, a, b = control.tobytes(), data.tobytes(), 0, 0
    controls, datas = [], []
    for g, z in zip(np.cumsum(groups).tolist(), ends.tolist()):
        controls.append(cb[a:g])
        datas.append(db[b:z])
        a, b = g, z
    return controls, datas


#: The four lengths that each control byte stands for.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ids of pack()."""
    length = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    d = np.r_[np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)].astype(np.uint32)
    at = np.cumsum(length) - length
    out = d[at]
    for k in range(1, 4):
        out |= np.where(length > k, d[at + k], np.uint32(0)) << np.uint32(8 * k)
    return out


def _tokens(path: str):
    """doc_id, n_tokens, ids; columns behind the text are carried along."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                ids, count = encode_all(part.column(1), path)
                raw, z = ids.astype("<u4").astype("<u2" if _narrow(path) else "<u4").tobytes(), 2 if _narrow(path) else 4
                ends = (np.cumsum(count) * z).tolist()
                null = np.asarray(part.column(1).is_null())
                blobs = [None if o else raw[a:b] for a, b, o in zip([0, *ends[:-1]], ends, null.tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.where(null, 0, count), pa.int64(), mask=null), pa.array(blobs, pa.binary()), *part.columns[2:]], ["doc_id", "n_tokens", "ids", *part.schema.names[2:]])

    return run


def _narrow(path: str) -> bool:
    return tokenizer(path)[0].max_token_value < 1 << 16


def _counts(path: str):
    def run(batches):
        total = np.zeros(tokenizer(path)[0].max_token_value + 1, np.int64)
        kind = "<u2" if _narrow(path) else "<u4"
        for b in batches:
            raw = b"".join(x for x in b.column(0).to_pylist() if x)
            total += np.bincount(np.frombuffer(raw, kind), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["token", "n"])

    return run


def _packed(path: str, rank, by_rank, first: int):
    """The packed rows; the row numbered first carries by_rank."""

    def run(batches):
        kind = "<u2" if _narrow(path) else "<u4"
        for b in batches:
            blobs = b.column(3).to_pylist()
            ids = np.frombuffer(b"".join(x for x in blobs if x), kind)
            count = np.array([len(x) // ids.itemsize if x else 0 for x in blobs], np.int64)
            controls, datas = pack(rank.value[ids], count)
            null = [x is None for x in blobs]
            table = pa.array([by_rank.value if r == first else None for r in b.column(0).to_pylist()], pa.binary())
            packed = [pa.array([None if o else x for o, x in zip(null, y)], pa.binary()) for y in (controls, datas)]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), *packed, table, *b.columns[4:]], ["doc_id", "n_tokens", "control", "data", "token_by_rank", *b.schema.names[4:]])

    return run


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, keep: tuple = ()) -> tuple[DataFrame, DataFrame]:
    """(encoded, ranks): (doc_id, n_tokens, control, data, token_by_rank, and the columns to keep) for each row of docs, and
    (rank, token, n). token_by_rank: in one row the tokens in order of rank as 4-byte little-endian numbers, else null."""
    spark = ready(docs.sparkSession)
    x = only(docs, "doc_id", "text", *keep)
    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in x.schema.fields[2:])
    tokens = x.mapInArrow(_tokens(vocabulary), f"doc_id bigint, n_tokens bigint, ids binary{kept}")
    tokens = written(tokens.select(F.monotonically_increasing_id().alias("row"), "*"), "tokens")
    n = tokens.select("ids").mapInArrow(_counts(vocabulary), "token int, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    # at most one row for each entry of the vocabulary, however many documents there are
    rows = sorted(n.collect(), key=lambda r: (-r["n"], r["token"]))
    first = tokens.agg(F.min("row")).first()[0]
    rank = np.zeros(tokenizer(vocabulary)[0].max_token_value + 1, np.uint32)
    rank[[r["token"] for r in rows]] = np.arange(len(rows))
    ranks = spark.createDataFrame([(k, r["token"], r["n"]) for k, r in enumerate(rows)], "rank int, token int, n bigint")
    by_rank = np.array([r["token"] for r in rows], "<u4").tobytes()
    pack_ = _packed(vocabulary, spark.sparkContext.broadcast(rank), spark.sparkContext.broadcast(by_rank), -1 if first is None else first)
    return tokens.mapInArrow(pack_, f"doc_id bigint, n_tokens bigint, control binary, data binary, token_by_rank binary{kept}"), ranks


def token_table(encoded: DataFrame) -> np.ndarray:
    """Token by rank, as the rows of encode() carry it."""
    one = encoded.filter("token_by_rank is not null").select("token_by_rank").first()
    return np.frombuffer(one[0] if one else b"", "<u4")


def decode(control: bytes, data: bytes, n: int, tokens: np.ndarray, vocabulary: str = VOCABULARY) -> str:
    """The text of a row of encode(); tokens: token by rank."""
    return tokenizer(vocabulary)[0].decode(tokens[unpack(control, data, n)].tolist())
