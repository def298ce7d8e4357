"""An encoder that makes FLAC streams for tables without audio: many streams at once, in numpy.

A frame takes the cheapest of constant, verbatim, fixed (order 0 to 4) and linear prediction (order 6) for each channel, of
the four stereo modes the one with the least differences, and Rice codes in one or 16 partitions.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import ragged, slices, utf8
from .flac import crc8, crc16
from .shared import only, ready

BLOCK, RATE, LPC, PRECISION = 4096, 16000, 6, 12


def _sum(v, first):
    return np.add.reduceat(v, first)


def _number(n: int) -> bytes:
    if n < 0x80:
        return bytes([n])
    more = 1
    while n >> (6 * more + 6 - more):
        more += 1
    return bytes([(0xFF << (7 - more) & 0xFF) | n >> 6 * more, *[0x80 | n >> 6 * k & 63 for k in range(more - 1, -1, -1)]])


def _predictors(x, pos, first, size):
    """Quantised coefficients (by subframe and lag) and shifts: autocorrelation and Levinson's recursion on all subframes."""
    f = x.astype(np.float64)
    r = np.zeros((LPC + 1, len(first)))
    for lag in range(LPC + 1):
        y = np.zeros_like(f)
        y[lag:] = f[lag:] * f[: len(f) - lag]
        y[pos < lag] = 0
        r[lag] = _sum(y, first)
    a = np.zeros((LPC, len(first)))
    err = r[0] * (1 + 1e-9) + 1e-9
    for i in range(LPC):
        k = (r[i + 1] - (a[:i] * r[1 : i + 1][::-1]).sum(0)) / err
        new = a.copy()
        new[i] = k
        new[:i] = a[:i] - k * a[:i][::-1]
        a, err = new, np.maximum(err * (1 - k * k), 1e-9)
    top = np.maximum(np.abs(a).max(0), 1e-9)
    shift = np.clip(PRECISION - 2 - np.floor(np.log2(top)).astype(np.int64), 0, 15)
    most = 1 << (PRECISION - 1)
    return np.clip(np.rint(a * 2.0**shift), -most, most - 1).astype(np.int64), shift


def _items(at, value, n):
    return at, value.astype(np.int64), n + np.zeros(len(at), np.int64)


def encode_streams(samples: np.ndarray, count: np.ndarray, channels: np.ndarray, bits: int = 16, block: int = BLOCK, rate: int = RATE) -> list[bytes]:
    """FLAC streams; samples: all streams' interleaved samples, count: samples (of all channels) of each, channels: 1 or 2."""
    n = count // channels
    begin = np.cumsum(count) - count
    frames = -(-n // block)
    row = np.repeat(np.arange(len(n)), frames)
    no = ragged(np.zeros(len(n), np.int64), frames)
    size = np.minimum(block, n[row] - no * block)
    ch = channels[row]
    chunks: list[bytes] = []
    if len(row):
        chunks = _encode_frames(samples, begin[row] + no * block * ch, size, ch, no, bits)
    out, at = [], 0
    width = -(-bits // 8)
    for s in range(len(n)):
        raw = samples[begin[s] : begin[s] + count[s]]
        pcm = raw.astype("<i2").tobytes() if width == 2 else raw.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()
        info = block.to_bytes(2, "big") * 2 + bytes(6) + (rate << 44 | int(channels[s] - 1) << 41 | bits - 1 << 36 | int(n[s])).to_bytes(8, "big") + hashlib.md5(pcm).digest()
        out.append(b"fLaC" + b"\x80" + (34).to_bytes(3, "big") + info + b"".join(chunks[at : at + frames[s]]))
        at += int(frames[s])
    return out


def _encode_frames(samples, begin, size, ch, no, bits):
    idx = ragged(np.zeros(len(size), np.int64), size)
    base, step = np.repeat(begin, size), np.repeat(ch, size)
    left = samples[base + idx * step].astype(np.int64)
    right = np.where(step == 2, samples[np.minimum(base + idx * step + 1, len(samples) - 1)], 0).astype(np.int64)
    first = np.cumsum(size) - size
    side, mid = left - right, (left + right) >> 1

    def rough(v):
        d = np.abs(np.diff(v, prepend=0))
        d[first] = 0
        return _sum(d, first)

    l, r, s, m = map(rough, (left, right, side, mid))
    mode = np.where(ch == 2, np.argmin(np.stack([l + r, l + s, s + r, m + s]), 0), 0)
    each = np.repeat(mode, size)
    one = np.choose(each, [left, left, side, mid])
    two = np.choose(each, [right, side, right, side])
    # subframes in order: frame, channel
    frame = np.repeat(np.arange(len(size)), ch)
    c = ragged(np.zeros(len(size), np.int64), ch)
    x = np.concatenate([one, two])[ragged(first[frame] + c * len(one), size[frame])]
    width = bits + ((c == 1) & ((mode[frame] == 1) | (mode[frame] == 3))) + ((c == 0) & (mode[frame] == 2))
    n = size[frame]
    start = np.cumsum(n) - n
    pos = ragged(np.zeros(len(n), np.int64), n)
    sub = np.repeat(np.arange(len(n)), n)
    constant = np.maximum.reduceat(x, start) == np.minimum.reduceat(x, start)
    ored = np.bitwise_or.reduceat(x, start)
    wasted = np.where(constant, 0, np.rint(np.log2(np.maximum(ored & -ored, 1).astype(np.float64))).astype(np.int64))
    x = x >> wasted[sub]
    width = width - wasted
    cost = np.full((LPC + 2, len(n)), np.inf)
    res = []
    e = x
    for o in range(5):
        if o:
            e = np.diff(e, prepend=0)
        v = np.where(pos >= o, e, 0)
        res.append(v)
        cost[o] = np.where(n > o, n * (np.log2(_sum(np.abs(v), start) / n + 0.5) + 1.9) + o * width, np.inf)
    coef, shift = _predictors(x, pos, start, n)
    pred = np.zeros(len(x), np.int64)
    for k in range(LPC):
        pred[k + 1 :] += coef[k, sub[k + 1 :]] * x[: len(x) - k - 1]
    v = np.where(pos >= LPC, x - (pred >> shift[sub]), 0)
    res.append(v)
    cost[5] = np.where(n > 4 * LPC, n * (np.log2(_sum(np.abs(v), start) / n + 0.5) + 1.9) + LPC * (width + PRECISION) + 9, np.inf)
    cost[6] = n * width
    best = np.where(constant, 7, np.argmin(cost[:7], 0))
    order = np.where(best < 5, best, np.where(best == 5, LPC, 0))
    coded = best < 6
    r_ = np.choose(np.minimum(best, 5)[sub], res)
    u = (r_ << 1) ^ (r_ >> 63)
    split = np.where((n % 16 == 0) & (n >> 4 > LPC), 4, 0)
    inside = n >> split
    part = (np.cumsum(1 << split) - (1 << split))[sub] + pos // inside[sub]
    pstart = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    length = np.diff(np.r_[pstart, len(part)])
    k = np.clip(np.floor(np.log2(_sum(u, pstart) / length * 0.7 + 1e-9)), 0, 30).astype(np.int64)
    five = np.maximum.reduceat(k, np.searchsorted(sub[pstart], np.arange(len(n)))) > 14
    wide = 4 + five.astype(np.int64)
    kk = np.repeat(k, length)
    is_coded = coded[sub]
    live = is_coded & (pos >= order[sub])
    verb = (best == 6)[sub]
    quot = np.where(live, u >> kk, 0)
    bits_ = np.where(live, kk + 1, np.where(verb, width[sub], 0))
    value = np.where(live, (1 << kk) | (u & ((1 << kk) - 1)), x & ((1 << width[sub]) - 1))
    param = np.zeros(len(x), np.int64)
    param[pstart] = np.where(is_coded[pstart], wide[sub[pstart]], 0)
    run = quot + bits_ + param
    head = 8 + wasted + np.where(coded, order * width + 6, 0) + np.where(best == 5, 9 + LPC * PRECISION, 0) + np.where(best == 7, width, 0)
    body = _sum(run, start)
    full = head + body
    # frames: header bytes, subframes, padding to a byte, CRC-16
    heads = []
    for f in range(len(size)):
        h = bytes([0xFF, 0xF8, 0x70, (0 if ch[f] == 1 else (1, 8, 9, 10)[mode[f]]) << 4 | {8: 1, 12: 2, 16: 4, 20: 5, 24: 6}[bits] << 1]) + _number(int(no[f])) + int(size[f] - 1).to_bytes(2, "big")
        heads.append(h + bytes([crc8(h)]))
    hbytes = np.array([len(h) for h in heads], np.int64)
    ffirst = np.searchsorted(frame, np.arange(len(size)))
    inner = -(-_sum(full, ffirst) // 8)
    total = hbytes + inner + 2
    at = np.cumsum(total) - total
    before = np.cumsum(full) - full
    sbase = (at + hbytes)[frame] * 8 + before - before[ffirst][frame]
    cum = np.cumsum(run) - run
    here = sbase[sub] + head[sub] + cum - cum[start][sub]
    kind = np.where(best == 7, 0, np.where(best == 6, 1, np.where(best == 5, 31 + LPC, 8 + order)))
    items = [_items(sbase, kind << 1 | (wasted > 0), 8)]
    w = np.flatnonzero(wasted)
    items.append(_items(sbase[w] + 8 + wasted[w] - 1, np.ones(len(w)), 1))
    z = np.flatnonzero(best == 7)
    items.append(_items(sbase[z] + 8, x[start[z]] & ((1 << width[z]) - 1), width[z]))
    for o in range(LPC):
        g = np.flatnonzero(coded & (order > o))
        items.append(_items(sbase[g] + 8 + wasted[g] + o * width[g], x[start[g] + o] & ((1 << width[g]) - 1), width[g]))
    q = np.flatnonzero(best == 5)
    b = sbase[q] + 8 + wasted[q] + LPC * width[q]
    items += [_items(b, np.full(len(q), PRECISION - 1), 4), _items(b + 4, shift[q], 5)]
    items += [_items(b + 9 + o * PRECISION, coef[o, q] & ((1 << PRECISION) - 1), PRECISION) for o in range(LPC)]
    g = np.flatnonzero(coded)
    items.append(_items(sbase[g] + head[g] - 6, (five[g].astype(np.int64) << 4) | split[g], 6))
    g = pstart[is_coded[pstart]]
    items.append(_items(here[g], kk[g], wide[sub[g]]))
    g = np.flatnonzero(live | verb)
    items.append(_items(here[g] + param[g] + quot[g], value[g], bits_[g]))
    place, val, nb = (np.concatenate(c) for c in zip(*items))
    # an item lies in one 32-bit word and the next; items share no bits, so sums join them
    v = val.astype(np.uint64) << (64 - (place & 31) - nb).astype(np.uint64)
    words = -(-int(total.sum()) // 4) + 2
    joined = np.bincount(place >> 5, (v >> np.uint64(32)).astype(np.float64), words) + np.bincount((place >> 5) + 1, (v & np.uint64(0xFFFFFFFF)).astype(np.float64), words)
    raw = joined.astype(">u4").view(np.uint8)[: int(total.sum())]
    for f in range(len(size)):
        raw[at[f] : at[f] + hbytes[f]] = np.frombuffer(heads[f], np.uint8)
    sums = crc16(raw, at, at + total - 2)
    raw[at + total - 2] = sums >> 8
    raw[at + total - 1] = sums & 255
    blob, ends = raw.tobytes(), (at + total).tolist()
    return [blob[a:z] for a, z in zip(at.tolist(), ends)]


def text_media(docs: DataFrame) -> DataFrame:
    """(doc_id, media): the UTF-8 bytes of each text as 16-bit samples (a last odd byte is followed by a zero byte), in FLAC; stereo
    where the number of bytes is a multiple of four. A lossless stand-in for audio: its PCM is known from the text.

    A null text gives a null medium, an empty one a stream without frames; repeated rows and null doc_ids like any other; an empty
    table gives no rows; other columns are ignored."""
    ready(docs.sparkSession)

    def run(batches):
        for b in batches:
            for part in slices(b, 1):
                raw, off = utf8(part.column(1))
                n = np.diff(off)
                even = n + (n & 1)
                buf = np.zeros(int(even.sum()), np.uint8)
                buf[ragged(np.cumsum(even) - even, n)] = raw
                media = encode_streams(buf.view("<i2"), even // 2, np.where((n % 4 == 0) & (n > 0), 2, 1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if z else m for m, z in zip(media, part.column(1).is_null().to_pylist())], pa.binary())], ["doc_id", "media"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, media binary")
