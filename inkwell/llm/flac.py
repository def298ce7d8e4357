"""FLAC media columns: frames are found, checked and decoded in numpy, many at a time, and come out as PCM blocks.

Frames are found by their sync code, header checksum (CRC-8) and number, and held against their CRC-16; so a worker decodes
all frames of a slice of streams side by side: step i reads the i-th residual of every frame (Rice codes with 4- or 5-bit
parameters, escapes, partitions), then step i of the linear predictor restores the i-th sample of every frame; fixed
predictors are running sums. Wasted bits, stereo decorrelation and 4 to 32 bits a sample are supported.

Each frame gives one block: its first sample counts from the stream's start, so a player can seek by it.

Defined cases: a null or empty medium gives no rows; one that isn't FLAC gives one row without block and the error
`not flac`; a frame that fails its checksum or can't be decoded gives a block with null pcm and the error `bad frame`, later
frames are decoded all the same; a stream without frames gives no rows; a null doc_id is carried along; repeated rows give
repeated blocks; an empty table gives no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import ragged, slices
from .shared import only, ready

SLICE_BYTES, GROUP_SAMPLES = 6 << 20, 1 << 20
_SIZES = {1: 192, **{n: 576 << (n - 2) for n in range(2, 6)}, **{n: 256 << (n - 8) for n in range(8, 16)}}
_RATES = {1: 88200, 2: 176400, 3: 192000, 4: 8000, 5: 16000, 6: 22050, 7: 24000, 8: 32000, 9: 44100, 10: 48000, 11: 96000}
_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
_FIXED = np.array([[0, 0, 0, 0], [1, 0, 0, 0], [2, -1, 0, 0], [3, -3, 1, 0], [4, -6, 4, -1]], np.int64)


def _table(poly: int, width: int) -> list[int]:
    out = []
    for b in range(256):
        r = b << (width - 8)
        for _ in range(8):
            r = (r << 1) ^ (poly if r >> (width - 1) else 0)
            r &= (1 << width) - 1
        out.append(r)
    return out


CRC8, CRC16 = _table(0x07, 8), _table(0x8005, 16)
_T16 = np.array(CRC16, np.uint16)
_CHUNK = 64


def _far() -> np.ndarray:
    """What a byte adds to the CRC-16 of the chunk that it stands in, by the bytes that follow there."""
    out = np.zeros((_CHUNK, 256), np.uint16)
    out[0] = _T16
    for d in range(1, _CHUNK):
        out[d] = (out[d - 1] << 8) ^ _T16[out[d - 1] >> 8]
    return out


_FAR = _far()
_LOW = np.zeros(256, np.uint16)
_HIGH = np.zeros(256, np.uint16)
for _b in range(256):
    for _t, _v in ((_LOW, _b), (_HIGH, _b << 8)):
        for _ in range(_CHUNK):
            _v = ((_v << 8) & 0xFFFF) ^ CRC16[_v >> 8]
        _t[_b] = _v


def crc8(data: bytes) -> int:
    r = 0
    for b in data:
        r = CRC8[r ^ b]
    return r


def crc16(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-16 of each span of bytes: chunks by table, joined in steps that take all spans at once."""
    n = end - start
    out = np.zeros(len(n), np.uint16)
    chunks = -(-n // _CHUNK)
    total = int(chunks.sum())
    if not total:
        return out
    # the first chunk of a span is the short one
    back = ragged(np.zeros(len(n), np.int64), chunks)
    last = np.repeat(end, chunks) - (np.repeat(chunks, chunks) - 1 - back) * _CHUNK
    size = np.where(back == 0, np.repeat(n - (chunks - 1) * _CHUNK, chunks), _CHUNK)
    at = ragged(last - size, size)
    away = np.repeat(last, size) - 1 - at
    part = np.bitwise_xor.reduceat(_FAR[away, raw[at]], np.cumsum(size) - size)
    first = np.cumsum(chunks) - chunks
    order = np.argsort(-chunks, kind="stable")
    live = chunks[order]
    acc = out[order]
    for k in range(int(chunks.max())):
        m = int(np.searchsorted(-live, -k))
        acc[:m] = _LOW[acc[:m] & 255] ^ _HIGH[acc[:m] >> 8] ^ part[first[order[:m]] + k]
    out[order] = acc
    return out


def stream_info(data: bytes) -> tuple[int, dict] | None:
    """Where the frames begin, and STREAMINFO; None if it isn't FLAC."""
    if data[:4] != b"fLaC":
        return None
    at, info, last = 4, None, False
    while not last:
        if at + 4 > len(data):
            return None
        last, kind, size = bool(data[at] & 128), data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        if kind == 0 and len(body) >= 34:
            low, high = struct.unpack(">HH", body[:4])
            v = int.from_bytes(body[10:18], "big")
            info = {"least": low, "most": high, "rate": v >> 44, "channels": (v >> 41 & 7) + 1, "bits": (v >> 36 & 31) + 1, "samples": v & (1 << 36) - 1, "md5": body[18:34]}
        at += 4 + size
    return (at, info) if info else None


def frame_header(d: bytes, p: int, end: int, info: dict):
    """(header bytes, block size, rate, channel assignment, bits, first sample or None, frame number or None), or None."""
    if p + 6 > end:
        return None
    variable, b2, b3 = d[p + 1] & 1, d[p + 2], d[p + 3]
    size, rate, chan, bits = b2 >> 4, b2 & 15, b3 >> 4, b3 >> 1 & 7
    if size == 0 or rate == 15 or chan > 10 or bits == 3 or b3 & 1:
        return None
    x, q = d[p + 4], p + 5
    if x >= 0x80:
        more = 1
        while more < 7 and x >> (6 - more) & 1:
            more += 1
        if x < 0xC0 or x == 0xFF or q + more > end:
            return None
        x &= (1 << (6 - more)) - 1 if more < 6 else 0
        for _ in range(more):
            if d[q] >> 6 != 2:
                return None
            x, q = x << 6 | d[q] & 63, q + 1
    tail = (1 if size == 6 else 2 if size == 7 else 0) + (1 if rate == 12 else 2 if rate in (13, 14) else 0)
    if q + tail >= end:
        return None
    if size in (6, 7):
        n = size - 5
        size_, q = int.from_bytes(d[q : q + n], "big") + 1, q + n
    else:
        size_ = _SIZES[size]
    if rate >= 12:
        n = 1 if rate == 12 else 2
        v, q = int.from_bytes(d[q : q + n], "big"), q + n
        rate_ = v * {12: 1000, 13: 1, 14: 10}[rate]
    else:
        rate_ = _RATES.get(rate, info["rate"])
    if crc8(d[p:q]) != d[q]:
        return None
    return q + 1 - p, size_, rate_, chan, _BITS.get(bits, info["bits"]), x if variable else None, None if variable else x


def find_frames(raw: np.ndarray, data: bytes, off: np.ndarray):
    """(frames, rows that aren't FLAC): frames as (row, start, end, good, header ...) in the order of the streams."""
    sync = np.flatnonzero((raw[:-1] == 0xFF) & ((raw[1:] & 0xFE) == 0xF8)) if len(raw) > 1 else np.zeros(0, np.int64)
    found, other = [], []
    for row in range(len(off) - 1):
        a, z = int(off[row]), int(off[row + 1])
        if a == z:
            continue
        head = stream_info(data[a : min(z, a + 4096)]) or stream_info(data[a:z])
        if head is None:
            other.append(row)
            continue
        begin, info = head
        last, own = -1, []
        for p in sync[np.searchsorted(sync, a + begin) : np.searchsorted(sync, z)].tolist():
            h = frame_header(data, p, z, info)
            if h is None:
                continue
            place = h[5] if h[5] is not None else h[6] * info["least"]
            if place > last:
                own.append((row, p, h, place))
                last = place
        found += [(*x, y) for x, y in zip(own, [x[1] for x in own[1:]] + [z])]
    start = np.array([f[1] for f in found], np.int64)
    end = np.array([f[4] for f in found], np.int64)
    good = crc16(raw, start, end) == 0
    rows = np.array([f[0] for f in found], np.int64)
    skip = np.zeros(len(found), bool)
    for n in np.flatnonzero(~good).tolist():
        # a frame may hold what looks like another's header: then it ends further on
        for m in range(n + 1, len(found)):
            if skip[n] or rows[m] != rows[n]:
                break
            if crc16(raw, start[n : n + 1], end[m : m + 1])[0] == 0:
                good[n], end[n] = True, end[m]
                skip[n + 1 : m + 1] = True
                break
    return [(f[0], int(start[n]), int(end[n]), bool(good[n]), f[2], f[3]) for n, f in enumerate(found) if not skip[n]], other


class Bits:
    """Reads bits at many places of a buffer at once."""

    def __init__(self, raw: np.ndarray):
        b = np.concatenate([raw, np.zeros(24, np.uint8)])
        n = len(raw) + 16
        w = np.zeros(n, np.uint64)
        for k in range(8):
            w |= b[k : k + n].astype(np.uint64) << np.uint64(56 - 8 * k)
        self.w, self.most = w, (n - 1) * 8

    def window(self, pos):
        """64 bits of which the first 57 count."""
        pos = np.minimum(pos, self.most)
        return self.w[pos >> 3] << (pos & 7).astype(np.uint64)

    def read(self, pos, n):
        """n (up to 57) bits at each place."""
        n = np.asarray(n, np.uint64)
        return ((self.window(pos) >> np.uint64(1)) >> (np.uint64(63) - n)).astype(np.int64)

    def signed(self, pos, n):
        v, n = self.read(pos, n), np.asarray(n, np.int64)
        return np.where(n > 0, v - ((v >> np.maximum(n - 1, 0) & 1) << n), 0)

    def unary(self, pos):
        """Zeros before the next one."""
        out, at, todo = np.zeros(len(pos), np.int64), pos.copy(), np.arange(len(pos))
        while len(todo):
            e = 53 - np.frexp((self.window(at[todo]) >> np.uint64(11)).astype(np.float64))[1].astype(np.int64)
            out[todo] += e
            at[todo] += e
            todo = todo[(e == 53) & (at[todo] < self.most)]
        return out


def residuals(bits: Bits, pos: np.ndarray, size: np.ndarray, order: np.ndarray, out: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Decodes the residual of each lane (by size, largest first) into the columns of out; returns where they end."""
    method = bits.read(pos, 2)
    parts = bits.read(pos + 2, 4)
    pos = pos + 6
    each = size >> parts
    bad |= (method > 1) | ((each << parts) != size) | (each < order)
    k, raw = np.zeros(len(pos), np.int64), np.zeros(len(pos), bool)
    # the step at which each lane's next partition begins
    turn, never = order.copy(), np.int64(1) << 40
    turn[bad] = never
    wide = 4 + (method == 1)
    any_raw, one, begin, soon = False, np.uint64(1), int(order.min()) if len(order) else 0, 0
    done = np.zeros(len(pos), np.int64)
    for i in range(begin, int(size.max()) if len(size) else 0):
        m = int(np.searchsorted(-size, -i))
        while soon <= i:
            new = np.flatnonzero(turn[:m] == i)
            k[new] = bits.read(pos[new], wide[new])
            pos[new] += wide[new]
            raw[new] = k[new] == (1 << wide[new]) - 1
            r = new[raw[new]]
            if len(r):
                k[r] = bits.read(pos[r], 5)
                pos[r] += 5
            done[new] += each[new]
            turn[new] = np.where(done[new] < size[new], done[new], never)
            any_raw = raw.any()
            soon = int(turn.min())
        at, kk = pos[:m], k[:m]
        if begin < 33 and i < 33:
            on = (order[:m] <= i) & ~bad[:m]
        else:
            on = None
        v = bits.window(at)
        e = 53 - np.frexp((v >> np.uint64(11)).astype(np.float64))[1].astype(np.int64)
        ku = kk.astype(np.uint64)
        low = (((v << e.astype(np.uint64)) << one) >> one) >> (np.uint64(63) - ku)
        far = e + kk > 55
        if far.any():
            f = np.flatnonzero(far)
            e[f] = bits.unary(at[f])
            low[f] = bits.read(at[f] + e[f] + 1, kk[f]).astype(np.uint64)
        u = (e << kk) | low.astype(np.int64)
        val, step = (u >> 1) ^ -(u & 1), e + 1 + kk
        if any_raw:
            r = np.flatnonzero(raw[:m])
            if len(r):
                val[r], step[r] = bits.signed(at[r], kk[r]), kk[r]
        if on is None:
            out[i, :m] = val
            pos[:m] += step
        else:
            out[i, :m] = np.where(on, val, out[i, :m])
            pos[:m] += np.where(on, step, 0)
    return pos


def subframes(bits: Bits, pos: np.ndarray, size: np.ndarray, width: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(samples by step and lane, ends) of one subframe a lane; lanes are ordered by size, largest first."""
    lanes, most = len(pos), int(size.max())
    head = bits.read(pos, 8)
    kind, pos = head >> 1 & 63, pos + 8
    bad |= head >> 7 > 0
    wasted = np.zeros(lanes, np.int64)
    w = np.flatnonzero(head & 1)
    wasted[w] = bits.unary(pos[w]) + 1
    pos[w] += wasted[w]
    width = width - wasted
    bad |= width < 1
    width = np.maximum(width, 1)
    fixed, lpc = (kind >= 8) & (kind <= 12), kind >= 32
    bad |= (kind > 1) & ~fixed & ~lpc
    order = np.where(fixed, kind - 8, np.where(lpc, kind - 31, 0))
    bad |= order > size
    x = np.zeros((most, lanes), np.int64)
    c = np.flatnonzero((kind == 0) & ~bad)
    x[:, c] = bits.signed(pos[c], width[c])
    pos[c] += width[c]
    v = np.flatnonzero((kind == 1) & ~bad)
    if len(v):
        i, lane = ragged(np.zeros(len(v), np.int64), size[v]), np.repeat(v, size[v])
        x[i, lane] = bits.signed(pos[lane] + i * width[lane], width[lane])
        pos[v] += size[v] * width[v]
    p = np.flatnonzero((fixed | lpc) & ~bad)
    if not len(p):
        return x << wasted, pos
    at, o, n = pos[p].copy(), order[p], size[p]
    for i in range(int(o.max())):
        on = np.flatnonzero(o > i)
        x[i, p[on]] = bits.signed(at[on], width[p[on]])
        at[on] += width[p[on]]
    coef, shift = np.zeros((32, len(p)), np.int64), np.zeros(len(p), np.int64)
    is_lpc = lpc[p]
    q = np.flatnonzero(is_lpc)
    wrong = np.zeros(len(p), bool)
    if len(q):
        precision = bits.read(at[q], 4) + 1
        wrong[q] = precision == 16
        shift[q] = bits.signed(at[q] + 4, 5)
        wrong[q] |= shift[q] < 0
        shift[q] = np.maximum(shift[q], 0)
        at[q] += 9
        for i in range(int(o[q].max())):
            on = o[q] > i
            coef[i, q[on]] = bits.signed(at[q[on]], precision[on])
            at[q[on]] += precision[on]
    res = np.zeros((int(n.max()), len(p)), np.int64)
    res[: min(32, len(res))] = x[: min(32, len(res)), p]
    pos[p] = residuals(bits, at, n, o, res, wrong)
    bad[p] |= wrong
    for d in range(5):
        f = np.flatnonzero(~is_lpc & (o == d))
        if len(f) and d:
            y = res[:, f]
            warm = [y[:d].copy()]
            for _ in range(d - 1):
                warm.append(np.diff(warm[-1], axis=0))
            for j in range(d - 1, -1, -1):
                y[j] = warm[j][0]
                np.cumsum(y[j:], axis=0, out=y[j:])
            res[:, f] = y
    for d in np.unique(o[q]).tolist():
        f = q[o[q] == d]
        y, cf, sh = np.ascontiguousarray(res[:, f]), np.ascontiguousarray(coef[:d, f][::-1]), shift[f]
        for i in range(d, int(n[f].max())):
            m = int(np.searchsorted(-n[f], -i))
            y[i, :m] += np.einsum("ol,ol->l", cf[:, :m], y[i - d : i, :m]) >> sh[:m]
        res[:, f] = y
    x[: len(res), p] = res
    return x << wasted, pos


def pcm_bytes(x: np.ndarray, bits: int) -> bytes:
    """Interleaved samples as signed little-endian numbers of whole bytes."""
    n = -(-bits // 8)
    return x.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :n].tobytes() if n != 2 else x.astype("<i2").tobytes()


def decode_frames(raw: np.ndarray, frames: list) -> list[bytes | None]:
    """PCM of each frame, None where it can't be decoded."""
    out: list[bytes | None] = [None] * len(frames)
    todo = sorted((n for n, f in enumerate(frames) if f[3]), key=lambda n: -frames[n][4][1])
    reader = Bits(raw) if todo else None
    while todo:
        size = frames[todo[0]][4][1]
        group, todo = todo[: max(1, GROUP_SAMPLES // size)], todo[max(1, GROUP_SAMPLES // size) :]
        head = [frames[n][4] for n in group]
        size = np.array([h[1] for h in head], np.int64)
        chan = np.array([h[3] for h in head], np.int64)
        width = np.array([h[4] for h in head], np.int64)
        count = np.where(chan < 8, chan + 1, 2)
        pos = np.array([(frames[n][1] + h[0]) * 8 for n, h in zip(group, head)], np.int64)
        bad = np.zeros(len(group), bool)
        chans = []
        for c in range(int(count.max())):
            on = np.flatnonzero((count > c) & ~bad)
            x = np.zeros((int(size[0]), len(group)), np.int64)
            if len(on):
                wide = width + ((c == 1) & ((chan == 8) | (chan == 10))) + ((c == 0) & (chan == 9))
                wrong = np.zeros(len(on), bool)
                y, pos[on] = subframes(reader, pos[on], size[on], wide[on], wrong)
                bad[on] |= wrong
                x[: len(y), on] = y
            chans.append(x)
        end = np.array([frames[n][2] for n in group], np.int64)
        bad |= (pos + 7) // 8 + 2 != end
        if len(chans) > 1:
            a, b = chans[0], chans[1]
            f = np.flatnonzero(chan == 8)
            b[:, f] = a[:, f] - b[:, f]
            f = np.flatnonzero(chan == 9)
            a[:, f] += b[:, f]
            f = np.flatnonzero(chan == 10)
            side = b[:, f]
            mid = a[:, f] * 2 + (side & 1)
            a[:, f], b[:, f] = (mid + side) >> 1, (mid - side) >> 1
        chans = [np.ascontiguousarray(c.T) for c in chans]
        for k, n in enumerate(group):
            if not bad[k]:
                one = np.stack([c[k, : size[k]] for c in chans[: count[k]]], 1) if count[k] > 1 else chans[0][k, : size[k]]
                out[n] = pcm_bytes(one.reshape(-1), int(width[k]))
    return out


SCHEMA = "doc_id bigint, block_no int, first_sample bigint, n_samples int, channels int, sample_rate int, bits int, pcm binary, error string"
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
_NAMES = ["row", "block_no", "first_sample", "n_samples", "channels", "sample_rate", "bits", "pcm", "error"]


def decode_column(col: pa.Array) -> list[list]:
    """Columns (row, block_no, first_sample, n_samples, channels, sample_rate, bits, pcm, error) of all blocks of a column."""
    col = col.fill_null(b"").cast(pa.large_binary())
    _, offs, buf = col.buffers()
    off = np.frombuffer(offs, np.int64, len(col) + 1, col.offset * 8)
    raw = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    frames, other = find_frames(raw, raw.tobytes(), off)
    pcm = decode_frames(raw, frames)
    rows = [(r, None, None, None, None, None, None, None, "not flac") for r in other]
    number: dict[int, int] = {}
    for (row, _, _, _, h, place), x in zip(frames, pcm):
        n = number[row] = number.get(row, -1) + 1
        rows.append((row, n, place, h[1], h[3] + 1 if h[3] < 8 else 2, h[2], h[4], x, None if x is not None else "bad frame"))
    rows.sort(key=lambda r: (r[0], r[1] or 0))
    return [list(c) for c in zip(*rows)] if rows else [[] for _ in _TYPES]


def pcm_blocks(media: DataFrame, column: str = "media") -> DataFrame:
    """The PCM blocks of a column of FLAC streams: doc_id, block_no, first_sample, n_samples, channels, sample_rate, bits, pcm
    (interleaved, signed, little-endian), error."""
    ready(media.sparkSession)

    def run(batches):
        for b in batches:
            for part in slices(b, 1, SLICE_BYTES):
                cols = decode_column(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(cols[0], pa.int64())), *[pa.array(c, t) for c, t in zip(cols[1:], _TYPES[1:])]], ["doc_id", *_NAMES[1:]])

    return only(media, "doc_id", column).mapInArrow(run, SCHEMA)
