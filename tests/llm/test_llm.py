"""The operators against brute force, exact round trips and held-out accuracy, and their defined cases."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkwell.llm import arrays, components, decontaminate, flac, flac_encode, licenses, line_dedup, mixing, ngram_join, quality, quotes, style_tree, token_output

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
rng = random.Random(3)
VOCAB = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(400)]


def words(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], DOCS)


def corpus():
    rows = [(i, words(60 + i % 30, i)) for i in range(60)]
    for i in range(60, 90):
        w = rows[i - 60][1].split()
        for k in range(i % 7):
            w[(k * 11) % len(w)] = f"new{i}x{k}"
        rows.append((i, " ".join(w)))
    return rows + [(100, rows[0][1]), (101, rows[0][1]), (100, rows[0][1]), (102, ""), (103, None), (None, rows[1][1]), (104, "one"), (105, "one"), (106, "x " * 30_000)]


def grams(text, n=2):
    import re

    w = re.findall(r"[A-Za-z0-9_\u0080-\U0010ffff]+", text.lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def joined(rows):
    """(doc_id, class, copies, links) by brute force over (doc_id, text)."""
    members = sorted({(i, frozenset(grams(t))) for i, t in rows if i is not None and t and grams(t)}, key=lambda x: x[0])
    sets = list({s for _, s in members})
    root = list(range(len(sets)))
    find = lambda x: x if root[x] == x else find(root[x])
    links = [0] * len(sets)
    for a in range(len(sets)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.65 * len(sets[a] | sets[b]) - 1e-9:
                links[a], links[b] = links[a] + 1, links[b] + 1
                root[find(a)] = find(b)
    at = {s: k for k, s in enumerate(sets)}
    least, copies = {}, {}
    for i, s in members:
        least.setdefault(find(at[s]), i)
        copies[s] = copies.get(s, -1) + 1
    return {(i, least[find(at[s])], copies[s], links[at[s]]) for i, s in members if copies[s] or links[at[s]]}


def test_ngram_join_equals_brute_force(spark):
    rows = corpus()
    d = docs(spark, rows).withColumn("gram", F.lit(1)).withColumn("cls", F.lit("x"))
    got = [tuple(r) for r in ngram_join.jaccard_join(d).collect()]
    assert len(got) == len(set(got)) and set(got) == joined(rows)
    kept = ngram_join.one_of_each(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    ids = [r["doc_id"] for r in kept.collect()]
    cls = {i: c for i, c, _, _ in got}
    assert sorted(i for i in ids if i is not None) == sorted({i for i, _ in rows if i is not None and cls.get(i, i) == i}) and ids.count(None) == 1


def test_ngram_join_of_large_groups_in_small_blocks(spark, monkeypatch):
    r = random.Random(8)
    rows = []
    for k in range(3):
        base = words(70, 500 + k).split()
        for i in range(40):
            w = list(base)
            for _ in range(r.randint(0, 14)):
                w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
            rows += [(k * 1000 + i, " ".join(w))] * r.choice((1, 1, 2))
    rows += [(9000, rows[0][1]), (9001, rows[0][1]), (9000, rows[60][1]), (0, rows[70][1])]
    r.shuffle(rows)
    want = joined(rows)
    for values in ({}, {"BLOCK_DOCS": 7, "STEP": 50, "HELD": 20, "PACKED": 300}, {"BLOCK_GRAMS": 900, "KEYS": 4}):
        with monkeypatch.context() as m:
            for name, value in values.items():
                m.setattr(ngram_join, name, value)
            got = [tuple(x) for x in ngram_join.jaccard_join(docs(spark, rows).repartition(3)).collect()]
        assert len(got) == len(set(got)) and set(got) == want, values
    assert ngram_join.jaccard_join(docs(spark, [])).count() == 0 and ngram_join.one_of_each(docs(spark, [])).count() == 0


def test_ngram_join_finds_one_head_whatever_the_bitmap_lets_through(spark, monkeypatch):
    base = [words(60, 900 + k) for k in range(4)]
    near = [b + " another end" for b in base]
    rows = [(i, t) for k in range(4) for t, ids in ((base[k], range(k * 1000, k * 1000 + 60)), (near[k], range(k * 1000 + 500, k * 1000 + 540))) for i in ids]
    random.Random(4).shuffle(rows)
    rows.sort(key=lambda r: r[0] in (0, 1000, 2000, 3000, 500, 1500, 2500, 3500))  # the heads come last
    monkeypatch.setattr(ngram_join, "key_bitmap", lambda keys, n: keys.sparkSession.sparkContext.broadcast(np.full(1 << 12, 255, np.uint8)))
    got = ngram_join.jaccard_join(docs(spark, rows).coalesce(1)).collect()
    assert {tuple(r) for r in got} == {(i, i // 1000 * 1000, 39 if i % 1000 >= 500 else 59, 1) for i, _ in rows}


def test_packed_columns_come_back():
    r = np.random.default_rng(5)
    cols = [r.integers(0, 2**63, 100, np.uint64), np.zeros(0, np.uint64), np.arange(7, dtype=np.int64), np.array([-5, 3], np.int64)]
    back = arrays.unpacked(arrays.packed(*cols))
    assert all((b.view(c.dtype) == c).all() and len(b) == len(c) for b, c in zip(back, cols))


def test_suffix_bound_is_a_bound():
    r = np.random.default_rng(0)
    for _ in range(200):
        x, y = (np.unique(r.integers(0, 60, 30)).astype(np.uint64) for _ in range(2))
        assert ngram_join.suffix_bound(x, y) >= len(np.intersect1d(x, y))


def test_parity_bitmaps_bound_the_overlap():
    r = np.random.default_rng(2)
    for n, m in ((5, 5), (60, 300), (900, 1000), (64, 65), (1, 4000)) * 20:
        x, y = (np.unique(r.integers(0, 2000, k)).astype(np.uint64) for k in (n, m))
        a, b = (ngram_join.parity(ngram_join._mixed(z)) for z in (x, y))
        assert min(len(x), len(y)) >= 0 and arrays.most_common(len(x), len(y), a, b) >= len(np.intersect1d(x, y))
        assert arrays.most_common(len(x), len(x), a, a) == len(x)


def test_components_equal_union_find(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 80), r.randint(0, 80)) for _ in range(50)] + [(i, i + 1) for i in range(200, 230)] + [(5, 5)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {x["id"]: x["root"] for x in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


def test_line_dedup_equals_brute_force(spark):
    base = [words(12, k) for k in range(12)]
    near = [b.replace(b.split()[5], b.split()[5] + "x") for b in base[:6]]
    rows = [(1, "\n".join(base[:6])), (2, "\n".join(near) + "\n\n" + base[7]), (3, base[7].upper() + "\nown line here"), (4, None), (5, ""), (6, "a\na"), (None, "zz top"), (7, base[8] + "\n" + words(20_000, 99)), (8, base[8] + " ")]
    order = sorted(((i if i is not None else -1, n, line) for i, t in rows if t is not None for n, line in enumerate(t.split("\n"))), key=lambda x: x[:2])
    norm = [(i, n, " ".join(line.lower().split())) for i, n, line in order]
    sets = [line_dedup.shingles(x) for _, _, x in norm]
    kept, gone = [], set()
    root = list(range(len(norm)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(len(norm)):
        for b in range(a):
            if norm[a][2] and norm[b][2] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    for k, (i, n, x) in enumerate(norm):
        if x and find(k) != k:
            gone.add((i, n))
    out = line_dedup.dedup_lines(docs(spark, rows).withColumn("h", F.lit(1))).collect()
    for r in out:
        i = r["doc_id"] if r["doc_id"] is not None else -1
        src = next(t for j, t in rows if (j if j is not None else -1) == i)
        assert r["text"] == (None if src is None else "\n".join(x for n, x in enumerate(src.split("\n")) if (i, n) not in gone)), i
    assert len(out) == len(rows) and line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_line_dedup_carries_no_places_of_lone_lines(spark):
    """Only lines that repeat or may be similar to others have places: repeats in one text, one partition or far apart, and near copies."""
    rows = [(i, "\n".join(words(12, 1000 * i + k) for k in range(20))) for i in range(20)]
    twice, apart, near = words(12, 90_001), words(12, 90_002), words(30, 90_003)
    rows[2] = (2, rows[2][1] + f"\n{twice}\n{twice}")
    rows[4] = (4, rows[4][1] + f"\n{near}")
    rows[5], rows[19] = (5, rows[5][1] + f"\n{apart}"), (19, f"{apart} \n{near}x\n" + rows[19][1])
    table = docs(spark, rows).repartitionByRange(5, "doc_id")
    _, places = line_dedup.similar_lines(table)
    held = [(r["doc_id"], r["line_no"]) for r in places.filter("line_no is not null").collect()]
    assert {(2, 20), (2, 21), (5, 20), (19, 0), (4, 20), (19, 1)} <= set(held) and len(held) < 100
    want = dict(rows) | {2: rows[2][1].rpartition("\n")[0], 19: "\n".join(rows[19][1].split("\n")[2:])}
    got = line_dedup.dedup_lines(table).collect()
    assert {r["doc_id"]: r["text"] for r in got} == want
    assert {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in got} == {i: (x.count("\n") + 1, {2: 1, 19: 2}.get(i, 0)) for i, x in rows}


def test_parity_bitmaps_of_many_pairs_at_once():
    """The bounds of a batch are those of each pair, whatever the lengths; batches without rows and sliced ones too."""
    r = random.Random(21)
    bits = lambda: pa.array([r.randbytes(r.choice((8, 8, 16, 32, 128, 1024))) for _ in range(300)], pa.binary())
    for x, y in ((bits(), bits()), (bits().slice(7, 90), bits().slice(11, 90)), (bits().slice(0, 0), bits().slice(0, 0))):
        odd = line_dedup.odd_ones(x, y)
        assert [(5000 - k) // 2 for k in odd.tolist()] == [arrays.most_common(2000, 3000, a, b) for a, b in zip(x.to_pylist(), y.to_pylist())]


def test_repeated_lines_are_marked_wherever_they_repeat(monkeypatch):
    """In a slice, in a later slice that is packed with it or after it, and in another task."""
    monkeypatch.setattr(line_dedup, "PACKED", 50 * line_dedup.BANDS)
    lone = iter(words(12, 5000 + k) for k in range(1000))
    batch = lambda *x: pa.record_batch([pa.array(["\n".join([*x, *[next(lone) for _ in range(30)]])])], ["text"])
    tasks = [[batch("in one", "in one"), batch("held"), batch("held"), batch("packed"), batch("lone"), batch("packed")], [batch("far")], [batch("far")]]
    tasks[0].insert(1, batch("held too"))
    tasks[0].insert(2, batch("held too"))
    got = pa.Table.from_batches([b for t in tasks for b in line_dedup._bands(4)(t)])
    out = pa.Table.from_batches([b for k in range(8) for b in line_dedup._buckets(4)(got.filter(pa.compute.equal(got["part"], k)).to_batches()) if b.schema.names[-1] == "often"])
    marked = {r["h"]: r["often"] for r in out.to_pylist() if r["band"] is None}
    c, s, e, _, number = line_dedup.lines(pa.array(["in one\nheld\nheld too\npacked\nfar\nlone"]))
    assert [marked[h] for h in line_dedup.span_hash(c, s, e).view(np.int64).tolist()] == [True] * 5 + [False]
    assert sum(marked.values()) == 5 and len(marked) == 6 + 30 * sum(map(len, tasks))


def test_token_ids_round_trip(spark):
    texts = ["Hello world, it's 2024!", "", None, "naïve café 日本語 \U0001f600  two  spaces\n\nlines ", "a" * 5000, "Hello world, it's 2024!", "don't"]
    enc, ranks = token_output.encode(docs(spark, list(enumerate(texts))).withColumn("ids", F.lit(0)))
    r = sorted(ranks.collect(), key=lambda x: x["rank"])
    assert [(x["n"], -x["token"]) for x in r] == sorted(((x["n"], -x["token"]) for x in r), reverse=True)
    tokens = np.array([x["token"] for x in r])
    for x in enc.collect():
        want = texts[x["doc_id"]]
        if want is None:
            assert x["n_tokens"] is None and x["data"] is None
        else:
            assert token_output.decode(bytes(x["control"]), bytes(x["data"]), x["n_tokens"], tokens) == want
    real = token_output.tokenizer(token_output.VOCABULARY)[0]
    ids, n = token_output.encode_all(pa.array(texts), token_output.VOCABULARY)
    assert ids.tolist() == [i for t in texts if t for i in real.encode_ordinary(t)] and n.sum() == len(ids)


def decoded(rows):
    """(doc_id, text) from the rows of a result alone."""
    table = [r["token_by_rank"] for r in rows if r["token_by_rank"] is not None]
    assert len(table) == 1
    tokens = np.frombuffer(table[0], "<u4")
    return [(r["doc_id"], None if r["data"] is None else token_output.decode(bytes(r["control"]), bytes(r["data"]), r["n_tokens"], tokens)) for r in rows]


def test_results_decode_from_their_own_rows(spark):
    import __spark_entry__
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    want = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = decoded(__spark_entry__.queries()["op2_token_ids"](spark, sf).collect())
    assert len(got) == len(want) and dict(got) == want
    got = decoded(P.run(spark, sf).collect())
    assert got and all(want[i] == t for i, t in got)
    assert token_output.encode(docs(spark, []))[0].count() == 0


def test_pieces_with_apostrophes_are_the_tokenizers():
    r = random.Random(0)
    bits = ["'", "''", " '", "'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'S", "'l", "'r", " ", "  ", "\n", "a", "don", "s", "re", "é", "1", "9", "?!", "-", "\t", " \n"]
    enc = token_output.tokenizer(token_output.VOCABULARY)[0]
    for _ in range(60):
        texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(50)]
        ids, count = token_output.encode_all(pa.array(texts), token_output.VOCABULARY)
        parts = np.split(ids, np.cumsum(count)[:-1])
        assert [p.tolist() for p in parts] == [enc.encode_ordinary(t) for t in texts]


def test_packed_ids_of_every_length():
    ids = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 7], np.uint32)
    c, d = token_output.pack(ids, np.array([4, 0, 5]))
    assert token_output.unpack(c[0], d[0], 4).tolist() == ids[:4].tolist() and c[1] == d[1] == b"" and token_output.unpack(c[2], d[2], 5).tolist() == ids[4:].tolist()


@pytest.mark.parametrize("text,want", [
    ("SPDX-License-Identifier: MIT", (["MIT"], [True], [], True)),
    ("SPDX-License-Identifier: (MIT OR GPL-3.0-only) AND Apache-2.0", (["MIT GPL-3.0-only OR Apache-2.0 AND"], [True], [], True)),
    ("spdx-license-identifier: GPL-2.0-only WITH Classpath-exception-2.0 or mit", (["GPL-2.0-only Classpath-exception-2.0 WITH MIT OR"], [True], [], True)),
    ("SPDX-License-Identifier: MIT AND GPL-3.0-only", (["MIT GPL-3.0-only AND"], [False], [], False)),
    ("SPDX-License-Identifier:\n", (["invalid"], [False], [], False)),
    ("SPDX-License-Identifier: (MIT OR", (["invalid"], [False], [], False)),
    ("All rights reserved.", ([], [], ["LicenseRef-Proprietary"], False)),
    ("small rights reserved", None), ("", None), (None, None),
])
def test_licenses(text, want):
    assert licenses.scan(text) == want


def test_license_query(spark):
    rows = [(1, "SPDX-License-Identifier: MIT"), (1, "SPDX-License-Identifier: MIT"), (None, "Licensed under the MIT License"), (2, None), (3, "none"), (4, "x " * 50_000 + "all rights reserved")]
    assert sorted(str(r["doc_id"]) for r in licenses.licenses(docs(spark, rows)).collect()) == ["1", "1", "4", "None"]
    assert licenses.licenses(docs(spark, [])).count() == 0


def scalar_flac(data):
    """PCM of a stream, one bit at a time: the plain way, to hold the decoder against."""
    at, info = flac.stream_info(data)
    bits = "".join(f"{b:08b}" for b in data[at:])
    p, out = 0, []
    def take(n):
        nonlocal p
        p += n
        return int(bits[p - n : p] or "0", 2)
    def signed(n):
        v = take(n)
        return v - (1 << n) if n and v >> (n - 1) else v
    while p < len(bits):
        h = flac.frame_header(data, at + p // 8, len(data), info)
        p += h[0] * 8
        n, chan, width = h[1], h[3], h[4]
        chans = []
        for c in range(chan + 1 if chan < 8 else 2):
            w = width + (chan in (8, 10) and c == 1) + (chan == 9 and c == 0)
            take(1)
            kind, waste = take(6), 0
            if take(1):
                waste = 1
                while not take(1):
                    waste += 1
            w -= waste
            if kind == 0:
                x = [signed(w)] * n
            elif kind == 1:
                x = [signed(w) for _ in range(n)]
            else:
                o = kind - 8 if kind < 32 else kind - 31
                x, shift = [signed(w) for _ in range(o)], 0
                coef = flac._FIXED[o][:o].tolist() if kind < 32 else None
                if coef is None:
                    prec, shift = take(4) + 1, signed(5)
                    coef = [signed(prec) for _ in range(o)]
                rice, parts = 4 + take(2), take(4)
                for part in range(1 << parts):
                    k = take(rice)
                    for _ in range((n >> parts) - (o if part == 0 else 0)):
                        q = 0
                        while not take(1):
                            q += 1
                        u = q << k | take(k)
                        x.append((u >> 1 ^ -(u & 1)) + (sum(a * b for a, b in zip(coef, reversed(x[-o:] if o else []))) >> shift))
            chans.append([v << waste for v in x])
        if chan == 8:
            chans[1] = [a - b for a, b in zip(*chans)]
        elif chan == 9:
            chans[0] = [a + b for a, b in zip(*chans)]
        elif chan == 10:
            both = [(m * 2 + (s & 1), s) for m, s in zip(*chans)]
            chans = [[(m + s) >> 1 for m, s in both], [(m - s) >> 1 for m, s in both]]
        out += [v for row in zip(*chans) for v in row]
        p = (p + 7) // 8 * 8 + 16
    return out


def signals(bits):
    r, top = np.random.default_rng(bits), 1 << (bits - 1)
    t = np.arange(9000)
    return [r.integers(-top, top, 700), (top * 0.7 * np.sin(t / 20)).astype(int), np.zeros(5000, int), r.integers(-4, 4, 5000) * 4, np.cumsum(r.integers(-1, 2, 6000)).clip(-top, top - 1), np.array([top - 1]), np.zeros(0, int)]


@pytest.mark.parametrize("bits", [8, 12, 16, 20, 24])
def test_flac_round_trip_and_scalar_decoder(bits):
    cases = [(np.asarray(s[: len(s) // c * c], np.int64), c) for s in signals(bits) for c in (1, 2)]
    streams = flac_encode.encode_streams(np.concatenate([s for s, _ in cases]), np.array([len(s) for s, _ in cases]), np.array([c for _, c in cases]), bits)
    cols = flac.decode_column(pa.array(streams, pa.binary()))
    assert not any(cols[8])
    for n, (s, c) in enumerate(cases):
        blocks = [(f, m, p) for r, f, m, p in zip(cols[0], cols[2], cols[3], cols[7]) if r == n]
        assert b"".join(p for *_, p in blocks) == flac.pcm_bytes(s, bits)
        assert [f for f, *_ in blocks] == np.cumsum([0, *[m for _, m, _ in blocks]])[:-1].tolist()
        if n % 3 == 0:
            assert scalar_flac(streams[n]) == s.tolist()


def test_flac_damage_is_found(spark):
    s = np.cumsum(np.random.default_rng(1).integers(-9, 10, 20_000)).astype(np.int64)
    good = flac_encode.encode_streams(s, np.array([len(s)]), np.array([1]))[0]
    bad = bytearray(good)
    bad[len(bad) // 2] ^= 16
    media = spark.createDataFrame([(1, good), (2, bytes(bad)), (3, b"RIFF...."), (4, None), (5, b""), (None, good), (1, good)], "doc_id bigint, media binary").withColumn("pcm", F.lit(1))
    rows = flac.pcm_blocks(media).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert len(by[1]) == 10 and len(by[None]) == 5 and 4 not in by and 5 not in by and by[3][0]["error"] == "not flac"
    two = sorted(by[2], key=lambda r: r["block_no"])
    assert [r["error"] for r in two].count("bad frame") == 1 and [r["first_sample"] for r in two] == [0, 4096, 8192, 12288, 16384]
    assert flac.pcm_blocks(media.limit(0)).count() == 0


def test_crc16_equals_the_plain_one():
    r = np.random.default_rng(2)
    raw = r.integers(0, 256, 3000).astype(np.uint8)
    a, z = np.array([0, 7, 100, 2999, 50]), np.array([3000, 71, 100, 3000, 114])
    def plain(d):
        x = 0
        for b in d:
            x = ((x << 8) & 0xFFFF) ^ flac.CRC16[(x >> 8) ^ b]
        return x
    assert flac.crc16(raw, a, z).tolist() == [plain(raw[i:j].tolist()) for i, j in zip(a, z)]


def test_text_media_edges(spark):
    rows = [(1, "abc"), (2, "abcd"), (3, None), (4, ""), (None, "é"), (1, "abc")]
    got = sorted((str(r["doc_id"]), r["channels"], bytes(r["pcm"])) for r in flac.pcm_blocks(flac_encode.text_media(docs(spark, rows))).collect())
    assert got == [("1", 1, b"abc\0"), ("1", 1, b"abc\0"), ("2", 2, b"abcd"), ("None", 1, "é".encode())]


def test_machine_equals_the_pairwise_sum():
    r = np.random.default_rng(5)
    model = (0.3, r.normal(size=64).astype(np.float32), r.normal(size=(64, 4)).astype(np.float32))
    col, val = r.choice(64, 9, False), r.normal(size=9).astype(np.float32)
    w0, w, v = model
    want = w0 + (w[col] * val).sum() + sum(v[col[i]] @ v[col[j]] * val[i] * val[j] for i in range(9) for j in range(i))
    assert abs(quality.raw_score(model, np.zeros(9, np.int64), col, val, 1)[0] - want) < 1e-4


def test_quality_held_out_and_edges(spark):
    rows = [(i, words(80, i) if i % 2 else " ".join("buy$$ now!!! click### %%%" for _ in range(15)) + words(5, i)) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    d = docs(spark, rows + [(None, None), (200, ""), (201, "z " * 40_000)]).withColumn("score", F.lit("x"))
    out = {r["doc_id"]: r for r in quality.scores(d, labels).collect()}
    assert np.mean([out[i]["keep"] == bool(i % 2) for i in range(60, 120)]) >= 0.95 and len(out) == 123
    kept = quality.accepted(d, labels)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in out.items() if r["keep"]}
    assert all(r["score"] == 0.5 for r in quality.scores(d, labels.limit(0)).collect()) and quality.scores(d.limit(0), labels).count() == 0


def edits(a, b):
    prev = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
        prev = row
    return min(prev)


def test_decontamination_equals_brute_force(spark):
    items = [(k, words(25, 500 + k).capitalize() + ".") for k in range(6)] + [(7, "short"), (8, None), (None, words(20, 1))]
    leak = lambda k, n: (lambda t: "".join(c if j % n else "#" for j, c in enumerate(t)))(items[k][1])
    rows = [(1, words(40, 1) + " " + items[0][1] + " " + words(30, 2)), (2, words(20, 3) + items[1][1].upper().replace(" ", "  ,")), (3, items[2][1][:40] + "zz" + items[2][1][41:]), (4, leak(3, 9)), (5, words(300, 9)), (6, None), (7, ""), (None, items[0][1]), (1, words(40, 1) + " " + items[0][1]), (9, words(20_000, 4) + " " + items[4][1]), (10, "it was Short; yes"), (11, "a shorty"), (12, "short"), (2, words(30, 77))]
    def plain(t):
        return " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    want = set()
    for i, t in rows:
        for k, x in items:
            if i is None or not t or k is None or not x or not plain(x):
                continue
            x, y = plain(x), plain(t)
            if len(x) < decontaminate.MIN_CHARS:
                if f" {x} " in f" {y} ":
                    want.add((i, k))
                continue
            at = sorted({*range(0, max(1, len(x) - 96 + 1), 48), max(0, len(x) - 96)})
            if len(y) < 20_000 and any(edits(x[s : s + 96], y) <= int(0.06 * len(x[s : s + 96])) for s in at) or x in y:
                want.add((i, k))
    b = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    d = docs(spark, rows).withColumn("item_id", F.lit(1))
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(d, b).collect()} == want and (9, 4) in want and (3, 2) in want
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(d, b, slice_chars=300).collect()} == want
    left = decontaminate.without_leaks(d, b)
    assert left.columns == d.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["11", "2", "4", "5", "6", "7", "None"]
    assert [r["text"] for r in decontaminate.without_leaks(d, b, slice_chars=300).filter("doc_id = 2").collect()] == [words(30, 77)]
    assert decontaminate.leaks(d.limit(0), b).count() == 0 and decontaminate.leaks(d, b.limit(0)).count() == 0


def test_curriculum_follows_the_schedule(spark):
    rows = [(i, words(10 + i % 5, i)) for i in range(900)]
    d = docs(spark, rows).withColumn("position", F.lit(-1))
    out = mixing.curriculum(d, {"s0": [1, 0], "s1": [0, 1], "s2": [1, 1]}, (0.0, 1.0)).collect()
    n = {i: len(t.split()) for i, t in rows}
    pos = [r["position"] for r in out]
    assert pos == sorted(pos)
    for lo, hi in ((0, 0.25), (0.5, 0.75), (0.75, 1.0)):
        share = {}
        for r in out:
            if lo <= r["position"] < hi:
                share[r["source"]] = share.get(r["source"], 0) + n[r["doc_id"]]
        mid, total = (lo + hi) / 2, sum(share.values())
        for s, w in (("s0", (1 - mid) / 2), ("s1", mid / 2), ("s2", 0.5)):
            assert abs(share.get(s, 0) / total - w) < 0.03
    assert max(r["epoch"] for r in out) == 1  # s2 is asked for more than there is


def test_curriculum_edges(spark):
    d = docs(spark, [(None, None), (1, ""), (1, ""), (2, "a b")]).withColumn("source", F.when(F.col("doc_id") == 2, "x"))
    assert [r["doc_id"] for r in mixing.curriculum(d).collect()] == [2] and mixing.curriculum(d.limit(0)).count() == 0
    assert mixing.curriculum(d).columns == [*d.columns, "position", "epoch"]


def page(k, nav="<ul><li>Home</li><li>About</li></ul>"):
    return f"<html><head><title>T{k}</title></head><body><nav>{nav}</nav><div class='main'><h1>{words(3, k)}</h1>" + "".join(f"<p>{words(20, k * 7 + j)}</p>" for j in range(1 + k % 4)) + "</div><footer>Same foot</footer></body></html>"


def test_style_tree_removes_what_repeats(spark):
    rows = [(k, f"http://a.example/{k}", page(k)) for k in range(30)] + [(90, None, "<p>lone"), (91, "http://b.example/", None), (92, "http://b.example/", ""), (93, "http://a.example/3", page(3)), (94, "x", "<div>" * 3000 + "deep")]
    d = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("?"))
    out = {r["page_id"]: r["text"] for r in style_tree.extract(d).collect()}
    for k in range(30):
        assert "Same foot" not in out[k] and "Home" not in out[k] and words(3, k) in out[k] and words(20, k * 7) in out[k]
    assert out[90] == "lone" and out[91] is None and out[92] == "" and out[93] == out[3] and out[94] == "deep"
    assert style_tree.extract(d.limit(0)).count() == 0


def test_quotes_are_linked(spark):
    rows = [(1, 0, "user", "First question here.\n\nSecond paragraph."), (1, 1, "assistant", "Another topic."), (1, 2, "user", "On Monday, A wrote:\n> first   QUESTION here.\nMy answer."), (1, 3, "assistant", "> > First question here.\n> My answer.\nDeep."), (1, 2, "user", "On Monday, A wrote:\n> first   QUESTION here.\nMy answer."), (2, 0, None, None), (None, 0, "user", "x"), (3, 0, "user", "> only quote")]
    d = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("hash", F.lit(1))
    links = {(r["turn"], r["depth"], r["origin_turn"], r["kind"]) for r in quotes.links(d).collect()}
    assert links == {(2, 1, 0, 3), (3, 2, 0, 3), (3, 1, 2, 3)}
    out = {r["conv_id"]: r for r in quotes.linked_conversations(d).collect()}
    assert [(m["turn"], m["reply_to"], m["text"]) for m in out[1]["messages"]] == [(0, None, "First question here.\n\nSecond paragraph."), (1, 0, "Another topic."), (2, 0, "My answer."), (3, 2, "Deep.")]
    assert out[2]["messages"][0]["role"] == "unknown" and out[3]["messages"][0]["text"] == "" and quotes.linked_conversations(d.limit(0)).count() == 0


def test_lines_near_the_threshold_in_large_groups(spark):
    """Groups of edited copies, some on either side of the threshold: one line of each component stays."""
    r = random.Random(12)
    rows = []
    for k in range(4):
        base = list(words(30, 700 + k))
        for i in range(30):
            x = list(base)
            for _ in range(r.choice((0, 1, 2, 3, 6))):
                x[r.randrange(len(x))] = r.choice("qrstuvwxyz")
            rows.append("".join(x))
    rows += ["日本語の行です、同じ文字が続きます。" * 2, "日本語の行です、同じ文字が続きます。" * 2 + "終", "ab", "abc", "ab  ", "a" * 50, "a" * 60]
    r.shuffle(rows)
    sets = [line_dedup.shingles(" ".join(x.lower().split())) for x in rows]
    root = list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    out = {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(docs(spark, list(enumerate(rows))).repartition(3)).collect()}
    assert [out[i] for i in range(len(rows))] == [x if find(i) == i else "" for i, x in enumerate(rows)]
