"""Progressive JPEG against a decoder that reads bit by bit, and round trips."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gazette.llm import progressive_jpeg as J

SF = "/root/testdata/sf0.001"


class Bits:
    def __init__(self, data):
        self.data, self.at = data.replace(b"\xff\x00", b"\xff"), 0

    def bit(self):
        self.at += 1
        return self.data[(self.at - 1) >> 3] >> (7 - ((self.at - 1) & 7)) & 1

    def bits(self, n):
        v = 0
        for _ in range(n):
            v = v << 1 | self.bit()
        return v

    def symbol(self, tree):
        code = ""
        while code not in tree:
            code += str(self.bit())
            assert len(code) <= 16
        return tree[code]


def plainly(data):
    """Coefficients by component, read scan by scan, block by block, bit by bit."""
    trees, restart, at, frame = {}, 0, 2, None
    while data[at + 1] != 0xD9:
        kind, size = data[at + 1], data[at + 2] << 8 | data[at + 3]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xC4:
            while body:
                code, left, tree = 0, body[17:], {}
                for n in range(1, 17):
                    for _ in range(body[n]):
                        tree[format(code, f"0{n}b")] = left[0]
                        code, left = code + 1, left[1:]
                    code <<= 1
                trees[body[0]] = tree
                body = left
        elif kind == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif kind == 0xC2:
            _, h, w, n = struct.unpack(">BHHB", body[:6])
            factors = [(body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15) for i in range(n)] if n > 1 else [(1, 1)]
            top = [max(f[i] for f in factors) for i in (0, 1)]
            mcus = (-(-h // (8 * top[1])), -(-w // (8 * top[0])))
            frame = [np.zeros((mcus[0] * v, mcus[1] * x, 64), np.int64) for x, v in factors]
        elif kind == 0xDA:
            n = body[0]
            parts = [body[1 + 2 * i] - 1 for i in range(n)]
            tabs = [body[2 + 2 * i] for i in range(n)]
            first, last, low, refine = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] & 15, body[3 + 2 * n] >> 4
            end = at
            while not (data[end] == 0xFF and data[end + 1] not in (0, *range(0xD0, 0xD8))):
                end += 1
            pieces, begin = [], at
            for i in range(at, end - 1):
                if data[i] == 0xFF and 0xD0 <= data[i + 1] <= 0xD7:
                    assert data[i + 1] == 0xD0 + len(pieces) % 8
                    pieces.append(data[begin:i])
                    begin = i + 2
            pieces.append(data[begin:end])
            at = end
            if n > 1:
                units = [[(c, i, y * factors[c][1] + b, x * factors[c][0] + a) for i, c in enumerate(parts) for b in range(factors[c][1]) for a in range(factors[c][0])] for y in range(mcus[0]) for x in range(mcus[1])]
            else:
                x_, v_ = factors[parts[0]]
                rows, cols = -(-(-(-h * v_ // top[1])) // 8), -(-(-(-w * x_ // top[0])) // 8)
                units = [[(parts[0], 0, y, x)] for y in range(rows) for x in range(cols)]
            step = restart or len(units)
            for k, piece in enumerate(pieces):
                b, pred, eob = Bits(piece), {}, 0
                for c, i, y, x in [u for unit in units[k * step : (k + 1) * step] for u in unit]:
                    block = frame[c][y, x]
                    if not first:
                        if refine:
                            block[0] |= b.bit() << low
                        else:
                            s = b.symbol(trees[tabs[i] >> 4])
                            v = b.bits(s)
                            pred[c] = pred.get(c, 0) + (v if not s or v >> (s - 1) else v - (1 << s) + 1)
                            block[0] = pred[c] << low
                        continue
                    tree, k_ = trees[tabs[i] & 15 | 16], first

                    def correct(j, block=block, b=b):
                        if b.bit():
                            block[j] += (1 << low) if block[j] > 0 else -(1 << low)

                    while k_ <= last and not eob:
                        s = b.symbol(tree)
                        r, s = s >> 4, s & 15
                        if not s and r < 15:
                            eob = (1 << r) + b.bits(r)
                            break
                        if not refine:
                            k_ += r
                            if s:
                                v = b.bits(s)
                                block[k_] = (v if v >> (s - 1) else v - (1 << s) + 1) << low
                            k_ += 1
                            continue
                        new = (1 if b.bit() else -1) << low if s else 0
                        while True:
                            if block[k_]:
                                correct(k_)
                            elif r:
                                r -= 1
                            else:
                                block[k_] = new
                                break
                            k_ += 1
                        k_ += 1
                    if eob:
                        if refine:
                            for j in range(k_, last + 1):
                                if block[j]:
                                    correct(j)
                        eob -= 1
        if kind != 0xDA and data[at] != 0xFF:
            raise AssertionError
    return frame


def store_of(rng, size, sampling, kind):
    n = J.geometry(*size, sampling)[1]
    if kind == "sparse":  # long runs of zeros, blocks without anything, last bits alone
        s = np.where(rng.random((n, 64)) < 0.04, rng.integers(-3, 4, (n, 64)), 0) * (rng.random((n, 1)) < 0.4)
    elif kind == "ones":
        s = rng.integers(-1, 2, (n, 64)) * (rng.random((n, 64)) < 0.1)
    else:
        s = (rng.standard_normal((n, 64)) * 300 / (1 + np.arange(64))).round().clip(-1023, 1023)
    return s.astype(np.int16)


GREY, FULL, WIDE = ((1, 1),), ((1, 1),) * 3, ((2, 1), (1, 1), (1, 1))
SCRIPTS = {
    3: (J.SCRIPT, (((0, 1, 2), 0, 0, 0, 2), ((1,), 1, 63, 0, 2), ((0, 2), 0, 0, 2, 1), ((0,), 1, 5, 0, 2), ((0,), 6, 63, 0, 2), ((2,), 1, 63, 0, 0), ((0,), 1, 63, 2, 1), ((1,), 1, 63, 2, 1), ((1,), 0, 0, 2, 1), ((0, 1, 2), 0, 0, 1, 0), ((1,), 1, 63, 1, 0), ((0,), 1, 63, 1, 0))),
    1: ((((0,), 0, 0, 0, 1), ((0,), 1, 63, 0, 3), ((0,), 1, 63, 3, 2), ((0,), 0, 0, 1, 0), ((0,), 1, 63, 2, 1), ((0,), 1, 63, 1, 0)),),
}


@pytest.mark.parametrize("sampling", [J.PLAIN, FULL, WIDE, GREY])
def test_scans_against_plain_reading(sampling):
    """Files of several sizes and restart intervals in one batch give what went in, and what the plain reader gives."""
    rng = np.random.default_rng(4)
    for script in SCRIPTS[len(sampling)]:
        for restart in (1, 3, 32767):
            sizes = [(1, 1), (16, 16), (23, 50), (90, 33), (8, 200)]
            stores = [store_of(rng, size, sampling, kind) for size, kind in zip(sizes, ["sparse", "ones", "sparse", "full", "ones"])]
            files = J.encode(stores, sizes, sampling, script, restart)
            for size, store, data, got in zip(sizes, stores, files, J.decode(files)):
                planes, _, alone = J.geometry(*size, sampling)
                frame = plainly(data)
                for (first, rows, columns), (used, across), plane in zip(planes, alone, frame):
                    mine = got["coefs"][first : first + rows * columns].reshape(rows, columns, 64)
                    assert (mine == plane).all()
                    # what lies beyond the edge is in DC scans of several components alone
                    assert (mine[:used, :across] == store[first : first + rows * columns].reshape(rows, columns, 64)[:used, :across]).all()


def test_small_chunks_write_the_same(monkeypatch):
    rng = np.random.default_rng(5)
    size = (160, 160)
    store = store_of(rng, size, J.PLAIN, "sparse")
    whole = J.encode([store], [size], restart=4)
    monkeypatch.setattr(J, "BLOCKS_AT_ONCE", 30)
    assert J.encode([store], [size], restart=4) == whole


def test_colours():
    """The inverse transform by its definition; chroma repeated; one component grey; a flat image in its colour."""
    rng = np.random.default_rng(6)
    store = store_of(rng, (8, 8), GREY, "full")
    quant = rng.integers(1, 4, 64)
    image = J.decode(J.encode([store], [(8, 8)], GREY, SCRIPTS[1][0], quant=quant))[0]
    assert (image["quant"][0] == quant).all()
    f = np.zeros(64)
    f[J.ZIGZAG] = store[0] * quant
    f = f.reshape(8, 8)
    want = np.array([[sum((0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) / 4 * f[v, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) for x in range(8)] for y in range(8)])
    got = J.to_rgb(image)
    assert got.shape == (8, 8, 3) and (np.abs(got[..., 0] - np.clip(want + 128, 0, 255)) <= 0.51).all() and (got[..., 0] == got[..., 2]).all()
    store = np.zeros((J.geometry(40, 30, J.PLAIN)[1], 64), np.int16)
    (y, *_), (cb, *_), (cr, rows, columns) = J.geometry(40, 30, J.PLAIN)[0]
    store[y:cb, 0], store[cr:, 0] = 8 * (76 - 128), 8 * (255 - 128)
    store[cb:cr, 0] = 8 * (85 - 128)
    rgb = J.to_rgb(J.decode(J.encode([store], [(40, 30)]))[0])
    assert rgb.shape == (40, 30, 3) and (np.abs(rgb.astype(int) - [254, 0, 0]) <= 1).all()
    store[cr, 0] = 0  # one chroma block stands for 16 x 16 pixels
    half = J.to_rgb(J.decode(J.encode([store], [(40, 30)]))[0])
    changed = (half != rgb).any(2)
    assert changed[:16, :16].all() and changed.sum() == 256


def test_bad_files_harm_no_other():
    rng = random.Random(1)
    good = J.store_payloads([bytes(rng.randrange(256) for _ in range(64 * 40))])[0]
    whole = J.decode([good])[0]
    files = [b"", b"no jpeg", good[: len(good) // 2], good.replace(b"\xff\xc2", b"\xff\xc0"), good[:200], b"\xff\xd8\xff\xd9"]
    for _ in range(60):
        data = bytearray(good)
        for _ in range(3):
            data[rng.randrange(len(data))] = rng.randrange(256)
        files.append(bytes(data))
    got = J.decode([good, *files, good])
    assert got[1:7] == [None] * 6 and all((got[i]["coefs"] == whole["coefs"]).all() for i in (0, -1))


def test_payload_round_trip():
    rng = random.Random(2)
    texts = [b"", b"a", bytes(range(256)) * 3, b"\0" * 1000, b"\1\2" * 500, b"\0" * 40 + b"\1" + b"\0" * 60 + b"\2", "häßlich naïve 漢字 ".encode() * 900] + [bytes(rng.randrange(256) for _ in range(rng.randrange(5000))) for _ in range(20)]
    payloads = [J.padded(t) for t in texts]
    assert all(len(p) % 64 == 0 and len(p) >= 64 for p in payloads)
    files = J.store_payloads(payloads)
    assert [J.read_payload(x) for x in J.decode(files)] == payloads
    assert J.store_payloads(payloads[3:5]) == files[3:5]  # a file does not depend on its batch


def test_columns_and_odd_rows(spark):
    long = "word and more " * 100_000
    rows = [(None, "no id"), (1, None), (2, ""), (3, " \n"), (4, "same"), (4, "same"), (5, long), (6, "é" * 77)]
    docs = spark.createDataFrame([(i, t, b"x", 3) for i, t in rows], "doc_id long, text string, media binary, Height int")
    got = J.media_features(J.text_media(docs)).collect()
    assert sorted((str(r.doc_id), r.n_bytes) for r in got) == sorted((str(i), len((t or "").encode())) for i, t in rows)
    for r in got:
        payload = J.padded(next((t or "").encode() for i, t in rows if i == r.doc_id))
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    same = [tuple(r)[2:] for r in got if r.doc_id in (1, 2)] + [tuple(r)[1:] for r in got if r.doc_id == 4]
    assert same[0] == same[1] and same[2] == same[3]
    assert J.media_features(J.text_media(docs.limit(0))).count() == 0
    tensors = J.rgb_tensors(J.text_media(docs).unionByName(docs.select("doc_id", docs["doc_id"].alias("n_bytes"), "media")).withColumn("Height", F.lit(0))).collect()
    assert {(r.height is None) == (r.rgb is None) for r in tensors} == {True} and sum(r.rgb is None for r in tensors) == len(rows) and all(len(r.rgb) == 3 * r.height * r.width for r in tensors if r.rgb)


def test_query_on_whole_table(spark):
    """Every value of the query from single files: written and read alone, by the plain reader."""
    got = {r.doc_id: r for r in J.op11_progressive_jpeg(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        r, payload = got[d.doc_id], J.padded((d.text or "").encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((d.text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    for d in sorted(docs, key=lambda d: len(d.text or ""))[:40]:
        data = J.store_payloads([J.padded((d.text or "").encode())])[0]
        frame, r = plainly(data), got[d.doc_id]
        assert (r.media_bytes, r.media_sha256) == (len(data), hashlib.sha256(data).hexdigest())
        image = J.decode([data])[0]
        assert (np.concatenate([p.reshape(-1, 64) for p in frame]) == image["coefs"]).all()
        rgb = J.to_rgb(image)
        sums = ":".join(str(int(rgb[..., c].sum(dtype=np.int64))) for c in range(3))
        assert r.feature.startswith(f"{rgb.shape[1]}x{rgb.shape[0]}:{sums}:") and r.feature.endswith(f"{zlib.crc32(rgb.tobytes()):08x}")
