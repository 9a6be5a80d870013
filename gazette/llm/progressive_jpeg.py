"""Progressive JPEG columns: scans are added up into coefficient arrays, turned back by an exact inverse transform, chroma is upsampled, and RGB tensors come out.

All images of a batch are decoded together. A scan's entropy-coded segments (a restart interval each) know nothing of one another, so they are
lanes that numpy moves on in step: one symbol of every lane at a time. Scans of an image that meet in their coefficients wait for one another.
The writer makes such files from coefficients, also for whole batches, so that bytes can be stored losslessly, one byte to a coefficient.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm.common import materialize, table

SQL: dict[str, str] = {}
#: Bytes of payload or media that are worked together, and blocks that the writer holds at once.
BYTES_AT_ONCE, BLOCKS_AT_ONCE = 4_000_000, 32_768
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_SIZE = np.zeros(1 << 16, np.uint8)  # bits of a magnitude
for _i in range(16):
    _SIZE[1 << _i :] = _i + 1


class NotDecodable(ValueError):
    """Not a progressive JPEG of eight bits that this module reads."""


# ---- Huffman tables ----


def canonical(lengths: dict[int, int]) -> tuple[bytes, bytes]:
    """The counts of codes by length, 1 to 16, and the symbols in the order of their codes."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    return bytes(sum(n == k for n in lengths.values()) for k in range(1, 17)), bytes(order)


def codes(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code and length by symbol (length 0: no code)."""
    code, at, out, length = 0, 0, np.zeros(256, np.int32), np.zeros(256, np.int32)
    for k, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            out[s], length[s] = code, k
            code += 1
        at += n
        code <<= 1
    return out, length


@lru_cache(maxsize=64)
def lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For the next 16 bits: the length of the code that they begin with, and its symbol above eight bits; 0 where none does."""
    out = np.zeros(1 << 16, np.int64)
    code, length = codes(counts, symbols)
    for s in symbols:
        n = int(length[s])
        first = int(code[s]) << (16 - n)
        if first >> 16:
            raise NotDecodable("a Huffman table with too many codes")
        out[first : first + (1 << (16 - n))] = n | s << 8
    return out


# Lengths by rule: equal for DC sizes; AC sizes without a run are short, as the writer's frequent values are small; in refinement the end of a block is.
DC_TABLE = canonical({s: 4 for s in range(12)})
AC_TABLE = canonical({r << 4 | s: 14 for r in range(16) for s in range(11)} | {1: 1, 2: 2, 3: 3, 4: 5, 0: 6, 5: 6, 6: 7, 7: 8})
REFINE_TABLE = canonical({r << 4 | s: 6 for r in range(16) for s in range(2)} | {0: 1})


# ---- where the blocks of a scan lie ----


@lru_cache(maxsize=4096)
def geometry(height: int, width: int, sampling: tuple[tuple[int, int], ...]) -> tuple[list[tuple[int, int, int]], int, list[tuple[int, int]]]:
    """By component (first block, rows, columns) of a store of whole MCUs; its number of blocks; and the (rows, columns) that a scan of the component alone has."""
    top_h, top_v = max(h for h, _ in sampling), max(v for _, v in sampling)
    across, down = -(-width // (8 * top_h)), -(-height // (8 * top_v))
    planes, total, alone = [], 0, []
    for h, v in sampling:
        planes.append((total, down * v, across * h))
        total += down * v * across * h
        alone.append((-(-(-(-height * v // top_v)) // 8), -(-(-(-width * h // top_h)) // 8)))
    return planes, total, alone


@lru_cache(maxsize=1024)
def scan_blocks(height: int, width: int, sampling: tuple[tuple[int, int], ...], members: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    """The blocks of a scan in its order, the component of each (its place among members), and how many make an MCU."""
    planes, _, alone = geometry(height, width, sampling)
    if len(members) == 1:
        first, _, columns = planes[members[0]]
        rows, used = alone[members[0]]
        at = (first + np.arange(rows)[:, None] * columns + np.arange(used)).ravel()
        return at, np.zeros(len(at), np.int64), 1
    parts, kinds = [], []
    for place, c in enumerate(members):
        (first, rows, columns), (h, v) = planes[c], sampling[c]
        grid = (first + np.arange(rows * columns)).reshape(rows // v, v, columns // h, h).transpose(0, 2, 1, 3).reshape(-1, v * h)
        parts.append(grid)
        kinds += [place] * (v * h)
    blocks = np.concatenate(parts, 1)
    return blocks.ravel(), np.tile(np.array(kinds), len(blocks)), blocks.shape[1]


# ---- writing ----

PLAIN = ((2, 2), (1, 1), (1, 1))
#: (components, first and last coefficient, earlier and present low bit): all DC, the AC bands of each component, then their last bits.
SCRIPT = (((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 20, 0, 1), ((0,), 21, 63, 0, 1), ((1,), 1, 63, 0, 1), ((2,), 1, 63, 0, 1), ((0, 1, 2), 0, 0, 1, 0), ((0,), 1, 63, 1, 0), ((1,), 1, 63, 1, 0), ((2,), 1, 63, 1, 0))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _packed(value: np.ndarray, length: np.ndarray, tokens: np.ndarray, number: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of segments as bytes with stuffing, restart marks between segments of a scan, and where each segment ends.

    tokens: how many tokens a segment has; number: its place in its scan; last: it ends its scan.
    """
    ends = np.cumsum(length, dtype=np.int64)
    upto = np.r_[0, np.cumsum(tokens)]
    bits = np.diff(np.r_[0, ends][upto])
    pad = -bits % 8
    starts = np.r_[0, np.cumsum(bits + pad)]
    at = ends - length + np.repeat(starts[:-1] - (np.cumsum(bits) - bits), tokens)
    value, length, at = np.r_[value, (1 << pad) - 1], np.r_[length, pad], np.r_[at, starts[:-1] + bits]  # ones fill the last byte
    word, room = at >> 5, 64 - (at & 31) - length
    wide = value.astype(np.uint64) << (room & 63).astype(np.uint64)
    n = int(starts[-1] // 32) + 2
    # a sum is as good as an or: no two tokens share a bit, and sums below 2^53 are exact
    total = np.bincount(word, (wide >> np.uint64(32)).astype(np.float64), n)
    total[1:] += np.bincount(word, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), n)[:-1]
    raw = total.astype(np.uint32).astype(">u4").view(np.uint8)[: starts[-1] // 8]
    full = raw == 0xFF
    size = np.diff(starts) // 8
    marks = np.where(last, 0, 2)
    moved = np.arange(len(raw)) + np.cumsum(full) - full + np.repeat(np.cumsum(marks) - marks, size)
    stuffed = np.diff(np.r_[0, np.cumsum(full)][starts // 8])
    stop = np.cumsum(size + stuffed + marks)
    out = np.zeros(int(stop[-1]), np.uint8)
    out[moved] = raw
    more = np.flatnonzero(~last)
    out[stop[more] - 2] = 0xFF
    out[stop[more] - 1] = 0xD0 + number[more] % 8
    return out, stop


def _magnitude(c: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(c < 0, c + (1 << size) - 1, c)


def _dc_tokens(coefs, blocks, kinds, per_mcu, new, low, refine):
    dc = coefs[blocks, 0].astype(np.int64) >> low
    if refine:
        return (dc & 1)[:, None], np.ones((len(dc), 1), np.int64)
    code, length = codes(*DC_TABLE)
    diff, row = np.empty(len(dc), np.int64), kinds.reshape(-1, per_mcu)[0]
    for kind in np.unique(row):  # predictions run through a component's blocks and begin anew with a segment
        mine = dc.reshape(-1, per_mcu)[:, row == kind]
        prior = np.r_[0, mine.ravel()[:-1]].reshape(mine.shape)
        prior[new.reshape(-1, per_mcu)[:, 0], 0] = 0
        diff.reshape(-1, per_mcu)[:, row == kind] = mine - prior
    size = _SIZE[np.abs(diff)].astype(np.int64)
    return (code[size] << size | _magnitude(diff, size))[:, None], (length[size] + size)[:, None]


def _end_of_blocks(tail, empty, new, code, length):
    """Where an end of blocks is told, and its bits: blocks with a tail, and after them those with nothing, are told together."""
    again = tail & empty & ~new & np.r_[False, tail[:-1]]
    begin = np.flatnonzero(tail & ~again)
    count = np.bincount(np.cumsum(tail & ~again)[tail] - 1, minlength=len(begin))
    size = _SIZE[count].astype(np.int64) - 1
    return begin, code[size << 4] << size | (count - (1 << size)), length[size << 4] + size


def _ac_tokens(coefs, blocks, first, last, low, refine, new):
    own = coefs[blocks, first : last + 1].astype(np.int32)
    n, width = own.shape
    place = np.arange(width, dtype=np.int32)
    mag = np.abs(own) >> low
    if not refine:
        code, length = codes(*AC_TABLE)
        hit = mag > 0
        upto = np.maximum.accumulate(np.where(hit, place, np.int32(-1)), 1)
        run = place - np.c_[np.full(n, -1, np.int32), upto[:, :-1]] - 1
        size = _SIZE[mag].astype(np.int32)
        symbol = np.where(hit, (run & 15) << 4 | size, 0)
        value, bits = np.zeros((n, width + 1), np.int32), np.zeros((n, width + 1), np.int32)
        value[:, :-1] = np.where(hit, code[symbol] << size | _magnitude(np.where(own < 0, -mag, mag), size), 0)
        bits[:, :-1] = np.where(hit, length[symbol] + size, 0)
        end = upto[:, -1]
        full = ~hit & (place < end[:, None]) & ((place - upto) % 16 == 0)  # every sixteenth zero of a run
        value[:, :-1][full], bits[:, :-1][full] = code[0xF0], length[0xF0]
        at, v, m = _end_of_blocks(end < width - 1, end < 0, new, code, length)
        value[at, -1], bits[at, -1] = v, m
        return value, bits
    code, length = codes(*REFINE_TABLE)
    held, fresh = mag > 1, mag == 1
    value, bits = np.zeros((n, width, 2), np.int32), np.zeros((n, width, 2), np.int32)
    value[:, :, 1], bits[:, :, 1] = np.where(held, mag & 1, 0), held
    zeros = np.cumsum(~held, 1, dtype=np.int32)
    since = np.maximum.accumulate(np.where(fresh, zeros, 0), 1)
    run = zeros - np.c_[np.zeros(n, np.int64), since[:, :-1]] - 1  # zeros before this one, since a fresh one
    final = np.maximum.accumulate(np.where(fresh, place, -1), 1)[:, -1]
    full = ~held & ~fresh & (run % 16 == 15) & (place < final[:, None])
    event = fresh | full
    upto = np.maximum.accumulate(np.where(event, place, np.int32(-1)), 1)
    row, col = np.nonzero(event)
    slot = np.c_[np.full(n, -1, np.int32), upto[:, :-1]][row, col] + 1  # told where the event before it ended
    was = fresh[row, col]
    symbol = np.where(was, (run[row, col] & 15) << 4 | 1, 0xF0)
    value[row, slot, 0] = np.where(was, code[symbol] << 1 | (own[row, col] > 0), code[symbol])
    bits[row, slot, 0] = length[symbol] + was
    end = upto[:, -1]
    at, v, m = _end_of_blocks(end < width - 1, end < 0, new, code, length)
    value[at, end[at] + 1, 0], bits[at, end[at] + 1, 0] = v, m
    return value.reshape(n, -1), bits.reshape(n, -1)


def encode(stores: list[np.ndarray], sizes: list[tuple[int, int]], sampling=PLAIN, script=SCRIPT, restart: int = 16, quant: np.ndarray | None = None, notes: list[bytes] | None = None) -> list[bytes]:
    """Progressive JPEG files of coefficient stores: blocks as geometry() has them, coefficients in zigzag order, -1023 to 1023. sizes: (height, width); restart: MCUs to a segment, at most 32767."""
    if not 0 < restart < 1 << 15:
        raise ValueError("1 to 32767 MCUs to a segment")
    coefs = np.concatenate(stores)
    base = np.r_[0, np.cumsum([len(s) for s in stores])]
    bodies: list[list[bytes]] = [[] for _ in stores]

    @lru_cache
    def laid(members: tuple[int, ...]) -> tuple:
        """The blocks of a scan over all images, the segments of each image, and where segments begin."""
        parts = [scan_blocks(h, w, sampling, members) for h, w in sizes]
        per = parts[0][2]
        count = np.array([len(p[0]) for p in parts])
        blocks = np.concatenate([p[0] for p in parts]) + np.repeat(base[:-1], count)
        mcus = count // per
        segments = -(-mcus // restart)
        upto = np.r_[0, np.cumsum(segments)]
        number = np.arange(upto[-1]) - np.repeat(upto[:-1], segments)
        image = np.repeat(np.arange(len(stores)), segments)
        held = np.minimum(restart, mcus[image] - number * restart) * per  # blocks of a segment
        return per, blocks, np.concatenate([p[1] for p in parts]), segments, upto, number, image, held, np.r_[0, np.cumsum(held)]

    for members, first, last, high, low in script:
        per, blocks, kinds, segments, upto, number, image, held, start = laid(members)
        pieces, stops, s = [], [], 0
        while s < len(held):
            e = max(s + 1, int(np.searchsorted(start, start[s] + BLOCKS_AT_ONCE, "right")) - 1)
            mine = slice(start[s], start[e])
            new = np.zeros(start[e] - start[s], bool)
            new[start[s:e] - start[s]] = True
            value, bits = _dc_tokens(coefs, blocks[mine], kinds[mine], per, new, low, high > 0) if first == 0 else _ac_tokens(coefs, blocks[mine], first, last, low, high > 0, new)
            there = bits > 0
            tokens = np.add.reduceat(there.sum(1), start[s:e] - start[s])
            out, stop = _packed(value[there], bits[there], tokens, number[s:e], number[s:e] + 1 == segments[image[s:e]])
            pieces.append(out.tobytes())
            stops.append(stop + (stops[-1][-1] if stops else 0))
            s = e
        body, stop = b"".join(pieces), np.concatenate(stops)[upto[1:] - 1].tolist()
        table_ = 1 if first and high else 0
        head = _segment(0xDA, bytes([len(members), *[x for c in members for x in (c + 1, table_)], first, last, high << 4 | low]))
        for i, (a, b) in enumerate(zip([0, *stop], stop)):
            bodies[i] += [head, body[a:b]]
    tables = b"".join(bytes([kind]) + counts + symbols for kind, (counts, symbols) in ((0x00, DC_TABLE), (0x10, AC_TABLE), (0x11, REFINE_TABLE)))
    common = _segment(0xDB, b"\0" + bytes(np.ones(64, np.uint8) if quant is None else quant.astype(np.uint8))) + _segment(0xC4, tables) + _segment(0xDD, struct.pack(">H", restart))
    out = []
    for i, (h, w) in enumerate(sizes):
        frame = _segment(0xC2, struct.pack(">BHHB", 8, h, w, len(sampling)) + b"".join(bytes([c + 1, x << 4 | y, 0]) for c, (x, y) in enumerate(sampling)))
        out.append(b"".join([b"\xff\xd8", _segment(0xFE, notes[i]) if notes else b"", common, frame, *bodies[i], b"\xff\xd9"]))
    return out


# ---- reading ----


# What markers say is kept by their bytes: files of one writer repeat them.


@lru_cache(maxsize=256)
def _quants(body: bytes) -> dict[int, np.ndarray]:
    out = {}
    while body:
        wide = body[0] >> 4
        out[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
        body = body[65 + 64 * wide :]
    return out


@lru_cache(maxsize=256)
def _tables(body: bytes) -> dict[int, tuple[bytes, bytes]]:
    out = {}
    while body:
        n = sum(body[1:17])
        out[body[0]] = (body[1:17], body[17 : 17 + n])
        lookup(*out[body[0]])
        body = body[17 + n :]
    return out


@lru_cache(maxsize=1024)
def _frame(body: bytes) -> dict:
    depth, h, w, n = struct.unpack(">BHHB", body[:6])
    parts = [body[6 + 3 * i : 9 + 3 * i] for i in range(n)]
    if depth != 8 or not h or not w or n not in (1, 3) or any(not p[1] >> 4 or not p[1] & 15 for p in parts):
        raise NotDecodable("a frame of another kind")
    # one component is never interleaved: its factors mean nothing
    return {"height": h, "width": w, "ids": tuple(p[0] for p in parts), "sampling": tuple((p[1] >> 4, p[1] & 15) for p in parts) if n > 1 else ((1, 1),), "tq": [p[2] for p in parts]}


@lru_cache(maxsize=1024)
def _scan(body: bytes, ids: tuple[int, ...]) -> tuple[dict, list[int]]:
    """A scan as far as its header tells, and the tables that it needs."""
    n = body[0]
    members = tuple(ids.index(body[1 + 2 * i]) if body[1 + 2 * i] in ids else -1 for i in range(n))
    first, last, bits = body[1 + 2 * n : 4 + 2 * n]
    if -1 in members or not n or first > last or last > 63 or first and n > 1 or not first and last or bits >> 4 and bits >> 4 != (bits & 15) + 1:
        raise NotDecodable("a scan of no progressive kind")
    need = [] if not first and bits >> 4 else [body[2 + 2 * i] & 15 | 16 for i in range(n)] if first else [body[2 + 2 * i] >> 4 for i in range(n)]
    return {"members": members, "first": first, "last": last, "refine": bits >> 4 > 0, "low": bits & 15}, need


def _parsed(data: bytes, marks: list[int], offset: int) -> dict:
    """What the markers of one file say. marks: places of markers in the batch that aren't restarts; offset: where the file begins in it."""
    out: dict = {"scans": [], "notes": []}
    quant: dict[int, np.ndarray] = {}
    tables: dict[int, tuple[bytes, bytes]] = {}
    restart, at = 0, 2
    if data[:2] != b"\xff\xd8":
        raise NotDecodable("no JPEG")
    while True:
        while at + 1 < len(data) and data[at] == 0xFF and data[at + 1] == 0xFF:
            at += 1
        if at + 4 > len(data) or data[at] != 0xFF:
            if out["scans"] and data[at : at + 2] == b"\xff\xd9":
                break
            raise NotDecodable("a marker is missing")
        kind = data[at + 1]
        if kind == 0xD9:
            break
        size = data[at + 2] << 8 | data[at + 3]
        body = data[at + 4 : at + 2 + size]
        if len(body) != size - 2:
            raise NotDecodable("a marker is cut")
        at += 2 + size
        if kind == 0xDB:
            quant |= _quants(body)
        elif kind == 0xC4:
            tables |= _tables(body)
        elif kind == 0xC2:
            out |= _frame(body)
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            raise NotDecodable("not progressive")
        elif kind == 0xDD:
            restart = body[0] << 8 | body[1]
        elif kind == 0xFE:
            out["notes"].append(body)
        elif kind == 0xDA:
            if "ids" not in out:
                raise NotDecodable("a scan without a frame")
            about, need = _scan(body, out["ids"])
            if any(t not in tables for t in need):
                raise NotDecodable("a table is missing")
            k = bisect_left(marks, offset + at)
            end = marks[k] - offset if k < len(marks) else len(data)
            out["scans"].append(about | {"tables": tuple(tables[t] for t in need), "restart": restart, "from": at, "to": min(end, len(data))})
            at = min(end, len(data))
    if not out["scans"] or any(t not in quant for t in out["tq"]):
        raise NotDecodable("no scan, or no quantisation")
    out["quant"] = [quant[t] for t in out["tq"]]
    if any(len(q) != 64 for q in out["quant"]):
        raise NotDecodable("a quantisation table is cut")
    return out


@lru_cache(maxsize=1024)
def _waves(scans: tuple[tuple[tuple[int, ...], int, int], ...]) -> list[int]:
    """When each scan (components, first, last) is decoded: after the earlier ones that it shares coefficients with."""
    out: list[int] = []
    for i, (members, first, last) in enumerate(scans):
        out.append(1 + max((out[j] for j, (m, f, t) in enumerate(scans[:i]) if set(m) & set(members) and f <= last and first <= t), default=-1))
    return out


class _Lanes:
    """Segments that are decoded in step: where their bits are, which blocks they hold, and what went wrong."""

    def __init__(self, win, stuffing, coefs, blocks, rows, bad):
        cols = list(np.array(rows, np.int64).T.copy())
        cols[:2] = [(c - np.searchsorted(stuffing, c)) * 8 for c in cols[:2]]  # bits without stuffing
        self.win, self.coefs, self.blocks, self.bad = win, coefs, blocks, bad
        self.pos, self.end, self.at, self.stop, self.image, self.first, self.last, self.low, self.table = cols

    def keep(self, k):
        for name in ("pos", "end", "at", "stop", "image", "first", "last", "low", "table"):
            setattr(self, name, getattr(self, name)[k])

    def peek(self):
        """The next bits, 40 of them less up to seven, and how many of those are over."""
        return self.win[self.pos >> 3], self.pos & 7

    def wrong(self, which):
        """Segments in which the bits are no valid code, or end."""
        which = which | (self.pos > self.end)
        if which.any():
            self.bad[self.image[which]] = True
            self.at[which] = self.stop[which]


def _dc_first(lanes: _Lanes, kinds, luts):
    pred = np.zeros((len(lanes.pos), 4), np.int64)
    while len(lanes.pos):
        w, over = lanes.peek()
        kind = kinds[lanes.at]
        e = luts[lanes.table + kind, (w >> (24 - over)) & 0xFFFF]
        n, s = e & 31, e >> 8
        lanes.wrong((n == 0) | (s > 11))
        s = np.minimum(s, 11)
        v = (w >> (40 - over - n - s)) & ((1 << s) - 1)
        diff = np.where(v < (1 << s >> 1), v - (1 << s) + 1, v)
        row = np.arange(len(pred))
        pred[row, kind] += diff
        go = lanes.at < lanes.stop
        lanes.coefs[lanes.blocks[lanes.at[go]], 0] = (pred[row, kind] << lanes.low)[go]
        lanes.pos += n + s
        lanes.wrong(np.zeros(len(go), bool))
        lanes.at += 1
        go = lanes.at < lanes.stop
        if not go.all():
            lanes.keep(go)
            pred = pred[go]


def _dc_refine(lanes: _Lanes):
    n = lanes.stop - lanes.at
    short = lanes.pos + n > lanes.end
    lanes.bad[lanes.image[short]] = True
    lanes.keep(~short)
    n = lanes.stop - lanes.at
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    pos = np.repeat(lanes.pos, n) + step
    bit = (lanes.win[pos >> 3] >> (39 - (pos & 7))) & 1
    lanes.coefs[lanes.blocks[np.repeat(lanes.at, n) + step], 0] |= (bit << np.repeat(lanes.low, n)).astype(np.int16)


def _ac_first(lanes: _Lanes, luts):
    flat, k, luts = lanes.coefs.reshape(-1), lanes.first.copy(), luts.reshape(-1)
    base, row = lanes.blocks[lanes.at] * 64, lanes.table << 16
    while len(k):
        w, over = lanes.peek()
        e = luts[row + ((w >> (24 - over)) & 0xFFFF)]
        n, s = e & 31, (e >> 8) & 15
        k += e >> 12
        plain = (s > 0) & (k <= lanes.last)
        v = (w >> (40 - over - n - s)) & ((1 << s) - 1)
        v -= np.where(v < (1 << s >> 1), (1 << s) - 1, 0)
        lanes.pos += n + s
        if plain.all():
            flat[base + k] = v << lanes.low
            k += 1
            done = k > lanes.last
        else:
            flat[(base + k)[plain]] = (v << lanes.low)[plain]
            k += 1
            r = e >> 12
            ends = (s == 0) & (r < 15) & (n > 0)
            lanes.wrong((n == 0) | (k - 1 > lanes.last) & ~ends)
            r = np.where(ends, r, 0)
            more = (1 << r) + ((w >> (40 - over - n - r)) & ((1 << r) - 1))
            lanes.pos += r
            lanes.at += np.where(ends, more - 1, 0)  # and one below
            done = ends | (k > lanes.last)
        if done.any():
            lanes.wrong(np.zeros(len(k), bool))
            lanes.at[done] += 1
            k[done] = lanes.first[done]
            go = lanes.at < lanes.stop
            if not go.all():
                lanes.keep(go)
                k, base, row, done = k[go], base[go], row[go], done[go]
            base[done] = lanes.blocks[lanes.at[done]] * 64


def _ac_refine(lanes: _Lanes, luts):
    flat = lanes.coefs.reshape(-1)
    k, blocks_left = lanes.first.copy(), np.zeros(len(lanes.pos), np.int64)  # of an end of blocks that was told
    while len(k):
        low, high = int(lanes.first.min()), int(lanes.last.max())
        col = np.arange(low, high + 1, dtype=np.int16)
        w, over = lanes.peek()
        asks = blocks_left == 0
        e = np.where(asks, luts[lanes.table, (w >> (24 - over)) & 0xFFFF], 0)
        n, s, r = e & 31, (e >> 8) & 15, e >> 12
        lanes.wrong(asks & ((n == 0) | (s > 1)))
        ends = asks & (s == 0) & (r < 15)
        x = np.where(ends, r, 0)
        blocks_left += np.where(ends, (1 << x) + ((w >> (40 - over - n - x)) & ((1 << x) - 1)), 0)
        fresh = asks & (s == 1)
        sign = (w >> (39 - over - n)) & 1
        lanes.pos += n + x + fresh
        at = (lanes.blocks[np.minimum(lanes.at, len(lanes.blocks) - 1)] * 64)[:, None] + col
        val = flat[at]
        open_ = (col >= k[:, None]) & (col <= lanes.last[:, None])
        held = (val != 0) & open_
        whole = blocks_left > 0
        zero = np.cumsum(open_ & ~held, 1, dtype=np.int16)
        hit = (zero == (r + 1).astype(np.int16)[:, None]) & open_ & ~whole[:, None]
        found = hit.any(1)
        stop = np.where(found, low + hit.argmax(1), lanes.last + 1)
        held &= col < stop[:, None]
        nth = np.cumsum(held, 1, dtype=np.int16)
        many = nth[:, -1].astype(np.int64)
        i, j = np.nonzero(held)
        bits = lanes.pos[i] + nth[i, j] - 1
        one = (lanes.win[np.minimum(bits >> 3, len(lanes.win) - 1)] >> (39 - (bits & 7))) & 1
        go = lanes.at < lanes.stop
        old = val[i, j].astype(np.int64)
        step = (one << lanes.low[i]) * ((np.abs(old) >> lanes.low[i]) & 1 ^ 1) * go[i]
        flat[at[i, j]] = np.where(old < 0, old - step, old + step)
        put = fresh & found & go
        flat[at[put, (stop - low)[put]]] = np.where(sign[put] > 0, 1, -1) << lanes.low[put]
        lanes.pos += many
        lanes.wrong(fresh & ~found & ~whole)
        k = stop + 1
        done = whole | (k > lanes.last)
        blocks_left -= whole
        lanes.at += done & go
        k = np.where(done, lanes.first, k)
        go = lanes.at < lanes.stop
        if not go.all():
            lanes.keep(go)
            k, blocks_left = k[go], blocks_left[go]


def decode(files: list[bytes]) -> list[dict | None]:
    """For each file its coefficients (blocks as geometry() has them, zigzag order), quantisation, height, width, sampling and notes; None for what is no whole progressive JPEG."""
    raw = np.frombuffer(b"".join(files) + b"\0", np.uint8)
    ff = np.flatnonzero(raw[:-1] == 0xFF)
    then = raw[ff + 1]
    marks = ff[(then != 0) & (then != 0xFF) & ((then < 0xD0) | (then > 0xD7))].tolist()
    resets = ff[(then >= 0xD0) & (then <= 0xD7)].tolist()
    stuffing = ff[then == 0] + 1
    clean = np.delete(raw, stuffing)
    clean = np.r_[clean, np.full(512, 0xFF, np.uint8)].astype(np.int64)
    win = clean[:-4] << 32 | clean[1:-3] << 24 | clean[2:-2] << 16 | clean[3:-1] << 8 | clean[4:]
    offsets = np.r_[0, np.cumsum([len(f) for f in files])].tolist()
    out: list[dict | None] = []
    total = 0
    for data, offset in zip(files, offsets):
        try:
            one = _parsed(data, marks, offset)
            for s, wave in zip(one["scans"], _waves(tuple((s["members"], s["first"], s["last"]) for s in one["scans"]))):
                s["wave"] = wave
            one["base"] = total
            total += geometry(one["height"], one["width"], one["sampling"])[1]
        except (NotDecodable, IndexError, struct.error, ValueError):
            one = None
        out.append(one)
    coefs = np.zeros((total, 64), np.int16)
    bad = np.zeros(len(files), bool)
    luts: dict[tuple, int] = {}
    tables: list[np.ndarray] = []
    jobs = sorted(((s["wave"], s["first"] > 0, s["refine"], i, s) for i, one in enumerate(out) if one for s in one["scans"]), key=lambda j: j[:4])
    for (_, ac, refine), group in groupby(jobs, key=lambda j: j[:3]):
        rows, blocks, kinds, held = [], [], [], 0
        for *_, i, s in group:
            one = out[i]
            at, kind, per = scan_blocks(one["height"], one["width"], one["sampling"], s["members"])
            size = (s["restart"] or len(at) // per) * per
            start, stop = offsets[i] + s["from"], offsets[i] + s["to"]
            cuts = resets[bisect_left(resets, start) : bisect_left(resets, stop)]
            if -(-len(at) // size) != len(cuts) + 1:
                bad[i] = True
                continue
            blocks.append(at + one["base"])
            kinds.append(kind)
            key = s["tables"]
            if key not in luts:  # the tables of a scan's components stand in a row
                luts[key] = len(tables)
                tables += [lookup(*t) for t in key]
            for x, (p, q) in enumerate(zip([start, *[c + 2 for c in cuts]], [*cuts, stop])):
                rows.append((p, q, held + x * size, held + min((x + 1) * size, len(at)), i, s["first"], s["last"], s["low"], luts[key]))
            held += len(at)
        if not rows:
            continue
        stacked = np.stack(tables) if tables else np.zeros((1, 1 << 16), np.int64)
        lanes = _Lanes(win, stuffing, coefs, np.concatenate(blocks), rows, bad)
        if not ac:
            _dc_refine(lanes) if refine else _dc_first(lanes, np.concatenate(kinds), stacked)
        else:
            (_ac_refine if refine else _ac_first)(lanes, stacked)
    for i, one in enumerate(out):
        if one:
            one["coefs"] = coefs[one["base"] : one["base"] + geometry(one["height"], one["width"], one["sampling"])[1]]
    return [None if bad[i] else one for i, one in enumerate(out)]


# ---- from coefficients to colours ----

_c = np.cos((2 * np.arange(8)[None, :] + 1) * np.arange(8)[:, None] * np.pi / 16) * np.where(np.arange(8) == 0, 8**-0.5, 0.5)[:, None]
#: From coefficients in zigzag order to samples, in whole numbers of 2^-20: products add up exactly in doubles, in any order.
BASIS = np.round(np.kron(_c, _c) * 2**20)[ZIGZAG]


def samples(coefs: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """Blocks of 64 samples, 0 to 255."""
    out = np.empty(coefs.shape, np.uint8)
    for i in range(0, len(coefs), BLOCKS_AT_ONCE):
        x = (coefs[i : i + BLOCKS_AT_ONCE] * quant).astype(np.float64) @ BASIS
        out[i : i + BLOCKS_AT_ONCE] = np.clip(np.floor(x * 2.0**-20 + 0.5) + 128, 0, 255)
    return out


def to_rgb(image: dict, blocks: np.ndarray | None = None) -> np.ndarray:
    """The (height, width, 3) tensor of a decoded image; chroma is repeated up to full resolution, one component is grey. blocks: its samples, if they are made already."""
    h, w, sampling = image["height"], image["width"], image["sampling"]
    top_h, top_v = max(x for x, _ in sampling), max(y for _, y in sampling)
    planes = []
    for (first, rows, columns), (x, y), q in zip(geometry(h, w, sampling)[0], sampling, image["quant"]):
        own = slice(first, first + rows * columns)
        b = samples(image["coefs"][own], q) if blocks is None else blocks[own]
        plane = b.reshape(rows, columns, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8)
        if (x, y) != (top_h, top_v):
            plane = plane[np.arange(h) * y // top_v][:, np.arange(w) * x // top_h]
        planes.append(plane[:h, :w])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, 2)
    y, cb, cr = planes[0].astype(np.int32) << 16, planes[1].astype(np.int32) - 128, planes[2].astype(np.int32) - 128
    out = np.empty((h, w, 3), np.uint8)
    half = 1 << 15
    # the usual weights in 2^-16: 1.402, 0.344136, 0.714136, 1.772
    out[..., 0] = np.clip((y + 91881 * cr + half) >> 16, 0, 255)
    out[..., 1] = np.clip((y - 22554 * cb - 46802 * cr + half) >> 16, 0, 255)
    out[..., 2] = np.clip((y + 116130 * cb + half) >> 16, 0, 255)
    return out


def described(rgb: np.ndarray) -> str:
    """Size, sums of the three colours, a hash of which of 8 x 8 cells are brighter than the mean, and the crc32 of the tensor."""
    h, w, _ = rgb.shape
    total = [int(rgb[..., c].sum(dtype=np.int64)) for c in range(3)]
    rows, cols = np.arange(8) * h // 8, np.arange(8) * w // 8
    grey = rgb[..., 0].astype(np.int64) + rgb[..., 1] + rgb[..., 2]
    cells = np.add.reduceat(np.add.reduceat(grey, rows, 0), cols, 1)
    area = np.maximum(np.diff(np.r_[rows, h]), 1)[:, None] * np.maximum(np.diff(np.r_[cols, w]), 1)
    bright = np.packbits((cells * (h * w) > sum(total) * area).ravel()).tobytes().hex()
    return f"{w}x{h}:{total[0]}:{total[1]}:{total[2]}:{bright}:{zlib.crc32(np.ascontiguousarray(rgb)):08x}"


# ---- columns ----


def _in_parts(batches: Iterator[pa.RecordBatch], size) -> Iterator[list[tuple]]:
    """Rows of batches as tuples, some MB together."""
    part, held = [], 0
    for b in batches:
        for row in zip(*[b.column(i) for i in range(b.num_columns)]):
            row = tuple(x.as_py() for x in row)
            part.append(row)
            held += size(row)
            if held >= BYTES_AT_ONCE or len(part) >= 4096:
                yield part
                part, held = [], 0
    if part:
        yield part


def rgb_tensors(media: DataFrame, column: str = "media") -> DataFrame:
    """media with height, width and rgb (height * width * 3 bytes) of the progressive JPEG in a binary column; all three null for nulls and anything else. Columns of these names are replaced."""
    old = [c for c in media.columns if c.lower() not in ("height", "width", "rgb")]
    at = old.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                found = decode([x.as_py() or b"" for x in part.column(at)])
                tensors = [None if one is None else to_rgb(one).tobytes() for one in found]
                sizes = [pa.array([None if one is None else one[k] for one in found], pa.int32()) for k in ("height", "width")]
                yield pa.RecordBatch.from_arrays([*part.columns, *sizes, pa.array(tensors, pa.binary())], [*old, "height", "width", "rgb"])

    from pyspark.sql import types as T

    schema = T.StructType([media.schema[c] for c in old] + [T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("rgb", T.BinaryType())])
    return media.select(*[media[c] for c in old]).mapInArrow(run, schema)


# Bytes that texts are mostly made of get the small coefficients, the others follow by number; 0 stays 0, so padding costs nothing.
_COMMON = bytes([0, 1, 2]) + b" etaoinsrhldcumfpgwybvk,.xjqz\n-ETAOINSRHLDC0123456789"
_ORDER = np.array(list(_COMMON) + [b for b in range(256) if b not in _COMMON])
TO_VALUE = np.zeros(256, np.int16)
TO_VALUE[_ORDER] = [(i + 1) // 2 * (1 if i % 2 else -1) for i in range(256)]
FROM_VALUE = np.zeros(257, np.uint8)
FROM_VALUE[TO_VALUE + 128] = np.arange(256)


def padded(data: bytes) -> bytes:
    """data and bytes 0 up to a positive multiple of 64."""
    return data + bytes(-len(data) % 64 or (0 if data else 64))


def payload_size(blocks: int) -> tuple[int, int]:
    """Height and width of the image that has room for so many blocks: MCUs of six blocks, as square as they come."""
    mcus = -(-blocks // 6)
    across = int(np.ceil(np.sqrt(mcus)))
    return 16 * -(-mcus // across), 16 * across


def store_payloads(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG for each payload of whole blocks: byte k of a block is its k-th coefficient in zigzag order, block after block in MCU order."""
    raw = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, 64)
    upto = np.r_[0, np.cumsum([len(p) // 64 for p in payloads])]
    stores, sizes = [], []
    values = TO_VALUE[raw]
    for a, b in zip(upto.tolist(), upto[1:].tolist()):
        sizes.append(payload_size(b - a))
        store = np.zeros((geometry(*sizes[-1], PLAIN)[1], 64), np.int16)
        store[scan_blocks(*sizes[-1], PLAIN, (0, 1, 2))[0][: b - a]] = values[a:b]
        stores.append(store)
    return encode(stores, sizes, notes=[b"blocks %d" % (len(p) // 64) for p in payloads])


def read_payload(image: dict) -> bytes:
    """The payload back from the coefficients of a decoded file."""
    blocks = int(image["notes"][0].split()[1])
    order = scan_blocks(image["height"], image["width"], image["sampling"], (0, 1, 2))[0][:blocks]
    return FROM_VALUE[image["coefs"][order].astype(np.int64) + 128].tobytes()


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 (null: empty), padded, as a progressive JPEG. Other columns are not read; rows stay rows, null ids stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _in_parts(batches, lambda r: len(r[1] or "")):
            data = [(t or "").encode() for _, t in part]
            media = store_payloads([padded(d) for d in data])
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in part], pa.int64()), pa.array([len(d) for d in data], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, "doc_id long, n_bytes long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(media: DataFrame) -> DataFrame:
    """The rows of text_media() read back: digests of the payload that the coefficients hold, of the file, and a description of its RGB tensor."""

    def told(i, n, data, image, blocks) -> tuple:
        payload = read_payload(image)
        return i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), described(to_rgb(image, blocks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _in_parts(batches, lambda r: len(r[2])):
            images = decode([data for _, _, data in part])
            if None in images:
                raise ValueError("a stored file could not be read back")
            # one quantisation for all of them: the blocks of the batch are transformed together
            blocks = samples(np.concatenate([x["coefs"] for x in images]), images[0]["quant"][0])
            rows = [told(*row, x, blocks[x["base"] : x["base"] + len(x["coefs"])]) for row, x in zip(part, images)]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [x.split()[0] for x in FEATURES.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES)


def op11_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(materialize(text_media(table(spark, sf_dir, "documents")), "media"))
