"""An adaptive context-mixing range coder for token ids, in independent blocks.

All blocks of a call are coded in step, one numpy lane per block. Every block
starts from the same empty model and has a length and a CRC-32 of its ids, so
each can be decoded and checked alone.

Model. For each id three predictions are made from the ids of the block so far:
order 2 (the id that followed the last two ids), order 1 (the id that followed
the last id) and order 0 (the ids seen, numbered as they first came). The first
thing coded is which prediction holds: order 2, order 1, order 0 with the
binary magnitude of the number, or none. The distribution of these outcomes is
mixed: the counts kept for the confidence of the order-2 prediction, for that
of the order-1 prediction and for the block as a whole are added, so a context
speaks the louder the more it has seen. Then the rest of the number, or a new
id, is coded evenly.

Coder. 48-bit interval, 16-bit words; a carry is added to the words once a
block has ended. Only integers are used: every machine decodes the same.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 2048
_SYMBOLS = 16  # 0 order 2, 1 order 1, 2..13 order 0 by magnitude, 14 new
_NEW = 14
_LEVELS = 8
_GAIN = np.uint16(16)
_TABLE1, _TABLE2 = 1024, 2048
_U = np.uint64
_LOW32 = _U(0xFFFFFFFF)
_HEAD = "<4sIII"
_MAGIC = b"RLCM"


class _Model:
    def __init__(self, lanes: int):
        self.lane = np.arange(lanes)
        self.by2 = np.ones((lanes * _LEVELS, _SYMBOLS), np.uint16)
        self.by1 = np.ones((lanes * _LEVELS, _SYMBOLS), np.uint16)
        self.by0 = np.ones((lanes, _SYMBOLS), np.uint16)
        self.id1, self.sure1 = np.zeros(lanes * _TABLE1, np.int64), np.zeros(lanes * _TABLE1, np.int8)
        self.id2, self.sure2 = np.zeros(lanes * _TABLE2, np.int64), np.zeros(lanes * _TABLE2, np.int8)
        self.last = np.zeros(lanes, np.int64)
        self.before = np.zeros(lanes, np.int64)

    def predict(self, n: int) -> np.ndarray:
        """Set the predictions of the first n lanes; their summed counts, cumulated, with a leading 0."""
        last, lane = self.last[:n], self.lane[:n]
        self.slot1 = lane * _TABLE1 + ((last * 0x9E3779B1 >> 12) & (_TABLE1 - 1))
        self.slot2 = lane * _TABLE2 + (((last * 0x9E3779B1 + self.before[:n] * 0x85EBCA77) >> 11) & (_TABLE2 - 1))
        self.guess1, self.level1 = self.id1[self.slot1], self.sure1[self.slot1]
        self.guess2, self.level2 = self.id2[self.slot2], self.sure2[self.slot2]
        self.row1 = lane * _LEVELS + self.level1
        self.row2 = lane * _LEVELS + self.level2
        cum = np.zeros((n, _SYMBOLS + 1), np.int32)
        np.cumsum(self.by2[self.row2].astype(np.int32) + self.by1[self.row1] + self.by0[:n], axis=1, out=cum[:, 1:])
        return cum

    def learn(self, n: int, ids: np.ndarray, symbol: np.ndarray) -> None:
        self.by2[self.row2, symbol] += _GAIN
        self.by1[self.row1, symbol] += _GAIN
        self.by0[self.lane[:n], symbol] += np.uint16(4)
        for slot, guess, level, table, sure in (
            (self.slot1, self.guess1, self.level1, self.id1, self.sure1),
            (self.slot2, self.guess2, self.level2, self.id2, self.sure2),
        ):
            hit = (guess == ids) & (level > 0)
            replace = ~hit & (level <= 1)
            sure[slot] = np.where(hit, np.minimum(level + 1, _LEVELS - 1), np.where(replace, 1, level - 1))
            table[slot] = np.where(replace, ids, guess)
        self.before[:n] = self.last[:n]
        self.last[:n] = ids


def _magnitude(number: np.ndarray) -> np.ndarray:
    """floor(log2(number)) of numbers from 1 to 2^52."""
    return np.frexp(number.astype(np.float64))[1].astype(np.int64) - 1


class _Writer:
    def __init__(self, lanes: int, words: int):
        self.low, self.range = np.zeros(lanes, _U), np.full(lanes, (1 << 48) - 1, _U)
        self.words, self.at = np.zeros((words, lanes), np.uint32), np.zeros(lanes, np.int64)

    def put(self, lanes: np.ndarray, start: np.ndarray, width: np.ndarray, total: np.ndarray) -> None:
        unit = self.range[lanes] // total.astype(_U)
        low, rng = self.low[lanes] + unit * start.astype(_U), unit * width.astype(_U)
        short = np.flatnonzero(rng <= _LOW32)
        if len(short):
            own = lanes[short]
            self.words[self.at[own], own] = (low[short] >> _U(32)).astype(np.uint32)
            self.at[own] += 1
            low[short] = (low[short] & _LOW32) << _U(16)
            rng[short] <<= _U(16)
        self.low[lanes], self.range[lanes] = low, rng

    def finish(self) -> list[bytes]:
        lanes = np.arange(len(self.low))
        self.words[self.at, lanes] = ((self.low + _LOW32) >> _U(32)).astype(np.uint32)
        self.at += 1
        for i in range(int(self.at.max()) - 1, 0, -1):
            self.words[i - 1] += self.words[i] >> 16
        out = np.ascontiguousarray((self.words & 0xFFFF).astype("<u2").T)
        return [out[i, :n].tobytes() for i, n in enumerate(self.at.tolist())]


class _Reader:
    def __init__(self, blocks: list[bytes]):
        lanes = len(blocks)
        self.words = np.zeros((lanes, max(map(len, blocks)) // 2 + 8), _U)
        for i, b in enumerate(blocks):
            self.words[i, : len(b) // 2] = np.frombuffer(b, "<u2")
        self.range = np.full(lanes, (1 << 48) - 1, _U)
        self.code = (self.words[:, 0] << _U(32)) | (self.words[:, 1] << _U(16)) | self.words[:, 2]
        self.at = np.full(lanes, 3)
        self.last = self.words.shape[1] - 1

    def unit(self, lanes: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        unit = self.range[lanes] // total.astype(_U)
        return unit, np.minimum((self.code[lanes] // unit).astype(np.int64), total - 1)

    def drop(self, lanes: np.ndarray, unit: np.ndarray, start: np.ndarray, width: np.ndarray | int) -> None:
        code, rng = self.code[lanes] - unit * start.astype(_U), unit * np.asarray(width).astype(_U)
        short = np.flatnonzero(rng <= _LOW32)
        if len(short):
            own = lanes[short]
            code[short] = (code[short] << _U(16)) | self.words[own, np.minimum(self.at[own], self.last)]
            self.at[own] += 1
            rng[short] <<= _U(16)
        self.code[lanes], self.range[lanes] = code, rng


def _numbered(ids: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every id: its number in first-seen order in its block, whether it is new, the ids seen before it."""
    lane = np.arange(len(ids)) // block
    _, first, where = np.unique(lane << 32 | ids, return_index=True, return_inverse=True)
    first = first[where]
    new = first == np.arange(len(ids))
    upto = np.cumsum(new)
    base = np.concatenate(([0], upto))[lane * block]
    return upto[first] - 1 - base, new, upto - new - base


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """Ids (below 2^32) as one byte string of independent blocks."""
    ids = np.asarray(ids, np.int64)
    lanes = -(-len(ids) // block)
    parts = [struct.pack(_HEAD, _MAGIC, block, len(ids), lanes)]
    if not lanes:
        return parts[0]
    number, new, seen = _numbered(ids, block)
    size = _magnitude(number + 1)
    # Even part: value and count of values; new ids are two halves.
    value = np.where(new, ids & 0xFFFF, number + 1 - (1 << size))
    count = np.where(new, 1 << 16, np.minimum(1 << size, seen + 1 - (1 << size)))
    model, out, all_lanes = _Model(lanes), _Writer(lanes, 3 * block + 4), np.arange(lanes)
    top = np.maximum.reduceat(ids, np.arange(0, len(ids), block)) >> 16
    for t in range(min(block, len(ids))):
        n = lanes if (lanes - 1) * block + t < len(ids) else lanes - 1
        own, at = all_lanes[:n], all_lanes[:n] * block + t
        now = ids[at]
        cum = model.predict(n)
        hit2 = (model.level2 > 0) & (model.guess2 == now)
        hit1 = (model.level1 > 0) & (model.guess1 == now) & ~hit2
        symbol = np.where(hit2, 0, np.where(hit1, 1, np.where(new[at], _NEW, size[at] + 2)))
        start = cum[own, symbol]
        out.put(own, start, cum[own, symbol + 1] - start, cum[:, -1])
        high = own[(symbol == _NEW) & (top[:n] > 0)]
        if len(high):
            out.put(high, now[high] >> 16, np.ones(len(high), np.int64), top[high] + 1)
        rest = own[(symbol > 1) & (count[at] > 1)]
        if len(rest):
            out.put(rest, value[at][rest], np.ones(len(rest), np.int64), count[at][rest])
        model.learn(n, now, symbol)
    blocks = out.finish()
    for i, body in enumerate(blocks):
        own = ids[i * block : (i + 1) * block]
        parts.append(struct.pack("<IIII", len(own), len(body), int(top[i]), zlib.crc32(own.astype("<u4").tobytes())))
    return b"".join(parts + blocks)


def _split(data: bytes) -> tuple[list[tuple[int, int, int, int]], list[bytes]]:
    magic, _, _, lanes = struct.unpack_from(_HEAD, data)
    if magic != _MAGIC:
        raise ValueError("not a block of token ids")
    heads = [struct.unpack_from("<IIII", data, struct.calcsize(_HEAD) + 16 * i) for i in range(lanes)]
    at, bodies = struct.calcsize(_HEAD) + 16 * lanes, []
    for head in heads:
        bodies.append(data[at : at + head[1]])
        at += head[1]
    return heads, bodies


def _decode_lanes(heads: list[tuple[int, int, int, int]], bodies: list[bytes]) -> list[np.ndarray]:
    """Ids of blocks; they are decoded in step, longest first."""
    order = sorted(range(len(heads)), key=lambda i: -heads[i][0])
    lengths = np.array([heads[i][0] for i in order])
    top = np.array([heads[i][2] for i in order], np.int64)
    lanes, longest = len(order), int(lengths[0])
    model, data, all_lanes = _Model(lanes), _Reader([bodies[i] for i in order]), np.arange(lanes)
    ids, known, seen = np.zeros((longest, lanes), np.int64), np.zeros((lanes, longest + 1), np.int64), np.zeros(lanes, np.int64)
    for t in range(longest):
        n = int(np.searchsorted(-lengths, -t, "left"))
        own = all_lanes[:n]
        cum = model.predict(n)
        unit, v = data.unit(own, cum[:, -1].astype(np.int64))
        symbol = (cum[:, 1:] <= v[:, None]).sum(axis=1)
        start = cum[own, symbol]
        data.drop(own, unit, start, cum[own, symbol + 1] - start)
        now = np.where(symbol == 0, model.guess2, model.guess1)
        fresh = symbol == _NEW
        upper = np.zeros(n, np.int64)
        high = own[fresh & (top[:n] > 0)]
        if len(high):
            unit, upper[high] = data.unit(high, top[high] + 1)
            data.drop(high, unit, upper[high], 1)
        size = np.where((symbol > 1) & ~fresh, symbol - 2, 0)
        count = np.where(fresh, 1 << 16, np.minimum(1 << size, seen[:n] + 1 - (1 << size)))
        value = np.zeros(n, np.int64)
        rest = own[(symbol > 1) & (count > 1)]
        if len(rest):
            unit, value[rest] = data.unit(rest, count[rest])
            data.drop(rest, unit, value[rest], 1)
        old = own[(symbol > 1) & ~fresh]
        now[old] = known[old, np.minimum(value[old] + (1 << size[old]) - 1, longest)]
        fresh = own[fresh]
        now[fresh] = value[fresh] | upper[fresh] << 16
        known[fresh, seen[fresh]] = now[fresh]
        seen[fresh] += 1
        ids[t, :n] = now
        model.learn(n, now, symbol)
    found: list[np.ndarray] = [np.empty(0, np.int64)] * lanes
    columns = np.ascontiguousarray(ids.T)
    for k, i in enumerate(order):
        own = columns[k, : heads[i][0]].astype("<u4")
        if zlib.crc32(own.tobytes()) != heads[i][3]:
            raise ValueError("a block of token ids does not match its checksum")
        found[i] = own
    return found


def decode_many(strings: list[bytes]) -> list[np.ndarray]:
    """The ids of each byte string; all their blocks are decoded in step."""
    split = [_split(data) for data in strings]
    heads = [h for found, _ in split for h in found]
    bodies = [b for _, found in split for b in found]
    decoded = _decode_lanes(heads, bodies) if heads else []
    out, at = [], 0
    for found, _ in split:
        part = decoded[at : at + len(found)]
        out.append(np.concatenate(part) if part else np.empty(0, "<u4"))
        at += len(found)
    return out


def decode_block(data: bytes, number: int) -> np.ndarray:
    """One block alone."""
    heads, bodies = _split(data)
    return _decode_lanes([heads[number]], [bodies[number]])[0]
