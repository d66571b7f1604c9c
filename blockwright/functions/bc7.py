"""BC7 texture blocks: 16 texels of 4 channels in 128 bits. All eight modes are read; modes 6, 5 and 1 are written.

A block's bits from the lowest: its mode (as many zeros, then a one), partition, rotation, index selection, the ends of each
channel, alphas, shared low bits, indices (the anchor of each part has one bit less: its highest is 0, for which ends are swapped).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Mode:
    """Parts, bits of the partition, rotation, index selection, colour and alpha ends; low bits by end or by part; bits of both indices."""

    parts: int
    partition: int
    rotation: int
    selection: int
    colour: int
    alpha: int
    by_end: int
    by_part: int
    index: int
    second: int


#: Fixed values of the format: the modes.
MODES = (
    Mode(3, 4, 0, 0, 4, 0, 1, 0, 3, 0), Mode(2, 6, 0, 0, 6, 0, 0, 1, 3, 0), Mode(3, 6, 0, 0, 5, 0, 0, 0, 2, 0), Mode(2, 6, 0, 0, 7, 0, 1, 0, 2, 0),
    Mode(1, 0, 2, 1, 5, 6, 0, 0, 2, 3), Mode(1, 0, 2, 0, 7, 8, 0, 0, 2, 2), Mode(1, 0, 0, 0, 7, 7, 1, 0, 4, 0), Mode(2, 6, 0, 0, 5, 5, 1, 0, 2, 0),
)
#: Fixed values of the format: texels of the second part of 64 patterns of two, one bit each.
TWO = (
    0xCCCC, 0x8888, 0xEEEE, 0xECC8, 0xC880, 0xFEEC, 0xFEC8, 0xEC80, 0xC800, 0xFFEC, 0xFE80, 0xE800, 0xFFE8, 0xFF00, 0xFFF0, 0xF000,
    0xF710, 0x008E, 0x7100, 0x08CE, 0x008C, 0x7310, 0x3100, 0x8CCE, 0x088C, 0x3110, 0x6666, 0x366C, 0x17E8, 0x0FF0, 0x718E, 0x399C,
    0xAAAA, 0xF0F0, 0x5A5A, 0x33CC, 0x3C3C, 0x55AA, 0x9696, 0xA55A, 0x73CE, 0x13C8, 0x324C, 0x3BDC, 0x6996, 0xC33C, 0x9966, 0x0660,
    0x0272, 0x04E4, 0x4E40, 0x2720, 0xC936, 0x936C, 0x39C6, 0x639C, 0x9336, 0x9CC6, 0x817E, 0xE718, 0xCCF0, 0x0FCC, 0x7744, 0xEE22,
)
#: Fixed values of the format: the part of each texel of 64 patterns of three.
THREE = (
    "0011001102212222", "0001001122112221", "0000200122112211", "0222002200110111", "0000000011221122", "0011001100220022", "0022002211111111", "0011001122112211",
    "0000000011112222", "0000111111112222", "0000111122222222", "0012001200120012", "0112011201120112", "0122012201220122", "0011011211221222", "0011200122002220",
    "0001001101121122", "0111001120012200", "0000112211221122", "0022002200221111", "0111011102220222", "0001000122212221", "0000001101220122", "0000110022102210",
    "0122012200110000", "0012001211222222", "0110122112210110", "0000011012211221", "0022110211020022", "0110011020022222", "0011012201220011", "0000200022112221",
    "0000000211221222", "0222002200120011", "0011001200220222", "0120012001200120", "0000111122220000", "0120120120120120", "0120201212010120", "0011220011220011",
    "0011112222000011", "0101010122222222", "0000000021212121", "0022112200221122", "0022001100220011", "0220122102201221", "0101222222220101", "0000212121212121",
    "0101010101012222", "0222011102220111", "0002111200021112", "0000211221122112", "0222011101110222", "0002111211120002", "0110011001102222", "0000000021122112",
    "0110011022222222", "0022001100110022", "0022112211220022", "0000000000002112", "0002000100020001", "0222122202221222", "0101222222222222", "0111201122012220",
)
#: Fixed values of the format: anchor texels of the second part of two, and of the second and third part of three.
ANCHOR_TWO = (
    15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 2, 8, 2, 2, 8, 8, 15, 2, 8, 2, 2, 8, 8, 2, 2,
    15, 15, 6, 8, 2, 8, 15, 15, 2, 8, 2, 2, 2, 15, 15, 6, 6, 2, 6, 8, 15, 15, 2, 2, 15, 15, 15, 15, 15, 2, 2, 15,
)
ANCHOR_THREE = (
    (3, 3, 15, 15, 8, 3, 15, 15, 8, 8, 6, 6, 6, 5, 3, 3, 3, 3, 8, 15, 3, 3, 6, 10, 5, 8, 8, 6, 8, 5, 15, 15,
     8, 15, 3, 5, 6, 10, 8, 15, 15, 3, 15, 5, 15, 15, 15, 15, 3, 15, 5, 5, 5, 8, 5, 10, 5, 10, 8, 13, 15, 12, 3, 3),
    (15, 8, 8, 3, 15, 15, 3, 8, 15, 15, 15, 15, 15, 15, 15, 8, 15, 8, 15, 3, 15, 8, 15, 8, 3, 15, 6, 10, 15, 15, 10, 8,
     15, 3, 15, 10, 10, 8, 9, 10, 6, 15, 8, 15, 3, 6, 6, 8, 15, 3, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 3, 15, 15, 8),
)
#: Fixed values of the format: weights (of 64) of indices of 2, 3 and 4 bits.
WEIGHTS = {2: np.array([0, 21, 43, 64]), 3: np.array([0, 9, 18, 27, 37, 46, 55, 64]), 4: np.array([0, 4, 9, 13, 17, 21, 26, 30, 34, 38, 43, 47, 51, 55, 60, 64])}
#: A block whose squared error is not above this is not tried in further modes.
GOOD = 64
#: Patterns of two parts that are fitted in full.
TRIED = 4

_SECOND = np.array([[m >> i & 1 for i in range(16)] for m in TWO], bool)


def widen(v: int, bits: int) -> int:
    """An n-bit value over 8 bits."""
    v <<= 8 - bits
    return v | v >> bits


def parts_of(mode: Mode, partition: int) -> tuple[list[int], list[int]]:
    """(part of each texel, anchor texel of each part)."""
    if mode.parts == 1:
        return [0] * 16, [0]
    if mode.parts == 2:
        return [TWO[partition] >> i & 1 for i in range(16)], [0, ANCHOR_TWO[partition]]
    return [int(c) for c in THREE[partition]], [0, ANCHOR_THREE[0][partition], ANCHOR_THREE[1][partition]]


class _Bits:
    def __init__(self, value: int = 0):
        self.value, self.at = value, 0

    def take(self, n: int) -> int:
        v = self.value >> self.at & (1 << n) - 1
        self.at += n
        return v

    def put(self, v: int, n: int) -> None:
        self.value |= int(v) << self.at
        self.at += n


def decode_block(block: bytes) -> np.ndarray:
    """16 texels of 4 channels; a block without a mode is transparent black."""
    b = _Bits(int.from_bytes(block, "little"))
    number = next((k for k in range(8) if block[0] >> k & 1), 8)
    if number == 8:
        return np.zeros((16, 4), np.uint8)
    m = MODES[number]
    b.at = number + 1
    partition, rotation, selection = b.take(m.partition), b.take(m.rotation), b.take(m.selection)
    ends = [[0, 0, 0, 255] for _ in range(2 * m.parts)]
    for c in range(3):
        for e in ends:
            e[c] = b.take(m.colour)
    for e in ends if m.alpha else []:
        e[3] = b.take(m.alpha)
    low = [b.take(1) for _ in ends] if m.by_end else [x for _ in range(m.parts) for x in [b.take(1)] * 2] if m.by_part else []
    more = int(bool(low))
    for i, e in enumerate(ends):
        for c in range(4 if m.alpha else 3):
            v = e[c] << 1 | low[i] if low else e[c]
            e[c] = widen(v, (m.alpha if c == 3 else m.colour) + more)
    part, anchors = parts_of(m, partition)
    first = [b.take(m.index - (anchors[part[i]] == i)) for i in range(16)]
    second = [b.take(m.second - (i == 0)) for i in range(16)] if m.second else first
    wide = WEIGHTS[m.second or m.index]
    colour, alpha = (WEIGHTS[m.index][first], wide[second]) if not selection else (wide[second], WEIGHTS[m.index][first])
    ends_ = np.array(ends, np.int64)
    low_end, high_end = ends_[[2 * p for p in part]], ends_[[2 * p + 1 for p in part]]
    w = np.stack([colour, colour, colour, alpha], 1)
    px = ((64 - w) * low_end + w * high_end + 32) >> 6
    if rotation:
        px[:, [3, rotation - 1]] = px[:, [rotation - 1, 3]]
    return px.astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    """Blocks x 16 texels x 4 channels."""
    return np.array([decode_block(data[i : i + 16]) for i in range(0, len(data) // 16 * 16, 16)], np.uint8).reshape(-1, 16, 4)


def _extremes(px: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Both ends of the principal axis of each block's own texels."""
    n = np.maximum(own.sum(1), 1)[:, None]
    mean = (px * own[:, :, None]).sum(1) / n
    d = (px - mean[:, None]) * own[:, :, None]
    axis = np.linalg.eigh(d.transpose(0, 2, 1) @ d)[1][:, :, -1]
    t = (d * axis[:, None]).sum(2)
    lo, hi = np.where(own, t, np.inf).min(1), np.where(own, t, -np.inf).max(1)
    empty = ~own.any(1)
    lo[empty] = hi[empty] = 0
    return mean[:, None] + axis[:, None] * np.stack([lo, hi], 1)[:, :, None]


def _refined(px: np.ndarray, own: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Ends of least squared error for given weights."""
    w = w / 64.0
    a, b, c = (own * (1 - w) ** 2).sum(1), (own * w * (1 - w)).sum(1), (own * w * w).sum(1)
    p, q = (px * (own * (1 - w))[:, :, None]).sum(1), (px * (own * w)[:, :, None]).sum(1)
    det = a * c - b * b
    ok = det > 1e-6
    det = np.where(ok, det, 1.0)[:, None]
    ends = np.stack([(c[:, None] * p - b[:, None] * q) / det, (a[:, None] * q - b[:, None] * p) / det], 1)
    return np.where(ok[:, None, None], ends, np.nan)


def _quantise(ends: np.ndarray, bits: int, low: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values of ``bits`` bits, low bit of each end, 8-bit ends). ``low``: None, "end" or "part" (both ends share it)."""
    v = np.clip(ends, 0, 255)
    if low is None:
        q = np.clip(np.rint(v * ((1 << bits) - 1) / 255), 0, (1 << bits) - 1).astype(np.int64)
        return q, np.zeros(q.shape[:2], np.int64), (q << 8 - bits) | (q >> 2 * bits - 8)
    total = bits + 1
    tries = []
    for p in (0, 1):
        q = np.clip(np.rint((v * ((1 << total) - 1) / 255 - p) / 2), 0, (1 << bits) - 1).astype(np.int64)
        full = q << 1 | p
        tries.append((q, (full << 8 - total) | (full >> 2 * total - 8)))
    error = np.stack([((w - v) ** 2).sum(2) for _, w in tries])
    if low == "part":
        error = error.sum(2, keepdims=True).repeat(2, 2)
    p = error.argmin(0)
    pick = lambda k: np.where(p[:, :, None] == 0, tries[0][k], tries[1][k])
    return pick(0), p, pick(1)


def _fit(px: np.ndarray, own: np.ndarray, bits: int, low: str | None, index: int, rounds: int = 3) -> tuple[np.ndarray, ...]:
    """(values, low bits, indices, squared error) of the own texels of each block between two ends."""
    w = WEIGHTS[index]
    best: list[np.ndarray] | None = None
    ends = _extremes(px, own)
    for _ in range(rounds):
        q, p, wide = _quantise(ends, bits, low)
        palette = ((64 - w)[None, :, None] * wide[:, :1] + w[None, :, None] * wide[:, 1:] + 32) >> 6
        far = ((px[:, :, None] - palette[:, None]) ** 2).sum(3)
        i = far.argmin(2)
        error = (np.take_along_axis(far, i[:, :, None], 2)[:, :, 0] * own).sum(1)
        if best is None:
            best = [q, p, i, error]
        else:
            better = error < best[3]
            for old, new in zip(best, (q, p, i, error), strict=True):
                old[better] = new[better]
        again = _refined(px, own, w[i])
        ends = np.where(np.isnan(again), ends, again)
    return tuple(best)


def partition_estimates(px: np.ndarray) -> np.ndarray:
    """For each of the 64 patterns of two parts what a line through each part leaves of the squared error, from sums of moments."""
    out = np.zeros((len(px), 64))
    square = px[:, :, :, None] * px[:, :, None]
    for own in (_SECOND, ~_SECOND):
        n = own.sum(1)[None, :, None]
        s = np.einsum("pt,ntc->npc", own, px)
        cov = np.einsum("pt,ntcd->npcd", own, square) - s[..., None] * s[:, :, None] / n[..., None]
        out += np.trace(cov, axis1=2, axis2=3) - np.linalg.eigvalsh(cov)[..., -1]
    return out


def _swap(values: np.ndarray, low: np.ndarray, index: np.ndarray, own: np.ndarray, anchor: np.ndarray, bits: int) -> None:
    """Turns ends and indices round where the anchor's highest bit is set."""
    turn = np.take_along_axis(index, anchor[:, None], 1)[:, 0] >> bits - 1 == 1
    values[turn], low[turn] = values[turn][:, ::-1], low[turn][:, ::-1]
    index[turn] = np.where(own[turn], (1 << bits) - 1 - index[turn], index[turn])


def encode(px: np.ndarray) -> bytes:
    """Blocks of 16 texels of 4 channels: mode 6, and where that leaves an error, mode 5 for alpha that goes its own way and mode 1 for
    opaque blocks of two colours lines; the least error wins, the earlier of equals."""
    px = np.asarray(px, np.float64)
    n, all_ = len(px), np.ones((len(px), 16), bool)
    zero = np.zeros(n, np.int64)
    out: list[bytes] = [b""] * n
    q, p, i, best = _fit(px, all_, 7, "end", 4)
    _swap(q, p, i, all_, zero, 4)
    for k in range(n):
        b = _Bits()
        b.put(1 << 6, 7)
        for c in range(4):
            b.put(q[k, 0, c], 7)
            b.put(q[k, 1, c], 7)
        b.put(p[k, 0], 1)
        b.put(p[k, 1], 1)
        for t in range(16):
            b.put(i[k, t], 4 - (t == 0))
        out[k] = b.value.to_bytes(16, "little")
    opaque = (px[:, :, 3] == 255).all(1)
    left = np.flatnonzero((best > GOOD) & ~opaque)
    for rotation in range(4 if len(left) else 0):
        own, turned = all_[left], px[left].copy()
        if rotation:
            turned[:, :, [3, rotation - 1]] = turned[:, :, [rotation - 1, 3]]
        cq, _, ci, ce = _fit(turned[:, :, :3], own, 7, None, 2)
        aq, _, ai, ae = _fit(turned[:, :, 3:], own, 8, None, 2)
        none = np.zeros(cq.shape[:2], np.int64)
        _swap(cq, none, ci, own, zero[: len(left)], 2)
        _swap(aq, none, ai, own, zero[: len(left)], 2)
        for j in np.flatnonzero(ce + ae < best[left]).tolist():
            b = _Bits()
            b.put(1 << 5, 6)
            b.put(rotation, 2)
            for c in range(3):
                b.put(cq[j, 0, c], 7)
                b.put(cq[j, 1, c], 7)
            b.put(aq[j, 0, 0], 8)
            b.put(aq[j, 1, 0], 8)
            for index in (ci[j], ai[j]):
                for t in range(16):
                    b.put(index[t], 2 - (t == 0))
            out[left[j]], best[left[j]] = b.value.to_bytes(16, "little"), ce[j] + ae[j]
    left = np.flatnonzero((best > GOOD) & opaque)
    tried = np.argsort(partition_estimates(px[left][:, :, :3]), axis=1, kind="stable")[:, :TRIED] if len(left) else np.zeros((0, 0), np.int64)
    for r in range(tried.shape[1]):
        pattern, found = tried[:, r], []
        for side in (0, 1):
            own = _SECOND[pattern] == bool(side)
            q, p, i, e = _fit(px[left][:, :, :3], own, 6, "part", 3)
            _swap(q, p, i, own, np.array(ANCHOR_TWO)[pattern] if side else zero[: len(left)], 3)
            found.append((q, p, i, e))
        error = found[0][3] + found[1][3]
        for j in np.flatnonzero(error < best[left]).tolist():
            b = _Bits()
            b.put(1 << 1, 2)
            b.put(pattern[j], 6)
            for c in range(3):
                for q, _, _, _ in found:
                    b.put(q[j, 0, c], 6)
                    b.put(q[j, 1, c], 6)
            for _, p, _, _ in found:
                b.put(p[j, 0], 1)
            second = _SECOND[pattern[j]]
            for t in range(16):
                b.put(found[int(second[t])][2][j, t], 3 - (t in (0, ANCHOR_TWO[pattern[j]])))
            out[left[j]], best[left[j]] = b.value.to_bytes(16, "little"), error[j]
    return b"".join(out)
