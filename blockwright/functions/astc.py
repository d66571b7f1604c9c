"""ASTC texture blocks of 4 x 4 texels: one weight for each texel, one or two parts, RGB or RGBA ends, and blocks of one colour.

A block's bits from the lowest: mode (11 bits), parts less one (2 bits), the kind of ends (behind a pattern of 10 bits and as 6
bits for two parts, else 4 bits), the ends as an integer sequence whose range is the largest that fits, and the weights from the highest bit down.
Blocks of any other layout decode to magenta.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np

from blockwright.functions.bc7 import _extremes, _refined

#: The steps of the 32-bit hash behind the partition patterns (operation, shift direction, distance).
HASH_STEPS = (
    ("^", ">>", 15), ("-", "<<", 17), ("+", "<<", 7), ("+", "<<", 4), ("^", ">>", 5),
    ("+", "<<", 16), ("^", ">>", 7), ("^", ">>", 3), ("^", "<<", 6), ("^", ">>", 17),
)
#: How the bits of a colour value (below its trit or quint) are spread over 9 bits, and the factor of its trit or quint,
#: by the number of levels. Bit 0 is "a"; the letters stand for bits 8 to 0.
SPREADS = {
    6: ("000000000", 204), 10: ("000000000", 113), 12: ("b000b0bb0", 93), 20: ("b0000bb00", 54), 24: ("cb000cbcb", 44), 40: ("cb0000cbc", 26),
    48: ("dcb000dcb", 22), 80: ("dcb0000dc", 13), 96: ("edcb000ed", 11), 160: ("edcb0000e", 6), 192: ("fedcb000f", 5),
}
#: Bits of a packed trit block, of a quint block, after each value; kinds of ends; a block of one colour.
TRIT_BITS, QUINT_BITS = (2, 2, 1, 2, 1), (3, 2, 2)
RGB, RGBA = 8, 12
ONE_COLOUR = 0x1FC
#: Weight levels by the mode's range, without and with its high bit.
WEIGHT_LEVELS = ((0, 0, 2, 3, 4, 5, 6, 8), (0, 0, 10, 12, 16, 20, 24, 32))
MAGENTA = (255, 0, 255, 255)
#: An opaque block whose squared error is above this is tried with two parts, and so many patterns are fitted.
PLAIN_ENOUGH, TRIED = 192, 4


@dataclass(frozen=True)
class Range:
    """Values of ``levels``: ``bits`` plain ones below a trit, a quint, or nothing."""

    levels: int

    @property
    def base(self) -> int:
        return 3 if self.levels % 3 == 0 else 5 if self.levels % 5 == 0 else 1

    @property
    def bits(self) -> int:
        return (self.levels // self.base).bit_length() - 1

    def size(self, n: int) -> int:
        """Bits of n values."""
        return n * self.bits + {1: 0, 3: (8 * n + 4) // 5, 5: (7 * n + 2) // 3}[self.base]


RANGES = tuple(Range(n) for n in sorted([2, 3, 4, 5, *SPREADS, *(1 << k for k in range(3, 9))]))


def colour_range(values: int, room: int) -> Range | None:
    """The largest range of 6 levels or more in which so many values fit into ``room`` bits."""
    return next((r for r in reversed(RANGES) if r.levels >= 6 and r.size(values) <= room), None)


def replicate(v: int, n: int, to: int) -> int:
    """An n-bit value over ``to`` bits, its bits repeated from the top."""
    x = 0
    for sh in range(to - n, -n, -n):
        x |= v << sh if sh >= 0 else v >> -sh
    return x & (1 << to) - 1


@functools.cache
def unquantised(levels: int) -> np.ndarray:
    """All values of a colour range as 0 to 255."""
    r, out = Range(levels), []
    for v in range(levels):
        if r.base == 1:
            out.append(replicate(v, r.bits, 8))
            continue
        spread, factor = SPREADS[levels]
        b = sum((v >> ord(c) - ord("a") & 1) << place for place, c in zip(range(8, -1, -1), spread, strict=True) if c != "0")
        flip = 0x1FF * (v & 1)
        out.append(flip & 0x80 | ((v >> r.bits) * factor + b ^ flip) >> 2)
    return np.array(out, np.int64)


@functools.cache
def nearest(levels: int) -> np.ndarray:
    """For each of 0 to 255 the nearest value of a colour range, the smallest of equals."""
    return np.abs(unquantised(levels)[None] - np.arange(256)[:, None]).argmin(1)


def weight(n: int) -> np.ndarray:
    """All weights of n bits as 0 to 64."""
    x = np.array([replicate(v, n, 6) for v in range(1 << n)])
    return x + (x > 32)


def trits(t: int) -> tuple[int, ...]:
    """Five trits of a packed value of 8 bits."""
    low = lambda v, k: 2 if v >> k + 1 & 1 else v >> k & 1
    if t >> 2 & 7 == 7:
        c, high = (t >> 5) << 2 | t & 3, (2, 2)
    else:
        c, high = t & 31, (t >> 7, 2) if t >> 5 & 3 == 3 else (t >> 5 & 3, t >> 7)
    if c & 3 == 3:
        return low(c, 2), c >> 4, 2, *high
    return (c & 3, 2, 2, *high) if c >> 2 & 3 == 3 else (low(c, 0), c >> 2 & 3, c >> 4, *high)


def quints(q: int) -> tuple[int, ...]:
    """Three quints of a packed value of 7 bits."""
    if q >> 1 & 3 == 3:
        if q >> 5 == 0:
            return 4, 4, 4 if q & 1 else q >> 3 & 3
        c, last = (q >> 3 & 3) << 3 | (3 - (q >> 5)) << 1 | q & 1, 4
    else:
        c, last = q & 31, q >> 5
    return (c >> 3, 4, last) if c & 7 == 5 else (c & 7, c >> 3, last)


#: The smallest packed value of each combination.
_PACKED_TRITS = {trits(t): t for t in range(255, -1, -1)}
_PACKED_QUINTS = {quints(q): q for q in range(127, -1, -1)}


def _group(r: Range) -> tuple[int, ...]:
    return {1: (0,), 3: TRIT_BITS, 5: QUINT_BITS}[r.base]


def put_sequence(values: list[int], r: Range) -> int:
    """An integer sequence as a number of ``r.size(len(values))`` bits."""
    out, at, extra = 0, 0, _group(r)
    for i in range(0, len(values), len(extra)):
        part = values[i : i + len(extra)]
        high = tuple(v >> r.bits for v in part) + (0,) * (len(extra) - len(part))
        packed = 0 if r.base == 1 else (_PACKED_TRITS if r.base == 3 else _PACKED_QUINTS)[high]
        for v, n in zip(part, extra, strict=False):
            out |= (v & (1 << r.bits) - 1) << at
            at += r.bits
            out |= (packed & (1 << n) - 1) << at
            packed >>= n
            at += n
    return out


def take_sequence(number: int, count: int, r: Range) -> list[int]:
    """``count`` values of an integer sequence."""
    out: list[int] = []
    extra = _group(r)
    while len(out) < count:
        low, packed, at = [], 0, 0
        for n in extra[: count - len(out)]:
            low.append(number & (1 << r.bits) - 1)
            number >>= r.bits
            packed |= (number & (1 << n) - 1) << at
            number >>= n
            at += n
        high = (0,) if r.base == 1 else trits(packed) if r.base == 3 else quints(packed)
        out += [h << r.bits | v for v, h in zip(low, high, strict=False)]
    return out


def scramble(p: int) -> int:
    """The hash of a pattern's seed."""
    for op, way, n in HASH_STEPS:
        moved = (p << n if way == "<<" else p >> n) & 0xFFFFFFFF
        p = p ^ moved if op == "^" else (p + moved if op == "+" else p - moved) & 0xFFFFFFFF
    return p


@functools.cache
def pattern(seed: int, parts: int) -> tuple[int, ...]:
    """The part of each of 16 texels: that of the four lines (slopes and start from the hash) which is highest there, the first of equals."""
    key = seed + (parts - 1) * 1024
    h = scramble(key)
    a, b = (4 if key & 2 else 5), (6 if parts == 3 else 5)
    shift = (a, b) if key & 1 else (b, a)
    slope = [(h >> 4 * i & 15) ** 2 >> shift[i % 2] for i in range(8)]
    texels = []
    for i in range(16):
        x, y = i % 4 * 2, i // 4 * 2
        lines = [(slope[2 * k] * x + slope[2 * k + 1] * y + (h >> 14 - 4 * k) & 63) if k < max(parts, 2) else 0 for k in range(4)]
        texels.append(lines.index(max(lines)))
    return tuple(texels)


@functools.cache
def two_part_masks() -> tuple[np.ndarray, np.ndarray]:
    """(seeds, their masks: whether a texel is in the second part) of the patterns that have both parts."""
    masks = np.array([pattern(s, 2) for s in range(1024)], bool)
    good = masks.any(1) & ~masks.all(1)
    return np.flatnonzero(good), masks[good]


def two_means(px: np.ndarray, rounds: int = 4) -> np.ndarray:
    """The mask of the texels of the second of two clusters, for blocks of 16 texels of 3 channels."""
    px = px.astype(np.float64)
    total = px.sum(2)
    rows = np.arange(len(px))
    centre = np.stack([px[rows, total.argmin(1)], px[rows, total.argmax(1)]], 1)
    second = np.zeros(px.shape[:2], bool)
    for _ in range(rounds):
        far = ((px[:, :, None, :] - centre[:, None]) ** 2).sum(3)
        second = far[:, :, 1] < far[:, :, 0]
        for s, mine in enumerate((~second, second)):
            n = mine.sum(1)
            mean = (px * mine[:, :, None]).sum(1) / np.maximum(n, 1)[:, None]
            centre[:, s] = np.where(n[:, None] > 0, mean, centre[:, s])
    return (second * (1 << np.arange(16))).sum(1)


def _lerp(low: np.ndarray, high: np.ndarray, w: np.ndarray) -> np.ndarray:
    return ((low * 257 * (64 - w) + high * 257 * w + 32) >> 6) >> 8


def _ends(v: list[int], kind: int) -> tuple[list[int], list[int]]:
    """Both RGBA ends of unquantised values (low and high of each channel); the darker one comes first, else blue was contracted."""
    low, high = [*v[0:6:2], v[6] if kind == RGBA else 255], [*v[1:6:2], v[7] if kind == RGBA else 255]
    if sum(high[:3]) >= sum(low[:3]):
        return low, high
    contracted = lambda e: [e[0] + e[2] >> 1, e[1] + e[2] >> 1, e[2], e[3]]
    return contracted(high), contracted(low)


def decode_block(block: bytes) -> np.ndarray:
    bits = int.from_bytes(block, "little")
    mode = bits & 0x7FF
    if mode & 0x1FF == ONE_COLOUR:
        return np.tile(np.array([bits >> 64 + 16 * c + 8 & 255 for c in range(4)], np.uint8), (16, 1))
    magenta = np.tile(np.array(MAGENTA, np.uint8), (16, 1))
    if not mode & 3 or mode >> 2 & 3 or mode >> 5 & 3 != 2 or mode >> 7 & 3 or mode >> 10:
        return magenta
    levels = WEIGHT_LEVELS[mode >> 9 & 1][(mode & 1) << 1 | (mode >> 1 & 1) << 2 | mode >> 4 & 1]
    parts = (bits >> 11 & 3) + 1
    if levels < 2 or levels & (levels - 1) or parts > 2:
        return magenta
    n = levels.bit_length() - 1
    seed, kind, at = (bits >> 13 & 1023, bits >> 23 & 63, 29) if parts == 2 else (0, (bits >> 13 & 15) << 2, 17)
    values = {RGB: 6, RGBA: 8}.get(kind >> 2, 0)
    r = colour_range(values * parts, 128 - at - 16 * n) if values and not kind & 3 else None
    if r is None:
        return magenta
    v = unquantised(r.levels)[take_sequence(bits >> at, values * parts, r)].tolist()
    ends = np.array([_ends(v[k * values : (k + 1) * values], kind >> 2) for k in range(parts)], np.int64)
    part = np.array(pattern(seed, 2) if parts == 2 else (0,) * 16)
    stored = [sum((bits >> 127 - (i * n + j) & 1) << j for j in range(n)) for i in range(16)]
    return _lerp(ends[part, 0], ends[part, 1], weight(n)[stored][:, None]).astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    """Blocks x 16 texels x 4 channels."""
    return np.array([decode_block(data[i : i + 16]) for i in range(0, len(data) // 16 * 16, 16)], np.uint8).reshape(-1, 16, 4)


def _fit(px: np.ndarray, parts: list[np.ndarray], kind: int, n: int, rounds: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values of the ends, weights, squared error) of each block under a kind of ends and weights of n bits."""
    channels = 3 if kind == RGB else 4
    r = colour_range(2 * channels * len(parts), 128 - (17 if len(parts) == 1 else 29) - 16 * n)
    w, px = weight(n), px[:, :, :channels]
    ends = [_extremes(px, own) for own in parts]
    best: list[np.ndarray] | None = None
    for _ in range(rounds):
        values, index, error = [], np.zeros(px.shape[:2], np.int64), np.zeros(len(px), np.int64)
        for e, own in zip(ends, parts, strict=True):
            q = nearest(r.levels)[np.clip(np.rint(e), 0, 255).astype(np.int64)]
            wide = unquantised(r.levels)[q]
            turn = wide[:, 1, :3].sum(1) < wide[:, 0, :3].sum(1)
            q[turn], wide[turn] = q[turn][:, ::-1], wide[turn][:, ::-1]
            palette = _lerp(wide[:, :1], wide[:, 1:], w[None, :, None])
            far = ((px[:, :, None] - palette[:, None]) ** 2).sum(3)
            i = far.argmin(2)
            index = np.where(own, i, index)
            error += (np.take_along_axis(far, i[:, :, None], 2)[:, :, 0] * own).sum(1).astype(np.int64)
            values.append(q.transpose(0, 2, 1).reshape(len(px), -1))
        found = [np.concatenate(values, 1), index, error]
        if best is None:
            best = found
        else:
            better = error < best[2]
            for old, new in zip(best, found, strict=True):
                old[better] = new[better]
        again = [_refined(px, own, w[index]) for own in parts]
        ends = [np.where(np.isnan(a), e, a) for a, e in zip(again, ends, strict=True)]
    return tuple(best)


def _pack(values: list[int], index: list[int], kind: int, n: int, seed: int | None) -> bytes:
    high = n in (4, 5)
    level = WEIGHT_LEVELS[int(high)].index(1 << n)
    bits = level >> 1 & 1 | (level >> 2 & 1) << 1 | (level & 1) << 4 | 2 << 5 | int(high) << 9
    if seed is None:
        bits, at = bits | kind << 13, 17
    else:
        bits, at = bits | 1 << 11 | seed << 13 | kind << 25, 29
    bits |= put_sequence(values, colour_range(len(values), 128 - at - 16 * n)) << at
    for i, v in enumerate(index):
        for j in range(n):
            bits |= (v >> j & 1) << 127 - (i * n + j)
    return bits.to_bytes(16, "little")


def encode(px: np.ndarray) -> bytes:
    """Blocks of 16 texels of 4 channels: the best of three sizes of weights, and for opaque blocks that these leave an error in, of the
    patterns of two parts nearest to their two clusters."""
    px = np.asarray(px, np.float64)
    out: list[bytes] = [b""] * len(px)
    best = np.full(len(px), np.iinfo(np.int64).max)

    def take(which: np.ndarray, parts: list[np.ndarray], kind: int, n: int, seeds: np.ndarray | None = None) -> None:
        values, index, error = _fit(px[which], parts, kind, n)
        for j in np.flatnonzero(error < best[which]).tolist():
            k = which[j]
            best[k] = error[j]
            out[k] = _pack(values[j].tolist(), index[j].tolist(), kind, n, None if seeds is None else int(seeds[j]))

    opaque = (px[:, :, 3] == 255).all(1)
    for which, kind, sizes in ((np.flatnonzero(opaque), RGB, (4, 3, 5)), (np.flatnonzero(~opaque), RGBA, (4, 3, 2))):
        for n in sizes if len(which) else ():
            take(which, [np.ones((len(which), 16), bool)], kind, n)
    which = np.flatnonzero(opaque & (best > PLAIN_ENOUGH))
    if len(which):
        seeds, masks = two_part_masks()
        clusters = two_means(px[which][:, :, :3])[:, None] >> np.arange(16) & 1 == 1
        differ = (clusters[:, None] ^ masks[None]).sum(2)
        near = np.argsort(np.minimum(differ, 16 - differ), axis=1, kind="stable")[:, :TRIED]
        for k in range(near.shape[1]):
            second = masks[near[:, k]]
            for n in (3, 2):
                take(which, [~second, second], RGB, n, seeds[near[:, k]])
    return b"".join(out)
