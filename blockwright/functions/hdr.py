"""HDR texture blocks: unsigned half floats, one region, two 10-bit endpoints, a 4-bit index for each of 16 texels.

A block has 128 bits from the lowest: the mode (5 bits), the low ends of red, green and blue and then the high ends (10 bits each),
and the indices, of which the first has 3 bits: its highest bit is 0, for which the ends are swapped if need be. Blocks of
other modes decode to 0.
"""

from __future__ import annotations

import numpy as np

#: Fixed values of the format: the mode, the weights of the indices (of 64), the largest half float.
MODE = 3
WEIGHTS = np.array([0, 4, 9, 13, 17, 21, 26, 30, 34, 38, 43, 47, 51, 55, 60, 64], np.int64)
LARGEST = 0x7BFF


def to_half(f: np.ndarray) -> np.ndarray:
    """Half float bits, ties up; what is not positive as 0."""
    f = np.nan_to_num(np.asarray(f, np.float32), nan=0.0, posinf=np.float32(65504))
    x = np.ascontiguousarray(f).view(np.uint32).astype(np.int64)
    small = (f * np.float32(16777216) + np.float32(0.5)).clip(0, 1024).astype(np.int64)
    return np.where(f <= 0, 0, np.where(f >= 65504, LARGEST, np.where(f < 2.0**-14, small, (x - 0x38000000 + 0x1000) >> 13)))


def from_half(h: np.ndarray) -> np.ndarray:
    h = np.asarray(h, np.int64)
    return np.where(h < 1024, h / 16777216.0, (1 + h % 1024 / 1024.0) * np.exp2((h >> 10) - 15.0))


def wide(e: np.ndarray) -> np.ndarray:
    """10-bit endpoints over 16 bits."""
    return np.where(e == 0, 0, np.where(e == 1023, 65535, ((e << 16) + 0x8000) >> 10))


def endpoint(u: np.ndarray) -> np.ndarray:
    """The nearest 10-bit endpoint of a value over 16 bits, the smallest of equals."""
    g = np.floor((u - 32) / 64 + 0.5).astype(np.int64)
    near = np.clip(np.stack([g - 1, g, g + 1]), 0, 1023)
    return np.take_along_axis(near, np.abs(wide(near) - u).argmin(0)[None], 0)[0]


def palette(ends: np.ndarray) -> np.ndarray:
    """The 16 colours (half bits) of each block's two ends (blocks x 2 x 3)."""
    u = wide(ends)
    mixed = ((64 - WEIGHTS)[None, :, None] * u[:, None, 0] + WEIGHTS[None, :, None] * u[:, None, 1] + 32) >> 6
    return (mixed * 31) >> 6


def _fit(half: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best indices, squared error) of each block."""
    far = ((half[:, :, None, :] - palette(ends)[:, None]) ** 2).sum(3)
    index = far.argmin(2)
    return index, np.take_along_axis(far, index[:, :, None], 2).sum((1, 2))


def encode(px: np.ndarray, rounds: int = 4) -> bytes:
    """Blocks of 16 texels of 3 channels. Ends start at the extremes along the principal axis; least squares refine them."""
    half = to_half(px).astype(np.float64)
    n = len(half)
    mean = half.mean(1, keepdims=True)
    axis = np.linalg.svd(half - mean, full_matrices=False)[2][:, 0]
    along = ((half - mean) * axis[:, None]).sum(2)
    rows = np.arange(n)
    # a final scale of 31 / 64 stands between the ends and half bits
    to_end = lambda h: endpoint(np.clip((h * 64 + 16) / 31, 0, 65535))
    ends = np.stack([to_end(half[rows, along.argmin(1)]), to_end(half[rows, along.argmax(1)])], 1)
    index, error = _fit(half, ends)
    for _ in range(rounds):
        w = WEIGHTS[index] / 64.0
        a, b, c = ((1 - w) ** 2).sum(1), (w * (1 - w)).sum(1), (w**2).sum(1)
        p, q = (half * (1 - w)[:, :, None]).sum(1), (half * w[:, :, None]).sum(1)
        det = a * c - b * b
        safe = np.where(det > 1e-9, det, 1.0)[:, None]
        new = np.stack([to_end((c[:, None] * p - b[:, None] * q) / safe), to_end((a[:, None] * q - b[:, None] * p) / safe)], 1)
        other, less = _fit(half, new)
        better = (less < error) & (det > 1e-9)
        ends[better], index[better], error[better] = new[better], other[better], less[better]
    swap = index[:, 0] >= 8
    ends[swap] = ends[swap][:, ::-1]
    index[swap] = 15 - index[swap]
    out = bytearray()
    for e, i in zip(ends.tolist(), index.tolist(), strict=True):
        bits, at = MODE, 5
        for v in e[0] + e[1]:
            bits |= v << at
            at += 10
        for k, v in enumerate(i):
            bits |= v << at
            at += 4 if k else 3
        out += bits.to_bytes(16, "little")
    return bytes(out)


def decode(data: bytes) -> np.ndarray:
    """Blocks x 16 texels x 3 channels as floats."""
    ends, index, good = [], [], []
    for at in range(0, len(data) // 16 * 16, 16):
        bits = int.from_bytes(data[at : at + 16], "little")
        good.append(bits & 31 == MODE)
        v = [bits >> 5 + 10 * k & 1023 for k in range(6)]
        ends.append([v[:3], v[3:]])
        index.append([bits >> 65 & 7, *(bits >> 68 + 4 * k & 15 for k in range(15))])
    if not ends:
        return np.zeros((0, 16, 3))
    half = np.take_along_axis(palette(np.array(ends, np.int64)), np.array(index)[:, :, None], 1)
    return from_half(half * np.array(good)[:, None, None])
