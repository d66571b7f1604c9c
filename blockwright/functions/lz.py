"""Plain blocks: literal runs and matches, one token byte each.

Token: literal length in the high half, match length - 4 in the low half; 15 goes on with bytes of 255 and a final
smaller one. Offsets take 2 bytes below 0x8000, else 3. The last sequence has literals only.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterable, Iterator

import numpy as np

from blockwright.functions import CorruptData

#: Fixed values of the format: least match, bytes at the end where none starts, first 3-byte offset, largest offset.
LEAST = 4
TAIL = 12
FAR = 0x8000
REACH = (1 << 23) - 1


def common(data: bytes, a: int, b: int, limit: int) -> int:
    """Length of the common prefix of the suffixes at a and b, at most ``limit``."""
    n, step = 0, 64
    while step:
        if n + step <= limit and data[a + n : a + n + step] == data[b + n : b + n + step]:
            n += step
        else:
            step //= 2
    return n


def candidates(data: bytes, start: int) -> tuple[list[int], np.ndarray]:
    """Positions from ``start`` on whose 4 bytes occur before, and the nearest such place of every position."""
    from blockwright.operators.matching import previous_occurrence

    before = previous_occurrence(data)
    n = max(len(data) - TAIL, 0)
    at = np.flatnonzero(before[:n] >= 0)
    at = at[(at >= start) & (at - before[at] <= REACH)]
    return at.tolist(), before


def sequences(data: bytes, start: int = 0) -> Iterator[tuple[int, int, int]]:
    """Greedy parse: (literals, match length, offset); the last one has match length and offset 0."""
    at, before = candidates(data, start)
    done, i, end = start, 0, len(data) - 5
    while i < len(at):
        p = at[i]
        q = int(before[p])
        n = common(data, q, p, end - p)
        if n < LEAST + (p - q >= FAR):
            i += 1
            continue
        while p > done and q > 0 and data[p - 1] == data[q - 1]:
            p, q, n = p - 1, q - 1, n + 1
        yield p - done, n, p - q
        done = p + n
        i = bisect.bisect_left(at, done, i)
    yield len(data) - done, 0, 0


def extended(v: int) -> bytes:
    """What follows a token field of 15."""
    return b"" if v < 15 else b"\xff" * ((v - 15) // 255) + bytes([(v - 15) % 255])


def encode(data: bytes, dictionary: bytes = b"") -> bytes:
    """A plain block of the greedy parse; ``dictionary`` is history before it."""
    whole = dictionary + data
    return write(whole, sequences(whole, len(dictionary)), len(dictionary))


def write(whole: bytes, parse: Iterable[tuple[int, int, int]], start: int = 0) -> bytes:
    """A plain block of a parse of ``whole`` from ``start`` on."""
    at, out = start, bytearray()
    for lits, n, off in parse:
        m = n - LEAST if n else 0
        out.append(min(lits, 15) << 4 | min(m, 15))
        out += extended(lits) + whole[at : at + lits]
        at += lits + n
        if n:
            out += off.to_bytes(2, "little") if off < FAR else (off & 0x7FFF | FAR).to_bytes(2, "little") + bytes([off >> 15])
            out += extended(m)
    return bytes(out)


def copy_match(out: bytearray, off: int, n: int) -> None:
    """Appends n bytes from ``off`` before the end; they may overlap what is written."""
    if not 0 < off <= len(out):
        raise CorruptData("offset outside of the history")
    if off >= n:
        out += out[len(out) - off : len(out) - off + n]
    else:
        part = bytes(out[-off:])
        out += (part * (n // off + 1))[:n]


_MORE = re.compile(rb"\xff*[^\xff]", re.S)


def take_extension(src: bytes, at: int) -> tuple[int, int]:
    """(value, next position) of what follows a field of 15."""
    m = _MORE.match(src, at)
    if not m:
        raise CorruptData("length goes on past the end")
    return 255 * (m.end() - at - 1) + src[m.end() - 1], m.end()


def decode(src: bytes, size: int, dictionary: bytes = b"") -> bytes:
    """The ``size`` bytes of a plain block."""
    out, at, total = bytearray(dictionary), 0, size + len(dictionary)
    while True:
        if at >= len(src):
            raise CorruptData("block ends before its last sequence")
        token = src[at]
        at += 1
        n = token >> 4
        if n == 15:
            more, at = take_extension(src, at)
            n += more
        if at + n > len(src) or len(out) + n > total:
            raise CorruptData("literals past the end")
        out += src[at : at + n]
        at += n
        if at == len(src):
            break
        if at + 2 > len(src):
            raise CorruptData("offset past the end")
        off = src[at] | src[at + 1] << 8
        at += 2
        if off & FAR:
            if at >= len(src):
                raise CorruptData("offset past the end")
            off = off & 0x7FFF | src[at] << 15
            at += 1
        n = token & 15
        if n == 15:
            more, at = take_extension(src, at)
            n += more
        n += LEAST
        if len(out) + n > total:
            raise CorruptData("match past the end")
        copy_match(out, off, n)
    if len(out) != total:
        raise CorruptData("block is shorter than it should be")
    return bytes(out[len(dictionary) :])
