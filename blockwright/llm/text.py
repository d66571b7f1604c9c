"""Vectorised text kernels shared by the operators: chunks of rows, words, hashes, distinct values.

Every kernel works on a chunk of whole rows at a time (at least one row, whatever its length), so that a
worker's memory follows ``limit`` and the longest single text, not the partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
#: Bytes that separate words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)

_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE (or its inverse) to the 0th, 1st, ... power modulo 2**64; at least n of them, kept for the next call."""
    have = _powers.get(inverse)
    if have is None or len(have) < n:
        m = max(n, 1 << 16, 0 if have is None else len(have) * 5 // 4)
        have = np.full(m, pow(BASE, -1, 1 << 64) if inverse else BASE, U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[inverse] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """Sums from which ``span_hash`` takes the hash of any span; one longer than ``symbols``."""
    out = np.zeros(len(symbols) + 1, U64)
    v = symbols.astype(U64)
    v += U64(1)
    v *= powers(len(symbols))
    np.cumsum(v, out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end); equal spans have equal hashes wherever they lie."""
    h = sums[ends] - sums[starts]
    h *= powers(len(sums), inverse=True)[starts]
    h += (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)
    return mix(h)


def ngram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values; k - 1 fewer than ``h``."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = h[:n] * U64(pow(BASE, k - 1, 1 << 64))
    for j in range(1, k):
        out += h[j : j + n] * U64(pow(BASE, k - 1 - j, 1 << 64))
    return mix(out)


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column with nulls as empty texts."""
    c = batch.column(batch.schema.get_field_index(name))
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return pc.fill_null(c, "") if c.null_count else c


def utf8(c: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each text in them (one more than texts), without a copy."""
    big = pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type)
    _, offsets, data = c.buffers()
    off = np.frombuffer(offsets, np.int64 if big else np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64) if len(c) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, off


def chunks(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges [lo, hi) whose texts take at most ``limit`` together, or one row that takes more."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def byte_chunks(batch: pa.RecordBatch, name: str, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, bytes, offsets from 0) of consecutive rows of a batch."""
    buf, off = utf8(text_column(batch, name))
    for lo, hi in chunks(off, limit):
        yield lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
    give_back()


#: The C library's function that returns free memory to the system, where there is one.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns what kernels have freed to the system, so that a reused worker does not keep the most that it ever held."""
    if _trim is not None:
        _trim(0)


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): words of each text; text i has words first[i] to first[i + 1]."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    w = ~SPACE[buf]
    edge = off[:-1][off[:-1] < n]
    start = w.copy()
    start[1:] &= ~w[:-1]
    start[edge] = w[edge]
    end = w.copy()
    end[:-1] &= ~w[1:]
    edge = edge[edge > 0] - 1
    end[edge] = w[edge]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_hash(buf), starts, ends)


def owners(first: np.ndarray) -> np.ndarray:
    """For each element the row that it belongs to."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, inverse): index of one element of each distinct hash, and for each element its class.

    Sorted by the high bits with the index in the low ones, which is several times faster than an argsort; the few
    neighbours with equal high bits and different hashes are put right afterwards.
    """
    n = len(h)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = U64(max(1, int(n - 1).bit_length()))
    mask = (U64(1) << bits) - U64(1)
    key = np.sort((h & ~mask) | np.arange(n, dtype=U64))
    idx = refine((key & mask).astype(np.int64), key >> bits, h)
    hs = h[idx]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(hs[1:], hs[:-1], out=new[1:])
    inverse = np.empty(n, np.int64)
    inverse[idx] = np.cumsum(new) - 1
    return idx[new], inverse


def refine(idx: np.ndarray, lead: np.ndarray, full: np.ndarray) -> np.ndarray:
    """``idx`` in exact order: within equal ``lead`` (ascending, cut short) by ``full``, then by index."""
    equal = lead[1:] == lead[:-1]
    wrong = equal & (full[idx[1:]] != full[idx[:-1]])
    if not wrong.any():
        return idx
    run = np.zeros(len(idx), np.int64)
    np.cumsum(~equal, out=run[1:])
    bad = np.zeros(int(run[-1]) + 1, bool)
    bad[run[1:][wrong]] = True
    sel = np.flatnonzero(bad[run])
    sub = idx[sel]
    idx[sel] = sub[np.lexsort((sub, full[sub], run[sel]))]
    return idx


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (length of them) of each range, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; bytes of equal significance lie together. Undone by ``unpack``."""
    head, body = [], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head.append(f"{a.dtype.str}:{len(a)}")
        body.append(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if a.dtype.itemsize > 1 else a.tobytes())
    h = ",".join(head).encode()
    return zstandard.ZstdCompressor(level=1).compress(len(h).to_bytes(4, "little") + h + b"".join(body))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:4], "little")
    out, at = [], 4 + n
    for part in raw[4 : 4 + n].decode().split(","):
        kind, size = part.split(":")
        dt, size = np.dtype(kind), int(size)
        b = np.frombuffer(raw, np.uint8, size * dt.itemsize, at)
        at += size * dt.itemsize
        out.append(np.ascontiguousarray(b.reshape(dt.itemsize, size).T).view(dt).reshape(size) if dt.itemsize > 1 else b.view(dt))
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    """Non-negative integers in the smallest unsigned type that holds them."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)
