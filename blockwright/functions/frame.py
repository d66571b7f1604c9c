"""Frames: independent blocks behind a table of their ends, so that any block can be read by itself.

Header: magic, block size (32 bits), raw size (64 bits), the end offset of each block (64 bits), all little-endian.
Version 1 blocks are plain, or stored if as long as their raw bytes; version 2 blocks start with a method byte (0 stored,
1 plain, 2 entropy, 3 turbo; bit 7: filtered machine code).
"""

from __future__ import annotations

import itertools
import struct
from collections.abc import Callable
from dataclasses import dataclass

from blockwright.functions import CorruptData, entropy, lz, turbo, x86

#: Fixed values of the format: the first word of frames of version 1 and 2.
MAGIC_1, MAGIC_2 = 0x3150415A, 0x3250415A
STORED, PLAIN, ENTROPY, TURBO = range(4)
FILTERED = 0x80
BLOCK = 64 << 10

_CODECS = {PLAIN: lz, ENTROPY: entropy, TURBO: turbo}


@dataclass(frozen=True)
class Block:
    """One block of a frame: where it lies after the table, and what it holds."""

    number: int
    method: int
    filtered: bool
    start: int
    end: int
    raw_len: int


def encode_block(data: bytes, methods: tuple[int, ...], version: int) -> bytes:
    """The shortest of stored and the given methods; the earlier one of equals. Filtered if that saves half a percent."""
    if version == 1:
        coded = lz.encode(data)
        return coded if len(coded) < len(data) else data
    best = bytes([STORED]) + data
    for m in methods:
        coded = bytes([m]) + _CODECS[m].encode(data)
        best = min(best, coded, key=len)
    if x86.worthwhile(data):
        turned = x86.apply(data, True)[0]
        for m in methods:
            coded = bytes([m | FILTERED]) + _CODECS[m].encode(turned)
            if len(coded) < len(best) - len(best) // 200:
                best = coded
    return best


def decode_block(coded: bytes, raw_len: int, version: int) -> bytes:
    if version == 1:
        return coded if len(coded) == raw_len else lz.decode(coded, raw_len)
    if not coded:
        raise CorruptData("a block without method")
    method, body = coded[0] & ~FILTERED, coded[1:]
    if method == STORED:
        out = body
    elif method in _CODECS:
        out = _CODECS[method].decode(body, raw_len)
    else:
        raise CorruptData("unknown method")
    if len(out) != raw_len:
        raise CorruptData("a block of another size")
    return x86.apply(out, False)[0] if coded[0] & FILTERED else out


def header(block_size: int, raw_size: int, sizes: list[int], version: int) -> bytes:
    """What stands before the blocks of these coded sizes."""
    ends = list(itertools.accumulate(sizes))
    return struct.pack(f"<IIQ{len(ends)}Q", MAGIC_1 if version == 1 else MAGIC_2, block_size, raw_size, *ends)


def assemble(blocks: list[bytes], block_size: int, raw_size: int, version: int) -> bytes:
    """A frame of coded blocks."""
    return header(block_size, raw_size, [len(b) for b in blocks], version) + b"".join(blocks)


def encode(data: bytes, block_size: int = BLOCK, methods: tuple[int, ...] = ()) -> bytes:
    """A frame: version 1 without methods, else version 2 that tries them."""
    version = 2 if methods else 1
    return assemble([encode_block(data[i : i + block_size], methods, version) for i in range(0, len(data), block_size)], block_size, len(data), version)


def index(src: bytes) -> tuple[int, int, list[Block]]:
    """(version, raw size, blocks) of a frame whose header and table hold together."""
    return index_of(src, len(src), src.__getitem__)


def index_of(head: bytes, total: int, byte_at: Callable[[int], int]) -> tuple[int, int, list[Block]]:
    """The same of a frame of ``total`` bytes of which ``head`` holds header and table; ``byte_at`` gives a block's method."""
    if len(head) < 16:
        raise CorruptData("frame cut short")
    magic, size, raw = struct.unpack_from("<IIQ", head)
    if magic not in (MAGIC_1, MAGIC_2) or not 0 < size <= 1 << 31:
        raise CorruptData("not a frame")
    version, n = (1 if magic == MAGIC_1 else 2), -(-raw // size)
    if n > (len(head) - 16) // 8:
        raise CorruptData("block table cut short")
    ends = struct.unpack_from(f"<{n}Q", head, 16)
    base, last, out = 16 + 8 * n, 0, []
    for i, end in enumerate(ends):
        length = min(size, raw - i * size)
        if end < last or end - last > length + (version == 2) or (version == 2 and end == last) or base + end > total:
            raise CorruptData("block ends out of order")
        first = byte_at(base + last) if version == 2 else (STORED if end - last == length else PLAIN)
        out.append(Block(i, first & ~FILTERED, bool(first & FILTERED) and version == 2, base + last, base + end, length))
        last = end
    return version, raw, out


def decode(src: bytes) -> bytes:
    version, _, blocks = index(src)
    return b"".join(decode_block(src[b.start : b.end], b.raw_len, version) for b in blocks)
