"""Archives of frames and clips of packets: layouts, checks, lookups. All fields are little-endian."""

from __future__ import annotations

import bisect
import struct
from dataclasses import dataclass

import numpy as np

from blockwright.functions import CorruptData, frame

#: Fixed values of the formats: first bytes, header sizes, versions, sizes of directory entries.
ARCHIVE_MAGIC = b"ZPAK"
ARCHIVE_HEADER, ENTRY, ARCHIVE_VERSION = 32, 32, 1
CLIP_MAGIC = (0x5650415A, 0x4449)
CLIP_HEADER, FRAME_ENTRY, CLIP_VERSION = 48, 16, 1


@dataclass(frozen=True)
class File:
    """A file of an archive: name, place of its frame, sizes."""

    name: str
    offset: int
    stored_size: int
    raw_size: int


def archive_header(count: int, directory_at: int, directory_size: int) -> bytes:
    return struct.pack("<4sIIIQQ", ARCHIVE_MAGIC, ARCHIVE_VERSION, count, 0, directory_at, directory_size)


def archive_entries(files: list[tuple[bytes, int, int, int]]) -> bytes:
    """The directory of files (name, offset, stored size, raw size) in bytewise order of names, each of which is there once."""
    entries, text = [], bytearray()
    for i, (name, at, size, raw) in enumerate(files):
        if i and files[i - 1][0] >= name:
            raise ValueError("a name occurs twice" if files[i - 1][0] == name else "names out of order")
        entries.append(struct.pack("<QQQII", at, size, raw, len(text), len(name)))
        text += name
    return b"".join(entries) + bytes(text)


def write_archive(frames: dict[str, tuple[bytes, int]] | list[tuple[str, tuple[bytes, int]]]) -> bytes:
    """An archive of frames: (name, (frame, raw size)), laid out in bytewise order of names; a name that occurs twice is an error."""
    pairs = sorted(((n.encode(), f) for n, f in (frames.items() if isinstance(frames, dict) else frames)), key=lambda x: x[0])
    at, files = ARCHIVE_HEADER, []
    for name, (data, raw) in pairs:
        files.append((name, at, len(data), raw))
        at += len(data)
    toc = archive_entries(files)
    return archive_header(len(files), at, len(toc)) + b"".join(f[0] for _, f in pairs) + toc


def read_archive(src: bytes) -> list[File]:
    """The directory of an archive whose parts lie inside it."""
    toc = int.from_bytes(src[16:24], "little")
    return archive_directory(src[:ARCHIVE_HEADER], src[toc:] if toc <= len(src) else b"", len(src))


def archive_directory(head: bytes, directory: bytes, total: int) -> list[File]:
    """The same of an archive of ``total`` bytes by its header and what follows the files."""
    if len(head) < ARCHIVE_HEADER:
        raise CorruptData("archive cut short")
    magic, version, count, _, toc, size = struct.unpack_from("<4sIIIQQ", head)
    if magic != ARCHIVE_MAGIC or version != ARCHIVE_VERSION or toc < ARCHIVE_HEADER or toc > total or size != total - toc or size != len(directory) or count > size // ENTRY:
        raise CorruptData("not an archive")
    names = directory[count * ENTRY :]
    out = []
    for i in range(count):
        at, stored, raw, name_at, name_len = struct.unpack_from("<QQQII", directory, i * ENTRY)
        if at < ARCHIVE_HEADER or at + stored > toc or name_at + name_len > len(names):
            raise CorruptData("entry outside of the archive")
        out.append(File(names[name_at : name_at + name_len].decode("utf-8", "replace"), at, stored, raw))
    return out


def archive_places(head: bytes, total: int) -> tuple[int, int, int]:
    """(number of files, place of the directory, place of the names) of an archive of ``total`` bytes by its header."""
    if len(head) < ARCHIVE_HEADER:
        raise CorruptData("archive cut short")
    magic, version, count, _, toc, size = struct.unpack_from("<4sIIIQQ", head)
    if magic != ARCHIVE_MAGIC or version != ARCHIVE_VERSION or toc < ARCHIVE_HEADER or toc > total or size != total - toc or count > size // ENTRY:
        raise CorruptData("not an archive")
    return count, toc, toc + count * ENTRY


def archive_slice(directory: bytes, toc: int, names: int) -> np.ndarray:
    """Some entries (at, stored, raw, name_at, name_len) of a directory at ``toc`` with so many bytes of names."""
    out = np.frombuffer(directory, np.dtype([("at", "<u8"), ("stored", "<u8"), ("raw", "<u8"), ("name_at", "<u4"), ("name_len", "<u4")]))
    if (out["at"] < ARCHIVE_HEADER).any() or (out["at"] > toc).any() or (out["stored"] > toc - out["at"]).any() or (out["name_at"].astype(np.int64) + out["name_len"] > names).any():
        raise CorruptData("entry outside of the archive")
    return out


def find(files: list[File], name: str) -> int:
    """Index of a name in a sorted directory, -1 if absent."""
    keys = [f.name.encode() for f in files]
    i = bisect.bisect_left(keys, name.encode())
    return i if i < len(keys) and keys[i] == name.encode() else -1


def read_file(src: bytes, f: File) -> bytes:
    out = frame.decode(src[f.offset : f.offset + f.stored_size])
    if len(out) != f.raw_size:
        raise CorruptData("a file of another size")
    return out


@dataclass(frozen=True)
class Clip:
    """Header of a clip: colour tag, size, rate, keyframe interval, and its packets (offset, size, is key)."""

    colour: int
    width: int
    height: int
    rate: tuple[int, int]
    interval: int
    packets: tuple[tuple[int, int, bool], ...]


def clip_header(count: int, width: int, height: int, rate: tuple[int, int], colour: int, index_at: int, interval: int = 0) -> bytes:
    return struct.pack("<IHBBHHIIIIQQI", *CLIP_MAGIC, CLIP_VERSION, colour & 3, width, height, *rate, count, interval, index_at, FRAME_ENTRY * count, 0)


def clip_frame(packets: list[tuple[int, int, bool]], width: int, height: int, rate: tuple[int, int], colour: int, index_at: int, interval: int = 0) -> tuple[bytes, bytes]:
    """(header, index) of packets (offset, size, is key)."""
    index = b"".join(struct.pack("<QII", at, size, int(key)) for at, size, key in packets)
    return clip_header(len(packets), width, height, rate, colour, index_at, interval), index


def write_clip(packets: list[tuple[bytes, bool]], width: int, height: int, rate: tuple[int, int], interval: int, colour: int = 0) -> bytes:
    """A clip: header, packets, then the index."""
    at, places = CLIP_HEADER, []
    for p, key in packets:
        places.append((at, len(p), key))
        at += len(p)
    head, index = clip_frame(places, width, height, rate, colour, at, interval)
    return head + b"".join(p for p, _ in packets) + index


def clip_index_place(head: bytes, total: int) -> int:
    """Where the index of a clip of ``total`` bytes begins."""
    if len(head) < CLIP_HEADER:
        raise CorruptData("clip cut short")
    return min(struct.unpack_from("<IHBBHHIIIIQQI", head)[10], total)


def read_clip(src: bytes) -> Clip:
    return clip_directory(src[:CLIP_HEADER], src[clip_index_place(src[:CLIP_HEADER], len(src)) :], len(src))


def clip_head(head: bytes, total: int) -> tuple[Clip, int, int]:
    """(clip without its packets, their number, place of the index) of a clip of ``total`` bytes by its header."""
    if len(head) < CLIP_HEADER:
        raise CorruptData("clip cut short")
    a, b, version, colour, w, h, num, den, n, interval, at, size, _ = struct.unpack_from("<IHBBHHIIIIQQI", head)
    if (a, b) != CLIP_MAGIC or version != CLIP_VERSION or colour > 3:
        raise CorruptData("not a clip")
    if min(w, h) < 2 or w % 2 or h % 2 or not num or not den or not n or size != FRAME_ENTRY * n or at < CLIP_HEADER or at + size > total:
        raise CorruptData("header does not hold together")
    return Clip(colour, w, h, (num, den), interval, ()), n, at


def clip_slice(index: bytes, index_at: int) -> np.ndarray:
    """Some entries (at, size, flags) of an index at ``index_at``."""
    out = np.frombuffer(index, np.dtype([("at", "<u8"), ("size", "<u4"), ("flags", "<u4")]))
    if (out["at"] < CLIP_HEADER).any() or (out["at"] > index_at).any() or (out["size"] > index_at - out["at"]).any():
        raise CorruptData("packet outside of the clip")
    return out


def clip_directory(head: bytes, index: bytes, total: int) -> Clip:
    """A clip of ``total`` bytes by its header and what follows the packets."""
    clip, n, at = clip_head(head, total)
    if FRAME_ENTRY * n > len(index):
        raise CorruptData("header does not hold together")
    packets = []
    for i in range(n):
        o, s, flags = struct.unpack_from("<QII", index, FRAME_ENTRY * i)
        if o < CLIP_HEADER or o + s > at:
            raise CorruptData("packet outside of the clip")
        packets.append((o, s, bool(flags & 1)))
    if not packets[0][2]:
        raise CorruptData("the first packet is no keyframe")
    return Clip(clip.colour, clip.width, clip.height, clip.rate, clip.interval, tuple(packets))


def keyframe(clip: Clip, i: int) -> int:
    """Number of the last keyframe at or before packet i."""
    return max((k for k in range(i + 1) if clip.packets[k][2]), default=0)
