"""Containers as Spark data sources: the driver looks at directories to deal them out, tasks read their own part of a directory and
its payloads; sinks likewise.

``register(spark)`` makes these formats known: ``frames`` (blocks), ``archives`` (files), ``clips`` (packets), ``records`` (raw
frames or images of a fixed size), and, to write only, ``textures`` (levels). No task holds more than one block, file,
packet or record at a time and what it reads ahead, and a container is never held whole: a sink's tasks write what they code to parts
beside the target, each with an index in sorted runs, and the commit merges the runs and puts header, directory and parts together in
order, as a stream, under another name that is then renamed. The driver holds a few numbers for each task and run, never a row for
each piece. A failed job leaves neither parts nor target. Paths are opened through Arrow's file systems (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import heapq
import itertools
import pickle
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyarrow import fs as afs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from blockwright.functions import CorruptData, containers, frame, texture

#: Bytes and pieces that a task of a source reads; bytes that are copied at a time, and that are read ahead.
TASK_BYTES, TASK_PIECES = 32 << 20, 1 << 18
COPY, AHEAD = 8 << 20, 1 << 20
#: Pieces of a sorted run of a part's index, and of what is read of it at a time; directory entries that are looked at together.
RUN, CHUNK, LOOK = 1 << 16, 1 << 10, 1 << 16


def _open(path: str) -> tuple[afs.FileSystem, str]:
    return afs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (afs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of all files below a folder, sorted."""
    system, at = _open(path)
    info = system.get_file_info(at)
    if info.type == afs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == afs.FileType.File else [f for f in system.get_file_info(afs.FileSelector(at, recursive=True)) if f.type == afs.FileType.File]
    return sorted((f.path, f.size) for f in found)


@dataclass
class Pieces(InputPartition):
    """Pieces of one file of so many bytes: those numbered from ``first`` up to ``end``."""

    file: str
    size: int
    first: int
    end: int

    def __init__(self, file: str, size: int, first: int, end: int):
        self.file, self.size, self.first, self.end = file, size, first, end


def _cuts(sizes: Iterator[np.ndarray], most: int) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of pieces; each but the last reaches ``most`` bytes or TASK_PIECES pieces."""
    first = at = held = 0
    for n in sizes:
        i, total = 0, np.cumsum(n)
        while i < len(n):
            gone = int(total[i - 1]) if i else 0
            j = min(int(np.searchsorted(total, gone + most - held)) + 1, i + TASK_PIECES - (at + i - first))
            if j > len(n):
                held += int(total[-1]) - gone
                break
            yield first, at + j
            first, i, held = at + j, j, 0
        at += len(n)
    if first < at:
        yield first, at


class _Ahead:
    """Reads of a file that mostly go forward, a piece at a time."""

    def __init__(self, f):
        self.f, self.at, self.data = f, 0, b""

    def __call__(self, at: int, n: int) -> bytes:
        i = at - self.at
        if i < 0 or i + n > len(self.data):
            self.at, self.data, i = at, self.f.read_at(max(n, AHEAD), at), 0
        return self.data[i : i + n]


class _Reader(DataSourceReader):
    """Deals directories out on the driver; tasks read their part of one and its payloads.

    ``look(read, size)`` gives the sizes of all pieces of a file of ``size`` bytes, some at a time; ``rows(read, size, a, b)`` gives
    (row without payload, (place, size)) of those numbered a to b.
    """

    def __init__(self, options: dict, look: Callable, rows: Callable, finish: Callable):
        self.path, self.payload = options["path"], str(options.get("payload", "true")).lower() == "true"
        self.task_bytes = int(options.get("taskbytes", options.get("taskBytes", TASK_BYTES)))
        self.look, self.rows, self.finish = look, rows, finish

    def partitions(self) -> list[InputPartition]:
        system, _ = _open(self.path)
        out: list[InputPartition] = []
        for name, size in _files(self.path):
            with system.open_input_file(name) as f:
                out += [Pieces(name, size, a, b) for a, b in _cuts(self.look(lambda at, n, f=f: f.read_at(n, at), size), self.task_bytes)]
        return out

    def read(self, partition: Pieces) -> Iterator[tuple]:
        system, _ = _open(self.path)
        with system.open_input_file(partition.file) as f:
            payload = _Ahead(f)
            for row, (at, size) in self.rows(lambda at, n: f.read_at(n, at), partition.size, partition.first, partition.end):
                data, error = None, None
                if self.payload:
                    try:
                        data = self.finish(row, payload(at, size))
                    except CorruptData as e:
                        error = str(e)
                yield (partition.file, *row, data, error)


@dataclass
class Written(WriterCommitMessage):
    """A part, the runs of its index (first and last order, place, number of chunks), and sums over its pieces (see ``count``)."""

    part: str
    runs: list[tuple] = field(default_factory=list)
    sums: list[int] = field(default_factory=list)


class _Writer(DataSourceWriter):
    """Tasks code rows into parts; the commit lays them out. Subclasses say how a row is coded and what stands around the pieces."""

    def __init__(self, options: dict, overwrite: bool):
        self.options, self.path = dict(options), options["path"]
        system, at = _open(self.path)
        if not overwrite and system.get_file_info(at).type != afs.FileType.NotFound:
            raise FileExistsError(self.path)
        self.parts = f"{at}.parts-{uuid.uuid4().hex}"

    def code(self, row: Row) -> tuple[tuple, tuple, bytes]:
        """(order, what the directory needs, payload)."""
        raise NotImplementedError

    def count(self, order: tuple, directory: tuple, size: int) -> tuple[int, ...]:
        """What ``layout`` needs the sums of over all pieces."""
        return 1, size

    def layout(self, pieces: Callable[[], Iterator[tuple]], sums: list[int]) -> Iterator[bytes | tuple]:
        """The file from its start: bytes, or pieces (order, directory, part, place, size) to be copied. ``pieces`` goes over all in order."""
        raise NotImplementedError

    def write(self, iterator: Iterator[Row]) -> Written:
        system, _ = _open(self.path)
        system.create_dir(self.parts, recursive=True)
        out, at, index_at, waiting, held = Written(f"{self.parts}/{uuid.uuid4().hex}"), 0, 0, [], 0
        with system.open_output_stream(out.part) as f, system.open_output_stream(f"{out.part}.index") as g:
            while run := list(itertools.islice(map(self.code, iterator), RUN)):
                entries = []
                for order, directory, data in run:
                    entries.append((order, directory, at, len(data)))
                    at += len(data)
                    waiting.append(data)
                    held += len(data)
                    if held >= AHEAD:
                        f.write(b"".join(waiting))
                        waiting, held = [], 0
                counted = [sum(x) for x in zip(*(self.count(o, d, n) for o, d, _, n in entries), strict=True)]
                out.sums = [a + b for a, b in zip(out.sums, counted, strict=True)] if out.sums else counted
                entries.sort(key=lambda e: e[0])
                chunks = [pickle.dumps(entries[i : i + CHUNK]) for i in range(0, len(entries), CHUNK)]
                out.runs.append((entries[0][0], entries[-1][0], index_at, len(chunks)))
                for c in chunks:
                    g.write(len(c).to_bytes(8, "little") + c)
                    index_at += 8 + len(c)
            f.write(b"".join(waiting))
        return out

    def _run(self, part: str, place: int, chunks: int) -> Iterator[tuple]:
        system, _ = _open(self.path)
        with system.open_input_file(f"{part}.index") as f:
            for _ in range(chunks):
                n = int.from_bytes(f.read_at(8, place), "little")
                for order, directory, at, size in pickle.loads(f.read_at(n, place + 8)):
                    yield order, directory, part, at, size
                place += 8 + n

    def _merged(self, messages: list[Written]) -> Iterator[tuple]:
        """All pieces in order; runs that follow one another are read one after the other, only others side by side."""
        lines: list[tuple[tuple, list]] = []
        for first, last, part, place, chunks in sorted((*r[:2], m.part, *r[2:]) for m in messages for r in m.runs):
            free = lines and lines[0][0] < first
            heapq.heapreplace(lines, (last, [*lines[0][1], (part, place, chunks)])) if free else heapq.heappush(lines, (last, [(part, place, chunks)]))
        streams = [itertools.chain.from_iterable(self._run(*r) for r in own) for _, own in lines]
        before = None
        for p in streams[0] if len(streams) == 1 else heapq.merge(*streams):
            if p[0] == before:
                raise ValueError(f"two pieces are called {before}")
            before = p[0]
            yield p

    def commit(self, messages: list[Written]) -> None:
        system, at = _open(self.path)
        try:
            messages = [m for m in messages if m and m.runs]
            sums = [sum(x) for x in zip(*(m.sums for m in messages), strict=True)]
            whole = f"{self.parts}/whole"
            system.create_dir(self.parts, recursive=True)
            with system.open_output_stream(whole) as out:
                handle, name, first, end = None, None, 0, 0

                def copy() -> None:
                    for a in range(first, end, COPY):
                        out.write(handle.read_at(min(COPY, end - a), a))

                for x in self.layout(lambda: self._merged(messages), sums):
                    if isinstance(x, bytes):
                        copy()
                        first = end
                        out.write(x)
                        continue
                    _, _, part, place, size = x
                    if part != name or place != end or end - first >= COPY:
                        copy()
                        if part != name:
                            handle, name = system.open_input_file(part), part
                        first = place
                    end = place + size
                copy()
            if system.get_file_info(at).type == afs.FileType.File:
                system.delete_file(at)
            system.move(whole, at)
        finally:
            self.abort(messages)

    def abort(self, messages: list[Written]) -> None:
        system, _ = _open(self.path)
        if system.get_file_info(self.parts).type == afs.FileType.Directory:
            system.delete_dir(self.parts)


def _packed(entries: Iterator[bytes]) -> Iterator[bytes]:
    """Small entries, some together."""
    while some := list(itertools.islice(entries, LOOK)):
        yield b"".join(some)


class Frames(DataSource):
    """Blocks of frames. To write: rows of (block_no, data), each but the last of the option ``block`` bytes; ``methods`` by number."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return "path string, block_no long, version int, method int, filtered boolean, start long, end long, raw_len long, data binary, error string"

    def reader(self, schema) -> DataSourceReader:
        def index(read, size: int) -> tuple:
            head = read(0, 16)
            blocks = -(-int.from_bytes(head[8:16], "little") // max(int.from_bytes(head[4:8], "little"), 1)) if len(head) == 16 else 0
            return frame.index_of(head + read(16, min(8 * blocks, size)), size, lambda at: read(at, 1)[0])

        def look(read, size: int) -> Iterator[np.ndarray]:
            yield np.array([b.end - b.start for b in index(read, size)[2]], np.int64)

        def rows(read, size: int, a: int, b: int) -> Iterator[tuple]:
            version, _, found = index(read, size)
            for x in found[a:b]:
                yield (x.number, version, x.method, x.filtered, x.start, x.end, x.raw_len), (x.start, x.end - x.start)

        return _Reader(self.options, look, rows, lambda row, data: frame.decode_block(data, row[6], row[1]))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _FrameWriter(self.options, overwrite)


def _methods(options: dict) -> tuple[int, ...]:
    return tuple(int(x) for x in str(options.get("methods", "")).split(",") if x)


class _FrameWriter(_Writer):
    def code(self, row: Row) -> tuple[tuple, tuple, bytes]:
        methods = _methods(self.options)
        data = bytes(row["data"] or b"")
        return (row["block_no"],), (len(data),), frame.encode_block(data, methods, 2 if methods else 1)

    def count(self, order: tuple, directory: tuple, size: int) -> tuple[int, ...]:
        return 1, directory[0]

    def layout(self, pieces: Callable[[], Iterator[tuple]], sums: list[int]) -> Iterator[bytes | tuple]:
        block = int(self.options.get("block", frame.BLOCK))
        blocks, raw = sums or (0, 0)

        def ends() -> Iterator[bytes]:
            at = 0
            for i, p in enumerate(pieces()):
                if p[0][0] != i or p[1][0] > block or p[1][0] != block and i < blocks - 1:
                    raise ValueError("blocks must be numbered from 0 and full but for the last")
                at += p[4]
                yield at.to_bytes(8, "little")

        yield frame.header(block, raw, [], 2 if _methods(self.options) else 1)
        yield from _packed(ends())
        yield from pieces()


class Archives(DataSource):
    """Files of archives. To write: rows of (name, block_no, data), the blocks of each file as for frames (see ``cut``)."""

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return "path string, i long, name string, offset long, stored_size long, raw_size long, data binary, error string"

    def reader(self, schema) -> DataSourceReader:
        def entries(read, size: int, a: int, b: int) -> np.ndarray:
            head = read(0, containers.ARCHIVE_HEADER)
            count, toc, names = containers.archive_places(head, size)
            return containers.archive_slice(read(toc + a * containers.ENTRY, (min(b, count) - a) * containers.ENTRY), toc, size - names)

        def look(read, size: int) -> Iterator[np.ndarray]:
            count, _, _ = containers.archive_places(read(0, containers.ARCHIVE_HEADER), size)
            for a in range(0, count, LOOK):
                yield entries(read, size, a, a + LOOK)["stored"].astype(np.int64)

        def rows(read, size: int, a: int, b: int) -> Iterator[tuple]:
            _, _, names = containers.archive_places(read(0, containers.ARCHIVE_HEADER), size)
            for c in range(a, b, LOOK):
                own = entries(read, size, c, min(c + LOOK, b))
                low = int(own["name_at"].min())
                text = read(names + low, int((own["name_at"].astype(np.int64) + own["name_len"]).max()) - low)
                for i, (at, stored, raw, name, n) in enumerate(own.tolist(), c):
                    yield (i, text[name - low : name - low + n].decode("utf-8", "replace"), at, stored, raw), (at, stored)

        return _Reader(self.options, look, rows, lambda row, data: frame.decode(data))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _ArchiveWriter(self.options, overwrite)


class _ArchiveWriter(_Writer):
    def code(self, row: Row) -> tuple[tuple, tuple, bytes]:
        methods = _methods(self.options)
        data = bytes(row["data"] or b"")
        return (row["name"].encode(), row["block_no"]), (len(data),), frame.encode_block(data, methods, 2 if methods else 1) if data else b""

    def count(self, order: tuple, directory: tuple, size: int) -> tuple[int, ...]:
        first = order[1] == 0
        return int(first), len(order[0]) if first else 0, size, int(directory[0] > 0)

    def layout(self, pieces: Callable[[], Iterator[tuple]], sums: list[int]) -> Iterator[bytes | tuple]:
        block, version = int(self.options.get("block", frame.BLOCK)), 2 if _methods(self.options) else 1
        count, names, stored, full_blocks = sums or (0, 0, 0, 0)

        def files() -> Iterator[tuple[bytes, list[tuple], bytes, int, int]]:
            """(name, blocks, header, stored size, raw size), a file at a time."""
            for name, own in itertools.groupby(pieces(), key=lambda p: p[0][0]):
                own = list(own)
                if [p[0][1] for p in own] != list(range(len(own))) or any(p[1][0] != block for p in own[:-1]) or own[-1][1][0] > block:
                    raise ValueError(f"blocks of {name.decode()} must be numbered from 0 and full but for the last")
                full = [p for p in own if p[1][0]]
                raw = sum(p[1][0] for p in full)
                head = frame.header(block, raw, [p[4] for p in full], version)
                yield name, full, head, len(head) + sum(p[4] for p in full), raw

        def entries() -> Iterator[bytes]:
            at, name_at = containers.ARCHIVE_HEADER, 0
            for name, _, _, size, raw in files():
                yield struct.pack("<QQQII", at, size, raw, name_at, len(name))
                at, name_at = at + size, name_at + len(name)

        heads = count * len(frame.header(block, 0, [], version)) + 8 * full_blocks
        yield containers.archive_header(count, containers.ARCHIVE_HEADER + heads + stored, count * containers.ENTRY + names)
        for _, full, head, _, _ in files():
            yield head
            yield from full
        yield from _packed(entries())
        yield from _packed(name for name, *_ in files())


class Clips(DataSource):
    """Packets of clips. To write: rows of (frame_no, packet, is_key); options width, height, rate ("30" or "30000/1001"), interval of keyframes, tag."""

    @classmethod
    def name(cls) -> str:
        return "clips"

    def schema(self) -> str:
        return "path string, frame_no long, offset long, size long, is_key boolean, width int, height int, fps double, data binary, error string"

    def reader(self, schema) -> DataSourceReader:
        def look(read, size: int) -> Iterator[np.ndarray]:
            c, count, index_at = containers.clip_head(read(0, containers.CLIP_HEADER), size)
            for a in range(0, count, LOOK):
                part = containers.clip_slice(read(index_at + a * containers.FRAME_ENTRY, min(LOOK, count - a) * containers.FRAME_ENTRY), index_at)
                if not a and not part["flags"][0] & 1:
                    raise CorruptData("the first packet is no keyframe")
                yield part["size"].astype(np.int64)

        def rows(read, size: int, a: int, b: int) -> Iterator[tuple]:
            c, _, index_at = containers.clip_head(read(0, containers.CLIP_HEADER), size)
            for k in range(a, b, LOOK):
                part = containers.clip_slice(read(index_at + k * containers.FRAME_ENTRY, (min(k + LOOK, b) - k) * containers.FRAME_ENTRY), index_at)
                for i, (o, n, flags) in enumerate(part.tolist(), k):
                    yield (i, o, n, bool(flags & 1), c.width, c.height, c.rate[0] / c.rate[1]), (o, n)

        return _Reader(self.options, look, rows, lambda row, data: data)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _ClipWriter(self.options, overwrite)


class _ClipWriter(_Writer):
    def code(self, row: Row) -> tuple[tuple, tuple, bytes]:
        return (row["frame_no"],), (bool(row["is_key"]),), bytes(row["packet"])

    def layout(self, pieces: Callable[[], Iterator[tuple]], sums: list[int]) -> Iterator[bytes | tuple]:
        num, _, den = str(self.options.get("rate", "30")).partition("/")
        count, stored = sums or (0, 0)
        yield containers.clip_header(count, int(self.options["width"]), int(self.options["height"]), (int(num), int(den or 1)), int(self.options.get("tag", 0)), containers.CLIP_HEADER + stored, int(self.options.get("interval", 0)))
        yield from pieces()

        def index() -> Iterator[bytes]:
            at = containers.CLIP_HEADER
            for p in pieces():
                yield struct.pack("<QII", at, p[4], int(p[1][0]))
                at += p[4]

        yield from _packed(index())


class Records(DataSource):
    """Records of a fixed size (option ``record``, or ``width`` and ``height`` with ``kind`` i420 or rgba8); a shorter rest is dropped."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return "path string, record_no long, data binary, error string"

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        pixels = int(o.get("width", 0)) * int(o.get("height", 0))
        size = int(o.get("record", 0)) or (pixels * 4 if o.get("kind", "i420") == "rgba8" else pixels * 3 // 2)
        if size < 1:
            raise ValueError("records need a size")

        def look(read, length: int) -> Iterator[np.ndarray]:
            for a in range(0, length // size, LOOK):
                yield np.full(min(LOOK, length // size - a), size, np.int64)

        def rows(read, length: int, a: int, b: int) -> Iterator[tuple]:
            for i in range(a, b):
                yield (i,), (i * size, size)

        return _Reader(self.options, look, rows, lambda row, data: data)


class Textures(DataSource):
    """To write: rows of (level, data) as a texture file; options format (a name of ``texture``, or astc), width, height, srgb."""

    @classmethod
    def name(cls) -> str:
        return "textures"

    def schema(self) -> str:
        return "level long, data binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _TextureWriter(self.options, overwrite)


class _TextureWriter(_Writer):
    def code(self, row: Row) -> tuple[tuple, tuple, bytes]:
        return (row["level"],), (), bytes(row["data"])

    def layout(self, pieces: Callable[[], Iterator[tuple]], sums: list[int]) -> Iterator[bytes | tuple]:
        pieces = list(pieces())  # a row for each level
        kind, w, h = str(self.options["format"]), int(self.options["width"]), int(self.options["height"])
        if kind == "astc":
            if len(pieces) != 1:
                raise ValueError("such a file holds one level")
            yield astc_header(w, h)
        else:
            yield texture.header(w, h, kind, len(pieces), str(self.options.get("srgb", "false")).lower() == "true")
        yield from pieces


def astc_header(width: int, height: int) -> bytes:
    """Magic, block of 4 x 4 x 1, size in 24 bits each, one layer."""
    return struct.pack("<I3B", 0x5CA1AB13, 4, 4, 1) + b"".join(v.to_bytes(3, "little") for v in (width, height, 1))


def register(spark: SparkSession) -> None:
    for source in (Frames, Archives, Clips, Records, Textures):
        spark.dataSource.register(source)


def cut(files: DataFrame, block: int = frame.BLOCK, name: str = "name", content: str = "content") -> DataFrame:
    """(name, block_no, data): contents as blocks, with one empty block of an empty file; no Python runs."""
    count = F.greatest(F.lit(1), F.ceil(F.length(content) / block)).cast("long")
    return files.select(F.col(name).alias("name"), F.coalesce(F.col(content), F.lit(b"")).alias("_c"), F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("block_no")).select(
        "name", "block_no", F.substring("_c", F.col("block_no").cast("int") * block + 1, block).alias("data")
    )
