"""Frames, archives, clips and raw records as tables. Files are read by Spark itself, so any of its file systems will do.

Directories are read without decoding; payloads decode in a later projection, block by block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwright.functions import CorruptData, containers, frame


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of a file or of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def entry_name(path: Column, root: str) -> Column:
    """Name of a file in an archive of a folder: the folder's own name stays as the first part."""
    above = root.rstrip("/").rsplit("/", 1)[0] + "/"
    bare = F.regexp_replace(path, "^[a-z]+:/*(?=/)", "")
    return F.translate(F.when(F.startswith(bare, F.lit(above)), F.substr(bare, F.lit(len(above) + 1))).otherwise(bare), "\\", "/")


def _explode(files: DataFrame, fn: Callable[[bytes], list[tuple]], fields: str) -> DataFrame:
    """(path, fields..., error): rows that ``fn`` finds in each file, or one row with the reason why there are none."""
    names = [f.split()[0] for f in fields.split(",")]
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = f"path string, {fields}, error string"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows = [(path, *r, None) for r in fn(content)]
                except CorruptData as e:
                    rows = [(path, *(None,) * len(names), str(e))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return files.select("path", "content").mapInArrow(run, schema)


def read_frames(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row for each block of each frame; without ``payload`` only the directory is looked at."""

    def blocks(src: bytes) -> list[tuple]:
        version, raw, found = frame.index(src)
        return [(b.number, version, b.method, b.filtered, b.start, b.end, b.raw_len, raw, src[b.start : b.end] if payload else None) for b in found]

    return _explode(binary_files(spark, path), blocks, "block_no long, version int, method int, filtered boolean, start long, end long, raw_len long, raw_size long, payload binary")


def decode_blocks(blocks: DataFrame) -> DataFrame:
    """``data`` of each block; null with a reason where it does not decode."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, errors = [], []
            for version, raw_len, payload in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                try:
                    data.append(frame.decode_block(payload, raw_len, version))
                    errors.append(None)
                except CorruptData as e:
                    data.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(data, pa.binary()), pa.array(errors, pa.string())], ["path", "block_no", "data", "error"])

    rows = blocks.where("error is null").select("path", "block_no", "version", "raw_len", "payload")
    return rows.mapInArrow(run, "path string, block_no long, data binary, error string")


def read_archives(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """One row for each file of each archive: the directory, with the frame itself if asked for."""

    def files(src: bytes) -> list[tuple]:
        return [(i, f.name, f.offset, f.stored_size, f.raw_size, src[f.offset : f.offset + f.stored_size] if content else None) for i, f in enumerate(containers.read_archive(src))]

    return _explode(binary_files(spark, path), files, "i long, name string, offset long, stored_size long, raw_size long, frame binary")


def read_clips(spark: SparkSession, path: str, packets: bool = True) -> DataFrame:
    """One row for each packet of each clip, with the clip's header."""

    def rows(src: bytes) -> list[tuple]:
        c = containers.read_clip(src)
        return [(i, o, s, k, c.width, c.height, c.rate[0] / c.rate[1], src[o : o + s] if packets else None) for i, (o, s, k) in enumerate(c.packets)]

    return _explode(binary_files(spark, path), rows, "frame_no long, offset long, size long, is_key boolean, width int, height int, fps double, packet binary")


def read_raw_frames(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """Planes of raw 4:2:0 frames; a rest shorter than a frame is dropped."""
    luma = width * height
    size = luma * 3 // 2

    def rows(src: bytes) -> list[tuple]:
        return [(i, src[i * size : i * size + luma], src[i * size + luma : i * size + luma + luma // 4], src[i * size + luma + luma // 4 : (i + 1) * size]) for i in range(len(src) // size)]

    return _explode(binary_files(spark, path), rows, "frame_no long, y binary, u binary, v binary")


def describe(spark: SparkSession, path: str) -> DataFrame:
    """What each file is and its totals: entries, raw and stored bytes, ratio; clips also seconds, keyframes, kbit/s."""

    def rows(src: bytes) -> list[tuple]:
        for kind, look in (("archive", containers.read_archive), ("clip", containers.read_clip), ("frame", frame.index)):
            try:
                found = look(src)
            except CorruptData:
                continue
            if kind == "archive":
                return [(kind, len(found), sum(f.raw_size for f in found), sum(f.stored_size for f in found), None, None, None)]
            if kind == "clip":
                stored, seconds = sum(s for _, s, _ in found.packets), len(found.packets) * found.rate[1] / found.rate[0]
                raw = len(found.packets) * found.width * found.height * 3 // 2
                return [(kind, len(found.packets), raw, stored, seconds, sum(k for _, _, k in found.packets), stored * 8 / 1000 / seconds)]
            return [(kind, len(found[2]), found[1], len(src), None, None, None)]
        raise CorruptData("no known container")

    d = _explode(binary_files(spark, path), rows, "kind string, entries long, raw long, stored long, seconds double, keyframes long, kbit_s double")
    return d.withColumn("ratio", F.round(F.col("raw") / F.col("stored"), 4))


def save(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes one file through Spark's file systems; what was there is replaced when the data is complete."""
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    to = jvm.org.apache.hadoop.fs.Path(path)
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    fs = to.getFileSystem(jsc.hadoopConfiguration())
    out = fs.create(part, True)
    out.write(data)
    out.close()
    fs.delete(to, False)
    fs.rename(part, to)
