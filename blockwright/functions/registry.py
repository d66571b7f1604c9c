"""Codecs as SQL functions: Arrow functions over binary columns, table functions over one binary value.

``register(spark)`` makes them known to the session's SQL:

    bw_encode(data, method), bw_decode(coded, length, method)    blocks; method: plain, lazy, entropy, entropy3, turbo, huffman
    bw_frame(data), bw_unframe(frame)                            frames of blocks of 64 KB
    bw_x86(data, forward)                                        the machine code filter
    bw_half(value), bw_unhalf(bits)                              half floats
    bw_code_lengths(symbol)                                      aggregate: the Huffman code lengths of a column of bytes
    bw_frame_blocks(frame), bw_archive_entries(archive), bw_clip_index(clip), bw_sequences(data)    table functions

What does not decode is null; a table function of damaged input has no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf, udtf

from blockwright.functions import CorruptData, containers, entropy, entropy3, frame, hdr, huffman, lz, parse, turbo, x86

ENCODERS: dict[str, Callable[[bytes], bytes]] = {
    "plain": lz.encode, "lazy": lambda b: lz.write(b, parse.lazy(b)), "entropy": entropy.encode, "entropy3": entropy3.encode, "turbo": turbo.encode, "huffman": huffman.encode,
}
DECODERS: dict[str, Callable[[bytes, int], bytes]] = {"plain": lz.decode, "lazy": lz.decode, "entropy": entropy.decode, "entropy3": entropy3.decode, "turbo": turbo.decode, "huffman": huffman.decode}


def _each(fn: Callable, *columns: pd.Series) -> pd.Series:
    """``fn`` of each row; null where an input is null or does not decode."""
    out = []
    for row in zip(*columns, strict=True):
        try:
            out.append(None if any(v is None for v in row) else fn(*row))
        except CorruptData:
            out.append(None)
    return pd.Series(out, dtype=object)


@pandas_udf(T.BinaryType())
def bw_encode(data: pd.Series, method: pd.Series) -> pd.Series:
    return _each(lambda b, m: ENCODERS[m](bytes(b)), data, method)


@pandas_udf(T.BinaryType())
def bw_decode(coded: pd.Series, length: pd.Series, method: pd.Series) -> pd.Series:
    return _each(lambda b, n, m: DECODERS[m](bytes(b), int(n)), coded, length, method)


@pandas_udf(T.BinaryType())
def bw_frame(data: pd.Series) -> pd.Series:
    return _each(lambda b: frame.encode(bytes(b), methods=(frame.PLAIN, frame.ENTROPY)), data)


@pandas_udf(T.BinaryType())
def bw_unframe(coded: pd.Series) -> pd.Series:
    return _each(lambda b: frame.decode(bytes(b)), coded)


@pandas_udf(T.BinaryType())
def bw_x86(data: pd.Series, forward: pd.Series) -> pd.Series:
    return _each(lambda b, f: x86.apply(bytes(b), bool(f))[0], data, forward)


@pandas_udf(T.LongType())
def bw_half(value: pd.Series) -> pd.Series:
    return pd.Series(hdr.to_half(value.to_numpy(np.float64, na_value=np.nan)))


@pandas_udf(T.DoubleType())
def bw_unhalf(bits: pd.Series) -> pd.Series:
    return pd.Series(hdr.from_half(bits.to_numpy(np.int64, na_value=0)))


@pandas_udf(T.ArrayType(T.IntegerType()))
def bw_code_lengths(symbol: pd.Series) -> list:
    counts = np.bincount(symbol.dropna().to_numpy(np.int64) & 255, minlength=256)
    return huffman.lengths(counts).astype(int).tolist()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def _rows(fn: Callable[[bytes], list[tuple]], data: bytes | None) -> Iterator[tuple]:
    try:
        yield from fn(bytes(data)) if data is not None else ()
    except CorruptData:
        return


@udtf(returnType=_struct(block_no=T.LongType(), method=T.IntegerType(), filtered=T.BooleanType(), start=T.LongType(), end=T.LongType(), raw_len=T.LongType()))
class FrameBlocks:
    def eval(self, data: bytes) -> Iterator[tuple]:
        yield from _rows(lambda b: [(x.number, x.method, x.filtered, x.start, x.end, x.raw_len) for x in frame.index(b)[2]], data)


@udtf(returnType=_struct(i=T.LongType(), name=T.StringType(), offset=T.LongType(), stored_size=T.LongType(), raw_size=T.LongType()))
class ArchiveEntries:
    def eval(self, data: bytes) -> Iterator[tuple]:
        yield from _rows(lambda b: [(i, f.name, f.offset, f.stored_size, f.raw_size) for i, f in enumerate(containers.read_archive(b))], data)


@udtf(returnType=_struct(frame_no=T.LongType(), offset=T.LongType(), size=T.LongType(), is_key=T.BooleanType()))
class ClipIndex:
    def eval(self, data: bytes) -> Iterator[tuple]:
        yield from _rows(lambda b: [(i, *p) for i, p in enumerate(containers.read_clip(b).packets)], data)


@udtf(returnType=_struct(seq=T.LongType(), literals=T.LongType(), length=T.LongType(), off=T.LongType()))
class Sequences:
    def eval(self, data: bytes) -> Iterator[tuple]:
        yield from _rows(lambda b: [(i, *s) for i, s in enumerate(lz.sequences(b))], data)


def register(spark: SparkSession) -> None:
    for f in (bw_encode, bw_decode, bw_frame, bw_unframe, bw_x86, bw_half, bw_unhalf, bw_code_lengths):
        spark.udf.register(f.__name__, f)
    for name, f in (("bw_frame_blocks", FrameBlocks), ("bw_archive_entries", ArchiveEntries), ("bw_clip_index", ClipIndex), ("bw_sequences", Sequences)):
        spark.udtf.register(name, f)
