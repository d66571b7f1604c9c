"""Whole jobs as plans: images to texture levels, frames to packets and back, one clip to another.

An image is a row and a group of pictures is a group of rows: both are bounded, independent, and what a task that is lost does again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwright.functions import astc, bc7, hdr, texture, video

LEVELS = "image_id long, level int, width int, height int, data binary"


def _blocks(image: np.ndarray) -> np.ndarray:
    """(blocks, 16, channels) of an (h, w, channels) image."""
    return np.stack([texture.blocks_of(image[:, :, k]) for k in range(image.shape[2])], 2)


def _channel(image: np.ndarray, k: int, price: float) -> bytes:
    return texture.cheaper(texture.encode_channel(image[:, :, k]), image[:, :, k : k + 1], "BC4", price)


def _colour(image: np.ndarray, price: float) -> bytes:
    return texture.cheaper(texture.encode_colour(image[:, :, :3]), image, "BC1", price)


def _beside(first: bytes, second: bytes) -> bytes:
    """Blocks of 16 bytes from two halves."""
    return np.hstack([np.frombuffer(x, np.uint8).reshape(-1, 8) for x in (first, second)]).tobytes()


#: Blocks of an RGBA image by format; the last argument is the price of a byte in squared error (0: none).
ENCODERS: dict[str, Callable[[np.ndarray, float], bytes]] = {
    "BC1": _colour,
    "BC3": lambda image, price: _beside(_channel(image, 3, price), _colour(image, price)),
    "BC4": lambda image, price: _channel(image, 0, price),
    "BC5": lambda image, price: _beside(_channel(image, 0, price), _channel(image, 1, price)),
    "BC6H": lambda image, price: hdr.encode(_blocks(image[:, :, :3] / 255.0)),
    "BC7": lambda image, price: bc7.encode(_blocks(image)),
    "ASTC": lambda image, price: astc.encode(_blocks(image)),
}


def texture_levels(images: DataFrame, kind: str, mips: bool = True, srgb: bool = False, price: float = 0.0) -> DataFrame:
    """(image_id, level, width, height, data) of images (image_id, width, height, rgba): block data of each mip level.

    An image with fewer bytes than its size has no rows.
    """
    code = ENCODERS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, w, h, raw in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if raw is None or len(raw) < w * h * 4:
                    continue
                image = np.frombuffer(raw, np.uint8, w * h * 4).reshape(h, w, 4)
                for level in range(max(w, h).bit_length() if mips else 1):
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), *(pa.array([v], pa.int32()) for v in (level, image.shape[1], image.shape[0])), pa.array([code(image, price)], pa.binary())], names=["image_id", "level", "width", "height", "data"])
                    image = texture.mip(image, srgb)

    return images.select(F.col("image_id").cast("long"), F.col("width").cast("int"), F.col("height").cast("int"), "rgba").mapInArrow(run, LEVELS)


def encode_clips(frames: DataFrame, width: int, height: int, quality: int = 70, interval: int = 60) -> DataFrame:
    """(clip, gop, frame_no, packet, is_key) of raw frames (clip, frame_no, y, u, v): every ``interval`` frames a keyframe begins a
    group of pictures, and each group is coded by itself."""
    import pandas as pd

    shapes = [(height, width), (height // 2, width // 2), (height // 2, width // 2)]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        session, out = video.Session(width, height), []
        for i, r in enumerate(g.sort_values("frame_no").itertuples()):
            planes = [np.frombuffer(p, np.uint8).reshape(s) for p, s in zip((r.y, r.u, r.v), shapes, strict=True)]
            out.append((r.clip, r.gop, r.frame_no, session.encode(planes, quality, key=i == 0), i == 0))
        return pd.DataFrame(out, columns=["clip", "gop", "frame_no", "packet", "is_key"])

    grouped = frames.withColumn("gop", F.floor(F.col("frame_no") / interval))
    return grouped.groupBy("clip", "gop").applyInPandas(run, "clip long, gop long, frame_no long, packet binary, is_key boolean")


def decode_packets(packets: DataFrame, width: int, height: int) -> DataFrame:
    """Frames of (clip, frame_no, packet, is_key): groups of pictures begin at keyframes, which a running count numbers."""
    from pyspark.sql.window import Window

    from blockwright.operators.codecs import decode_clips

    w = Window.partitionBy("clip").orderBy("frame_no").rowsBetween(Window.unboundedPreceding, 0)
    numbered = packets.withColumn("gop", F.sum(F.col("is_key").cast("long")).over(w))
    return decode_clips(numbered.select("clip", "gop", "frame_no", "packet"), width, height)


def transcode(spark: SparkSession, source: str, target: str, quality: int, interval: int = 60) -> None:
    """A clip coded anew. The target appears when it is complete; a packet that does not decode ends the job without one."""
    from blockwright.sources import datasource

    datasource.register(spark)
    packets = spark.read.format("clips").load(source).withColumn("clip", F.lit(0).cast("long"))
    first = packets.select("width", "height", "fps").first()
    frames = decode_packets(packets.select("clip", "frame_no", F.col("data").alias("packet"), "is_key"), first["width"], first["height"])
    checked = frames.select("clip", "frame_no", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.col("y")).alias("y"), "u", "v")
    out = encode_clips(checked, first["width"], first["height"], quality, interval)
    rate = f"{round(first['fps'] * 1001)}/1001" if abs(first["fps"] - round(first["fps"])) > 1e-6 else str(round(first["fps"]))
    out.select("frame_no", "packet", "is_key").write.format("clips").options(width=first["width"], height=first["height"], rate=rate, interval=interval).mode("overwrite").save(target)
