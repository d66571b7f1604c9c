"""Streams of packets: resynchronisation as keyed state, stateless coding, windowed reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from blockwright.functions import CorruptData, lz, video

FRAMES = "clip long, frame_no long, decodes boolean"


def resync(frames: DataFrame, idle_ms: int = 3_600_000) -> DataFrame:
    """(clip, frame_no, decodes) of a stream of (clip, frame_no, is_key, bad). A clip without packets for ``idle_ms``
    (processing time) is forgotten; if it goes on, it starts anew.

    The state of a clip says whether there is a reference and which frame is next. A corrupt packet or a gap drops the
    reference; only a keyframe brings it back. Frames are put in order within a micro-batch; older ones are late and
    never decode.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        have, following = state.get if state.exists else (False, -1)
        rows = pd.concat(list(parts)).sort_values("frame_no")
        out = []
        for n, is_key, bad in zip(rows.frame_no, rows.is_key, rows.bad, strict=True):
            if n < following:
                out.append((key[0], n, False))
                continue
            if following >= 0 and n != following:
                have = False
            have = bool(not bad and (is_key or have))
            following = int(n) + 1
            out.append((key[0], n, have))
        state.update((have, following))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["clip", "frame_no", "decodes"])

    return frames.groupBy("clip").applyInPandasWithState(step, FRAMES, "have boolean, following long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def compress(messages: DataFrame, dictionary: bytes, version: int) -> DataFrame:
    """(pkt_id, dict_version, raw_len, coded) of a stream of (pkt_id, payload): each message by itself, no state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [x or b"" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([version] * len(raw), pa.int32()), pa.array([len(r) for r in raw], pa.int64()), pa.array([lz.encode(r, dictionary) for r in raw], pa.binary())], ["pkt_id", "dict_version", "raw_len", "coded"])

    return messages.select("pkt_id", "payload").mapInArrow(run, "pkt_id long, dict_version int, raw_len long, coded binary")


def decode_sessions(packets: DataFrame, width: int, height: int, idle_ms: int = 3_600_000) -> DataFrame:
    """(clip, frame_no, y, error) of a stream of (clip, frame_no, packet): the decoder's planes are the state of its clip.

    Packets are put in order within a micro-batch. Damage, a gap or a late packet gives a row without a picture, and so do
    all packets after it up to the next keyframe.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        session = video.Session(width, height)
        following, planes = state.get if state.exists else (-1, None)
        if planes is not None:
            session.load(bytes(planes))
        rows = pd.concat(list(parts)).sort_values("frame_no")
        out = []
        for n, packet in zip(rows.frame_no, rows.packet, strict=True):
            if n < following:
                out.append((key[0], n, None, "late"))
                continue
            if following >= 0 and n != following:
                session.planes = None
            following = int(n) + 1
            try:
                out.append((key[0], n, session.decode(bytes(packet))[0].tobytes(), None))
            except CorruptData as e:
                out.append((key[0], n, None, str(e)))
        state.update((following, session.dump()))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["clip", "frame_no", "y", "error"])

    return packets.groupBy("clip").applyInPandasWithState(step, "clip long, frame_no long, y binary, error string", "following long, planes binary", "append", GroupStateTimeout.ProcessingTimeTimeout)


def clip_sink(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: keeps the packets (frame_no, packet, is_key) of each micro-batch beside the clip to be, one folder a batch,
    so that a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.select("frame_no", "packet", "is_key").write.mode("overwrite").parquet(f"{path}.batches/{number:09d}")

    return write


def finish_clip(spark: SparkSession, path: str, width: int, height: int, rate: str = "30") -> None:
    """Writes the clip of all batches so far: its index and header need the last packet, so they come when the stream ends."""
    from blockwright.sources import datasource

    datasource.register(spark)
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{path}.batches")
    rows.write.format("clips").options(width=width, height=height, rate=rate).mode("overwrite").save(path)


def rates(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Packets and bytes of each kind in windows of event time; what is later than the watermark is dropped."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type")
    return w.agg(F.count("*").alias("packets"), F.sum(F.octet_length("props")).alias("bytes")).select(F.col("window.start").alias("start"), "event_type", "packets", "bytes")
