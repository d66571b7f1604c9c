"""Clip indexes as relations: seeking, groups of frames, resynchronisation, rates, motion vectors.

``events`` stands for a clip index: a user is a clip, an event a packet, a purchase a keyframe, an error a corrupt packet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from blockwright.session import table

#: The standard frame rates (numerator, denominator) that a measured rate may be snapped to.
RATES = ((24000, 1001), (24, 1), (25, 1), (30000, 1001), (30, 1), (50, 1), (60000, 1001), (60, 1), (120, 1))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("clip"), F.col("event_id").alias("frame_no"), (F.col("event_type") == "purchase").alias("is_key"), (F.col("event_type") == "error").alias("bad"), F.octet_length("props").cast("long").alias("size"), "ts", "value"
    )


def _so_far() -> WindowSpec:
    return Window.partitionBy("clip").orderBy("frame_no").rowsBetween(Window.unboundedPreceding, 0)


_FRAMES = """f AS (SELECT user_id AS clip, event_id AS frame_no, event_type = 'purchase' AS is_key, event_type = 'error' AS bad,
  CAST(octet_length(encode(props)) AS BIGINT) AS size, ts, value FROM events)"""


def keyframe_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last keyframe at or before each frame of its clip; null before the first."""
    key = F.last(F.when(F.col("is_key"), F.col("frame_no")), ignorenulls=True).over(_so_far())
    return _frames(spark, sf_dir).select("clip", "frame_no", key.alias("keyframe"))


KEYFRAME_ASOF = f"""WITH {_FRAMES} SELECT f.clip, f.frame_no, k.frame_no AS keyframe
FROM f ASOF LEFT JOIN (SELECT clip, frame_no FROM f WHERE is_key) k ON f.clip = k.clip AND f.frame_no >= k.frame_no"""


def gop_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames and bytes of each group: a keyframe and what follows up to the next."""
    gop = F.sum(F.col("is_key").cast("long")).over(_so_far())
    return _frames(spark, sf_dir).select("clip", gop.alias("gop"), "size").groupBy("clip", "gop").agg(F.count("*").alias("frames"), F.sum("size").alias("bytes"), F.max("size").alias("largest"))


GOP_STATS = f"""WITH {_FRAMES}, g AS (SELECT clip, CAST(sum(is_key::INT) OVER (PARTITION BY clip ORDER BY frame_no) AS BIGINT) AS gop, size FROM f)
SELECT clip, gop, count(*) AS frames, CAST(sum(size) AS BIGINT) AS bytes, max(size) AS largest FROM g GROUP BY clip, gop"""


def clip_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames, keyframes, bytes, seconds at 30 frames a second and kbit/s of each clip."""
    f = _frames(spark, sf_dir).groupBy("clip").agg(F.count("*").alias("frames"), F.sum(F.col("is_key").cast("long")).alias("keyframes"), F.sum("size").alias("bytes"))
    seconds = F.col("frames") / 30.0
    return f.select("*", F.round(seconds, 6).alias("seconds"), F.round(F.col("bytes") * 8 / 1000 / seconds, 6).alias("kbit_s"))


CLIP_SUMMARY = f"""WITH {_FRAMES}, s AS (SELECT clip, count(*) AS frames, CAST(sum(is_key::INT) AS BIGINT) AS keyframes, CAST(sum(size) AS BIGINT) AS bytes FROM f GROUP BY clip)
SELECT *, round(frames / 30.0::DOUBLE, 6) AS seconds, round(bytes * 8 / 1000::DOUBLE / (frames / 30.0::DOUBLE), 6) AS kbit_s FROM s"""


def packet_resync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each packet decodes: it is whole and a keyframe came after the last corrupt packet."""
    key = F.max(F.when(F.col("is_key"), F.col("frame_no"))).over(_so_far())
    bad = F.max(F.when(F.col("bad"), F.col("frame_no"))).over(_so_far())
    return _frames(spark, sf_dir).select("clip", "frame_no", F.coalesce(key > F.coalesce(bad, F.lit(-1)), F.lit(False)).alias("decodes"))


PACKET_RESYNC = f"""WITH {_FRAMES} SELECT clip, frame_no, coalesce(max(CASE WHEN is_key THEN frame_no END) OVER w > coalesce(max(CASE WHEN bad THEN frame_no END) OVER w, -1), false) AS decodes
FROM f WINDOW w AS (PARTITION BY clip ORDER BY frame_no)"""


def slice_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of macroblocks dealt to slices: slice k has rows k * rows / slices up to the next one's first, rounded down."""
    o = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("clip"), (F.col("s_nationkey") + 5).cast("long").alias("rows"))
    s = o.withColumn("slices", F.least(F.lit(8).cast("long"), F.col("rows")))
    k = s.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"))
    at = lambda x: F.floor(x * F.col("rows") / F.col("slices"))
    return k.select("clip", "slice", at(F.col("slice")).alias("first_row"), at(F.col("slice") + 1).alias("end_row"))


SLICE_ROWS = """SELECT clip, slice, slice * rows // slices AS first_row, (slice + 1) * rows // slices AS end_row FROM (
SELECT s_suppkey AS clip, CAST(s_nationkey + 5 AS BIGINT) AS rows, least(8, CAST(s_nationkey + 5 AS BIGINT)) AS slices, unnest(range(0, least(8, s_nationkey + 5))) AS slice FROM supplier)"""


def rate_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each clip's stated rate, or, if the measured one is off by more than 5 % of it, the last standard rate within half a
    percent of the measured one, else the measured one in thousandths."""
    m = table(spark, sf_dir, "customer").select("c_custkey", (F.lit(24.0) + F.pmod("c_custkey", F.lit(4)) * 12).alias("stated"), F.round(23.5 + F.pmod(F.col("c_custkey") * 37, F.lit(9800)) / 100.0, 4).alias("measured"))
    near = [F.abs(F.col("measured") - F.lit(n / d)) < F.col("measured") * 0.005 for n, d in RATES]
    pick = lambda k: F.coalesce(*[F.when(hit, F.lit(r[k]).cast("long")) for hit, r in zip(reversed(near), reversed(RATES), strict=True)])
    off = F.abs(F.col("measured") - F.col("stated")) > F.col("stated") * 0.05
    num = F.when(~off, F.col("stated").cast("long")).otherwise(F.coalesce(pick(0), F.floor(F.col("measured") * 1000 + 0.5)))
    den = F.when(~off, F.lit(1).cast("long")).otherwise(F.coalesce(pick(1), F.lit(1000).cast("long")))
    return m.select("c_custkey", "stated", "measured", num.alias("num"), den.alias("den"))


RATE_SNAP = f"""WITH m AS (SELECT c_custkey, 24.0::DOUBLE + c_custkey % 4 * 12 AS stated, round(23.5::DOUBLE + (c_custkey * 37 % 9800) / 100.0::DOUBLE, 4) AS measured FROM customer),
r(i, n, d) AS (VALUES {", ".join(f"({i}, {n}::BIGINT, {d}::BIGINT)" for i, (n, d) in enumerate(RATES))}),
s AS (SELECT m.*, (SELECT max(i) FROM r WHERE abs(measured - n / d::DOUBLE) < measured * 0.005::DOUBLE) AS i FROM m)
SELECT c_custkey, stated, measured, CASE WHEN abs(measured - stated) <= stated * 0.05::DOUBLE THEN CAST(stated AS BIGINT) WHEN s.i IS NULL THEN CAST(floor(measured * 1000 + 0.5) AS BIGINT) ELSE n END AS num,
CASE WHEN abs(measured - stated) <= stated * 0.05::DOUBLE THEN 1 WHEN s.i IS NULL THEN 1000 ELSE d END AS den FROM s LEFT JOIN r ON r.i = s.i"""


def rolling_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the last 240 values of each user, in hundredths, rounded down (exact integers, so that no order matters)."""
    w = Window.partitionBy("clip").orderBy("frame_no").rowsBetween(-239, 0)
    cents = F.round(F.col("value") * 100).cast("long")
    return _frames(spark, sf_dir).select("clip", "frame_no", F.floor(F.sum(cents).over(w) / F.count("value").over(w)).alias("mean"))


ROLLING_AVERAGE = f"""WITH {_FRAMES} SELECT clip, frame_no, CAST(floor(sum(CAST(round(value * 100) AS BIGINT)) OVER w / count(value) OVER w) AS BIGINT) AS mean
FROM f WINDOW w AS (PARTITION BY clip ORDER BY frame_no ROWS 239 PRECEDING)"""


def mv_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors coded against their left neighbour; the neighbour of a row's first one, and of other modes, is 0."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "N", (F.col("l_partkey") % 64).cast("int") - 32).otherwise(0).alias("mv"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "mv")
    return li.select("l_orderkey", "l_linenumber", "mv", (F.col("mv") - F.coalesce(F.lag("mv").over(w), F.lit(0))).alias("delta"))


MV_DELTA = """WITH m AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN CAST(l_partkey % 64 AS INTEGER) - 32 ELSE 0 END AS mv FROM lineitem)
SELECT l_orderkey, l_linenumber, mv, mv - coalesce(lag(mv) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, mv), 0) AS delta FROM m"""

QUERIES = {
    "keyframe_asof": (keyframe_asof, KEYFRAME_ASOF),
    "gop_stats": (gop_stats, GOP_STATS),
    "clip_summary": (clip_summary, CLIP_SUMMARY),
    "packet_resync": (packet_resync, PACKET_RESYNC),
    "slice_rows": (slice_rows, SLICE_ROWS),
    "rate_snap": (rate_snap, RATE_SNAP),
    "rolling_average": (rolling_average, ROLLING_AVERAGE),
    "mv_delta": (mv_delta, MV_DELTA),
}
