"""Texture and video operators over pixels: mips, errors, block search, palettes, tables, colours.

Images come from ``embeddings`` (a vector is a row of 64 pixels) and ``lineitem``; 8-bit values are quantised where needed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwright.session import table

WIDTH = 64


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(y, x, f, v): a float image and its 8-bit form."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "f"))
    return e.select("y", F.col("x").cast("long").alias("x"), F.col("f").cast("double").alias("f"), quantise(F.col("f").cast("double")).alias("v"))


def quantise(f: Column) -> Column:
    """-1 to 1 as 0 to 255."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor((f + 1) * 127.5))).cast("int")


_PIXELS = """px AS (SELECT y, x, f, CAST(greatest(0, least(255, floor((f + 1) * 127.5))) AS INTEGER) AS v
  FROM (SELECT vec_id AS y, unnest(range(0, len(embedding))) AS x, CAST(unnest(embedding) AS DOUBLE) AS f FROM embeddings))"""


def search_rows(spark: SparkSession, sf_dir: str, row: Callable[[Column], Column], first: Callable[[Column], Column], last: Callable[[Column], Column], best: Callable, schema: str) -> DataFrame:
    """What ``best(row, own, reference)`` finds for each row of blocks, where own and reference are lists of (y, 8-bit pixels): rows of the
    image go to the row of blocks ``row(y)`` that they belong to, and to those from ``first(y)`` to ``last(y)`` that look for matches in
    them. So a row travels a few times as it is, instead of once for each pixel and displacement."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), F.transform("embedding", lambda f: quantise(f.cast("double"))).alias("v")).where("y is not null and v is not null")
    y = F.col("y")
    places = F.concat(F.array(F.struct(row(y).cast("long").alias("row"), F.lit(True).alias("own"))), F.transform(F.sequence(first(y).cast("long"), last(y).cast("long")), lambda r: F.struct(r.alias("row"), F.lit(False).alias("own"))))
    groups = e.select("y", "v", F.explode(places).alias("p")).groupBy(F.col("p.row").alias("row")).agg(F.collect_list(F.struct(F.col("p.own").alias("own"), "y", "v")).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 256):
                part, out = b.slice(at, 256), []
                for k, rows in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    own, ref = ([(r["y"], np.array(r["v"], np.int64)) for r in rows if r["own"] is side] for side in (True, False))
                    out += best(k, own, ref) if own and ref else []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return groups.mapInArrow(run, schema)


def moved_differences(v: np.ndarray, r: np.ndarray, moves: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(absolute differences, number of pixels) by displacement and block of a row and a reference row, whose coordinates are clamped to
    the image's width; pixels that a short reference lacks don't count."""
    at = np.clip(np.arange(len(v)) + moves[:, None], 0, WIDTH - 1)
    there = at < len(r)
    d = np.where(there, np.abs(v - r[np.minimum(at, len(r) - 1)]), 0)
    starts = np.arange(0, len(v), block)
    return np.add.reduceat(d, starts, axis=1), np.add.reduceat(there.astype(np.int64), starts, axis=1)


def mip_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next smaller 8-bit level: rounded means of 2 x 2 pixels; an odd last row or column is dropped."""
    p = _pixels(spark, sf_dir)
    g = p.groupBy(F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x")).agg(F.sum(F.col("v").cast("long")).alias("s"), F.count("*").alias("n"))
    return g.where("n = 4").select("y", "x", F.shiftright(F.col("s") + 2, 2).alias("v"))


MIP_LEVEL = f"WITH {_PIXELS}, g AS (SELECT y // 2 AS gy, x // 2 AS gx, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM px GROUP BY 1, 2) SELECT gy AS y, gx AS x, (s + 2) >> 2 AS v FROM g WHERE n = 4"


def mip_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next smaller float level."""
    g = _pixels(spark, sf_dir).groupBy(F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x")).agg(F.avg("f").alias("f"), F.count("*").alias("n"))
    return g.where("n = 4").select("y", "x", F.round("f", 5).alias("f"))


MIP_FLOAT = f"WITH {_PIXELS}, g AS (SELECT y // 2 AS gy, x // 2 AS gx, avg(f) AS f, count(*) AS n FROM px GROUP BY 1, 2) SELECT gy AS y, gx AS x, round(f, 5) AS f FROM g WHERE n = 4"


def psnr_of(error: Column, n: Column) -> Column:
    """Peak signal to noise ratio of a sum of squared 8-bit errors, 99 without any."""
    return F.when(error == 0, F.lit(99.0)).otherwise(10 * F.log10(F.lit(65025.0) * n / error))


def psnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each row after its values lose their low 3 bits (middle of the step)."""
    v = F.col("v").cast("long")
    d = v - (F.shiftleft(F.shiftright(v, 3), 3) + 4)
    s = _pixels(spark, sf_dir).groupBy("y").agg(F.sum(d * d).alias("sse"), F.count("*").alias("n"))
    return s.select("y", "sse", F.round(psnr_of(F.col("sse"), F.col("n")), 6).alias("psnr"))


PSNR = f"""WITH {_PIXELS}, s AS (SELECT y, CAST(sum((v - ((v >> 3 << 3) + 4)) * (v - ((v >> 3 << 3) + 4))) AS BIGINT) AS sse, count(*) AS n FROM px GROUP BY y)
SELECT y, sse, round(CASE WHEN sse = 0 THEN 99.0::DOUBLE ELSE 10 * log10(65025.0::DOUBLE * n / sse) END, 6) AS psnr FROM s"""


def sad_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best horizontal displacement (-4 to 4) of each block of 16 pixels within the row before, by absolute differences.

    Ties go to the shorter, then the smaller displacement.
    """
    moves = np.arange(-4, 5)

    def best(y: int, own: list, ref: list) -> list[tuple]:
        total: dict[int, list[np.ndarray]] = {}
        for _, v in own:
            for _, r in ref:
                if len(v) and len(r):
                    sad, n = moved_differences(v, r, moves, 16)
                    for k in range(sad.shape[1]):
                        t = total.setdefault(k, [np.zeros(9, np.int64), np.zeros(9, np.int64)])
                        t[0] += sad[:, k]
                        t[1] += n[:, k]
        found = [(k, min((int(sad[i]), abs(int(d)), int(d)) for i, d in enumerate(moves) if n[i])) for k, (sad, n) in total.items() if n.any()]
        return [(y, k, d, sad) for k, (sad, _, d) in found]

    return search_rows(spark, sf_dir, lambda y: y, lambda y: y + 1, lambda y: y + 1, best, "y long, block long, d int, sad long")


SAD_SEARCH = f"""WITH {_PIXELS}, m AS (SELECT y, x, v, CAST(d AS INTEGER) AS d, greatest(0, least(63, x + d)) AS rx FROM px CROSS JOIN range(-4, 5) AS t(d)),
c AS (SELECT m.y, m.x // 16 AS block, d, CAST(sum(abs(m.v - r.v)) AS BIGINT) AS sad FROM m JOIN px r ON r.y = m.y - 1 AND r.x = m.rx GROUP BY ALL)
SELECT y, block, d, sad FROM (SELECT *, row_number() OVER (PARTITION BY y, block ORDER BY sad, abs(d), d) AS k FROM c) WHERE k = 1"""


#: Bytes of a field that is sent as it is.
FIELD_BYTES = 4


def band_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each line the nearest of the 16 lines before it (by order and number) with the same supplier, in rows of a part group, and
    the bytes that its field takes: none if it repeats from as far as the line before, up to 3 to point there, all of it if it does not repeat.

    A lag over equal values gives the nearest earlier one; the row distance decides whether it lies in the band.
    """
    from pyspark.sql.window import Window

    li = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("img"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", (F.col("l_suppkey") % 20).alias("field"))
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    r = li.withColumn("i", F.row_number().over(Window.partitionBy("img").orderBy(*order)))
    j = F.lag("i").over(Window.partitionBy("img", "field").orderBy("i"))
    r = r.select("img", "i", "field", F.coalesce(F.when(F.col("i") - j <= 16, F.col("i") - j), F.lit(0)).alias("distance"))
    before = F.lag("distance").over(Window.partitionBy("img").orderBy("i"))
    rate = F.when(F.col("distance") == 0, FIELD_BYTES).when(F.coalesce(before == F.col("distance"), F.lit(False)), 0).otherwise(min(FIELD_BYTES, 3))
    return r.select("img", "i", "field", "distance", rate.alias("rate"))


BAND_REUSE = f"""WITH r AS (SELECT l_partkey % 50 AS img, l_suppkey % 20 AS field, CAST(row_number() OVER (PARTITION BY l_partkey % 50 ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS INTEGER) AS i FROM lineitem),
d AS (SELECT img, i, field, coalesce((SELECT min(r.i - b.i) FROM r b WHERE b.img = r.img AND b.field = r.field AND b.i < r.i AND b.i >= r.i - 16), 0) AS distance FROM r)
SELECT *, CASE WHEN distance = 0 THEN {FIELD_BYTES} WHEN distance = lag(distance) OVER (PARTITION BY img ORDER BY i) THEN 0 ELSE {min(FIELD_BYTES, 3)} END AS rate FROM d"""


def bc4_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 8 levels between two 8-bit ends: 6 between them if the first is larger, else 4 and the extremes."""
    e = spark.range(256).select(F.col("id").alias("a")).select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(255).cast("long"), F.lit(17).cast("long"))).alias("b"))
    a, b = F.col("a"), F.col("b")
    six = [a, b, *[F.floor(((7 - k) * a + k * b + 3) / 7) for k in range(1, 7)]]
    four = [a, b, *[F.floor(((5 - k) * a + k * b + 2) / 5) for k in range(1, 5)], F.lit(0).cast("long"), F.lit(255).cast("long")]
    return e.select("a", "b", F.posexplode(F.when(a > b, F.array(*six)).otherwise(F.array(*four))).alias("i", "level"))


BC4_PALETTE = """WITH e AS (SELECT a, b * 17 AS b, i FROM range(256) AS s(a), range(16) AS t(b), range(8) AS u(i))
SELECT a, b, CAST(i AS INTEGER) AS i, CASE WHEN i = 0 THEN a WHEN i = 1 THEN b
  WHEN a > b THEN ((8 - i) * a + (i - 1) * b + 3) // 7 WHEN i < 6 THEN ((6 - i) * a + (i - 1) * b + 2) // 5 WHEN i = 6 THEN 0 ELSE 255 END AS level FROM e"""


def bc1_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Green channel of the colours of two 565 ends: 2 between them if the first is larger, else the mean and black."""
    p = spark.range(64).select(F.col("id").alias("a")).select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))).alias("b"))
    wide = lambda g: F.shiftleft(g, 2).bitwiseOR(F.shiftright(g, 4))
    x, y = wide(F.col("a")), wide(F.col("b"))
    two = [x, y, F.floor((2 * x + y + 1) / 3), F.floor((x + 2 * y + 1) / 3)]
    one = [x, y, F.floor((x + y) / 2), F.lit(0).cast("long")]
    return p.select("a", "b", F.posexplode(F.when(F.col("a") > F.col("b"), F.array(*two)).otherwise(F.array(*one))).alias("i", "level"))


BC1_PALETTE = """WITH e AS (SELECT a, b, (a << 2) | (a >> 4) AS x, (b << 2) | (b >> 4) AS y, i FROM range(64) AS s(a), range(64) AS t(b), range(4) AS u(i))
SELECT a, b, CAST(i AS INTEGER) AS i, CASE i WHEN 0 THEN x WHEN 1 THEN y WHEN 2 THEN CASE WHEN a > b THEN (2 * x + y + 1) // 3 ELSE (x + y) // 2 END
  ELSE CASE WHEN a > b THEN (x + 2 * y + 1) // 3 ELSE 0 END END AS level FROM e"""

#: The luminance steps of the common still-image standard, in rows of 8.
LUMINANCE = (
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
)


def quant_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of each coefficient at qualities 1 to 100: scaled, rounded, within 1 and 255."""
    q = spark.range(1, 101).select(F.col("id").alias("quality"), F.posexplode(F.array(*[F.lit(v).cast("long") for v in LUMINANCE])).alias("i", "base"))
    scale = F.when(F.col("quality") < 50, F.floor(5000 / F.col("quality"))).otherwise(200 - 2 * F.col("quality"))
    return q.select("quality", "i", F.greatest(F.lit(1), F.least(F.lit(255), F.floor((F.col("base") * scale + 50) / 100))).cast("long").alias("step"))


QUANT_TABLES = f"""WITH b AS (SELECT unnest(range(0, 64)) AS i, unnest([{', '.join(map(str, LUMINANCE))}]) AS base)
SELECT quality, CAST(i AS INTEGER) AS i, greatest(1, least(255, (base * CASE WHEN quality < 50 THEN 5000 // quality ELSE 200 - 2 * quality END + 50) // 100)) AS step
FROM range(1, 101) AS q(quality), b"""


#: Scale of limited-range luma and chroma, and the matrices of both standards (v to r, u and v to g, u to b).
LIMITED = (1.164, 1.138)
MATRIX = {1: (1.5748, 0.1873, 0.4681, 1.8556), 0: (1.402, 0.344, 0.714, 1.772)}


def yuv_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of 0 to 255 of sampled YUV triples, limited and full range, by both usual matrices (709 from 720 lines on)."""
    s = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(255).cast("long"), F.lit(51).cast("long"))).alias(c)
    p = spark.range(4).select((F.col("id") % 2).alias("hd"), F.floor(F.col("id") / 2).alias("full"))
    for c in ("y", "u", "v"):
        p = p.select("*", s(c))
    wide = F.col("full") == 1
    y = F.when(wide, F.col("y") / 255.0).otherwise((F.col("y") - 16) / 255.0 * LIMITED[0])
    chroma = lambda c: (F.col(c) / 255.0 - 0.5) * F.when(wide, F.lit(1.0)).otherwise(F.lit(LIMITED[1]))
    u, v = chroma("u"), chroma("v")
    m = [F.when(F.col("hd") == 1, F.lit(a)).otherwise(F.lit(b)) for a, b in zip(MATRIX[1], MATRIX[0], strict=True)]
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) * 255
    r, g, b = y + m[0] * v, y - m[1] * u - m[2] * v, y + m[3] * u
    return p.select("hd", "full", "y", "u", "v", *[F.round(clip(c), 3).alias(n) for n, c in (("r", r), ("g", g), ("b", b))])


_M = [f"CASE hd WHEN 1 THEN {a}::DOUBLE ELSE {b}::DOUBLE END" for a, b in zip(MATRIX[1], MATRIX[0], strict=True)]
YUV_RGB = f"""WITH p AS (SELECT id % 2 AS hd, id // 2 AS "full", y * 51 AS y, u * 51 AS u, v * 51 AS v FROM range(4) AS h(id), range(6) AS a(y), range(6) AS b(u), range(6) AS c(v)),
n AS (SELECT *, CASE WHEN "full" = 1 THEN y / 255.0::DOUBLE ELSE (y - 16) / 255.0::DOUBLE * {LIMITED[0]}::DOUBLE END AS l, (u / 255.0::DOUBLE - 0.5) * CASE WHEN "full" = 1 THEN 1.0::DOUBLE ELSE {LIMITED[1]}::DOUBLE END AS cb,
  (v / 255.0::DOUBLE - 0.5) * CASE WHEN "full" = 1 THEN 1.0::DOUBLE ELSE {LIMITED[1]}::DOUBLE END AS cr FROM p),
c AS (SELECT *, l + {_M[0]} * cr AS r0, l - {_M[1]} * cb - {_M[2]} * cr AS g0, l + {_M[3]} * cb AS b0 FROM n)
SELECT hd, "full", y, u, v, {", ".join(f"round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}0)) * 255, 3) AS {x}" for x in "rgb")} FROM c"""

QUERIES = {
    "mip_level": (mip_level, MIP_LEVEL),
    "mip_float": (mip_float, MIP_FLOAT),
    "psnr": (psnr, PSNR),
    "sad_search": (sad_search, SAD_SEARCH),
    "band_reuse": (band_reuse, BAND_REUSE),
    "bc4_palette": (bc4_palette, BC4_PALETTE),
    "bc1_palette": (bc1_palette, BC1_PALETTE),
    "quant_tables": (quant_tables, QUANT_TABLES),
    "yuv_rgb": (yuv_rgb, YUV_RGB),
}
