"""Texture formats as relations: half floats, endpoints, bit replication, partition patterns, clusters, integer sequences,
sRGB levels, block statistics.

The patterns and scales are fixed by the formats; they are computed by their rules, as columns, and in SQL by the same rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwright.functions import columns as C
from blockwright.functions.astc import HASH_STEPS, SPREADS, two_means
from blockwright.operators.images import _PIXELS, WIDTH, _pixels, moved_differences, psnr_of, search_rows
from blockwright.session import table

M32 = 0xFFFFFFFF


def half_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values over forty octaves as half floats (negative ones as 0, ties up) and back."""
    p = _pixels(spark, sf_dir).select("y", "x", (F.col("f") * F.pow(F.lit(2.0), F.col("x") % 40 - 24)).alias("f"))
    h = p.select("y", "x", C.float_to_half(F.col("f")).alias("half"))
    return h.select("y", "x", "half", C.half_to_float(F.col("half")).alias("back"))


HALF_FLOATS = f"""WITH {_PIXELS}, s AS (SELECT y, x, f * pow(2.0::DOUBLE, x % 40 - 24) AS f FROM px),
e AS (SELECT *, CASE WHEN f > 0 THEN CAST(floor(log2(f)) AS INTEGER) END AS e0 FROM s),
n AS (SELECT *, CASE WHEN pow(2.0::DOUBLE, e0 + 1) <= f THEN e0 + 1 WHEN pow(2.0::DOUBLE, e0) > f THEN e0 - 1 ELSE e0 END AS e FROM e),
h AS (SELECT y, x, CASE WHEN NOT f > 0 THEN 0::BIGINT WHEN f >= 65504 THEN 31743 WHEN f < pow(2.0::DOUBLE, -14) THEN CAST(floor(CAST(f * 16777216 AS FLOAT) + 0.5::FLOAT) AS BIGINT)
  ELSE CAST(floor(f * pow(2.0::DOUBLE, 10 - e) + 0.5) AS BIGINT) + (e + 14) * 1024 END AS half FROM n)
SELECT y, x, half, CASE WHEN half < 1024 THEN half / 16777216.0::DOUBLE ELSE (1 + half % 1024 / 1024.0::DOUBLE) * pow(2.0::DOUBLE, half // 1024 - 15) END AS back FROM h"""


def endpoint_scale(e: Column) -> Column:
    """A 10-bit endpoint over 16 bits."""
    return F.when(e == 0, 0).when(e == 1023, 65535).otherwise(F.shiftright(F.shiftleft(e, 16) + 0x8000, 10))


def endpoint_of(u: Column) -> Column:
    """The 10-bit endpoint nearest to a value over 16 bits, the smallest of equals."""
    guess = F.floor((u - 32) / 64 + 0.5)
    near = [F.greatest(F.lit(0), F.least(F.lit(1023), guess + d)) for d in (-1, 0, 1)]
    return F.array_min(F.array(*[F.struct(F.abs(endpoint_scale(e) - u).alias("d"), e.alias("e")) for e in near]))["e"]


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 10-bit endpoints over 16 bits, as half floats, and the endpoints of values beside them."""
    e = spark.range(1024).select(F.col("id").alias("e")).withColumn("wide", endpoint_scale(F.col("e")).cast("long"))
    beside = [F.greatest(F.lit(0), F.least(F.lit(65535), F.col("wide") + d)) for d in (-33, 31, 40)]
    return e.select("e", "wide", F.shiftright(F.col("wide") * 31, 6).alias("half"), *[endpoint_of(b).cast("long").alias(n) for b, n in zip(beside, ("below", "above", "far"), strict=True)])


_WIDE = "CASE WHEN {0} = 0 THEN 0 WHEN {0} = 1023 THEN 65535 ELSE (({0} << 16) + 32768) >> 10 END"
ENDPOINTS = f"""WITH e AS (SELECT range AS e, {_WIDE.format('range')} AS wide FROM range(1024)),
u AS (SELECT e, wide, k, greatest(0, least(65535, wide + [-33, 31, 40][k])) AS u FROM e, range(1, 4) AS t(k)),
c AS (SELECT u.*, g.e AS c, abs(g.wide - u.u) AS d FROM u JOIN e g ON abs(g.wide - u.u) <= 128),
b AS (SELECT e, wide, k, arg_min(c, d * 1024 + c) AS c FROM c GROUP BY e, wide, k)
SELECT e, wide, (wide * 31) >> 6 AS half, max(c) FILTER (WHERE k = 1) AS below, max(c) FILTER (WHERE k = 2) AS above, max(c) FILTER (WHERE k = 3) AS far FROM b GROUP BY e, wide"""


def replicate(v: Column, n: int, to: int) -> Column:
    """An n-bit value over ``to`` bits, its bits repeated from the top."""
    x = F.lit(0).cast("long")
    for sh in range(to - n, -n, -n):
        x = x.bitwiseOR(F.shiftleft(v, sh) if sh >= 0 else F.shiftright(v, -sh))
    return x.bitwiseAND(F.lit((1 << to) - 1))


def bit_replication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values of 1 to 8 bits over 8 bits, and as weights of 0 to 64 (up to 5 bits)."""
    parts = []
    for n in range(1, 9):
        v = spark.range(1 << n).select(F.lit(n).alias("bits"), F.col("id").alias("v"))
        six = replicate(F.col("v"), n, 6)
        parts.append(v.select("bits", "v", replicate(F.col("v"), n, 8).alias("wide"), (F.when(six > 32, six + 1).otherwise(six) if n <= 5 else F.lit(None).cast("long")).alias("weight")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: The bits of a value as text, repeated and cut.
BIT_REPLICATION = """WITH v AS (SELECT bits, v FROM range(1, 9) AS n(bits), range(256) AS t(v) WHERE v < 1 << bits),
r AS (SELECT bits, v, repeat(right(lpad(bin(v), 64, '0'), bits), 8) AS s FROM v),
w AS (SELECT *, list_sum(list_transform(range(1, 9), lambda i: CAST(s[i] AS BIGINT) << (8 - i))) AS wide, list_sum(list_transform(range(1, 7), lambda i: CAST(s[i] AS BIGINT) << (6 - i))) AS six FROM r)
SELECT CAST(bits AS INTEGER) AS bits, v, CAST(wide AS BIGINT) AS wide, CASE WHEN bits <= 5 THEN CAST(CASE WHEN six > 32 THEN six + 1 ELSE six END AS BIGINT) END AS weight FROM w"""




def _hashed(seeds: DataFrame) -> DataFrame:
    """``seeds`` (parts, seed) with their hash; a column for each step, so that no expression doubles."""
    d = seeds.withColumn("p", F.col("seed") + (F.col("parts") - 1) * 1024)
    key = F.col("p")
    d = d.withColumn("key", key)
    for op, way, n in HASH_STEPS:
        moved = (F.shiftleft("p", n) if way == "<<" else F.shiftright("p", n)).bitwiseAND(F.lit(M32))
        p = F.col("p")
        d = d.withColumn("p", p.bitwiseXOR(moved) if op == "^" else F.pmod(p + moved if op == "+" else p - moved, F.lit(M32 + 1)))
    return d


def partition_texels(spark: SparkSession) -> DataFrame:
    """(parts, seed, texel, part): the part that each of 16 texels belongs to, for 2 to 4 parts and 1024 seeds."""
    seeds = spark.range(1024).select(F.explode(F.array(*[F.lit(n).cast("long") for n in (2, 3, 4)])).alias("parts"), F.col("id").alias("seed"))
    d = _hashed(seeds)
    p, key, parts = F.col("p"), F.col("key"), F.col("parts")
    low = F.when(key.bitwiseAND(F.lit(2)) != 0, 4).otherwise(5)
    high = F.when(parts == 3, 6).otherwise(5)
    odd = key.bitwiseAND(F.lit(1)) != 0
    d = d.select("parts", "seed", "p", F.when(odd, low).otherwise(high).alias("sh1"), F.when(odd, high).otherwise(low).alias("sh2"), (key.bitwiseAND(F.lit(16)) != 0).alias("third"))
    four = [F.shiftright(p, n).bitwiseAND(F.lit(15)) for n in (0, 4, 8, 12, 16, 20, 24, 28)]
    slope = [F.floor(s * s / F.pow(F.lit(2), F.col("sh1") if i % 2 == 0 else F.col("sh2"))).cast("long").alias(f"s{i}") for i, s in enumerate(four)]
    d = d.select("parts", "seed", "p", *slope, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))).alias("texel"))
    x, y = 2 * (F.col("texel") % 4), 2 * F.floor(F.col("texel") / 4)
    line = lambda i, n: (F.col(f"s{2 * i}") * x + F.col(f"s{2 * i + 1}") * y + F.shiftright(p, n)).bitwiseAND(F.lit(63))
    a, b = line(0, 14), line(1, 10)
    c, e = F.when(parts < 3, 0).otherwise(line(2, 6)), F.when(parts < 4, 0).otherwise(line(3, 2))
    d = d.select("parts", "seed", "texel", a.alias("a"), b.alias("b"), c.alias("c"), e.alias("d"))
    a, b, c, e = (F.col(n) for n in "abcd")
    return d.select("parts", "seed", "texel", F.when((a >= b) & (a >= c) & (a >= e), 0).when((b >= c) & (b >= e), 1).when(c >= e, 2).otherwise(3).cast("long").alias("part"))


def partition_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pattern as a number: two bits for each texel."""
    return partition_texels(spark).groupBy("parts", "seed").agg(F.sum(F.col("part") * F.pow(F.lit(4), F.col("texel")).cast("long")).alias("pattern"))


def _hash_sql() -> str:
    out = "h0 AS (SELECT parts, seed, seed + (parts - 1) * 1024 AS key, seed + (parts - 1) * 1024 AS p FROM range(2, 5) AS n(parts), range(1024) AS t(seed))"
    for i, (op, way, n) in enumerate(HASH_STEPS):
        moved = f"((p {way} {n}) & {M32})"
        value = f"xor(p, {moved})" if op == "^" else f"((p {op} {moved} + {M32 + 1}) % {M32 + 1})"
        out += f",\nh{i + 1} AS (SELECT parts, seed, key, {value} AS p FROM h{i})"
    return out


_TEXELS = f"""{_hash_sql()},
sh AS (SELECT *, CASE WHEN key & 1 = 1 THEN CASE WHEN key & 2 = 2 THEN 4 ELSE 5 END ELSE CASE WHEN parts = 3 THEN 6 ELSE 5 END END AS s1,
  CASE WHEN key & 1 = 1 THEN CASE WHEN parts = 3 THEN 6 ELSE 5 END ELSE CASE WHEN key & 2 = 2 THEN 4 ELSE 5 END END AS s2 FROM h{len(HASH_STEPS)}),
sl AS (SELECT parts, seed, p, list_transform(range(0, 8), lambda i: (((p >> CAST(4 * i AS BIGINT)) & 15) * ((p >> CAST(4 * i AS BIGINT)) & 15)) >> CASE WHEN i % 2 = 0 THEN s1 ELSE s2 END) AS s FROM sh),
ln AS (SELECT parts, seed, texel, (s[1] * (texel % 4) * 2 + s[2] * (texel // 4) * 2 + (p >> 14)) & 63 AS a, (s[3] * (texel % 4) * 2 + s[4] * (texel // 4) * 2 + (p >> 10)) & 63 AS b,
  CASE WHEN parts < 3 THEN 0 ELSE (s[5] * (texel % 4) * 2 + s[6] * (texel // 4) * 2 + (p >> 6)) & 63 END AS c, CASE WHEN parts < 4 THEN 0 ELSE (s[7] * (texel % 4) * 2 + s[8] * (texel // 4) * 2 + (p >> 2)) & 63 END AS d FROM sl, range(16) AS t(texel)),
tx AS (SELECT parts, seed, texel, CASE WHEN a >= greatest(b, c, d) THEN 0 WHEN b >= greatest(c, d) THEN 1 WHEN c >= d THEN 2 ELSE 3 END AS part FROM ln)"""
PARTITION_PATTERNS = f"WITH {_TEXELS} SELECT parts, seed, CAST(sum(part << CAST(2 * texel AS INTEGER)) AS BIGINT) AS pattern FROM (SELECT parts, seed, texel, CAST(part AS BIGINT) AS part FROM tx) GROUP BY parts, seed"


def partition_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 32-bit multiplicative checksum over the texels of all patterns, folded in order; 16,384 values for each number of parts."""
    t = partition_texels(spark).groupBy("parts").agg(F.array_sort(F.collect_list(F.struct("seed", "texel", "part"))).alias("t"))
    return t.select("parts", F.aggregate("t", F.lit(2166136261).cast("long"), lambda h, x: F.pmod(h.bitwiseXOR(x["part"]) * 16777619, F.lit(M32 + 1))).alias("checksum"))


PARTITION_CHECKSUM = f"""WITH {_TEXELS}, l AS (SELECT parts, list(CAST(part AS BIGINT) ORDER BY seed, texel) AS t FROM tx GROUP BY parts)
SELECT parts, list_reduce(t, lambda h, v: (xor(h, v) * 16777619) % {M32 + 1}, 2166136261::BIGINT) AS checksum FROM l"""


def block_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(y, mask): each row of 64 values as a block of 16 texels of 4 channels, its first three in two clusters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array(b.column(1).to_pylist(), np.float64).reshape(len(b), 16, 4) if len(b) else np.zeros((0, 16, 4))
            v = np.clip(np.floor((f + 1) * 127.5), 0, 255)[:, :, :3]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(two_means(v), pa.int64())], names=["y", "mask"])

    e = table(spark, sf_dir, "embeddings").where("size(embedding) = 64").select(F.col("vec_id").alias("y"), F.col("embedding").cast("array<double>").alias("f"))
    return e.mapInArrow(run, "y bigint, mask bigint")


def _means_sql() -> str:
    out = f"""{_PIXELS}, ch AS (SELECT y, x // 4 AS i, x % 4 AS k, CAST(v AS DOUBLE) AS v FROM px WHERE x % 4 < 3 AND y IN (SELECT vec_id FROM embeddings WHERE len(embedding) = 64)),
tx0 AS (SELECT y, i, max(v) FILTER (WHERE k = 0) AS r, max(v) FILTER (WHERE k = 1) AS g, max(v) FILTER (WHERE k = 2) AS b FROM ch GROUP BY y, i),
c0 AS (SELECT y, arg_min({{'r': r, 'g': g, 'b': b}}, (r + g + b) * 16 + i) AS lo, arg_min({{'r': r, 'g': g, 'b': b}}, -(r + g + b) * 16 + i) AS hi FROM tx0 GROUP BY y)"""
    d = lambda c: "(" + " + ".join(f"(t.{n} - c.{c}.{n}) * (t.{n} - c.{c}.{n})" for n in "rgb") + ")"
    mean = lambda s, c: f"CASE WHEN count(*) FILTER (WHERE s = {s}) > 0 THEN {{{', '.join(f"'{n}': sum({n}) FILTER (WHERE s = {s}) / count(*) FILTER (WHERE s = {s})" for n in 'rgb')}}} ELSE any_value(a.{c}) END AS {c}"
    for k in range(1, 5):
        out += f",\ns{k} AS (SELECT t.*, CASE WHEN {d('hi')} < {d('lo')} THEN 1 ELSE 0 END AS s FROM tx0 t JOIN c{k - 1} c USING (y))"
        out += f",\nc{k} AS (SELECT y, {mean(0, 'lo')}, {mean(1, 'hi')} FROM s{k} JOIN c{k - 1} a USING (y) GROUP BY y)"
    return out + ",\nmk AS (SELECT y, CAST(sum(s << CAST(i AS INTEGER)) AS BIGINT) AS mask FROM s4 GROUP BY y)"


BLOCK_MASKS = f"WITH {_means_sql()} SELECT y, mask FROM mk"


def hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 4 two-part patterns nearest to each block's clusters, by differing texels or those of the complement; ties by seed.

    The 1024 patterns of the format are one array beside each block, so the search stays inside its row.
    """
    two = partition_texels(spark).where("parts = 2").groupBy("seed").agg(F.sum(F.col("part") * F.pow(F.lit(2), F.col("texel")).cast("long")).alias("m")).where("m not in (0, 65535)")
    patterns = two.agg(F.array_sort(F.collect_list(F.struct("seed", "m"))).alias("all"))  # a single row
    differ = lambda p: F.bit_count(F.col("mask").bitwiseXOR(p["m"]))
    near = F.transform("all", lambda p: F.struct(F.least(differ(p), 16 - differ(p)).alias("bits"), p["seed"].alias("seed")))
    four = block_masks(spark, sf_dir).crossJoin(F.broadcast(patterns)).select("y", F.slice(F.array_sort(near), 1, 4).alias("four"))
    return four.select("y", F.posexplode("four").alias("rank", "b")).select("y", "rank", F.col("b.seed").alias("seed"), F.col("b.bits").alias("bits"))


HAMMING_TOPK = f"""WITH {_means_sql()}, {_TEXELS},
pt AS (SELECT seed, CAST(sum(part << CAST(texel AS INTEGER)) AS BIGINT) AS m FROM tx WHERE parts = 2 GROUP BY seed),
k AS (SELECT y, seed, bit_count(xor(mask, m)) AS b FROM mk, pt WHERE m NOT IN (0, 65535)),
r AS (SELECT y, seed, CAST(least(b, 16 - b) AS INTEGER) AS bits FROM k)
SELECT y, CAST(row_number() OVER (PARTITION BY y ORDER BY bits, seed) - 1 AS INTEGER) AS rank, seed, bits FROM r QUALIFY rank < 4"""


def unquantise(v: Column, levels: int) -> Column:
    """A colour value of a range of ``levels`` as 0 to 255."""
    if levels & (levels - 1) == 0:
        return replicate(v, levels.bit_length() - 1, 8)
    spread, factor = SPREADS[levels]
    n = (levels // (3 if levels % 3 == 0 else 5)).bit_length() - 1
    bit = lambda i: F.shiftright(v, i).bitwiseAND(F.lit(1))
    b = F.lit(0).cast("long")
    for place, letter in zip(range(8, -1, -1), spread, strict=True):
        if letter != "0":
            b = b.bitwiseOR(F.shiftleft(bit(ord(letter) - ord("a")), place))
    flip = F.when(bit(0) == 1, 0x1FF).otherwise(0)
    t = (F.shiftright(v, n) * factor + b).bitwiseXOR(flip.cast("long"))
    return flip.bitwiseAND(F.lit(0x80)).cast("long").bitwiseOR(F.shiftright(t, 2))


def colour_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values of the 17 colour ranges of 6 to 256 levels as 0 to 255."""
    out = None
    for levels in sorted([*SPREADS, *(1 << n for n in range(3, 9))]):
        part = spark.range(levels).select(F.lit(levels).alias("levels"), F.col("id").alias("v"), unquantise(F.col("id"), levels).alias("wide"))
        out = part if out is None else out.unionByName(part)
    return out


def _range_sql(levels: int) -> str:
    if levels & (levels - 1) == 0:
        n = levels.bit_length() - 1
        wide = " | ".join(f"(v << {sh})" if sh >= 0 else f"(v >> {-sh})" for sh in range(8 - n, -n, -n))
        return f"SELECT {levels} AS levels, v, ({wide}) & 255 AS wide FROM range({levels}) AS t(v)"
    spread, factor = SPREADS[levels]
    n = (levels // (3 if levels % 3 == 0 else 5)).bit_length() - 1
    b = " + ".join(["0", *(f"(((v >> {ord(c) - 97}) & 1) << {p})" for p, c in zip(range(8, -1, -1), spread, strict=True) if c != "0")])
    return f"SELECT {levels} AS levels, v, ((v & 1) * 128) | (xor((v >> {n}) * {factor} + {b}, (v & 1) * 511) >> 2) AS wide FROM range({levels}) AS t(v)"


COLOUR_RANGES = " UNION ALL ".join(_range_sql(n) for n in sorted([*SPREADS, *(1 << n for n in range(3, 9))]))


def _bits(v: Column, at: int, n: int = 1) -> Column:
    return F.shiftright(v, at).bitwiseAND(F.lit((1 << n) - 1))


def trit_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five trits of each value of 8 bits, as the format packs them."""
    t = spark.range(256).select(F.col("id").alias("packed"))
    p = F.col("packed")
    full, high = _bits(p, 2, 3) == 7, _bits(p, 5, 2) == 3
    c = F.when(full, F.shiftleft(_bits(p, 5, 3), 2).bitwiseOR(_bits(p, 0, 2))).otherwise(_bits(p, 0, 5))
    t = t.select("packed", c.alias("c"), F.when(full | high, 2).otherwise(_bits(p, 7)).alias("t4"), F.when(full, 2).when(high, _bits(p, 7)).otherwise(_bits(p, 5, 2)).alias("t3"))
    c = F.col("c")
    first, second = _bits(c, 0, 2) == 3, _bits(c, 2, 2) == 3
    low = lambda a, b: F.shiftleft(_bits(c, b), 1).bitwiseOR(_bits(c, a) * (1 - _bits(c, b)))
    t2, t1 = F.when(first | second, 2).otherwise(_bits(c, 4)), F.when(first, _bits(c, 4)).when(second, 2).otherwise(_bits(c, 2, 2))
    t0 = F.when(first, low(2, 3)).when(second, _bits(c, 0, 2)).otherwise(low(0, 1))
    return t.select("packed", *[x.cast("long").alias(n) for x, n in ((t0, "t0"), (t1, "t1"), (t2, "t2"), (F.col("t3"), "t3"), (F.col("t4"), "t4"))])


TRIT_BLOCKS = """WITH p AS (SELECT range AS p, (range >> 2) & 7 = 7 AS f, (range >> 5) & 3 = 3 AS g FROM range(256)),
c AS (SELECT *, CASE WHEN f THEN ((p >> 5) & 7) * 4 + (p & 3) ELSE p & 31 END AS c, CASE WHEN f OR g THEN 2 ELSE p >> 7 END AS t4, CASE WHEN f THEN 2 WHEN g THEN p >> 7 ELSE (p >> 5) & 3 END AS t3 FROM p)
SELECT p AS packed, CASE WHEN c & 3 = 3 THEN CASE WHEN c & 8 = 8 THEN 2 ELSE (c >> 2) & 1 END WHEN c & 12 = 12 THEN c & 3 WHEN c & 2 = 2 THEN 2 ELSE c & 1 END AS t0,
CASE WHEN c & 3 = 3 THEN c >> 4 WHEN c & 12 = 12 THEN 2 ELSE (c >> 2) & 3 END AS t1, CASE WHEN c & 3 = 3 OR c & 12 = 12 THEN 2 ELSE c >> 4 END AS t2, CAST(t3 AS BIGINT) AS t3, CAST(t4 AS BIGINT) AS t4 FROM c"""


def quint_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three quints of each value of 7 bits, as the format packs them."""
    q = spark.range(128).select(F.col("id").alias("packed"))
    p = F.col("packed")
    four = _bits(p, 1, 2) == 3
    both = four & (_bits(p, 5, 2) == 0)
    c = F.when(four, F.shiftleft(_bits(p, 3, 2), 3).bitwiseOR(F.shiftleft(3 - _bits(p, 5, 2), 1)).bitwiseOR(_bits(p, 0))).otherwise(_bits(p, 0, 5))
    odd = 1 - _bits(p, 0)
    top = F.shiftleft(_bits(p, 0), 2).bitwiseOR(F.shiftleft(_bits(p, 4) * odd, 1)).bitwiseOR(_bits(p, 3) * odd)
    q = q.select("packed", both.alias("both"), c.alias("c"), F.when(both, top).when(four, 4).otherwise(_bits(p, 5, 2)).alias("q2"))
    c, five = F.col("c"), _bits(F.col("c"), 0, 3) == 5
    q1 = F.when(F.col("both") | five, 4).otherwise(_bits(c, 3, 2))
    q0 = F.when(F.col("both"), 4).when(five, _bits(c, 3, 2)).otherwise(_bits(c, 0, 3))
    return q.select("packed", q0.cast("long").alias("q0"), q1.cast("long").alias("q1"), F.col("q2").cast("long").alias("q2"))


QUINT_BLOCKS = """WITH p AS (SELECT range AS p, (range >> 1) & 3 = 3 AS f, (range >> 1) & 3 = 3 AND (range >> 5) & 3 = 0 AS b FROM range(128)),
c AS (SELECT *, CASE WHEN f THEN ((p >> 3) & 3) * 8 + (3 - ((p >> 5) & 3)) * 2 + (p & 1) ELSE p & 31 END AS c,
  CASE WHEN b THEN CASE WHEN p & 1 = 1 THEN 4 ELSE ((p >> 4) & 1) * 2 + ((p >> 3) & 1) END WHEN f THEN 4 ELSE (p >> 5) & 3 END AS q2 FROM p)
SELECT p AS packed, CAST(CASE WHEN b THEN 4 WHEN c & 7 = 5 THEN (c >> 3) & 3 ELSE c & 7 END AS BIGINT) AS q0, CAST(CASE WHEN b OR c & 7 = 5 THEN 4 ELSE (c >> 3) & 3 END AS BIGINT) AS q1, CAST(q2 AS BIGINT) AS q2 FROM c"""


def motion_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best displacement (up to 2 rows and 4 columns) of each block of 8 x 8 pixels within the image 16 rows above: differences and
    8 for each step away, so that ties go to the shorter one; then the smaller.
    """
    dy, dx = np.arange(-2, 3), np.arange(-4, 5)
    price = 8 * (np.abs(dy)[:, None] + np.abs(dx))
    at = np.clip(np.arange(WIDTH) + dx[:, None], 0, WIDTH - 1)

    def best(row: int, own: list, ref: list) -> list[tuple]:
        below, above = dict(own), dict(ref)
        if len(below) == len(own) and len(above) == len(ref) and all(len(v) == WIDTH for _, v in (*own, *ref)):
            if len(own) < 8:
                return []
            now = np.stack([below[8 * row + i] for i in range(8)])
            lines = np.stack([above.get(8 * row - 18 + i, np.zeros(WIDTH, np.int64)) for i in range(12)])
            there = np.array([8 * row - 18 + i in above for i in range(12)])
            whole = np.array([there[k : k + 8].all() for k in range(5)])
            moved = np.stack([lines[k : k + 8] for k in range(5)])[:, :, at]
            sad = np.abs(moved - now[None, :, None, :]).reshape(5, 8, 9, WIDTH // 8, 8).sum((1, 4))
            n = np.broadcast_to(np.where(whole, 64, 0)[:, None, None], sad.shape)
        else:  # rows that are missing pixels or occur twice: each meets each
            cols = -(-max(len(v) for _, v in own) // 8)
            sad, n = np.zeros((5, 9, cols), np.int64), np.zeros((5, 9, cols), np.int64)
            for y, v in own:
                for k in range(5):
                    for z, r in ref:
                        if z == y - 16 + dy[k] and len(v) and len(r):
                            d, m = moved_differences(v, r, dx, 8)
                            sad[k, :, : d.shape[1]] += d
                            n[k, :, : d.shape[1]] += m
        cost = np.where(n == 64, sad + price[:, :, None], np.iinfo(np.int64).max).reshape(45, -1)
        out = []
        for col, i in enumerate(cost.argmin(0).tolist()):
            if n[i // 9, i % 9, col] == 64:
                out.append((row, col, int(dy[i // 9]), int(dx[i % 9]), int(sad[i // 9, i % 9, col]), int(cost[i, col])))
        return out

    first, last = (lambda y: F.ceil((y + 7) / 8)), (lambda y: F.floor((y + 18) / 8))
    return search_rows(spark, sf_dir, lambda y: F.floor(y / 8), first, last, best, "row long, col long, dy int, dx int, sad long, cost long")


MOTION_SEARCH = f"""WITH {_PIXELS}, m AS (SELECT y, x, v, CAST(dy AS INTEGER) AS dy, CAST(dx AS INTEGER) AS dx, y - 16 + dy AS ry, greatest(0, least(63, x + dx)) AS rx FROM px, range(-2, 3) AS a(dy), range(-4, 5) AS b(dx)),
c AS (SELECT m.y // 8 AS "row", m.x // 8 AS "col", dy, dx, CAST(sum(abs(m.v - r.v)) AS BIGINT) AS sad FROM m JOIN px r ON r.y = m.ry AND r.x = m.rx GROUP BY ALL HAVING count(*) = 64)
SELECT "row", "col", dy, dx, sad, sad + 8 * (abs(dx) + abs(dy)) AS cost FROM c QUALIFY row_number() OVER (PARTITION BY "row", "col" ORDER BY sad + 8 * (abs(dx) + abs(dy)), dy, dx) = 1"""


def mip_srgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next smaller level of sRGB values: means of 2 x 2 pixels in linear light, encoded and rounded; an odd last row or
    column is dropped, a single one is taken twice."""
    p = _pixels(spark, sf_dir)
    light = F.when(F.col("v") / 255.0 <= 0.04045, F.col("v") / 255.0 / 12.92).otherwise(F.pow((F.col("v") / 255.0 + 0.055) / 1.055, F.lit(2.4)))
    # equal values are counted first, so that a mean does not depend on the order of its sum
    g = p.groupBy(F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x")).agg(F.array_sort(F.collect_list(light)).alias("four")).where("size(four) = 4")
    mean = F.aggregate("four", F.lit(0.0), lambda a, b: a + b) / 4
    code = F.when(mean <= 0.0031308, mean * 12.92).otherwise(1.055 * F.pow(mean, F.lit(1 / 2.4)) - 0.055)
    return g.select("y", "x", F.floor(code * 255 + 0.5).alias("v"))


MIP_SRGB = f"""WITH {_PIXELS}, l AS (SELECT y // 2 AS gy, x // 2 AS gx, CASE WHEN v / 255.0::DOUBLE <= 0.04045 THEN v / 255.0::DOUBLE / 12.92 ELSE pow((v / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END AS f FROM px),
g AS (SELECT gy, gx, list_reduce(list(f ORDER BY f), lambda a, b: a + b) / 4 AS m FROM l GROUP BY 1, 2 HAVING count(*) = 4)
SELECT gy AS y, gx AS x, CAST(floor(CASE WHEN m <= 0.0031308 THEN m * 12.92 ELSE 1.055::DOUBLE * pow(m, 1 / 2.4::DOUBLE) - 0.055 END * 255 + 0.5) AS BIGINT) AS v FROM g"""


def srgb_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear light of each sRGB value, and where it rounds up to the next."""
    light = lambda c: F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))
    k = spark.range(256).select(F.col("id").alias("k"))
    return k.select("k", F.round(light(F.col("k") / 255.0), 9).alias("linear"), F.when(F.col("k") < 255, F.round(light((F.col("k") + 0.5) / 255.0), 9)).alias("threshold"))


SRGB_THRESHOLDS = """WITH k AS (SELECT range AS k, range / 255.0::DOUBLE AS a, (range + 0.5::DOUBLE) / 255 AS b FROM range(256))
SELECT k, round(CASE WHEN a <= 0.04045 THEN a / 12.92 ELSE pow((a + 0.055) / 1.055, 2.4) END, 9) AS linear,
  CASE WHEN k < 255 THEN round(CASE WHEN b <= 0.04045 THEN b / 12.92 ELSE pow((b + 0.055) / 1.055, 2.4) END, 9) END AS threshold FROM k"""


def difference_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight times the difference of each pixel from the one a row above, at most 255."""
    p = _pixels(spark, sf_dir).select("y", "x", "v")
    other = p.select((F.col("y") + 1).alias("y"), "x", F.col("v").alias("w"))
    return p.join(other, ["y", "x"]).select("y", "x", F.least(F.lit(255), F.abs(F.col("v") - F.col("w")) * 8).alias("d"))


DIFFERENCE_VIEW = f"WITH {_PIXELS} SELECT a.y, a.x, least(255, abs(a.v - b.v) * 8) AS d FROM px a JOIN px b ON b.y = a.y - 1 AND b.x = a.x"


def block_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounded mean and activity (sum of differences from it) of each block of 16 x 16 pixels, and whether it is worth coding
    without a reference: if the activity is below twice the difference from the block one row up."""
    p = _pixels(spark, sf_dir).select("y", "x", "v")
    up = p.select((F.col("y") + 1).alias("y"), "x", F.col("v").alias("w"))
    block = [F.floor(F.col("y") / 16).alias("row"), F.floor(F.col("x") / 16).alias("col")]
    px = p.join(up, ["y", "x"], "left").select(*block, "v", "w")
    mean = px.groupBy("row", "col").agg(F.shiftright(F.sum(F.col("v").cast("long")) + 128, 8).alias("mean"), F.count("*").alias("n")).where("n = 256").drop("n")
    s = px.join(mean, ["row", "col"]).groupBy("row", "col", "mean").agg(F.sum(F.abs(F.col("v") - F.col("mean"))).alias("activity"), F.sum(F.abs(F.col("v") - F.coalesce("w", F.lit(128))).cast("long")).alias("sad"))
    return s.select("row", "col", "mean", "activity", "sad", (F.col("activity") < 2 * F.col("sad")).alias("try_alone"))


BLOCK_ACTIVITY = f"""WITH {_PIXELS}, b AS (SELECT a.y // 16 AS "row", a.x // 16 AS "col", a.v, coalesce(u.v, 128) AS w FROM px a LEFT JOIN px u ON u.y = a.y - 1 AND u.x = a.x),
m AS (SELECT "row", "col", (CAST(sum(v) AS BIGINT) + 128) >> 8 AS mean FROM b GROUP BY "row", "col" HAVING count(*) = 256),
s AS (SELECT "row", "col", mean, CAST(sum(abs(v - mean)) AS BIGINT) AS activity, CAST(sum(abs(v - w)) AS BIGINT) AS sad FROM b JOIN m USING ("row", "col") GROUP BY "row", "col", mean)
SELECT *, activity < 2 * sad AS try_alone FROM s"""


def block_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and scaled covariances of the first three channels of each block of 16 texels: all that a principal axis needs."""
    p = _pixels(spark, sf_dir).select("y", F.floor(F.col("x") / 4).alias("i"), (F.col("x") % 4).alias("k"), F.col("v").cast("long").alias("v"))
    t = p.groupBy("y", "i").agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(n) for k, n in enumerate("rgb")])
    s = t.groupBy("y").agg(F.count("*").alias("n"), *[F.sum(n).alias(f"s{n}") for n in "rgb"], *[F.sum(F.col(a) * F.col(b)).alias(f"s{a}{b}") for a, b in ("rr", "rg", "rb", "gg", "gb", "bb")])
    return s.select("y", *[f"s{n}" for n in "rgb"], *[(F.col("n") * F.col(f"s{a}{b}") - F.col(f"s{a}") * F.col(f"s{b}")).alias(f"c{a}{b}") for a, b in ("rr", "rg", "rb", "gg", "gb", "bb")])


BLOCK_MOMENTS = f"""WITH {_PIXELS}, c AS (SELECT y, x // 4 AS i, x % 4 AS k, CAST(v AS BIGINT) AS v FROM px),
t AS (SELECT y, i, max(v) FILTER (WHERE k = 0) AS r, max(v) FILTER (WHERE k = 1) AS g, max(v) FILTER (WHERE k = 2) AS b FROM c GROUP BY y, i)
SELECT y, CAST(sum(r) AS BIGINT) AS sr, CAST(sum(g) AS BIGINT) AS sg, CAST(sum(b) AS BIGINT) AS sb,
{', '.join(f"CAST(count(*) * sum({a} * {b}) - sum({a}) * sum({b}) AS BIGINT) AS c{a}{b}" for a, b in ("rr", "rg", "rb", "gg", "gb", "bb"))} FROM t GROUP BY y"""


def image_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each level: rows against the 2 x 2 means below them, by block of 16 rows."""
    p = _pixels(spark, sf_dir).select("y", "x", F.col("v").cast("long").alias("v"))
    g = [F.floor(F.col("y") / 2).alias("gy"), F.floor(F.col("x") / 2).alias("gx")]
    m = p.groupBy(*g).agg(F.shiftright(F.sum("v") + 2, 2).alias("m"), F.count("*").alias("n")).where("n = 4").drop("n")
    d = p.select("y", *g, "v").join(m, ["gy", "gx"])
    s = d.groupBy(F.floor(F.col("y") / 16).alias("band")).agg(F.sum((F.col("v") - F.col("m")) * (F.col("v") - F.col("m"))).alias("sse"), F.count("*").alias("n"))
    return s.select("band", "sse", F.round(psnr_of(F.col("sse"), F.col("n")), 6).alias("psnr"))


IMAGE_QUALITY = f"""WITH {_PIXELS}, m AS (SELECT y // 2 AS gy, x // 2 AS gx, (CAST(sum(v) AS BIGINT) + 2) >> 2 AS m FROM px GROUP BY 1, 2 HAVING count(*) = 4),
s AS (SELECT y // 16 AS band, CAST(sum((v - m) * (v - m)) AS BIGINT) AS sse, count(*) AS n FROM px JOIN m ON gy = y // 2 AND gx = x // 2 GROUP BY 1)
SELECT band, sse, round(CASE WHEN sse = 0 THEN 99.0::DOUBLE ELSE 10 * log10(65025.0::DOUBLE * n / sse) END, 6) AS psnr FROM s"""

QUERIES = {
    "half_floats": (half_floats, HALF_FLOATS),
    "endpoints": (endpoints, ENDPOINTS),
    "bit_replication": (bit_replication, BIT_REPLICATION),
    "partition_patterns": (partition_patterns, PARTITION_PATTERNS),
    "partition_checksum": (partition_checksum, PARTITION_CHECKSUM),
    "block_masks": (block_masks, BLOCK_MASKS),
    "hamming_topk": (hamming_topk, HAMMING_TOPK),
    "colour_ranges": (colour_ranges, COLOUR_RANGES),
    "trit_blocks": (trit_blocks, TRIT_BLOCKS),
    "quint_blocks": (quint_blocks, QUINT_BLOCKS),
    "motion_search": (motion_search, MOTION_SEARCH),
    "mip_srgb": (mip_srgb, MIP_SRGB),
    "srgb_thresholds": (srgb_thresholds, SRGB_THRESHOLDS),
    "difference_view": (difference_view, DIFFERENCE_VIEW),
    "block_activity": (block_activity, BLOCK_ACTIVITY),
    "block_moments": (block_moments, BLOCK_MOMENTS),
    "image_quality": (image_quality, IMAGE_QUALITY),
}
