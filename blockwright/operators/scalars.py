"""Queries over the small column functions, and reports that use them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blockwright.functions import columns as C
from blockwright.operators.matching import common_prefix
from blockwright.session import table


def size_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of blocks and frames, hash buckets and bit positions of order keys."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") * 977 + 1).alias("n"))
    n = F.col("n")
    return o.select("k", C.block_bound(n).alias("bound"), C.frame_bound(n, 65536).alias("frame_bound"), C.multiplicative_hash(n, 16).alias("bucket"), C.log2_floor(n).alias("high_bit"), C.trailing_zeros(n).alias("low_bit"), F.bit_count(n).alias("ones"))


SIZE_BOUNDS = """WITH o AS (SELECT o_orderkey AS k, o_orderkey * 977 + 1 AS n FROM orders)
SELECT k, n + n // 255 + 16 AS bound, 16 + 9 * ((n + 65535) // 65536) + n AS frame_bound, CAST(((n::HUGEINT * 2654435761) % 4294967296) // 65536 AS BIGINT) AS bucket,
CAST(length(bin(n)) - 1 AS INTEGER) AS high_bit, CAST(length(regexp_extract(bin(n), '(0*)$', 1)) AS INTEGER) AS low_bit, CAST(bit_count(n) AS INTEGER) AS ones FROM o"""


def token_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tokens with their fields, context group and the plain sizes of their lengths."""
    t = spark.range(256).select(F.col("id").alias("token"))
    return t.select("token", F.shiftright("token", 4).alias("literals"), F.col("token").bitwiseAND(F.lit(15)).alias("match"), C.token_groups(F.col("token")).cast("long").alias("grp"), F.shiftright("token", 4).alias("literal_grp"), C.command_groups(F.col("token")).cast("long").alias("command_grp"), C.price_groups(F.col("token")).cast("long").alias("price_grp"))


TOKEN_FIELDS = """WITH t AS (SELECT range AS token, range >> 4 AS l, range & 15 AS m FROM range(256))
SELECT token, l AS literals, m AS match, CAST(CASE WHEN l < 2 THEN l WHEN l < 4 THEN 2 ELSE 3 END * 4 + CASE WHEN m < 2 THEN 0 WHEN m < 5 THEN 1 WHEN m < 15 THEN 2 ELSE 3 END AS BIGINT) AS grp, l AS literal_grp,
CAST((token & 3) * 4 + CASE WHEN (token >> 2) & 15 < 2 THEN 0 WHEN (token >> 2) & 15 < 5 THEN 1 WHEN (token >> 2) & 15 < 15 THEN 2 ELSE 3 END AS BIGINT) AS command_grp,
CAST(least(l, 3) * 4 + CASE WHEN m < 2 THEN 0 WHEN m < 5 THEN 1 WHEN m < 15 THEN 2 ELSE 3 END AS BIGINT) AS price_grp FROM t"""


def split_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match lengths as the parts that short commands can take."""
    m = table(spark, sf_dir, "lineitem").select((F.col("l_quantity").cast("int") * 2 + 4).alias("ml")).groupBy("ml").agg(F.count("*").alias("n"))
    return m.select("ml", "n", F.posexplode(C.split_match(F.col("ml"))).alias("part", "size"))


SPLIT_MATCHES = """WITH m AS (SELECT CAST(l_quantity AS INTEGER) * 2 + 4 AS ml, count(*) AS n FROM lineitem GROUP BY 1),
a AS (SELECT *, CASE WHEN ml BETWEEN 33 AND 96 THEN least(32, ml - 4) ELSE ml END AS f FROM m), b AS (SELECT *, ml - f AS r FROM a),
c AS (SELECT *, CASE WHEN r > 32 THEN least(32, r - 4) ELSE r END AS s FROM b),
d AS (SELECT ml, n, unnest([0, 1, 2]) AS part, unnest([f, s, r - s]) AS size FROM c) SELECT ml, n, part, size FROM d WHERE size > 0"""


def colour_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grey and tinted colours through 565 and linear light."""
    c = spark.range(256).select(F.col("id").alias("v"), (255 - F.col("id")).alias("w"))
    p = c.select("v", C.pack_565(F.col("v"), F.col("w"), F.lit(128).cast("long")).alias("packed"), C.srgb_to_linear(F.col("v")).alias("linear"))
    r, g, b = C.unpack_565(F.col("packed"))
    return p.select("v", "packed", r.alias("r"), g.alias("g"), b.alias("b"), "linear")


COLOUR_BITS = """WITH c AS (SELECT range AS v, 255 - range AS w FROM range(256)),
p AS (SELECT v, (((v * 31 + 127) // 255) << 11) | (((w * 63 + 127) // 255) << 5) | ((128 * 31 + 127) // 255) AS packed,
  CAST(floor(CASE WHEN v / 255.0::DOUBLE <= 0.04045 THEN v / 255.0::DOUBLE / 12.92 ELSE pow((v / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END * 65535 + 0.5) AS BIGINT) AS linear FROM c),
q AS (SELECT *, packed >> 11 & 31 AS r5, packed >> 5 & 63 AS g6, packed & 31 AS b5 FROM p)
SELECT v, packed, (r5 << 3) | (r5 >> 2) AS r, (g6 << 2) | (g6 >> 4) AS g, (b5 << 3) | (b5 >> 2) AS b, linear FROM q"""


def asset_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images by part size: levels, block data, colour tag, size in words."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 37).cast("long").alias("w"), (F.col("p_partkey") % 1200 + 1).alias("h"))
    w, h = F.col("w"), F.col("h")
    return p.select("p_partkey", C.mip_levels(w, h).alias("levels"), C.texture_size(w, h, 8).alias("bytes"), C.colour_tag(h).alias("tag"), C.human(C.texture_size(w, h, 8)).alias("text"))


ASSET_SIZES = """WITH p AS (SELECT p_partkey, CAST(p_size * 37 AS BIGINT) AS w, p_partkey % 1200 + 1 AS h FROM part), s AS (SELECT *, ((w + 3) // 4) * ((h + 3) // 4) * 8 AS b FROM p)
SELECT p_partkey, CAST(length(bin(greatest(w, h))) AS INTEGER) AS levels, b AS bytes, CASE WHEN h >= 720 THEN 'bt709' ELSE 'bt601' END AS tag,
CASE WHEN b < 1000 THEN b || ' B' WHEN b < 1000000 THEN (b // 100) // 10 || '.' || (b // 100) % 10 || ' KB' WHEN b < 1000000000 THEN (b // 100000) // 10 || '.' || (b // 100000) % 10 || ' MB' ELSE 'large' END AS text FROM s"""


def frame_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates as text, as numerator and denominator."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.element_at(F.array(*map(F.lit, ("30", "29.97", "30000/1001", "25", "59.94"))), (F.col("c_custkey") % 5 + 1).cast("int")).alias("text"))
    num, den = C.frame_rate(F.col("text"))
    return c.select("c_custkey", "text", num.alias("num"), den.alias("den"))


FRAME_RATES = """SELECT c_custkey, text, CASE text WHEN '30' THEN 30::BIGINT WHEN '29.97' THEN 29970 WHEN '30000/1001' THEN 30000 WHEN '25' THEN 25 ELSE 59940 END AS num,
CASE text WHEN '30000/1001' THEN 1001::BIGINT WHEN '29.97' THEN 1000 WHEN '59.94' THEN 1000 ELSE 1 END AS den
FROM (SELECT c_custkey, (['30', '29.97', '30000/1001', '25', '59.94'])[c_custkey % 5 + 1] AS text FROM customer)"""


def header_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 32-bit and the next 16-bit word of each page, little-endian."""
    p = table(spark, sf_dir, "pages").where("octet_length(html) >= 6").select("page_id", F.col("html").cast("binary").alias("b"))
    return p.select("page_id", C.little_endian(F.col("b"), 0, 4).alias("first"), C.little_endian(F.col("b"), 4, 2).alias("second"))


HEADER_WORDS = """WITH p AS (SELECT page_id, hex(encode(html)) AS h FROM pages WHERE octet_length(encode(html)) >= 6)
SELECT page_id, ('0x' || h[7:8] || h[5:6] || h[3:4] || h[1:2])::BIGINT AS first, ('0x' || h[11:12] || h[9:10])::BIGINT AS second FROM p"""


def zero_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run and level of each non-zero coefficient: how many zeros come before it in its block."""
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("block"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.greatest(F.lit(0), F.col("l_quantity").cast("int") - 35).alias("level"))
    li = li.withColumn("i", F.row_number().over(Window.partitionBy("block").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")))
    nz = li.where("level <> 0")
    before = F.coalesce(F.lag("i").over(Window.partitionBy("block").orderBy("i")), F.lit(0))
    return nz.select("block", "i", (F.col("i") - before - 1).alias("run"), "level")


ZERO_RUNS = """WITH l AS (SELECT l_orderkey % 500 AS block, greatest(0, CAST(l_quantity AS INTEGER) - 35) AS level,
  CAST(row_number() OVER (PARTITION BY l_orderkey % 500 ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS INTEGER) AS i FROM lineitem)
SELECT block, i, i - coalesce(lag(i) OVER (PARTITION BY block ORDER BY i), 0) - 1 AS run, level FROM l WHERE level <> 0"""


def segment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best window of 57 values of each epoch of 512: the largest sum of frequencies, the first of equals; empty ones are skipped."""
    e = table(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / 512).alias("epoch"), F.floor(F.col("value") / 10).alias("v"))
    freq = e.groupBy("epoch", "v").agg(F.count("*").alias("freq"))
    f = e.join(freq, ["epoch", "v"])
    w = Window.partitionBy("epoch").orderBy("event_id").rowsBetween(0, 56)
    s = f.select("epoch", "event_id", F.sum("freq").over(w).alias("score"), F.count("*").over(w).alias("n")).where("n = 57")
    return s.groupBy("epoch").agg(F.max(F.struct("score", (-F.col("event_id")).alias("neg"))).alias("b")).select("epoch", (-F.col("b.neg")).alias("event_id"), "b.score")


SEGMENT_SCORES = """WITH e AS (SELECT event_id, event_id // 512 AS epoch, floor(value / 10) AS v FROM events),
f AS (SELECT *, count(*) OVER (PARTITION BY epoch, v) AS freq FROM e),
s AS (SELECT epoch, event_id, CAST(sum(freq) OVER w AS BIGINT) AS score, count(*) OVER w AS n FROM f WINDOW w AS (PARTITION BY epoch ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 56 FOLLOWING))
SELECT epoch, event_id, score FROM s WHERE n = 57 QUALIFY row_number() OVER (PARTITION BY epoch ORDER BY score DESC, event_id) = 1"""


def dictionary_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last place in a dictionary (the benchmark passages) of each 4-character key of the part names, and how far the match goes.

    The dictionary's keys are a fixed vocabulary here; its table is aggregated to one row a key before the join. A key is 4
    characters, so that equal keys are equal strings; the rest of the name is then compared with what follows in the dictionary.
    """
    cut = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(t) - 3, F.lit(1))), lambda i: F.substr(t, i, F.lit(4)))
    d = table(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("t")).select("item_id", "t", F.posexplode(cut(F.col("t"))).alias("pos", "key"))
    d = d.groupBy("key").agg(F.max(F.struct("item_id", "pos", F.substr(F.col("t"), F.col("pos") + 1, F.lit(64)).alias("rest"))).alias("last"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("t")).select("p_partkey", "t", F.posexplode(cut(F.col("t"))).alias("at", "key"))
    m = p.join(d, "key").where("char_length(key) = 4")
    return m.select("p_partkey", "at", F.col("last.item_id").alias("item_id"), F.col("last.pos").alias("pos"), common_prefix(F.substr(F.col("t"), F.col("at") + 1, F.lit(64)), F.col("last.rest")).cast("long").alias("len"))


DICTIONARY_MATCHES = """WITH d AS (SELECT item_id, CAST(i AS INTEGER) AS pos, substr(t, CAST(i + 1 AS BIGINT), 4) AS key, substr(t, CAST(i + 1 AS BIGINT), 64) AS rest FROM (SELECT item_id, lower(text) AS t, unnest(range(0, greatest(length(text) - 3, 1))) AS i FROM benchmark)),
l AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY key ORDER BY item_id DESC, pos DESC) = 1),
p AS (SELECT p_partkey, CAST(i AS INTEGER) AS "at", substr(t, CAST(i + 1 AS BIGINT), 4) AS key, substr(t, CAST(i + 1 AS BIGINT), 64) AS own FROM (SELECT p_partkey, lower(p_name) AS t, unnest(range(0, greatest(length(p_name) - 3, 1))) AS i FROM part))
SELECT p_partkey, "at", item_id, pos, CAST(len(list_filter(range(1, least(length(own), length(rest)) + 1), lambda k: left(own, k) = left(rest, k))) AS BIGINT) AS len FROM p JOIN l USING (key) WHERE length(key) = 4"""


def best_of_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fastest round of each codec in interleaved rounds (events as timings)."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("codec")).agg(F.min("value").alias("best"), F.count("*").alias("rounds"))


BEST_OF_ROUNDS = "SELECT event_type AS codec, min(value) AS best, count(*) AS rounds FROM events GROUP BY event_type"


def method_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest of several coded sizes of each order; the earlier method of equals."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", *[(F.col("o_custkey") * m % 97 + 20).alias(n) for n, m in (("stored", 7), ("plain", 11), ("entropy", 13), ("turbo", 17))])
    best = F.array_min(F.array(*[F.struct(F.col(n).alias("size"), F.lit(i).alias("rank"), F.lit(n).alias("method")) for i, n in enumerate(("stored", "plain", "entropy", "turbo"))]))
    return o.select("o_orderkey", best.alias("b")).select("o_orderkey", "b.method", "b.size")


METHOD_CHOICE = """WITH o AS (SELECT o_orderkey, o_custkey * 7 % 97 + 20 AS a, o_custkey * 11 % 97 + 20 AS b, o_custkey * 13 % 97 + 20 AS c, o_custkey * 17 % 97 + 20 AS d FROM orders)
SELECT o_orderkey, CASE least(a, b, c, d) WHEN a THEN 'stored' WHEN b THEN 'plain' WHEN c THEN 'entropy' ELSE 'turbo' END AS method, least(a, b, c, d) AS size FROM o"""


def code_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits of the bytes of each language (documents without one are a class of their own) under their best Huffman code, whose
    lengths are not limited, and how many bytes have a code."""
    import numpy as np
    import pandas as pd

    from blockwright.functions import huffman
    from blockwright.operators.bytes_stats import histogram

    def run(g: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(256, np.int64)
        counts[g.v] = g.n
        lens = huffman.lengths(counts, 64).astype(np.int64)
        return pd.DataFrame([(g.lang.iloc[0], int((lens > 0).sum()), int((counts * lens).sum()))], columns=["lang", "symbols", "bits"])

    # at most 256 rows a group
    d = table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("none")).alias("lang"), "text")
    return histogram(d, "lang", "text").groupBy("lang").applyInPandas(run, "lang string, symbols long, bits long")


#: The two smallest weights are joined until one is left; a code's bits are the sum of all joined weights.
CODE_LENGTHS = """WITH RECURSIVE b AS (SELECT coalesce(lang, 'none') AS lang, hex(encode(coalesce(text, ''))) AS h FROM documents),
k AS (SELECT lang, substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS v FROM (SELECT lang, h, unnest(range(0, length(h) // 2)) AS i FROM b)),
c AS (SELECT lang, v, count(*) AS n FROM k GROUP BY lang, v),
t(lang, l, bits, symbols) AS (SELECT lang, list(n ORDER BY n), CASE WHEN count(*) = 1 THEN CAST(max(n) AS BIGINT) ELSE 0::BIGINT END, count(*) FROM c GROUP BY lang
  UNION ALL SELECT lang, list_sort(list_append(l[3:], l[1] + l[2])), bits + l[1] + l[2], symbols FROM t WHERE len(l) > 1)
SELECT lang, symbols, bits FROM t WHERE len(l) = 1"""

QUERIES = {
    "size_bounds": (size_bounds, SIZE_BOUNDS),
    "token_fields": (token_fields, TOKEN_FIELDS),
    "split_matches": (split_matches, SPLIT_MATCHES),
    "colour_bits": (colour_bits, COLOUR_BITS),
    "asset_sizes": (asset_sizes, ASSET_SIZES),
    "frame_rates": (frame_rates, FRAME_RATES),
    "header_words": (header_words, HEADER_WORDS),
    "zero_runs": (zero_runs, ZERO_RUNS),
    "segment_scores": (segment_scores, SEGMENT_SCORES),
    "dictionary_matches": (dictionary_matches, DICTIONARY_MATCHES),
    "best_of_rounds": (best_of_rounds, BEST_OF_ROUNDS),
    "method_choice": (method_choice, METHOD_CHOICE),
    "code_lengths": (code_lengths, CODE_LENGTHS),
}
