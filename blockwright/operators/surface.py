"""The engine's surface as queries: SQL functions, containers written and read as data sources, synthetic packets."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwright.functions import registry
from blockwright.session import bound_batches, shared_folder, spread, table
from blockwright.sources import datasource


def sql_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message coded and decoded by SQL functions, by the method of its turn."""
    registry.register(spark)
    bound_batches(spark, 1 << 20)
    rows = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw")))
    method = F.element_at(F.array(*map(F.lit, ("plain", "lazy", "entropy", "entropy3", "turbo", "huffman"))), (F.pmod("turn", F.lit(6)) + 1).cast("int"))
    coded = rows.withColumn("method", method).withColumn("coded", F.call_function("bw_encode", F.col("raw"), F.col("method")))
    back = coded.withColumn("back", F.call_function("bw_decode", F.col("coded"), F.length("raw"), F.col("method")))
    return back.select("conv_id", "turn", "method", F.length("back").cast("long").alias("n"), F.md5("back").alias("digest"))


SQL_ROUND_TRIP = """SELECT conv_id, turn, (['plain', 'lazy', 'entropy', 'entropy3', 'turbo', 'huffman'])[turn % 6 + 1] AS method,
CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n, md5(coalesce(text, '')) AS digest FROM conversations"""


def sql_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greedy parse of every passage by a table function: its literals and matches add up to the passage."""
    registry.register(spark)
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"))
    rows.createOrReplaceTempView("bw_passages")
    s = spark.sql("SELECT item_id, literals, length FROM bw_passages, LATERAL bw_sequences(raw)")
    return s.groupBy("item_id").agg(F.sum(F.col("literals") + F.col("length")).alias("n"))


SQL_SEQUENCES = "SELECT item_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM benchmark"


def sink_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a file of an archive that tasks write in blocks of 4 KB, read back by tasks."""
    datasource.register(spark)
    path = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}.pak"
    pages = table(spark, sf_dir, "pages").select(F.format_string("p/%012d", "page_id").alias("name"), F.col("html").cast("binary").alias("content"))
    datasource.cut(pages, 4096).write.format("archives").option("block", 4096).option("methods", "1").mode("append").save(path)
    got = spark.read.format("archives").load(path)
    return got.select(F.substring("name", 3, 12).cast("long").alias("page_id"), F.length("data").cast("long").alias("n"), F.md5("data").alias("digest"))


SINK_ARCHIVE = "SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS n, md5(html) AS digest FROM pages"


def sink_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as packets of a clip that tasks write, read back by its index; the first packet counts as a keyframe."""
    datasource.register(spark)
    path = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}.clip"
    e = table(spark, sf_dir, "events").select("event_id", F.coalesce("props", F.lit("")).cast("binary").alias("packet"), (F.col("event_type") == "purchase").alias("is_key"))
    first = e.agg(F.min("event_id")).first()[0]
    rows = e.select(F.col("event_id").alias("frame_no"), "packet", (F.col("is_key") | (F.col("event_id") == F.lit(first))).alias("is_key"))
    rows = rows.repartitionByRange("frame_no").sortWithinPartitions("frame_no")  # the commit need not merge what follows one another
    rows.write.format("clips").options(width=64, height=48, rate=30).mode("append").save(path)
    return spark.read.format("clips").load(path).select("frame_no", "is_key", "size", F.md5("data").alias("digest"))


SINK_CLIP = """SELECT row_number() OVER (ORDER BY event_id) - 1 AS frame_no, event_type = 'purchase' OR event_id = (SELECT min(event_id) FROM events) AS is_key,
CAST(octet_length(encode(coalesce(props, ''))) AS BIGINT) AS size, md5(coalesce(props, '')) AS digest FROM events"""

#: Multiplier and increment of the generator of synthetic traffic, modulo 2**32.
STEP, ADD, M32 = 1103515245, 12345, 1 << 32


def draw(state: Column, k: int) -> Column:
    """The k-th pseudo-random number of 15 bits of a state."""
    for _ in range(k):
        state = F.pmod(state * STEP + ADD, F.lit(M32))
    return F.shiftright(state, 16).bitwiseAND(F.lit(32767))


def synthetic_packets(spark: SparkSession, count: int, phased: bool = False, seed: int = 1) -> DataFrame:
    """(pkt_id, kind, ents, payload): messages of 8 kinds (at random, or one kind after the other) with a header (kind, 1, number,
    entities) and entities (id, one to three coordinates, hit points, state)."""
    p = spark.range(count).select(F.col("id").alias("pkt_id"), F.pmod((F.col("id") + seed) * 2654435761, F.lit(M32)).alias("s"))
    kind = F.floor(F.col("pkt_id") * 8 / count) if phased else draw(F.col("s"), 1) % 8
    p = p.select("pkt_id", kind.cast("long").alias("kind"), (draw(F.col("s"), 2) % 6 + 1).alias("ents"), draw(F.col("s"), 3).alias("r"))
    word = lambda v, n: F.lpad(F.hex(v), 2 * n, "0")
    entity = lambda i: F.concat(word(F.pmod(F.col("r") + i * 7, F.lit(256)), 4), F.expr("repeat('3F800000', cast(kind % 3 as int) + 1)"), word(F.pmod(F.col("r") * (i + 1), F.lit(65536)), 2), word(F.pmod(F.col("r") + i, F.lit(5)), 1))
    body = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("ents") - 1), entity), "")
    head = F.concat(word(192 + F.col("kind"), 1), F.lit("01"), word(F.col("pkt_id") % 256, 1), word(F.col("ents"), 1))
    return p.select("pkt_id", "kind", "ents", F.unhex(F.concat(head, body)).alias("payload"))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20,000 synthetic messages at random and as many by phases: their kinds, entities, sizes and digests."""
    both = [synthetic_packets(spark, 20_000, phased).withColumn("phased", F.lit(phased)) for phased in (False, True)]
    return both[0].unionByName(both[1]).select("phased", "pkt_id", "kind", "ents", F.length("payload").cast("long").alias("size"), F.md5("payload").alias("digest"))


def _drawn(k: int) -> str:
    s = "s"
    for _ in range(k):
        s = f"(({s} * {STEP} + {ADD}) % {M32})"
    return f"(({s} >> 16) & 32767)"


PACKETS = f"""WITH p AS (SELECT phased, id, ((id + 1)::HUGEINT * 2654435761 % {M32})::BIGINT AS s FROM range(20000) AS t(id), (VALUES (false), (true)) AS f(phased)),
k AS (SELECT phased, id, CASE WHEN phased THEN id * 8 // 20000 ELSE {_drawn(1)} % 8 END AS kind, {_drawn(2)} % 6 + 1 AS ents, {_drawn(3)} AS r FROM p),
h AS (SELECT *, printf('%02X01%02X%02X', 192 + kind, id % 256, ents) || list_aggregate(list_transform(range(0, ents), lambda i: printf('%08X', (r + i * 7) % 256) || repeat('3F800000', CAST(kind % 3 + 1 AS BIGINT)) || printf('%04X%02X', r * (i + 1) % 65536, (r + i) % 5)), 'string_agg', '') AS x FROM k)
SELECT phased, id AS pkt_id, CAST(kind AS BIGINT) AS kind, ents, CAST(length(x) // 2 AS BIGINT) AS size, md5(unhex(x)) AS digest FROM h"""

QUERIES = {
    "sql_round_trip": (sql_round_trip, SQL_ROUND_TRIP),
    "sql_sequences": (sql_sequences, SQL_SEQUENCES),
    "sink_archive": (sink_archive, SINK_ARCHIVE),
    "sink_clip": (sink_clip, SINK_CLIP),
    "packets": (packets, PACKETS),
}
