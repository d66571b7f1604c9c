"""Statistics over the bytes of payloads: histograms, contexts, bit costs, entropy plans, block tables.

Histograms are counted in Arrow batches (one row per distinct value leaves a task), never as a row per byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blockwright.session import table

PARTS = 4
BLOCK = 1024
SPLIT = 4096


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return pc.fill_null(batch.column(batch.schema.get_field_index(name)), "").cast(pa.binary()).to_pylist()


def histogram(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, v, n): how often each byte value occurs for each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[object, np.ndarray] = {}
            for k, raw in zip(b.column(0).to_pylist(), _texts(b, text), strict=True):
                found[k] = found.get(k, 0) + np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
            keys, vs, ns = [], [], []
            for k, h in found.items():
                v = np.flatnonzero(h)
                keys += [k] * len(v)
                vs.append(v)
                ns.append(h[v])
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, b.column(0).type), pa.array(np.concatenate(vs), pa.int32()), pa.array(np.concatenate(ns), pa.int64())], ["key", "v", "n"])

    kind = df.schema[key].dataType.simpleString()
    part = df.select(key, text).mapInArrow(run, f"key {kind}, v int, n bigint")
    return part.groupBy(F.col("key").alias(key), "v").agg(F.sum("n").alias("n"))


def byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-0 histogram: how often each byte value occurs in the documents of each language."""
    return histogram(table(spark, sf_dir, "documents"), "lang", "text")


#: Bytes of a text column for SQL: blocks are cut first, then positions inside the block.
def bytes_cte(source: str, keys: str, text: str, block: int = BLOCK) -> str:
    return f"""raw AS (SELECT {keys}, hex(encode({text})) AS h, octet_length(encode({text})) AS n FROM {source}),
blk AS (SELECT {keys}, n, b, substr(h, CAST(b * {2 * block} + 1 AS BIGINT), {2 * block}) AS hb
        FROM (SELECT *, unnest(range(0, (n + {block - 1}) // {block})) AS b FROM raw)),
byt AS (SELECT {keys}, n, b, i, b * {block} + i AS pos, ('0x' || substr(hb, CAST(2 * i + 1 AS BIGINT), 2))::INTEGER AS v
        FROM (SELECT *, unnest(range(0, length(hb) // 2)) AS i FROM blk))"""


BYTE_HISTOGRAM = f"WITH {bytes_cte('documents', 'lang', 'text')} SELECT lang, v, count(*) AS n FROM byt GROUP BY lang, v"


def context_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, cur, n): bytes by the high half of the byte before them; each text has PARTS parts that start in group 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(16 * 256, np.int64)
        for b in batches:
            for raw in _texts(b, "text"):
                if not raw:
                    continue
                v = np.frombuffer(raw, np.uint8)
                before = np.empty(len(v), np.int64)
                before[0] = 0
                before[1:] = v[:-1] >> 4
                before[:: -(-len(v) // PARTS)] = 0
                total += np.bincount(before * 256 + v, minlength=4096)
        i = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i // 256, pa.int32()), pa.array(i % 256, pa.int32()), pa.array(total[i], pa.int64())], ["grp", "cur", "n"])

    part = table(spark, sf_dir, "documents").select("text").mapInArrow(run, "grp int, cur int, n bigint")
    return part.groupBy("grp", "cur").agg(F.sum("n").alias("n"))


CONTEXT_HISTOGRAM = f"""WITH {bytes_cte('documents', 'doc_id', 'text')},
ctx AS (SELECT v AS cur, CASE WHEN pos % ((n + 3) // 4) = 0 THEN 0 ELSE lag(v) OVER (PARTITION BY doc_id ORDER BY pos) // 16 END AS grp FROM byt)
SELECT CAST(grp AS INTEGER) AS grp, cur, count(*) AS n FROM ctx GROUP BY grp, cur"""


def bit_cost_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(v, n, bits): price of each byte value of web pages, log2(total / count) within 1 and 16; unseen values cost 2 more bits."""
    h = histogram(table(spark, sf_dir, "pages").withColumn("one", F.lit(1)), "one", "html").select("v", "n")
    total = h.agg(F.sum("n").alias("total"))
    every = spark.range(256).select(F.col("id").cast("int").alias("v"))
    seen = every.join(h, "v", "left").join(F.broadcast(total))
    bits = F.coalesce(F.log2(F.col("total") / F.col("n")), F.log2(F.col("total").cast("double")) + 2)
    return seen.where("total >= 64").select("v", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.greatest(F.lit(1.0), F.least(F.lit(16.0), bits)), 6).alias("bits"))


BIT_COST_TABLE = f"""WITH {bytes_cte('pages', 'page_id', 'html')},
h AS (SELECT v, count(*) AS n FROM byt GROUP BY v), t AS (SELECT sum(n) AS total FROM h)
SELECT CAST(d.v AS INTEGER) AS v, coalesce(h.n, 0) AS n,
  round(greatest(1.0::DOUBLE, least(16.0::DOUBLE, coalesce(log2(total::DOUBLE / n), log2(total::DOUBLE) + 2))), 6) AS bits
FROM range(256) AS d(v) LEFT JOIN h ON h.v = d.v CROSS JOIN t WHERE total >= 64"""


def entropy_block_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each document with their order-0 entropy bound, the cheaper of stored and coded, and running end offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for k, raw in zip(b.column(0).to_pylist(), _texts(b, "text"), strict=True):
                v = np.frombuffer(raw, np.uint8)
                for i in range(0, len(v), BLOCK):
                    c = np.bincount(v[i : i + BLOCK])
                    c = c[c > 0]
                    n = int(c.sum())
                    bound = float((c * np.log2(n / c)).sum()) / 8
                    out[0].append(k)
                    out[1].append(i // BLOCK)
                    out[2].append(n)
                    out[3].append(int(np.ceil(np.round(bound, 6))))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "blk", "raw", "entropy"])

    blocks = table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(run, "doc_id bigint, blk bigint, raw bigint, entropy bigint")
    size = F.least("raw", F.col("entropy"))
    w = Window.partitionBy("doc_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.select("doc_id", "blk", "raw", "entropy", F.when(F.col("entropy") < F.col("raw"), "coded").otherwise("stored").alias("method"), F.sum(size).over(w).alias("end_offset"))


ENTROPY_BLOCK_PLAN = f"""WITH {bytes_cte('documents', 'doc_id', 'text')},
c AS (SELECT doc_id, b, v, count(*) AS k, sum(count(*)) OVER (PARTITION BY doc_id, b) AS n FROM byt GROUP BY doc_id, b, v),
e AS (SELECT doc_id, b AS blk, CAST(max(n) AS BIGINT) AS raw, CAST(ceil(round(sum(k * log2(n::DOUBLE / k)) / 8, 6)) AS BIGINT) AS entropy FROM c GROUP BY doc_id, b)
SELECT doc_id, blk, raw, entropy, CASE WHEN entropy < raw THEN 'coded' ELSE 'stored' END AS method,
  CAST(sum(least(raw, entropy)) OVER (PARTITION BY doc_id ORDER BY blk) AS BIGINT) AS end_offset FROM e"""


def block_split_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of SPLIT bytes of each document: start, length, worst coded size of the block and of the document's frame."""
    n = F.octet_length("text").cast("long")
    d = table(spark, sf_dir, "documents").select("doc_id", n.alias("n")).where("n > 0")
    nb = F.ceil(F.col("n") / SPLIT)
    b = d.select("doc_id", "n", nb.alias("blocks"), F.explode(F.sequence(F.lit(0).cast("long"), nb - 1)).alias("block_no"))
    size = F.least(F.lit(SPLIT).cast("long"), F.col("n") - F.col("block_no") * SPLIT)
    return b.select("doc_id", "block_no", (F.col("block_no") * SPLIT).alias("start"), size.alias("raw_len"), (size + F.floor(size / 255) + 16).alias("bound"), (16 + 9 * F.col("blocks") + F.col("n")).alias("frame_bound"))


BLOCK_SPLIT_TABLE = """SELECT doc_id, block_no, block_no * 4096 AS start, least(4096, n - block_no * 4096) AS raw_len,
  least(4096, n - block_no * 4096) + least(4096, n - block_no * 4096) // 255 + 16 AS bound, 16 + 9 * blocks + n AS frame_bound
FROM (SELECT doc_id, n, (n + 4095) // 4096 AS blocks, unnest(range(0, (n + 4095) // 4096)) AS block_no
      FROM (SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n FROM documents) WHERE n > 0)"""

QUERIES = {
    "byte_histogram": (byte_histogram, BYTE_HISTOGRAM),
    "context_histogram": (context_histogram, CONTEXT_HISTOGRAM),
    "bit_cost_table": (bit_cost_table, BIT_COST_TABLE),
    "entropy_block_plan": (entropy_block_plan, ENTROPY_BLOCK_PLAN),
    "block_split_table": (block_split_table, BLOCK_SPLIT_TABLE),
}
