"""Archive directories as relations: tables of contents, lookups, name rules, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blockwright.plans.running import global_running
from blockwright.session import table

FIRST_FRAME = 32


def archive_toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table of contents of an archive of all pages: entries in bytewise name order with running offsets, equal names by ``page_id``."""
    e = table(spark, sf_dir, "pages").select(F.col("url").alias("name"), F.octet_length("html").cast("long").alias("raw_size"), F.octet_length("url").cast("long").alias("name_length"), F.lit(1).cast("long").alias("one"), "page_id")
    r = global_running(e, ["name", "page_id", "raw_size"], {"raw_size": "end_offset", "name_length": "name_end", "one": "rank"})
    return r.select((F.col("rank") - 1).alias("i"), "name", "raw_size", (F.col("end_offset") - F.col("raw_size") + FIRST_FRAME).alias("offset"), (F.col("name_end") - F.col("name_length")).alias("name_offset"), "name_length")


ARCHIVE_TOC = """WITH e AS (SELECT url AS name, CAST(octet_length(encode(html)) AS BIGINT) AS raw_size, CAST(octet_length(encode(url)) AS BIGINT) AS name_length FROM pages)
SELECT row_number() OVER (ORDER BY name) - 1 AS i, name, raw_size,
  CAST(sum(raw_size) OVER (ORDER BY name ROWS UNBOUNDED PRECEDING) - raw_size + 32 AS BIGINT) AS offset,
  CAST(sum(name_length) OVER (ORDER BY name ROWS UNBOUNDED PRECEDING) - name_length AS BIGINT) AS name_offset, name_length FROM e"""


def archive_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index of each looked-up name in the table of contents, -1 if it is absent. Half of the names have a stray suffix."""
    toc = archive_toc(spark, sf_dir).select("i", "name")
    ask = table(spark, sf_dir, "pages").select(F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat("url", F.lit("/x"))).alias("name"))
    return ask.join(toc, "name", "left").select("name", F.coalesce("i", F.lit(-1)).alias("i"))


ARCHIVE_FIND = """WITH toc AS (SELECT row_number() OVER (ORDER BY url) - 1 AS i, url AS name FROM pages),
ask AS (SELECT CASE WHEN page_id % 2 = 0 THEN url ELSE url || '/x' END AS name FROM pages)
SELECT ask.name, coalesce(i, -1) AS i FROM ask LEFT JOIN toc USING (name)"""


def archive_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads that occur more than once: digest, count and smallest id."""
    d = table(spark, sf_dir, "documents").select(F.md5(F.col("text").cast("binary")).alias("digest"), "doc_id")
    return d.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


ARCHIVE_DUPLICATES = "SELECT md5(text) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1"


def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by market segment as file names; repeated names get a number from the second on."""
    w = Window.partitionBy("c_mktsegment", "c_nationkey").orderBy("c_custkey")
    n = F.row_number().over(w)
    base = F.concat_ws("/", "c_mktsegment", F.col("c_nationkey").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(n == 1, base).otherwise(F.concat(base, F.lit(" ("), n.cast("string"), F.lit(")"))).alias("name"))


UNIQUE_NAMES = """SELECT c_custkey, CASE WHEN n = 1 THEN base ELSE base || ' (' || n || ')' END AS name
FROM (SELECT c_custkey, c_mktsegment || '/' || c_nationkey AS base, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS n FROM customer)"""


def extension(name: Column) -> Column:
    """Lower-case extension of the last path part, "(none)" without one."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(name, r"\.([^./]*)$", 1)), F.lit("")), F.lit("(none)"))


def type_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and bytes by extension, the most bytes first: pages by their URL and parts by their type's last word."""
    p = table(spark, sf_dir, "pages").select(F.col("url").alias("name"), F.octet_length("html").cast("long").alias("raw"))
    q = table(spark, sf_dir, "part").select(F.concat_ws(".", "p_name", F.regexp_extract("p_type", r"(\S+)$", 1)).alias("name"), F.col("p_size").cast("long").alias("raw"))
    return p.unionByName(q).groupBy(extension(F.col("name")).alias("ext")).agg(F.count("*").alias("files"), F.sum("raw").alias("raw")).orderBy(F.desc("raw"), "ext")


TYPE_REPORT = r"""WITH f AS (SELECT url AS name, CAST(octet_length(encode(html)) AS BIGINT) AS raw FROM pages
UNION ALL SELECT concat_ws('.', p_name, regexp_extract(p_type, '(\S+)$', 1)), CAST(p_size AS BIGINT) FROM part)
SELECT coalesce(nullif(lower(regexp_extract(name, '\.([^./]*)$', 1)), ''), '(none)') AS ext, count(*) AS files, CAST(sum(raw) AS BIGINT) AS raw FROM f GROUP BY 1 ORDER BY raw DESC, ext"""


def is_safe(name: Column) -> Column:
    """Whether a stored name may be written below a target folder: no empty, ``.`` or ``..`` part, no drive or backslash."""
    parts = F.split(F.regexp_replace(name, "/\\z", ""), "/")
    return (name != "") & F.forall(parts, lambda s: ~s.isin("", ".", "..")) & ~name.rlike("[\\\\:\\x00]")


def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of pages as they are, without scheme, and with stray parts, each with the verdict."""
    p = table(spark, sf_dir, "pages")
    bare = F.regexp_replace("url", "^[a-z]+://", "")
    forms = F.array(F.col("url"), bare, F.concat(bare, F.lit("/../x")), F.concat(F.lit("/"), bare), F.concat(bare, F.lit("/")), F.concat(bare, F.lit("//y")), F.concat(bare, F.lit("//\n")))
    n = p.select("page_id", F.posexplode(forms).alias("form", "name"))
    return n.select("page_id", F.col("form").cast("int").alias("form"), "name", is_safe(F.col("name")).alias("safe"))


SAFE_NAMES = r"""WITH b AS (SELECT page_id, url, regexp_replace(url, '^[a-z]+://', '') AS bare FROM pages),
n AS (SELECT page_id, unnest(range(0, 7)) AS form, unnest([url, bare, bare || '/../x', '/' || bare, bare || '/', bare || '//y', bare || '//' || chr(10)]) AS name FROM b)
SELECT page_id, CAST(form AS INTEGER) AS form, name,
  name <> '' AND NOT contains(name, chr(92)) AND NOT contains(name, ':') AND len(list_filter(string_split(CASE WHEN right(name, 1) = '/' THEN left(name, -1) ELSE name END, '/'), lambda s: s IN ('', '.', '..'))) = 0 AS safe FROM n"""


def substring_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose name holds any of the alternatives of a bar-separated list; empty alternatives do nothing."""
    only = F.split(F.lit("ring||no such|e b"), "[|]")
    return table(spark, sf_dir, "part").where(F.exists(only, lambda s: (s != "") & F.contains(F.col("p_name"), s))).select("p_partkey", "p_name")


SUBSTRING_FILTER = "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring') OR contains(p_name, 'no such') OR contains(p_name, 'e b')"

QUERIES = {
    "archive_toc": (archive_toc, ARCHIVE_TOC),
    "archive_find": (archive_find, ARCHIVE_FIND),
    "archive_duplicates": (archive_duplicates, ARCHIVE_DUPLICATES),
    "unique_names": (unique_names, UNIQUE_NAMES),
    "type_report": (type_report, TYPE_REPORT),
    "safe_names": (safe_names, SAFE_NAMES),
    "substring_filter": (substring_filter, SUBSTRING_FILTER),
}
