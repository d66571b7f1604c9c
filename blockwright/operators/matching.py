"""Match search and sequence statistics: earlier occurrences, offset classes, commands, move-to-front, literal deltas."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blockwright.plans.running import global_running
from blockwright.session import spread, table

WINDOW = (1 << 23) - 1


def previous_occurrence(data: bytes, width: int = 4) -> np.ndarray:
    """For each position the nearest earlier one with the same ``width`` bytes, -1 without."""
    v = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = len(v) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    key = sum(v[i : i + n] << np.uint64(8 * i) for i in range(width))
    order = np.argsort(key, kind="stable")
    out = np.full(n, -1, np.int64)
    same = key[order][1:] == key[order][:-1]
    out[order[1:][same]] = order[:-1][same]
    return out


def prev_occurrence_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, pos, dist): positions of a message whose 4 bytes occur earlier in it, with the distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pc.fill_null(b.column(2), "").cast(pa.binary()).to_pylist()
            for c, t, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts, strict=True):
                before = previous_occurrence(raw)
                pos = np.flatnonzero((before >= 0) & (np.arange(len(before)) - before <= WINDOW))
                if len(pos):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pos), c)), pa.array(np.full(len(pos), t)), pa.array(pos), pa.array(pos - before[pos])], ["conv_id", "turn", "pos", "dist"])

    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").mapInArrow(run, "conv_id bigint, turn bigint, pos bigint, dist bigint")


PREV_OCCURRENCE = """WITH r AS (SELECT conv_id, turn, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM conversations),
k AS (SELECT conv_id, turn, pos, substr(h, CAST(2 * pos + 1 AS BIGINT), 8) AS key FROM (SELECT *, unnest(range(0, n - 3)) AS pos FROM r)),
p AS (SELECT conv_id, turn, pos, pos - lag(pos) OVER (PARTITION BY conv_id, turn, key ORDER BY pos) AS dist FROM k)
SELECT conv_id, turn, pos, dist FROM p WHERE dist <= 8388607"""


def common_prefix(a: Column, b: Column) -> Column:
    """Length in characters of the common prefix of two strings."""
    n = F.least(F.char_length(a), F.char_length(b))
    at = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.substr(a, k, F.lit(1)) != F.substr(b, k, F.lit(1)))
    return F.when(n == 0, 0).otherwise(F.coalesce(F.get(at, F.lit(0)) - 1, n))


def match_length_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Common prefix of each part name with its predecessor in sorted order within its brand."""
    w = Window.partitionBy("p_brand").orderBy("p_name", "p_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.lag("p_name").over(w).alias("before"))
    return p.select("p_partkey", F.when(F.col("before").isNull(), 0).otherwise(common_prefix(F.col("p_name"), F.col("before"))).cast("long").alias("lcp"))


MATCH_LENGTH = """WITH p AS (SELECT p_partkey, p_name, lag(p_name) OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS b FROM part)
SELECT p_partkey, CAST(coalesce(len(list_filter(range(1, least(length(p_name), length(b)) + 1), lambda k: left(p_name, k) = left(b, k))), 0) AS BIGINT) AS lcp FROM p"""


def _offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("block"), F.col("l_linenumber").alias("seq"), "l_suppkey", (F.col("l_partkey") * F.col("l_suppkey") + 1).alias("off"), F.col("l_quantity").cast("int").alias("ml"))


_OFFSETS = "o AS (SELECT l_orderkey AS block, l_linenumber AS seq, l_suppkey, l_partkey * l_suppkey + 1 AS off, CAST(l_quantity AS INTEGER) AS ml FROM lineitem)"


def offset_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind of each offset (0: as before, else its bytes), least useful match length, and score."""
    w = Window.partitionBy("block").orderBy("seq", "off", "ml")
    off = F.col("off")
    kind = F.when(off == F.lag("off").over(w), 0).when(off < 256, 1).when(off < 65536, 2).otherwise(3)
    return _offsets(spark, sf_dir).select("block", "seq", "off", kind.alias("kind"), F.when(off < 0x8000, 4).otherwise(5).alias("least"), (F.col("ml") - F.when(off >= 0x8000, 1).otherwise(0)).alias("score"))


OFFSET_CLASSES = f"""WITH {_OFFSETS} SELECT block, seq, off,
CASE WHEN off = lag(off) OVER (PARTITION BY block ORDER BY seq, off, ml) THEN 0 WHEN off < 256 THEN 1 WHEN off < 65536 THEN 2 ELSE 3 END AS kind,
CASE WHEN off < 32768 THEN 4 ELSE 5 END AS least, ml - CASE WHEN off >= 32768 THEN 1 ELSE 0 END AS score FROM o"""


def offset_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each stride 1 to 64: offsets that it divides, and whether these are at least half."""
    o = _offsets(spark, sf_dir).select("off")
    sums = o.agg(F.count("*").alias("total"), *[F.sum((F.col("off") % s == 0).cast("long")).alias(f"s{s}") for s in range(1, 65)])
    rows = sums.select("total", F.posexplode(F.array(*[f"s{s}" for s in range(1, 65)])).alias("i", "divided"))
    return rows.select((F.col("i") + 1).cast("long").alias("stride"), "divided", (F.col("divided") * 2 >= F.col("total")).alias("eligible"))


OFFSET_SCALE = f"""WITH {_OFFSETS}, s AS (SELECT CAST(r.stride AS BIGINT) AS stride, CAST(sum((off % r.stride = 0)::INT) AS BIGINT) AS divided, count(*) AS total FROM o CROSS JOIN range(1, 65) AS r(stride) GROUP BY r.stride)
SELECT stride, divided, divided * 2 >= total AS eligible FROM s"""


def top_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 252 most frequent triples (kind, literals, match length); of equals the one with the larger index."""
    t = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 4).alias("kind"), F.pmod("l_suppkey", F.lit(16)).alias("lit"), F.col("l_quantity").cast("long").alias("ml"))
    index = F.col("kind") * 4096 + F.col("lit") * 64 + F.col("ml")
    return t.groupBy("kind", "lit", "ml").agg(F.count("*").alias("n")).withColumn("idx", index).orderBy(F.desc("n"), F.desc("idx")).limit(252)


TOP_COMMANDS = """SELECT kind, lit, ml, count(*) AS n, kind * 4096 + lit * 64 + ml AS idx
FROM (SELECT l_partkey % 4 AS kind, l_suppkey % 16 AS lit, CAST(l_quantity AS BIGINT) AS ml FROM lineitem) GROUP BY kind, lit, ml ORDER BY n DESC, idx DESC LIMIT 252"""

def move_to_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot of each event's type in a three-slot move-to-front list of its user, -1 on a miss, for any number of types.

    Slot 0 holds the type before. Among changes of type, slot 1 holds that of the change before, and slot 2 that of the last
    change whose type differs from the one two changes later: whatever alternates after it fills the first two slots.
    """
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.lag("event_type").over(w).alias("a"))
    # the types of changes, newest first: a the last, b the one before; c needs the change where an alternation began
    e = e.withColumn("new", F.coalesce(F.col("event_type") != F.col("a"), F.lit(True)))
    runs = e.where("new").select("user_id", "event_id", "event_type", F.lag("event_type", 1).over(w).alias("p"), F.lag("event_type", 2).over(w).alias("q"))
    # before a change to t, with p and q the two types before: the type of the last change that the one two later did not repeat
    third = F.last(F.when(F.col("q") != F.col("event_type"), F.col("q")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    slot = F.when(F.col("event_type") == F.col("p"), 0).when(F.col("event_type") == F.col("q"), 1).when(F.col("event_type") == third, 2).otherwise(-1)
    changed = runs.select("user_id", "event_id", slot.alias("slot"))
    same = e.where("not new").select("user_id", "event_id", F.lit(0).alias("slot"))
    return changed.unionByName(same)


MOVE_TO_FRONT = """WITH p AS (SELECT user_id, event_id, event_type, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS own FROM events),
c AS (SELECT p.user_id, p.event_id, any_value(p.own) AS own, count(DISTINCT q.event_type) AS later FROM p LEFT JOIN events q ON q.user_id = p.user_id AND q.event_id > p.own AND q.event_id < p.event_id GROUP BY 1, 2)
SELECT user_id, event_id, CASE WHEN own IS NULL OR later > 2 THEN -1 ELSE CAST(later AS INTEGER) END AS slot FROM c"""


def delta_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of the differences (modulo 256) between the bytes of messages and those at the last match's offset, 0 before the
    first: at each place the offset of the nearest earlier occurrence of four bytes that began before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for b in batches:
            for raw in pc.fill_null(b.column(0), "").cast(pa.binary()).to_pylist():
                v = np.frombuffer(raw, np.uint8)
                off = np.zeros(len(v), np.int64)
                before = previous_occurrence(raw)
                hit = np.flatnonzero(before >= 0)
                if len(hit):
                    at = np.searchsorted(hit, np.arange(len(v)), "left") - 1  # the last match that began before
                    some = at >= 0
                    off[some] = (hit - before[hit])[at[some]]
                back = np.where(off > 0, v[np.arange(len(v)) - off], 0) if len(v) else v
                total += np.bincount((v - back) & 255, minlength=256)
        i = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(total[i])], ["delta", "n"])

    return table(spark, sf_dir, "conversations").select("text").mapInArrow(run, "delta int, n bigint").groupBy("delta").agg(F.sum("n").alias("n"))


DELTA_LITERALS = """WITH r AS (SELECT conv_id, turn, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM conversations),
b AS (SELECT conv_id, turn, pos, n, ('0x' || substr(h, CAST(2 * pos + 1 AS BIGINT), 2))::INTEGER AS v, CASE WHEN pos <= n - 4 THEN substr(h, CAST(2 * pos + 1 AS BIGINT), 8) END AS key FROM (SELECT *, unnest(range(0, n)) AS pos FROM r)),
m AS (SELECT *, CASE WHEN key IS NOT NULL THEN pos - lag(pos) OVER (PARTITION BY conv_id, turn, key ORDER BY pos) END AS dist FROM b),
o AS (SELECT *, last_value(dist IGNORE NULLS) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS off FROM m),
d AS (SELECT CAST((o.v - coalesce(q.v, 0)) & 255 AS INTEGER) AS delta FROM o LEFT JOIN b q ON q.conv_id = o.conv_id AND q.turn = o.turn AND q.pos = o.pos - o.off)
SELECT delta, count(*) AS n FROM d GROUP BY delta"""


#: Characters whose strings are counted together before they are exchanged.
COUNTED = 2 << 20


def _strings(texts: list[str], width: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(code points of the distinct strings of ``width`` characters of some texts, how often each occurs)."""
    cp = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    n = len(cp) - width + 1
    if n <= 0:
        return np.zeros((0, width), np.uint32), np.zeros(0, np.int64)
    own = np.ones(n, bool)
    across = (np.cumsum([len(t) for t in texts])[:, None] - np.arange(1, width)).ravel()
    own[across[(across >= 0) & (across < n)]] = False
    seen = np.zeros(int(cp.max()) + 1, bool)
    seen[cp] = True
    letters = np.flatnonzero(seen).astype(np.uint32)
    if len(letters) > 256:
        found, count = np.unique(np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(cp, width)[own]).view(f"V{4 * width}").ravel(), return_counts=True)
        return np.frombuffer(found.tobytes(), np.uint32).reshape(-1, width), count
    # few letters, as nearly always: a string is a number of 64 bits
    number = (np.cumsum(seen) - 1)[cp].astype(np.uint64)
    key = np.sort(sum(number[i : i + n] << np.uint64(8 * i) for i in range(width))[own])
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return letters[key[at].astype("<u8").view(np.uint8).reshape(-1, width)], np.diff(np.r_[at, len(key)])


def _packed(codes: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(which rows, their code points as bytes): one, two or four bytes each, as the largest of a row needs."""
    largest = codes.max(1, initial=0)
    for low, high, kind in ((0, 1 << 8, "u1"), (1 << 8, 1 << 16, "<u2"), (1 << 16, 1 << 32, "<u4")):
        which = np.flatnonzero((largest >= low) & (largest < high))
        if len(which):
            data = codes[which].astype(kind)
            places = np.arange(len(which) + 1, dtype=np.int32) * (data.itemsize * data.shape[1])
            yield which, pa.Array.from_buffers(pa.binary(), len(which), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data))])


def kmer_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many 8-character strings of all documents occur how often; those of some texts are counted before they are exchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, some, held = pc.fill_null(b.column(0), "").to_pylist(), [], 0
            for i, t in enumerate(texts):
                some.append(t)
                held += len(t)
                if held >= COUNTED or i == len(texts) - 1:
                    codes, count = _strings(some)
                    for which, k in _packed(codes):
                        yield pa.RecordBatch.from_arrays([k, pa.array(count[which], pa.int64())], ["k", "n"])
                    some, held = [], 0

    k = spread(table(spark, sf_dir, "documents").select("text")).mapInArrow(run, "k binary, n bigint")
    return k.groupBy("k").agg(F.sum("n").alias("freq")).groupBy("freq").agg(F.count("*").alias("kmers"))


KMER_FREQUENCY = """WITH k AS (SELECT substr(text, CAST(i AS BIGINT), 8) AS k FROM (SELECT text, unnest(range(1, length(text) - 6)) AS i FROM documents WHERE length(text) >= 8)),
f AS (SELECT k, count(*) AS freq FROM k GROUP BY k) SELECT freq, count(*) AS kmers FROM f GROUP BY freq"""


#: Bytes of a region, and the share of it (in hundredths) that its matches must save.
REGION, SAVE_PERCENT = 128 << 10, 1


def region_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences that are kept, with their literals: those of regions whose matches save less than a hundredth become literals
    of the next sequence that is kept. A match saves its bytes less those of its token, offset and length, in sixteenths of a bit.

    Ends are running sums over ranges of the whole table, since there are few blocks. Regions ascend with the sequences of a block, so
    what came before a sequence matters only for a region's first one: the end of the last region that was kept.
    """
    o = _offsets(spark, sf_dir).withColumn("block", F.col("block") % 50).withColumn("ll", (F.col("l_suppkey") * 300).cast("long"))
    # some blocks hardly repeat anything
    o = o.withColumn("ml", (4 + F.col("ml") * (F.col("block") % 4)).cast("long")).withColumn("total", F.col("ll") + F.col("ml")).withColumn("one", F.lit(1).cast("long"))
    r = global_running(o, ["block", "seq", "l_suppkey", "off", "ml"], {"total": "upto", "one": "rank"}, o.count())
    w = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    starts = o.groupBy("block").agg(F.sum("total").alias("total"), F.sum("one").alias("one"))
    starts = starts.select("block", F.coalesce(F.sum("total").over(w), F.lit(0)).alias("start"), F.coalesce(F.sum("one").over(w), F.lit(0)).alias("ranks"))
    r = r.join(F.broadcast(starts), "block").select("block", (F.col("rank") - F.col("ranks")).cast("int").alias("seq"), "off", "ml", "ll", (F.col("upto") - F.col("start")).alias("end"))
    r = r.withColumn("region", F.floor((F.col("end") - F.col("ml")) / REGION))
    saves = 128 * F.col("ml") - 128 * (1 + F.when(F.col("off") < 256, 1).when(F.col("off") < 65536, 2).otherwise(3)) - 128 * F.when(F.col("ml") >= 19, 1).otherwise(0)
    regions = r.groupBy("block", "region").agg(F.sum(saves.cast("long")).alias("saved"), F.max("end").alias("region_end"), F.min("seq").alias("first")).where(F.col("saved") >= REGION * 128 * SAVE_PERCENT // 100)
    before = F.coalesce(F.lag("region_end").over(Window.partitionBy("block").orderBy("region")), F.lit(0))
    kept = r.join(regions.select("block", "region", "first", before.alias("before")), ["block", "region"])
    ll = F.when(F.col("seq") == F.col("first"), F.col("end") - F.col("ml") - F.col("before")).otherwise(F.col("ll"))
    return kept.select("block", "seq", "off", "ml", "region", ll.alias("ll"))


REGION_STORE = f"""WITH {_OFFSETS}, a AS (SELECT block % 50 AS block, row_number() OVER (PARTITION BY block % 50 ORDER BY seq, l_suppkey, off, ml) AS seq, l_suppkey, off, ml, l_suppkey * 300 AS ll FROM (SELECT block, seq, l_suppkey, off, CAST(4 + ml * (block % 50 % 4) AS BIGINT) AS ml FROM o)),
e AS (SELECT *, CAST(sum(ll + ml) OVER (PARTITION BY block ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM a),
r AS (SELECT *, CAST((e - ml) // {REGION} AS BIGINT) AS region, 128 * ml - 128 * (1 + CASE WHEN off < 256 THEN 1 WHEN off < 65536 THEN 2 ELSE 3 END) - CASE WHEN ml >= 19 THEN 128 ELSE 0 END AS s FROM e),
k AS (SELECT *, sum(s) OVER (PARTITION BY block, region) >= {REGION * 128 * SAVE_PERCENT // 100} AS kept FROM r),
l AS (SELECT *, e - ml - coalesce(max(e) FILTER (WHERE kept) OVER (PARTITION BY block ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lits FROM k)
SELECT block, CAST(seq AS INTEGER) AS seq, off, ml, region, CAST(lits AS BIGINT) AS ll FROM l WHERE kept"""


def offset_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of offsets under the scales 1, 2, 3 and 64: how often each occurs, and the bytes that follow it."""
    o = _offsets(spark, sf_dir).select(F.col("off").cast("long").alias("off")).groupBy("off").agg(F.count("*").alias("n"))
    o = o.select("*", F.explode(F.array(*[F.lit(s).cast("long") for s in (1, 2, 3, 64)])).alias("scale"))
    whole = (F.col("off") % F.col("scale")) == 0
    v = F.when(whole, F.floor(F.col("off") / F.col("scale"))).otherwise(F.col("off"))
    o = o.select("scale", "n", whole.alias("whole"), v.alias("v"))
    one = F.col("scale") == 1
    near = F.when(one, F.col("v") < 251 << 8).otherwise(F.col("v") < 125 << 8)
    symbol = F.when(near, F.when(one | F.col("whole"), 3).otherwise(128) + F.shiftright("v", 8)).otherwise(F.when(one | ~F.col("whole"), 255).otherwise(254))
    s = o.groupBy("scale", symbol.cast("long").alias("symbol")).agg(F.sum("n").alias("n"))
    return s.select("scale", "symbol", "n", (F.col("n") * F.when(F.col("symbol") < 254, 1).otherwise(3)).alias("bytes"))


OFFSET_SYMBOLS = f"""WITH {_OFFSETS}, v AS (SELECT scale, off % scale = 0 AS whole, CASE WHEN off % scale = 0 THEN off // scale ELSE off END AS v FROM o, (VALUES (1::BIGINT), (2), (3), (64)) AS s(scale)),
c AS (SELECT scale, CASE WHEN scale = 1 THEN CASE WHEN v < 64256 THEN 3 + (v >> 8) ELSE 255 END WHEN v < 32000 THEN CASE WHEN whole THEN 3 ELSE 128 END + (v >> 8) WHEN whole THEN 254 ELSE 255 END AS symbol FROM v)
SELECT scale, CAST(symbol AS BIGINT) AS symbol, count(*) AS n, count(*) * CASE WHEN symbol < 254 THEN 1 ELSE 3 END AS bytes FROM c GROUP BY scale, symbol"""


def varint_size(v: Column) -> Column:
    """Bytes of an unsigned value in groups of seven bits."""
    return F.when(v < 1 << 7, 1).when(v < 1 << 14, 2).when(v < 1 << 21, 3).when(v < 1 << 28, 4).otherwise(5)


def varint_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total bytes of keys as variable-length integers, by size."""
    v = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("v")).unionByName(_offsets(spark, sf_dir).select(F.col("off").alias("v")))
    return v.groupBy(varint_size(F.col("v")).alias("size")).agg(F.count("*").alias("n"), F.sum(varint_size(F.col("v")).cast("long")).alias("bytes"))


VARINT_SIZES = f"""WITH {_OFFSETS}, v AS (SELECT l_orderkey AS v FROM lineitem UNION ALL SELECT off FROM o),
s AS (SELECT CASE WHEN v < 128 THEN 1 WHEN v < 16384 THEN 2 WHEN v < 2097152 THEN 3 WHEN v < 268435456 THEN 4 ELSE 5 END AS size FROM v)
SELECT size, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM s GROUP BY size"""


def extension_bytes(v: Column) -> Column:
    """Bytes by which a length beyond a token's 4 bits is continued."""
    return F.when(v < 15, 0).otherwise(F.floor((v - 15) / 255) + 1)


def plain_sequence_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coded size of each sequence in the plain format: token, literal count, literals, offset, match length."""
    o = _offsets(spark, sf_dir).select("block", "seq", "off", F.col("l_suppkey").alias("ll"), (F.col("ml") + 4).cast("long").alias("ml"))
    least = F.when(F.col("off") < 0x8000, 4).otherwise(5)
    size = 1 + extension_bytes(F.col("ll")) + F.col("ll") + F.when(F.col("off") < 0x8000, 2).otherwise(3) + extension_bytes(F.greatest(F.col("ml") - least, F.lit(0)))
    return o.select("block", "seq", "off", size.cast("long").alias("size"))


PLAIN_COST = f"""WITH {_OFFSETS}, s AS (SELECT block, seq, off, l_suppkey AS ll, greatest(ml + 4 - CASE WHEN off < 32768 THEN 4 ELSE 5 END, 0) AS x FROM o)
SELECT block, seq, off, CAST(1 + CASE WHEN ll < 15 THEN 0 ELSE (ll - 15) // 255 + 1 END + ll + CASE WHEN off < 32768 THEN 2 ELSE 3 END + CASE WHEN x < 15 THEN 0 ELSE (x - 15) // 255 + 1 END AS BIGINT) AS size FROM s"""

QUERIES = {
    "prev_occurrence_matches": (prev_occurrence_matches, PREV_OCCURRENCE),
    "match_length_neighbours": (match_length_neighbours, MATCH_LENGTH),
    "offset_classes": (offset_classes, OFFSET_CLASSES),
    "offset_scale": (offset_scale, OFFSET_SCALE),
    "offset_symbols": (offset_symbols, OFFSET_SYMBOLS),
    "top_commands": (top_commands, TOP_COMMANDS),
    "move_to_front": (move_to_front, MOVE_TO_FRONT),
    "delta_literals": (delta_literals, DELTA_LITERALS),
    "kmer_frequency": (kmer_frequency, KMER_FREQUENCY),
    "region_store": (region_store, REGION_STORE),
    "varint_sizes": (varint_sizes, VARINT_SIZES),
    "plain_sequence_cost": (plain_sequence_cost, PLAIN_COST),
}
