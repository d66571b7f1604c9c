"""Order MinHash fingerprints: sensitive to edit distance, not only to the set of k-mers.

The k-mers of a text (K bytes each) are numbered by occurrence (the 2nd occurrence of a k-mer differs from its 1st).
Each numbered k-mer has a pseudo-random value; it picks one of SLOTS slots and a rank there. A slot selects its KEEP
k-mers of smallest rank, puts them back into text order and hashes the tuple of k-mers: equal entries need the same
k-mers in the same order. A text without enough k-mers in a slot hashes what there is; an empty slot says nothing.

Likeness of two fingerprints: equal slots over the slots that either uses; 1 if neither uses any and both stand for the
same text.

Defined results: a null text is empty; a text of fewer than K bytes is one k-mer; an empty text has a fingerprint of its
own; rows that repeat give equal fingerprints; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from blockwright.llm import text as tx
from blockwright.session import bound_batches

K = 8
SLOTS = 64
KEEP = 2
#: k-mers of a slot that are looked at first; all are where that does not settle it.
FEW = 16
#: Bytes that are fingerprinted at a time.
CHUNK = 1 << 20
EMPTY = np.uint32(0)
RANK = np.uint64((1 << 58) - 1)
SLOT_EDGES = np.array([i << 58 for i in range(SLOTS)] + [(1 << 64) - 1], np.uint64)
#: Stands for a null key, which comes first.
NO_KEY = -(1 << 63)


def signature(text: bytes) -> np.ndarray:
    """SLOTS 32-bit entries of one text; 0 marks an empty slot."""
    out = np.zeros(SLOTS, np.uint32)
    m = max(len(text) - K + 1, 1)
    if not text:
        return out
    if len(text) < K:
        w = np.array([xxhash.xxh3_64_intdigest(text, seed=len(text))], np.uint64)
    else:
        w = np.empty((m + 7) // 8 * 8, np.uint64)  # the K = 8 bytes from each position on
        for r in range(min(8, m)):
            part = text[r : len(text) - (len(text) - r) % 8]
            w[r::8][: len(part) // 8] = np.frombuffer(part, "<u8")
        w = w[:m]
    h = tx.mix(w * np.uint64(tx.BASE) + np.uint64(K))
    # occurrences: equal k-mers are neighbours, in text order, after sorting by (hash, position)
    bits = np.uint64(max(1, (m - 1).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    key = np.sort((h & ~low) | np.arange(m, dtype=np.uint64))
    pos = tx.refine((key & low).astype(np.int64), key >> bits, h)
    h = h[pos]
    run = np.arange(m)
    begin = run.copy()
    begin[1:][h[1:] == h[:-1]] = 0
    np.maximum.accumulate(begin, out=begin)
    value = tx.mix(h + (run - begin).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    # a value's high bits are its slot and the rest its rank there; small ranks are enough where there are many
    cand = run
    if m > 2 * FEW * SLOTS:
        cand = np.flatnonzero((value & RANK) < np.uint64((1 << 58) // m * FEW * SLOTS))
    first = None
    for cand in (cand, run):
        cand = cand[np.argsort(value[cand])]
        edge = np.searchsorted(value[cand], SLOT_EDGES)
        if len(cand) == m or (np.diff(edge) >= KEEP).all():
            break
    slots = np.flatnonzero(np.diff(edge))
    first, end = edge[slots], edge[slots + 1]
    far = np.iinfo(np.int64).max
    pick = np.stack([np.where(first + j < end, cand[np.minimum(first + j, len(cand) - 1)], -1) for j in range(KEEP)], 1)
    place = np.where(pick >= 0, pos[pick], far)
    pick = np.take_along_axis(pick, np.argsort(place, axis=1), 1)
    entry = np.full(len(slots), np.uint64(0x5851F42D4C957F2D))
    for j in range(KEEP):
        c = pick[:, j]
        entry = np.where(c >= 0, tx.mix(entry * np.uint64(tx.BASE) + h[c]), entry)
    out[slots] = np.maximum((entry >> np.uint64(32)).astype(np.uint32), np.uint32(1))
    return out


def signatures(texts: list[bytes]) -> np.ndarray:
    """A row for each text."""
    return np.stack([signature(x) for x in texts]) if texts else np.zeros((0, SLOTS), np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1 for each pair of rows."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(1)
    equal = ((a == b) & (a != EMPTY)).sum(1)
    return np.where(used == 0, 1.0, equal / np.maximum(used, 1))


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, fingerprint (hexadecimal string) of every row; no exchange."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("fingerprint", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = tx.text_column(batch, text)
            keys = batch.column(batch.schema.get_field_index(key))
            for lo, hi in tx.chunks(tx.utf8(c)[1], CHUNK):
                sig = signatures([x.encode() for x in c.slice(lo, hi - lo).to_pylist()])
                yield pa.RecordBatch.from_arrays([keys.slice(lo, hi - lo).cast(arrow.field(0).type), pa.array([s.tobytes().hex() for s in sig], pa.string())], schema=arrow)

    return docs.select(key, text).mapInArrow(run, schema)


def next_documents(docs: DataFrame, fn, schema: T.StructType, text: str = "text", key: str = "doc_id", parts: int | None = None) -> DataFrame:
    """Applies ``fn(rows, next_rows)`` to runs of documents in ascending order of the key, each with the one after it.

    The documents are dealt into ranges of the key; the first document of a range also goes to the end of the range
    before it (the very first one to the end of the last), so that no range waits for another and none holds more than
    its share. The key is an integer; nulls come first. Equal keys go to the same range in order of their text. ``rows``: (key, text) lists of equal length.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    d = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = d.select(F.percentile_approx("key", [i / parts for i in range(parts)], 10_000).alias("q")).first()["q"]
    cuts = sorted(set(cuts or []))
    if cuts:
        cuts[0] = d.agg(F.min("key").alias("k")).first()["k"]
        cuts = sorted(set(cuts))
    last = len(cuts) - 1
    out_arrow = to_arrow_schema(schema)
    # a document whose key begins a range goes to the range before, too; of equal keys only the first text counts there
    if not cuts:
        return spark.createDataFrame([], schema)
    dealt_kind = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("extra", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("text", T.StringType())])
    dealt_arrow = to_arrow_schema(dealt_kind)
    edges = np.array(cuts, np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            part = np.searchsorted(edges, key, "right") - 1
            first = np.flatnonzero(edges[part] == key)
            for rows, to, extra in ((np.arange(len(key)), part, 0), (first, np.where(part[first] == 0, last, part[first] - 1), 1)):
                if len(rows):
                    own = b if not extra else b.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(np.full(len(rows), extra), pa.int32()), *(c.cast(f.type) for c, f in zip(own.columns, list(dealt_arrow)[2:], strict=True))], schema=dealt_arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0

        def flush(keep: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            mine = [x for x in held if not x[1]]
            extra = [x for x in held if x[1]]
            if keep:  # more rows of this range follow: the last one waits for its successor
                rows, after = mine[:-1], mine[1:]
                held = mine[-1:]
                size = len(held[0][3]) if held else 0
            else:
                rows, after = mine, mine[1:] + extra[:1]
                held, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(fn([None if r[2] == NO_KEY else r[2] for r in rows], [r[3] for r in rows], [r[3] for r in after]), out_arrow, strict=True)], schema=out_arrow)

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if row[0] != now:
                    if held:
                        yield from flush(False)
                    now, held, size = row[0], [], 0
                if row[1] and held and held[-1][1]:
                    continue  # of equal boundary keys the first text is the successor
                held.append(row)
                size += len(row[3])
                if size > CHUNK and not row[1]:
                    yield from flush(True)
        if held:
            yield from flush(False)

    dealt = d.mapInArrow(deal, dealt_kind).repartition(parts, "part").sortWithinPartitions("part", "extra", "key", "text")
    return dealt.mapInArrow(run, schema)


def edited_pairs(keys: list, texts: list[str], after: list[str]) -> list[list]:
    """Columns of ``op2`` for a run of documents and those after them."""
    edited = []
    for t, n in zip(texts, after, strict=True):
        cut = len(t) // 4
        edited.append((t[: len(t) - cut] + n[:cut]).encode())
    own, nxt = [t.encode() for t in texts], [t.encode() for t in after]
    # all but the last successor are the documents themselves
    rows = signatures([*own, nxt[-1]])
    a, b = rows[:-1], rows[1:]
    e = signatures(edited)
    return [
        keys,
        [len(t) for t in texts],
        [hashlib.sha256(x).hexdigest() for x in edited],
        [x.tobytes().hex() for x in a],
        [x.tobytes().hex() for x in e],
        likeness(a, e).tolist(),
        likeness(a, b).tolist(),
    ]


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: fingerprints of all documents and of their edited texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
        + [T.StructField(c, T.DoubleType()) for c in ("near_edited", "near_next")]
    )
    return next_documents(docs, edited_pairs, schema)
