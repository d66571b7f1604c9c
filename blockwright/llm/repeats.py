"""Distributed search for repeated substrings of a fixed least length, over bytes or words of all documents.

A *window* is ``length`` consecutive symbols. Every window is given to one of its short grams (the one of smallest hash,
the leftmost of equals), which depends on the window's content alone: equal windows meet at equal grams. The windows of
one gram occurrence form a *segment* of neighbouring windows. So all work on equal windows is local to a gram:

1. scan: segments of each chunk; equal segments of a chunk are settled there and one of them is sent on, as a packed
   run of (gram hash, segment hash, document, place) for each bucket of gram hashes;
2. buckets: equal segments of all chunks are settled by their hashes; where different segments share a gram, only the
   windows themselves can tell, so their texts are asked for, one for each class of equal segments;
3. texts: the documents with such segments send them to their gram. The prefix of a gram with more than ``crowd`` different
   segments is extended to the whole window: the document sends hashes of windows instead, one for each class of equal
   windows of a chunk, dealt by that hash. So no group grows with how often a string, short or long, occurs: a group of
   texts has at most ``crowd`` parts, and a window is sent once for each chunk of a task;
4. groups: a kernel (a suffix array or a suffix tree) finds equal windows within bounded batches of whole groups; windows
   that came as hashes are settled in buckets;
5. the spans that are found return to their documents.

What is shuffled: a few bytes for each segment, the texts twice (by document), and the texts of segments in step 3.
Hashes have 64 bits, of segments with their place relative to the gram. What a document is told is checked against its
own hashes.

Rules: ``any`` marks every window that occurs twice or more, ``smaller`` those that also occur in a document with a
smaller key. Keys are integers; null keys are equal to one another and come first (inside, such a row goes by a key of its
text, below all others). Rows with equal keys are told apart by the hash of what is marked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from blockwright.llm import text as tx
from blockwright.session import bound_batches

#: Rows without a key have keys from here to LAST_NULL.
NO_KEY = -(1 << 63)
LAST_NULL = NO_KEY + (1 << 32) - 1
#: A part of a document: symbols from a on, m windows of which lo to hi are meant, place of the gram, hash, gram.
REC = np.dtype([("a", "<u4"), ("m", "<u2"), ("lo", "<u2"), ("hi", "<u2"), ("at", "<u2"), ("sh", "<u8"), ("h", "<u8")])
#: Low bits of a gram's order that hold its position.
PLACE = np.uint64(24)
#: Positions that the sliding minimum takes at a time.
STEP = 1 << 20
BUCKET, MARKED, ASKED, SPLIT, WINDOW = range(5)

SENT = T.StructType([T.StructField("to", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("doc", T.LongType()), T.StructField("payload", T.BinaryType())])
SENT_ARROW = to_arrow_schema(SENT)


@dataclass(frozen=True)
class Search:
    """What is searched: windows of ``length`` symbols by grams of ``gram`` symbols; bytes or words; the rule."""

    length: int
    gram: int
    words: bool
    smaller: bool
    #: Bytes of text that are scanned at a time, symbols of segments that a kernel gets at a time.
    chunk: int
    batch: int
    #: The windows of a gram with more different segments than this are dealt one by one.
    crowd: int = 256

    def symbols(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of all texts, first symbol of each text)."""
        if not self.words:
            return buf, off
        s, e, first = tx.word_spans(buf, off)
        return (tx.word_hashes(buf, s, e) if len(s) else np.zeros(0, np.uint64)), first


def rolling(sums: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n symbols from each position on."""
    h = sums[n:] - sums[:-n]
    h *= tx.powers(len(sums), inverse=True)[: len(h)]
    h += np.uint64(n * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
    return tx.mix(h)


def sliding_argmin(order: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest of each ``width`` consecutive values, the leftmost of (nearly) equal ones."""
    out = np.empty(max(len(order) - width + 1, 0), np.int64)
    low = (np.uint64(1) << PLACE) - np.uint64(1)
    for b in range(0, len(out), STEP):
        k = order[b : b + STEP + width - 1]
        k = (k & ~low) | np.arange(len(k), dtype=np.uint64)
        have = 1
        while have * 2 <= width:
            k = np.minimum(k[:-have], k[have:])
            have *= 2
        if have < width:
            k = np.minimum(k[: len(k) - (width - have)], k[width - have :])
        out[b : b + len(k)] = (k & low).astype(np.int64) + b
    return out


def segments(search: Search, sums: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first symbol, number of windows, place of the gram after it) and gram hash of each segment."""
    n = len(sums) - 1
    count = np.maximum(np.diff(first) - search.length + 1, 0)
    if n < search.length or not count.any():
        z = np.zeros(0, np.int64)
        return z, z, z, z, np.zeros(0, np.uint64)
    grams = rolling(sums, search.gram)
    at = sliding_argmin(grams, search.length - search.gram + 1)
    w = tx.ranges(first[:-1], count)
    doc = np.repeat(np.arange(len(count)), count)
    p = at[w]
    cut = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (doc[1:] != doc[:-1])])
    a, p = w[cut], p[cut]
    return doc[cut], a, np.diff(np.r_[cut, len(w)]), p - a, grams[p]


def segment_hash(search: Search, sums: np.ndarray, a: np.ndarray, m: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of a segment's symbols with the place of its gram."""
    return tx.mix(tx.span_hash(sums, a, a + m + search.length - 1) + at.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def records(a: np.ndarray, m: np.ndarray, at: np.ndarray, sh: np.ndarray, h: np.ndarray | int = 0) -> np.ndarray:
    r = np.zeros(len(a), REC)
    r["a"], r["m"], r["hi"], r["at"], r["sh"], r["h"] = a, m, m, at, sh, h
    return r


def by_document(keys: np.ndarray, rec: np.ndarray, kind: int) -> list[tuple]:
    """A row for each document with its records."""
    if not len(rec):
        return []
    order = np.argsort(keys, kind="stable")
    keys, rec = keys[order], rec[order]
    edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    raw, w = rec.tobytes(), REC.itemsize
    return [(int(keys[i]), kind, int(keys[i]), raw[i * w : j * w]) for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(rec)], strict=True)]


def to_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SENT_ARROW, strict=True)], schema=SENT_ARROW)


def batches_of(rows: Iterator[tuple], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for r in rows:
        out.append(r)
        size += len(r[3]) + 32
        if size > limit:
            yield to_batch(out)
            out, size = [], 0
    if out:
        yield to_batch(out)


def rank(keys: np.ndarray) -> np.ndarray:
    """Keys as they compare: all null ones are equal."""
    return np.maximum(keys, LAST_NULL)


def settle(search: Search, group: np.ndarray, keys: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Which segments are marked by an equal one. group: class of each segment; many: stands for two or more."""
    n = int(group.max()) + 1 if len(group) else 0
    if search.smaller:
        keys = rank(keys)
        least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least, group, keys)
        return keys > least[group]
    return many | (np.bincount(group, minlength=n)[group] > 1)


def _scan(search: Search, buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for lo, hi, buf, off in tx.byte_chunks(batch, "text", search.chunk):
            sym, first = search.symbols(buf, off)
            sums = tx.prefix_hash(sym)
            doc, a, m, at, h = segments(search, sums, first)
            if not len(doc):
                continue
            sh = segment_hash(search, sums, a, m, at)
            k = keys[lo:hi][doc]
            place = a - first[doc]
            one, group = tx.distinct(tx.mix(h) ^ sh)
            marked = settle(search, group, k, np.zeros(len(k), bool))
            for r in by_document(k[marked], records(place, m, at, sh)[marked], MARKED):
                yield (r[0] % buckets, *r[1:])
            if search.smaller:
                go, many = np.flatnonzero(~marked), np.zeros(len(k), bool)
            else:
                go, many = one, marked
            to = ((h[go] >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
            go = go[np.lexsort((h[go], to))]
            to = ((h[go] >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
            edge = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(go)], strict=True):
                g = go[i:j]
                yield int(to[i]), BUCKET, 0, tx.pack(np.diff(h[g], prepend=np.uint64(0)), sh[g], k[g].view(np.uint64), tx.narrow(place[g]), tx.narrow(m[g]), tx.narrow(at[g]), many[g].view(np.uint8))


def _compare(search: Search, parts: list[list[np.ndarray]]) -> Iterator[tuple]:
    """Settles the segments of a bucket; yields marked and asked parts of documents."""
    h, sh, k, a, m, at, many = (np.concatenate([p[i] for p in parts]) for i in range(7))
    k, many = k.view(np.int64), many.astype(bool)
    _, group = tx.distinct(tx.mix(h) ^ sh)
    _, gram = tx.distinct(h)
    marked = settle(search, group, k, many)
    n = int(gram.max()) + 1
    # one segment of each class speaks for it: the first of those with the smallest key
    order = np.lexsort((k, group))
    speaks = np.zeros(len(h), bool)
    speaks[order[np.r_[True, group[order][1:] != group[order][:-1]]]] = True
    kinds = np.bincount(gram, speaks, minlength=n)
    if search.smaller:
        least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least, gram, rank(k))
        open_ = ~marked & (rank(k) > least[gram])
        need = open_ | speaks
    else:
        open_ = ~marked
        need = speaks
    need &= (np.bincount(gram, open_, minlength=n)[gram] > 0) & (kinds[gram] > 1)
    rec = records(a, m, at, sh, h)
    fresh = marked & ~many  # the chunk has marked the others of its own already
    yield from by_document(k[fresh], rec[fresh], MARKED)
    crowd = np.bincount(gram, need, minlength=n)[gram] > search.crowd
    yield from by_document(k[need & ~crowd], rec[need & ~crowd], ASKED)
    yield from by_document(k[need & crowd], rec[need & crowd], SPLIT)


def _buckets(search: Search, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows come by kind and bucket; marked ones pass through."""
    now, parts = None, []
    for b in batches:
        for to, kind, doc, payload in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if kind != BUCKET:
                yield doc, kind, doc, payload
                continue
            if to != now and parts:
                yield from _compare(search, parts)
                parts = []
            now = to
            d, *rest = tx.unpack(payload)
            parts.append([np.cumsum(d, dtype=np.uint64), *[x.astype(np.int64) if i in (2, 3, 4) else x for i, x in enumerate(rest)]])
    if parts:
        yield from _compare(search, parts)


def _located(search: Search, sums: np.ndarray, first: np.ndarray, doc: np.ndarray, rec: np.ndarray) -> np.ndarray:
    """Which records are right for their document, by hash."""
    a = first[doc] + rec["a"].astype(np.int64)
    m, at = rec["m"].astype(np.int64), rec["at"].astype(np.int64)
    ok = a + m + search.length - 1 <= first[doc + 1]
    i = np.flatnonzero(ok)
    ok[i] = segment_hash(search, sums, a[i], m[i], at[i]) == rec["sh"][i]
    return ok


def _texts(search: Search, buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Documents with what is marked and asked of them: passes marks on, sends asked segments to their groups."""
    ln = search.length
    for batch in batches:
        keys = batch.column(0).to_pylist()
        items = batch.column(2).to_pylist()
        for lo, hi, buf, off in tx.byte_chunks(batch, "text", search.chunk):
            asked, kinds, docs = [], [], []
            for i in range(lo, hi):
                for x in items[i]:
                    if x["kind"] == MARKED:
                        yield keys[i], MARKED, keys[i], x["payload"]
                    else:
                        r = np.frombuffer(x["payload"], REC)
                        asked.append(r)
                        kinds.append(np.full(len(r), x["kind"]))
                        docs.append(np.full(len(r), i - lo))
            if not asked:
                continue
            sym, first = search.symbols(buf, off)
            sums = tx.prefix_hash(sym)
            rec, kind, doc = np.concatenate(asked), np.concatenate(kinds), np.concatenate(docs)
            ok = _located(search, sums, first, doc, rec)
            rec, kind, doc = rec[ok], kind[ok], doc[ok]
            start = first[doc] + rec["a"].astype(np.int64)
            key = tx.mix(rec["h"]).view(np.int64)
            plain = np.flatnonzero(kind == ASKED)
            for i in plain.tolist():
                s = int(start[i])
                yield int(key[i]), ASKED, keys[lo + doc[i]], rec[i].tobytes() + sym[s : s + int(rec["m"][i]) + ln - 1].tobytes()
            yield from _windows(search, buckets, sums, first, doc, start, rec["m"].astype(np.int64), np.array(keys[lo:hi], np.int64), np.flatnonzero(kind == SPLIT))


def _windows(search: Search, buckets: int, sums: np.ndarray, first: np.ndarray, doc: np.ndarray, start: np.ndarray, m: np.ndarray, keys: np.ndarray, crowd: np.ndarray) -> Iterator[tuple]:
    """Settles equal windows of the crowded segments of a chunk and sends one of each class to the bucket of its hash."""
    w = tx.ranges(start[crowd], m[crowd])
    if not len(w):
        return
    owner = np.repeat(doc[crowd], m[crowd])
    h = tx.span_hash(sums, w, w + search.length)
    k = keys[owner]
    one, group = tx.distinct(h)
    marked = settle(search, group, k, np.zeros(len(w), bool))
    hit = np.flatnonzero(marked)
    if len(hit):
        cut = np.flatnonzero(np.r_[True, (w[hit][1:] != w[hit][:-1] + 1) | (owner[hit][1:] != owner[hit][:-1])])
        a, n = w[hit][cut], np.diff(np.r_[cut, len(hit)])
        at = np.zeros(len(a), np.int64)
        rec = records(a - first[owner[hit][cut]], n, at, segment_hash(search, sums, a, n, at))
        yield from by_document(k[hit][cut], rec, MARKED)
    go, many = (np.flatnonzero(~marked), np.zeros(len(w), bool)) if search.smaller else (one, marked)
    to = ((h[go] >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((h[go], to))
    go, to = go[order], to[order]
    edge = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, np.int64)
    for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(go)], strict=False):
        g = go[i:j]
        yield int(to[i]), WINDOW, 0, tx.pack(np.diff(h[g], prepend=np.uint64(0)), k[g].view(np.uint64), tx.narrow(w[g] - first[owner[g]]), many[g].view(np.uint8))


def _meet(search: Search, parts: list[list[np.ndarray]]) -> Iterator[tuple]:
    """Settles the windows of a bucket that came as hashes."""
    h = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    k = np.concatenate([p[1] for p in parts]).view(np.int64)
    place = np.concatenate([p[2].astype(np.int64) for p in parts])
    many = np.concatenate([p[3] for p in parts]).astype(bool)
    _, group = tx.distinct(h)
    hit = np.flatnonzero(settle(search, group, k, many) & ~many)
    if len(hit):
        one = np.ones(len(hit), np.int64)
        yield from by_document(k[hit], records(place[hit], one, one * 0, tx.mix(h[hit])), MARKED)


def _groups(search: Search, kernel: Callable, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows come by kind and group. Whole groups are gathered up to the batch size and given to the kernel."""
    kind_of = np.uint64 if search.words else np.uint8

    def solve(rec: list, sym: list, keys: list) -> Iterator[tuple]:
        r = np.concatenate(rec)
        size = r["hi"].astype(np.int64) - r["lo"]
        k = np.array(keys, np.int64)
        # equal parts of one document need one answer; equal parts of several stand for one another
        hit = kernel(search, sym, size, k)
        owner = np.repeat(np.arange(len(r)), size)
        w = tx.ranges(r["lo"].astype(np.int64), size)
        owner, w = owner[hit], w[hit]
        if not len(w):
            return
        cut = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (w[1:] != w[:-1] + 1)])
        out = r[owner[cut]].copy()
        out["lo"] = w[cut]
        out["hi"] = w[np.r_[cut[1:], len(w)] - 1] + 1
        out["h"] = 0
        yield from by_document(k[owner[cut]], out, MARKED)

    now, total, rec, sym, keys = None, 0, [], [], []
    bucket, parts = None, []
    for b in batches:
        for to, kind, doc, payload in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if kind == MARKED:
                yield doc, kind, doc, payload
                continue
            if kind == WINDOW:
                if to != bucket and parts:
                    yield from _meet(search, parts)
                    parts = []
                bucket = to
                parts.append(tx.unpack(payload))
                continue
            if to != now and total > search.batch:
                yield from solve(rec, sym, keys)
                total, rec, sym, keys = 0, [], [], []
            now = to
            rec.append(np.frombuffer(payload, REC, 1))
            sym.append(np.frombuffer(payload, kind_of, -1, REC.itemsize))
            keys.append(doc)
            total += len(sym[-1])
    if rec:
        yield from solve(rec, sym, keys)
    if parts:
        yield from _meet(search, parts)


def covered(search: Search, sums: np.ndarray, first: np.ndarray, doc: np.ndarray, rec: np.ndarray) -> np.ndarray:
    """Symbols that lie in a marked window."""
    n = len(sums) - 1
    rec = rec.copy()
    ok = _located(search, sums, first, doc, rec)
    rec, doc = rec[ok], doc[ok]
    step = np.zeros(n + 1, np.int32)
    a = first[doc] + rec["a"].astype(np.int64)
    np.add.at(step, a + rec["lo"], 1)
    np.add.at(step, a + rec["hi"] + search.length - 1, -1)
    return np.cumsum(step[:-1]) > 0


def find(docs: DataFrame, search: Search, kernel: Callable, rows: DataFrame | None = None) -> DataFrame:
    """Rows of ``docs`` (key, text; key a long without nulls) with ``marks``: packed parts of each, for ``covered``.

    ``rows``: the same rows with more columns, if these are to be returned, too.

    The kernel gets (search, symbols of each part, windows of each part, keys) and says for each window whether it is
    marked.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * parts

    def run(step: Callable, *args: object) -> Callable:
        return lambda batches: batches_of(step(search, *args, batches))

    sent = docs.mapInArrow(run(_scan, buckets), SENT)
    met = sent.repartition(buckets, "to").sortWithinPartitions("kind", "to").mapInArrow(run(_buckets), SENT)
    asked = met.groupBy(F.col("doc").alias("key")).agg(F.collect_list(F.struct("kind", "payload")).alias("items"))
    texts = docs.join(asked.hint("shuffle_hash"), "key").select("key", "text", "items").mapInArrow(run(_texts, buckets), SENT)
    found = texts.repartition(buckets, "to").sortWithinPartitions("kind", "to", "doc").mapInArrow(run(_groups, kernel), SENT)
    marks = found.groupBy(F.col("doc").alias("key")).agg(F.collect_list("payload").alias("marks"))
    rows = docs if rows is None else rows
    more = [c for c in rows.columns if c not in ("key", "text")]
    return rows.join(marks.hint("shuffle_hash"), "key", "left").select("key", "text", "marks", *more)


def apply_marks(found: DataFrame, search: Search, finish: Callable, schema: T.StructType) -> DataFrame:
    """``finish`` gets (keys, texts as bytes, their offsets, first symbol of each, covered symbols, rows) of each chunk."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [None if k <= LAST_NULL else k for k in batch.column(0).to_pylist()]
            marks = batch.column(2).to_pylist()
            for lo, hi, buf, off in tx.byte_chunks(batch, "text", search.chunk):
                sym, first = search.symbols(buf, off)
                sums = tx.prefix_hash(sym)
                rec = [np.frombuffer(b"".join(x or ()), REC) for x in marks[lo:hi]]
                doc = np.repeat(np.arange(hi - lo), [len(r) for r in rec])
                gone = covered(search, sums, first, doc, np.concatenate([np.zeros(0, REC), *rec]))
                rows = list(finish(keys[lo:hi], buf, off, first, gone, batch.slice(lo, hi - lo)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return found.mapInArrow(run, schema)


def key_of(text: str, key: str) -> Column:
    """The key that a row goes by: its own, or one below all others that depends on the text."""
    null = F.lit(NO_KEY) + F.xxhash64(F.coalesce(F.col(text), F.lit(""))).bitwiseAND(F.lit((1 << 32) - 1))
    return F.coalesce(F.col(key).cast("long"), null).alias("key")


def keyed(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(key, text) without nulls."""
    return docs.select(key_of(text, key), F.coalesce(F.col(text), F.lit("")).alias("text"))
