"""Exact byte dedup by suffix arrays built in two stages.

Every byte covered by a string of LENGTH bytes that also starts anywhere else (the same document included) is removed.
Candidates come from ``repeats``. A kernel gets bounded batches of whole groups as one text and builds its suffix array
in two stages: suffixes that are smaller than their successors are sorted directly; the others are induced by scanning
the buckets of first bytes in ascending order, since such a suffix lies in its bucket in the order of its successor.
Neighbours of the array whose common prefix has LENGTH bytes or more are repeats.

Defined results: null and empty texts hold no bytes; a null key comes first; rows that repeat hold equal strings, so
that each loses what is long enough; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from blockwright.llm import repeats as rp
from blockwright.llm import text as tx

LENGTH = 400
GRAM = 32

SEARCH = rp.Search(length=LENGTH, gram=GRAM, words=False, smaller=False, chunk=2 << 20, batch=1 << 18)


def smaller_than_next(t: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the one that starts a symbol later; the last one counts as such."""
    n = len(t)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(np.diff(t.astype(np.int16)))
    step[-1] = 1
    # within a run of equal symbols the first difference after it decides
    at = np.where(step != 0, np.arange(n), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return step[at] > 0


def sort_directly(t: np.ndarray, idx: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ``idx`` in order of their first ``depth`` symbols (or a few more), equal ones as they come.

    Seven symbols of nine bits are compared at a time, and only those that were equal so far go on to the next seven.
    """
    seven = np.zeros(len(t) + depth + 8, np.uint64)
    for j in range(min(7, len(t))):
        seven[: len(t) - j] |= t[j:].astype(np.uint64) << np.uint64(9 * (6 - j))
    order = idx[np.argsort(seven[idx], kind="stable")]
    tie = seven[order][1:] == seven[order][:-1]
    for d in range(7, depth, 7):
        at = np.flatnonzero(np.r_[tie, False] | np.r_[False, tie])  # places in runs of equal ones
        if not len(at):
            break
        goes_on = np.r_[False, tie][at]
        k = seven[order[at] + d]
        mixed = goes_on[1:] & (k[1:] != k[:-1])
        if mixed.any():  # sort the runs that differ here
            run = np.cumsum(~goes_on) - 1
            some = np.zeros(int(run[-1]) + 1, bool)
            some[run[1:][mixed]] = True
            sub = np.flatnonzero(some[run])
            by = sub[np.lexsort((k[sub], run[sub]))]
            order[at[sub]] = order[at[by]]
            k[sub] = k[by]
            tie[at[1:][goes_on[1:]] - 1] = (k[1:] == k[:-1])[goes_on[1:]]
    return order


def common_prefixes(sums: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Symbols, up to ``most``, that the suffixes at a and at b share (by the hashes of ever shorter steps)."""
    n = len(sums) - 1
    out = np.zeros(len(a), np.int64)
    step = 1 << (most.bit_length() - 1)
    while step:
        i = np.flatnonzero((out + step <= most) & (np.maximum(a, b) + out + step <= n))
        x, y = a[i] + out[i], b[i] + out[i]
        out[i[tx.span_hash(sums, x, x + step) == tx.span_hash(sums, y, y + step)]] += step
        step //= 2
    return out


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``t`` (symbols 0 to 256, ending with a 0) in order of their first ``depth`` symbols."""
    direct = smaller_than_next(t)
    own = sort_directly(t, np.flatnonzero(direct), depth)
    own_first = t[own]
    # stage 2: scan the buckets; a suffix larger than its successor goes to the end of its bucket's first part
    queue: list[list[np.ndarray]] = [[] for _ in range(257)]
    out = []
    for c in range(257):
        induced = np.concatenate(queue[c]) if queue[c] else np.zeros(0, np.int64)
        found = [induced]
        while len(induced):
            p = induced[induced > 0] - 1
            induced = p[(t[p] == c) & ~direct[p]]
            found.append(induced)
        a, b = np.searchsorted(own_first, [c, c + 1])
        bucket = np.concatenate([*found, own[a:b]])
        queue[c] = []
        if not len(bucket):
            continue
        out.append(bucket)
        p = bucket[bucket > 0] - 1
        p = p[(t[p] > c) & ~direct[p]]
        if len(p):
            first = t[p]
            order = np.argsort(first, kind="stable")
            p, first = p[order], first[order]
            edge = np.flatnonzero(np.r_[True, np.diff(first) != 0])
            for x, y in zip(edge.tolist(), [*edge[1:].tolist(), len(p)], strict=True):
                queue[first[x]].append(p[x:y])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def kernel(search: rp.Search, parts: list[np.ndarray], size: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Windows whose string starts at another window, too."""
    n = np.array([len(p) for p in parts])
    base = np.r_[0, np.cumsum(n + 1)][:-1]
    t = np.zeros(int((n + 1).sum()), np.uint16)
    for b, p in zip(base.tolist(), parts, strict=True):
        t[b : b + len(p)] = p
        t[b : b + len(p)] += 1
    starts = tx.ranges(base, size)
    number = np.full(len(t), -1, np.int64)
    number[starts] = np.arange(len(starts))
    order = number[suffix_array(t, search.length)]
    order = order[order >= 0]
    equal = common_prefixes(tx.prefix_hash(t), starts[order[:-1]], starts[order[1:]], search.length) >= search.length
    hit = np.zeros(len(starts), bool)
    hit[order[1:][equal]] = True
    hit[order[:-1][equal]] = True
    return hit


def marked(docs: DataFrame, text: str = "text", key: str = "doc_id", search: rp.Search = SEARCH) -> DataFrame:
    """(key, text, marks) of every row."""
    return rp.find(rp.keyed(docs, text, key), search, kernel)


def _spans(gone: np.ndarray) -> int:
    return int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(bool(len(gone) and gone[0]))


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", search: rp.Search = SEARCH) -> DataFrame:
    """key, n_bytes, spans (array of start and end of each removed run), kept (binary: the remaining bytes)."""
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(span)), T.StructField("kept", T.BinaryType())])

    def finish(keys: list, buf: np.ndarray, off: np.ndarray, first: np.ndarray, gone: np.ndarray, _: object) -> Iterator[tuple]:
        for i, k in enumerate(keys):
            g = gone[off[i] : off[i + 1]]
            edge = np.flatnonzero(np.diff(np.r_[False, g, False].astype(np.int8)))
            yield k, len(g), [{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()], buf[off[i] : off[i + 1]][~g].tobytes()

    return rp.apply_marks(marked(docs, text, key, search), search, finish, schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: digests of what stays of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())])

    def finish(keys: list, buf: np.ndarray, off: np.ndarray, first: np.ndarray, gone: np.ndarray, _: object) -> Iterator[tuple]:
        for i, k in enumerate(keys):
            g = gone[off[i] : off[i + 1]]
            yield k, len(g), int(g.sum()), _spans(g), hashlib.sha256(buf[off[i] : off[i + 1]][~g].tobytes()).hexdigest()

    return rp.apply_marks(marked(docs), SEARCH, finish, schema)
