"""Substring dedup over words by prefix-partitioned suffix trees.

Every word covered by a window of LENGTH words that also starts in a document with a smaller key is removed. Candidates
come from ``repeats`` (their groups share a sampled string, longer where it is frequent). Inside a task the suffixes are
split by variable-length prefixes into groups of at most GROUP suffixes; each group's subtree is held as its leaves in
order and the lengths of the prefixes that neighbours share, so that a deep internal node is a run of neighbours that
share LENGTH words or more: a repeat, marked below every leaf but those of its smallest document.

Defined results: null and empty texts have no words and keep nothing; a null key comes first; rows that repeat keep what
they hold (equal keys are not smaller); extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockwright.llm import repeats as rp
from blockwright.llm import text as tx

LENGTH = 13
GRAM = 5
#: Most suffixes of a subtree (more only if all of them are equal).
GROUP = 50_000

SEARCH = rp.Search(length=LENGTH, gram=GRAM, words=True, smaller=True, chunk=2 << 20, batch=1 << 18)


def prefix_groups(ids: np.ndarray, starts: np.ndarray, length: int, limit: int = GROUP) -> Iterator[np.ndarray]:
    """Suffixes (as indices into ``starts``) by variable-length prefixes: small neighbours together, large ones split."""
    todo = [(np.arange(len(starts)), 0)]
    while todo:
        idx, depth = todo.pop()
        if len(idx) <= limit or depth == length:
            if len(idx):
                yield idx
            continue
        c = ids[starts[idx] + depth]
        idx = idx[np.argsort(c, kind="stable")]
        edge = np.flatnonzero(np.r_[True, np.diff(ids[starts[idx] + depth]) != 0])
        ends = np.r_[edge[1:], len(idx)]
        begin = 0
        for a, b in zip(edge.tolist(), ends.tolist(), strict=True):
            if b - a > limit:
                if a > begin:
                    todo.append((idx[begin:a], length))
                todo.append((idx[a:b], depth + 1))
                begin = b
            elif b - begin > limit:
                todo.append((idx[begin:a], length))
                begin = a
        if begin < len(idx):
            todo.append((idx[begin:], length))


def subtree(ids: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(leaves in lexicographic order, symbols that each shares with the leaf before it), compared to ``length``."""
    table = ids[starts[:, None] + np.arange(length)]
    order = np.lexsort(table.T[::-1])
    table = table[order]
    same = np.zeros(len(starts), np.int64)
    if len(starts) > 1:
        same[1:] = np.logical_and.accumulate(table[1:] == table[:-1], axis=1).sum(1)
    return order, same


def maximal_repeats(sym: np.ndarray, length: int) -> list[tuple[int, list[int]]]:
    """Deep internal nodes of the whole suffix tree of a short sequence: (depth, leaves) of each node of ``length`` or more."""
    ids = np.append(np.unique(sym, return_inverse=True)[1] + 1, 0)
    order = sorted(range(len(sym)), key=lambda i: ids[i:].tolist())

    def common(i: int, j: int) -> int:
        n = 0
        while i + n < len(sym) and j + n < len(sym) and sym[i + n] == sym[j + n]:
            n += 1
        return n

    lcp = [common(a, b) for a, b in zip(order, order[1:], strict=False)]
    out, stack = [], []  # open nodes: (depth, first leaf)
    for i, d in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > d:
            depth, first = stack.pop()
            if depth >= length:
                out.append((depth, sorted(order[first : i + 1])))
        if d >= length and (not stack or stack[-1][0] < d):
            stack.append((d, first))
    return sorted(out)


def kernel(search: rp.Search, parts: list[np.ndarray], size: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Windows that also start in a document with a smaller key."""
    ids = np.unique(np.concatenate(parts), return_inverse=True)[1].astype(np.int32)
    base = np.r_[0, np.cumsum([len(p) for p in parts])][:-1]
    starts = tx.ranges(base, size)
    owner = np.repeat(rp.rank(keys), size)
    hit = np.zeros(len(starts), bool)
    for idx in prefix_groups(ids, starts, search.length):
        order, same = subtree(ids, starts[idx], search.length)
        leaf = idx[order]
        edge = np.flatnonzero(same < search.length)
        node = np.cumsum(same < search.length) - 1
        hit[leaf] = owner[leaf] > np.minimum.reduceat(owner[leaf], edge)[node]
    return hit


def marked(docs: DataFrame, text: str = "text", key: str = "doc_id", search: rp.Search = SEARCH) -> DataFrame:
    """(key, text, marks) of every row."""
    return rp.find(rp.keyed(docs, text, key), search, kernel)


def _kept(buf: np.ndarray, off: np.ndarray, first: np.ndarray, gone: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(words, removed words, remaining words joined by one space) of each text."""
    s, e, _ = tx.word_spans(buf, off)
    raw = buf.tobytes()
    for i in range(len(off) - 1):
        a, b = int(first[i]), int(first[i + 1])
        g = gone[a:b]
        keep = np.flatnonzero(~g) + a
        yield b - a, int(g.sum()), b" ".join([raw[x:y] for x, y in zip(s[keep].tolist(), e[keep].tolist(), strict=True)])


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", search: rp.Search = SEARCH) -> DataFrame:
    """key, n_words, n_removed, kept (the remaining words joined by one space) of every row."""
    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def finish(keys: list, buf: np.ndarray, off: np.ndarray, first: np.ndarray, gone: np.ndarray, _: object) -> Iterator[tuple]:
        for k, (n, r, t) in zip(keys, _kept(buf, off, first, gone), strict=True):
            yield k, n, r, t.decode()

    return rp.apply_marks(marked(docs, text, key, search), search, finish, schema)


def rewrite(docs: DataFrame, text: str = "text", key: str = "doc_id", n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with all columns. A text that loses words becomes the others joined by one space, with its new length."""
    rows = docs.select(rp.key_of(text, key), F.coalesce(F.col(text), F.lit("")).alias("text"), F.struct(*docs.columns).alias("row"))
    found = rp.find(rows.select("key", "text"), SEARCH, kernel, rows)
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("new", T.StringType())])

    def finish(keys: list, buf: np.ndarray, off: np.ndarray, first: np.ndarray, gone: np.ndarray, batch: pa.RecordBatch) -> Iterator[tuple]:
        for row, (_, r, t) in zip(batch.column(3).to_pylist(), _kept(buf, off, first, gone), strict=True):
            yield row, t.decode() if r else None

    out = rp.apply_marks(found, SEARCH, finish, schema)
    new = {text: F.coalesce("new", f"row.{text}"), n_chars: F.when(F.col("new").isNull(), F.col(f"row.{n_chars}")).otherwise(F.char_length("new").cast("long"))}
    return out.select(*[new.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: digests of what stays of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "n_words", "n_removed")] + [T.StructField("kept_sha256", T.StringType())])

    def finish(keys: list, buf: np.ndarray, off: np.ndarray, first: np.ndarray, gone: np.ndarray, _: object) -> Iterator[tuple]:
        for k, (n, r, t) in zip(keys, _kept(buf, off, first, gone), strict=True):
            yield k, n, r, hashlib.sha256(t).hexdigest()

    return rp.apply_marks(marked(docs), SEARCH, finish, schema)
