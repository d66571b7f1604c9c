"""Quality classifier: a linear-chain conditional random field labels every line of a document good or bad.

A line's features come from the line itself and from its neighbours (shares of character classes, repeated words,
repeated lines, lengths); the chain adds a weight for each pair of neighbouring states. Training has document labels
only, so every line of a labelled document carries its label. Exact forward-backward, vectorised over documents, gives
the marginal of each line; a document's quality is the mean marginal weighted by line length.

The field is fitted on at most MAX_DOCS labelled documents (those with the smallest hashes of the key, in that order as long
as they have at most MAX_LINES lines together), all lines of each; scoring reads whole texts.

Defined results: a null or empty text is one empty line, which is scored like any other; rows that repeat are scored one
by one (of repeated training rows of a key the smallest text and the largest label count, once); null labels, null keys and
labels without a document teach nothing; a score equal to a threshold passes it; extra columns are ignored; a text of any
length is scored whole, in memory that follows its lines; an empty table gives no rows; without training rows of both
classes the field scores 0.5 everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from blockwright.llm import text as tx
from blockwright.session import bound_batches

MAX_DOCS = 4000
MAX_LINES = 400_000
CHUNK = 1 << 20
STEPS = 120

#: Classes of bytes: space, lower, upper, digit, beyond ASCII, punctuation, exclamation, bar, symbol, other.
KINDS = 10
_KIND = np.full(256, 9, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[0x61:0x7B] = 1
_KIND[0x41:0x5B] = 2
_KIND[0x30:0x3A] = 3
_KIND[0x80:] = 4
_KIND[list(b".,;:?'\"()-")] = 5
_KIND[list(b"!")] = 6
_KIND[list(b"|")] = 7
_KIND[list(b"#*$%&<>")] = 8
OWN = 14
FEATURES = 3 * OWN + 3


def line_features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, its length in bytes, first line of each text). A text has one line more than line feeds."""
    n_docs = len(off) - 1
    feeds = np.flatnonzero(buf == 0x0A)
    per = np.searchsorted(feeds, off[1:]) - np.searchsorted(feeds, off[:-1]) + 1
    first = np.r_[0, np.cumsum(per)]
    n = int(first[-1])
    begin, end = np.empty(n, np.int64), np.empty(n, np.int64)
    inner = np.ones(n, bool)
    inner[first[:-1]] = False
    begin[first[:-1]] = off[:-1]
    begin[inner] = feeds + 1
    inner = np.ones(n, bool)
    inner[first[1:] - 1] = False
    end[first[1:] - 1] = off[1:]
    end[inner] = feeds
    size = end - begin
    doc = np.repeat(np.arange(n_docs), per)
    count = np.zeros((n, KINDS))
    if len(buf):
        line = np.repeat(np.arange(n, dtype=np.int64) * KINDS, np.diff(np.r_[begin, len(buf)]))
        count = np.bincount(line + _KIND[buf], minlength=n * KINDS).reshape(n, KINDS).astype(np.float64)
    count[:, 0] = np.maximum(count[:, 0] - (np.diff(np.r_[begin, len(buf)]) - size), 0)  # without the line feed
    s, e, _ = tx.word_spans(buf, off)
    sums = tx.prefix_hash(buf)
    h = tx.span_hash(sums, s, e) if len(s) else np.zeros(0, np.uint64)
    at = np.searchsorted(begin, s, "right") - 1
    words = np.bincount(at, minlength=n).astype(np.float64)
    again = np.zeros(len(h))
    if len(h) > 2:
        again[1:] = (h[1:] == h[:-1]) & (at[1:] - at[:-1] <= 1)
    again = np.bincount(at, again, minlength=n)
    lh = tx.mix(tx.span_hash(sums, begin, end) ^ (doc.astype(np.uint64) * np.uint64(tx.BASE)))
    one, inverse = tx.distinct(lh)
    twice = (np.bincount(inverse, minlength=len(one))[inverse] > 1) & (size > 0)
    all_, letters, w = np.maximum(size, 1), np.maximum(count[:, 1] + count[:, 2] + count[:, 4], 1), np.maximum(words, 1)
    own = np.stack(
        [count[:, 2] / letters, count[:, 3] / all_, count[:, 4] / all_, np.minimum(count[:, 6] / w, 1), np.minimum(count[:, 7] / w, 1), np.minimum(count[:, 8] / w, 2), np.minimum(count[:, 5] / w, 1)]
        + [count[:, 0] / all_, count[:, 9] / all_, again / w, twice.astype(float), np.log1p(size) / 6, np.minimum(size / w, 30) / 10, (words == 0).astype(float)],
        1,
    )
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    is_first, is_last = np.zeros(n), np.zeros(n)
    is_first[first[:-1]] = 1
    is_last[first[1:] - 1] = 1
    before[is_first > 0] = 0
    after[is_last > 0] = 0
    return np.hstack([own, before, after, is_first[:, None], is_last[:, None], np.ones((n, 1))]).astype(np.float32), size, first


def forward_backward(unary: np.ndarray, first: np.ndarray, trans: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals P(good) of each line, expected transitions (2 x 2, summed, each document's times its ``weight``) and log
    partition of each document.

    unary: score of state good of each line (bad scores 0); trans[a, b]: score of state b after state a.
    """
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    start, length = first[:-1][order], n[order]
    steps = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(steps), "left")  # documents with more than t lines
    alpha = np.zeros((len(unary), 2))
    beta = np.zeros((len(unary), 2))
    u = np.stack([np.zeros(len(unary)), unary], 1)
    for t in range(steps):
        i = start[: active[t]] + t
        if t == 0:
            alpha[i] = u[i]
        else:
            a = alpha[i - 1]
            alpha[i] = u[i] + np.logaddexp(a[:, :1] + trans[0], a[:, 1:] + trans[1])
    for t in range(steps - 2, -1, -1):
        i = start[: active[t + 1]] + t
        b = beta[i + 1] + u[i + 1]
        beta[i] = np.logaddexp(trans[:, 0] + b[:, :1], trans[:, 1] + b[:, 1:])
    last = first[1:] - 1
    log_z = np.logaddexp(alpha[last, 0], alpha[last, 1])
    z = np.repeat(log_z, n)
    p = np.exp(np.minimum(alpha[:, 1] + beta[:, 1] - z, 0))
    pair = np.zeros((2, 2))
    inner = np.ones(len(unary), bool)
    inner[first[:-1]] = False
    j = np.flatnonzero(inner)
    times = 1.0 if weight is None else np.repeat(weight, n)[j]
    for a in range(2):
        for b in range(2):
            pair[a, b] = (times * np.exp(np.minimum(alpha[j - 1, a] + trans[a, b] + u[j, b] + beta[j, b] - z[j], 0))).sum()
    return p, pair, log_z


class LineField:
    """Weights of the field; ``quality`` scores texts."""

    def __init__(self) -> None:
        self.w = np.zeros(FEATURES)
        self.trans = np.zeros((2, 2))

    def objective(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean log-likelihood of a line and its gradient in (w, trans): documents count alike, both classes have half the weight."""
        n = np.diff(first)
        weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y == 0).sum(), 1)) / n
        state = np.repeat(y.astype(np.float64), n)
        unary = x @ self.w
        p, pair, log_z = forward_backward(unary, first, self.trans, weight)
        own = np.add.reduceat(unary * state, first[:-1]) + (n - 1) * np.where(y > 0, self.trans[1, 1], self.trans[0, 0])
        seen = np.diag([(weight * (n - 1))[y == 0].sum(), (weight * (n - 1))[y > 0].sum()])
        return float((weight * (own - log_z)).sum()), np.r_[x.T @ (np.repeat(weight, n) * (state - p)), (seen - pair).ravel()]

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, steps: int = STEPS) -> None:
        """Gradient ascent (Adam) on ``objective`` with a small ridge."""
        if not len(y) or y.min() == y.max():
            return
        theta = np.zeros(FEATURES + 4)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for t in range(1, steps + 1):
            self.w, self.trans = theta[:FEATURES], theta[FEATURES:].reshape(2, 2)
            g = self.objective(x, first, y)[1] - 1e-4 * theta
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta + 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.w, self.trans = theta[:FEATURES].copy(), theta[FEATURES:].reshape(2, 2).copy()

    def quality(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        x, size, first = line_features(buf, off)
        p, _, _ = forward_backward(x @ self.w, first, self.trans)
        doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
        w = size + 1.0
        return np.clip(np.bincount(doc, w * p, minlength=len(off) - 1) / np.bincount(doc, w, minlength=len(off) - 1), 0, 1)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", quality: str = "quality", max_docs: int = MAX_DOCS, max_lines: int = MAX_LINES) -> LineField:
    """A field fitted on at most ``max_docs`` labelled documents of ``max_lines`` lines, chosen by the hash of their key."""
    bound_batches(docs.sparkSession)
    y = labels.where(F.col(key).isNotNull() & F.col(quality).isNotNull()).groupBy(key).agg(F.max(quality).alias("_y"))
    y = y.orderBy(F.xxhash64(F.col(key).cast("string")), key).limit(max_docs)
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias(text)).join(F.broadcast(y), key)  # at most max_docs keys
    rows = rows.groupBy(key, "_y").agg(F.min(text).alias(text))
    lines = F.length(F.regexp_replace(text, "[^\n]", "")) + 1
    before = F.sum(lines).over(Window.partitionBy(F.lit(0)).orderBy(F.xxhash64(F.col(key).cast("string")), key))  # of max_docs rows
    rows = rows.withColumn("_lines", before).where(F.col("_lines") <= max_lines)
    schema = T.StructType([T.StructField("y", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("x", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys = batch.column(batch.schema.get_field_index("_y")).to_pylist()
            for lo, hi, buf, off in tx.byte_chunks(batch, text, CHUNK):
                x, _, first = line_features(buf, off)
                out = []
                for i in range(hi - lo):
                    part = x[first[i] : first[i + 1]]
                    out.append((int(ys[lo + i] > 0), len(part), np.ascontiguousarray(part).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    # sums depend on the order of the rows, so it is fixed
    found = sorted((r["y"], r["n"], bytes(r["x"])) for r in rows.select("_y", text).mapInArrow(run, schema).collect())
    field = LineField()
    if found:
        x = np.frombuffer(b"".join(r[2] for r in found), np.float32).reshape(-1, FEATURES)
        field.fit(x, np.r_[0, np.cumsum([r[1] for r in found])], np.array([r[0] for r in found]))
    return field


def classify(docs: DataFrame, field: LineField, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` is read whole: (key, score) of every row; no exchange."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column(batch.schema.get_field_index(key))
            for lo, hi, buf, off in tx.byte_chunks(batch, text, CHUNK):
                yield pa.RecordBatch.from_arrays([k.slice(lo, hi - lo).cast(arrow.field(0).type), pa.array(field.quality(buf, off))], schema=arrow)

    return docs.select(key, text).mapInArrow(run, schema)


def keep(docs: DataFrame, field: LineField, least: float, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is ``least`` or more, with all columns; no exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for lo, hi, buf, off in tx.byte_chunks(batch, text, CHUNK):
                good[lo:hi] = field.quality(buf, off) >= least
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n."""
    return F.crc32(key.cast("string").cast("binary")) % n


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: quality of all documents, learnt from rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    held = fold(F.col("doc_id"), 4) == 2
    field = train(docs.where(~held), labels.where(~held))
    return classify(docs, field).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
