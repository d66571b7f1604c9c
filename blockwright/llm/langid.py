"""Language identification by a convolutional network over bytes, trained in numpy.

Filters of several widths slide over a window of WINDOW bytes; each filter's largest response (never below 0) feeds a
softmax over the languages. A byte picks a row of a filter's table, so a convolution is a sum of table rows. A text is
cut into windows of that fixed length, all of them are read, and its prediction is the language with the largest mean
probability, windows weighted by their letters.

Training: a sample of at most MAX_DOCS labelled documents (the smallest hashes of the key; of repeated rows of a key one),
WINDOWS_EACH windows spread evenly over each.

Defined results: texts that are null or have no letter are ``und`` with score 0; rows that repeat are predicted one by
one, also with a null key; null languages and null keys teach nothing; of equally likely languages the first by name is taken; a
text of any length is read whole, AT_ONCE windows at a time; extra columns are ignored; an empty table gives no rows; without
labelled rows everything is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from blockwright.llm import text as tx
from blockwright.session import bound_batches

WIDTHS = (2, 3, 4)
FILTERS = 8
WINDOW = 256
MAX_DOCS = 4000
WINDOWS_EACH = 3
EPOCHS = 6
BATCH = 64
RATE = 0.01
SEED = 7
#: Windows that are scored at a time.
AT_ONCE = 2048
CHUNK = 4 << 20
NONE = "und"

#: Bytes as the network sees them: ASCII letters in lower case; 0 fills windows up.
_SEEN = tx.LOWER.copy()
_ASCII = np.zeros(256, bool)
_ASCII[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_LETTERLIKE = _ASCII.copy()
_LETTERLIKE[0xC0:] = True
_LETTER = regex.compile(r"\p{L}")


class ByteNet:
    """Filter tables [width][offset][byte, filter], softmax weights and the languages."""

    def __init__(self, langs: list[str], seed: int = SEED):
        r = np.random.default_rng(seed)
        self.langs = langs
        self.tables = [r.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = r.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32)
        self.out_bias = np.zeros(len(langs), np.float32)

    def pool(self, x: np.ndarray, where: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest responses [window, filter] and, if asked for, where they are."""
        best, at = [], []
        for table, bias, w in zip(self.tables, self.bias, WIDTHS, strict=True):
            n = x.shape[1] - w + 1
            r = table[0][x[:, :n]]
            for j in range(1, w):
                r += table[j][x[:, j : j + n]]
            if where:
                i = r.argmax(1)
                at.append(i)
                best.append(np.take_along_axis(r, i[:, None], 1)[:, 0] + bias)
            else:
                best.append(r.max(1) + bias)
        return np.concatenate(best, 1), at

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(self.pool(x)[0], 0) @ self.out + self.out_bias
        h = np.exp(h - h.max(1, keepdims=True))
        return h / h.sum(1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> None:
        """Adam on the cross-entropy; languages count alike. The pooled positions alone carry gradients to the tables."""
        r = np.random.default_rng(seed)
        params = [*self.tables, *self.bias, self.out, self.out_bias]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        weight = (len(y) / (len(self.langs) * np.maximum(np.bincount(y, minlength=len(self.langs)), 1)))[y].astype(np.float32)
        t = 0
        for _ in range(epochs):
            order = r.permutation(len(y))
            for b in range(0, len(y), BATCH):
                i = order[b : b + BATCH]
                xb = x[i]
                raw, at = self.pool(xb, True)
                h = np.maximum(raw, 0)
                z = h @ self.out + self.out_bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(i)), y[i]] -= 1
                p *= weight[i, None] / len(i)
                back = (p @ self.out.T) * (raw > 0)
                grads = []
                for k, w in enumerate(WIDTHS):
                    g = np.zeros_like(self.tables[k])
                    part = back[:, k * FILTERS : (k + 1) * FILTERS]
                    for j in range(w):
                        np.add.at(g[j], (np.take_along_axis(xb, at[k] + j, 1), np.arange(FILTERS)[None, :]), part)
                    grads.append(g)
                grads += [back[:, k * FILTERS : (k + 1) * FILTERS].sum(0) for k in range(len(WIDTHS))]
                grads += [h.T @ p, p.sum(0)]
                t += 1
                for q, g, a, c in zip(params, grads, m, v, strict=True):
                    a += 0.1 * (g - a)
                    c += 0.001 * (g * g - c)
                    q -= RATE * (a / (1 - 0.9**t)) / (np.sqrt(c / (1 - 0.999**t)) + 1e-8)


def windows(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts of all windows, their documents): every text in steps of WINDOW, the last one possibly short."""
    n = (np.diff(off) + WINDOW - 1) // WINDOW
    doc = np.repeat(np.arange(len(off) - 1), n)
    return off[doc] + (tx.ranges(np.zeros(len(n), np.int64), n)) * WINDOW, doc


def cut(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Windows as rows of bytes, filled up with 0. ``buf`` holds WINDOW spare bytes at its end."""
    x = buf[starts[:, None] + np.arange(WINDOW)[None, :]]
    x[np.arange(WINDOW)[None, :] >= (ends - starts)[:, None]] = 0
    return x


def train(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", max_docs: int = MAX_DOCS) -> ByteNet | None:
    """A net for the languages of at most ``max_docs`` rows of ``docs``, chosen by the hash of their key."""
    bound_batches(docs.sparkSession)
    named = docs.where(F.col(lang).isNotNull() & F.col(key).isNotNull())
    chosen = named.select(key).distinct().orderBy(F.xxhash64(F.col(key).cast("string")), key).limit(max_docs)
    rows = named.select(F.col(lang).alias("_y"), text, key).join(F.broadcast(chosen), key)  # at most max_docs keys
    rows = rows.groupBy(key).agg(F.min(F.struct("_y", text)).alias("_r")).select(F.col("_r._y").alias("_y"), F.col(f"_r.{text}").alias(text))
    schema = T.StructType([T.StructField("y", T.StringType()), T.StructField("x", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys = batch.column(batch.schema.get_field_index("_y")).to_pylist()
            for lo, hi, buf, off in tx.byte_chunks(batch, text, CHUNK):
                seen = np.concatenate([_SEEN[buf], np.zeros(WINDOW, np.uint8)])
                out = []
                for i in range(hi - lo):
                    n = int(off[i + 1] - off[i])
                    for s in sorted({int(x) for x in np.linspace(0, max(n - WINDOW, 0), WINDOWS_EACH)}) if n else ():
                        out.append((ys[lo + i], cut(seen, np.array([off[i] + s]), off[i + 1 : i + 2])[0].tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    found = sorted((r["y"], bytes(r["x"])) for r in rows.select("_y", text).mapInArrow(run, schema).collect())
    if not found:
        return None
    langs = sorted({y for y, _ in found})
    net = ByteNet(langs)
    net.fit(np.frombuffer(b"".join(x for _, x in found), np.uint8).reshape(-1, WINDOW), np.array([langs.index(y) for y, _ in found]))
    return net


def predict(net: ByteNet | None, buf: np.ndarray, off: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    n = len(off) - 1
    letters = np.concatenate([[0], np.cumsum(_ASCII[buf], dtype=np.int64)])
    lettered = letters[off[1:]] > letters[off[:-1]]
    for i in np.flatnonzero(~lettered & (np.diff(off) > 0)).tolist():
        lettered[i] = bool(_LETTER.search(buf[off[i] : off[i + 1]].tobytes().decode()))
    if net is None or not n:
        return [NONE] * n, np.zeros(n)
    seen = np.concatenate([_SEEN[buf], np.zeros(WINDOW, np.uint8)])
    like = np.concatenate([[0], np.cumsum(_LETTERLIKE[buf], dtype=np.int64)])
    starts, doc = windows(buf, off)
    total = np.zeros((n, len(net.langs)))
    for a in range(0, len(starts), AT_ONCE):
        s, d = starts[a : a + AT_ONCE], doc[a : a + AT_ONCE]
        e = np.minimum(s + WINDOW, off[d + 1])
        w = like[e] - like[s] + 1e-3
        np.add.at(total, d, net.probabilities(cut(seen, s, e)) * w[:, None])
    total /= np.maximum(total.sum(1, keepdims=True), 1e-12)
    best = total.argmax(1)
    score = np.clip(total[np.arange(n), best], 0, 1)
    return [net.langs[b] if ok else NONE for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)], np.where(lettered, score, 0.0)


def identify(docs: DataFrame, net: ByteNet | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score) of every row; no exchange."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column(batch.schema.get_field_index(key))
            for lo, hi, buf, off in tx.byte_chunks(batch, text, CHUNK):
                langs, score = predict(net, buf, off)
                yield pa.RecordBatch.from_arrays([k.slice(lo, hi - lo).cast(arrow.field(0).type), pa.array(langs, pa.string()), pa.array(score)], schema=arrow)

    return docs.select(key, text).mapInArrow(run, schema)


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n."""
    return F.crc32(key.cast("string").cast("binary")) % n


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: languages of all documents, learnt from rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = fold(F.col("doc_id"), 5) == 0
    net = train(docs.where(~held))
    return identify(docs, net).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")
