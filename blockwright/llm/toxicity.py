"""Toxicity by class-conditional Kneser-Ney models over words, smoothed by backoff counts that both classes share.

C_c(v, w) is the number of class c's labelled documents (c: toxic or ordinary) in which word w follows v; every text
begins after START and ends with END. N_c(w) sums it over v. Without c the sum over both classes is meant. Each order is
discounted and interpolated with the next lower one, and only the two highest orders know the class:

    S0(w)      continuation: in how many contexts w occurs in either class, discounted; what that frees is spread evenly
    S1(w)      N(w) discounted, interpolated with S0                     (shared)
    S2(w | v)  C(v, w) discounted, over C(v), interpolated with S1       (shared)
    U_c(w)     what N_c(w) exceeds, over all of c, interpolated with S1; r_c(w) = U_c(w) / S1(w)
    P_c(w | v) what C_c(v, w) exceeds, over C_c(v), interpolated with S2(w | v) r_c(w) / Z_c(v)

where Z_c(v) = sum over w of S2(w | v) r_c(w) keeps the backoff a distribution (a unigram-rescaled backoff). The shared
orders use Ney's estimate of the discount. The class orders discount a count n of class c by DISCOUNT + LIFT * n' * share(c),
n' the count in both classes and share(c) the class's share of all words, and keep KEEP of what is left: a class keeps a part of its own where it exceeds LIFT
times its share of the shared count, and all the rest, so every rare expression and every one that both classes use alike, backs off
to the shared counts, from which it gets the same probability in both. No expression is left out of any count. A small KEEP
makes what a class prefers weigh by how much it prefers it, and keeps small what Z takes from the other words, which differs by subject and language.

A text's raw score is its log-likelihood ratio, sum of log P_toxic - log P_ordinary, over the number of its words and END.
A monotone curve, fitted on a fold of the labelled documents that the counts leave out, turns it into 0 to 1.

The ratio of a pair is u(w) + L(v) unless a class keeps some of its count (u: log r_toxic / r_ordinary; L: log ratio of the
backoff weights), so the model is a value g = u + L for each word and a difference for each pair of which a class keeps some.
Counting takes three exchanges: labelled texts meet their labels, pair counts go to the bucket of w, sums over contexts to
the bucket of v. Scoring: the HEAD most frequent words and pairs are broadcast (a bounded size); all the rest is asked for at its bucket, which answers with
sums for each document. A map of BITS bits spares keys without a value the way; it changes no result.

Words are told apart by 32 bits of their hash. Defined results: null and empty texts are scored as START, END; rows that
repeat are scored one by one (of repeated labels of a document the largest counts); null labels and labels without a
document teach nothing; a null key is no label's; the score of a tie is that of the curve, 0.5 counts as toxic; extra columns
are ignored; a text of any length is one unit of work; an empty table gives no rows; without training rows of both classes every score is the same low value.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from blockwright.llm import text as tx
from blockwright.llm.labelled import maybe_labelled
from blockwright.session import bound_batches, shared_folder

#: What a class's counts lose: DISCOUNT, LIFT times the class's share of the count in both (less if that comes more than half-way to all
#: that the smaller class can have), and all but KEEP of the rest.
DISCOUNT = 1.0
LIFT = 5.0
KEEP = 1 / 32
#: Most words, and most pairs, that are broadcast.
HEAD = 1 << 18
#: Bits of the map that spares keys without a value the exchange.
BITS = 1 << 26
CHUNK = 4 << 20
#: Entries that a task sums up before it sends them.
HOLD = 4 << 20
#: Tasks that the texts of one label may be dealt to.
SALT = 4
#: Bins of raw scores for fitting the curve.
BINS = 8000
SPAN = 0.125
#: Score without a model.
LOW_SCORE = 0.02

START, END = 1, 2
LOW = np.uint64((1 << 32) - 1)
HALF = np.uint64(32)
#: Sums over a bucket: words of both classes; word types, with how many occur once, twice; contexts, likewise; pairs once, twice.
SUMS = ("n_t", "n_o", "types", "w1", "w2", "cont", "c1", "c2", "p1", "p2")
#: Bytes of words: letters, digits and everything beyond ASCII.
OUTSIDE = np.ones(256, bool)
OUTSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_TO_SPACE = np.where(OUTSIDE, np.uint8(0x20), tx.LOWER)

SENT = T.StructType([T.StructField("to", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("src", T.LongType()), T.StructField("payload", T.BinaryType())])
SENT_ARROW = to_arrow_schema(SENT)


def _rows(found: list[tuple], schema: pa.Schema = SENT_ARROW) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)


def _edges(b: np.ndarray) -> Iterator[tuple[int, int]]:
    """(begin, end) of each run of equal values."""
    if len(b):
        at = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]).tolist()
        yield from zip(at, [*at[1:], len(b)], strict=True)


def events(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word or END, word before it or START, document) of each event; a document has one more than words."""
    buf = _TO_SPACE[buf]
    s, e, first = tx.word_spans(buf, off)
    h = np.maximum(tx.word_hashes(buf, s, e) >> HALF, np.uint64(END + 1)) if len(s) else np.zeros(0, np.uint64)
    n = np.diff(first)
    docs = np.arange(len(n))
    cur, prev = np.full(len(h) + len(n), END, np.uint64), np.full(len(h) + len(n), START, np.uint64)
    inner = np.ones(len(cur), bool)
    inner[first[1:] + docs] = False
    cur[inner] = h
    inner[:] = True
    inner[first[:-1] + docs] = False
    prev[inner] = h
    return cur, prev, np.repeat(docs, n + 1)


def pair_keys(cur: np.ndarray, prev: np.ndarray) -> np.ndarray:
    """A key holds the word in its high half, the word before it in the low one (0: the word alone)."""
    return (cur << HALF) | prev


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n."""
    return F.crc32(key.cast("string").cast("binary")) % n


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the columns of counts for each distinct key, sorted."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return k[at], np.add.reduceat(c, at)


def bucket_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def labels_of(labels: DataFrame, key: str, toxic: str) -> DataFrame:
    """(key, toxic) once for each labelled key."""
    return labels.where(F.col(key).isNotNull() & F.col(toxic).isNotNull()).groupBy(F.col(key).cast("long").alias("key")).agg(F.max(toxic).cast("long").alias("toxic"))


def pair_counts(docs: DataFrame, y: DataFrame) -> DataFrame:
    """Counts of all pairs of the labelled documents: (kind, key, SUMS, payload) rows, kind 0 the sums of a bucket, kind 1 its
    pairs (keys and counts in both classes).

    ``docs``: key (long), text; ``y``: key, toxic.
    """
    buckets = bucket_count(docs.sparkSession)
    out = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("key", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in SUMS] + [T.StructField("payload", T.BinaryType())])
    out_arrow = to_arrow_schema(out)

    def home(k: np.ndarray) -> np.ndarray:
        return (tx.mix(k.view(np.uint64)) % np.uint64(buckets)).astype(np.int64) * SALT

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            bad = batch.column(1).to_numpy(zero_copy_only=False) > 0
            order = np.lexsort((k, home(k)))
            k, bad = k[order], bad[order]
            for i, j in _edges(home(k)):
                payload = tx.pack(k[i:j], bad[i:j].view(np.uint8))
                yield _rows([(int(home(k[i : i + 1])[0]) + s, 0, 0, payload) for s in range(SALT)])

    def send_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() % SALT
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi, buf, off in tx.byte_chunks(batch, "text", CHUNK):
                k, n = keys[lo:hi], np.diff(off)
                order = np.argsort(home(k), kind="stable")
                out = []
                for i, j in _edges(home(k[order])):
                    g = order[i:j]
                    out.append((int(home(k[g[:1]])[0]) + salt, 1, 0, tx.pack(k[g], tx.narrow(n[g]), buf[tx.ranges(off[:-1][g], n[g])])))
                yield _rows(out)

    def send(k: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        b = ((k >> HALF) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(b, kind="stable")
        k, c, b = k[order], c[order], b[order]
        return _rows([(int(b[i]), 0, 0, tx.pack(np.diff(k[i:j], prepend=np.uint64(0)), tx.narrow(c[i:j, 0]), tx.narrow(c[i:j, 1]))) for i, j in _edges(b)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Labels come before the texts of their bucket."""
        keys, counts, held, now, known, marks = [], [], 0, None, np.zeros(0, np.int64), np.zeros(0, bool)
        for batch in batches:
            for to, kind, payload in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                got = tx.unpack(payload)
                if to != now:
                    now, known, marks = to, np.zeros(0, np.int64), np.zeros(0, bool)
                if kind == 0:
                    known, marks = np.concatenate([known, got[0]]), np.concatenate([marks, got[1].astype(bool)])
                    order = np.argsort(known)
                    known, marks = known[order], marks[order]
                    continue
                k, n, buf = got
                at = np.minimum(np.searchsorted(known, k), max(len(known) - 1, 0))
                hit = known[at] == k if len(known) else np.zeros(len(k), bool)
                cur, prev, doc = events(buf, np.r_[0, np.cumsum(n.astype(np.int64))])
                mine = hit[doc]
                pair, doc = pair_keys(cur, prev)[mine], doc[mine]
                if not len(pair):
                    continue
                first, _ = tx.distinct(tx.mix(pair ^ (doc.astype(np.uint64) * np.uint64(tx.BASE))))
                bad = marks[at[doc[first]]]
                pair, c = _merge([pair[first]], [np.stack([bad, ~bad], 1).astype(np.int64)])
                keys.append(pair)
                counts.append(c)
                held += len(pair)
                if held > HOLD:
                    yield send(*_merge(keys, counts))
                    keys, counts, held = [], [], 0
        if held:
            yield send(*_merge(keys, counts))

    def bucket(number: int, keys: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        k, c = _merge(keys, counts)
        own, cont = word_sums(k, c)
        total = own.sum(1)
        pair = c.sum(1)
        some = lambda x, n: float((x == n).sum())
        rows = [(0, 0, *map(float, own.sum(0)), float(len(own)), some(total, 1), some(total, 2), float(len(k)), some(cont, 1), some(cont, 2), some(pair, 1), some(pair, 2), None)]
        rows.append((1, number, *[0.0] * len(SUMS), tx.pack(np.diff(k, prepend=np.uint64(0)), tx.narrow(c[:, 0]), tx.narrow(c[:, 1]))))
        return _rows(rows, out_arrow)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, counts = None, [], []
        for b in batches:
            for to, payload in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
                if to != now and keys:
                    yield bucket(now, keys, counts)
                    keys, counts = [], []
                now = to
                k, c = pairs_of(payload)
                keys.append(k)
                counts.append(c)
        if keys:
            yield bucket(now, keys, counts)

    met = docs.mapInArrow(send_texts, SENT).unionByName(y.select("key", "toxic").mapInArrow(label, SENT)).repartition(buckets, "to").sortWithinPartitions("to", "kind")
    return met.mapInArrow(count, SENT).repartition(buckets, "to").sortWithinPartitions("to").mapInArrow(merge, out)


def pairs_of(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts in both classes)."""
    d, t, o = tx.unpack(payload)
    return np.cumsum(d, dtype=np.uint64), np.stack([t.astype(np.int64), o.astype(np.int64)], 1)


def word_sums(k: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts in both classes, contexts) of each word of sorted pairs."""
    at = np.flatnonzero(np.r_[True, (k[1:] >> HALF) != (k[:-1] >> HALF)])
    return np.add.reduceat(c, at), np.diff(np.r_[at, len(k)])


def ney(once: float, twice: float) -> float:
    return once / (once + 2 * twice) if once else 0.5


class Law:
    """Totals of both classes (toxic, ordinary), discounts, and what follows for words. ``free``: what the classes' words free."""

    def __init__(self, sums: dict[str, float]):
        self.n = np.array([sums["n_t"], sums["n_o"]])
        self.share = self.n / self.n.sum()
        self.lift = min(LIFT, (1 + 1 / self.share.min()) / 2)
        self.types, self.contexts = sums["types"], sums["cont"]
        self.d0, self.d1, self.d2 = ney(sums["c1"], sums["c2"]), ney(sums["w1"], sums["w2"]), ney(sums["p1"], sums["p2"])
        self.free = np.ones(2)

    def excess(self, c: np.ndarray) -> np.ndarray:
        """What the classes keep of their counts."""
        return KEEP * np.maximum(c - DISCOUNT - self.lift * c.sum(1)[:, None] * self.share, 0)

    def words(self, own: np.ndarray, cont: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(S1, r of both classes) of words with these counts and contexts."""
        s0 = (cont - self.d0 + self.d0 * self.types / (self.types + 1)) / self.contexts
        s1 = (own.sum(1) - self.d1 + self.d1 * self.types * s0) / self.n.sum()
        return s1, self.excess(own) / self.n / s1[:, None] + self.free

    def settle(self, pairs: DataFrame) -> None:
        """Sums up what the classes keep of all words."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                kept = [self.excess(word_sums(*pairs_of(p))[0]).sum(0) for p in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([x[q] for x in kept], pa.float64()) for q in (0, 1)], names=["t", "o"])

        kept = pairs.mapInArrow(run, "t double, o double").collect()  # a row for each bucket
        self.free = 1 - np.array([math.fsum(r[q] for r in kept) for q in (0, 1)]) / self.n


def _context_sums(pairs: DataFrame, law: Law, buckets: int) -> DataFrame:
    """From the pairs of each word's bucket to the contexts' buckets: sums over each context (kind 0), pairs that exceed the
    discounts (kind 1); and each word's u to its own bucket (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for payload in b.column(0).to_pylist():
                k, c = pairs_of(payload)
                own, cont = word_sums(k, c)
                s1, r = law.words(own.astype(np.float64), cont.astype(np.float64))
                word = np.repeat(np.arange(len(cont)), cont)
                w = k[np.r_[0, np.cumsum(cont)[:-1]]] >> HALF
                prev = k & LOW
                order = np.lexsort((prev, prev % np.uint64(buckets)))
                v, c, word, k = prev[order], c[order], word[order], k[order]
                at = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
                over = law.excess(c)
                keep = c.sum(1) - law.d2
                dense = np.concatenate([np.add.reduceat(c, at), np.diff(np.r_[at, len(v)])[:, None]], 1)
                # only what differs from the words that no class knows better is sent
                sparse = np.concatenate([np.add.reduceat(over, at), np.add.reduceat(keep[:, None] * (r[word] - law.free), at)], 1)
                cv = v[at]
                to = (cv % np.uint64(buckets)).astype(np.int64)
                out = []
                for i, j in _edges(to):
                    some = np.flatnonzero(sparse[i:j].any(1))
                    out.append((int(to[i]), 0, 0, tx.pack(np.diff(cv[i:j], prepend=np.uint64(0)), *[tx.narrow(dense[i:j, q]) for q in range(3)], tx.narrow(some), sparse[i:j][some].ravel())))
                big = np.flatnonzero(over.any(1))
                to = (v[big] % np.uint64(buckets)).astype(np.int64)
                for i, j in _edges(to):
                    g = big[i:j]
                    out.append((int(to[i]), 1, 0, tx.pack(k[g], c[g].ravel(), s1[word[g]], r[word[g]].ravel())))
                u = np.log(r / law.free)
                u = u[:, 0] - u[:, 1]
                g = np.flatnonzero(u)
                g = g[np.argsort(w[g] % np.uint64(buckets), kind="stable")]
                to = (w[g] % np.uint64(buckets)).astype(np.int64)
                for i, j in _edges(to):
                    out.append((int(to[i]), 2, 0, tx.pack(w[g[i:j]], u[g[i:j]], own[g[i:j]].sum(1))))
                yield _rows(out)

    return pairs.mapInArrow(run, SENT)


def _settled(law: Law, known: list[bytes], exceed: list[bytes], words: list[bytes]) -> tuple[np.ndarray, ...]:
    """(keys, values, counts) of a bucket's words and pairs, sorted; those of value 0 say nothing and are not there."""
    v, dense, sparse = [], [], []
    for p in known:
        d, t, o, kinds, some, x = tx.unpack(p)
        v.append(np.cumsum(d, dtype=np.uint64))
        dense.append(np.stack([t, o, kinds], 1).astype(np.int64))
        s = np.zeros((len(d), 4))
        s[some] = x.reshape(-1, 4)
        sparse.append(s)
    keys, values, counts = [np.zeros(0, np.uint64)], [np.zeros(0)], [np.zeros(0, np.int64)]
    if v:
        every = np.concatenate(v)
        v, dense = _merge(v, dense)
        sums = np.stack([np.bincount(np.searchsorted(v, every), x, minlength=len(v)) for x in np.concatenate(sparse).T], 1)
        own, all_ = dense[:, :2], dense[:, :2].sum(1)
        rest = law.d2 * dense[:, 2] / all_
        z = (sums[:, 2:] + law.free * (all_ - law.d2 * dense[:, 2])[:, None]) / all_[:, None] + rest[:, None]
        with np.errstate(all="ignore"):
            a = np.where(own > 0, (own - sums[:, :2]) / np.maximum(own, 1), 1.0) / z
        lam = np.log(a[:, 0]) - np.log(a[:, 1])
        keys.append(v << HALF)
        values.append(lam)
        counts.append(all_)
        for p in exceed:
            k, c, s1, r = tx.unpack(p)
            c, r = c.reshape(-1, 2), r.reshape(-1, 2)
            i = np.searchsorted(v, k & LOW)
            s2 = (c.sum(1) - law.d2) / all_[i] + rest[i] * s1
            prob = law.excess(c) / np.maximum(own[i], 1) + a[i] * s2[:, None] * r
            keys.append(k)
            values.append(np.log(prob[:, 0]) - np.log(prob[:, 1]) - (np.log(r[:, 0]) - np.log(r[:, 1])) - lam[i])
            counts.append(c.sum(1))
    for p in words:
        k, u, n = tx.unpack(p)
        keys.append(k << HALF)
        values.append(u)
        counts.append(n)
    k, val, n = np.concatenate(keys), np.concatenate(values), np.concatenate(counts)
    if not len(k):
        return k, val, n
    one, inverse = np.unique(k, return_inverse=True)
    val = np.bincount(inverse, val)
    most = np.zeros(len(one), np.int64)
    np.maximum.at(most, inverse, n)
    some = np.flatnonzero(val)
    return one[some], val[some], most[some]


def model_table(pairs: DataFrame, law: Law, buckets: int) -> DataFrame:
    """(to, payload): for each bucket the keys of its words and of the pairs after its contexts, their values and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [], [])

        def done() -> Iterator[pa.RecordBatch]:
            k, val, n = _settled(law, *(sorted(x) for x in held))  # so that sums do not depend on the order of arrival
            if len(k):
                yield _rows([(now, 0, 0, tx.pack(np.diff(k, prepend=np.uint64(0)), val.astype(np.float32), tx.narrow(n)))])

        for b in batches:
            for to, kind, payload in zip(*(b.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if to != now and now is not None:
                    yield from done()
                    held = ([], [], [])
                now = to
                held[kind].append(payload)
        if now is not None:
            yield from done()

    return _context_sums(pairs, law, buckets).repartition(buckets, "to").sortWithinPartitions("to", "kind").mapInArrow(run, SENT)


def _level(n: np.ndarray) -> np.ndarray:
    """Eight levels for each doubling of a count."""
    return np.floor(8 * np.log2(np.maximum(n, 1))).astype(np.int64)


class Model:
    """The values of all buckets as a table, the most frequent ones at hand, a map of the others, and the curve."""

    def __init__(self, table: DataFrame | None, buckets: int = 1, base: float = 0.0):
        """``base``: the ratio of a word that neither class prefers, in a context that says nothing."""
        self.table, self.buckets, self.base = table, buckets, base
        self.x, self.y = np.array([0.0]), np.array([LOW_SCORE])
        if table is not None:
            self.at_hand = table.sparkSession.sparkContext.broadcast(self._at_hand(table))

    def _at_hand(self, table: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, values of at most HEAD words and HEAD pairs, map of all other keys)."""

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
            for b in batches:
                for payload in b.column(0).to_pylist():
                    d, val, n = tx.unpack(payload)
                    k = np.cumsum(d, dtype=np.uint64)
                    yield k, val, ((k & LOW) != 0).astype(np.int64), _level(n.astype(np.int64))

        def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, _, is_pair, level in each(batches):
                at, n = np.unique(is_pair * 1000 + level, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], names=["at", "n"])

        least = [1000, 1000]
        held = [0, 0]
        counts = table.select("payload").mapInArrow(levels, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).orderBy(F.desc("at")).collect()
        for row in counts:
            is_pair, level = divmod(row["at"], 1000)
            if held[is_pair] + row["n"] <= HEAD and least[is_pair] <= 1000:
                held[is_pair] += row["n"]
                least[is_pair] = level
            else:
                held[is_pair] = HEAD + 1  # and nothing more frequent is left out
        least = np.array(least)

        def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for k, val, is_pair, level in each(batches):
                g = level >= least[is_pair]
                if g.any():
                    yield pa.RecordBatch.from_arrays([pa.array([tx.pack(k[g], val[g])], pa.binary())], names=["payload"])

        def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for k, _, is_pair, level in each(batches):
                pos = (tx.mix(k[level < least[is_pair]]) % np.uint64(BITS)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pos)], names=["pos"])

        found = [tx.unpack(r["payload"]) for r in table.select("payload").mapInArrow(head, "payload binary").collect()]
        k = np.concatenate([np.zeros(0, np.uint64), *[x[0] for x in found]])
        val = np.concatenate([np.zeros(0), *[x[1] for x in found]])
        order = np.argsort(k)
        bits = np.zeros(BITS // 8, np.uint8)
        maps = table.select("payload").mapInArrow(rest, "pos long").groupBy(F.shiftright("pos", 15).alias("at")).agg(F.expr("bitmap_construct_agg(pos & 32767)").alias("map"))
        for row in maps.collect():  # at most BITS / 8 bytes
            bits[row["at"] << 12 : (row["at"] + 1) << 12] = np.frombuffer(row["map"], np.uint8)
        return k[order], val[order], bits


def fit_counts(docs: DataFrame, labels: DataFrame, text: str, key: str, toxic: str) -> Model:
    """Counts over all labelled documents of ``docs``."""
    spark = docs.sparkSession
    y = labels_of(labels, key, toxic)
    d = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    shared_folder(spark)
    bound_batches(spark)
    found = pair_counts(maybe_labelled(d, y, "key"), y).checkpoint()
    sums = found.where("kind = 0").agg(*[F.sum(c).alias(c) for c in SUMS]).first().asDict()
    if not sums["n_t"] or not sums["n_o"]:
        return Model(None)
    law, pairs, buckets = Law(sums), found.where("kind = 1").select("payload"), bucket_count(spark)
    law.settle(pairs)
    return Model(model_table(pairs, law, buckets).checkpoint(), buckets, float(np.log(law.free[0] / law.free[1])))


def rising(bins: np.ndarray, good: np.ndarray, all_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points (x ascending, y not falling) of the monotone curve nearest to good / all_ of each bin (pool adjacent violators)."""
    base = good.sum() / max(all_.sum(), 1)
    blocks: list[list[float]] = []
    for b, g, n in zip(bins.tolist(), good.tolist(), all_.tolist(), strict=True):
        blocks.append([g, n, b * n])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            top = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], top, strict=True)]
    return np.array([x / n for _, n, x in blocks]), np.maximum.accumulate([(g + base) / (n + 1) for g, n, _ in blocks])


def raw_scores(docs: DataFrame, model: Model, text: str, key: str, curve: bool = False) -> DataFrame:
    """(key, raw) of every row: the length-normalised log-likelihood ratio, or (``curve``) the score that it stands for."""
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("raw", T.DoubleType())])
    arrow = to_arrow_schema(schema)
    if model.table is None:
        return docs.select(key, F.lit(LOW_SCORE if curve else 0.0).alias("raw"))
    buckets, base, at_hand, x, y = model.buckets, model.base, model.at_hand, model.x, model.y
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of what is at hand (kind 2, by chunk); what is not, to its bucket (kind 1): keys with their documents and counts."""
        number = TaskContext.get().partitionId() << 24
        known, values, bits = at_hand.value
        for batch in batches:
            k = batch.column(batch.schema.get_field_index(key))
            for lo, hi, buf, off in tx.byte_chunks(batch, text, CHUNK):
                cur, prev, doc = events(buf, off)
                n = np.bincount(doc, minlength=hi - lo)
                # each word once as such (END, too) and START once for each document; then the pairs
                keys = np.concatenate([cur << HALF, np.full(hi - lo, START, np.uint64) << HALF, pair_keys(cur, prev)])
                doc = np.concatenate([doc, np.arange(hi - lo), doc])
                one, inverse = tx.distinct(tx.mix(keys))
                own = keys[one]
                at = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
                hit = known[at] == own if len(known) else np.zeros(len(own), bool)
                gain = np.zeros(len(own))
                gain[hit] = values[at[hit]]
                total = np.bincount(doc, gain[inverse], minlength=hi - lo)
                pos = tx.mix(own) % np.uint64(BITS)
                maybe = ~hit & ((bits[(pos >> np.uint64(3)).astype(np.int64)] >> (pos & np.uint64(7)).astype(np.uint8)) & 1 == 1)
                out = []
                far = np.flatnonzero(maybe[inverse])
                if len(far):
                    fk, fd = keys[far], doc[far]
                    to = np.where((fk & LOW) == 0, fk >> HALF, fk & LOW) % np.uint64(buckets)
                    order = np.lexsort((fd, fk, to))
                    fk, fd, to = fk[order], fd[order], to[order].astype(np.int64)
                    first = np.flatnonzero(np.r_[True, (fk[1:] != fk[:-1]) | (fd[1:] != fd[:-1])])
                    times = np.diff(np.r_[first, len(fk)])
                    fk, fd, to = fk[first], fd[first], to[first]
                    for i, j in _edges(to):
                        at = np.flatnonzero(np.r_[True, fk[i + 1 : j] != fk[i : j - 1]])
                        runs = np.diff(np.r_[at, j - i])
                        out.append((int(to[i]), 1, number, tx.pack(np.diff(fk[i:j][at], prepend=np.uint64(0)), tx.narrow(runs), tx.narrow(fd[i:j]), tx.narrow(times[i:j]))))
                sink = pa.BufferOutputStream()
                held = pa.RecordBatch.from_arrays([k.slice(lo, hi - lo).cast(arrow.field(0).type)], schema=pa.schema([arrow.field(0)]))
                with pa.ipc.new_stream(sink, held.schema) as w:
                    w.write_batch(held)
                out.append((number, 2, -1, tx.pack(np.frombuffer(sink.getvalue(), np.uint8), tx.narrow(n), total)))
                yield _rows(out)
                number += 1

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A bucket's values (kind 0) come before its questions; to each chunk the sums of its documents."""
        now, known, values = None, np.zeros(0, np.uint64), np.zeros(0)
        for batch in batches:
            out = []
            for to, kind, src, payload in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if kind == 2:
                    out.append((to, kind, src, payload))
                    continue
                if to != now:
                    now, known, values = to, np.zeros(0, np.uint64), np.zeros(0)
                if kind == 0:
                    d, values, _ = tx.unpack(payload)
                    known = np.cumsum(d, dtype=np.uint64)
                    continue
                d, runs, doc, times = tx.unpack(payload)
                own = np.cumsum(d, dtype=np.uint64)
                at = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
                hit = known[at] == own if len(known) else np.zeros(len(own), bool)
                gain = np.zeros(len(own))
                gain[hit] = values[at[hit]]
                gain = np.repeat(gain, runs) * times
                some = gain != 0
                docs_, inverse = np.unique(doc[some], return_inverse=True)
                if len(docs_):
                    out.append((src, 3, to, tx.pack(docs_, np.bincount(inverse, gain[some]).astype(np.float32))))
            if out:
                yield _rows(out)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A chunk's own sums come before the answers."""

        def done(keys: np.ndarray, n: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
            keys = pa.ipc.open_stream(keys.tobytes()).read_all().column(0).combine_chunks()
            raw = total / n + base
            # a slight rise everywhere keeps the order of raw scores
            score = 0.98 * np.interp(raw, x, y) + 0.01 + 0.01 * np.tanh(raw / SPAN) if curve else raw
            return pa.RecordBatch.from_arrays([keys, pa.array(score)], schema=arrow)

        now, held = None, None
        for b in batches:
            for to, kind, payload in zip(*(b.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if to != now:
                    if held is not None:
                        yield done(*held)
                    now, held = to, None
                if kind == 2:
                    keys, n, total = tx.unpack(payload)
                    held = keys, n, total.copy()  # what is unpacked may be read-only
                elif held is None:
                    raise RuntimeError("an answer for a chunk that is not there")
                else:
                    docs_, sums = tx.unpack(payload)
                    held[2][docs_] += sums
        if held is not None:
            yield done(*held)

    asked = docs.select(key, text).mapInArrow(ask, SENT).unionByName(model.table)
    answers = asked.repartition(buckets, "to").sortWithinPartitions("to", "kind", "src").mapInArrow(answer, SENT)
    return answers.repartition(parts, "to").sortWithinPartitions("to", "kind", "src").mapInArrow(assemble, schema)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", toxic: str = "toxic", part: Column | None = None) -> Model:
    """The model of the labelled documents. ``part``: true for rows that only the curve is fitted on (by default a fifth)."""
    part = part if part is not None else fold(F.col(key), 5) == 4
    model = fit_counts(docs.where(~part), labels.where(~part), text, key, toxic)
    if model.table is None:
        return model
    y = labels_of(labels.where(part), key, toxic).select("key", (F.col("toxic") > 0).cast("long").alias("y"))
    d = docs.where(part).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    seen = raw_scores(maybe_labelled(d, y, "key"), model, "text", "key").join(y, "key")
    bins = seen.groupBy(F.width_bucket("raw", F.lit(-SPAN), F.lit(SPAN), F.lit(BINS)).alias("bin")).agg(F.count("*").alias("n"), F.sum("y").alias("y")).orderBy("bin").collect()
    if bins:
        model.x, model.y = rising(*(np.array([float(r[c]) for r in bins]) for c in ("bin", "y", "n")))
        model.x = (model.x - 0.5) / BINS * 2 * SPAN - SPAN
    return model


def toxicity(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, score) of every row."""
    return raw_scores(docs, model, text, key, curve=True).withColumnRenamed("raw", "score")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: toxicity of all documents, learnt from the rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held = fold(F.col("doc_id"), 5) == 0
    model = train(docs.where(~held), labels.where(~held))
    return toxicity(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
