"""Harmonic packing of tokenised documents into fixed-length sequences.

A document of n tokens fills n div capacity sequences by itself; what is left of it, of length r, falls into the
reciprocal-capacity class k = capacity div r, the lengths from capacity / (k + 1) (without) to capacity / k. A bin of class k holds
exactly k documents. What k documents leave open, less than one document of the class takes, is filled with the first tokens of the next
document that comes by, which is cut there; so a sequence costs one cut at most and has no padding. A worker fills the
bins of all classes on its own, in the order of its documents: no exchange is needed, and a partition that is lost is
simply packed again, with the same result. What is left in open bins at the end of a partition is laid out one after
another in full sequences and, for the last less than a capacity, sequences of powers of two.

A worker holds its open bins: less than a capacity for each of the fewer than 2 * sqrt(capacity) classes.

Tokens: the text is cut where no token can span (ASCII white space, between ASCII letters, digits and punctuation),
each distinct unit of a chunk is tokenised once, and a worker remembers units across chunks in a bounded table.

Defined results: a null or empty text is the end token alone; rows that repeat, also with equal or null keys, are packed one
by one; a text of any length is tokenised at once and cut at every capacity; documents of equal length fill bins in the order of the input; extra
columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from blockwright.llm import text as tx
from blockwright.session import bound_batches

CAPACITY = 4096
END_ID = 2
#: Characters that are tokenised at a time.
CHUNK = 1 << 21
#: Units that a worker remembers before it starts anew.
REMEMBER = 2_000_000

_SIMPLE = re.compile("(?:[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-&(-/:-@\\[-`{-~]+)\\Z")


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else from 256 on."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


class UnitTokenizer:
    """Token ids of texts by a word-end BPE file of the tokenizers library, unit by unit."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.model = self.whole.model
        self.stand_in = {b: c for b, c in byte_alphabet().items() if chr(b) != c}
        self.forget()
        klass = np.full(256, 4, np.uint8)  # 0 space, 1 letter, 2 other, 3 digit, 4 beyond Latin 1 or not plain there
        klass[:128] = 2
        klass[[0x20, *range(0x09, 0x0E)]] = 0
        klass[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]] = 1
        klass[0x30:0x3A] = 3
        self.klass = klass
        join = np.zeros((5, 5), bool)  # [before, after]: both belong to one unit
        join[1, 1] = join[2, 2] = True
        join[4, 1:] = join[1:, 4] = True
        self.join = join

    def forget(self) -> None:
        self.hashes, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def learn(self, at: np.ndarray, hashes: np.ndarray, units: list[str]) -> None:
        """Remembers the ids of ``units``; ``at``: where their sorted hashes go."""
        found = [self.unit_ids(u) for u in units]
        size = np.array([len(x) for x in found], np.int64)
        ids = np.array([i for x in found for i in x], np.uint32)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.at = np.insert(self.at, at, self.used + np.cumsum(size) - size)
        self.size = np.insert(self.size, at, size)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.used += len(ids)

    def unit_ids(self, unit: str) -> list[int]:
        if not _SIMPLE.match(unit):
            return self.whole.encode(unit, add_special_tokens=False).ids
        unit = unit.lower()
        if not unit.isascii():
            unit = unit.encode().decode("latin-1").translate(self.stand_in)
        return [t.id for t in self.model.tokenize(unit)]

    def units(self, cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spans of the units: cut at ASCII white space and wherever neither tokens nor normalisation can reach across."""
        n = len(cp)
        c = np.full(n, 4, np.uint8)
        low = cp < 256
        c[low] = self.klass[cp[low]]
        edge = off[:-1][off[:-1] < n]
        go_on = np.zeros(n, bool)  # continues the unit of the character before
        go_on[1:] = self.join[c[:-1], c[1:]]
        quote = np.flatnonzero(cp == 0x27)
        if len(quote):  # contractions depend on what surrounds them: such words stay whole
            solid = c != 0
            first = solid.copy()
            first[1:] &= ~solid[:-1]
            first[edge] = solid[edge]
            word = np.cumsum(first)
            marked = np.zeros(int(word[-1]) + 1, bool)
            marked[word[quote]] = True
            go_on |= marked[word] & solid & ~first
        go_on[edge] = False
        start = (c != 0) & ~go_on
        end = np.ones(n, bool)
        end[:-1] = ~go_on[1:]
        end &= c != 0
        return np.flatnonzero(start), np.flatnonzero(end) + 1

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, offsets of each text in them)."""
        joined = "".join(texts)
        off = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(x) for x in texts], out=off[1:])
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        if not len(cp):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        s, e = self.units(cp, off)
        h = tx.span_hash(tx.prefix_hash(cp), s, e)
        one, inverse = tx.distinct(h)
        if len(self.hashes) > REMEMBER:
            self.forget()
        own = h[one]
        order = np.argsort(own, kind="stable")
        own = own[order]
        at = np.searchsorted(self.hashes, own)
        new = np.ones(len(own), bool)
        inside = at < len(self.hashes)
        new[inside] = self.hashes[at[inside]] != own[inside]
        new[1:] &= own[1:] != own[:-1]
        if new.any():
            which = one[order[new]]
            self.learn(at[new], own[new], [joined[a:b] for a, b in zip(s[which].tolist(), e[which].tolist(), strict=True)])
        slot = np.empty(len(own), np.int64)
        slot[order] = np.searchsorted(self.hashes, own)
        slot = slot[inverse]
        each = self.size[slot]
        ids = self.flat[tx.ranges(self.at[slot], each)]
        ends = np.zeros(len(s) + 1, np.int64)
        np.cumsum(each, out=ends[1:])
        return ids, ends[np.searchsorted(s, off)]


_tokenizers: dict[str, UnitTokenizer] = {}


def tokenizer(path: str) -> UnitTokenizer:
    """The worker's tokenizer of a file, loaded once."""
    if path not in _tokenizers:
        _tokenizers[path] = UnitTokenizer(path)
    return _tokenizers[path]


class Bins:
    """The open bins of a worker, one for each class. ``full`` holds rows (key, start, tokens, document's tokens, sequence, offset)."""

    def __init__(self, first: int, capacity: int):
        self.next, self.capacity = first, capacity
        self.open: dict[int, list[tuple]] = {}
        #: Bins with all their documents whose rest is still to be filled, and the tokens that they hold.
        self.waiting: deque[tuple[list[tuple], int]] = deque()
        self.full: list[tuple] = []

    def sequence(self, pieces: list[tuple]) -> None:
        at = 0
        for p in pieces:
            self.full.append((*p, self.next, at))
            at += len(p[2])
        self.next += 1

    def add(self, key: object, own: np.ndarray) -> None:
        """Places the tokens of a document."""
        n, at = len(own), 0
        while n - at >= self.capacity:
            self.sequence([(key, at, own[at : at + self.capacity], n)])
            at += self.capacity
        while at < n and self.waiting:
            pieces, have = self.waiting.popleft()
            size = min(self.capacity - have, n - at)
            pieces.append((key, at, own[at : at + size].copy(), n))
            at, have = at + size, have + size
            if have < self.capacity:
                self.waiting.appendleft((pieces, have))
            else:
                self.sequence(pieces)
        if at < n:
            k = self.capacity // (n - at)
            pieces = self.open.setdefault(k, [])
            pieces.append((key, at, own[at:].copy(), n))
            if len(pieces) == k:
                del self.open[k]
                have = sum(len(p[2]) for p in pieces)
                if have < self.capacity:
                    self.waiting.append((pieces, have))
                else:
                    self.sequence(pieces)

    def close(self) -> None:
        """Lays out what is left one after another; the last sequences have lengths of powers of two."""
        left = [p for pieces, _ in self.waiting for p in pieces] + [p for _, pieces in sorted(self.open.items()) for p in pieces]
        self.waiting.clear()
        self.open = {}
        rest = sum(len(p[2]) for p in left)
        pieces, have = [], 0
        for key, start, own, n in left:
            at = 0
            while at < len(own):
                room = self.capacity if rest >= self.capacity else 1 << (rest.bit_length() - 1)
                size = min(room - have, len(own) - at)
                pieces.append((key, start + at, own[at : at + size], n))
                at, have = at + size, have + size
                if have == room:
                    self.sequence(pieces)
                    pieces, have, rest = [], 0, rest - room


def pack_documents(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = True) -> DataFrame:
    """Pieces of all documents with their places in sequences.

    Columns: key, start, length, ids (array of the piece's tokens, if asked for), ids_crc32, doc_tokens, sequence_id,
    offset. A sequence's pieces lie gapless from offset 0; its length is ``capacity`` (a power of two) or a smaller power.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    bound_batches(docs.sparkSession)
    kind = docs.schema[key].dataType
    fields = [(key, kind), ("start", T.LongType()), ("length", T.LongType())]
    fields += [("ids", T.ArrayType(T.IntegerType()))] if ids else []
    fields += [(c, T.LongType()) for c in ("ids_crc32", "doc_tokens", "sequence_id", "offset")]
    schema = T.StructType([T.StructField(*f) for f in fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def rows(placed: list[tuple]) -> pa.RecordBatch:
        found = [(k, at, len(part), *([part] if ids else []), zlib.crc32(part.tobytes()), n, seq, place) for k, at, part, n, seq, place in placed]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        bins = Bins(TaskContext.get().partitionId() << 32, capacity)
        for batch in batches:
            texts = tx.text_column(batch, text).to_pylist()
            keys = batch.column(batch.schema.get_field_index(key)).to_pylist()
            ends = np.zeros(len(texts) + 1, np.int64)
            np.cumsum([len(x) for x in texts], out=ends[1:])
            for lo, hi in tx.chunks(ends, CHUNK):
                flat, off = tok.encode(texts[lo:hi])
                for i in range(hi - lo):
                    bins.add(keys[lo + i], np.append(flat[off[i] : off[i + 1]], np.uint32(end_id)))
                if bins.full:
                    yield rows(bins.full)
                    bins.full = []
        bins.close()
        if bins.full:
            yield rows(bins.full)

    return docs.select(key, text).mapInArrow(run, schema)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: all documents in sequences of 4096 tokens."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), ids=False)
