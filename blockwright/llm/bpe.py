"""Byte-level BPE encoding and decoding through a global exchange of distinct words.

1. Pre-tokens: a vectorised form of the usual byte-level pattern finds the pre-tokens of a block (a bounded run of
   whole documents) and replaces them by a stream of word numbers, one for each position.
2. Global distinct words: each block sends its distinct pre-tokens, dealt by hash into buckets; a bucket encodes each
   distinct pre-token once, whatever block it came from, and answers every block with the ids.
3. Reassembly: a block's stream of positions meets the answers to its words, which gives the ids of each document in
   order. Decoding looks the ids up in the token-byte table of the vocabulary (its size is fixed).

No word is hot: a block sends a word once, however often it occurs. A block's stream and words are derived twice from
the same scan (once for each side of the reassembly) instead of being shuffled twice; a seal over the words tells if the two
scans ever differ, which is an error. Lost executors are covered by recomputation.

Defined results: a null or empty text has no ids and decodes to an empty value; rows that repeat, also with equal or null keys,
are encoded one by one; a text of any length is one block; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from blockwright.llm import text as tx
from blockwright.session import bound_batches

#: Characters in a block of whole documents.
BLOCK = 4 << 20

OTHER, LETTER, NUMBER, SPACE, EDGE = range(5)
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of every code point: letter, number, white space or other."""
    if not _classes:
        points = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        out = np.zeros(0x110000, np.uint8)
        for kind, what in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
            for m in regex.finditer(what, points):
                out[ord(points[m.start()]) : ord(points[m.end() - 1]) + 1] = kind
        out[0xD800:0xE000] = OTHER
        _classes.append(out)
    return _classes[0]


def pretoken_starts(cp: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where the pre-tokens start, in the code points of texts that lie one after the other.

    Contractions 's 't 're 've 'm 'll 'd; runs of letters, of numbers and of other characters, each with one space
    before it; white space, of which the last character stays with what follows.
    """
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    c = classes()[cp]
    begin = off[:-1][off[:-1] < n]
    before = np.empty(n, np.uint8)
    before[1:] = c[:-1]
    before[begin] = EDGE
    after = np.empty(n, np.uint8)
    after[:-1] = c[1:]
    after[off[1:][off[1:] > 0] - 1] = EDGE
    blank = np.zeros(n, bool)  # the character before is a plain space
    blank[1:] = cp[:-1] == 0x20
    blank[begin] = False
    space = c == SPACE
    start = ~space & (c != before) & ~blank
    start |= space & ((before != SPACE) | ((after != SPACE) & (after != EDGE)))
    quote = np.flatnonzero((cp == 0x27) & start)
    if len(quote):
        end = off[np.searchsorted(off, quote, "right")]
        one = np.where(quote + 1 < end, cp[np.minimum(quote + 1, n - 1)], 0)
        two = np.where(quote + 2 < end, cp[np.minimum(quote + 2, n - 1)], 0)
        short = np.isin(one, [ord(x) for x in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        hit = short | long
        start[quote[hit] + 1] = False
        rest = np.where(short, quote + 2, quote + 3)
        start[rest[hit & (rest < end)]] = True
    return np.flatnonzero(start)


class Vocabulary:
    """Ranks of a .tiktoken file: ids of a pre-token, bytes of an id."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.token = {i: b for b, i in ranks.items()}


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


class Block:
    """A run of documents as distinct words, ordered by bucket, and the word number at each position."""

    def __init__(self, texts: list[str], buckets: int):
        joined = "".join(texts)
        off = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(x) for x in texts], out=off[1:])
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        s = pretoken_starts(cp, off)
        e = np.append(s[1:], len(cp))
        self.first = np.searchsorted(s, off)  # of each document, in the stream
        h = tx.span_hash(tx.prefix_hash(cp), s, e) if len(s) else np.zeros(0, np.uint64)
        one, inverse = tx.distinct(h)
        bucket = (h[one] >> np.uint64(20)).astype(np.int64) % buckets
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.stream = rank[inverse]
        self.bucket = bucket[order]
        one = one[order]
        #: Tells the block's words from any others, so that answers are only taken for the words that asked.
        self.seal = h[one].sum(dtype=np.uint64)[None] if len(one) else np.zeros(1, np.uint64)
        self.spans = s[one], e[one]
        self.text = joined

    def words(self) -> Iterator[tuple[int, list[str]]]:
        """(bucket, its words in order)."""
        edge = np.flatnonzero(np.r_[True, self.bucket[1:] != self.bucket[:-1]]) if len(self.bucket) else np.zeros(0, np.int64)
        s, e = (x.tolist() for x in self.spans)
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(s)], strict=True):
            yield int(self.bucket[a]), [self.text[s[i] : e[i]] for i in range(a, b)]


def _blocks(batches: Iterator[pa.RecordBatch], text: str, key: str, buckets: int) -> Iterator[tuple[int, list, Block]]:
    """(block id, keys, block): the same for the same partition, however often it is read."""
    number = TaskContext.get().partitionId() << 24
    texts, keys, size = [], [], 0
    for batch in batches:
        for t, k in zip(tx.text_column(batch, text).to_pylist(), batch.column(batch.schema.get_field_index(key)).to_pylist(), strict=True):
            if texts and size + len(t) > BLOCK:
                yield number, keys, Block(texts, buckets)
                number, texts, keys, size = number + 1, [], [], 0
            texts.append(t)
            keys.append(k)
            size += len(t)
    if texts:
        yield number, keys, Block(texts, buckets)


class Encoded:
    """The documents of a block with the ids of their words."""

    def __init__(self, keys: list, stream: np.ndarray, first: np.ndarray, size: np.ndarray, ids: np.ndarray, token: dict[int, bytes]):
        self.keys, self.stream, self.first, self.token = keys, stream, first, token
        at = np.cumsum(size) - size
        self.word_ids = [ids[a : a + n].tolist() for a, n in zip(at.tolist(), size.tolist(), strict=True)]
        self.size = size

    def documents(self) -> Iterator[tuple[object, list[int]]]:
        """(key, numbers of the document's words in order)."""
        first = self.first.tolist()
        for i, k in enumerate(self.keys):
            yield k, self.stream[first[i] : first[i + 1]].tolist()


def full_rows(x: Encoded) -> Iterator[tuple]:
    """(key, ids, decoded bytes)."""
    data = [b"".join([x.token[i] for i in w]) for w in x.word_ids]
    for k, doc in x.documents():
        yield k, [i for w in doc for i in x.word_ids[w]], b"".join([data[w] for w in doc])


def digest_rows(x: Encoded) -> Iterator[tuple]:
    """(key, number of ids, SHA-256 of the ids as text, SHA-256 of the decoded bytes)."""
    data = [b"".join([x.token[i] for i in w]) for w in x.word_ids]
    said = [" ".join(map(str, w)) for w in x.word_ids]
    for k, doc in x.documents():
        a = hashlib.sha256(" ".join([said[w] for w in doc]).encode()).hexdigest()
        b = hashlib.sha256(b"".join([data[w] for w in doc])).hexdigest()
        yield k, int(x.size[doc].sum()) if doc else 0, a, b


def encode_decode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", finish: Callable[[Encoded], Iterator[tuple]] = full_rows, fields: list[T.StructField] | None = None, buckets: int | None = None) -> DataFrame:
    """Ids of each document and the bytes that they decode to: key, ids (array<int>), decoded (binary).

    ``finish`` may turn a block's result into other columns, ``fields`` (besides the key).
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(key, text)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or 4 * parts
    sent = T.StructType([T.StructField("to", T.LongType()), T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("payload", T.BinaryType())])
    sent_arrow = to_arrow_schema(sent)
    kind = docs.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), *(fields or [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])])
    out_arrow = to_arrow_schema(out)
    key_arrow = out_arrow.field(0).type

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), sent_arrow, strict=True)], schema=sent_arrow)

    def send_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, block in _blocks(batches, text, key, buckets):
            rows = []
            for b, words in block.words():
                raw = [w.encode() for w in words]
                rows.append((b, number, b, tx.pack(tx.narrow(np.array([len(r) for r in raw], np.int64)), np.frombuffer(b"".join(raw), np.uint8), block.seal)))
            if rows:
                yield batch(rows)

    def send_streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, keys, block in _blocks(batches, text, key, buckets):
            sink = pa.BufferOutputStream()
            table = pa.record_batch([pa.array(keys, key_arrow)], names=["key"])
            with pa.ipc.new_stream(sink, table.schema) as w:
                w.write_batch(table)
            words = np.array([len(block.bucket)], np.int64)
            yield batch([(number, number, -1, tx.pack(np.frombuffer(sink.getvalue(), np.uint8), tx.narrow(block.stream), tx.narrow(block.first), words, block.seal))])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition's words come bucket by bucket, so a bucket's words are all that is held."""
        encode, now, known = vocabulary(path).encode, None, {}
        for b in batches:
            rows = []
            for block, bucket, payload in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if bucket != now:
                    now, known = bucket, {}
                size, raw, seal = tx.unpack(payload)
                raw, at, found = raw.tobytes(), 0, []
                for n in size.tolist():
                    w = raw[at : at + n]
                    at += n
                    ids = known.get(w)
                    if ids is None:
                        ids = known[w] = encode(w)
                    found.append(ids)
                rows.append((block, block, bucket, tx.pack(tx.narrow(np.array([len(x) for x in found], np.int64)), tx.narrow(np.array([i for x in found for i in x], np.int64)), seal)))
            if rows:
                yield batch(rows)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition's rows come block by block: the stream (bucket -1) first, then the answers by bucket."""
        token = vocabulary(path).token

        def done(stream: bytes, sizes: list, ids: list, seals: list) -> pa.RecordBatch:
            keys, numbers, first, words, seal = tx.unpack(stream)
            keys = pa.ipc.open_stream(keys.tobytes()).read_all().column(0).to_pylist()
            size = np.concatenate([np.zeros(0, np.int64), *sizes]).astype(np.int64)
            if len(size) != int(words[0]) or any(x != seal[0] for x in seals):
                raise RuntimeError("a block was answered for other words than it holds")
            x = Encoded(keys, numbers.astype(np.int64), first.astype(np.int64), size, np.concatenate([np.zeros(0, np.int64), *ids]), token)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*finish(x), strict=True), out_arrow, strict=True)], schema=out_arrow)

        stream, sizes, ids, seals = None, [], [], []
        for b in batches:
            for bucket, payload in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if bucket < 0:
                    if stream is not None:
                        yield done(stream, sizes, ids, seals)
                    stream, sizes, ids, seals = payload, [], [], []
                else:
                    n, i, seal = tx.unpack(payload)
                    sizes.append(n)
                    ids.append(i)
                    seals.append(seal[0])
        if stream is not None:
            yield done(stream, sizes, ids, seals)

    words = docs.mapInArrow(send_words, sent).repartition(buckets, "to").sortWithinPartitions("bucket", "block")
    answers = words.mapInArrow(answer, sent)
    streams = docs.mapInArrow(send_streams, sent)
    met = streams.unionByName(answers).repartition(4 * parts, "to").sortWithinPartitions("block", "bucket")
    return met.mapInArrow(assemble, out)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: digests of the ids and of the decoded bytes of all documents."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), finish=digest_rows, fields=fields)
