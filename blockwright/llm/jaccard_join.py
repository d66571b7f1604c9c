"""N-gram Jaccard join with prefix trees: documents whose sets of word shingles are alike, and their components.

Two documents link when their sets of SHINGLE-word shingles have a Jaccard similarity of ``num / den`` or more. All links
are found; equal sets form one class and count once.

1. Shingle sets: hashed, one per distinct set of a chunk of documents.
2. Which shingles repeat: a chunk sends each distinct shingle once, as packed runs dealt by hash; a bucket answers which
   of them other chunks have, too, and how often they occur. A chunk sends a shingle once even if many of its sets hold
   it, so that frequent shingles stay small. A set can only be linked if at least ``num / den`` of it repeats: most sets
   end here.
3. Candidates: the global order puts rarer shingles first (by the count of step 2, then by hash); linked sets share one of their first shingles (the prefix
   that leaves too little for a link). Sets that share one, and whose sizes allow a link, are chained to candidate
   components; no pairs are made. A batch chains its own sets first and sends a shingle once for each chain, so that what
   is sent does not grow with the number of tasks times that of sets.
4. Join: the sets of a candidate component are stored in a trie in the global order; each set is looked up in it, sharing
   the overlap of common paths, pruned by what the remaining lengths allow. A component of more than BLOCK sets is cut
   into blocks of sets with the same smallest shingle (a large one by hash), and only blocks that share a prefix shingle
   meet. Every link is verified and counted once for each of its sets; those that connect are kept.
5. Components of the links give each document its component. A document's links are those of its class (equal sets) with
   other classes.

Hashes of shingles have 48 bits, of sets 64. Defined results: a text with fewer words than SHINGLE is one shingle (the
whole sequence); one without words has an empty set, linked with nothing; a null key counts as the smallest; rows that
repeat are linked with one another; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from blockwright.llm import text as tx
from blockwright.llm.components import components
from blockwright.session import bound_batches, shared_folder

SHINGLE = 5
NUM, DEN = 75, 100
CHUNK = 4 << 20
#: Most sets of a block of a large candidate component.
BLOCK = 512
NO_KEY = -(1 << 63)

TOKEN = np.uint64(16)  # bits that a shingle's hash loses


def shingle_sets(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct 48-bit shingles of all texts, first of each text)."""
    buf = tx.LOWER[buf]
    s, e, first = tx.word_spans(buf, off)
    if not len(s):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    h = tx.word_hashes(buf, s, e)
    count = np.diff(first)
    g = tx.ngram_hash(h, SHINGLE)
    at = tx.ranges(first[:-1], np.maximum(count - SHINGLE + 1, 0))
    doc = np.repeat(np.arange(len(count)), np.maximum(count - SHINGLE + 1, 0))
    few = np.flatnonzero((count > 0) & (count < SHINGLE))
    whole = np.array([xxhash.xxh3_64_intdigest(h[first[i] : first[i + 1]].tobytes(), seed=int(count[i])) for i in few.tolist()], np.uint64)
    token = np.concatenate([g[at], whole]) >> TOKEN
    doc = np.concatenate([doc, few])
    if len(count) <= 1 << 16:  # both fit into one number
        key = np.sort((doc.astype(np.uint64) << np.uint64(48)) | token)
        key = key[np.r_[True, key[1:] != key[:-1]]]
        token, doc = key & np.uint64((1 << 48) - 1), (key >> np.uint64(48)).astype(np.int64)
    else:
        order = np.lexsort((token, doc))
        token, doc = token[order], doc[order]
        new = np.r_[True, (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])]
        token, doc = token[new], doc[new]
    return token, np.searchsorted(doc, np.arange(len(count) + 1))


def set_ids(token: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64-bit id of each set, 0 of an empty one."""
    out = np.zeros(len(first) - 1, np.int64)
    for i in np.flatnonzero(np.diff(first)).tolist():
        out[i] = np.uint64(xxhash.xxh3_64_intdigest(token[first[i] : first[i + 1]].tobytes()) | 1).astype(np.int64)
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(chunk, set ids, sizes, shingles by hash, their sets, whether several sets of the chunk hold it), each set once."""
    number = TaskContext.get().partitionId() << 24
    for batch in batches:
        for _, _, buf, off in tx.byte_chunks(batch, "text", CHUNK):
            token, first = shingle_sets(buf, off)
            sid = set_ids(token, first)
            _, one = np.unique(sid, return_index=True)
            one = one[sid[one] != 0]
            size = np.diff(first)[one]
            token = token[tx.ranges(first[:-1][one], size)]
            owner = np.repeat(np.arange(len(one)), size)
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            many = np.zeros(len(token), bool)
            many[1:] = token[1:] == token[:-1]
            many[:-1] |= many[1:]
            if len(token):
                yield number, sid[one], size, token, owner, many
            number += 1


SENT = T.StructType([T.StructField("to", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("payload", T.BinaryType())])
SETS = T.StructType([T.StructField("sid", T.LongType()), T.StructField("n", T.LongType()), T.StructField("tokens", T.BinaryType())])
#: kind 0: a set (to) and the set that stands for its chain (sid); kind 1: a shingle (to) of a chain (sid) and the sizes of its sets there.
POSTING = T.StructType([T.StructField("to", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType()), T.StructField("sid", T.LongType())])
EDGE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
LINK = T.StructType([*EDGE.fields, T.StructField("n", T.LongType()), T.StructField("part", T.BooleanType())])
#: A shingle of a set: hash and how often it occurs.
SHINGLE_OF = np.dtype([("token", "<u8"), ("count", "<u2")])


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)


def _columns(cols: list[np.ndarray], schema: T.StructType) -> pa.RecordBatch:
    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)


def needed(n: np.ndarray | int) -> np.ndarray | int:
    """Least overlap of a set of n with any set that it links to."""
    return -(-NUM * n // DEN)


def repeated_sets(docs: DataFrame) -> DataFrame:
    """(sid, n, tokens): sets of which enough shingles repeat, with the shingles that do, in the global order.

    Equal sets of different chunks appear more than once.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * parts

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each bucket the chunk's shingles: those of a single set with that set, the others without."""
        for number, sid, _, token, owner, many in _chunks(batches):
            keep = ~many
            keep[1:] |= many[1:] & (token[1:] != token[:-1])  # one of those with several holders
            keep[0] = True
            t, o, m = token[keep], owner[keep], many[keep]
            b = (tx.mix(t) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            b = b[order]
            cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
            rows = []
            for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(b)], strict=True):
                g = order[i:j]
                rows.append((int(b[i]), int(b[i]), tx.pack(np.diff(t[g], prepend=np.uint64(0)), tx.narrow(o[g]), np.packbits(m[g]), np.array([number, seal(sid)], np.int64))))
            yield _batch(rows, SENT)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """To each chunk its shingles that repeat anywhere, with their counts."""

        def done(held: list[list[np.ndarray]]) -> pa.RecordBatch | None:
            t = np.concatenate([x[0] for x in held])
            many = np.concatenate([x[2] for x in held])
            order = np.argsort(t, kind="stable")
            group = np.empty(len(t), np.int64)
            group[order] = np.cumsum(np.r_[True, t[order][1:] != t[order][:-1]]) - 1
            count = np.minimum(np.bincount(group, 1 + many), 65535).astype(np.int64)[group]
            hit = count > 1
            rows, at = [], 0
            for x in held:
                h = np.flatnonzero(hit[at : at + len(x[0])])
                if len(h):
                    rows.append((int(x[3][0]), 0, tx.pack(np.diff(x[0][h], prepend=np.uint64(0)), x[1][h], np.packbits(x[2][h]), tx.narrow(count[at + h]), x[3][1:])))
                at += len(x[0])
            return _batch(rows, SENT) if rows else None

        now, held = None, []
        for b in batches:
            for bucket, payload in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if bucket != now and held:
                    if (out := done(held)) is not None:
                        yield out
                    held = []
                now = bucket
                d, o, m, number = tx.unpack(payload)
                held.append([np.cumsum(d, dtype=np.uint64), o, np.unpackbits(m, count=len(d)).astype(bool), number])
        if held and (out := done(held)) is not None:
            yield out

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A chunk's sets and the shingles that repeat inside it."""
        for number, sid, size, token, owner, many in _chunks(batches):
            t, o = token[many], owner[many]
            yield _batch([(number, -1, tx.pack(sid.view(np.uint64), tx.narrow(size), np.diff(t, prepend=np.uint64(0)), tx.narrow(o)))], SENT)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(sid: np.ndarray, size: np.ndarray, inner: np.ndarray, inner_of: np.ndarray, got: list[tuple]) -> pa.RecordBatch | None:
            if not got:
                return None
            t, o, m, c = (np.concatenate([g[i] for g in got]) for i in range(4))
            # counts of the shingles that several sets of the chunk hold
            order = np.argsort(t[m], kind="stable")
            known, counts = t[m][order], c[m][order]
            inner_count = counts[np.searchsorted(known, inner)] if len(inner) else np.zeros(0, np.int64)
            t = np.concatenate([t[~m], inner])
            o = np.concatenate([o[~m], inner_of]).astype(np.int64)
            c = np.concatenate([c[~m], inner_count])
            order = np.lexsort((t, c, o))
            t, o, c = t[order], o[order], c[order]
            edge = np.searchsorted(o, np.arange(len(sid) + 1))
            enough = np.flatnonzero(np.diff(edge) >= needed(size.astype(np.int64)))
            both = np.empty(len(t), SHINGLE_OF)
            both["token"], both["count"] = t, c
            rows = [(int(sid[i].view(np.int64)), int(size[i]), both[edge[i] : edge[i + 1]].tobytes()) for i in enough.tolist()]
            return _batch(rows, SETS) if rows else None

        state = None
        for b in batches:
            for bucket, payload in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                got = tx.unpack(payload)
                if bucket < 0:
                    if state and (out := done(*state)) is not None:
                        yield out
                    state = (got[0], got[1], np.cumsum(got[2], dtype=np.uint64), got[3], [])
                else:
                    if int(got[4][0]) != seal(state[0].view(np.int64)):
                        raise RuntimeError("a chunk was answered for other sets than it holds")
                    n = len(got[0])
                    state[4].append((np.cumsum(got[0], dtype=np.uint64), got[1], np.unpackbits(got[2], count=n).astype(bool), got[3].astype(np.int64)))
        if state and (out := done(*state)) is not None:
            yield out

    answers = docs.mapInArrow(ask, SENT).repartition(buckets, "to").sortWithinPartitions("bucket").mapInArrow(answer, SENT)
    met = docs.mapInArrow(own, SENT).unionByName(answers).repartition(buckets, "to").sortWithinPartitions("to", "bucket")
    return met.mapInArrow(assemble, SETS)


def seal(sid: np.ndarray) -> int:
    """A checksum of a chunk's sets, so that answers are only taken for the sets that asked."""
    return int((sid >> 1).sum() & ((1 << 62) - 1))


class Forest:
    """Union-find over 0 .. n - 1 with labels at hand for vectorised tests."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.members: dict[int, list[int]] = {i: [i] for i in range(n)}

    def union(self, a: int, b: int) -> bool:
        a, b = int(self.label[a]), int(self.label[b])
        if a == b:
            return False
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        moved = self.members.pop(b)
        self.label[moved] = a
        self.members[a] += moved
        return True


def prefixes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, their sets) of the prefixes of a batch of (sid, n, tokens, ...): sets that link share one of these."""
    token = []
    for n, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
        t = np.frombuffer(raw, SHINGLE_OF)["token"]
        # shingles that do not repeat come first of all and cannot be shared
        token.append(t[: max(n - needed(n) + 1 - (n - len(t)), 0)])
    return np.concatenate(token).astype(np.int64), np.repeat(np.arange(len(token)), [len(t) for t in token])


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n elements the smallest that edges (a, b) reach."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != label[label]).any():
            label = label[label]


def candidate_edges(sets: DataFrame) -> DataFrame:
    """(a, b): sets that share a shingle of their prefixes and whose sizes allow a link, chained."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sid, size = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            token, owner = prefixes(b)
            order = np.lexsort((size[owner], token))
            t, o = token[order], owner[order]
            near = np.flatnonzero((t[1:] == t[:-1]) & (DEN * size[o[:-1]] >= NUM * size[o[1:]]))
            label = joined(len(sid), o[near], o[near + 1])
            inner = np.flatnonzero(label != np.arange(len(sid)))
            if len(inner):
                yield _columns([sid[inner], np.zeros(len(inner), np.int32), size[inner], size[inner], sid[label[inner]]], POSTING)
            chain_of = label[o]
            order = np.lexsort((chain_of, t))
            t, chain_of, n = t[order], chain_of[order], size[o[order]]
            at = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (chain_of[1:] != chain_of[:-1])]) if len(t) else np.zeros(0, np.int64)
            if len(at):
                yield _columns([t[at], np.ones(len(at), np.int32), np.minimum.reduceat(n, at), np.maximum.reduceat(n, at), sid[chain_of[at]]], POSTING)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by shingle and smallest size; what the sizes so far reach is joined. Each chain that has one ends up next
        to its task's smallest."""
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        shingle, reach, at = None, 0, 0
        for b in batches:
            inner = []
            for to, kind, lo, hi, s in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if kind == 0:
                    inner.append((to, s))
                    continue
                if to == shingle and DEN * reach >= NUM * lo:
                    x, y = find(s), find(at)
                    if x != y:
                        root[max(x, y)] = min(x, y)
                    if hi > reach:
                        reach, at = hi, s
                else:
                    shingle, reach, at = to, hi, s
            if inner:
                yield _batch(inner, EDGE)
        if root:
            yield _batch([(x, find(x)) for x in root], EDGE)

    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sets.mapInArrow(post, POSTING).repartition(parts, "to").sortWithinPartitions("kind", "to", "lo", "sid").mapInArrow(chain, EDGE)


class Trie:
    """Sequences (ascending numbers) as a path-compressed trie over their sorted order."""

    def __init__(self, seqs: list[np.ndarray], sizes: list[int]):
        self.order = sorted(range(len(seqs)), key=lambda i: seqs[i].astype(">u4").tobytes())
        self.seqs = [seqs[i] for i in self.order]
        self.sizes = np.array([sizes[i] for i in self.order], np.int64)
        self.lengths = np.array([len(s) for s in self.seqs], np.int64)
        n = len(seqs)
        lcp = np.zeros(n + 1, np.int64)
        for i in range(1, n):
            a, b = self.seqs[i - 1], self.seqs[i]
            m = min(len(a), len(b))
            d = np.flatnonzero(a[:m] != b[:m])
            lcp[i] = d[0] if len(d) else m
        #: (from depth, to depth, first leaf, end of leaves, children, leaves that end here, smallest size, longest sequence)
        self.roots = self._build(lcp)

    def _build(self, lcp: np.ndarray) -> list[int]:
        self.nodes: list[tuple[int, int, int, int, list[int], list[int], int, int]] = []
        out: list[int] = []
        todo = [(0, len(self.seqs), 0, out)]
        while todo:
            lo, hi, depth, into = todo.pop()
            # leaves lo .. hi share ``depth`` symbols; split them by the next one
            edge = [lo, *(int(i) for i in lo + 1 + np.flatnonzero(lcp[lo + 1 : hi] <= depth)), hi]
            for a, b in zip(edge, edge[1:], strict=False):
                to = int(self.lengths[a]) if b - a == 1 else int(min(lcp[a + 1 : b].min(), self.lengths[a:b].min()))
                ends = [i for i in range(a, b) if self.lengths[i] == to]
                kids: list[int] = []
                into.append(len(self.nodes))
                self.nodes.append((depth, to, a, b, kids, ends, int(self.sizes[a:b].min()), int(self.lengths[a:b].max())))
                if b - a > len(ends):
                    todo.append((a + len(ends), b, to, kids))
        return out

    def visit(self, x: int, mask: np.ndarray, skip: np.ndarray | None = None) -> Iterator[int]:
        """Leaves after leaf x that link with it; ``mask``: the numbers of x; leaves with x's label in ``skip`` are passed."""
        seq, size = self.seqs[x], int(self.sizes[x])
        todo = [(r, 0) for r in reversed(self.roots)]
        while todo:
            node, have = todo.pop()
            start, end, lo, hi, kids, ends, small, longest = self.nodes[node]
            if hi <= x + 1 or skip is not None and (skip[max(lo, x + 1) : hi] == skip[x]).all():
                continue
            if end > start:
                part = self.seqs[lo][start:end]
                have += int(np.count_nonzero(mask[part]))
                rest = len(seq) - int(np.searchsorted(seq, part[-1], "right"))
            else:
                rest = len(seq)
            if (NUM + DEN) * (have + min(rest, longest - end)) < NUM * (size + small):
                continue
            for i in ends:
                if i > x and (skip is None or skip[i] != skip[x]) and (NUM + DEN) * have >= NUM * (size + int(self.sizes[i])):
                    yield i
            todo += [(k, have) for k in reversed(kids)]


def join_block(sids: list[int], sizes: list[int], tokens: list[np.ndarray], blocks: list[int]) -> list[tuple[int, int, int]]:
    """(set, smallest set that links reach, number of links) for all sets that have a link.

    ``blocks``: the block of each set. Where two blocks meet, only links between them are taken: those inside a block are
    found where it meets itself.
    """
    if len(sids) < 2:
        return []
    whole = np.concatenate(tokens)
    every, first = np.unique(whole["token"], return_index=True)
    rank = np.empty(len(every), np.int64)
    rank[np.lexsort((every, whole["count"][first]))] = np.arange(len(every))
    trie = Trie([rank[np.searchsorted(every, t["token"])] for t in tokens], sizes)
    block = np.array(blocks)[trie.order]
    block = block if (block != block[0]).any() else None
    forest = Forest(len(sids))
    count = np.zeros(len(sids), np.int64)
    mask = np.zeros(len(every), bool)
    for x in range(len(sids)):
        mask[trie.seqs[x]] = True
        for y in trie.visit(x, mask, block):
            count[x] += 1
            count[y] += 1
            forest.union(x, y)
        mask[trie.seqs[x]] = False
    out = []
    for members in forest.members.values():
        if len(members) > 1:
            least = min(sids[trie.order[i]] for i in members)
            out += [(sids[trie.order[i]], least, int(count[i])) for i in members]
    return out


def met_blocks(placed: DataFrame) -> DataFrame:
    """(g, sid, n, tokens, part, i): the sets of large components (root) by the meetings g of their blocks i.

    A block holds sets with the same smallest shingle, or part of them if there are more than BLOCK.
    """

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            least = [int(np.frombuffer(raw, SHINGLE_OF)["token"].min(initial=(1 << 48) - 1)) for raw in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(least, pa.int64())], names=[*b.schema.names, "least"])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            token, owner = prefixes(b)
            both = np.unique(np.stack([token, b.column(3).to_numpy(zero_copy_only=False)[owner]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["token", "i"])

    kinds = T.StructType([*placed.schema.fields, T.StructField("least", T.LongType())])
    # sets of equal smallest shingles go together, few of them with others of the component
    some = placed.mapInArrow(smallest, kinds).withColumn("home", F.xxhash64("root", F.pmod("least", F.ceil(F.col("many") / BLOCK))))
    crowd = some.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).alias("subs"))
    some = some.join(crowd, "home").select("sid", "n", "tokens", F.xxhash64("home", F.pmod(F.xxhash64("sid"), F.col("subs"))).alias("i")).checkpoint()
    posted = some.mapInArrow(post, "token long, i long").distinct().checkpoint()
    pairs = posted.join(posted.withColumnRenamed("i", "j"), "token").where("i <= j").select("i", "j").distinct()
    meet = pairs.select(F.xxhash64("i", "j").alias("g"), F.explode(F.array_distinct(F.array("i", "j"))).alias("i"))
    return some.join(meet, "i").withColumn("part", F.lit(True))


def link_forest(sets: DataFrame) -> DataFrame:
    """(a, b, n, part): sets with a link, the smallest that links reach, and their number of links.

    ``part`` if the candidate component has more blocks, which meet only later: then a set has a row for each meeting.
    """
    spark = sets.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cand = components(candidate_edges(sets)).checkpoint()
    # the component's size meets its ids, not its sets: those come by id
    size = cand.groupBy("root").agg(F.count("*").alias("many"))
    placed = sets.join(cand.join(size, "root"), sets["sid"] == cand["id"]).select("sid", "n", "tokens", "root", "many")
    columns = ("g", "sid", "n", "tokens", "part", "i")
    dealt = placed.where(F.col("many") <= BLOCK).select(F.xxhash64("root").alias("g"), "sid", "n", "tokens", F.lit(False).alias("part"), F.lit(0).cast("long").alias("i"))
    if not size.where(F.col("many") > BLOCK).isEmpty():
        dealt = dealt.unionByName(met_blocks(placed.where(F.col("many") > BLOCK)).select(*columns))
    dealt = dealt.select(*columns)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, cut = None, ([], [], [], []), False

        def done() -> Iterator[pa.RecordBatch]:
            if out := join_block(*held):
                yield _batch([(*e, cut) for e in out], LINK)

        for b in batches:
            for g, s, n, raw, part, block in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if g != now:
                    yield from done()
                    held = ([], [], [], [])
                now, cut = g, part
                held[0].append(s)
                held[1].append(n)
                held[2].append(np.frombuffer(raw, SHINGLE_OF))
                held[3].append(block)
        yield from done()

    return dealt.repartition(parts, "g").sortWithinPartitions("g", "sid").mapInArrow(join, LINK)


def shingle_info(docs: DataFrame) -> DataFrame:
    """(key, n_shingles, sid) of every row."""
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("sid", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for lo, hi, buf, off in tx.byte_chunks(batch, "text", CHUNK):
                token, first = shingle_sets(buf, off)
                yield pa.RecordBatch.from_arrays([keys.slice(lo, hi - lo), pa.array(np.diff(first)), pa.array(set_ids(token, first))], schema=to_arrow_schema(schema))

    return docs.mapInArrow(run, schema)


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_shingles, set_id (0: empty set), n_links (other sets that the set links with), component_id (smallest key
    reachable by links) of every row.
    """
    d = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    shared_folder(docs.sparkSession)
    bound_batches(docs.sparkSession)
    info = shingle_info(d).checkpoint()
    sets = repeated_sets(d).groupBy("sid").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens")).checkpoint()
    links = link_forest(sets).checkpoint()
    roots = links.where("not part").select(F.col("a").alias("id"), F.col("b").alias("root"))
    if not links.where("part").isEmpty():
        roots = roots.unionByName(components(links.where("part").select("a", "b")))
    counts = links.groupBy(F.col("a").alias("linked")).agg(F.sum("n").alias("n_links"))
    least = info.where("sid <> 0").groupBy("sid").agg(F.min("key").alias("least"))
    least = least.join(roots, least["sid"] == roots["id"], "left").select("sid", "least", F.coalesce("root", "sid").alias("root"))
    comp = least.groupBy("root").agg(F.min("least").alias("component"))
    by_set = least.join(comp, "root").join(counts, F.col("sid") == F.col("linked"), "left").select("sid", "component", "n_links")
    # empty sets have no class to look up
    out = info.where("sid <> 0").join(by_set, "sid", "left").unionByName(info.where("sid = 0").select("*", F.lit(None).cast("long").alias("component"), F.lit(None).cast("long").alias("n_links")))
    name = lambda c: F.nullif(F.col(c), F.lit(NO_KEY))
    return out.select(name("key").alias(key), "n_shingles", F.col("sid").alias("set_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("sid") == 0, name("key")).otherwise(name("component")).alias("component_id"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: components of all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
