"""The ten operators and the pipeline against brute force on small fixtures, with nulls, empties, ties, repeats, extra columns."""

import base64
import dataclasses
import functools
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("blockwright.llm")

from blockwright.llm import bpe, components, fingerprint, jaccard_join, langid, line_crf, ngram_quality, packing, substring_dedup, suffix_dedup, toxicity
from blockwright.llm import text as tx

WORD = re.compile(r"[^\x20\x09-\x0D]+")
R = random.Random(11)
VOCAB = ["".join(R.choices("abcdefghij", k=R.randint(2, 6))) for _ in range(400)] + ["é", "ß", "日本", "x|y", "don't", "&&&"]
PASSAGE = " ".join(R.choices(VOCAB, k=60))


def prose(n):
    return " ".join(R.choices(VOCAB, k=n))


def near(text, every):
    return " ".join(w if i % every else w + "q" for i, w in enumerate(text.split()))


@pytest.fixture(scope="module")
def fixture():
    """(doc_id, text): repeated rows, copies, near copies, shared passages, odd texts; doc_ids are not in order."""
    long = prose(3000)
    base = [prose(R.randint(20, 200)) for _ in range(30)]
    base += [base[0], base[0], near(base[1], 40), near(base[1], 37), near(near(base[2], 50), 41), near(base[3], 5)]
    base += [prose(20) + " " + PASSAGE + " " + prose(15) for _ in range(6)] + [PASSAGE, long, near(long, 100)]
    base += ["", "   \n\t ", "a", "one two three", "one two three", "ab " * 300, "x" * 5000, "é" * 300 + "日" * 300, "   a b", None, None, "A B C d e f g", "a b c D E F G", "tab\tsep\x0bvt\x0cff\rcr"]
    ids = R.sample(range(1000), len(base))
    rows = list(zip(ids, base, strict=True))
    rows.append(rows[5])  # a repeated row
    return rows


@pytest.fixture(scope="module")
def docs(spark, fixture):
    """With columns whose names clash with those that operators use inside."""
    rows = [(k, t, "x", 1, "y", "z") for k, t in fixture]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, n int, sid string, _row string").repartition(5)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_kernels():
    for texts in ([], [""], ["a"], ["", "a b", "", " c\n"], ["é日 x"]):
        raw = [t.encode() for t in texts]
        buf = np.frombuffer(b"".join(raw), np.uint8)
        off = np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64)
        s, e, first = tx.word_spans(buf, off)
        assert [[buf[a:b].tobytes().decode() for a, b in zip(s[first[i] : first[i + 1]], e[first[i] : first[i + 1]], strict=True)] for i in range(len(texts))] == [WORD.findall(t) for t in texts]
    h = np.array([5, 7, 5, 5, 9], np.uint64)
    one, inverse = tx.distinct(h)
    assert (h[one][inverse] == h).all() and len(one) == 3
    a, b = tx.unpack(tx.pack(np.arange(1000, dtype=np.uint32), np.zeros(0, np.uint8)))
    assert (a == np.arange(1000)).all() and len(b) == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(100, 90), (101, 90), (102, 101), (7, 7), (-5, 200)]
    got = {r["id"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    assert got == {v: find(v) for e in edges for v in e}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1 -----------------------------------------------------------------------------------------------------------------


def shingles(text):
    w = [x for x in (text or "").encode().translate(bytes(range(256)).lower()).split()]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [(k, shingles(t)) for k, t in rows]
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            n = len(a & b)
            if n and 100 * n >= 75 * (len(a) + len(b) - n):
                up[find(i)] = find(j)
    least = defaultdict(lambda: 1 << 60)
    for i, (k, _) in enumerate(sets):
        least[find(i)] = min(least[find(i)], k)
    return sorted((k, len(s), least[find(i)] if s else k) for i, (k, s) in enumerate(sets))


@pytest.mark.parametrize("block", [2, 512])
def test_jaccard_join(spark, docs, fixture, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    got = jaccard_join.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute_components(fixture)


def test_jaccard_join_dense_group(spark):
    base = R.choices(VOCAB, k=80)
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(R.randint(0, 4)):
            w[R.randrange(80)] = R.choice(VOCAB)
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.near_duplicates(df).select("doc_id", "n_shingles", "component_id").collect())) == brute_components(rows)


@pytest.mark.parametrize("block", [5, 512])
def test_jaccard_join_counts_every_link(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rs = random.Random(8)
    base = rs.choices(VOCAB, k=80)
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(rs.randint(0, 3)):
            w[rs.randrange(80)] = rs.choice(VOCAB)
        rows.append((i, " ".join(w)))
    rows += [(100, rows[0][1]), (101, ""), (102, "quite alone")]
    got = {r["doc_id"]: r["n_links"] for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {k: frozenset(shingles(t)) for k, t in rows}
    other = set(sets.values()) - {frozenset()}
    assert got == {k: sum(a != b and 100 * len(a & b) >= 75 * len(a | b) for b in other) for k, a in sets.items()}
    assert sum(got.values()) > 4 * len(rows)  # far more than a tree of links


def test_jaccard_join_large_component(spark, monkeypatch):
    """Many different near copies: blocks meet, every link is counted, and another group that shares a passage stays apart."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 100)
    rs = random.Random(18)
    base, other = rs.choices(VOCAB, k=90), rs.choices(VOCAB, k=30)
    rows = []
    for i in range(700):
        w = list(base)
        for _ in range(rs.randint(0, 3)):
            w[rs.randrange(90)] = rs.choice(VOCAB) + str(rs.randrange(50))
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(base[:25] + other + rs.choices(VOCAB, k=2))) for i in range(20)]
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert {(k, c) for k, (c, _) in got.items()} == {(k, c) for k, _, c in brute_components(rows)}
    sets = {k: frozenset(shingles(t)) for k, t in rows}
    other_sets = set(sets.values())
    links = {a: sum(a != b and 100 * len(a & b) >= 75 * len(a | b) for b in other_sets) for a in other_sets}
    assert {k: n for k, (_, n) in got.items()} == {k: links[a] for k, a in sets.items()}


def test_trie_visits_every_link():
    rs = random.Random(3)
    seqs = [np.array(sorted(rs.sample(range(30), rs.randint(1, 20)))) for _ in range(80)]
    seqs += seqs[:5]
    t = jaccard_join.Trie(seqs, [len(s) for s in seqs])
    found = set()
    for x in range(len(seqs)):
        mask = np.zeros(30, bool)
        mask[t.seqs[x]] = True
        found |= {(x, y) for y in t.visit(x, mask, np.arange(len(seqs)))}
    want = {(x, y) for x in range(len(seqs)) for y in range(x + 1, len(seqs)) if 100 * len(np.intersect1d(t.seqs[x], t.seqs[y])) >= 75 * len(np.union1d(t.seqs[x], t.seqs[y]))}
    assert found == want


def test_jaccard_join_empty(empty):
    assert jaccard_join.near_duplicates(empty).count() == 0


# 2 -----------------------------------------------------------------------------------------------------------------


def brute_signature(raw):
    def mix(x):
        m = (1 << 64) - 1
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & m
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & m
        return x ^ (x >> 31)

    import xxhash

    m, seen, cells = (1 << 64) - 1, Counter(), defaultdict(list)
    mers = [] if not raw else [xxhash.xxh3_64_intdigest(raw, seed=len(raw))] if len(raw) < 8 else [int.from_bytes(raw[i : i + 8], "little") for i in range(len(raw) - 7)]
    for p, w in enumerate(mers):
        h = mix((w * tx.BASE + fingerprint.K) & m)
        v = mix((h + seen[h] * 0xA24BAED4963EE407) & m)
        seen[h] += 1
        cells[v >> 58].append((v & (1 << 58) - 1, p, h))
    out = [0] * fingerprint.SLOTS
    for s, c in cells.items():
        e = 0x5851F42D4C957F2D
        for _, _, h in sorted(sorted(c)[: fingerprint.KEEP], key=lambda z: z[1]):
            e = mix((e * tx.BASE + h) & m)
        out[s] = max(e >> 32, 1)
    return out


def test_fingerprints(spark, docs, fixture):
    for _, t in fixture:
        raw = (t or "").encode()
        assert fingerprint.signature(raw).tolist() == brute_signature(raw)
    got = {(r["doc_id"], r["fingerprint"]) for r in fingerprint.fingerprints(docs).collect()}
    assert got == {(k, fingerprint.signature((t or "").encode()).tobytes().hex()) for k, t in fixture}


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_next_documents(docs, fixture, parts):
    schema = "doc_id long, text string, after string"
    from pyspark.sql.types import _parse_datatype_string

    got = fingerprint.next_documents(docs, lambda k, t, a: [k, t, a], _parse_datatype_string(schema), parts=parts).collect()
    rows = sorted((k, t or "") for k, t in fixture)
    want = [(k, t, rows[(i + 1) % len(rows)][1]) for i, (k, t) in enumerate(rows)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_edited_text_and_likeness():
    cols = fingerprint.edited_pairs([1, 2, 3], ["abcdefgh", "", "xy"], ["QRST", "xy", "abcdefgh"])
    assert cols[2] == [hashlib.sha256(x).hexdigest() for x in (b"abcdefQR", b"", b"xy")]
    assert cols[5][1] == 1.0 and cols[5][2] == 1.0 and 0 <= cols[6][0] <= 1
    t = prose(300)
    a = fingerprint.signatures([t.encode(), near(t, 60).encode(), prose(300).encode(), " ".join(reversed(t.split())).encode()])
    same, other, turned = (fingerprint.likeness(a[:1], a[i : i + 1])[0] for i in (1, 2, 3))
    assert same > 0.5 > 0.1 > other and turned < same


def test_fingerprints_empty(empty):
    assert fingerprint.fingerprints(empty).count() == 0


# 3 -----------------------------------------------------------------------------------------------------------------


def test_forward_backward_is_exact():
    rs = np.random.default_rng(1)
    first = np.array([0, 3, 4, 8])
    unary, trans = rs.normal(size=8), rs.normal(size=(2, 2))
    p, pair, _ = line_crf.forward_backward(unary, first, trans)
    want, expect = np.zeros(8), np.zeros((2, 2))
    for a, b in zip(first, first[1:], strict=False):
        total = 0.0
        for code in range(1 << (b - a)):
            y = [code >> i & 1 for i in range(b - a)]
            w = np.exp(sum(unary[a + i] * s for i, s in enumerate(y)) + sum(trans[u, v] for u, v in zip(y, y[1:], strict=False)))
            total += w
        for code in range(1 << (b - a)):
            y = [code >> i & 1 for i in range(b - a)]
            w = np.exp(sum(unary[a + i] * s for i, s in enumerate(y)) + sum(trans[u, v] for u, v in zip(y, y[1:], strict=False))) / total
            for i, s in enumerate(y):
                want[a + i] += w * s
            for u, v in zip(y, y[1:], strict=False):
                expect[u, v] += w
    assert np.allclose(p, want) and np.allclose(pair, expect)


def test_line_field_gradient_is_that_of_the_likelihood():
    rs = np.random.default_rng(3)
    n = rs.integers(1, 9, 12)
    first = np.r_[0, np.cumsum(n)]
    x, y = rs.normal(size=(first[-1], line_crf.FEATURES)), np.arange(12) % 2
    f = line_crf.LineField()
    f.w, f.trans = rs.normal(size=line_crf.FEATURES) * 0.1, rs.normal(size=(2, 2))
    _, g = f.objective(x, first, y)
    theta = np.r_[f.w, f.trans.ravel()]
    for i in [*range(0, line_crf.FEATURES, 7), *range(line_crf.FEATURES, len(theta))]:
        up, down = theta.copy(), theta.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        ends = []
        for t in (up, down):
            f.w, f.trans = t[: line_crf.FEATURES], t[line_crf.FEATURES :].reshape(2, 2)
            ends.append(f.objective(x, first, y)[0])
        assert (ends[0] - ends[1]) / 2e-5 == pytest.approx(g[i], abs=1e-7)


def test_line_field_learns_from_whole_texts(spark):
    """The bad lines of a document come after its first 300 lines; repeated rows of a key count once."""
    good = "\n".join(["a plain line of some words"] * 300)
    rows = [(i, good + ("\n||| 99 ### !!!" * 300 if i % 2 else "")) for i in range(40)] + [(1, good + "\n||| 99 ### !!!" * 300)] * 20
    d = spark.createDataFrame(rows, "doc_id long, text string")
    f = line_crf.train(d, d.selectExpr("doc_id", "cast(1 - doc_id % 2 as int) as quality").distinct())
    tail = line_crf.classify(spark.createDataFrame([(1, "||| 99 ### !!!\n" * 9), (2, "a plain line of some words\n" * 9)], "doc_id long, text string"), f).collect()
    assert {r["doc_id"]: r["score"] for r in tail}[1] < 0.2 < 0.5 < {r["doc_id"]: r["score"] for r in tail}[2]


def test_line_features_do_not_depend_on_neighbours():
    texts = ["a b\nA!! B!!\n\nx", "", "tail\n", "a b\nA!! B!!\n\nx"]
    raw = [t.encode() for t in texts]
    buf, off = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64)
    x, size, first = line_crf.line_features(buf, off)
    assert np.diff(first).tolist() == [t.count("\n") + 1 for t in texts]
    assert size.tolist() == [len(x) for t in texts for x in t.split("\n")]
    for i in range(len(texts)):
        own = line_crf.line_features(np.frombuffer(raw[i], np.uint8), np.array([0, len(raw[i])]))[0]
        assert np.allclose(own, x[first[i] : first[i + 1]])


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = line_crf.op3(spark, sf).toPandas()
    y = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    m = got.merge(y, on="doc_id")
    assert len(got) == 1000 and got.score.between(0, 1).all() and ((got.score >= 0.7).astype(int) == got.predicted).all()
    assert (got.held_out == [zlib.crc32(str(k).encode()) % 4 == 2 for k in got.doc_id]).all()
    h = m[m.held_out]
    assert (h.predicted == h.quality).mean() > 0.95


def test_quality_odd_texts(docs, fixture, empty):
    labels = docs.select("doc_id", F.lit(None).cast("int").alias("quality"))
    field = line_crf.train(docs, labels)
    out = line_crf.classify(docs, field).collect()
    assert len(out) == len(fixture) and all(0 <= r["score"] <= 1 for r in out)
    field = line_crf.train(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")))
    assert line_crf.classify(docs, field).count() == len(fixture) and line_crf.classify(empty, field).count() == 0
    assert line_crf.keep(docs, field, 0.0).count() == len(fixture)


# 4 -----------------------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op4(spark, sf).toPandas()
    m = got.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    h = m[m.held_out]
    assert len(got) == 10_000 and got.score.between(0, 1).all() and ((got.score >= 0.5).astype(int) == got.predicted).all()
    assert (got.held_out == [zlib.crc32(str(k).encode()) % 5 == 0 for k in got.doc_id]).all()
    assert h[h.toxic == 1].predicted.mean() > 0.85 and h[h.toxic == 0].predicted.mean() < 0.01


def brute_kneser_ney(train, texts):
    """The model by dictionaries. train: (text, toxic)."""

    def chain(t):
        w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
        return list(zip(["<s>", *w], [*w, "</s>"], strict=True))

    c = [Counter(), Counter()]
    for t, bad in train:
        c[0 if bad else 1].update(set(chain(t)))
    both = c[0] + c[1]
    words = [Counter(), Counter()]
    for q in (0, 1):
        for (_, w), n in c[q].items():
            words[q][w] += n
    all_words = words[0] + words[1]
    contexts = Counter(w for _, w in both)
    size = [sum(x.values()) for x in words]
    share = [x / sum(size) for x in size]

    def ney(x):
        once, twice = sum(n == 1 for n in x.values()), sum(n == 2 for n in x.values())
        return once / (once + 2 * twice) if once else 0.5

    d0, d1, d2 = ney(contexts), ney(all_words), ney(both)
    kinds = len(all_words)
    s0 = lambda w: (max(contexts[w] - d0, 0) + d0 * kinds / (kinds + 1)) / len(both)
    s1 = lambda w: (max(all_words[w] - d1, 0) + d1 * kinds * s0(w)) / sum(size)
    lift = min(toxicity.LIFT, (1 + 1 / min(share)) / 2)
    keep = lambda q, own, every: toxicity.KEEP * max(own - toxicity.DISCOUNT - lift * every * share[q], 0)
    free = [1 - sum(keep(q, words[q][w], all_words[w]) for w in all_words) / size[q] for q in (0, 1)]
    r = lambda q, w: keep(q, words[q][w], all_words[w]) / size[q] / s1(w) + free[q] if w in all_words else free[q]
    after = defaultdict(list)
    for v, w in both:
        after[v].append(w)

    def s2(v, w):
        n = sum(both[v, x] for x in after[v])
        return (max(both[v, w] - d2, 0) + d2 * len(after[v]) * s1(w)) / n

    @functools.cache
    def log_p(q, v, w):
        if v not in after:
            return math.log(r(q, w))
        n = sum(both[v, x] for x in after[v])
        z = sum((both[v, x] - d2) / n * r(q, x) for x in after[v]) + d2 * len(after[v]) / n
        own = sum(c[q][v, x] for x in after[v])
        kept = sum(keep(q, c[q][v, x], both[v, x]) for x in after[v])
        back = (own - kept) / own if own else 1.0
        if w not in all_words:  # the shared probability of an unknown word is the same in both classes
            return math.log(back * r(q, w) / z)
        return math.log((keep(q, c[q][v, w], both[v, w]) / own if own else 0.0) + back * s2(v, w) * r(q, w) / z)

    # the class distributions sum to one over the words and the unknown one
    unknown = d1 * kinds * (d0 * kinds / (kinds + 1) / len(both)) / sum(size)
    for q in (0, 1):
        assert abs(sum(r(q, w) * s1(w) for w in all_words) + free[q] * unknown - 1) < 1e-9
        for v in list(after)[:5]:
            assert abs(sum(math.exp(log_p(q, v, w)) for w in all_words) + math.exp(log_p(q, v, "?")) * s2(v, "?") - 1) < 1e-9 or both[v, "?"]
    return [sum(log_p(0, v, w) - log_p(1, v, w) for v, w in chain(t)) / len(chain(t)) for t in texts]


@pytest.mark.parametrize("head", [3, 1 << 18])
def test_toxicity_is_kneser_ney(spark, monkeypatch, head):
    monkeypatch.setattr(toxicity, "HEAD", head)
    rs = random.Random(4)
    names = ["oak", "elm", "fir", "ash", "bay", "yew", "box", "may", "tea", "fig"]
    rows = [(i, " ".join(rs.choices(names, range(10, 0, -1), k=rs.randint(1, 12)))) for i in range(160)]
    rows = [(i, t + " vile scum " * rs.randint(1, 3) + t if i % 4 == 0 and i < 90 else f"{t} grim" if i in (4, 100) else t) for i, t in rows]
    more = [(200, "oak grim vile elm"), (201, "scum"), (202, "never seen"), (203, None), (204, "  "), (205, "vile scum " * 400_000), (206, "x1 vile x2")]
    d = spark.createDataFrame(rows + more, "doc_id long, text string").repartition(3)
    y = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows] + [(None, 1), (3, None), (3, 0), (999, 1)], "doc_id long, toxic int")
    m = toxicity.fit_counts(d, y, "text", "doc_id", "toxic")
    got = {r["doc_id"]: r["raw"] for r in toxicity.raw_scores(d, m, "text", "doc_id").collect()}
    want = brute_kneser_ney([(t, i % 4 == 0) for i, t in rows], [t for _, t in rows + more])
    assert len(got) == len(rows) + len(more)
    for (i, _), x in zip(rows + more, want, strict=True):
        assert got[i] == pytest.approx(x, abs=1e-6)


def test_toxicity_of_single_documents(spark, monkeypatch):
    """A chunk may hold one document, and all that it asks for may be far away."""
    monkeypatch.setattr(toxicity, "HEAD", 0)
    rows = [(i, "vile scum here" if i % 3 == 0 else "kind words there") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    m = toxicity.fit_counts(d, d.selectExpr("doc_id", "cast(doc_id % 3 = 0 as int) as toxic"), "text", "doc_id", "toxic")
    want = brute_kneser_ney([(t, i % 3 == 0) for i, t in rows], ["vile words", "kind scum here"])
    for text, x in zip(("vile words", "kind scum here"), want, strict=True):
        got = toxicity.raw_scores(spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1), m, "text", "doc_id").collect()
        assert len(got) == 1 and got[0]["raw"] == pytest.approx(x, abs=1e-6)


def test_toxicity_curve_never_falls():
    x, y = toxicity.rising(np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 3, 1, 9, 9]), np.array([10.0, 10, 10, 10, 10]))
    assert len(x) == 3 and (np.diff(x) > 0).all() and (np.diff(y) >= 0).all() and y[0] < 0.05 and y[-1] > 0.8


def test_toxicity_odd_texts(docs, fixture, empty):
    none = toxicity.train(docs, docs.select("doc_id", F.lit(None).cast("int").alias("toxic")))
    out = toxicity.toxicity(docs, none).collect()
    assert len(out) == len(fixture) and all(r["score"] < 0.5 for r in out)
    assert toxicity.toxicity(empty, toxicity.train(empty, empty.select("doc_id", F.lit(1).alias("toxic")))).count() == 0


# 5 and 10 ------------------------------------------------------------------------------------------------------------


def brute_bytes(rows, n):
    raw = [(k, (t or "").encode()) for k, t in rows]
    seen = Counter(r[i : i + n] for _, r in raw for i in range(len(r) - n + 1))
    out = []
    for k, r in raw:
        g = bytearray(len(r))
        for i in range(len(r) - n + 1):
            if seen[r[i : i + n]] > 1:
                g[i : i + n] = b"\1" * n
        out.append((k, len(r), sum(g), len(re.findall(b"\1+", bytes(g))), bytes(a for a, b in zip(r, g, strict=True) if not b)))
    return sorted(out)


def brute_words(rows, n):
    ws = [(k, WORD.findall(t or "")) for k, t in rows]
    least = {}
    for k, w in ws:
        for i in range(len(w) - n + 1):
            least[tuple(w[i : i + n])] = min(k, least.get(tuple(w[i : i + n]), k))
    out = []
    for k, w in ws:
        g = bytearray(len(w))
        for i in range(len(w) - n + 1):
            if least[tuple(w[i : i + n])] < k:
                g[i : i + n] = b"\1" * n
        out.append((k, len(w), sum(g), " ".join(x for x, b in zip(w, g, strict=True) if not b)))
    return sorted(out)


@pytest.mark.parametrize(("crowd", "chunk"), [(1, 1 << 21), (1, 700), (256, 1 << 21), (256, 3000)])
def test_byte_dedup(docs, fixture, crowd, chunk):
    """Texts longer than a chunk, and windows of crowded grams."""
    got = suffix_dedup.dedup(docs, search=dataclasses.replace(suffix_dedup.SEARCH, crowd=crowd, chunk=chunk, batch=4000)).collect()
    assert sorted((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), bytes(r["kept"])) for r in got) == brute_bytes(fixture, 400)


@pytest.mark.parametrize(("crowd", "chunk"), [(1, 1 << 21), (1, 700), (256, 1 << 21), (256, 3000)])
def test_word_dedup(docs, fixture, crowd, chunk):
    """Texts longer than a chunk, and windows of crowded grams."""
    search = dataclasses.replace(substring_dedup.SEARCH, crowd=crowd, chunk=chunk, batch=500)
    assert sorted(map(tuple, substring_dedup.dedup(docs, search=search).collect())) == brute_words(fixture, 13)


def test_a_passage_in_many_contexts(spark):
    """Whatever the number of contexts, a group holds few parts; the results are those of brute force."""
    rs = random.Random(21)
    rows = [(i, " ".join(rs.choices(VOCAB, k=rs.randint(5, 60))) + " " + PASSAGE * 2 + " " + " ".join(rs.choices(VOCAB, k=rs.randint(5, 60)))) for i in range(700)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sorted(map(tuple, substring_dedup.dedup(d, search=dataclasses.replace(substring_dedup.SEARCH, crowd=50)).collect())) == brute_words(rows, 13)
    got = suffix_dedup.dedup(d, search=dataclasses.replace(suffix_dedup.SEARCH, crowd=50)).collect()
    assert sorted((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), bytes(r["kept"])) for r in got) == brute_bytes(rows, 400)


def test_common_prefixes():
    r = np.random.default_rng(5)
    t = np.concatenate([r.integers(0, 2, 300), np.tile(r.integers(0, 256, 90), 12)])
    a, b = r.integers(0, len(t), 500), r.integers(0, len(t), 500)
    got = suffix_dedup.common_prefixes(tx.prefix_hash(t.astype(np.uint16)), a, b, 400)
    for i, j, n in zip(a.tolist(), b.tolist(), got.tolist(), strict=True):
        want = 0
        while want < 400 and max(i, j) + want < len(t) and t[i + want] == t[j + want]:
            want += 1
        assert n == want
    text = np.append(t + 1, 0).astype(np.uint16)
    order = suffix_dedup.sort_directly(text, np.arange(len(text)), 400)
    keys = [text[i : i + 406].tolist() for i in order.tolist()]
    assert all(x[:400] <= y[:400] for x, y in zip(keys, keys[1:], strict=False))


def test_dedup_null_keys_and_empty(spark, empty):
    t = prose(100)
    d = spark.createDataFrame([(None, t), (3, t), (None, None), (4, "x " + t)], "doc_id long, text string")
    got = sorted(((r["doc_id"] is None, r["n_removed"]) for r in substring_dedup.dedup(d).collect()))
    assert got == [(False, 100), (False, 100), (True, 0), (True, 0)]
    assert suffix_dedup.dedup(d).where("doc_id is null").count() == 2
    assert substring_dedup.dedup(empty).count() == 0 and suffix_dedup.dedup(empty).count() == 0


def test_rewrite_keeps_columns(docs, fixture):
    d = docs.withColumn("n_chars", F.length("text").cast("long"))
    got = substring_dedup.rewrite(d)
    assert got.columns == d.columns
    want = {(k, t if not r or t is None else kept) for (k, _, r, kept), (_, t) in zip(brute_words(fixture, 13), sorted(fixture, key=lambda x: (x[0], len(x[1] or ""))), strict=True)}
    assert {(r["doc_id"], r["text"]) for r in got.collect()} == want


def test_two_stage_suffix_array():
    rs = random.Random(2)
    for n, letters in ((1, 1), (50, 2), (300, 3), (400, 1), (500, 200)):
        t = np.array([rs.randint(1, letters) for _ in range(n)] + [0], np.uint16)
        order = suffix_dedup.suffix_array(t, n + 1)
        assert sorted(order.tolist()) == list(range(n + 1))
        assert order.tolist() == sorted(range(n + 1), key=lambda i: t[i:].tolist())


def test_subtrees_and_maximal_repeats():
    rs = np.random.default_rng(4)
    ids = rs.integers(0, 3, 400).astype(np.int32)
    starts = np.arange(400 - 6)
    seen = np.zeros(len(starts), int)
    for limit in (5, 50, 1000):
        seen[:] = 0
        for g in substring_dedup.prefix_groups(ids, starts, 6, limit):
            seen[g] += 1
            order, same = substring_dedup.subtree(ids, starts[g], 6)
            rows = [ids[s : s + 6].tolist() for s in starts[g][order]]
            assert rows == sorted(rows)
            assert all(x == next((k for k in range(6) if a[k] != b[k]), 6) for x, a, b in zip(same[1:], rows, rows[1:], strict=False))
        assert (seen == 1).all()
    assert (4, [0, 5]) in substring_dedup.maximal_repeats(np.array([1, 2, 3, 4, 9, 1, 2, 3, 4, 8]), 3)


# 6 -----------------------------------------------------------------------------------------------------------------

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_unit_tokenizer_is_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    letters = "ab'’éÉ!=≮̸ \n\t5३½日́ s tre_-\x1cİΣ"
    texts = ["", "don't it's 'tis O'Dell're", "x≠y é̸ ≠", "<|endoftext|>", "!!é?? 5́ '́", "\x00\x01abc\x7f"]
    texts += ["".join(R.choices(letters, k=R.randint(0, 40))) for _ in range(1500)]
    ids, off = packing.tokenizer(public_tokenizers.path("word_bpe_49k.json")).encode(texts)
    for i, x in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_packing(docs, fixture, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path, capacity=256).toPandas()
    own = defaultdict(list)
    for k, x in fixture:
        own[k].append([*t.encode(x or "", add_special_tokens=False).ids, 2])
    for k, g in got.groupby("doc_id"):
        want = own[k]
        assert g.length.sum() == sum(map(len, want)) and set(g.doc_tokens) == {len(w) for w in want}
        for r in g.itertuples():
            part = next(w for w in want if len(w) == r.doc_tokens)[r.start : r.start + r.length]
            assert list(r.ids) == part and r.ids_crc32 == zlib.crc32(np.array(part, np.uint32).tobytes())
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        total = int(g.length.sum())
        assert (g.offset.values == np.r_[0, np.cumsum(g.length.values)[:-1]]).all() and total <= 256 and total & (total - 1) == 0
    assert packing.pack_documents(empty, path).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(docs, path, capacity=100)


@pytest.mark.parametrize("capacity", [1, 2, 64, 4096])
def test_bins_of_reciprocal_classes(capacity):
    rs = random.Random(capacity)
    lengths = [rs.choice([1, rs.randint(1, 20), rs.randint(1, 3 * capacity), capacity, capacity // 3 + 1]) for _ in range(400)]
    b = packing.Bins(7, capacity)
    for i, n in enumerate(lengths):
        b.add(i, np.arange(n, dtype=np.uint32) + i * 100_000)
        assert len(b.open) <= 2 * capacity**0.5 and all(len(v) < k and sum(len(p[2]) for p in v) < capacity for k, v in b.open.items())
    for pieces, have in b.waiting:
        assert have == sum(len(p[2]) for p in pieces) < capacity
    before = len(b.full)
    b.close()
    assert not b.open and not b.waiting
    own, by = defaultdict(list), defaultdict(list)
    for k, start, part, n, seq, place in b.full:
        assert n == lengths[k] and (part == np.arange(start, start + len(part)) + k * 100_000).all()
        own[k].append((start, len(part)))
        by[seq].append((place, len(part)))
    for k, n in enumerate(lengths):
        assert [s for s, _ in sorted(own[k])] == [0, *np.cumsum([x for _, x in sorted(own[k])])[:-1]] and sum(x for _, x in own[k]) == n
    sizes = []
    for pieces in by.values():
        assert [s for s, _ in sorted(pieces)] == [0, *np.cumsum([x for _, x in sorted(pieces)])[:-1]]
        sizes.append(sum(x for _, x in pieces))
    assert all(x <= capacity and x & (x - 1) == 0 for x in sizes) and sum(x < capacity for x in sizes) <= capacity.bit_length()
    assert len(b.full) <= len(lengths) + len(by) and min(by) == 7 and before <= len(b.full)


# 7 -----------------------------------------------------------------------------------------------------------------


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = langid.op7(spark, sf).toPandas()
    m = got.merge(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert (m[m.held_out].lang_pred == m[m.held_out].lang).mean() > 0.97


def test_language_odd_texts(docs, fixture, empty):
    d = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").when(F.col("doc_id") % 3 == 0, "bb"))
    net = langid.train(d)
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.identify(docs, net).collect()}
    import regex

    for k, t in fixture:
        found = {p for q, p in got if q == k}
        assert found <= {"aa", "bb"} if regex.search(r"\p{L}", t or "") else found == {"und"}
    assert langid.train(d.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r["lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}
    assert langid.identify(empty, net).count() == 0


def test_pooling_is_a_convolution():
    net = langid.ByteNet(["a", "b"], seed=3)
    x = np.random.default_rng(0).integers(0, 256, (4, langid.WINDOW)).astype(np.uint8)
    h, _ = net.pool(x)
    one = np.zeros((langid.WINDOW, 256))
    for r in range(4):
        one[:] = 0
        one[np.arange(langid.WINDOW), x[r]] = 1
        want = [max(sum(one[i + j] @ table[j][:, f] for j in range(w)) + bias[f] for i in range(langid.WINDOW - w + 1)) for table, bias, w in zip(net.tables, net.bias, langid.WIDTHS, strict=True) for f in range(langid.FILTERS)]
        assert np.allclose(h[r], want, atol=1e-4)


# 8 -----------------------------------------------------------------------------------------------------------------


def test_bpe_is_the_library(spark, docs, fixture, empty):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = sorted((r["doc_id"], list(r["ids"]), bytes(r["decoded"])) for r in bpe.encode_decode(docs, path).collect())
    assert got == sorted((k, enc.encode_ordinary(t or ""), (t or "").encode()) for k, t in fixture)
    letters = "ab'srevlmdt’éÉ! \n\t  5३日\x1c\x85 　."
    texts = ["".join(R.choices(letters, k=R.randint(0, 40))) for _ in range(1500)] + ["'s", "''s", " 's", "it's'll", "  a", "a  "]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, body string")
    for r in bpe.encode_decode(df, path, "body", "k").collect():
        assert list(r["ids"]) == enc.encode_ordinary(texts[r["k"]])
    assert bpe.encode_decode(empty, path).count() == 0


# 9 -----------------------------------------------------------------------------------------------------------------


def brute_base(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = set()
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), failed


def test_quality_rules_base(spark, docs, fixture, empty):
    trusted = docs.select("doc_id").where("doc_id % 2 = 0")
    got = sorted(tuple(r)[:7] for r in ngram_quality.quality_rules(docs, trusted).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    assert got == sorted((k, *brute_base(t)) for k, t in fixture)
    assert ngram_quality.quality_rules(empty, trusted).count() == 0
    alone = ngram_quality.quality_rules(docs, trusted.limit(0)).collect()
    assert all(r["score"] == 0 and r["kept"] == (not r["base_failed"]) for r in alone)
    kept = ngram_quality.keep(docs, trusted)
    assert kept.columns == docs.columns


def test_quality_rules_score(spark):
    rows = [(i, prose(60) if i % 2 else " ".join(R.choices(["@@", "##1", "zz%"], k=60))) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    good = d.where("doc_id % 2 = 1").select("doc_id")
    ratios = {r["bucket"]: r["llr"] for r in ngram_quality.ratio_table(d, good).collect()}
    got = {r["doc_id"]: r["score"] for r in ngram_quality.quality_rules(d, good).collect()}
    pairs = spark.createDataFrame([(i, j, w, n) for i, t in rows for j, (w, n) in enumerate(zip(t.split(), [*t.split()[1:], None], strict=True))], "i long, j int, w string, n string")
    h = pairs.select("i", F.pmod(F.xxhash64("w"), F.lit(ngram_quality.BUCKETS)).alias("u"), F.when(F.col("n").isNotNull(), F.pmod(F.xxhash64("w", "n"), F.lit(ngram_quality.BUCKETS)) + ngram_quality.BUCKETS).alias("b")).collect()
    raw, target = Counter(), Counter()
    for r in h:
        for x in (r["u"], r["b"]):
            if x is not None:
                raw[x] += 1
                target[x] += r["i"] % 2
    tot = {half: (sum(n for x, n in raw.items() if (x >= ngram_quality.BUCKETS) == half), sum(n for x, n in target.items() if (x >= ngram_quality.BUCKETS) == half)) for half in (False, True)}
    for x, n in raw.items():
        r, t = tot[x >= ngram_quality.BUCKETS]
        assert abs(ratios[x] - np.log((target[x] + ngram_quality.PSEUDO) / (n * t / r + ngram_quality.PSEUDO))) < 1e-9
    for i, t in rows:
        mine = [ratios[x] for r in h if r["i"] == i for x in (r["u"], r["b"]) if x is not None]
        assert abs(got[i] - sum(mine) / (2 * len(t.split()) - 1)) < 1e-6
    assert min(v for k, v in got.items() if k % 2) > max(v for k, v in got.items() if not k % 2)


# pipeline ------------------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline as c

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in c.STAGES] == ["quality_classifier", "quality_rules", "near_duplicates", "substring_dedup", "packing"]
    now, before = docs, None
    for name, stage in c.STAGES:
        before = {r["doc_id"]: r for r in now.collect()}
        out = stage(spark, now, sf)
        got = out.collect()
        if name != "packing":
            assert out.columns == docs.columns and {r["doc_id"] for r in got} <= set(before)
        rows = [(k, r["text"]) for k, r in before.items()]
        if name == "near_duplicates":
            comp = {k: x for k, _, x in brute_components(rows)}
            assert sorted(r["doc_id"] for r in got) == sorted(k for k, x in comp.items() if k == x)
        elif name == "substring_dedup":
            kept = {k: (n, t) for k, _, n, t in brute_words(rows, 13)}
            assert all(r["text"] == (kept[r["doc_id"]][1] if kept[r["doc_id"]][0] else before[r["doc_id"]]["text"]) and r["n_chars"] == len(r["text"]) for r in got)
        elif name == "packing":
            assert {r["doc_id"] for r in got} == set(before)
        else:
            assert len(got) < len(before) and all(r == before[r["doc_id"]] for r in got)
        now = spark.createDataFrame(got, out.schema)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    first = c.quality_classifier(spark, docs, sf)
    assert first.join(labels.where("quality = 0"), "doc_id").count() == 0

    def tokens(pieces):  # where documents are cut depends on their partition
        own = defaultdict(list)
        for r in sorted(pieces, key=lambda r: (r["doc_id"], r["start"])):
            own[r["doc_id"]] += r["ids"]
        return own

    assert tokens(c.run(spark, sf).collect()) == tokens(got)


def test_pipeline_returns_tokens(spark, docs):
    import corpus_pipeline as c

    got = c.pack(spark, docs, "").collect()
    assert got and all(len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], np.uint32).tobytes()) == r["ids_crc32"] for r in got)


def test_pipeline_odd_rows(spark, tmp_path):
    import corpus_pipeline as c

    rows = [(1, None, None, None, None), (None, prose(80), "en", "s", 9), (None, None, None, None, None), (2, "", "en", "s", 0), (3, prose(80), None, None, None)]
    rows += [(i, prose(100), "en", "s", 1) for i in range(10, 20)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(10, 1, 0), (11, 1, 0), (2, 0, 0), (None, 1, None), (12, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows_in in (d, d.limit(0)):
        now = rows_in
        for name, stage in c.STAGES:
            now = stage(spark, now.select(*c.COLUMNS, F.lit("clash").alias("key")) if name != "quality_classifier" else now, str(tmp_path))
        now.collect()


def test_texts_longer_than_a_chunk(spark):
    """One text of several megabytes beside small ones, against the libraries and the plain definitions."""
    from tokenizers import Tokenizer

    rs = random.Random(31)
    long = " ".join(rs.choices(VOCAB, k=1_100_000)) + "."
    rows = [(1, long), (2, long + " and then some more"), (3, "a short text of a few words"), (4, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert len(long.encode()) > 4 << 20
    assert sorted(map(tuple, jaccard_join.near_duplicates(d).select("doc_id", "n_shingles", "component_id").collect())) == brute_components(rows)
    prints = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(d).collect()}
    assert all(prints[k] == fingerprint.signature((t or "").encode()).tobytes().hex() for k, t in rows)
    field = line_crf.LineField()
    field.w = np.linspace(-0.1, 0.1, line_crf.FEATURES)
    for r in line_crf.classify(d, field).collect():
        raw = (dict(rows)[r["doc_id"]] or "").encode()
        assert r["score"] == pytest.approx(field.quality(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0])
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    pieces = defaultdict(list)
    for r in packing.pack_documents(d, path).orderBy("doc_id", "start").collect():
        pieces[r["doc_id"]] += r["ids"]
    assert all(pieces[k] == [*whole.encode(t or "", add_special_tokens=False).ids, 2] for k, t in rows)
    decoded = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.encode_decode(d, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()}
    assert all(decoded[k] == (t or "").encode() for k, t in rows)
    rules = {r["doc_id"]: r for r in ngram_quality.quality_rules(d, d.select("doc_id")).collect()}
    assert rules[1]["n_words"] == 1_100_000 and rules[4]["n_words"] == 0 and rules[1]["word_chars"] == len(long.replace(" ", ""))
