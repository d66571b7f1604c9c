"""Codecs as Arrow operators over blocks, and queries that prove round trips.

A kernel sees one bounded block at a time; a payload that does not decode gives a null and a reason, never an exception.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwright.functions import CorruptData, astc, bc7, containers, dictionary, entropy, entropy3, frame, hdr, huffman, lz, parse, texture, turbo, video, x86
from blockwright.session import spread, table

BLOCK = 16 << 10


def map_bytes(df: DataFrame, key: str, text: str, fn: Callable[[bytes], tuple], fields: str, keep_null: bool = False) -> DataFrame:
    """(key, what ``fn`` gives for the bytes); corrupt input gives nulls and the reason in ``error``. A null counts as empty, or, with
    ``keep_null``, gives nulls."""
    names = [f.split()[0] for f in fields.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, errors = [], []
            for raw in b.column(1).cast(pa.binary()).to_pylist():
                try:
                    rows.append((None,) * len(names) if raw is None and keep_null else fn(raw or b""))
                    errors.append(None)
                except CorruptData as e:
                    rows.append((None,) * len(names))
                    errors.append(str(e))
            cols = [pa.array(c) for c in zip(*rows, strict=True)] if rows else [pa.array([]) for _ in names]
            types = [f.type for f in arrow][1:-1]
            yield pa.RecordBatch.from_arrays([b.column(0), *[c.cast(t) for c, t in zip(cols, types, strict=True)], pa.array(errors, pa.string())], schema=arrow)

    kind = df.schema[key].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = f"{key} {kind}, {fields}, error string"
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return df.select(key, text).mapInArrow(run, schema)


def _round_trip(spark: SparkSession, sf_dir: str, encode: Callable[[bytes], bytes], decode: Callable[[bytes, int], bytes]) -> DataFrame:
    def both(raw: bytes) -> tuple:
        out = []
        for i in range(0, len(raw), BLOCK):
            part = raw[i : i + BLOCK]
            out.append(decode(encode(part), len(part)))
        back = b"".join(out)
        return len(back), hashlib.md5(back).hexdigest()

    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return map_bytes(docs, "doc_id", "text", both, "n long, digest string", keep_null=True).select("doc_id", "n", "digest")


def roundtrip_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document coded in plain blocks and back."""
    return _round_trip(spark, sf_dir, lz.encode, lz.decode)


def roundtrip_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document coded in entropy blocks and back."""
    return _round_trip(spark, sf_dir, entropy.encode, entropy.decode)


def roundtrip_entropy3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document coded in entropy blocks of version 3 and back, with repeat indices in the tokens of every second block."""
    return _round_trip(spark, sf_dir, lambda b: entropy3.encode(b, commands=len(b) % 2 == 1), entropy3.decode)


def roundtrip_lazy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document coded in plain blocks of the lazy parse and back."""
    return _round_trip(spark, sf_dir, lambda b: lz.write(b, parse.lazy(b)), lz.decode)


def parse_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every message and of its plain blocks by each parse, and of its entropy blocks; the parses must decode."""

    def sizes(raw: bytes) -> tuple:
        ways = [lz.write(raw, p) for p in (lz.sequences(raw), parse.skipping(raw), parse.lazy(raw), parse.cheapest(raw))]
        if any(lz.decode(w, len(raw)) != raw for w in ways):
            raise CorruptData("a parse does not decode")
        return len(raw), *map(len, ways), len(entropy.encode(raw)), len(entropy3.encode(raw, parse.repriced(raw))), len(entropy3.encode(raw, parse.arrivals(raw), commands=True))

    rows = spread(table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("key"), "text"))
    out = map_bytes(rows, "key", "text", sizes, "raw long, greedy long, skipping long, lazy long, cheapest long, entropy2 long, entropy3 long, arrivals long")
    return out.select("key.conv_id", "key.turn", "raw", "greedy", "skipping", "lazy", "cheapest", "entropy2", "entropy3", "arrivals", "error")


def match_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, pos, len, off): for each position of a message its earlier places, each with a longer common prefix than the nearer ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, t, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), pc.fill_null(b.column(2), "").cast(pa.binary()).to_pylist(), strict=True):
                before = parse.earlier(raw)
                found = [(c, t, p, n, off) for p in range(len(before)) for n, off in parse.longer_matches(raw, before, p, MATCH_DEPTH, len(raw))]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["conv_id", "turn", "pos", "len", "off"])

    return spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")).mapInArrow(run, "conv_id bigint, turn bigint, pos bigint, len bigint, off bigint")


#: Candidates of a position: the nearest places with the same four bytes.
MATCH_DEPTH = 128
MATCH_TABLE = f"""WITH r AS (SELECT conv_id, turn, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM conversations),
k AS (SELECT conv_id, turn, pos, substr(h, CAST(2 * pos + 1 AS BIGINT), 8) AS key, substr(h, CAST(2 * pos + 1 AS BIGINT)) AS rest FROM (SELECT *, unnest(range(0, n - 3)) AS pos FROM r)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, key ORDER BY pos) AS i FROM k),
p AS (SELECT a.conv_id, a.turn, a.pos, a.pos - b.pos AS off,
  len(list_filter(range(1, CAST(length(a.rest) // 2 + 1 AS BIGINT)), lambda j: substr(a.rest, 1, CAST(2 * j AS BIGINT)) = substr(b.rest, 1, CAST(2 * j AS BIGINT)))) AS len
  FROM o a JOIN o b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.key = b.key AND b.i < a.i AND b.i >= a.i - {MATCH_DEPTH}),
m AS (SELECT *, max(len) OVER (PARTITION BY conv_id, turn, pos ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM p)
SELECT conv_id, turn, pos, len, off FROM m WHERE best IS NULL OR len > best"""


def roundtrip_turbo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document coded in turbo blocks and back."""
    return _round_trip(spark, sf_dir, turbo.encode, turbo.decode)


def roundtrip_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document coded in single Huffman streams and back."""
    return _round_trip(spark, sf_dir, huffman.encode, huffman.decode)


def x86_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through the machine code filter and back."""
    return _round_trip(spark, sf_dir, lambda b: x86.apply(b, True)[0], lambda b, _: x86.apply(b, False)[0])


def split_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through the field planes of every texture format and back."""

    def back(b: bytes, _: int) -> bytes:
        for k in reversed(texture.FIELDS):
            b = texture.merge(b, k)
        return b

    def forth(b: bytes) -> bytes:
        for k in texture.FIELDS:
            b = texture.split(b, k)
        return b

    return _round_trip(spark, sf_dir, forth, back)


#: Bytes of passages that a dictionary is trained on: those with the smallest hashes of their key, over the whole table.
TRAINING = 4 << 20


def trained_dictionary(samples: DataFrame, text: str, key: str, size: int = 4096, most: int = TRAINING) -> bytes:
    """A dictionary of a sample of at most ``most`` bytes, drawn by hash from all rows."""
    total = samples.agg(F.sum(F.octet_length(text) + 1)).first()[0] or 0
    share = min(1.0, 0.9 * most / total) if total > most else 1.0
    drawn = samples.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))) if share < 1 else samples
    rows = sorted((r[0], r[1] or "") for r in drawn.select(key, text).collect())  # at most about ``most`` bytes
    return dictionary.train("\n".join(t for _, t in rows).encode()[:most], size)


def roundtrip_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document coded against a dictionary trained on the benchmark passages (a small, fixed table) and back."""
    d = trained_dictionary(table(spark, sf_dir, "benchmark"), "text", "item_id")
    return _round_trip(spark, sf_dir, lambda b: lz.encode(b, d), lambda b, n: lz.decode(b, n, d))


SOURCE_DIGEST = "SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n, md5(text) AS digest FROM documents"


def frame_blocks(df: DataFrame, key: str, text: str, block: int = BLOCK, methods: tuple[int, ...] = ()) -> DataFrame:
    """(key, block_no, method, raw_len, payload): payloads cut into blocks that are coded as tasks of their own; an empty one is one empty
    block, a null one a block without payload."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, i // block, raw and raw[i : i + block]) for k, raw in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True) for i in range(0, max(len(raw or b""), 1), block)]
            if rows:
                k, n, p = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(k, b.column(0).type), pa.array(n, pa.int64()), pa.array(p, pa.binary())], ["key", "block_no", "raw"])

    version = 2 if methods else 1

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(2).to_pylist()
            out = [None if r is None else frame.encode_block(r, methods, version) for r in raw]
            method = [None if r is None else (o[0] & ~frame.FILTERED) if version == 2 else (frame.STORED if len(o) == len(r) else frame.PLAIN) for o, r in zip(out, raw, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(method, pa.int32()), pa.array([None if r is None else len(r) for r in raw], pa.int64()), pa.array(out, pa.binary())], ["key", "block_no", "method", "raw_len", "payload"])

    kind = df.schema[key].dataType.simpleString()
    blocks = df.select(key, text).mapInArrow(cut, f"key {kind}, block_no long, raw binary")
    parts = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(parts).mapInArrow(code, f"key {kind}, block_no long, method int, raw_len long, payload binary")


def roundtrip_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as frames of blocks that are coded in parallel, put together in order, then decoded. A row is its place in the table,
    since a ``doc_id`` may occur more than once."""
    docs = table(spark, sf_dir, "documents").select(F.struct(F.monotonically_increasing_id().alias("row"), "doc_id").alias("key"), "text")
    b = frame_blocks(docs, "key", "text", methods=(frame.PLAIN, frame.ENTROPY))
    whole = b.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("block_no", "raw_len", "payload"))).alias("b"), F.sum("raw_len").alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            out = [None if raw is None else frame.decode(frame.assemble([p["payload"] for p in parts if p["raw_len"]], BLOCK, raw, 2)) for parts, raw in zip(x.column(1).to_pylist(), x.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array([None if o is None else len(o) for o in out], pa.int64()), pa.array([None if o is None else hashlib.md5(o).hexdigest() for o in out], pa.string())], ["doc_id", "n", "digest"])

    return whole.select("key.doc_id", "b", "raw").mapInArrow(run, "doc_id long, n long, digest string")


def roundtrip_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each group of ids in an archive of frames, listed, looked up and read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows in b.column(1).to_pylist():
                files = {r["url"]: (frame.encode((r["html"] or "").encode()), len((r["html"] or "").encode())) for r in rows}
                src = containers.write_archive(files)
                toc = containers.read_archive(src)
                out = [(r["page_id"], containers.read_file(src, toc[containers.find(toc, r["url"])])) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([len(o) for _, o in out], pa.int64()), pa.array([hashlib.md5(o).hexdigest() for _, o in out])], ["page_id", "n", "digest"])

    p = table(spark, sf_dir, "pages")
    groups = p.groupBy(F.floor(F.col("page_id") / 16).alias("g")).agg(F.collect_list(F.struct("page_id", "url", "html")).alias("rows"))
    return groups.mapInArrow(run, "page_id long, n long, digest string")


PAGE_DIGEST = "SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS n, md5(html) AS digest FROM pages"


def bc_decode_psnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as 8 x 8 images in single-channel blocks and back: coded bytes and quality."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, quality = [], []
            for e in b.column(1).to_pylist():
                v = np.clip(np.floor((np.array(e, np.float64) + 1) * 127.5), 0, 255).astype(np.uint8)
                img = v[: len(v) // 8 * 8].reshape(-1, 8)
                coded = texture.encode_channel(img)
                size.append(len(coded))
                quality.append(float(texture.psnr(img, texture.decode_channel(coded, img.shape[1], img.shape[0]))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(quality, pa.float64())], ["vec_id", "coded", "psnr"])

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInArrow(run, "vec_id long, coded long, psnr double")


def hdr_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as blocks of 16 texels of high range (over twenty octaves) in HDR blocks and back: the largest error in octaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            worst = []
            for e in b.column(1).to_pylist():
                px = np.exp2(np.resize(np.array(e or [0.0], np.float64), (16, 3)) * 10)
                back = hdr.decode(hdr.encode(px.reshape(1, 16, 3)))[0]
                worst.append(float(np.abs(np.log2(np.maximum(back, 2.0**-24)) - np.log2(px)).max()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(worst, pa.float64())], ["vec_id", "octaves"])

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInArrow(run, "vec_id long, octaves double")


def bc7_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as blocks of 16 texels of 4 channels (opaque ones for every second vector) in blocks of the best mode and back: the mode and
    the squared error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(0).to_pylist()
            px = np.array([np.clip(np.floor((np.resize(np.array(e or [0.0], np.float64), 64) + 1) * 127.5), 0, 255).reshape(16, 4) for e in b.column(1).to_pylist()]).reshape(-1, 16, 4)
            px[np.array(key, np.int64) % 2 == 0, :, 3] = 255
            coded = bc7.encode(px)
            mode = [next(k for k in range(8) if coded[i] >> k & 1) for i in range(0, len(coded), 16)]
            error = ((bc7.decode(coded).astype(np.int64) - px.astype(np.int64)) ** 2).sum((1, 2))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(mode, pa.int32()), pa.array(error, pa.int64())], names=["vec_id", "mode", "sse"])

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInArrow(run, "vec_id long, mode int, sse long")


def astc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same blocks as those of ``bc7_roundtrip`` in ASTC blocks and back: parts and squared error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(0).to_pylist()
            px = np.array([np.clip(np.floor((np.resize(np.array(e or [0.0], np.float64), 64) + 1) * 127.5), 0, 255).reshape(16, 4) for e in b.column(1).to_pylist()]).reshape(-1, 16, 4)
            px[np.array(key, np.int64) % 2 == 0, :, 3] = 255
            coded = astc.encode(px)
            parts = [(coded[i + 1] >> 3 & 3) + 1 for i in range(0, len(coded), 16)]
            error = ((astc.decode(coded).astype(np.int64) - px.astype(np.int64)) ** 2).sum((1, 2))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(parts, pa.int32()), pa.array(error, pa.int64())], names=["vec_id", "parts", "sse"])

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInArrow(run, "vec_id long, parts int, sse long")


def decode_clips(packets: DataFrame, width: int, height: int, carry: str | None = None) -> DataFrame:
    """(clip, gop, frame_no, y, u, v, error) of (clip, gop, frame_no, packet): each group of pictures by itself, in order.

    A group starts with a keyframe and is bounded by the keyframe interval. Damage drops frames up to its end. ``carry``: a
    binary column that is kept. Groups are dealt by number, as adaptive execution would put their few bytes into one task.
    """
    import pandas as pd

    more = [carry] if carry else []

    def run(g: pd.DataFrame) -> pd.DataFrame:
        session, out = video.Session(width, height), []
        for r in g.sort_values("frame_no").itertuples():
            kept = [getattr(r, c) for c in more]
            try:
                out.append((r.clip, r.gop, r.frame_no, *(np.ascontiguousarray(p).tobytes() for p in session.decode(bytes(r.packet))), None, *kept))
            except CorruptData as e:
                out.append((r.clip, r.gop, r.frame_no, None, None, None, str(e), *kept))
        return pd.DataFrame(out, columns=["clip", "gop", "frame_no", "y", "u", "v", "error", *more])

    fields = "clip long, gop long, frame_no long, y binary, u binary, v binary, error string" + "".join(f", {c} binary" for c in more)
    return packets.repartition(_groups_of(packets.sparkSession), "clip", "gop").groupBy("clip", "gop").applyInPandas(run, fields)


def _groups_of(spark: SparkSession) -> int:
    """Tasks that groups of pictures are dealt to."""
    return max(8 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def video_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as 8 x 8 frames, coded in groups of 16 and decoded: packet bytes, whether the decoder shows what the encoder saw, and its
    squared error against the source."""
    import pandas as pd

    size = 8

    def planes(e: list) -> list[np.ndarray]:
        v = np.clip(np.floor((np.array(e, np.float64) + 1) * 127.5), 0, 255).astype(np.uint8)[: size * size].reshape(size, size)
        return [v, np.full((size // 2, size // 2), 128, np.uint8), np.full((size // 2, size // 2), 128, np.uint8)]

    def code(g: pd.DataFrame) -> pd.DataFrame:
        session, out = video.Session(size, size), []
        for r in g.sort_values("vec_id").itertuples():
            p = planes(r.embedding)
            packet = session.encode(p, 95, interval=16, reach=1)
            out.append((0, r.gop, r.vec_id, packet, p[0].tobytes() + session.visible()[0].tobytes()))
        return pd.DataFrame(out, columns=["clip", "gop", "frame_no", "packet", "seen"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, y, seen = b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()
            shown = [np.frombuffer(x or bytes(size * size), np.uint8).astype(np.int64) for x in y]
            source = [np.frombuffer(x[: size * size], np.uint8) for x in seen]
            yield pa.RecordBatch.from_arrays([key, pa.array([a == s[size * size :] for a, s in zip(y, seen, strict=True)], pa.bool_()), pa.array([int(((a - s) ** 2).sum()) for a, s in zip(shown, source, strict=True)], pa.int64())], ["vec_id", "same", "sse"])

    e = table(spark, sf_dir, "embeddings").where("size(embedding) = 64").withColumn("gop", F.floor(F.col("vec_id") / 16))
    coded = e.select("vec_id", "embedding", "gop").repartition(_groups_of(spark), "gop").groupBy("gop").applyInPandas(code, "clip long, gop long, frame_no long, packet binary, seen binary")
    return decode_clips(coded, size, size, "seen").select("frame_no", "y", "seen").mapInArrow(judge, "vec_id long, same boolean, sse long")


def codec_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total coded size of all documents by codec, with ratio."""
    import bz2
    import zlib

    names = ("plain", "entropy", "turbo", "deflate", "bzip2")

    def sizes(raw: bytes) -> tuple:
        parts = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        fns = (lz.encode, entropy.encode, turbo.encode, zlib.compress, bz2.compress)
        return (len(raw), *[sum(len(f(p)) for p in parts) for f in fns])

    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    s = map_bytes(docs, "doc_id", "text", sizes, "raw long, " + ", ".join(f"{n} long" for n in names))
    t = s.agg(F.sum("raw").alias("raw"), *[F.sum(n).alias(n) for n in names])
    rows = t.select("raw", F.explode(F.array(*[F.struct(F.lit(n).alias("codec"), F.col(n).alias("coded")) for n in names])).alias("x"))
    return rows.select("x.codec", "raw", "x.coded", F.round(F.col("raw") / F.col("x.coded"), 4).alias("ratio"))


QUERIES = {
    "roundtrip_plain": (roundtrip_plain, SOURCE_DIGEST),
    "roundtrip_entropy": (roundtrip_entropy, SOURCE_DIGEST),
    "roundtrip_entropy3": (roundtrip_entropy3, SOURCE_DIGEST),
    "roundtrip_lazy": (roundtrip_lazy, SOURCE_DIGEST),
    "parse_sizes": (parse_sizes, None),
    "match_table": (match_table, MATCH_TABLE),
    "roundtrip_turbo": (roundtrip_turbo, SOURCE_DIGEST),
    "roundtrip_huffman": (roundtrip_huffman, SOURCE_DIGEST),
    "roundtrip_dictionary": (roundtrip_dictionary, SOURCE_DIGEST),
    "x86_roundtrip": (x86_roundtrip, SOURCE_DIGEST),
    "split_merge": (split_merge, SOURCE_DIGEST),
    "roundtrip_frame": (roundtrip_frame, SOURCE_DIGEST),
    "roundtrip_archive": (roundtrip_archive, PAGE_DIGEST),
    "bc_decode_psnr": (bc_decode_psnr, None),
    "video_roundtrip": (video_roundtrip, None),
    "hdr_roundtrip": (hdr_roundtrip, None),
    "bc7_roundtrip": (bc7_roundtrip, None),
    "astc_roundtrip": (astc_roundtrip, None),
    "codec_compare": (codec_compare, None),
}
