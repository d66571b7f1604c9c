"""Containers as data sources: written and read by tasks, directories without payloads, refused input, nothing left behind."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockwright.functions import containers, frame, texture
from blockwright.sources import containers as whole
from blockwright.sources import datasource


@pytest.fixture(scope="module")
def known(spark):
    datasource.register(spark)
    return spark


def _files(spark, n):
    size = F.pmod(F.col("id") * 7919, F.lit(70_000))
    return spark.range(n).select(F.format_string("d%d/f%05d.bin", F.col("id") % 7, "id").alias("name"), F.expr("cast(left(repeat(concat('abc', id, 'xyz '), 9000), cast(pmod(id * 7919, 70000) as int)) as binary)").alias("content"), size.alias("size"))


def test_an_archive_of_a_thousand_files(known, tmp_path):
    files = _files(known, 1000).repartition(6)
    path = f"{tmp_path}/a.pak"
    datasource.cut(files, 16384).write.format("archives").option("block", 16384).option("methods", "1").mode("append").save(path)
    assert os.listdir(tmp_path) == ["a.pak"]
    got = known.read.format("archives").option("taskBytes", 200_000).load(path)
    assert got.rdd.getNumPartitions() > 1
    both = got.join(files, "name").select("name", (F.col("data") == F.coalesce("content", F.lit(b""))).alias("same"), "raw_size", "error", F.length("content").alias("n")).collect()
    assert len(both) == 1000 and all(r["same"] and r["error"] is None and r["raw_size"] == r["n"] for r in both)
    listed = known.read.format("archives").option("payload", "false").load(path).orderBy("i").collect()
    assert [r["name"] for r in listed] == sorted(r["name"] for r in listed) and all(r["data"] is None for r in listed)
    src = open(path, "rb").read()
    assert [f.name for f in containers.read_archive(src)] == [r["name"] for r in listed]
    assert {r["name"] for r in whole.read_archives(known, path).collect()} == {r["name"] for r in listed}


def test_duplicates_and_holes_are_refused(known, tmp_path):
    rows = datasource.cut(known.createDataFrame([("a", b"x" * 10), ("b", b"y"), ("a", b"z")], "name string, content binary"), 4096)
    with pytest.raises(Exception, match="two pieces|twice"):
        rows.write.format("archives").mode("append").save(f"{tmp_path}/dup.pak")
    holes = known.createDataFrame([(0, b"x" * 4096), (2, b"y")], "block_no long, data binary")
    with pytest.raises(Exception, match="numbered from 0"):
        holes.write.format("frames").option("block", 4096).mode("append").save(f"{tmp_path}/hole.zap")
    with pytest.raises(ValueError):
        containers.write_archive([("a", (b"", 0)), ("a", (b"", 0))])
    assert os.listdir(tmp_path) == []


def test_frames(known, tmp_path):
    data = b"".join(b"%d stream of blocks " % (i // 40) for i in range(20_000))
    path = f"{tmp_path}/f.zap"
    rows = datasource.cut(known.createDataFrame([("f", data)], "name string, content binary"), 4096).select("block_no", "data").repartition(5)
    for methods in ("", "1,2"):
        rows.write.format("frames").option("block", 4096).option("methods", methods).mode("overwrite").save(path)
        assert frame.decode(open(path, "rb").read()) == data
        got = known.read.format("frames").option("taskBytes", 1000).load(path)
        assert b"".join(bytes(r["data"]) for r in got.orderBy("block_no").collect()) == data and got.rdd.getNumPartitions() > 3
    with pytest.raises(Exception, match="f.zap"):
        rows.write.format("frames").mode("append").save(path)
    broken = bytearray(open(path, "rb").read())
    broken[-40:] = bytes(40)
    open(path, "wb").write(bytes(broken))
    last = known.read.format("frames").load(path).orderBy("block_no").collect()[-1]
    assert last["data"] is None and last["error"]


def test_clips_and_records(known, tmp_path):
    rows = known.range(30).select(F.col("id").alias("frame_no"), F.expr("cast(repeat(cast(id as string), cast(id as int) + 1) as binary)").alias("packet"), (F.col("id") % 10 == 0).alias("is_key")).repartition(4)
    path = f"{tmp_path}/c.clip"
    rows.write.format("clips").options(width=64, height=48, rate="30000/1001", tag=1).mode("append").save(path)
    got = known.read.format("clips").load(path)
    assert got.join(rows, ["frame_no", "is_key"]).where("data = packet").count() == 30
    c = containers.read_clip(open(path, "rb").read())
    assert (c.width, c.height, c.rate, c.colour) == (64, 48, (30000, 1001), 1) and containers.keyframe(c, 17) == 10
    raw = np.arange(10 * 8 * 4 * 3 // 2 + 7, dtype=np.uint8).tobytes()
    open(f"{tmp_path}/v.yuv", "wb").write(raw)
    frames = known.read.format("records").options(width=8, height=4).load(f"{tmp_path}/v.yuv").orderBy("record_no").collect()
    assert [bytes(r["data"]) for r in frames] == [raw[i * 48 : (i + 1) * 48] for i in range(10)]
    images = known.read.format("records").options(width=3, height=5, kind="rgba8").load(f"{tmp_path}/v.yuv")
    assert images.count() == len(raw) // 60


def test_texture_files(known, tmp_path):
    levels = known.createDataFrame([(1, b"b" * 8), (0, b"a" * 32)], "level long, data binary")
    levels.write.format("textures").options(format="BC1", width=8, height=8).mode("append").save(f"{tmp_path}/t.dds")
    assert open(f"{tmp_path}/t.dds", "rb").read() == texture.texture_file([b"a" * 32, b"b" * 8], 8, 8, "BC1")
    extended = texture.texture_file([b"x" * 64], 8, 8, "BC7", True)
    assert len(extended) == 148 + 64 and extended[84:88] == b"DX10" and extended[128] == 99
    levels.where("level = 0").write.format("textures").options(format="astc", width=300, height=5).mode("append").save(f"{tmp_path}/t.astc")
    assert open(f"{tmp_path}/t.astc", "rb").read() == bytes([0x13, 0xAB, 0xA1, 0x5C, 4, 4, 1, 44, 1, 0, 5, 0, 0, 1, 0, 0]) + b"a" * 32


def _scene(w, h, t=0):
    y, x = np.mgrid[0:h, 0:w]
    r = np.random.default_rng(t)
    base = np.stack([x * 2 + t * 3, y * 3, (x + y) * 2, np.full_like(x, 255)], 2) % 256
    return np.clip(base + r.integers(0, 4, base.shape), 0, 255).astype(np.uint8)


def test_mips():
    grey = np.zeros((2, 2, 4), np.uint8)
    grey[:, 1, :3] = 255
    grey[..., 3] = 255
    assert texture.mip(grey)[0, 0].tolist() == [128, 128, 128, 255] and texture.mip(grey, True)[0, 0].tolist() == [188, 188, 188, 255]
    for v in range(256):
        assert (texture.mip(np.full((2, 2, 4), v, np.uint8), True) == v).all()
    assert (texture.mip(np.full((3, 5, 4), 77, np.uint8)) == 77).all() and texture.mip(np.full((3, 5, 4), 77, np.uint8)).shape == (1, 2, 4)
    column = np.arange(8, dtype=np.uint8).reshape(8, 1, 1)
    assert texture.mip(column)[:, 0, 0].tolist() == [1, 3, 5, 7]


@pytest.mark.parametrize(("kind", "least"), [("BC1", 30), ("BC4", 32), ("BC7", 34), ("ASTC", 32)])
def test_texture_job(known, tmp_path, kind, least):
    import zlib

    from blockwright.functions import astc, bc7
    from blockwright.plans import jobs

    image = _scene(67, 45)
    rows = [(1, 67, 45, image.tobytes()), (2, 8, 8, b"too short"), (3, 1, 1, bytes([10, 200, 30, 255]))]
    images = known.createDataFrame(rows, "image_id int, width int, height int, rgba binary")
    got = {(r["image_id"], r["level"]): r for r in jobs.texture_levels(images, kind).collect()}
    assert sorted(got) == [(1, k) for k in range(7)] + [(3, 0)]
    assert all(len(r["data"]) == -(-r["width"] // 4) * -(-r["height"] // 4) * (8 if kind in ("BC1", "BC4") else 16) for r in got.values())
    data = bytes(got[1, 0]["data"])
    channels = 1 if kind == "BC4" else 3

    def shown(d):
        if kind in ("BC1", "BC4"):
            return (texture.decode_colour(d, 67, 45)[:, :, :3] if kind == "BC1" else texture.decode_channel(d, 67, 45)[:, :, None]).astype(np.uint8)
        px = (bc7 if kind == "BC7" else astc).decode(d)
        return np.stack([texture.image_of(px[:, :, k], 67, 45) for k in range(3)], 2)

    assert texture.psnr(shown(data), image[:, :, :channels]) > least
    if kind in ("BC1", "BC4"):
        less = bytes(jobs.texture_levels(images, kind, mips=False, price=60.0).where("image_id = 1").first()["data"])
        assert len(zlib.compress(texture.split(less, kind))) < 0.95 * len(zlib.compress(texture.split(data, kind))) and texture.psnr(shown(less), image[:, :, :channels]) > 26
    if kind == "BC1":
        jobs.texture_levels(images, "BC1").where("image_id = 1").select("level", "data").write.format("textures").options(format="BC1", width=67, height=45).mode("append").save(f"{tmp_path}/t.dds")
        assert os.path.getsize(f"{tmp_path}/t.dds") == 128 + sum(len(r["data"]) for k, r in got.items() if k[0] == 1)


def test_clip_jobs(known, tmp_path):
    from blockwright.plans import jobs

    frames = []
    for i in range(12):
        y = _scene(72, 40, i // 2)[:, :, 0]
        frames.append((0, i, y.tobytes(), *(np.full((20, 36), 100 + i, np.uint8).tobytes() for _ in "uv")))
    raw = known.createDataFrame(frames, "clip long, frame_no long, y binary, u binary, v binary").repartition(3)
    path, other = f"{tmp_path}/a.clip", f"{tmp_path}/b.clip"
    coded = jobs.encode_clips(raw, 72, 40, 85, 5)
    coded.select("frame_no", "packet", "is_key").write.format("clips").options(width=72, height=40, rate=25).mode("append").save(path)
    c = containers.read_clip(open(path, "rb").read())
    assert [i for i, p in enumerate(c.packets) if p[2]] == [0, 5, 10]
    jobs.transcode(known, path, other, 60, 4)
    for p, least in ((path, 34), (other, 28)):
        packets = known.read.format("clips").load(p).select(F.lit(0).cast("long").alias("clip"), "frame_no", F.col("data").alias("packet"), "is_key")
        shown = {r["frame_no"]: np.frombuffer(bytes(r["y"]), np.uint8) for r in jobs.decode_packets(packets, 72, 40).collect()}
        assert len(shown) == 12 and all(texture.psnr(shown[i], np.frombuffer(f[2], np.uint8)) > least for i, f in enumerate(frames))
    assert os.path.getsize(other) < os.path.getsize(path)
    broken = bytearray(open(path, "rb").read())
    broken[c.packets[6][0] + 1] ^= 255
    open(path, "wb").write(bytes(broken))
    with pytest.raises(Exception):
        jobs.transcode(known, path, f"{tmp_path}/never.clip", 60)
    assert sorted(os.listdir(tmp_path)) == ["a.clip", "b.clip"]


def test_the_driver_holds_no_row_for_each_piece(known, tmp_path):
    import pickle
    import random

    from pyspark.sql import Row

    path, n = f"{tmp_path}/many.clip", 200_000
    numbers = list(range(n))
    random.Random(3).shuffle(numbers)
    w = datasource.Clips({"path": path, "width": "64", "height": "48"}).writer(None, False)
    said = [w.write(iter([Row(frame_no=i, packet=b"%d" % i, is_key=i % 50 == 0) for i in part])) for part in (numbers[: n // 3], numbers[n // 3 :])]
    assert len(pickle.dumps(said)) < 10_000
    w.commit(said)
    assert os.listdir(tmp_path) == ["many.clip"]
    src = open(path, "rb").read()
    assert [(src[o : o + k], key) for o, k, key in containers.read_clip(src).packets] == [(b"%d" % i, i % 50 == 0) for i in range(n)]
    r = datasource.Clips({"path": path, "taskBytes": "300000"}).reader(None)
    dealt = r.partitions()
    assert len(pickle.dumps([(p.file, p.size, p.first, p.end) for p in dealt])) < 10_000 and len(dealt) == 4
    assert [(x[1], x[8]) for p in dealt for x in r.read(p)] == [(i, b"%d" % i) for i in range(n)]
