"""Every query of the catalog against its SQL on the smallest tables; sources, streams and running sums."""

import duckdb
import pandas as pd
import pytest

from blockwright import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if pd.api.types.is_scalar(v) and pd.isna(v):
        return None
    return int(v) if isinstance(v, float) and v.is_integer() else v


def rows(df):
    return [tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).values.tolist()]


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = (sorted(map(repr, rows(x))) for x in (got, want))
    assert a == b


def test_entry_works_without_the_llm_folders(tmp_path):
    """A copy without the llm folders and the pipeline imports and has all other queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "blockwright", tmp_path / "blockwright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, env={**__import__("os").environ, "PYTHONPATH": str(tmp_path)})
    assert said.returncode == 0, said.stderr
    names, sql = (line.split() for line in said.stdout.splitlines())
    assert names == sorted(catalog.queries()) and sql == sorted(catalog.oracle_sql())


def test_containers_as_tables(spark, tmp_path):
    from blockwright.functions import containers, frame
    from blockwright.sources import containers as src

    data = bytes(i * i % 251 for i in range(100_000))
    src.save(spark, f"file://{tmp_path}/f/a.frame", frame.encode(data, 16 << 10, (frame.PLAIN,)))
    src.save(spark, f"file://{tmp_path}/f/b.frame", b"not a frame at all, just text")
    b = src.read_frames(spark, f"{tmp_path}/f")
    assert b.where("error is not null").count() == 1
    out = src.decode_blocks(b).orderBy("block_no").collect()
    assert b"".join(bytes(r["data"]) for r in out) == data
    src.save(spark, f"file://{tmp_path}/x/p.arc", containers.write_archive({"n": (frame.encode(data), len(data))}))
    src.save(spark, f"file://{tmp_path}/x/c.clip", containers.write_clip([(b"kk", True), (b"p", False)], 16, 16, (30, 1), 2))
    assert src.read_archives(spark, f"{tmp_path}/x/p.arc").select("name", "raw_size").collect() == [("n", len(data))]
    assert [r["is_key"] for r in src.read_clips(spark, f"{tmp_path}/x/c.clip").orderBy("frame_no").collect()] == [True, False]
    assert {r["kind"]: r["entries"] for r in src.describe(spark, f"{tmp_path}/x").collect()} == {"archive": 1, "clip": 2}
    src.save(spark, f"file://{tmp_path}/y/raw.i420", bytes(6 * 6 + 3))
    assert src.read_raw_frames(spark, f"{tmp_path}/y", 4, 2).count() == 3


def test_running_sums_do_not_depend_on_partitions(spark):
    from pyspark.sql import functions as F

    from blockwright.plans.running import global_running

    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), F.col("id").alias("v"))
    got = global_running(df, ["k"], {"v": "s"}).orderBy("k").collect()
    total = 0
    for r in got:
        total += r["v"]
        assert r["s"] == total


def test_resync_stream(spark, tmp_path):
    from blockwright.streaming.packets import resync

    d = [(1, 0, False, False), (1, 1, True, False), (1, 2, False, False), (1, 3, False, True), (1, 4, False, False), (1, 5, True, False), (1, 7, False, False), (2, 0, True, False)]
    schema = "clip long, frame_no long, is_key boolean, bad boolean"
    for i, part in enumerate((d[:3], d[3:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    _run(spark, resync(stream).writeStream.format("memory").queryName("resync").outputMode("append").option("checkpointLocation", f"{tmp_path}/c"))
    got = {(r["clip"], r["frame_no"]): r["decodes"] for r in spark.table("resync").collect()}
    assert got[2, 0] and len(got) == len(d)
    assert [got[1, n] for n in (0, 1, 2, 3, 4, 5, 7)] == [False, True, True, False, False, True, False]


def test_stream_compression(spark):
    from blockwright.functions import lz
    from blockwright.streaming.packets import compress

    d = b"hello world, this is the header"
    out = compress(spark.createDataFrame([(1, bytearray(d)), (2, None)], "pkt_id long, payload binary"), d, 3).orderBy("pkt_id").collect()
    assert lz.decode(bytes(out[0]["coded"]), out[0]["raw_len"], d) == d and out[0]["dict_version"] == 3 and out[1]["raw_len"] == 0


def _stream(spark, folder, schema, parts):
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def _run(spark, writer, idle=False):
    """All that is there, batch by batch. Without batches for timeouts alone, which a state with timeouts would ask for forever."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(idle).lower())
    query = writer.trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(60)
    finally:
        query.stop()
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_decoder_sessions_as_state(spark, tmp_path):
    import numpy as np

    from blockwright.functions import video
    from blockwright.streaming.packets import decode_sessions

    rs, enc, seen, packets = np.random.default_rng(2), video.Session(32, 16), [], []
    for i in range(8):
        y = np.roll(np.add.outer(np.arange(16) * 5, np.arange(32) * 3) % 256, i, 1).astype(np.uint8)
        packets.append(enc.encode([y, *(np.full((8, 16), 90 + i, np.uint8) for _ in "uv")], 80, interval=4, reach=1))
        seen.append(enc.visible()[0].tobytes())
    broken = bytes(rs.integers(0, 256, 40, np.uint8))
    rows = [(1, i, p) for i, p in enumerate(packets)] + [(2, i, broken if i == 2 else p) for i, p in enumerate(packets)]
    stream = _stream(spark, tmp_path, "clip long, frame_no long, packet binary", [rows[:3], rows[3:10], rows[10:], [(1, 2, packets[2])]])
    _run(spark, decode_sessions(stream, 32, 16).writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", f"{tmp_path}/c"))
    got = [(r["clip"], r["frame_no"], r["y"] and bytes(r["y"]), r["error"]) for r in spark.table("sessions").collect()]
    assert sorted(g[:3] for g in got if g[0] == 1 and g[3] is None) == [(1, i, seen[i]) for i in range(8)]
    assert [g for g in got if g[3] == "late"] == [(1, 2, None, "late")]
    second = {g[1]: g for g in got if g[0] == 2}
    assert [second[i][2] == seen[i] for i in range(8)] == [True, True, False, False, True, True, True, True]


def test_one_pass_clip_sink(spark, tmp_path):
    from blockwright.functions import containers
    from blockwright.streaming import packets as pk

    rows = [(i, bytes([i]) * (i + 1), i % 5 == 0) for i in range(20)]
    stream = _stream(spark, tmp_path, "frame_no long, packet binary, is_key boolean", [rows[:7], rows[7:15], rows[15:]])
    path = f"{tmp_path}/out.clip"
    _run(spark, stream.writeStream.foreachBatch(pk.clip_sink(path)).option("checkpointLocation", f"{tmp_path}/c"))
    pk.clip_sink(path)(spark.createDataFrame(rows[7:15], "frame_no long, packet binary, is_key boolean"), 1)  # a batch that runs again
    pk.finish_clip(spark, path, 64, 48)
    src = open(path, "rb").read()
    c = containers.read_clip(src)
    assert [(src[o : o + n], k) for o, n, k in c.packets] == [(p, k) for _, p, k in rows]


def test_windowed_rates(spark, tmp_path):
    from datetime import datetime, timedelta

    from blockwright.streaming.packets import rates

    t = datetime(2024, 1, 1)
    first = [(t + timedelta(minutes=m), "view", "abc") for m in (0, 1, 4, 6)]
    later = [(t + timedelta(minutes=40), "view", "x"), (t, "view", "on time no more")]
    last = [(t + timedelta(minutes=1), "view", "too late"), (t + timedelta(minutes=80), "view", "")]
    stream = _stream(spark, tmp_path, "ts timestamp, event_type string, props string", [first, later, last])
    _run(spark, rates(stream).writeStream.format("memory").queryName("rates").outputMode("append").option("checkpointLocation", f"{tmp_path}/c"), True)
    got = {(r["start"] - t).seconds // 60: (r["packets"], r["bytes"]) for r in spark.table("rates").collect()}
    assert got[5] == (1, 3) and got[0] in ((3, 9), (4, 24), (5, 32)) and got[40] == (1, 1)  # what is late may still meet its window


def test_sql_functions(spark):
    from blockwright.functions import frame, registry

    registry.register(spark)
    data = b"some data, some more data, " * 40
    spark.createDataFrame([(1, data, 2.5), (2, b"", -1.0), (3, None, None)], "k long, d binary, v double").createOrReplaceTempView("given")
    for m in registry.ENCODERS:
        got = spark.sql(f"SELECT k, bw_decode(bw_encode(d, '{m}'), length(d), '{m}') AS b FROM given").collect()
        assert {r["k"]: r["b"] and bytes(r["b"]) for r in got} == {1: data, 2: b"", 3: None}
    r = spark.sql("SELECT bw_unframe(bw_frame(d)) AS b, bw_x86(bw_x86(d, true), false) AS x, bw_unhalf(bw_half(v)) AS h, bw_decode(d, 5L, 'plain') AS bad FROM given WHERE k = 1").first()
    assert bytes(r["b"]) == data == bytes(r["x"]) and r["h"] == 2.5 and r["bad"] is None
    assert spark.sql("SELECT bw_code_lengths(ascii(c)) AS l FROM (SELECT explode(split('aaab', '')) AS c)").first()["l"][97] == 1
    assert spark.sql("SELECT count(*) AS n, sum(raw_len) AS s FROM given, LATERAL bw_frame_blocks(bw_frame(d)) WHERE k = 1").first() == (1, len(data))
    assert spark.sql("SELECT * FROM given, LATERAL bw_archive_entries(d)").count() == 0 and frame.index(frame.encode(data))[1] == len(data)


def _against_sql(spark, name, sf, **tables):
    """A query against its SQL over given parquet tables."""
    c = duckdb.connect()
    for t in tables:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet/*.parquet')")
    got, want = catalog.queries()[name](spark, str(sf)).toPandas(), c.execute(catalog.oracle_sql()[name]).df()
    assert sorted(map(repr, rows(got))) == sorted(map(repr, rows(want)))


@pytest.mark.parametrize("name", ["roundtrip_frame", "roundtrip_plain"])
def test_repeated_keys_empty_and_null_texts(spark, tmp_path, name):
    long = "many words and " * 3000
    docs = spark.createDataFrame([(1, "one"), (1, "two"), (2, long), (2, long), (3, ""), (4, None), (None, "x"), (None, "y")], "doc_id long, text string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    _against_sql(spark, name, tmp_path, documents=docs)


def test_equal_names_in_the_table_of_contents(spark, tmp_path):
    got = []
    for k, order in enumerate((1, -1)):
        pages = [(i, f"u{i % 3}", "h" * (i * 7 % 11)) for i in range(60)][::order]
        spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3 + k).write.parquet(f"{tmp_path}/{k}/pages.parquet")
        got.append(sorted(map(tuple, catalog.queries()["archive_toc"](spark, f"{tmp_path}/{k}").collect())))
    assert got[0] == got[1] and [r[2] for r in got[0]] == [i * 7 % 11 for k in range(3) for i in range(k, 60, 3)]


@pytest.mark.parametrize("name", ["motion_search", "sad_search"])
def test_block_searches_over_odd_rows_and_without_a_row_for_each_pixel(spark, tmp_path, name):
    import random

    r = random.Random(5)
    line = lambda n: [r.choice([None, -2.0, 0.1, 0.5]) if r.random() < 0.05 else r.uniform(-1, 1) for _ in range(n)]
    odd = [(y, line(64)) for y in range(0, 90) if y not in (13, 40)] + [(50, line(64)), (50, line(64)), (60, line(70)), (None, line(64)), (91, None), (92, [])]
    odd = [(y, v[: r.choice((20, 61, 70))] if v and y is not None and y > 76 else v) for y, v in odd]
    spark.createDataFrame(odd, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    _against_sql(spark, name, tmp_path, embeddings=odd)
    plan = catalog.queries()[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_strings_are_counted_by_number():
    from collections import Counter

    import numpy as np

    from blockwright.operators.matching import _packed, _strings

    wide = "".join(map(chr, range(0x4E00, 0x4E00 + 300)))
    for texts in (["abcabcabcabc", "", "short", "éèabcabcabc", "żółćżółćżółć", "12345678"], ["xabcdefgh", wide + "😀😀😀😀😀😀😀😀😀", "abcdefgh"], ["", "a"], ["abcdefg", "hijklmn"]):
        codes, count = _strings(texts)
        got = {"".join(map(chr, c)): n for c, n in zip(codes.tolist(), count.tolist(), strict=True)}
        assert got == Counter(t[i : i + 8] for t in texts for i in range(len(t) - 7))
        packed = [bytes(x) for _, k in _packed(codes) for x in k.to_pylist()]
        assert len(set(packed)) == len(got) and sorted(np.concatenate([w for w, _ in _packed(codes)] or [np.zeros(0)]).tolist()) == list(range(len(got)))


def test_kernels_are_dealt_to_all_cores(spark, tmp_path):
    from blockwright.session import spread

    spark.range(200_000).selectExpr("id", "cast(id as string) as text").coalesce(1).write.option("parquet.block.size", 1 << 30).parquet(f"{tmp_path}/t")
    with_many = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        sizes = spread(spark.read.parquet(f"{tmp_path}/t")).rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", with_many)
    assert len(sizes) == 4 * spark.sparkContext.defaultParallelism and max(sizes) < 2 * 200_000 / len(sizes)


def test_region_store_has_no_window_over_a_block_of_sequences(spark):
    plan = catalog.queries()["region_store"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line and "row_number" in line]
    assert not windows


def test_parses_are_dealt_to_all_cores(spark):
    assert catalog.queries()["parse_sizes"](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_set_of_tables_is_made_once(monkeypatch):
    from blockwright.functions import entropy3, huffman

    data, calls, lengths = b"".join(b"%d words of many kinds %d " % (i * i, i) for i in range(400)), [], huffman.lengths
    monkeypatch.setattr(huffman, "lengths", lambda *a: calls.append(1) or lengths(*a))
    coded = entropy3.encode(data)
    assert entropy3.decode(coded, len(data)) == data and len(calls) < 100


def test_sql_functions_get_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, str(64 << 20))
        catalog.queries()["sql_round_trip"](spark, SF)
        assert int(spark.conf.get(key).rstrip("b")) <= 1 << 20
    finally:
        spark.conf.set(key, before)
