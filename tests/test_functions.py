"""Codecs: round trips over sizes and kinds of data, exact sizes, damage, recorded formats."""

import random

import numpy as np
import pytest

from blockwright.functions import CorruptData, astc, bc7, containers, dictionary, entropy, entropy3, frame, hdr, huffman, lz, parse, texture, turbo, video, x86

R = random.Random(5)
NOISE = R.randbytes(30_000)
CASES = [bytes(R.choices(range(3), k=n)) for n in range(0, 300, 7)] + [b"\x07" * 50_000, bytes((i % 5 + i // 777) & 255 for i in range(50_000)), NOISE, NOISE + NOISE]


@pytest.mark.parametrize("codec", [lz, entropy, entropy3, turbo])
def test_round_trip_and_exact_size(codec):
    for c in CASES:
        e = codec.encode(c)
        assert codec.decode(e, len(c)) == c
        with pytest.raises(CorruptData):
            codec.decode(e, len(c) + 1)
        if c:
            with pytest.raises(CorruptData):
                codec.decode(e, len(c) - 1)


@pytest.mark.parametrize("codec", [lz, entropy, entropy3, turbo])
def test_damage_is_an_error_or_other_bytes_but_never_a_crash(codec):
    c = CASES[-3][:3000]
    e = codec.encode(c)
    for i in range(300):
        d = bytearray(e)
        d[R.randrange(len(d))] ^= 1 << R.randrange(8)
        try:
            assert len(codec.decode(bytes(d[: len(d) - i % 3]), len(c))) == len(c)
        except CorruptData:
            pass


def test_far_repeats_are_found():
    assert len(lz.encode(NOISE + NOISE)) < 0.6 * 2 * len(NOISE)


def test_dictionary_is_history():
    d, m = NOISE[:5000], NOISE[1000:1100] + b"!"
    e = lz.encode(m, d)
    assert len(e) < 30 and lz.decode(e, len(m), d) == m
    with pytest.raises(CorruptData):
        lz.decode(e, len(m))


def test_plain_format_by_hand():
    # 3 literals, match of 6 from 3 back, then 2 literals
    block = bytes([3 << 4 | 2]) + b"abc" + (3).to_bytes(2, "little") + bytes([2 << 4]) + b"xy"
    assert lz.decode(block, 11) == b"abcabcabcxy"
    far = bytes([1 << 4]) + b"z" + (0x8000 | 1).to_bytes(2, "little") + b"\x00" + bytes([0])
    assert lz.decode(far, 5) == b"zzzzz"


def test_huffman_limits():
    counts = np.zeros(256, np.int64)
    counts[:20] = [1 << i for i in range(20)]
    lens = huffman.lengths(counts)
    assert lens.max() <= huffman.LIMIT and huffman.kraft(lens) <= 1 << huffman.LIMIT
    for c in CASES:
        if c:
            assert huffman.decode(huffman.encode(c), len(c)) == c
            assert huffman.decode_parts(huffman.encode_parts(c), len(c)) == c
    with pytest.raises(CorruptData):
        huffman.decode(b"\x11" * 128 + b"\x00", 1)


def test_repeat_offsets_move_to_front():
    r = entropy.Recent()
    for off in (10, 20, 30):
        r.push(off)
    assert r.offsets == [30, 20, 10] and r.use(2) == 10 and r.offsets == [10, 30, 20] and r.slot(20) == 2


def test_x86_filter():
    code = bytearray()
    for i in range(3000):
        code += b"\x90\xe8" + ((5000 - len(code)) & 0xFFFFFFFF).to_bytes(4, "little")
    turned, n = x86.apply(bytes(code), True)
    assert n > 1000 and x86.apply(turned, False)[0] == bytes(code)
    assert x86.apply(b"\xe8\0\0\0", True) == (b"\xe8\0\0\0", 0)
    f = frame.encode(bytes(code), methods=(frame.PLAIN,))
    assert frame.decode(f) == bytes(code) and any(b.filtered for b in frame.index(f)[2])


def test_frames():
    data = CASES[-3] + NOISE
    for methods in ((), (frame.PLAIN,), (frame.PLAIN, frame.ENTROPY, frame.TURBO)):
        f = frame.encode(data, 16 << 10, methods)
        assert frame.decode(f) == data
        for cut in (0, 5, 20, len(f) - 1):
            with pytest.raises(CorruptData):
                frame.decode(f[:cut])
    assert frame.decode(frame.encode(b"")) == b""


def test_archives():
    files = {"z/last.bin": b"7" * 70_000, "a/first.txt": b"x" * 1000, "empty": b"", "m/mid": bytes(range(200)), "m/mid2": b"17"}
    src = containers.write_archive({n: (frame.encode(b, 16 << 10), len(b)) for n, b in files.items()})
    toc = containers.read_archive(src)
    assert [f.name for f in toc] == sorted(files) and toc[0].name == "a/first.txt" and toc[-1].name == "z/last.bin"
    for n, b in files.items():
        assert containers.read_file(src, toc[containers.find(toc, n)]) == b
    assert [containers.find(toc, n) for n in ("m", "m/mid3", "")] == [-1, -1, -1]
    for i in range(300):
        d = bytearray(src)
        d[R.randrange(len(d))] ^= 255
        try:
            for f in containers.read_archive(bytes(d)):
                containers.read_file(bytes(d), f)
        except CorruptData:
            pass


def test_clips():
    packets = [(bytes([i]) * (i + 1), i % 4 == 0) for i in range(8)]
    src = containers.write_clip(packets, 320, 256, (30000, 1001), 4, 1)
    c = containers.read_clip(src)
    assert len(src) == 48 + 36 + 8 * 16 and c.rate == (30000, 1001) and c.colour == 1
    assert containers.keyframe(c, 6) == 4 and containers.keyframe(c, 3) == 0
    assert [src[o : o + s] for o, s, _ in c.packets] == [p for p, _ in packets]
    with pytest.raises(CorruptData):
        containers.read_clip(containers.write_clip([(b"x", False)], 320, 256, (30, 1), 4))


def test_textures():
    y, x = np.mgrid[0:45, 0:67]
    img = ((x * 2 + y) % 256).astype(np.uint8)
    back = texture.decode_channel(texture.encode_channel(img), 67, 45)
    assert back.shape == img.shape and texture.psnr(img, back) > 32
    one = np.array([[77]], np.uint8)
    assert abs(int(texture.decode_channel(texture.encode_channel(one), 1, 1)[0, 0]) - 77) <= 4
    for k in texture.FIELDS:
        d = NOISE[: 16 * 40 + 5]
        assert texture.merge(texture.split(d, k), k) == d
    red = bytes([0x00, 0xF8, 0x00, 0x00, 0, 0, 0, 0])
    assert texture.decode_colour(red, 4, 4)[0, 0].tolist() == [255, 0, 0, 255]


def test_colour_blocks():
    y, x = np.mgrid[0:45, 0:67]
    img = np.stack([x * 3 % 256, y * 5 % 256, (x + y) * 2 % 256, np.where(x < 30, 255, x * y & 255)], 2).astype(np.uint8)
    bc1 = texture.decode_colour(texture.encode_colour(img[:, :, :3]), 67, 45)
    assert (bc1[:, :, 3] == 255).all() and texture.psnr(img[:, :, :3], bc1[:, :, :3]) > 32
    bc3 = texture.decode_colour_alpha(texture.encode_colour_alpha(img), 67, 45)
    assert texture.psnr(img[:, :, :3], bc3[:, :, :3]) > 32
    two = texture.decode_two(texture.encode_two(img), 67, 45)
    assert texture.psnr(img[:, :, :2], two) > 32
    one = np.array([[[10, 200, 30, 255]]], np.uint8)
    assert np.abs(texture.decode_colour(texture.encode_colour(one[:, :, :3]), 1, 1)[0, 0, :3].astype(int) - one[0, 0, :3]).max() <= 4
    white = np.full((4, 4, 3), 255, np.uint8)
    assert (texture.decode_colour(texture.encode_colour(white), 4, 4)[:, :, 3] == 255).all()


def test_mips_and_texture_files():
    assert texture.mip(np.full((3, 5), 77, np.uint8)).tolist() == [[77, 77]]
    assert texture.mip(np.array([[0, 255], [255, 0]], np.uint8)).tolist() == [[128]]
    assert texture.mip(np.array([[9]], np.uint8)).tolist() == [[9]]
    f = texture.texture_file([bytes(8), bytes(8)], 4, 4, "BC1")
    assert len(f) == 128 + 16 and f[:4] == b"DDS " and f[84:88] == b"DXT1"


def test_old_entropy_blocks():
    data = (b"abcd" * 50 + bytes(range(60))) * 3
    lits, tokens, lens, offs, extra, sizes, at, last = bytearray(), bytearray(), bytearray(), bytearray(), [], [], 0, 0
    for n, match, off in lz.sequences(data):
        lits += data[at : at + n]
        at += n + match
        if not match:
            break
        tokens.append(min(n, 15) << 4 | min(match - 4, 15))
        lens += lz.extended(n) + lz.extended(match - 4)
        offs.append(0 if off == last else off.bit_length())
        if off != last:
            extra.append(off - (1 << off.bit_length() - 1))
            sizes.append(off.bit_length() - 1)
        last = off
    bits = huffman.write_bits(np.array(extra), np.array(sizes))
    block = b"".join(len(x).to_bytes(4, "little") for x in (lits, tokens, lens, bits)) + b"".join(bytes([0]) + len(s).to_bytes(4, "little") + s for s in (lits, tokens, lens, offs)) + bits
    assert entropy.decode(block, len(data)) == data


def test_dictionary_training():
    samples = b"".join(b"\xc0\x01" + R.randbytes(30) + b"name_word_of_the_header_that_always_repeats_itself_in_every_message_" for _ in range(400))
    d = dictionary.train(samples, 1024)
    assert 64 <= len(d) <= 1024 and b"header_that_always" in d
    assert dictionary.train(b"abc", 64) == b"abc"


def clip_frame(t, w=72, h=40):
    y, x = np.mgrid[0:h, 0:w]
    luma = (np.sin((x + 3 * t) / 9) * 50 + np.cos((y + t) / 7) * 40 + 120).clip(0, 255).astype(np.uint8)
    luma[10:20, 5 + t * 2 : 15 + t * 2] = 230
    return [luma, np.full((h // 2, w // 2), 100 + t, np.uint8), np.full((h // 2, w // 2), 140, np.uint8)]


@pytest.mark.parametrize(("quality", "least"), [(40, 28), (90, 36)])
def test_video_decoder_shows_what_the_encoder_saw(quality, least):
    enc, dec = video.Session(72, 40), video.Session(72, 40)
    packets = []
    for t in range(14):
        packets.append(enc.encode(clip_frame(t), quality, interval=5))
        shown = dec.decode(packets[-1])
        assert all((a == b).all() for a, b in zip(shown, enc.visible(), strict=True))
        assert texture.psnr(clip_frame(t)[0], shown[0]) > least
    assert [chr(p[2]) for p in packets] == ["I" if t % 5 == 0 else "P" for t in range(14)]
    fresh = video.Session(72, 40)
    with pytest.raises(CorruptData):
        fresh.decode(packets[1])
    fresh.decode(packets[5])
    with pytest.raises(CorruptData):
        fresh.decode(packets[6][:-1])
    with pytest.raises(CorruptData):
        fresh.decode(packets[7])
    fresh.decode(packets[10])
    for i in range(200):
        d = bytearray(packets[i % 14])
        d[R.randrange(len(d))] ^= 1 << R.randrange(8)
        try:
            video.Session(72, 40).decode(bytes(d))
        except CorruptData:
            pass


def test_video_parts():
    assert video.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(video.ZIGZAG.tolist()) == list(range(64))
    assert np.allclose(video.BASIS @ video.BASIS.T, np.eye(8))
    r = np.random.default_rng(1).integers(-200, 200, (50, 8, 8))
    back = video.inverse(np.rint(video.forward(r)).astype(int), np.ones(64, int))
    assert np.abs(back - r).max() <= 2
    levels = np.zeros(64, int)
    levels[[0, 9, 63]] = 5, -300, 8
    coded = video.put_levels(levels)
    assert dict(video.take_levels(coded, 0)[0]) == {0: 5, 9: -300, 63: 8}
    for d in (0, -127, 127, 128, -128, 255, -300):
        assert video.take_vector(video.put_vector(d), 0)[0] == d
    for n in (0, 127, 128, 1 << 20):
        assert video.take_number(video.put_number(n), 0)[0] == n
    with pytest.raises(ValueError):
        video.Session(71, 40)


def _mixed(seed: int, n: int) -> bytes:
    r = random.Random(seed)
    words = [bytes(r.randrange(97, 123) for _ in range(r.randint(2, 9))) for _ in range(300)]
    return b" ".join(r.choice(words) for _ in range(n))


@pytest.mark.parametrize("commands", [False, True])
def test_entropy3_round_trips(commands):
    r = random.Random(5)
    pixels = bytes(x for i in range(9000) for x in (i % 7 * 3, i // 50 % 256, i * i % 5))
    noise = bytes(r.randrange(256) for _ in range(3000))
    ramp = bytes((i // 3 + (i % 3) * 40 + (r.randrange(3) if i % 17 == 0 else 0)) & 255 for i in range(40_000))
    far = noise * 3 + _mixed(2, 9000) + noise
    for data in (b"", b"a", b"ab" * 300, noise, pixels, ramp, far, _mixed(1, 60_000) + pixels * 4):
        coded = entropy3.encode(data, commands=commands)
        assert entropy3.decode(coded, len(data)) == data
        assert len(data) < 5000 or data is noise or len(coded) < len(data)
        if len(data) > 20:
            assert entropy.decode(coded, len(data)) == data and coded[3] >> 6 == 3
    scaled = entropy3.encode(pixels)
    assert scaled[23] & 127 in range(1, 65)


def test_entropy3_regions_and_modes():
    text, r = _mixed(3, 60_000), random.Random(6)
    data = text + bytes(r.randrange(256) for _ in range(300_000)) + text[::-1]
    edges = [0, len(text), len(text) + 300_000, len(data)]
    split = entropy3.write_regions(data, [0, edges[1], len(data)])
    assert split[0] & 15 == entropy3.REGIONAL and len(split) < len(entropy3.write_stream(data))
    assert entropy3.read_stream(split[0] & 15, split[0] >> 4, split[5:], len(data)) == data
    flat = np.frombuffer(text[:30_000], np.uint8)
    smooth = np.arange(30_000).astype(np.uint8)
    noise = np.frombuffer(data[edges[1] : edges[1] + 30_000], np.uint8)
    modes, _ = entropy3.chunk_modes([(flat, noise), (noise, smooth % 3), (noise, noise)])
    assert modes[0][1] == 0 and modes[0][0] != entropy3.RAW and modes[1] in ((entropy3.PLAIN, 1), (entropy3.CONTEXT, 1)) and modes[2][0] == entropy3.RAW
    tables = [np.array([r.choice([0, 0, 0, 3, 7, 11]) for _ in range(256)], np.uint8) for _ in range(16)]
    tables[3][:] = 0
    back, at = entropy3.read_tables(b"x" + entropy3.write_tables(tables), 1, 16)
    assert all((a == b).all() for a, b in zip(tables, back, strict=True)) and at == 1 + len(entropy3.write_tables(tables))


def test_entropy3_damage_never_escapes():
    r, data = random.Random(7), _mixed(4, 3000)
    good = entropy3.encode(data, commands=True)
    for i in range(300):
        bad = bytearray(good)
        bad[r.randrange(len(bad))] ^= 1 << r.randrange(8)
        bad = bytes(bad[: r.randrange(len(bad))]) if i % 3 == 0 else bytes(bad)
        try:
            assert len(entropy3.decode(bad, len(data))) == len(data)
        except CorruptData:
            pass


def test_best_scale_is_the_cheapest():
    r = random.Random(8)
    off = np.array([r.randrange(1, 30_000) * 12 for _ in range(2000)])
    assert entropy3.best_scale(off, np.zeros(3, np.int64)) in (6, 12) and entropy3.best_scale(off * 0 + r.randrange(1, 9) * 2 + 1, np.zeros(3, np.int64)) >= 1
    odd = np.array([r.randrange(1, 60_000) for _ in range(2000)])
    assert entropy3.best_scale(odd, np.zeros(3, np.int64)) == 1
    for s in (1, 3, 12, 64):
        symbol, value = entropy3.offset_symbols(off, s)
        for o, c, v in zip(off.tolist(), symbol.tolist(), value.tolist(), strict=True):
            top, factor = entropy3.offset_of(c, s)
            assert (v if top < 0 else top << 8 | v & 255) * factor == o


def test_parses():
    r = random.Random(9)
    noise = bytes(r.randrange(256) for _ in range(30_000))
    for data in (b"", b"short", _mixed(5, 2000), b"abcd" * 2000 + _mixed(6, 500), noise + noise):
        greedy = len(lz.encode(data))
        for way in (parse.skipping(data), parse.lazy(data, 4), parse.lazy(data, 32), parse.cheapest(data), parse.repriced(data)):
            way = list(way)
            assert sum(n + m for n, m, _ in way) == len(data) and lz.decode(lz.write(data, way), len(data)) == data
        best = len(lz.write(data, parse.cheapest(data, 64)))
        assert best <= greedy + 1 and best <= len(lz.write(data, parse.lazy(data, 64))) + 1
    assert len(lz.write(noise + noise, parse.lazy(noise + noise))) < 0.6 * 2 * len(noise)
    assert parse.incompressible(noise, 4096) and not parse.incompressible(noise[:9000], 4096) and not parse.incompressible(_mixed(5, 9000), 4096)


def test_cheapest_parse_against_every_parse():
    data = b"abababcabababcxabababcabab" + b"z" * 12

    def brute(p: int, done: int) -> int:
        if p == len(data):
            return 8 * 16 * (p - done)
        best = brute(p + 1, done)
        if p < len(data) - lz.TAIL:
            for q in range(p):
                n = lz.common(data, q, p, len(data) - 5 - p)
                for m in range(4, n + 1):
                    best = min(best, 128 * (p - done) + 128 + 256 + 128 * max(0, (m - 19) // 255 + 1 if m >= 19 else 0) + brute(p + m, p + m))
        return best

    price = sum(128 * n + (128 + 256 + (128 if m >= 19 else 0) if m else 0) for n, m, _ in parse.cheapest(data, 1000))
    assert price == brute(0, 0)


def test_longer_matches_are_the_records():
    data = _mixed(11, 400)
    before = parse.earlier(data)
    for p in range(0, len(before), 7):
        best, want = 0, []
        for q in range(p - 1, -1, -1):
            n = lz.common(data, q, p, len(data) - p)
            if n >= 4 and n > best:
                best = n
                want.append((n, p - q))
        assert list(parse.longer_matches(data, before, p, 10_000, len(data))) == want


def test_partition_patterns_have_their_checksum(spark):
    """Fixed value: the checksum of the two-part patterns of the format."""
    from blockwright.operators import texels

    assert {r["parts"]: r["checksum"] for r in texels.partition_checksum(spark, "").collect()}[2] == 0x5D5FC459


def test_colour_ranges_are_even(spark):
    from blockwright.operators import texels

    by = {}
    for r in texels.colour_ranges(spark, "").collect():
        by.setdefault(r["levels"], []).append(r["wide"])
    for n, wide in by.items():
        assert max(abs(a - i * 255 / (n - 1)) for i, a in enumerate(sorted(wide))) < 1.5 and len(set(wide)) == n


def test_two_means_by_hand():
    from blockwright.functions.astc import two_means

    px = np.zeros((1, 16, 3))
    px[0, 5:9] = 200
    px[0, 12] = 180
    assert two_means(px).tolist() == [sum(1 << i for i in (5, 6, 7, 8, 12))] and two_means(np.full((1, 16, 3), 9.0)).tolist() == [0]


def _smooth_blocks(seed, n, alpha):
    r = np.random.default_rng(seed)
    y, x = np.mgrid[0:4, 0:4]
    px = np.zeros((n, 16, 4))
    for k in range(n):
        for c in range(4):
            px[k, :, c] = (r.uniform(0, 255) + r.uniform(-20, 20) * x + r.uniform(-20, 20) * y + r.uniform(-4, 4, (4, 4))).ravel()
        if k % 3 == 0:  # two colours
            side = bc7._SECOND[r.integers(64)]
            px[k, side, :3] = px[k, side][:, :3] * 0.2 + r.uniform(0, 200, 3)
    px = np.clip(np.rint(px), 0, 255)
    if not alpha:
        px[:, :, 3] = 255
    return px


@pytest.mark.parametrize("alpha", [False, True])
def test_bc7_quality_and_modes(alpha):
    px = _smooth_blocks(3, 120, alpha)
    coded = bc7.encode(px)
    back = bc7.decode(coded).astype(float)
    used = {next(k for k in range(8) if coded[i] >> k & 1) for i in range(0, len(coded), 16)}
    assert len(coded) == 16 * len(px) and used == ({5, 6} if alpha else {1, 6})
    assert 10 * np.log10(65025 / ((back - px) ** 2).mean()) > (31 if alpha else 36)
    flat = np.full((1, 16, 4), [10, 200, 30, 255.0])
    assert np.abs(bc7.decode(bc7.encode(flat)) - flat).max() <= 1
    assert not bc7.decode(bytes(16)).any()


def test_bc7_tables_and_all_modes():
    for row in bc7.THREE:
        assert len(row) == 16 and row[0] == "0" and set(row) <= set("012")
    for k, mask in enumerate(bc7.TWO):
        assert not mask & 1 and mask >> bc7.ANCHOR_TWO[k] & 1
    for k, row in enumerate(bc7.THREE):
        assert row[bc7.ANCHOR_THREE[0][k]] == "1" and row[bc7.ANCHOR_THREE[1][k]] == "2"
    for m in bc7.MODES:  # every mode fills its block
        number = bc7.MODES.index(m)
        ends = 2 * m.parts
        bits = number + 1 + m.partition + m.rotation + m.selection + ends * (3 * m.colour + m.alpha) + ends * m.by_end + m.parts * m.by_part
        bits += 16 * m.index - m.parts + (16 * m.second - 1 if m.second else 0)
        assert bits == 128
    r = np.random.default_rng(1)
    for number in range(8):
        block = bytearray(r.integers(0, 256, 16, np.uint8).tobytes())
        block[0] = block[0] >> number + 1 << number + 1 | 1 << number if number < 7 else 128
        assert bc7.decode_block(bytes(block)).shape == (16, 4)


def test_partition_estimates_by_hand():
    px = _smooth_blocks(9, 5, False)[:, :, :3]
    got = bc7.partition_estimates(px)
    for k in range(5):
        for m in range(0, 64, 5):
            want = 0.0
            for own in (bc7._SECOND[m], ~bc7._SECOND[m]):
                part = px[k, own]
                want += (np.linalg.svd(part - part.mean(0), compute_uv=False)[1:] ** 2).sum()
            assert got[k, m] == pytest.approx(want, abs=1e-6)


def test_hdr_blocks():
    r = np.random.default_rng(4)
    t = r.uniform(0, 1, (60, 16, 1))
    a, b = np.exp2(r.uniform(-6, 6, (60, 1, 3))), np.exp2(r.uniform(-6, 6, (60, 1, 3)))
    half = hdr.to_half(a) * (1 - t) + hdr.to_half(b) * t
    px = hdr.from_half(np.rint(half).astype(np.int64))
    back = hdr.decode(hdr.encode(px))
    assert np.median(np.abs(np.log2(back / px))) < 0.06 and np.abs(np.log2(back / px)).max() < 1.2
    assert not hdr.decode(bytes(16)).any() and hdr.decode(b"").shape == (0, 16, 3)
    f = np.array([0.0, -1.0, np.nan, 1e9, 65504.0, 1.0, 2.0**-24, 2.0**-15, 1 + 2.0**-11, 0.05])
    want = [0, 0, 0, 0x7BFF, 0x7BFF, 0x3C00, 1, 512, 0x3C01, int(np.float16(0.05).view(np.uint16))]
    assert hdr.to_half(f).tolist() == want and (hdr.from_half(hdr.to_half(f[4:9])) == [65504.0, 1.0, 2.0**-24, 2.0**-15, 1 + 2.0**-10]).all()
    assert (hdr.wide(hdr.endpoint(hdr.wide(np.arange(1024)))) == hdr.wide(np.arange(1024))).all()


def test_integer_sequences():
    r = random.Random(3)
    for k in astc.RANGES:
        for n in range(1, 17):
            v = [r.randrange(k.levels) for _ in range(n)]
            number = astc.put_sequence(v, k)
            assert number.bit_length() <= k.size(n) and astc.take_sequence(number, n, k) == v
    assert len(astc._PACKED_TRITS) == 243 and len(astc._PACKED_QUINTS) == 125
    assert all(set(astc.trits(t)) <= {0, 1, 2} for t in range(256)) and all(set(astc.quints(q)) <= set(range(5)) for q in range(128))


def test_astc_recorded_values():
    """The checksum of the two-part patterns, and a block of one colour."""
    h = 2166136261
    for s in range(1024):
        for p in astc.pattern(s, 2):
            h = (h ^ p) * 16777619 & 0xFFFFFFFF
    assert h == 0x5D5FC459
    block = bytes([0xFC, 0xFD, 0xFF, 0xFF, 0xFF, 0xFF, 0xFF, 0xFF, 0x00, 0x40, 0x00, 0x80, 0x00, 0xC0, 0xFF, 0xFF])
    assert (astc.decode_block(block) == [0x40, 0x80, 0xC0, 0xFF]).all()
    assert (astc.decode_block(bytes(16)) == astc.MAGENTA).all() and astc.decode(b"").shape == (0, 16, 4)


@pytest.mark.parametrize("alpha", [False, True])
def test_astc_quality(alpha):
    px = _smooth_blocks(5, 90, alpha)
    coded = astc.encode(px)
    back = astc.decode(coded).astype(float)
    parts = [(coded[i + 1] >> 3 & 3) + 1 for i in range(0, len(coded), 16)]
    assert len(coded) == 16 * len(px) and {p for p, x in zip(parts, px, strict=True) if (x[:, 3] < 255).any()} <= {1} and (alpha or 2 in parts)
    assert 10 * np.log10(65025 / ((back - px) ** 2).mean()) > (28 if alpha else 33)
    flat = np.full((1, 16, 4), [10, 200, 30, 255.0])
    assert np.abs(astc.decode(astc.encode(flat)) - flat).max() <= 4
    if not alpha:
        assert (back[:, :, 3] == 255).all()


def test_turbo_near_offsets_in_table_commands():
    """A hand-built block: two table commands of 16 literals and a match of 32 bytes. Offsets below 16 are refused."""
    for off in range(17):
        word = 16 | 28 << 5 | 1 << 10
        head = (2).to_bytes(4, "little") + (2).to_bytes(4, "little") + bytes(4) + bytes([1]) + word.to_bytes(2, "little")
        literals = bytes((i * 7 + 1) & 255 for i in range(72))
        block = head + bytes([0, 0, off, off]) + literals
        if off < 16:
            with pytest.raises(CorruptData):
                turbo.decode(block, 136)
        else:
            first = literals[:16] * 3
            second = literals[16:32] * 3
            assert turbo.decode(block, 136) == first + second + literals[32:]


def test_arrivals_make_use_of_repeat_offsets():
    r = random.Random(12)
    records = b"".join(b"id=%d;x=%d;name=%s\n" % (i, r.randrange(9), r.choice([b"ann", b"bob", b"cy"])) for i in range(90))
    prices = parse.Prices()
    for data in (b"", b"a", b"abcd" * 9, records, _mixed(13, 150)):
        cost = []
        for keep in (1, 2, 4, 16):
            way = parse.arrivals(data, 16, prices, keep)
            assert sum(n + m for n, m, _ in way) == len(data) and lz.decode(lz.write(data, way), len(data)) == data
            assert entropy3.decode(entropy3.encode(data, iter(way), commands=keep > 2), len(data)) == data
            cost.append(parse.parse_price(data, way, prices))
        assert cost[-1] <= cost[0] and cost[-1] <= parse.parse_price(data, list(parse.lazy(data)), prices)
    best = parse.parse_price(records, parse.arrivals(records, 16, prices, 16), prices)
    assert best < 0.97 * parse.parse_price(records, parse.cheapest(records, 16, prices), prices)


def test_parse_price_by_hand():
    data = b"abcdefgh" + b"abcdefgh" + b"xy" + b"abcdefgh" + b"tail of the data"
    way = [(8, 8, 8), (2, 8, 10), (16, 0, 0)]
    p = parse.Prices()
    assert parse.parse_price(data, way, p) == 26 * 128 + 2 * 128 + 2 * 256
    assert parse.parse_price(data, [(8, 8, 8), (2, 4, 10), (0, 4, 10), (16, 0, 0)], p) == 26 * 128 + 3 * 128 + 2 * 256 + parse.REPEAT


def test_rated_levels():
    r = np.random.default_rng(6)
    coefs = r.laplace(0, 12, (200, 64)) * np.linspace(3, 0.2, 64)[np.argsort(video.ZIGZAG)]
    step, costs = np.full((1, 64), 10.0), np.full(256, 6.0)
    plain = np.rint(coefs / step).astype(np.int64)

    def total(levels, price):
        bits = sum(costs[list(video.put_levels(x))].sum() if x.any() else 0.0 for x in levels)
        return ((coefs - levels * step) ** 2).sum() + price * bits, bits

    for price in (0.0, 12.0, 60.0):
        got, own = video.rated(coefs, step, price, costs)
        assert (np.abs(got) <= np.abs(plain)).all() and total(got, price)[0] <= total(plain, price)[0] + 1e-6
        assert price or (got == plain).all()
    assert total(got, 60.0)[1] < 0.8 * total(plain, 60.0)[1]
    again = video.learned(costs, bytes([3]) * 900 + bytes(range(100)))
    assert again[3] == 1 and again[200] > 9 and (video.learned(costs, b"short") == costs).all()


def test_rate_choices_save_bits_at_equal_quality():
    y = np.add.outer(np.arange(64) * 3, np.arange(96) * 2)
    r = np.random.default_rng(2)
    clip = [[np.clip(np.roll(y, 3 * t, 1) % 230 + r.integers(0, 9, y.shape), 0, 255).astype(np.uint8), *(np.full((32, 48), 120, np.uint8) for _ in "uv")] for t in range(5)]

    def run(quality):
        enc, dec, size, quality_ = video.Session(96, 64), video.Session(96, 64), 0, []
        for f in clip:
            packet = enc.encode(f, quality, interval=5)
            shown = dec.decode(packet)
            assert all((a == b).all() for a, b in zip(shown, enc.visible(), strict=True))
            size += len(packet)
            quality_.append(texture.psnr(shown[0], f[0]))
        return size, np.mean(quality_)

    before, video.LAMBDA = video.LAMBDA, 0.0
    try:
        plain = run(60)
    finally:
        video.LAMBDA = before
    ours = [run(q) for q in (60, 64, 68, 72, 76)]
    assert ours[0][0] < plain[0] and min(s for s, q in ours if q >= plain[1] - 0.05) < plain[0]


def test_two_halves_are_the_plain_blocks_without_a_price():
    from blockwright.plans import jobs

    y, x = np.mgrid[0:18, 0:22]
    image = (np.stack([x * 9, y * 11, x * y, 255 - x * 7], 2) % 256).astype(np.uint8)
    assert jobs.ENCODERS["BC3"](image, 0.0) == texture.encode_colour_alpha(image) and jobs.ENCODERS["BC5"](image, 0.0) == texture.encode_two(image)
    less = jobs.ENCODERS["BC5"](image, 50.0)
    assert texture.decode_two(less, 22, 18).shape == (18, 22, 2) and less != texture.encode_two(image)


def test_prices_by_region():
    r = random.Random(15)
    text, digits = _mixed(16, 900), bytes(r.choice(b"0123456789") for _ in range(6000))
    data = text + digits
    way = list(parse.lazy(data))
    size = len(text)
    first, second = (parse.region_prices(data, way, size) + [None])[:2]
    assert first.literal[ord("e")] < second.literal[ord("e")] and second.literal[ord("7")] < first.literal[ord("7")]
    whole = parse.prices_of(data, way)
    assert second.literal[48:58].mean() <= whole.literal[48:58].mean()
    ours = parse.cheapest(data, 16, parse.region_prices(data, way, size), size)
    assert lz.decode(lz.write(data, ours), len(data)) == data
    assert parse.region_prices(b"", [(0, 0, 0)])[0].literal[0] == 128
    pixels = bytes((i // 3 * 7 + (i % 3) * 50 + r.randrange(2)) & 255 for i in range(6000))
    strided = [(3, 4, 3)] + [(60, 4, 3)] * ((len(pixels) - 7) // 64)
    rest = len(pixels) - sum(n + m for n, m, _ in strided)
    assert parse.delta_regions(pixels, [*strided, (rest, 0, 0)], 3000) == [True, True]
    assert not any(parse.delta_regions(text, list(parse.lazy(text)), 2000))
