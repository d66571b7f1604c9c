"""Block textures: field planes, decoding of the simple formats, encoding of single channels. Arrays run over all blocks."""

from __future__ import annotations

import numpy as np

#: Fixed values of the formats: widths of the fields of a block, in bytes.
FIELDS = {"BC1": (4, 4), "BC3": (2, 6, 4, 4), "BC4": (2, 6), "BC5": (2, 6, 2, 6), "BC7": (8, 1, 7)}


def block_bytes(kind: str) -> int:
    return sum(FIELDS[kind])


def split(data: bytes, kind: str) -> bytes:
    """All first fields of the blocks, then all second ones, and so on; a rest shorter than a block stays at the end."""
    n = block_bytes(kind)
    whole = len(data) // n * n
    rows = np.frombuffer(data, np.uint8, whole).reshape(-1, n)
    cut = np.cumsum((0, *FIELDS[kind]))
    return b"".join(rows[:, a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)) + data[whole:]


def merge(data: bytes, kind: str) -> bytes:
    """Undoes ``split``."""
    n = block_bytes(kind)
    count, at, fields = len(data) // n, 0, []
    for w in FIELDS[kind]:
        fields.append(np.frombuffer(data, np.uint8, count * w, at).reshape(count, w))
        at += count * w
    return np.hstack(fields).tobytes() + data[at:]


def blocks_of(image: np.ndarray) -> np.ndarray:
    """(blocks, 16) values of 4 x 4 blocks in raster order; edges repeat."""
    h, w = image.shape
    full = np.pad(image, ((0, -h % 4), (0, -w % 4)), mode="edge")
    return full.reshape(full.shape[0] // 4, 4, full.shape[1] // 4, 4).swapaxes(1, 2).reshape(-1, 16)


def image_of(blocks: np.ndarray, w: int, h: int) -> np.ndarray:
    bw, bh = -(-w // 4), -(-h // 4)
    return blocks.reshape(bh, bw, 4, 4).swapaxes(1, 2).reshape(bh * 4, bw * 4)[:h, :w]


def levels(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(blocks, 8) levels between two ends: 6 between them if the first is larger, else 4 and the extremes."""
    a, b = a.astype(np.int64)[:, None], b.astype(np.int64)[:, None]
    k6, k4 = np.arange(1, 7), np.arange(1, 5)
    six = ((7 - k6) * a + k6 * b + 3) // 7
    four = np.hstack([((5 - k4) * a + k4 * b + 2) // 5, np.zeros_like(a), np.full_like(a, 255)])
    return np.hstack([a, b, np.where(a > b, six, four)])


def encode_channel(image: np.ndarray, inset: int = 2) -> bytes:
    """Single-channel blocks. The ends of each block are tried up to ``inset`` steps inside its extremes."""
    px = blocks_of(image.astype(np.int64))
    hi, lo = px.max(1), px.min(1)
    best, ends, picks = np.full(len(px), np.iinfo(np.int64).max), np.zeros((len(px), 2), np.int64), np.zeros((len(px), 16), np.int64)
    for i in range(inset + 1):
        for j in range(inset + 1):
            a, b = np.maximum(hi - i, lo), np.minimum(lo + j, hi)
            ok = (a > b) | (hi == lo)
            d = np.abs(px[:, :, None] - levels(a, b)[:, None, :])
            pick = d.argmin(2)
            error = np.where(ok, (np.take_along_axis(d, pick[:, :, None], 2)[:, :, 0] ** 2).sum(1), np.iinfo(np.int64).max)
            win = error < best
            best = np.where(win, error, best)
            ends[win] = np.stack([a, b], 1)[win]
            picks[win] = pick[win]
    bits = (picks.astype(np.uint64) << (3 * np.arange(16, dtype=np.uint64))).sum(1, dtype=np.uint64)
    out = np.empty((len(px), 8), np.uint8)
    out[:, :2] = ends
    out[:, 2:] = (bits[:, None] >> (8 * np.arange(6, dtype=np.uint64)) & np.uint64(255)).astype(np.uint8)
    return out.tobytes()


def decode_channel(data: bytes, w: int, h: int) -> np.ndarray:
    """Pixels of single-channel blocks."""
    b = np.frombuffer(data, np.uint8).reshape(-1, 8)
    bits = (b[:, 2:].astype(np.uint64) << (8 * np.arange(6, dtype=np.uint64))).sum(1, dtype=np.uint64)
    pick = (bits[:, None] >> (3 * np.arange(16, dtype=np.uint64)) & np.uint64(7)).astype(np.int64)
    return image_of(np.take_along_axis(levels(b[:, 0], b[:, 1]), pick, 1), w, h).astype(np.uint8)


def decode_colour(data: bytes, w: int, h: int) -> np.ndarray:
    """(h, w, 4) pixels of 565 colour blocks: four colours if the first end is larger, else three and transparent black."""
    b = np.frombuffer(data, np.uint8).reshape(-1, 8).astype(np.int64)
    ends = b[:, 0:4:2] | b[:, 1:4:2] << 8
    r, g, c = ends >> 11, ends >> 5 & 63, ends & 31
    rgb = np.stack([r << 3 | r >> 2, g << 2 | g >> 4, c << 3 | c >> 2], 2)
    x, y = rgb[:, 0], rgb[:, 1]
    four = (ends[:, 0] > ends[:, 1])[:, None]
    palette = np.stack([x, y, np.where(four, (2 * x + y + 1) // 3, (x + y) // 2), np.where(four, (x + 2 * y + 1) // 3, 0)], 1)
    alpha = np.full((len(b), 4), 255)
    alpha[~four[:, 0], 3] = 0
    palette = np.concatenate([palette, alpha[:, :, None]], 2)
    bits = b[:, 4] | b[:, 5] << 8 | b[:, 6] << 16 | b[:, 7] << 24
    pick = bits[:, None] >> 2 * np.arange(16) & 3
    px = np.take_along_axis(palette, pick[:, :, None], 1)
    return np.stack([image_of(px[:, :, k], w, h) for k in range(4)], 2).astype(np.uint8)


def _palette(ends: np.ndarray) -> np.ndarray:
    """(blocks, 4, 3) colours between two 565 ends."""
    r, g, c = ends >> 11, ends >> 5 & 63, ends & 31
    rgb = np.stack([r << 3 | r >> 2, g << 2 | g >> 4, c << 3 | c >> 2], 2)
    x, y = rgb[:, 0], rgb[:, 1]
    return np.stack([x, y, (2 * x + y + 1) // 3, (x + 2 * y + 1) // 3], 1)


def _to_565(c: np.ndarray) -> np.ndarray:
    q = np.rint(np.clip(c, 0, 255) * np.array([31, 63, 31]) / 255).astype(np.int64)
    return q[..., 0] << 11 | q[..., 1] << 5 | q[..., 2]


def encode_colour(image: np.ndarray, rounds: int = 3) -> bytes:
    """565 colour blocks (always four colours) of an (h, w, 3) image.

    The ends start at the extremes of each block along its main axis (power iteration on the covariance) and are fitted
    again to the chosen levels by least squares while that helps. All blocks go through each step together.
    """
    px = np.stack([blocks_of(image[:, :, k].astype(np.float64)) for k in range(3)], 2)
    mean = px.mean(1, keepdims=True)
    d = px - mean
    cov = np.einsum("bpi,bpj->bij", d, d)
    axis = np.ones((len(px), 3)) + cov.sum(2) * 1e-3
    for _ in range(8):
        axis = np.einsum("bij,bj->bi", cov, axis)
        axis /= np.maximum(np.linalg.norm(axis, axis=1, keepdims=True), 1e-12)
    t = np.einsum("bpi,bi->bp", d, axis)
    ends = np.stack([mean[:, 0] + axis * t.max(1)[:, None], mean[:, 0] + axis * t.min(1)[:, None]], 1)
    weight = np.array([1, 0, 2 / 3, 1 / 3])
    best, best_ends, best_pick = np.full(len(px), np.inf), np.zeros((len(px), 2), np.int64), np.zeros((len(px), 16), np.int64)
    for _ in range(rounds):
        e = _to_565(ends)
        e = np.stack([e.max(1), e.min(1)], 1)
        flat = e[:, 0] == e[:, 1]  # four colours need a larger first end
        e[flat & (e[:, 0] < 0xFFFF), 0] += 1
        e[flat & (e[:, 1] == 0xFFFF), 1] -= 1
        err = ((px[:, :, None, :] - _palette(e)[:, None]) ** 2).sum(3)
        pick = err.argmin(2)
        total = np.take_along_axis(err, pick[:, :, None], 2)[:, :, 0].sum(1)
        win = total < best
        best, best_ends[win], best_pick[win] = np.where(win, total, best), e[win], pick[win]
        a = weight[pick]
        aa, ab, bb = (a * a).sum(1), (a * (1 - a)).sum(1), ((1 - a) ** 2).sum(1)
        det = aa * bb - ab * ab
        ax, bx = np.einsum("bp,bpi->bi", a, px), np.einsum("bp,bpi->bi", 1 - a, px)
        ok = np.abs(det) > 1e-9
        safe = np.where(ok, det, 1)[:, None]
        fit = np.stack([(bb[:, None] * ax - ab[:, None] * bx) / safe, (aa[:, None] * bx - ab[:, None] * ax) / safe], 1)
        ends = np.where(ok[:, None, None], fit, ends)
    out = np.zeros((len(px), 8), np.uint8)
    out[:, 0:4:2], out[:, 1:4:2] = best_ends & 255, best_ends >> 8
    bits = (best_pick << 2 * np.arange(16)).sum(1)
    out[:, 4:] = bits[:, None] >> 8 * np.arange(4) & 255
    return out.tobytes()


def encode_colour_alpha(image: np.ndarray) -> bytes:
    """Blocks of an (h, w, 4) image: alpha as a single channel, then colours."""
    a = np.frombuffer(encode_channel(image[:, :, 3]), np.uint8).reshape(-1, 8)
    c = np.frombuffer(encode_colour(image[:, :, :3]), np.uint8).reshape(-1, 8)
    return np.hstack([a, c]).tobytes()


def decode_colour_alpha(data: bytes, w: int, h: int) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).reshape(-1, 16)
    out = decode_colour(b[:, 8:].tobytes(), w, h)
    out[:, :, 3] = decode_channel(b[:, :8].tobytes(), w, h)
    return out


def encode_two(image: np.ndarray) -> bytes:
    """Blocks of two single channels (normal maps)."""
    return np.hstack([np.frombuffer(encode_channel(image[:, :, k]), np.uint8).reshape(-1, 8) for k in range(2)]).tobytes()


def decode_two(data: bytes, w: int, h: int) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).reshape(-1, 16)
    return np.stack([decode_channel(b[:, 8 * k : 8 * k + 8].tobytes(), w, h) for k in range(2)], 2)


#: Earlier blocks whose fields a block may repeat.
BAND = 16


def cheaper(data: bytes, image: np.ndarray, kind: str, price: float) -> bytes:
    """Blocks (BC1 or BC4) that repeat fields of one of the BAND blocks before them where that is worth it: the least sum of squared
    error and ``price`` for each byte. A field costs nothing if it repeats from as far back as the last one did, up to 3 bytes if it
    repeats from elsewhere in the band, else all of its bytes."""
    if not price:
        return data
    first, size = FIELDS[kind][0], block_bytes(kind)
    one = kind == "BC4"
    px = np.stack([blocks_of(image[:, :, k].astype(np.int64)) for k in range(1 if one else 3)], 2)
    out: list[bytes] = []
    back = [0, 0]
    for i in range(len(data) // size):
        own = data[i * size : (i + 1) * size]
        band = out[: -BAND - 1 : -1]
        options = list(dict.fromkeys([own, *(x for b in band for x in (own[:first] + b[first:], b[:first] + own[first:], b))]))
        joined = b"".join(options)
        if one:
            seen = blocks_of(decode_channel(joined, 4 * len(options), 4).astype(np.int64))[:, :, None]
        else:
            wide = decode_colour(joined, 4 * len(options), 4).astype(np.int64)
            seen = np.stack([blocks_of(wide[:, :, k]) for k in range(3)], 2)
        error = ((seen - px[i]) ** 2).sum((1, 2))
        near: list[dict[bytes, int]] = [{}, {}]
        for far, b in enumerate(band, 1):
            near[0].setdefault(b[:first], far)
            near[1].setdefault(b[first:], far)
        best, chosen = None, None
        for x, e in zip(options, error.tolist(), strict=True):
            places = [near[0].get(x[:first], 0), near[1].get(x[first:], 0)]
            rate = sum(n if not d else 0 if d == b else min(n, 3) for d, b, n in zip(places, back, (first, size - first), strict=True))
            if best is None or e + price * rate < best:
                best, chosen = e + price * rate, (x, places)
        out.append(chosen[0])
        back = [d or b for d, b in zip(chosen[1], back, strict=True)]
    return b"".join(out)


def to_linear(v: np.ndarray) -> np.ndarray:
    """sRGB values of 0 to 255 as linear light of 0 to 1."""
    c = v / 255.0
    return np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)


def mip(image: np.ndarray, srgb: bool = False) -> np.ndarray:
    """The next smaller level of 8-bit pixels: rounded means of 2 x 2; an odd last row or column is dropped, one stays one.

    ``srgb``: the first three channels are averaged in linear light; where that rounds up to the next value is the light
    of the middle between both. Alpha is always linear.
    """
    h, w = image.shape[:2]
    y, x = np.arange(max(h // 2, 1)) * 2, np.arange(max(w // 2, 1)) * 2
    four = [image[np.minimum(y + a, h - 1)[:, None], np.minimum(x + b, w - 1)[None]] for a in (0, 1) for b in (0, 1)]
    out = (sum(p.astype(np.int64) for p in four) + 2) >> 2
    if srgb:
        light = sum(to_linear(p[..., :3].astype(np.float64)) for p in four) / 4
        edges = to_linear(np.arange(255) + 0.5)
        out[..., :3] = np.searchsorted(edges, light, "right")
    return out.astype(np.uint8)


#: Fixed values of the format: name of each kind of block in a texture file, its number in the extended header, bytes of a block.
FOUR_CC = {"BC1": b"DXT1", "BC3": b"DXT5", "BC4": b"BC4U", "BC5": b"BC5U"}
EXTENDED = {"BC1": 71, "BC3": 77, "BC4": 80, "BC5": 83, "BC6H": 95, "BC7": 98}
BLOCK_BYTES = {"BC1": 8, "BC3": 16, "BC4": 8, "BC5": 16, "BC6H": 16, "BC7": 16}


def header(w: int, h: int, kind: str, levels: int, srgb: bool = False) -> bytes:
    """What stands before the levels of a DDS file; kinds without a name of their own, and sRGB ones, have the extended header."""
    import struct

    srgb = srgb and kind not in ("BC4", "BC5")  # channels are never sRGB
    mips, extended = levels > 1, kind not in FOUR_CC or srgb
    flags = 0x1007 | 0x80000 | (0x20000 if mips else 0)
    first = -(-w // 4) * -(-h // 4) * BLOCK_BYTES[kind]
    head = struct.pack("<4s7I44x", b"DDS ", 124, flags, h, w, first, 0, levels)
    form = struct.pack("<2I4s5I", 32, 4, b"DX10" if extended else FOUR_CC[kind], 0, 0, 0, 0, 0)
    more = struct.pack("<5I", EXTENDED[kind] + (srgb and kind in ("BC1", "BC3", "BC7")), 3, 0, 1, 0) if extended else b""
    return head + form + struct.pack("<5I", 0x1000 | (0x400008 if mips else 0), 0, 0, 0, 0) + more


def texture_file(levels: list[bytes], w: int, h: int, kind: str, srgb: bool = False) -> bytes:
    """A DDS file of block data with its mip levels."""
    return header(w, h, kind, len(levels), srgb) + b"".join(levels)


def psnr(a: np.ndarray, b: np.ndarray) -> float:
    """Peak signal to noise ratio of 8-bit values, 99 without an error."""
    se = float(((a.astype(np.int64) - b.astype(np.int64)) ** 2).sum())
    return 99.0 if se == 0 else 10 * float(np.log10(65025 * a.size / se))
