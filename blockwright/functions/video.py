"""Video packets: 16 x 16 macroblocks that are skipped, predicted with a half-pixel vector, or coded by themselves.

A packet: header, slice table, and three streams (modes, vectors, coefficients), each stored, plain or Huffman coded.
Prediction reads the frame before only, so a frame is parsed first and then rebuilt for all its blocks together; edges
are read by clamping coordinates. The inverse transform is exact in integers.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

from blockwright.functions import CorruptData, huffman, lz

#: Fixed values of the format: header, modes, padding around a frame, largest vector, limits of slices.
MAGIC, HEADER, VERSION = b"ZV", 36, 1
SKIP, INTER, INTRA = range(3)
PAD, REACH = 32, 128
MOST_SLICES = 64
STORED, PLAIN, CODED = range(3)

#: The luminance and chrominance steps of the common still-image standard.
LUMINANCE = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMINANCE = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    *(99,) * 32,
)

_K = np.arange(8)
BASIS = np.sqrt(np.where(_K == 0, 1 / 8, 1 / 4))[:, None] * np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16)
EXACT = np.rint(4096 * BASIS).astype(np.int64)
#: Positions in zigzag order: along the antidiagonals, upwards on even ones.
ZIGZAG = np.array([r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))])


def steps(quality: int) -> np.ndarray:
    """(3, 64) steps: luminance and chrominance of blocks by themselves, and predicted blocks (flat)."""
    q = min(max(quality, 1), 100)
    scale = 5000 // q if q < 50 else 200 - 2 * q
    base = np.array([LUMINANCE, CHROMINANCE, (16,) * 64])
    return np.clip((base * scale + 50) // 100, 1, 255)


def inverse(levels: np.ndarray, step: np.ndarray) -> np.ndarray:
    """(n, 8, 8) residuals of (n, 64) levels."""
    c = np.clip(levels.astype(np.int64) * step, -4095, 4095).reshape(-1, 8, 8)
    rows = np.clip((c @ EXACT + 512) >> 10, -32768, 32767)
    rows[~c.any(2)] = 0
    return (EXACT.T @ rows + 8192) >> 14


def forward(residual: np.ndarray) -> np.ndarray:
    """(n, 64) coefficients of (n, 8, 8) residuals."""
    return (BASIS @ residual.astype(np.float64) @ BASIS.T).reshape(-1, 64)


def predict(plane: np.ndarray, x: np.ndarray, y: np.ndarray, vx: np.ndarray, vy: np.ndarray, n: int) -> np.ndarray:
    """(blocks, n, n) pixels at (x, y) moved by half-pixel vectors; bilinear, rounded."""
    h, w = plane.shape
    ix, iy, fx, fy = vx >> 1, vy >> 1, vx & 1, vy & 1
    i = np.arange(n + 1)
    cy = np.clip((y + iy)[:, None] + i, 0, h - 1)
    cx = np.clip((x + ix)[:, None] + i, 0, w - 1)
    p = plane[cy[:, :, None], cx[:, None, :]].astype(np.int64)
    a, b, c, d = p[:, :-1, :-1], p[:, :-1, 1:], p[:, 1:, :-1], p[:, 1:, 1:]
    fx, fy = fx[:, None, None] > 0, fy[:, None, None] > 0
    return np.where(fx & fy, (a + b + c + d + 2) >> 2, np.where(fx, (a + b + 1) >> 1, np.where(fy, (a + c + 1) >> 1, a)))


def vector_range(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest half-pixel vector of macroblocks at a coordinate."""
    return np.maximum(2 * (2 - PAD - at), -REACH), np.minimum(2 * (size + PAD - 19 - at), REACH)


def put_number(v: int) -> bytes:
    """A count in groups of seven bits, low ones first."""
    out = bytearray()
    while v >= 0x80:
        out.append(v & 0x7F | 0x80)
        v >>= 7
    return bytes(out + bytes([v]))


def take_number(src: bytes, at: int) -> tuple[int, int]:
    v = 0
    for shift in range(0, 35, 7):
        if at >= len(src):
            raise CorruptData("number cut short")
        v |= (src[at] & 0x7F) << shift
        at += 1
        if not src[at - 1] & 0x80:
            return v, at
    raise CorruptData("number too long")


def put_levels(levels: np.ndarray) -> bytes:
    """Runs of zeros and levels of a block in zigzag order, then the end mark."""
    z = levels[ZIGZAG]
    out, last = bytearray(), -1
    for i in np.flatnonzero(z).tolist():
        run, v = i - last - 1, int(z[i])
        last = i
        if run < 8 and -8 <= v <= 8:
            out.append(run << 4 | (v + 8 if v < 0 else v + 7))
        else:
            out += bytes([0x81 + run]) + struct.pack("<h", v)
    return bytes(out) + b"\x80"


def token_bits(run: np.ndarray, level: np.ndarray, costs: np.ndarray) -> np.ndarray:
    """Bits of a run and a level by what each byte of the coefficient stream costs; long ones take two more bytes."""
    short = (run < 8) & (np.abs(level) <= 8)
    byte = np.where(short, np.clip(run, 0, 7) << 4 | np.where(level < 0, level + 8, level + 7) & 15, 0x81 + run)
    return costs[byte] + np.where(short, 0, 16)


def rated(coefs: np.ndarray, step: np.ndarray, price: float, costs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(levels, price) of blocks of coefficients (n, 64): the least of squared error and ``price`` for each bit.

    From the last coefficient to the first, each level may fall by one or to nothing (whose run then joins the next one's); at last
    a block may be dropped. All blocks take each step together.
    """
    size = np.abs(coefs / step)[:, ZIGZAG]
    sign = np.where(coefs[:, ZIGZAG] < 0, -1, 1)
    worth = np.broadcast_to(np.asarray(step, np.float64) ** 2, coefs.shape)[:, ZIGZAG]
    level = np.minimum(np.rint(size), 32767).astype(np.int64)
    nothing = (size**2 * worth).sum(1)
    place = np.arange(64)
    before = np.maximum.accumulate(np.where(level > 0, place, -1), axis=1)
    before = np.concatenate([np.full((len(level), 1), -1), before[:, :-1]], 1)  # the last level before each place, not yet touched
    following = np.full(len(level), 64)
    rows = np.arange(len(level))
    # bits of each run and level, those of over 8 as one
    table = token_bits(place[:, None], np.arange(-9, 10)[None, :], costs)
    column = lambda v: np.minimum(np.maximum(v, -9), 9) + 9
    for k in range(63, -1, -1):
        now = level[:, k]
        if not now.any():
            continue
        has = following < 64
        at = np.minimum(following, 63)
        after = column(sign[rows, at] * level[rows, at])
        rest = lambda run: np.where(has, table[np.minimum(np.maximum(run, 0), 62), after], 0.0)  # noqa: E731, B023
        run, kept, gone = k - before[:, k] - 1, rest(following - k - 1), rest(following - before[:, k] - 1)
        own, weight, side = size[:, k], worth[:, k], sign[:, k]
        best, chosen = None, now
        for option in (now, now - 1):
            bits = np.where(option > 0, table[run, column(side * option)] + kept, gone)
            total = (own - option) ** 2 * weight + price * bits
            if best is None:
                best = total
            else:
                win = (total < best) & (option >= 0)
                best, chosen = np.where(win, total, best), np.where(win, option, chosen)
        chosen = np.where(own**2 * weight + price * gone < best, 0, chosen)
        level[:, k] = np.where(now > 0, chosen, 0)
        following = np.where(level[:, k] > 0, k, following)
    last = np.maximum.accumulate(np.where(level > 0, place, -1), axis=1)
    run = place - np.concatenate([np.full((len(level), 1), -1), last[:, :-1]], 1) - 1
    bits = np.where(level > 0, token_bits(run, sign * level, costs), 0.0).sum(1) + costs[0x80]
    total = ((size - level) ** 2 * worth).sum(1) + price * bits
    dropped = total >= nothing
    level[dropped] = 0
    out = np.zeros_like(level)
    out[:, ZIGZAG] = sign * level
    return out, np.where(dropped, nothing, total)


def learned(costs: np.ndarray, stream: bytes) -> np.ndarray:
    """Bits of each byte by how often a stream has it, from 1 to 16; a stream too short to tell changes nothing."""
    if len(stream) < 64:
        return costs
    n = np.bincount(np.frombuffer(stream, np.uint8), minlength=256)
    return np.clip(np.where(n > 0, np.log2(len(stream) / np.maximum(n, 1)), np.log2(len(stream)) + 2), 1, 16)


def take_levels(src: bytes, at: int) -> tuple[list[tuple[int, int]], int]:
    """((place, level) of a block, next position)."""
    out, place = [], 0
    while True:
        if at >= len(src):
            raise CorruptData("coefficients run out")
        t = src[at]
        at += 1
        if t == 0x80:
            return out, at
        if t < 0x80:
            run, low = t >> 4, t & 15
            v = low - 8 if low < 8 else low - 7
        else:
            if at + 2 > len(src):
                raise CorruptData("coefficients run out")
            run, v = t - 0x81, struct.unpack_from("<h", src, at)[0]
            at += 2
        place += run
        if place > 63:
            raise CorruptData("a run past the block")
        out.append((int(ZIGZAG[place]), v))
        place += 1


def put_vector(d: int) -> bytes:
    return bytes([d & 255]) if -127 <= d <= 127 else b"\x80" + struct.pack("<h", d)


def take_vector(src: bytes, at: int) -> tuple[int, int]:
    if at >= len(src):
        raise CorruptData("vectors run out")
    if src[at] != 0x80:
        return src[at] - (src[at] > 127) * 256, at + 1
    if at + 3 > len(src):
        raise CorruptData("vectors run out")
    return struct.unpack_from("<h", src, at + 1)[0], at + 3


def put_stream(data: bytes) -> tuple[int, bytes]:
    """(method, coded): the shortest of stored, plain and Huffman."""
    best = (STORED, data)
    if len(data) > 16:
        best = min(best, (PLAIN, lz.encode(data)), key=lambda x: len(x[1]))
    if len(data) > 256:
        best = min(best, (CODED, huffman.encode(data)), key=lambda x: len(x[1]))
    return best


def take_stream(method: int, data: bytes, raw: int) -> bytes:
    if method == STORED and len(data) == raw:
        return data
    if method == PLAIN and len(data) < raw:
        return lz.decode(data, raw)
    if method == CODED:
        return huffman.decode(data, raw)
    raise CorruptData("stream of an unknown method or size")


#: Price of a bit in squared steps of predicted blocks.
LAMBDA = 0.12


@dataclass
class Frame:
    """Parsed macroblocks of a frame: modes, vectors, and the coded blocks' levels."""

    modes: np.ndarray
    vectors: np.ndarray
    levels: np.ndarray  # (macroblocks, 6, 64)


@dataclass
class Session:
    """A sequence of frames of one size. ``planes``: the last frame (padded to macroblocks), None without a reference."""

    width: int
    height: int
    planes: list[np.ndarray] | None = field(default=None)

    def __post_init__(self) -> None:
        if not (2 <= self.width <= 16384 and 2 <= self.height <= 16384) or self.width % 2 or self.height % 2:
            raise ValueError("sizes are even, from 2 to 16384")
        self.cols, self.rows = -(-self.width // 16), -(-self.height // 16)
        self.number = 0
        #: Bits of each byte of the coefficient stream, learned from the frame before; the encoder's alone.
        self.costs = np.full(256, 6.0)

    def grid(self) -> tuple[np.ndarray, np.ndarray]:
        i = np.arange(self.cols * self.rows)
        return i % self.cols * 16, i // self.cols * 16

    def predictions(self, vectors: np.ndarray) -> np.ndarray:
        """(macroblocks, 6, 8, 8) predicted from the last frame."""
        x, y = self.grid()
        vx, vy = vectors[:, 0], vectors[:, 1]
        luma = predict(self.planes[0], x, y, vx, vy, 16).reshape(-1, 2, 8, 2, 8).swapaxes(2, 3).reshape(-1, 4, 8, 8)
        chroma = [predict(p, x // 2, y // 2, vx >> 1, vy >> 1, 8)[:, None] for p in self.planes[1:]]
        return np.concatenate([luma, *chroma], 1)

    def rebuild(self, f: Frame, step: np.ndarray) -> list[np.ndarray]:
        """Planes of a parsed frame."""
        n = len(f.modes)
        pred = np.full((n, 6, 8, 8), 128, np.int64)
        moved = f.modes != INTRA
        if moved.any():
            pred[moved] = self.predictions(f.vectors)[moved]
        own = np.stack([step[0]] * 4 + [step[1]] * 2)
        scale = np.where(moved[:, None, None], step[2], own[None])
        px = np.clip(pred + inverse(f.levels.reshape(-1, 64), scale.reshape(-1, 64)).reshape(n, 6, 8, 8), 0, 255).astype(np.uint8)
        luma = px[:, :4].reshape(self.rows, self.cols, 2, 2, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(self.rows * 16, self.cols * 16)
        chroma = [px[:, 4 + k].reshape(self.rows, self.cols, 8, 8).swapaxes(1, 2).reshape(self.rows * 8, self.cols * 8) for k in range(2)]
        return [luma, *chroma]

    def visible(self) -> list[np.ndarray]:
        """The last frame without its padding."""
        return [self.planes[0][: self.height, : self.width], *(p[: self.height // 2, : self.width // 2] for p in self.planes[1:])]

    def dump(self) -> bytes | None:
        """The reference as bytes, None without one."""
        return b"".join(np.ascontiguousarray(p).tobytes() for p in self.planes) if self.planes else None

    def load(self, data: bytes) -> None:
        """Takes up what ``dump`` gave."""
        shapes, at, planes = [(self.rows * 16, self.cols * 16)] + [(self.rows * 8, self.cols * 8)] * 2, 0, []
        for h, w in shapes:
            planes.append(np.frombuffer(data, np.uint8, h * w, at).reshape(h, w))
            at += h * w
        self.planes = planes

    # decoding

    def parse(self, packet: bytes) -> tuple[bool, int, Frame]:
        if len(packet) < HEADER:
            raise CorruptData("packet cut short")
        magic, kind, quality, w, h, m0, m1, m2, version, *sizes = struct.unpack_from("<2scBHH4B6I", packet)
        if magic != MAGIC or kind not in b"IP" or version > VERSION or (w, h) != (self.width, self.height):
            raise CorruptData("not a packet of this sequence")
        key, at, slices = kind == b"I", HEADER, [None]
        if version:
            if at >= len(packet) or not 1 <= packet[at] <= min(MOST_SLICES, self.rows):
                raise CorruptData("slice table is wrong")
            count, at, slices = packet[at], at + 1, []
            for _ in range(count):
                a, at = take_number(packet, at)
                b, at = take_number(packet, at)
                slices.append((a, b))
        streams = []
        for method, raw, stored in zip((m0, m1, m2), sizes[::2], sizes[1::2], strict=True):
            if raw > 64 * 6 * 4 * self.cols * self.rows + 64 or at + stored > len(packet):
                raise CorruptData("stream cut short or too large")
            streams.append(take_stream(method, packet[at : at + stored], raw))
            at += stored
        modes, vectors, coefs = streams
        n = self.cols * self.rows
        if len(modes) != n:
            raise CorruptData("a mode is missing")
        slices = [(len(vectors), len(coefs))] if slices == [None] else slices
        if sum(a for a, _ in slices) != len(vectors) or sum(b for _, b in slices) != len(coefs):
            raise CorruptData("slices do not fill the streams")
        f = Frame(np.frombuffer(modes, np.uint8).astype(np.int64) & 3, np.zeros((n, 2), np.int64), np.zeros((n, 6, 64), np.int64))
        x, y = self.grid()
        (lx, hx), (ly, hy) = vector_range(x, self.cols * 16), vector_range(y, self.rows * 16)
        v_end = c_end = 0
        for k, (a, b) in enumerate(slices):
            v_at, c_at, v_end, c_end = v_end, c_end, v_end + a, c_end + b
            own_v, own_c = vectors[:v_end], coefs[:c_end]
            for i in range(k * self.rows // len(slices) * self.cols, (k + 1) * self.rows // len(slices) * self.cols):
                mode, coded = modes[i] & 3, modes[i] >> 2
                if mode > INTRA or (key and mode != INTRA) or (mode == SKIP and coded):
                    raise CorruptData("a mode that can't be here")
                if mode == INTER:
                    dx, v_at = take_vector(own_v, v_at)
                    dy, v_at = take_vector(own_v, v_at)
                    left = f.vectors[i - 1] if i % self.cols else (0, 0)
                    f.vectors[i] = min(max(left[0] + dx, lx[i]), hx[i]), min(max(left[1] + dy, ly[i]), hy[i])
                for j in range(6):
                    if coded >> j & 1:
                        found, c_at = take_levels(own_c, c_at)
                        for place, v in found:
                            f.levels[i, j, place] = v
            if v_at != v_end or c_at != c_end:
                raise CorruptData("a slice is not used up")
        return key, quality, f

    def decode(self, packet: bytes) -> list[np.ndarray]:
        """Planes of the next packet. After damage there is no reference until the next keyframe."""
        before, self.planes = self.planes, None
        key, quality, f = self.parse(packet)
        if not key and before is None:
            raise CorruptData("no reference frame")
        self.planes = before
        self.planes = self.rebuild(f, steps(quality))
        return self.visible()

    # encoding

    def pad(self, planes: list[np.ndarray]) -> list[np.ndarray]:
        sizes = [(self.rows * 16, self.cols * 16)] + [(self.rows * 8, self.cols * 8)] * 2
        return [np.pad(p, ((0, h - p.shape[0]), (0, w - p.shape[1])), mode="edge") for p, (h, w) in zip(planes, sizes, strict=True)]

    def search(self, luma: np.ndarray, reach: int, price: float) -> np.ndarray:
        """Half-pixel vectors: all whole-pixel moves of up to ``reach``, then the eight half-pixel neighbours of the best."""
        x, y = self.grid()
        now = luma.reshape(self.rows, 16, self.cols, 16).swapaxes(1, 2).reshape(-1, 16, 16).astype(np.int64)
        (lx, hx), (ly, hy) = vector_range(x, self.cols * 16), vector_range(y, self.rows * 16)
        best, out = np.full(len(x), np.inf), np.zeros((len(x), 2), np.int64)

        def trial(vx: np.ndarray, vy: np.ndarray) -> None:
            ok = (vx >= lx) & (vx <= hx) & (vy >= ly) & (vy <= hy)
            sad = np.abs(predict(self.planes[0], x, y, vx, vy, 16) - now).sum((1, 2)) + price * (np.abs(vx) + np.abs(vy) > 0) + price / 8 * (np.abs(vx) + np.abs(vy))
            win = ok & (sad < best)
            best[win] = sad[win]
            out[win] = np.stack([vx, vy], 1)[win]

        for dy in range(-reach, reach + 1):
            for dx in range(-reach, reach + 1):
                trial(np.full(len(x), 2 * dx), np.full(len(x), 2 * dy))
        base = out.copy()
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                trial(base[:, 0] + dx, base[:, 1] + dy)
        return out

    def encode(self, planes: list[np.ndarray], quality: int = 70, key: bool | None = None, interval: int = 60, reach: int = 3) -> bytes:
        """A packet; the session's planes become what a decoder shows. Blocks take the mode of least error plus price."""
        src = self.pad(planes)
        key = self.planes is None or self.number % interval == 0 if key is None else key or self.planes is None
        step, n = steps(quality), self.cols * self.rows
        luma = src[0].reshape(self.rows, 2, 8, self.cols, 2, 8).transpose(0, 3, 1, 4, 2, 5).reshape(n, 4, 8, 8)
        chroma = [p.reshape(self.rows, 8, self.cols, 8).swapaxes(1, 2).reshape(n, 1, 8, 8) for p in src[1:]]
        px = np.concatenate([luma, *chroma], 1).astype(np.int64)
        own = np.stack([step[0]] * 4 + [step[1]] * 2)
        price = LAMBDA * float(step[2].mean()) ** 2

        def quantise(residual: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(levels, price of each macroblock)."""
            flat_step = np.broadcast_to(s, (n, 6, 64)).reshape(-1, 64)
            levels, total = rated(forward(residual.reshape(-1, 8, 8)), flat_step, price, self.costs)
            return levels.reshape(n, 6, 64), total.reshape(n, 6).sum(1)

        alone, alone_price = quantise(px - 128, own)
        f = Frame(np.full(n, INTRA), np.zeros((n, 2), np.int64), alone)
        if not key:
            v = self.search(src[0], reach, float(step[2].mean()))
            zero = self.predictions(np.zeros_like(v))
            inter, inter_price = quantise(px - self.predictions(v), step[2])
            left = np.where((np.arange(n) % self.cols > 0)[:, None], np.roll(v, 1, 0), 0)
            vector_bits = np.where(v == left, 2, 6 + np.abs(v - left).clip(0, 10)).sum(1)
            costs = np.stack([((zero - px) ** 2).sum((1, 2, 3)) + price, inter_price + price * (3 + vector_bits), alone_price + price * 6])
            f.modes = costs.argmin(0)
            f.levels = np.where((f.modes == SKIP)[:, None, None], 0, np.where((f.modes == INTER)[:, None, None], inter, f.levels))
            f.vectors = np.where((f.modes == INTER)[:, None], v, 0)
        f.levels = np.clip(f.levels, -32768, 32767)
        coded = (f.levels.any(2) << np.arange(6)).sum(1)
        slices, vectors, coefs, table = min(max(self.rows // 4, 1), 32), bytearray(), bytearray(), b""
        for k in range(slices):
            v_at, c_at = len(vectors), len(coefs)
            for i in range(k * self.rows // slices * self.cols, (k + 1) * self.rows // slices * self.cols):
                if f.modes[i] == INTER:
                    left = f.vectors[i - 1] if i % self.cols else np.zeros(2, np.int64)
                    vectors += put_vector(int(f.vectors[i, 0] - left[0])) + put_vector(int(f.vectors[i, 1] - left[1]))
                for j in range(6):
                    if coded[i] >> j & 1:
                        coefs += put_levels(f.levels[i, j])
            table += put_number(len(vectors) - v_at) + put_number(len(coefs) - c_at)
        streams = [bytes((f.modes | coded << 2).astype(np.uint8)), bytes(vectors), bytes(coefs)]
        packed = [put_stream(s) for s in streams]
        sizes = [x for s, (_, c) in zip(streams, packed, strict=True) for x in (len(s), len(c))]
        head = struct.pack("<2scBHH4B6I", MAGIC, b"I" if key else b"P", quality, self.width, self.height, *(m for m, _ in packed), VERSION, *sizes)
        self.planes = self.rebuild(f, step)
        self.number += 1
        self.costs = learned(self.costs, streams[2])
        return head + bytes([slices]) + table + b"".join(c for _, c in packed)
