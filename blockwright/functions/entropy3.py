"""Entropy blocks of version 3: literal chunks with a mode each, compact code tables, scaled offsets, streams by region.

Header: six 32-bit words (literals with both top bits set, sequences, length bytes, near offsets, far offsets, chunks with
the scale in the top byte); a word for each chunk (its literals, top bit: deltas); eight streams, each as a byte (method, and
limit of its codes in the high half), size, data: literals, tokens, length bytes, offset symbols, low bytes of near
offsets, and the three bytes of far ones. Methods: 0 raw, 1 one table in 8 parts, 2 sixteen tables by the symbol before in
6 parts, 4 several streams one after the other, each behind its number of symbols; 15 marks the literal chunks.

A chunk is raw, has its own table, or uses the block's sixteen tables; its symbols are literals or their differences from
the byte that the last offset points at. A scale S above 1 lets offsets that it divides be sent divided.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from blockwright.functions import CorruptData, huffman, lz
from blockwright.functions.entropy import LITERAL_GROUPS, TOKEN_GROUPS, Recent

#: Fixed values of the format: output bytes of a literal chunk and of a region, largest scale, limits of the codes.
CHUNK, REGION, MAX_SCALE = 128 << 10, 256 << 10, 64
PLAIN_LIMIT, CONTEXT_LIMIT = 11, 10
RAW, PLAIN, CONTEXT, REGIONAL, LITERALS = 0, 1, 2, 4, 15
#: Symbols of a compact table: code lengths 0 to 11, a short run of zeros (from 3, 3 bits), a long one (from 11, 7 bits).
SHORT, LONG = 12, 13
#: Groups of command tokens: literal run by match class.
_M = np.array([0, 0, 1, 1, 1] + [2] * 10 + [3])
COMMAND_GROUPS = ((np.arange(256) & 3) * 4 + _M[np.arange(256) >> 2 & 15]).astype(np.int64)


def write_tables(tables: list[np.ndarray]) -> bytes:
    """Code lengths of some tables, run-length coded and then Huffman coded."""
    flat = np.concatenate(tables).astype(np.int64)
    at = np.flatnonzero(np.r_[True, (flat[1:] != 0) | (flat[:-1] != 0)])
    symbols: list[tuple[int, int, int]] = []  # symbol, extra bits' value, number of extra bits
    for a, b in zip(at.tolist(), [*at[1:].tolist(), len(flat)], strict=True):
        if flat[a]:
            symbols.append((int(flat[a]), 0, 0))
            continue
        n = b - a
        while n >= 11:
            symbols.append((LONG, min(n, 138) - 11, 7))
            n -= min(n, 138)
        symbols += [(SHORT, n - 3, 3)] if n >= 3 else [(0, 0, 0)] * n
    lens = huffman.lengths(np.bincount([s for s, _, _ in symbols], minlength=14), 7)
    codes = huffman.codes(lens)
    values, sizes = list(lens), [3] * 14
    for s, extra, n in symbols:
        values += [codes[s], extra]
        sizes += [lens[s], n]
    return bytes([len(tables)]) + huffman.write_bits(np.array(values, np.int64), np.array(sizes, np.int64))


def read_tables(src: bytes, at: int, count: int) -> tuple[list[np.ndarray], int]:
    """(code lengths of ``count`` tables, next position)."""
    if at >= len(src) or src[at] != count:
        raise CorruptData("another number of tables")
    left = 8 * (len(src) - at - 1)
    bits = int.from_bytes(src[at + 1 : at + 1 + 500 * count], "little")  # more than any tables take

    used = 0

    def take(n: int) -> int:
        nonlocal bits, used
        used += n
        if used > left:
            raise CorruptData("tables cut short")
        v = bits & (1 << n) - 1
        bits >>= n
        return v

    lens = np.array([take(3) for _ in range(14)], np.uint8)
    if not 0 < huffman.kraft(lens, 7) <= 128:
        raise CorruptData("code lengths claim too much")
    by_code = {(int(lens[s]), int(c)): s for s, c in enumerate(huffman.codes(lens)) if lens[s]}
    out, n = np.zeros(256 * count, np.uint8), 0
    while n < len(out):
        code, size = 0, 0
        while (size, code) not in by_code:
            if size == 7:
                raise CorruptData("no code")
            code |= take(1) << size
            size += 1
        s = by_code[size, code]
        if s == SHORT:
            n += 3 + take(3)
        elif s == LONG:
            n += 11 + take(7)
        else:
            out[n] = s
            n += 1
    if n > len(out):
        raise CorruptData("a run of zeros past the end")
    return list(out.reshape(count, 256)), at + 1 + -(-used // 8)


def _bounds(n: int, parts: int) -> list[tuple[int, int]]:
    q = -(-n // parts)
    return [(min(k * q, n), min((k + 1) * q, n)) for k in range(parts)]


def _before(v: np.ndarray, parts: int, group: np.ndarray | None) -> np.ndarray:
    """Group of the symbol before each one; 0 at the start of a part."""
    g = np.zeros(len(v), np.int64)
    if group is not None and len(v):
        g[1:] = group[v[:-1]]
        g[[a for a, b in _bounds(len(v), parts) if a < b]] = 0
    return g


def _counts(v: np.ndarray, parts: int, group: np.ndarray | None) -> np.ndarray:
    tables = 1 if group is None else 16
    return np.bincount(_before(v, parts, group) * 256 + v, minlength=256 * tables).reshape(tables, 256)


def _write_parts(v: np.ndarray, parts: int, group: np.ndarray | None, lens: list[np.ndarray]) -> bytes:
    """Sizes of all parts but the last, and the parts."""
    code = np.stack([huffman.codes(x) for x in lens])
    size = np.stack(lens).astype(np.int64)
    g = _before(v, parts, group)
    streams = [huffman.write_bits(code[g[a:b], v[a:b]], size[g[a:b], v[a:b]]) for a, b in _bounds(len(v), parts)]
    return b"".join(len(s).to_bytes(4, "little") for s in streams[:-1]) + b"".join(streams)


def _read_parts(src: bytes, at: int, n: int, parts: int, group: np.ndarray | None, tables: list) -> bytes:
    return b"".join(huffman.read_symbols(tables, group, s, k) for s, k in huffman._parts(src, at, n, parts))


def _tables(lens: list[np.ndarray], limit: int) -> list:
    if max(int(x.max()) for x in lens) > limit:
        raise CorruptData("a code is too long")
    return [huffman.table(x) for x in lens]


def write_stream(data: bytes, group: np.ndarray | None = None) -> bytes:
    """A stream's record: coded if that saves a hundredth."""
    v = np.frombuffer(data, np.uint8)
    if len(v) >= 64:
        parts = 8 if group is None else 6
        lens = [huffman.lengths(c, PLAIN_LIMIT) for c in _counts(v, parts, group)]
        body = write_tables(lens) + _write_parts(v, parts, group, lens)
        if len(body) < len(v) - len(v) // 100:
            return bytes([(PLAIN if group is None else CONTEXT) | PLAIN_LIMIT << 4]) + len(body).to_bytes(4, "little") + body
    return bytes([RAW]) + len(data).to_bytes(4, "little") + data


def write_regions(data: bytes, edges: list[int], group: np.ndarray | None = None) -> bytes:
    """The shortest of one stream and of 2, 4, ... streams over neighbouring regions; ``edges``: where regions begin, and the end."""
    best, regions = write_stream(data, group), len(edges) - 1
    many = 2
    while many <= regions and len(data) >= 4096:
        cuts = [edges[regions * k // many] for k in range(many + 1)]
        body = b"".join((b - a).to_bytes(4, "little") + write_stream(data[a:b], group) for a, b in zip(cuts, cuts[1:], strict=False) if a < b)
        best = min(best, bytes([REGIONAL]) + len(body).to_bytes(4, "little") + body, key=len)
        many *= 2
    return best


def _record(src: bytes, at: int) -> tuple[int, int, bytes, int]:
    """(method, limit, data, next position) of a stream."""
    if at + 5 > len(src):
        raise CorruptData("stream header cut short")
    size = int.from_bytes(src[at + 1 : at + 5], "little")
    if at + 5 + size > len(src):
        raise CorruptData("stream cut short")
    return src[at] & 15, src[at] >> 4, src[at + 5 : at + 5 + size], at + 5 + size


def read_stream(method: int, limit: int, data: bytes, n: int, group: np.ndarray | None = None) -> bytes:
    """The n symbols of a stream."""
    if method == RAW and not limit and len(data) == n:
        return data
    if method == REGIONAL and not limit:
        out, at = b"", 0
        while at < len(data):
            k = int.from_bytes(data[at : at + 4], "little")
            m, lim, body, at = _record(data, at + 4)
            if not 0 < k <= n - len(out) or m == REGIONAL:
                raise CorruptData("regions hold too much")
            out += read_stream(m, lim, body, k, group)
        if len(out) == n:
            return out
    elif limit == PLAIN_LIMIT and n and (method == PLAIN or method == CONTEXT and group is not None):
        own = group if method == CONTEXT else None
        lens, at = read_tables(data, 0, 16 if method == CONTEXT else 1)
        return _read_parts(data, at, n, 6 if method == CONTEXT else 8, own, _tables(lens, PLAIN_LIMIT))
    raise CorruptData("unknown method or another size")


def coded_bytes(counts: np.ndarray) -> int:
    """Estimated size of a Huffman coded histogram with its table; 0 of an empty one."""
    return int((np.asarray(counts, np.int64) * huffman.lengths(counts)).sum()) // 8 + 128 if np.sum(counts) else 0


def offset_symbols(offsets: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, value) of new offsets: near ones hold the high part of the value in the symbol, 254 and 255 are far."""
    off = np.asarray(offsets, np.int64)
    if scale == 1:
        return np.where(off < 251 << 8, 3 + (off >> 8), 255), off
    whole = off % scale == 0
    value = np.where(whole, off // scale, off)
    near = value < 125 << 8
    return np.where(near, np.where(whole, 3, 128) + (value >> 8), np.where(whole, 254, 255)), value


def offset_of(symbol: int, scale: int) -> tuple[int, int]:
    """(high part of a near value or -1 of a far one, factor) of a symbol from 3 on; factor 0: not a symbol."""
    if symbol == 255:
        return -1, 1
    if scale == 1:
        return symbol - 3, int(symbol < 254)
    if symbol == 254:
        return -1, scale
    return (symbol - 128, 1) if symbol >= 128 else (symbol - 3, scale)


def scale_bytes(offsets: np.ndarray, repeats: np.ndarray, scale: int) -> int:
    """Estimated size of new offsets under a scale; ``repeats``: how often each repeat symbol occurs."""
    symbol, value = offset_symbols(offsets, scale)
    first = np.bincount(symbol, minlength=256)
    first[:3] = repeats
    far = symbol >= 254
    byte = lambda v: np.bincount(v & 255, minlength=256)
    return coded_bytes(first) + sum(map(coded_bytes, (byte(value[~far]), *(byte(value[far] >> n) for n in (0, 8, 16)))))


def best_scale(offsets: np.ndarray, repeats: np.ndarray) -> int:
    """The scale that codes new offsets in the fewest bytes; one above 1 must divide half of them and save a 512th over the best before it."""
    off = np.asarray(offsets, np.int64)
    best, size = 1, scale_bytes(off, repeats, 1)
    for s in range(2, MAX_SCALE + 1):
        if 2 * np.count_nonzero(off % s == 0) >= len(off):
            now = scale_bytes(off, repeats, s)
            if now < size - size // 512:
                best, size = s, now
    return best


def _plain_cost(v: np.ndarray) -> int | None:
    if len(v) < 64:
        return None
    lens = huffman.lengths(np.bincount(v, minlength=256))
    return (int(lens[v].astype(np.int64).sum()) + 7) // 8 + 8 + len(write_tables([lens])) + 28


def chunk_modes(chunks: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[tuple[int, int]], list[list[np.ndarray] | None]]:
    """(mode, deltas) of each chunk of (literals, deltas), and the two table sets, None if not worth their size.

    A mode must also pay for the time that it takes to decode: a hundredth of the chunk for a table of its own, half of one more
    for the sixteen, a 512th for deltas. The sets come from the chunks that use them, so the choice is made again after each count.
    """
    modes: list[tuple[int, int]] = [(CONTEXT, 2)] * len(chunks)  # at first both sets count all chunks
    plain = [[_plain_cost(v) for v in c] for c in chunks]
    sets: list[list[np.ndarray]] = []
    gain = [0, 0]
    known: dict[tuple, list[np.ndarray]] = {}  # a set by the chunks that it counts
    groups = [[_before(v, 6, LITERAL_GROUPS) for v in c] for c in chunks]
    for _ in range(3):
        sets = []
        for d in (0, 1):
            # no chunk of less than 256 literals takes a set
            counted = (d, *(i for i, (mode, kind) in enumerate(modes) if mode == CONTEXT and kind in (d, 2)))
            counted = counted if any(len(chunks[i][0]) >= 256 for i in range(len(chunks))) else (d,)
            if counted not in known:
                total = np.zeros(16 * 256, np.int64)
                for i in counted[1:]:
                    total += np.bincount(groups[i][d] * 256 + chunks[i][d], minlength=16 * 256)
                known[counted] = [huffman.lengths(x, CONTEXT_LIMIT) for x in total.reshape(16, 256)]
            sets.append(known[counted])
        gain = [0, 0]
        for i, c in enumerate(chunks):
            n = len(c[0])
            options = [(n, RAW, 0)]
            for d in (0, 1):
                penalty = n // 100 + d * n // 512
                if plain[i][d] is not None:
                    options.append((plain[i][d] + penalty, PLAIN, d))
            other = min(options)[0]
            for d in (0, 1):
                lens = np.stack(sets[d]).astype(np.int64)[groups[i][d], c[d]]
                if n >= 256 and lens.all():
                    options.append(((int(lens.sum()) + 7) // 8 + 26 + n // 100 + d * n // 512 + n // 200, CONTEXT, d))
            best = min(options, key=lambda x: x[0])
            modes[i] = best[1:]
            if best[1] == CONTEXT:
                gain[best[2]] += other - best[0]
    kept: list[list[np.ndarray] | None] = [s if gain[d] > len(write_tables(s)) else None for d, s in enumerate(sets)]
    for i, (mode, d) in enumerate(modes):
        if mode == CONTEXT and kept[d] is None:
            n = len(chunks[i][0])
            options = [(n, RAW, 0)] + [(plain[i][k] + n // 100 + k * n // 512, PLAIN, k) for k in (0, 1) if plain[i][k] is not None]
            modes[i] = min(options, key=lambda x: x[0])[1:]
    return modes, kept


def _write_literals(chunks: list[tuple[np.ndarray, np.ndarray]]) -> tuple[bytes, list[int]]:
    """(the literal record, which chunks are deltas)."""
    modes, sets = chunk_modes(chunks)
    out = [bytes([sum(1 << d for d in (0, 1) if sets[d] is not None)])] + [write_tables(s) for s in sets if s is not None]
    for (mode, d), c in zip(modes, chunks, strict=True):
        v = c[d]
        if mode == RAW:
            body = v.tobytes()
        elif mode == PLAIN:
            lens = [huffman.lengths(np.bincount(v, minlength=256))]
            body = write_tables(lens) + _write_parts(v, 8, None, lens)
        else:
            body = _write_parts(v, 6, LITERAL_GROUPS, sets[d])
        out.append(bytes([mode]) + len(body).to_bytes(4, "little") + body)
    body = b"".join(out)
    return bytes([LITERALS]) + len(body).to_bytes(4, "little") + body, [d for _, d in modes]


def encode(data: bytes, parse: Iterator[tuple[int, int, int]] | None = None, commands: bool = False) -> bytes:
    """A block of a parse (by default the greedy one). ``commands``: tokens that hold the repeat index."""
    first, least = (3, 2) if commands else (15, 3)
    recent, at, last = Recent(), 0, 0
    raw = np.frombuffer(data, np.uint8)
    tokens, lens, slots, offsets = bytearray(), bytearray(), [], []
    literals, deltas, chunks, edge = [], [], [], 0
    regions = max(1, min(64, -(-len(data) // REGION)))
    marks = [(0, 0, 0)]  # tokens, length bytes and events before each region
    for n, match, off in lz.sequences(data) if parse is None else parse:
        if not chunks or at >= edge:
            chunks.append(len(literals))
            edge = (at // CHUNK + 1) * CHUNK
        while len(marks) < regions and at + n >= len(marks) * REGION:
            marks.append((len(tokens), len(lens), len(slots)))
        part = raw[at : at + n]
        literals.append(part)
        deltas.append(part - raw[at - last : at - last + n] if last else part)
        at += n + match
        if not match:
            break
        last = off
        for value, start in ((n, first), (match, 15 + least)):
            if value >= start:
                lens += b"\xff" * ((value - start) // 255) + bytes([(value - start) % 255])
        slot = recent.slot(off)
        short = min(match - least, 15)
        tokens.append(min(n, 3) | short << 2 | (slot if slot >= 0 else 3) << 6 if commands else min(n, 15) << 4 | short)
        slots.append(slot)
        offsets.append(off)
        if slot >= 0:
            recent.use(slot)
        else:
            recent.push(off)
    slot, off = np.array(slots, np.int64), np.array(offsets, np.int64)
    new = slot < 0
    scale = best_scale(off[new], np.bincount(slot[~new], minlength=3)[:3])
    symbol, value = offset_symbols(off, scale)
    symbol = np.where(new, symbol, slot)
    shown = new if commands else np.ones(len(slot), bool)
    far = new & (symbol >= 254)
    near = new & ~far
    marks += [(len(tokens), len(lens), len(slots))] * (regions + 1 - len(marks))
    upto = lambda m: [int(np.count_nonzero(m[: e])) for _, _, e in marks]
    ends = [*chunks[1:], len(literals)]
    pieces = [tuple(np.concatenate([np.zeros(0, np.uint8), *x[a:b]]) for x in (literals, deltas)) for a, b in zip(chunks, ends, strict=True)]
    record, kinds = _write_literals(pieces)
    byte = lambda v, n=0: (v >> n & 255).astype(np.uint8).tobytes()
    streams = [
        write_regions(bytes(tokens), [m[0] for m in marks], COMMAND_GROUPS if commands else TOKEN_GROUPS),
        write_regions(bytes(lens), [m[1] for m in marks]),
        write_regions(byte(symbol[shown]), upto(shown)),
        write_regions(byte(value[near]), upto(near)),
        *(write_regions(byte(value[far], n), upto(far)) for n in (0, 8, 16)),
    ]
    head = [sum(len(p[0]) for p in pieces) | 3 << 30, len(tokens), len(lens), int(near.sum()), int(far.sum()), len(pieces) | (scale | commands << 7) << 24]
    head += [len(p[0]) | k << 31 for p, k in zip(pieces, kinds, strict=True)]
    return b"".join(x.to_bytes(4, "little") for x in head) + record + b"".join(streams)


def _read_literals(src: bytes, words: list[int]) -> list[bytes]:
    """The symbols of each chunk."""
    if not src or src[0] > 3:
        raise CorruptData("unknown table sets")
    at, sets, out = 1, [None, None], []
    for d in (0, 1):
        if src[0] >> d & 1:
            lens, at = read_tables(src, at, 16)
            sets[d] = _tables(lens, CONTEXT_LIMIT)
    for w in words:
        n, d = w & 0x7FFFFFFF, w >> 31
        mode, high, body, at = _record(src, at)
        if high:
            raise CorruptData("unknown chunk mode")
        if mode == RAW and len(body) == n:
            out.append(body)
        elif mode == PLAIN and n:
            lens, skip = read_tables(body, 0, 1)
            out.append(_read_parts(body, skip, n, 8, None, _tables(lens, PLAIN_LIMIT)))
        elif mode == CONTEXT and n and sets[d] is not None:
            out.append(_read_parts(body, 0, n, 6, LITERAL_GROUPS, sets[d]))
        else:
            raise CorruptData("unknown chunk mode or another size")
    if at != len(src):
        raise CorruptData("chunks are not used up")
    return out


def _undo_deltas(out: bytearray, part: bytes, back: int) -> None:
    """Appends literals that were sent as differences from the bytes ``back`` before them."""
    if not back:
        out += part
        return
    if back > len(out):
        raise CorruptData("offset outside of the history")
    for i in range(0, len(part), back):  # a run of ``back`` bytes depends on the run before it only
        run = np.frombuffer(part, np.uint8)[i : i + back]
        out += (run + np.frombuffer(bytes(out[len(out) - back : len(out) - back + len(run)]), np.uint8)).tobytes()


def decode(src: bytes, size: int) -> bytes:
    """The ``size`` bytes of a block."""
    if len(src) < 24:
        raise CorruptData("header cut short")
    nl, ns, nlen, near, far, last = (int.from_bytes(src[4 * i : 4 * i + 4], "little") for i in range(6))
    nl, count, scale, commands = nl & 0x3FFFFFFF, last & 0xFFFFFF, last >> 24 & 127, last >> 31
    if nl > size or ns > size // 3 + 1 or nlen > 2 * ns + size // 255 + 1 or near > ns or far > ns - near or not 0 < count <= size // 16 + 1 or not scale or len(src) < 24 + 4 * count:
        raise CorruptData("counts claim more than the block can hold")
    words = [int.from_bytes(src[24 + 4 * i : 28 + 4 * i], "little") for i in range(count)]
    if sum(w & 0x7FFFFFFF for w in words) != nl:
        raise CorruptData("chunks hold another number of literals")
    method, high, body, at = _record(src, 24 + 4 * count)
    if method != LITERALS or high:
        raise CorruptData("literals are missing")
    parts, got = _read_literals(body, words), []
    for k, n in enumerate((ns, nlen, near + far if commands else ns, near, far, far, far)):
        method, limit, body, at = _record(src, at)
        got.append(read_stream(method, limit, body, n, None if k else COMMAND_GROUPS if commands else TOKEN_GROUPS))
    if at != len(src):
        raise CorruptData("bytes after the streams")
    tokens, lens, symbols, low, *high_bytes = got
    new, first, least = iter(symbols), (3 if commands else 15), (2 if commands else 3)
    near_at = far_at = len_at = chunk = lit_at = back = 0
    recent, out = Recent(), bytearray()

    def literals(n: int) -> None:
        nonlocal chunk, lit_at
        while n and lit_at == len(parts[chunk]):
            chunk, lit_at = chunk + 1, 0
            if chunk == len(parts):
                raise CorruptData("literals run out")
        part = parts[chunk][lit_at : lit_at + n]
        if len(part) != n or len(out) + n > size:
            raise CorruptData("literals past their chunk or the end")
        lit_at += n
        if words[chunk] >> 31:
            _undo_deltas(out, part, back)
        else:
            out.extend(part)

    for token in tokens:
        n, m, symbol = (token & 3, token >> 2 & 15, token >> 6) if commands else (token >> 4, token & 15, 3)
        if symbol == 3:
            symbol = next(new, -1)
            if symbol < 0 or commands and symbol < 3:
                raise CorruptData("offset symbols run out")
        if symbol < 3:
            off = recent.use(symbol)
        else:
            top, factor = offset_of(symbol, scale)
            if top >= 0 and near_at < near:
                value = top << 8 | low[near_at]
                near_at += 1
            elif top < 0 and far_at < far:
                value = sum(b[far_at] << 8 * i for i, b in enumerate(high_bytes))
                far_at += 1
            else:
                raise CorruptData("offsets run out")
            off = value * factor
            recent.push(off)
        if n == first:
            more, len_at = lz.take_extension(lens, len_at)
            n += more
        if n:
            literals(n)
        if m == 15:
            more, len_at = lz.take_extension(lens, len_at)
            m += more
        if len(out) + m + least > size:
            raise CorruptData("match past the end")
        lz.copy_match(out, off, m + least)
        back = off
    rest = size - len(out)
    if rest:
        literals(rest)
    if (near_at, far_at, len_at) != (near, far, nlen) or next(new, None) is not None or lit_at != len(parts[chunk]) or any(parts[chunk + 1 :]):
        raise CorruptData("streams are not used up")
    return bytes(out)
