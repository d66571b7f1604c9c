"""Small functions of the formats as column expressions: sizes, hashes, bit scans, tokens, colours, rates, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def block_bound(n: Column) -> Column:
    """Most bytes that a plain block of n bytes can take."""
    return n + F.floor(n / 255) + 16


def frame_bound(n: Column, block: int) -> Column:
    """Most bytes that a frame of n bytes can take."""
    return 16 + 9 * F.ceil(n / block) + n


def multiplicative_hash(v: Column, bits: int) -> Column:
    """The top bits of v * 2654435761 modulo 2**32; the product is taken in halves, so that nothing overflows."""
    k = 2654435761
    low, high = v.bitwiseAND(F.lit(0xFFFF)), F.shiftright(v, 16).bitwiseAND(F.lit(0xFFFF))
    product = (low * k + F.shiftleft((high * k).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftright(product, 32 - bits)


def log2_floor(v: Column) -> Column:
    """Position of the highest set bit of a positive value."""
    return F.length(F.bin(v)) - 1


def trailing_zeros(v: Column) -> Column:
    return F.length(F.regexp_extract(F.bin(v), "(0*)$", 1))


def clamp(v: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def half_floor(v: Column) -> Column:
    """v / 2 rounded down, also below 0."""
    return F.floor(v / 2)


def pack_565(r: Column, g: Column, b: Column) -> Column:
    """8-bit channels rounded to 5, 6 and 5 bits."""
    q = lambda c, top: F.floor((c * top + 127) / 255)
    return F.shiftleft(q(r, 31), 11).bitwiseOR(F.shiftleft(q(g, 63), 5)).bitwiseOR(q(b, 31))


def unpack_565(v: Column) -> tuple[Column, Column, Column]:
    """Channels with their high bits repeated below."""
    r, g, b = F.shiftright(v, 11).bitwiseAND(F.lit(31)), F.shiftright(v, 5).bitwiseAND(F.lit(63)), v.bitwiseAND(F.lit(31))
    five = lambda c: F.shiftleft(c, 3).bitwiseOR(F.shiftright(c, 2))
    return five(r), F.shiftleft(g, 2).bitwiseOR(F.shiftright(g, 4)), five(b)


def srgb_to_linear(v: Column) -> Column:
    """8-bit sRGB as linear light of 0 to 65535."""
    c = v / 255.0
    return F.floor(F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4))) * 65535 + 0.5)


def float_to_half(f: Column) -> Column:
    """The bits of a half float of a non-negative value, ties up; others as 0, large ones as the largest."""
    guess = F.floor(F.log2(F.when(f > 0, f)))
    two = lambda n: F.pow(F.lit(2.0), n)
    e = F.when(two(guess + 1) <= f, guess + 1).when(two(guess) > f, guess - 1).otherwise(guess)
    small = F.floor((f * 16777216).cast("float") + F.lit(0.5).cast("float"))
    return F.when(~(f > 0), 0).when(f >= 65504, 0x7BFF).when(f < 2.0**-14, small).otherwise(F.floor(f * two(10 - e) + 0.5) + (e + 14) * 1024).cast("long")


def half_to_float(h: Column) -> Column:
    return F.when(h < 1024, h / 16777216.0).otherwise((1 + h % 1024 / 1024.0) * F.pow(F.lit(2.0), F.floor(h / 1024) - 15))


def token_groups(token: Column) -> Column:
    """Group of a token: literal length class (0, 1, 2-3, more) by match class (0-1, 2-4, 5-14, 15)."""
    lit, match = F.shiftright(token, 4), token.bitwiseAND(F.lit(15))
    a = F.when(lit < 2, lit).when(lit < 4, 2).otherwise(3)
    b = F.when(match < 2, 0).when(match < 5, 1).when(match < 15, 2).otherwise(3)
    return a * 4 + b


def _match_class(match: Column) -> Column:
    return F.when(match < 2, 0).when(match < 5, 1).when(match < 15, 2).otherwise(3)


def command_groups(token: Column) -> Column:
    """Group of a command token: literal run (its low two bits) by match class (the next four)."""
    return token.bitwiseAND(F.lit(3)) * 4 + _match_class(F.shiftright(token, 2).bitwiseAND(F.lit(15)))


def price_groups(index: Column) -> Column:
    """Group of a command token's price: literal run (high half, 3 and more as one) by match class."""
    return F.least(F.shiftright(index, 4), F.lit(3)) * 4 + _match_class(index.bitwiseAND(F.lit(15)))


def split_match(length: Column) -> Column:
    """A match of 33 to 96 bytes as parts of at most 32 and at least 4, others whole."""
    first = F.least(F.lit(32), length - 4)
    rest = length - first
    second = F.when(rest > 32, F.least(F.lit(32), rest - 4)).otherwise(rest)
    three = F.filter(F.array(first, second, rest - second), lambda x: x > 0)
    return F.when((length > 32) & (length <= 96), three).otherwise(F.array(length))


def vector_bytes(d: Column) -> Column:
    """Bytes of a coded vector part: 1, or 3 outside of -127 to 127."""
    return F.when(F.abs(d) <= 127, 1).otherwise(3)


def mip_levels(w: Column, h: Column) -> Column:
    return log2_floor(F.greatest(w, h)) + 1


def texture_size(w: Column, h: Column, block: int) -> Column:
    return F.ceil(w / 4) * F.ceil(h / 4) * block


def colour_tag(height: Column) -> Column:
    """BT.709 from 720 lines on."""
    return F.when(height >= 720, "bt709").otherwise("bt601")


def frame_rate(text: Column) -> tuple[Column, Column]:
    """"30", "29.97" or "30000/1001" as numerator and denominator."""
    parts = F.split(text, "/")
    plain = F.contains(text, F.lit("."))
    num = F.when(plain, F.round(parts[0].cast("double") * 1000).cast("long")).otherwise(parts[0].cast("double").cast("long"))
    return num, F.when(F.size(parts) > 1, F.get(parts, F.lit(1)).cast("long")).when(plain, 1000).otherwise(1).cast("long")


def human(n: Column) -> Column:
    """Bytes with a unit of powers of 1000 and one decimal."""
    step = F.when(n < 1000, 0).when(n < 1_000_000, 1).when(n < 1_000_000_000, 2).otherwise(3)
    unit = F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB"))), step + 1)
    return F.when(step == 0, F.concat_ws(" ", n.cast("string"), unit)).otherwise(F.concat_ws(" ", (F.floor(n * 10 / F.pow(F.lit(1000), step)) / 10).cast("string"), unit))


def little_endian(data: Column, at: int, width: int) -> Column:
    """An unsigned number of ``width`` bytes (up to 7) at a place of a binary value."""
    h = F.hex(data)
    digits = [F.substr(h, F.lit(2 * (at + i) + 1), F.lit(2)) for i in reversed(range(width))]
    return F.conv(F.concat(*digits), 16, 10).cast("long")
