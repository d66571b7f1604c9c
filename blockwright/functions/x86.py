"""Reversible filter for machine code: relative call and jump targets become absolute within a block."""

from __future__ import annotations

import re

_CALL = re.compile(rb"[\xe8\xe9]", re.S)
RANGE = 1 << 25


def apply(data: bytes, forward: bool) -> tuple[bytes, int]:
    """(filtered data, conversions). The four bytes after each E8 / E9 are passed over, whether they convert or not."""
    out, at, n = bytearray(data), 0, 0
    while at < len(out) - 4 and (m := _CALL.search(out, at, len(out) - 4)):
        i = m.start()
        if out[i + 4] in (0x00, 0xFF):
            rel, here = int.from_bytes(out[i + 1 : i + 5], "little"), i + 5
            to = (rel + here if forward else rel - here) % RANGE
            if to >= RANGE // 2:
                to -= RANGE
            out[i + 1 : i + 5] = to.to_bytes(4, "little", signed=True)
            n += 1
        at = i + 5
    return bytes(out), n


def worthwhile(data: bytes) -> bool:
    """Whether a block is large enough and has enough convertible places for a trial."""
    return len(data) >= 4096 and apply(data, True)[1] > len(data) // 2048
