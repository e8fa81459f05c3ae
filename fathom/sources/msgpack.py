"""MessagePack, as its public specification describes it: nil, bool, int, float, str, bin, array, map."""

from __future__ import annotations

import struct

_SIZED = {0xC4: ("B", "bin"), 0xC5: ("H", "bin"), 0xC6: ("I", "bin"), 0xD9: ("B", "str"), 0xDA: ("H", "str"), 0xDB: ("I", "str"), 0xDC: ("H", "array"), 0xDD: ("I", "array"), 0xDE: ("H", "map"), 0xDF: ("I", "map")}
_FIXED = {0xCA: "f", 0xCB: "d", 0xCC: "B", 0xCD: "H", 0xCE: "I", 0xCF: "Q", 0xD0: "b", 0xD1: "h", 0xD2: "i", 0xD3: "q"}


def pack(x: object) -> bytes:
    if x is None:
        return b"\xc0"
    if isinstance(x, bool):
        return b"\xc3" if x else b"\xc2"
    if isinstance(x, int):
        if 0 <= x < 128:
            return bytes([x])
        if -32 <= x < 0:
            return struct.pack("b", x)
        for code, kind in ((0xCC, "B"), (0xCD, "H"), (0xCE, "I"), (0xCF, "Q")) if x > 0 else ((0xD0, "b"), (0xD1, "h"), (0xD2, "i"), (0xD3, "q")):
            try:
                return bytes([code]) + struct.pack(f">{kind}", x)
            except struct.error:
                continue
        raise OverflowError(x)
    if isinstance(x, float):
        return b"\xcb" + struct.pack(">d", x)
    if isinstance(x, str):
        data = x.encode()
        return _head(len(data), 0xA0, 32, (0xD9, 0xDA, 0xDB)) + data
    if isinstance(x, bytes):
        return _head(len(x), 0, 0, (0xC4, 0xC5, 0xC6)) + x
    if isinstance(x, dict):
        return _head(len(x), 0x80, 16, (None, 0xDE, 0xDF)) + b"".join(pack(k) + pack(v) for k, v in x.items())
    return _head(len(x), 0x90, 16, (None, 0xDC, 0xDD)) + b"".join(map(pack, x))


def _head(n: int, fixed: int, below: int, codes: tuple) -> bytes:
    if n < below:
        return bytes([fixed | n])
    for code, kind, top in zip(codes, "BHI", (1 << 8, 1 << 16, 1 << 32), strict=True):
        if code is not None and n < top:
            return bytes([code]) + struct.pack(f">{kind}", n)
    raise OverflowError(n)


def unpack_all(data: bytes) -> list:
    out, at = [], 0
    while at < len(data):
        x, at = _unpack(data, at)
        out.append(x)
    return out


def _unpack(data: bytes, at: int) -> tuple[object, int]:
    c, at = data[at], at + 1
    if c < 0x80:
        return c, at
    if c >= 0xE0:
        return c - 256, at
    if c in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[c], at
    if c in _FIXED:
        kind = f">{_FIXED[c]}"
        return struct.unpack_from(kind, data, at)[0], at + struct.calcsize(kind)
    if c in _SIZED:
        kind, what = _SIZED[c]
        n, at = struct.unpack_from(f">{kind}", data, at)[0], at + struct.calcsize(kind)
    else:
        what, n = ("str", c & 31) if c >= 0xA0 else ("array", c & 15) if c >= 0x90 else ("map", c & 15)
    if what in ("str", "bin"):
        raw = data[at : at + n]
        return (raw.decode() if what == "str" else raw), at + n
    items = []
    for _ in range(n * (2 if what == "map" else 1)):
        x, at = _unpack(data, at)
        items.append(x)
    return (dict(zip(items[::2], items[1::2], strict=True)) if what == "map" else items), at
