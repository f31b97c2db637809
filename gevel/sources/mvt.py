"""Vector tiles of points in the Mapbox vector tile format (version 2): just the protocol buffer fields that points need."""

from __future__ import annotations

import struct
from collections.abc import Sequence

Value = bool | int | float | str


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _zigzag(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def _value(x: Value) -> bytes:
    if isinstance(x, bool):
        return _number(7, int(x))
    if isinstance(x, int):
        return _number(6, _zigzag(x))
    if isinstance(x, float):
        return _varint(3 << 3 | 1) + struct.pack("<d", x)
    return _block(1, x.encode())


def encoded(layer: str, places: Sequence[tuple[int, int]], marks: Sequence[dict[str, Value]], extent: int = 4096) -> bytes:
    """One layer of points with their marks; keys and values are stored once."""
    keys: dict[str, int] = {}
    values: dict[tuple[type, Value], int] = {}
    features = []
    for (x, y), mark in zip(places, marks, strict=True):
        tags = b"".join(_varint(keys.setdefault(k, len(keys))) + _varint(values.setdefault((type(v), v), len(values))) for k, v in mark.items())
        move = _varint(9) + _varint(_zigzag(int(x))) + _varint(_zigzag(int(y)))
        features.append(_block(2, _block(2, tags) + _number(3, 1) + _block(4, move)))
    body = _block(1, layer.encode()) + b"".join(features) + b"".join(_block(3, k.encode()) for k in keys) + b"".join(_block(4, _value(v)) for _, v in values) + _number(5, extent) + _number(15, 2)
    return _block(3, body)
