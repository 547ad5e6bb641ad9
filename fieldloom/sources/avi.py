"""Uncompressed AVI: frames of 24-bit pictures in one RIFF file, written in order and read frame by frame.

Compressed video needs a decoder of its own; ``frames.read_split_video`` takes what one has split."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

from .frames import bmp_rows


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)


def encode(pictures: list[np.ndarray], fps: int) -> bytes:
    """Pictures (height x width, or x 3 colours) of one size as a file."""
    height, width = pictures[0].shape[:2] if pictures else (0, 0)
    data = [bmp_rows(p) for p in pictures]
    size = len(data[0]) if data else 0
    main = struct.pack("<10I", 1_000_000 // max(1, fps), size * fps, 0, 0x10, len(data), 0, 1, size, width, height) + b"\0" * 16
    stream = b"vidsDIB " + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, fps, 0, len(data), size, 0xFFFFFFFF, 0, 0, 0, width, height)
    bitmap = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, size, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", bitmap)))
    index, at, body = [], 4, []
    for d in data:
        index.append(b"00db" + struct.pack("<III", 0x10, at, len(d)))
        body.append(_chunk(b"00db", d))
        at += len(body[-1])
    return _chunk(b"RIFF", b"AVI " + head + _chunk(b"LIST", b"movi" + b"".join(body)) + _chunk(b"idx1", b"".join(index)))


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        size = struct.unpack_from("<I", data, at + 4)[0]
        yield data[at : at + 4], at + 8, min(end, at + 8 + size)
        at += 8 + size + size % 2


def decode(data: bytes) -> Iterator[np.ndarray]:
    """The pictures of a file, height x width x 3."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI")
    width = height = 0
    for name, at, end in _chunks(data, 12, len(data)):
        kind = data[at : at + 4]
        if name == b"LIST" and kind == b"hdrl":
            for part, a, b in _chunks(data, at + 4, end):
                if part == b"LIST" and data[a : a + 4] == b"strl":
                    for sub, x, _ in _chunks(data, a + 4, b):
                        if sub == b"strf":
                            width, height, _, bits, packed = struct.unpack_from("<iiHHI", data, x + 4)
                            if bits != 24 or packed:
                                raise ValueError("only uncompressed 24-bit AVI")
        elif name == b"LIST" and kind == b"movi":
            stride = (width * 3 + 3) // 4 * 4
            for part, a, b in _chunks(data, at + 4, end):
                if part == b"00db":
                    rows = np.frombuffer(data, np.uint8, b - a, a).reshape(height, stride)[::-1, : width * 3]
                    yield rows.reshape(height, width, 3)
