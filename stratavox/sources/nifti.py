"""NIfTI-1 single files, gzipped or not: the volume alone, axes (z, y, x)."""

from __future__ import annotations

import gzip
import struct

import numpy as np

_KINDS = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}


def from_bytes(data: bytes) -> np.ndarray:
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    order = "<" if struct.unpack("<i", data[:4])[0] == 348 else ">"
    if struct.unpack(order + "i", data[:4])[0] != 348:
        raise ValueError("not a NIfTI-1 file")
    dim = struct.unpack(order + "8h", data[40:56])
    kind, start = struct.unpack(order + "h", data[70:72])[0], int(struct.unpack(order + "f", data[108:112])[0])
    slope, inter = struct.unpack(order + "2f", data[112:120])
    shape = [max(1, n) for n in dim[1 : 1 + max(3, dim[0])]]
    a = np.frombuffer(data, np.dtype(order + _KINDS[kind]), int(np.prod(shape)), start).reshape(shape[::-1]).squeeze()
    return a * slope + inter if slope not in (0.0, 1.0) or inter else a.astype(a.dtype.newbyteorder("="))


def to_bytes(volume: np.ndarray, compress: bool = True) -> bytes:
    kind = next(k for k, v in _KINDS.items() if np.dtype(v) == volume.dtype)
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, *volume.shape[::-1], 1, 1, 1, 1)
    struct.pack_into("<2h", head, 70, kind, volume.dtype.itemsize * 8)
    struct.pack_into("<8f", head, 76, 1, 1, 1, 1, 1, 1, 1, 1)
    struct.pack_into("<3f", head, 108, 352, 1, 0)
    head[344:348] = b"n+1\0"
    data = bytes(head) + np.ascontiguousarray(volume).tobytes()
    return gzip.compress(data) if compress else data
