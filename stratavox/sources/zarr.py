"""Zarr version 2 arrays on disk: metadata, chunk names and chunk codecs."""

from __future__ import annotations

import json
import zlib
from collections.abc import Sequence

import numpy as np


def metadata(shape: Sequence[int], chunk: Sequence[int], dtype: str, level: int = 1) -> str:
    return json.dumps({"zarr_format": 2, "shape": list(shape), "chunks": list(chunk), "dtype": np.dtype(dtype).str, "compressor": {"id": "zlib", "level": level}, "fill_value": 0, "order": "C", "filters": None})


def chunk_name(index: Sequence[int], separator: str = ".") -> str:
    return separator.join(map(str, index))


def encode(block: np.ndarray, chunk: Sequence[int], level: int = 1) -> bytes:
    """One chunk; chunks at the end of the array are filled up with zeros, as the format wants."""
    full = np.zeros(chunk, block.dtype)
    full[tuple(slice(0, n) for n in block.shape)] = block
    return zlib.compress(full.tobytes(), level)


def decode(data: bytes, meta: dict, index: Sequence[int]) -> np.ndarray:
    """One chunk, cut to the array; compressors: none, zlib, gzip and zstd."""
    kind = (meta.get("compressor") or {}).get("id")
    if meta.get("filters"):
        raise ValueError("filters have no support")
    if kind == "zlib":
        data = zlib.decompress(data)
    elif kind == "gzip":
        data = zlib.decompress(data, 31)
    elif kind == "zstd":
        import zstandard

        data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
    elif kind is not None:
        raise ValueError(f"no support for compressor {kind!r}")
    a = np.frombuffer(data, meta["dtype"]).reshape(meta["chunks"], order=meta.get("order", "C"))
    size = [min(c, s - i * c) for c, s, i in zip(meta["chunks"], meta["shape"], index, strict=True)]
    return a[tuple(slice(0, n) for n in size)]
