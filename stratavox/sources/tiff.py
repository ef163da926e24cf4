"""TIFF: single-channel images, unsigned, signed or floating point, in strips or tiles, uncompressed, LZW or deflate, with or without
differences along the rows, classic and big files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
_NONE, _LZW, _DEFLATE, _OLD_DEFLATE = 1, 5, 8, 32946


def lzw_decode(data: bytes) -> bytes:
    """TIFF's LZW: codes from the high bit on, 9 bits that grow to 12 one code early, 256 clears the table, 257 ends."""
    single = [bytes([k]) for k in range(256)] + [b"", b""]
    table, out, previous = single.copy(), [], b""
    held = bits = 0
    width, grows = 9, 511
    for byte in data:
        held = held << 8 | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 256:
            table, previous, width, grows = single.copy(), b"", 9, 511
            continue
        if code == 257:
            break
        if code < len(table):
            entry = table[code]
        elif code == len(table) and previous:
            entry = previous + previous[:1]
        else:
            raise ValueError("not LZW data")
        out.append(entry)
        if previous:
            table.append(previous + entry[:1])
            if len(table) == grows and width < 12:
                width += 1
                grows = (1 << width) - 1
        previous = entry
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    """The inverse of lzw_decode()."""
    out, held, bits = bytearray(), 0, 0
    single = {bytes([k]): k for k in range(256)}
    table, width, code = single.copy(), 9, b""

    def put(c: int) -> None:
        nonlocal held, bits
        held = held << width | c
        bits += width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    put(256)
    for k in range(len(data)):
        longer = code + data[k : k + 1]
        if longer in table:
            code = longer
            continue
        put(table[code])
        table[longer] = len(table) + 2
        if len(table) + 2 == 4094:
            put(256)
            table, width = single.copy(), 9
        elif len(table) + 2 == 1 << width:
            width += 1
        code = data[k : k + 1]
    if code:
        put(table[code])
        if len(table) + 3 == 1 << width and width < 12:
            width += 1
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


_UNPACK = {_NONE: lambda raw: raw, _LZW: lzw_decode, _DEFLATE: zlib.decompress, _OLD_DEFLATE: zlib.decompress}


@dataclass(frozen=True)
class Page:
    """One image of a file: where its segments, strips or tiles, are and what they hold."""

    shape: tuple[int, int]
    dtype: str
    compression: int
    predictor: int
    segment: tuple[int, int]
    tiled: bool
    offsets: tuple[int, ...]
    counts: tuple[int, ...]

    def decode(self, read, rows: slice = slice(None), cols: slice = slice(None)) -> np.ndarray:
        """The image or a box of it; of the file only the segments that meet the box are read."""
        (h, w), (sh, sw) = self.shape, self.segment
        (y0, y1, _), (x0, x1, _) = rows.indices(h), cols.indices(w)
        out = np.zeros((max(0, y1 - y0), max(0, x1 - x0)), np.dtype(self.dtype).newbyteorder("="))
        across = -(-w // sw)
        for r in range(y0 // sh, -(-y1 // sh) if out.size else 0):
            for c in range(x0 // sw, -(-x1 // sw)):
                k = r * across + c
                raw = _UNPACK[self.compression](read(self.offsets[k], self.counts[k]))
                height = sh if self.tiled else min(sh, h - r * sh)
                a = np.frombuffer(raw, self.dtype)[: height * sw].reshape(height, sw)
                if self.predictor == 2:
                    a = np.cumsum(a, axis=1, dtype=a.dtype.newbyteorder("="))
                top, left = r * sh, c * sw
                ya, yz, xa, xz = max(y0, top), min(y1, top + height), max(x0, left), min(x1, left + sw)
                out[ya - y0 : yz - y0, xa - x0 : xz - x0] = a[ya - top : yz - top, xa - left : xz - left]
        return out


def pages(read) -> Iterator[Page]:
    """The images of a file; read(offset, n) gives bytes."""
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None:
        raise ValueError("not a TIFF file")
    big = struct.unpack(order + "H", head[2:4])[0] == 43
    at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
    count_code, entry, word = ("Q", 20, "Q") if big else ("H", 12, "I")
    while at:
        width = struct.calcsize(order + count_code)
        n = struct.unpack(order + count_code, read(at, width))[0]
        block = read(at + width, n * entry + struct.calcsize(word))
        tags: dict[int, tuple] = {}
        for i in range(n):
            e = block[i * entry : (i + 1) * entry]
            tag, kind = struct.unpack(order + "HH", e[:4])
            many = struct.unpack(order + word, e[4 : 4 + struct.calcsize(word)])[0]
            size, body = _SIZES.get(kind, 1) * many, e[4 + struct.calcsize(word) :]
            if kind in _CODES:
                raw = body[:size] if size <= len(body) else read(struct.unpack(order + word, body[: struct.calcsize(word)])[0], size)
                tags[tag] = struct.unpack(f"{order}{many}{_CODES[kind]}", raw)
        if tags.get(277, (1,))[0] != 1:
            raise ValueError("only single-channel images")
        bits, form = tags.get(258, (1,))[0], tags.get(339, (1,))[0]
        kind = {1: "u", 2: "i", 3: "f"}.get(form)
        compression, predictor = tags.get(259, (1,))[0], tags.get(317, (1,))[0]
        if kind is None or bits not in (8, 16, 32, 64) or compression not in _UNPACK or predictor not in (1, 2):
            raise ValueError(f"no support for {bits} bits, format {form}, compression {compression}, predictor {predictor}")
        h, w = tags[257][0], tags[256][0]
        tiled = 322 in tags
        segment = (tags[323][0], tags[322][0]) if tiled else (min(tags.get(278, (h,))[0], h), w)
        offsets, counts = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
        yield Page((h, w), f"{order}{kind}{bits // 8}", compression, predictor, segment, tiled, offsets, counts)
        at = struct.unpack(order + word, block[n * entry :])[0]


def from_bytes(data: bytes, squeeze: bool = True) -> np.ndarray:
    """All images of a file as one (pages, height, width) array; with squeeze, axes of length 1 go."""
    read = lambda at, n: data[at : at + n]
    a = np.stack([p.decode(read) for p in pages(read)])
    return a.squeeze() if squeeze else a


def _pack(a: np.ndarray, compression: int, predictor: int) -> bytes:
    if predictor == 2:
        a = np.concatenate([a[:, :1], np.diff(a, axis=1).astype(a.dtype)], axis=1)
    raw = np.ascontiguousarray(a).tobytes()
    return {_NONE: lambda: raw, _LZW: lambda: lzw_encode(raw), _DEFLATE: lambda: zlib.compress(raw)}[compression]()


def directory(shape: tuple[int, int], dtype: np.dtype, compression: int, predictor: int, tile: tuple[int, int] | None, rows: int, offsets: list[int], counts: list[int], at: int, nxt: int, big: bool) -> bytes:
    """The little-endian description of one page that stands at `at`: its tags, then lists of places that don't fit in them."""
    word, count, entry, wide = ("Q", "Q", 20, 16) if big else ("I", "H", 12, 4)
    kinds = {3: "H", 4: "I", 16: "Q"}
    tags = [(256, 4, [shape[1]]), (257, 4, [shape[0]]), (258, 3, [dtype.itemsize * 8]), (259, 3, [compression]), (262, 3, [1])]
    tags += [] if tile else [(273, wide, offsets)]
    tags += [(277, 3, [1])] + ([] if tile else [(278, 4, [rows]), (279, wide, counts)]) + [(284, 3, [1]), (317, 3, [predictor])]
    tags += [(322, 4, [tile[1]]), (323, 4, [tile[0]]), (324, wide, offsets), (325, wide, counts)] if tile else []
    tags.append((339, 3, [{"u": 1, "i": 2, "f": 3}[dtype.kind]]))
    after = at + struct.calcsize("<" + count) + len(tags) * entry + struct.calcsize("<" + word)
    out, rest = bytearray(struct.pack("<" + count, len(tags))), bytearray()
    for tag, kind, values in tags:
        raw = struct.pack(f"<{len(values)}{kinds[kind]}", *values)
        if len(raw) > struct.calcsize(word):
            place = after + len(rest)
            rest += raw
            raw = struct.pack("<" + word, place)
        out += struct.pack("<HH" + word, tag, kind, len(values)) + raw.ljust(struct.calcsize(word), b"\0")
    return bytes(out + struct.pack("<" + word, nxt) + rest)


def head(first: int, big: bool) -> bytes:
    return b"II" + (struct.pack("<HHHQ", 43, 8, 0, first) if big else struct.pack("<HI", 42, first))


def to_bytes(volume: np.ndarray, compress: bool | str = False, predictor: int = 1, tile: tuple[int, int] | None = None, rows: int | None = None) -> bytes:
    """A little-endian multi-page file in strips of `rows` rows, one a page unless it is said, or in tiles; a big file if offsets
    need it. compress: False, True (deflate) or "lzw"; predictor 2 stores differences along the rows."""
    if volume.ndim == 2:
        volume = volume[None]
    if predictor == 2 and volume.dtype.kind == "f":
        raise ValueError("differences are for whole numbers")
    volume = np.ascontiguousarray(volume.astype(volume.dtype.newbyteorder("<")))
    compression = {False: _NONE, True: _DEFLATE, "lzw": _LZW}[compress]
    h, w = volume.shape[1:]
    sh, sw = tile or (min(rows or h, h), w)
    packed = []
    for page in volume:
        cuts = [page[y : y + sh, x : x + sw] for y in range(0, h, sh) for x in range(0, w, sw)]
        if tile:
            cuts = [np.pad(c, ((0, sh - c.shape[0]), (0, sw - c.shape[1])), mode="edge") for c in cuts]
        packed.append([_pack(c, compression, predictor) for c in cuts])
    big = sum(len(x) + 1 for p in packed for x in p) + sum(400 + 32 * len(p) for p in packed) > 0xFFFF0000
    out = bytearray(head(16 if big else 8, big))
    for k, segments in enumerate(packed):
        size = len(directory((h, w), volume.dtype, compression, predictor, tile, sh, [0] * len(segments), [0] * len(segments), 0, 0, big))
        counts = [len(x) for x in segments]
        starts = np.r_[0, np.cumsum([n + (n & 1) for n in counts])]
        data = len(out) + size + (size & 1)
        nxt = data + int(starts[-1]) if k + 1 < len(packed) else 0
        out += directory((h, w), volume.dtype, compression, predictor, tile, sh, [data + int(x) for x in starts[:-1]], counts, len(out), nxt, big).ljust(size + (size & 1), b"\0")
        for x in segments:
            out += x + b"\0" * (len(x) & 1)
    return bytes(out)
