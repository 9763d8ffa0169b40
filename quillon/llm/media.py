"""Media columns: progressive JPEG files that hold bytes without loss, and RGB tensors.

JPEG loses nothing of its own unit, the quantised coefficient.  A byte of the payload is
stored as the coefficient of magnitude category 8 whose eight extra bits it is, in zigzag
order over the blocks of a 4:2:0 image with quantisers of 1; bytes 255 fill the last rows.
A file has a scan for the upper bits of the first coefficients of all components, two
spectral bands of upper bits for each component, and scans that refine the last bit.

The reader takes any baseline-precision progressive Huffman file: scans are added up in
arrays of coefficients, which an inverse transform in numpy, upsampling of chroma and
conversion of colours turn into a full-resolution tensor.  Where a scan's codes turn out to
be of one length it is read as a matrix of bits, else bit by bit.

* null and empty texts hold one unit of fill bytes; equal texts have equal files
* files without a comment on their payload have a null payload
* repeated rows stay; an empty table gives an empty result; only named columns take part
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm.common import extended

UNIT = 576
FILL = 255
ROWS = 16


def _zigzag() -> np.ndarray:
    """Place in a row-wise block of each coefficient in zigzag order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()
_K = np.arange(8)
DCT = (np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16) * np.where(_K[:, None] == 0, np.sqrt(1 / 8), 0.5)).astype(np.float32)
#: id and sampling factors of luma and chroma; blocks of a unit of the image.
COMPONENTS = ((1, 2, 2), (2, 1, 1), (3, 1, 1))
BANDS = ((1, 5), (6, 63))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def _table(kind: int, number: int, lengths: dict[int, list[int]]) -> bytes:
    counts = bytes(len(lengths.get(n, ())) for n in range(1, 17))
    return _segment(0xC4, bytes([kind << 4 | number]) + counts + bytes(s for n in sorted(lengths) for s in lengths[n]))


def _codes(lengths: dict[int, list[int]]) -> dict[int, tuple[int, int]]:
    """Symbol to (code, length), as the format assigns them."""
    out, code = {}, 0
    for n in range(1, 17):
        for s in lengths.get(n, ()):
            out[s] = (code, n)
            code += 1
        code <<= 1
    return out


#: Code lengths of the tables that the writer uses: categories of differences of first
#: coefficients; upper bits; ends of blocks.
DC_TABLE, AC_TABLE, END_TABLE = {4: list(range(12))}, {1: [0x07]}, {1: [0x00]}


def _pack(values: np.ndarray, lengths: np.ndarray) -> bytes:
    """Bit strings of these lengths one after another, filled with ones and stuffed."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    bits = np.ones(-(-total // 8) * 8, np.uint8)
    at = np.arange(total) - np.repeat(ends - lengths, lengths)
    bits[:total] = np.repeat(values, lengths) >> (np.repeat(lengths, lengths) - 1 - at) & 1
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def layout(n_blocks: int) -> tuple[int, int]:
    """Columns and rows of units (six blocks each) that hold so many blocks."""
    units = max(1, -(-n_blocks // 6))
    columns = -(-units // 4095)
    return columns, -(-units // columns)


def write_jpeg(payload: bytes, n_bytes: int) -> bytes:
    """A file that holds ``payload``; its comment tells the length and ``n_bytes``."""
    columns, rows = layout(-(-len(payload) // 64))
    flat = np.full(columns * rows * 6 * 64, FILL, np.uint8)
    flat[: len(payload)] = np.frombuffer(payload, np.uint8)
    units = flat.reshape(rows, columns, 6, 64)
    # blocks by component, row-wise as scans of one component go
    luma = units[:, :, :4].reshape(rows, columns, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64)
    planes = [luma, units[:, :, 4].reshape(-1, 64), units[:, :, 5].reshape(-1, 64)]
    scan = lambda ids, ss, se, ah, al: _segment(0xDA, bytes([len(ids), *(x for i in ids for x in (i, 0)), ss, se, ah << 4 | al]))
    out = [
        b"\xff\xd8",
        _segment(0xFE, f"payload {len(payload)} {n_bytes}".encode()),
        _segment(0xDB, b"\x00" + b"\x01" * 64),
        _segment(0xC2, struct.pack(">BHHB", 8, rows * 16, columns * 16, 3) + bytes(x for i, h, v in COMPONENTS for x in (i, h << 4 | v, 0))),
        _table(0, 0, DC_TABLE),
        _table(1, 0, AC_TABLE),
    ]
    value = units[..., 0].astype(np.int32)
    value = np.where(value < 128, value - 255, value)
    upper = value >> 1
    diff = np.empty_like(upper)
    for part in (slice(0, 4), slice(4, 5), slice(5, 6)):
        own = upper[:, :, part].reshape(-1)
        diff[:, :, part] = np.diff(own, prepend=0).reshape(diff[:, :, part].shape)
    diff = diff.reshape(-1)
    size = np.frexp(np.abs(diff).astype(np.float64))[1].astype(np.int64)
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
    out += [scan((1, 2, 3), 0, 0, 0, 1), _pack(size << size | extra, 4 + size)]
    for (i, _, _), blocks in zip(COMPONENTS, planes, strict=True):
        for ss, se in BANDS:
            # a code of one bit, 0, before seven extra bits
            out += [scan((i,), ss, se, 0, 1), (blocks[:, ss : se + 1] >> 1).tobytes()]
    out += [scan((1, 2, 3), 0, 0, 1, 0), np.packbits(_filled(value.reshape(-1) & 1)).tobytes().replace(b"\xff", b"\xff\x00"), _table(1, 0, END_TABLE)]
    for (i, _, _), blocks in zip(COMPONENTS, planes, strict=True):
        bits = (blocks & 1) ^ (blocks < 128)  # the last bit of the magnitude
        bits[:, 0] = 0  # the code for the end of the block
        out += [scan((i,), 1, 63, 1, 0), np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")]
    return b"".join([*out, b"\xff\xd9"])


def _filled(bits: np.ndarray) -> np.ndarray:
    return np.concatenate([bits, np.ones(-len(bits) % 8, bits.dtype)]).astype(np.uint8)


class Bits:
    """Bit by bit; beyond the end are zeros."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def _more(self) -> None:
        self.held = self.held << 48 | int.from_bytes(self.data[self.at : self.at + 6].ljust(6, b"\0"), "big")
        self.at, self.n = self.at + 6, self.n + 48

    def take(self, n: int) -> int:
        if self.n < n:
            self._more()
        self.n -= n
        out = self.held >> self.n
        self.held &= (1 << self.n) - 1
        return out

    def symbol(self, table: list[tuple[int, int]]) -> int:
        if self.n < 16:
            self._more()
        symbol, length = table[self.held >> self.n - 16]
        self.n -= length
        self.held &= (1 << self.n) - 1
        return symbol


def _signed(bits: int, size: int) -> int:
    return bits if not size or bits >> size - 1 else bits - (1 << size) + 1


@cache
def _lookup(spec: bytes) -> list[tuple[int, int]]:
    """(symbol, length) for the next 16 bits, of a table's counts and symbols."""
    out, at = [], 16
    for n in range(1, 17):
        for s in spec[at : at + spec[n - 1]]:
            out += [(s, n)] * (1 << 16 - n)
        at += spec[n - 1]
    return out + [(0, 16)] * ((1 << 16) - len(out))


class Plane:
    """A component's factors and its coefficients, in zigzag order, padded to whole units."""

    def __init__(self, h: int, v: int, quant: int, width: int, height: int, hmax: int, vmax: int):
        self.h, self.v, self.quant = h, v, quant
        self.wide, self.high = -(-width // (8 * hmax)) * h, -(-height // (8 * vmax)) * v
        # blocks that scans of this component alone go over
        self.own = -(--(-width * h // hmax) // 8), -(--(-height * v // vmax) // 8)
        self.coefficients = np.zeros((self.high * self.wide, 64), np.int32)


def _order(plane: Plane, alone: bool) -> np.ndarray:
    """Numbers of the plane's blocks by unit of the scan, (units, blocks of a unit)."""
    grid = np.arange(plane.high * plane.wide).reshape(plane.high, plane.wide)
    if alone:
        return grid[: plane.own[1], : plane.own[0]].reshape(-1, 1)
    cut = grid.reshape(plane.high // plane.v, plane.v, plane.wide // plane.h, plane.h)
    return cut.transpose(0, 2, 1, 3).reshape(-1, plane.v * plane.h)


def _matrix(data: bytes, rows: int, stride: int) -> np.ndarray | None:
    """The first rows * stride bits as a matrix."""
    if rows * stride > 8 * len(data):
        return None
    return np.unpackbits(np.frombuffer(data, np.uint8, -(-rows * stride // 8)), count=rows * stride).reshape(rows, stride)


def _number(bits: np.ndarray) -> np.ndarray:
    out = np.zeros(len(bits), np.int32)
    for k in range(bits.shape[1]):
        out = out << 1 | bits[:, k]
    return out


def _constant(data: bytes, table: list, rows: int, extra: int | None) -> tuple[np.ndarray, int] | None:
    """Extra bits by row and the symbol, if the scan has but one code; else None.

    If the first code holds at every place where it would have to follow its like, then
    by induction these are the codes of the scan.
    """
    head = int.from_bytes(data[:2].ljust(2, b"\xff"), "big")
    symbol, length = table[head]
    bits = _matrix(data, rows, length + (symbol & 15 if extra is None else extra))
    if bits is None or (bits[:, :length] != bits[0, :length]).any():
        return None
    return bits[:, length:], symbol


def _first_dc(data: bytes, order: list[np.ndarray], planes: list[Plane], tables: list, al: int) -> None:
    bits, take = Bits(data), _signed
    plan = [(k, n) for k, o in enumerate(order) for n in [o.shape[1]] for _ in range(n)]
    last, out = [0] * len(planes), [[] for _ in planes]
    for _ in range(len(order[0])):
        for k, _n in plan:
            size = bits.symbol(tables[k])
            if size:
                last[k] += take(bits.take(size), size)
            out[k].append(last[k])
    for o, p, values in zip(order, planes, out, strict=True):
        p.coefficients[o.reshape(-1), 0] = np.array(values, np.int32) << al


def _refine_dc(data: bytes, order: list[np.ndarray], planes: list[Plane], al: int) -> None:
    n = [o.shape[1] for o in order]
    found = _matrix(data + b"\0" * 8, len(order[0]), sum(n))
    if found is None:
        raise ValueError("the scan is cut off")
    at = 0
    for o, p, k in zip(order, planes, n, strict=True):
        p.coefficients[o, 0] |= found[:, at : at + k].astype(np.int32) << al
        at += k


def _first_ac(data: bytes, blocks: np.ndarray, plane: Plane, table: list, ss: int, se: int, al: int) -> None:
    n = se - ss + 1
    fast = _constant(data, table, len(blocks) * n, None)
    if fast and fast[1] and fast[1] < 16:
        size, found = fast[1], _number(fast[0])
        found = np.where(found >> size - 1, found, found - (1 << size) + 1)
        plane.coefficients[blocks, ss : se + 1] = found.reshape(-1, n) << al
        return
    bits, run = Bits(data), 0
    for b in blocks.tolist():
        if run:
            run -= 1
            continue
        k = ss
        while k <= se:
            rs = bits.symbol(table)
            zeros, size = rs >> 4, rs & 15
            if size:
                k += zeros
                plane.coefficients[b, k] = _signed(bits.take(size), size) * (1 << al)
                k += 1
            elif zeros == 15:
                k += 16
            else:
                run = (1 << zeros) - 1 + (bits.take(zeros) if zeros else 0)
                break


def _refine_ac(data: bytes, blocks: np.ndarray, plane: Plane, table: list, ss: int, se: int, al: int) -> None:
    part, one = plane.coefficients[blocks, ss : se + 1], 1 << al
    if (part != 0).all():
        fast = _constant(data, table, len(blocks), se - ss + 1)
        if fast and fast[1] == 0:
            plane.coefficients[blocks, ss : se + 1] = part + np.sign(part) * (fast[0].astype(np.int32) << al)
            return
    bits, run = Bits(data), 0

    def correct(row: list[int], k: int) -> None:
        if bits.take(1):
            row[k] += one if row[k] > 0 else -one

    for b in blocks.tolist():
        row, k = plane.coefficients[b].tolist(), ss
        while k <= se and not run:
            rs = bits.symbol(table)
            zeros, size = rs >> 4, rs & 15
            if not size and zeros < 15:
                run = (1 << zeros) + (bits.take(zeros) if zeros else 0)
                break
            new = (one if bits.take(1) else -one) if size else 0
            while k <= se:
                if row[k]:
                    correct(row, k)
                elif zeros:
                    zeros -= 1
                else:
                    row[k] = new
                    k += 1
                    break
                k += 1
        if run:
            for k in range(k, se + 1):
                if row[k]:
                    correct(row, k)
            run -= 1
        plane.coefficients[b] = row


_END = re.compile(rb"\xff[^\x00\xff\xd0-\xd7]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


class Picture:
    """What a file holds: width, height, planes, quantisers and comments."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        self.comments, self.planes, self.quants = [], {}, {}
        tables, interval, at = {}, 0, 2
        while True:
            marker, n = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + n]
            if marker == 0xD9:
                break
            if marker == 0xFE:
                self.comments.append(body)
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quants[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.int32)
                    body = body[65 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    end = 17 + sum(body[1:17])
                    tables[body[0]] = _lookup(body[1:end])
                    body = body[end:]
            elif marker == 0xC2:
                _, self.height, self.width, count = struct.unpack(">BHHB", body[:6])
                parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(count)]
                hmax, vmax = max(p[1] for p in parts), max(p[2] for p in parts)
                self.planes = {i: Plane(h, v, q, self.width, self.height, hmax, vmax) for i, h, v, q in parts}
            elif 0xC0 <= marker <= 0xCF and marker != 0xC8:
                raise ValueError("not a progressive Huffman file")
            elif marker == 0xDD:
                interval = int.from_bytes(body, "big")
            at += 2 + n
            if marker == 0xDA:
                end = _END.search(data, at)
                stop = end.start() if end else len(data)
                self._scan(body, data[at:stop], tables, interval)
                if not end:
                    break
                at = stop

    def _scan(self, head: bytes, data: bytes, tables: dict, interval: int) -> None:
        ids = [(head[1 + 2 * k], head[2 + 2 * k]) for k in range(head[0])]
        ss, se, ah, al = *head[-3:-1], head[-1] >> 4, head[-1] & 15
        planes = [self.planes[i] for i, _ in ids]
        order = [_order(p, len(planes) == 1) for p in planes]
        pieces = _RESTART.split(data) if interval else [data]
        size = interval or len(order[0])
        for k, piece in enumerate(pieces):
            piece = piece.replace(b"\xff\x00", b"\xff")
            own = [o[k * size : (k + 1) * size] for o in order]
            if ss == 0 and ah == 0:
                _first_dc(piece, own, planes, [tables[t >> 4] for _, t in ids], al)
            elif ss == 0:
                _refine_dc(piece, own, planes, al)
            else:
                (_refine_ac if ah else _first_ac)(piece, own[0].reshape(-1), planes[0], tables[16 | ids[0][1] & 15], ss, se, al)

    def payload(self) -> tuple[bytes, int] | None:
        """The bytes that ``write_jpeg`` stored, and the length that it was told."""
        found = [m for c in self.comments if (m := re.fullmatch(rb"payload (\d+) (\d+)", c))]
        if not found:
            return None
        y, cb, cr = (p.coefficients for p in self.planes.values())
        rows, columns = self.height // 16, self.width // 16
        units = np.empty((rows, columns, 6, 64), np.int32)
        units[:, :, :4] = y.reshape(rows, 2, columns, 2, 64).transpose(0, 2, 1, 3, 4).reshape(rows, columns, 4, 64)
        units[:, :, 4], units[:, :, 5] = cb.reshape(rows, columns, 64), cr.reshape(rows, columns, 64)
        flat = units.reshape(-1)[: int(found[0][1])]
        return np.where(flat < 0, flat + 255, flat).astype(np.uint8).tobytes(), int(found[0][2])

    def rgb(self) -> np.ndarray:
        """The image at full resolution, (height, width, 3) of bytes."""
        full = []
        hmax, vmax = max(p.h for p in self.planes.values()), max(p.v for p in self.planes.values())
        for p in self.planes.values():
            blocks = np.zeros((len(p.coefficients), 64), np.float32)
            blocks[:, ZIGZAG] = p.coefficients * self.quants[p.quant]
            samples = DCT.T @ blocks.reshape(-1, 8, 8) @ DCT
            plane = samples.reshape(p.high, p.wide, 8, 8).transpose(0, 2, 1, 3).reshape(8 * p.high, 8 * p.wide)
            plane = np.clip(np.rint(plane + 128), 0, 255).astype(np.float32)
            full.append(plane.repeat(vmax // p.v, axis=0).repeat(hmax // p.h, axis=1)[: self.height, : self.width])
        if len(full) == 1:
            return np.repeat(full[0][:, :, None], 3, axis=2).astype(np.uint8)
        y, cb, cr = full[0], full[1] - 128, full[2] - 128
        out = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
        return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def store(docs: DataFrame, text: str = "text", unit: int = UNIT, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) and ``media``, the file that holds the text's
    UTF-8 bytes, filled up to a positive multiple of ``unit``."""
    kept = [c for c in (docs.columns if keep is None else keep) if c != "media"]
    source = docs.select(*kept, docs[text].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                rows, files = batch.slice(start, ROWS), []
                for value in rows.column("__text"):
                    raw = (value.as_py() or "").encode()
                    files.append(write_jpeg(raw + bytes([FILL]) * (unit - len(raw) if not raw else -len(raw) % unit), len(raw)))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), pa.array(files, pa.binary())], names=[*kept, "media"])

    return source.mapInArrow(run, extended(source.drop("__text").schema, "media binary"))


_READ = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, width int, height int"


def read(stored: DataFrame, media: str = "media", keep: list[str] | None = None, tensors: bool = True, payloads: bool = True) -> DataFrame:
    """Reads files back: digests of what they hold, a feature of the picture (its size, mean
    colours and the tensor's checksum) and, if asked for, the tensor's bytes as ``rgb``,
    row by row, and, unless it isn't asked for, the ``payload``.  A null file has nulls."""
    kept = [c for c in (stored.columns if keep is None else keep) if c != media]
    source = stored.select(*kept, stored[media].alias("__media"))
    schema = extended(source.drop("__media").schema, _READ + ", rgb binary" * tensors + ", payload binary" * (tensors and payloads))
    names = schema.fieldNames()[len(kept) :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                rows = batch.slice(start, ROWS)
                out = [_digest(v.as_py(), tensors) for v in rows.column("__media")]
                columns = [pa.array(c, t) for c, t in zip(list(zip(*out, strict=True))[: len(names)], kinds, strict=False)]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), *columns], names=[*kept, *names])

    return source.mapInArrow(run, schema)


def _digest(data: bytes | None, tensors: bool) -> tuple:
    if data is None:
        return (None,) * (9 + 2 * tensors)
    picture = Picture(data)
    rgb, held = picture.rgb(), picture.payload()
    payload, n_bytes = held or (None, None)
    means = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64) // max(1, rgb.shape[0] * rgb.shape[1])
    raw = rgb.tobytes()
    feature = f"{picture.width}x{picture.height} rgb {'/'.join(map(str, means.tolist()))} crc32 {zlib.crc32(raw):08x}"
    of_payload = (None,) * 3 if payload is None else (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    out = (n_bytes, *of_payload, len(data), hashlib.sha256(data).hexdigest(), feature, picture.width, picture.height)
    return out + (raw, payload) if tensors else out
