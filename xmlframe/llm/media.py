"""Media columns: payloads kept losslessly in progressive JPEG files, decoded to coefficients, samples and RGB tensors.

The unit of a JPEG file is the quantized coefficient. A payload byte b becomes one coefficient of magnitude 128 + b % 128, negative
from b = 128 on, so the file keeps every byte exactly whatever the transform does to samples. Files are 4:2:2: two luma
blocks and one block of each chroma to a unit of 16 x 8 pixels; unused blocks at the end are blanks and a comment segment holds
the payload's length.

Scans: DC bits above the last, the last DC bit, then for each component and each of two frequency bands the AC bits above the
last and the last bit. The decoder takes any Huffman-coded progressive file of 8-bit samples: it accumulates spectral
bands and bit refinements into coefficient arrays, scales them by the quantization tables, inverse-transforms all blocks
of a component in numpy, repeats subsampled chroma and converts to RGB. Runs of blocks without new coefficients and bands
whose codes are one byte a coefficient are decoded as arrays; anything else goes symbol by symbol.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xmlframe.llm.common import ship

ROUND = 192
BANDS = ((1, 5), (6, 63))
AC_CODE = 0x07  # run 0, size 7
_TAG = b"payload="


def _zigzag() -> np.ndarray:
    """Natural index of each coefficient in zigzag order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()
_FREQ = np.arange(8)
_COS = (np.where(_FREQ == 0, np.sqrt(0.125), 0.5)[:, None] * np.cos((2 * _FREQ[None, :] + 1) * _FREQ[:, None] * np.pi / 16)).astype(np.float32)


def pad(data: bytes) -> bytes:
    """Bytes 32 behind the data up to a positive multiple of 192."""
    return data + b" " * (max(1, -(-len(data) // ROUND)) * ROUND - len(data))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, lengths: list[int], symbols: list[int]) -> bytes:
    return _segment(0xC4, bytes([kind, *lengths, *[0] * (16 - len(lengths)), *symbols]))


def _scan(components: list[tuple[int, int]], band: tuple[int, int], high: int, low: int, data: bytes) -> bytes:
    head = bytes([len(components)]) + b"".join(bytes(x) for x in components) + bytes([*band, high << 4 | low])
    return _segment(0xDA, head) + data.replace(b"\xff", b"\xff\x00")


def _packed(bits: np.ndarray) -> bytes:
    return np.packbits(np.concatenate((bits, np.ones(-len(bits) % 8, np.uint8)))).tobytes()


def layout(blocks: int) -> tuple[int, int]:
    """(rows, columns) of 16 x 8 pixel units that hold at least so many blocks, four a unit."""
    units = -(-blocks // 4)
    rows = min(8000, -(-units // 64))
    return rows, -(-units // rows)


def encode(payload: bytes) -> bytes:
    """A progressive JPEG file whose coefficients are the payload; its length has to be a multiple of 64."""
    rows, cols = layout(len(payload) // 64)
    units = rows * cols
    raw = np.frombuffer(payload + b" " * (256 * units - len(payload)), np.uint8).reshape(-1, 64)
    negative, size = raw >> 7, raw & 127 | 128
    out = [b"\xff\xd8", _segment(0xFE, _TAG + str(len(payload)).encode()), _segment(0xDB, bytes([0]) + b"\x01" * 64)]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, rows * 8, cols * 16, 3) + bytes([1, 0x21, 0, 2, 0x11, 0, 3, 0x11, 0])))
    out.append(_table(0x00, [0, 0, 0, 10], list(range(10))))  # DC sizes 0 to 9, four bits each
    out.append(_table(0x10, [1], [AC_CODE]))  # one bit, 0
    out.append(_table(0x11, [0, 0, 0, 15], [n << 4 for n in range(15)]))  # runs of ended blocks, four bits each

    parts = (slice(0, 2 * units), slice(2 * units, 3 * units), slice(3 * units, 4 * units))
    dc = np.where(negative[:, 0] == 1, -size[:, 0].astype(np.int32), size[:, 0])
    high = [dc[p] >> 1 for p in parts]
    steps = [np.diff(x, prepend=0) for x in high]
    order = np.concatenate((steps[0].reshape(-1, 2), steps[1][:, None], steps[2][:, None]), axis=1).ravel()
    width = np.ceil(np.log2(np.abs(order) + 1)).astype(np.int64)
    value = width << width | np.where(order < 0, order + (1 << width) - 1, order)
    shift = (width + 3)[:, None] - np.arange(14)[None, :]
    bits = (value[:, None] >> np.maximum(shift, 0) & 1).astype(np.uint8)[shift >= 0]
    last = np.concatenate(((dc[parts[0]] & 1).reshape(-1, 2), (dc[parts[1]] & 1)[:, None], (dc[parts[2]] & 1)[:, None]), axis=1).astype(np.uint8).ravel()
    all_three = [(1, 0x00), (2, 0x00), (3, 0x00)]
    out.append(_scan(all_three, (0, 0), 0, 1, _packed(bits)))
    out.append(_scan(all_three, (0, 0), 1, 0, _packed(last)))

    upper = np.where(negative == 1, 127 - (size >> 1), size >> 1).astype(np.uint8)  # code bit 0, then 7 bits: one byte
    lower = size & 1
    for number, part in enumerate(parts, 1):
        n = part.stop - part.start
        for a, b in BANDS:
            out.append(_scan([(number, 0x00)], (a, b), 0, 1, upper[part, a : b + 1].tobytes()))
            bits = []
            for at in range(0, n, 0x7FFF):
                run = min(0x7FFF, n - at)
                e = run.bit_length() - 1
                head = e << e | run - (1 << e)
                bits.append(np.array([head >> i & 1 for i in reversed(range(4 + e))], np.uint8))
                bits.append(lower[part, a : b + 1][at : at + run].ravel())
            out.append(_scan([(number, 0x01)], (a, b), 1, 0, _packed(np.concatenate(bits))))
    return b"".join([*out, b"\xff\xd9"])


@dataclass
class Component:
    number: int
    h: int
    v: int
    table: int
    wide: int = 0  # blocks a row, whole units
    high: int = 0
    own_wide: int = 0  # blocks that a scan of this component alone has
    own_high: int = 0
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int32))  # zigzag order
    _rows: np.ndarray | None = None

    def own_rows(self) -> np.ndarray:
        """Rows of ``coefficients`` in the order of a scan of this component alone."""
        if self._rows is None:
            rows = np.arange(self.own_wide * self.own_high)
            self._rows = rows // self.own_wide * self.wide + rows % self.own_wide
        return self._rows


@dataclass
class Image:
    height: int = 0
    width: int = 0
    components: list[Component] = field(default_factory=list)
    tables: dict[int, np.ndarray] = field(default_factory=dict)
    comments: list[bytes] = field(default_factory=list)


class JpegError(ValueError):
    pass


class _Bits:
    """Bits of a scan without restart markers."""

    def __init__(self, data: bytes) -> None:
        self.data = data.replace(b"\xff\x00", b"\xff")
        self.bits = np.unpackbits(np.frombuffer(self.data, np.uint8))
        self.at = 0

    def take(self, n: int) -> int:
        if n == 0:
            return 0
        a, b = self.at, self.at + n
        if b > len(self.bits):
            raise JpegError("a scan ends early")
        self.at = b
        return (int.from_bytes(self.data[a >> 3 : b + 7 >> 3], "big") >> (-b & 7)) & ((1 << n) - 1)

    def symbol(self, codes: "_Codes") -> int:
        at = self.at >> 3
        n, s = codes.short[(int.from_bytes(self.data[at : at + 2].ljust(2, b"\xff"), "big") >> (8 - (self.at & 7))) & 255]
        if n and self.at + n <= len(self.bits):
            self.at += n
            return s
        value = 0
        for n in range(1, 17):
            value = value << 1 | self.take(1)
            if (s := codes.get((n, value))) is not None:
                return s
        raise JpegError("no such code")

    def signed(self, n: int) -> int:
        x = self.take(n)
        return x if n == 0 or x >> (n - 1) else x - (1 << n) + 1


class _Codes(dict[tuple[int, int], int]):
    """Symbols by (length, code); ``short`` has (length, symbol) for each next byte that begins with a code of up to 8 bits."""

    def __init__(self, lengths: bytes, symbols: bytes) -> None:
        super().__init__()
        self.short: list[tuple[int, int]] = [(0, 0)] * 256
        code = at = 0
        for n, count in enumerate(lengths, 1):
            for _ in range(count):
                self[n, code] = symbols[at]
                if n <= 8:
                    first = code << (8 - n)
                    self.short[first : first + (1 << (8 - n))] = [(n, symbols[at])] * (1 << (8 - n))
                code, at = code + 1, at + 1
            code <<= 1


def decode(data: bytes) -> Image:
    """Coefficient arrays of a progressive JPEG file, all scans accumulated."""
    image, huffman, restart, at, unit = Image(), {}, 0, 2, (1, 1)
    if data[:2] != b"\xff\xd8":
        raise JpegError("no JPEG file")
    while True:
        if data[at] != 0xFF:
            raise JpegError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xD9:
            return image
        if marker == 0xFF:
            at += 1
            continue
        n = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xFE:
            image.comments.append(body)
        elif marker == 0xDB:
            while body:
                if body[0] >> 4:
                    image.tables[body[0] & 15], body = np.frombuffer(body[1:129], ">u2").astype(np.float32), body[129:]
                else:
                    image.tables[body[0]], body = np.frombuffer(body[1:65], np.uint8).astype(np.float32), body[65:]
        elif marker == 0xC4:
            while body:
                count = sum(body[1:17])
                huffman[body[0]], body = _Codes(body[1:17], body[17 : 17 + count]), body[17 + count :]
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
        elif marker == 0xC2:
            bits, image.height, image.width, count = struct.unpack(">BHHB", body[:6])
            if bits != 8:
                raise JpegError("samples aren't 8 bits")
            image.components = [Component(x, y >> 4, y & 15, z) for x, y, z in (body[6 + 3 * i : 9 + 3 * i] for i in range(count))]
            unit = max(c.h for c in image.components), max(c.v for c in image.components)
            across, down = -(-image.width // (8 * unit[0])), -(-image.height // (8 * unit[1]))
            for c in image.components:
                c.wide, c.high = across * c.h, down * c.v
                c.own_wide, c.own_high = -(-image.width * c.h // (8 * unit[0])), -(-image.height * c.v // (8 * unit[1]))
                c.coefficients = np.zeros((c.wide * c.high, 64), np.int32)
        elif marker == 0xDA:
            if restart:
                raise JpegError("restart intervals aren't supported")
            end = at
            while not (data[end] == 0xFF and data[end + 1] != 0):
                end = data.index(b"\xff", end + (data[end] == 0xFF))
            _read_scan(image, huffman, body, data[at:end])
            at = end
        elif marker in (0xC0, 0xC1, *range(0xC3, 0xD0)) and marker not in (0xC8, 0xCC):
            raise JpegError("no progressive Huffman file")


def _read_scan(image: Image, huffman: dict[int, dict], head: bytes, data: bytes) -> None:
    own = []
    for i in range(head[0]):
        number, tables = head[1 + 2 * i : 3 + 2 * i]
        own.append((next(c for c in image.components if c.number == number), tables))
    first, last, approx = head[1 + 2 * head[0] : 4 + 2 * head[0]]
    high, low = approx >> 4, approx & 15
    bits = _Bits(data)
    if first == 0:
        _read_dc(own, huffman, bits, high, low)
        return
    c, tables = own[0]
    rows = c.own_rows()
    codes = huffman[0x10 | tables & 15]
    if high:
        _refine_ac(c, rows, codes, bits, first, last, 1 << low)
    elif not _bytes_ac(c, rows, codes, data, first, last, low):
        _first_ac(c, rows, codes, bits, first, last, low)


def _dc_order(own: list) -> list[tuple[int, np.ndarray]]:
    """For each block place in a unit: (component, its rows in the order of units)."""
    if len(own) == 1:
        return [(0, own[0][0].own_rows())]
    out = []
    for i, (c, _) in enumerate(own):
        across, down = c.wide // c.h, c.high // c.v
        unit = np.arange(across * down)
        for y in range(c.v):
            for x in range(c.h):
                out.append((i, (unit // across * c.v + y) * c.wide + unit % across * c.h + x))
    return out


def _read_dc(own: list, huffman: dict, bits: _Bits, high: int, low: int) -> None:
    places = _dc_order(own)
    units = len(places[0][1])
    if high:
        got = bits.bits[: units * len(places)].reshape(units, len(places))
        for j, (i, rows) in enumerate(places):
            own[i][0].coefficients[rows, 0] |= got[:, j].astype(np.int32) << low
        return
    steps = np.zeros((units, len(places)), np.int64)
    tables = [huffman[own[i][1] >> 4] for i, _ in places]
    for u in range(units):
        for j, codes in enumerate(tables):
            steps[u, j] = bits.signed(bits.symbol(codes))
    for i, (c, _) in enumerate(own):
        mine = [j for j, (k, _) in enumerate(places) if k == i]
        total = np.cumsum(steps[:, mine].ravel()).reshape(units, -1)
        for x, j in enumerate(mine):
            c.coefficients[places[j][1], 0] = total[:, x] << low


def _bytes_ac(c: Component, rows: np.ndarray, codes: _Codes, data: bytes, first: int, last: int, low: int) -> bool:
    """Decode a band in which every coefficient has the code 0 of size 7, if this is one."""
    width = last - first + 1
    if codes.get((1, 0)) != AC_CODE or len(data) != len(rows) * width:
        return False
    x = np.frombuffer(data, np.uint8).reshape(-1, width)
    if (x > 127).any():
        return False
    x = x.astype(np.int32)
    c.coefficients[rows, first : last + 1] = np.where(x >= 64, x, x - 127) << low
    return True


def _first_ac(c: Component, rows: np.ndarray, codes: _Codes, bits: _Bits, first: int, last: int, low: int) -> None:
    skip = 0
    for row in rows:
        if skip:
            skip -= 1
            continue
        k = first
        while k <= last:
            s = bits.symbol(codes)
            run, size = s >> 4, s & 15
            if size:
                k += run
                c.coefficients[row, k] = bits.signed(size) * (1 << low)
                k += 1
            elif run == 15:
                k += 16
            else:
                skip = (1 << run) - 1 + bits.take(run)
                break


def _refine_ac(c: Component, rows: np.ndarray, codes: _Codes, bits: _Bits, first: int, last: int, bit: int) -> None:
    i = 0
    while i < len(rows):
        k, own = first, c.coefficients[rows[i]]
        while k <= last:
            s = bits.symbol(codes)
            run, size = s >> 4, s & 15
            if size == 0 and run < 15:  # the rest of this block and the next blocks have corrections only
                count = (1 << run) + bits.take(run)
                if k > first:
                    _correct(c.coefficients, rows[i : i + 1], bits, k, last, bit)
                    i, count = i + 1, count - 1
                if count:
                    _correct(c.coefficients, rows[i : i + count], bits, first, last, bit)
                i += count - 1
                break
            new = (bit if bits.take(1) else -bit) if size else 0
            while k <= last:
                if own[k]:
                    if bits.take(1):
                        own[k] += bit if own[k] > 0 else -bit
                elif run == 0:
                    if new:
                        own[k] = new
                    k += 1
                    break
                else:
                    run -= 1
                k += 1
        i += 1


def _correct(coefficients: np.ndarray, rows: np.ndarray, bits: _Bits, first: int, last: int, bit: int) -> None:
    own = coefficients[rows, first : last + 1]
    there = own != 0
    n = int(there.sum())
    got = bits.bits[bits.at : bits.at + n].astype(np.int32)
    if len(got) != n:
        raise JpegError("a scan ends early")
    bits.at += n
    own[there] += got * bit * np.sign(own[there])
    coefficients[rows, first : last + 1] = own


def _plane(c: Component, table: np.ndarray, first: int, last: int) -> np.ndarray:
    """Samples of block rows ``first`` to ``last`` of a component, inverse-transformed in one go."""
    own = c.coefficients[first * c.wide : last * c.wide]
    natural = np.zeros(own.shape, np.float32)
    natural[:, ZIGZAG] = own * table
    half = (natural.reshape(-1, 8) @ _COS).reshape(-1, 8, 8)  # along rows
    full = (half.transpose(0, 2, 1).reshape(-1, 8) @ _COS).reshape(last - first, c.wide, 8, 8)
    return full.transpose(0, 3, 1, 2).reshape((last - first) * 8, c.wide * 8)


def rgb(image: Image, band: int = 1 << 21) -> np.ndarray:
    """The full-resolution tensor, height x width x 3 of 8-bit samples, computed in bands of about ``band`` pixels."""
    tall, wide = max(c.v for c in image.components), max(c.h for c in image.components)
    out = np.zeros((image.height, image.width, 3), np.uint8)
    rows = max(1, band // max(1, 8 * tall * image.width))  # rows of units in a band
    for first in range(0, -(-image.height // (8 * tall)), rows):
        top, end = first * 8 * tall, min(image.height, (first + rows) * 8 * tall)
        planes = []
        for c in image.components:
            plane = _plane(c, image.tables[c.table], first * c.v, min(c.high, (first + rows) * c.v))
            plane = plane.repeat(tall // c.v, axis=0).repeat(wide // c.h, axis=1)
            planes.append(np.clip(np.rint(plane + 128), 0, 255)[: end - top, : image.width])
        if len(planes) == 1:
            out[top:end] = planes[0][:, :, None]
            continue
        y, blue, red = planes[0], planes[1] - 128, planes[2] - 128
        part = np.stack((y + 1.402 * red, y - 0.344136 * blue - 0.714136 * red, y + 1.772 * blue), axis=2)
        out[top:end] = np.clip(np.rint(part), 0, 255)
    return out


def payload_of(image: Image) -> bytes:
    """The bytes that ``encode`` put into the coefficients."""
    length = next((int(x[len(_TAG) :]) for x in image.comments if x.startswith(_TAG)), None)
    if length is None:
        raise JpegError("the file holds no payload")
    x = np.concatenate([c.coefficients for c in image.components])
    return ((np.abs(x) & 127) | ((x < 0).astype(np.int32) << 7)).astype(np.uint8).tobytes()[:length]


def describe(tensor: np.ndarray) -> str:
    """Channel means, mean luma step between neighbours and a 64-bit map of the cells brighter than the mean; exact sums."""
    height, width, _ = tensor.shape
    means = tensor.reshape(-1, 3).sum(axis=0, dtype=np.int64) / (height * width)
    luma = tensor.sum(axis=2, dtype=np.int32)
    step = int(np.abs(np.diff(luma, axis=1)).sum(dtype=np.int64)) / (height * max(1, width - 1))
    edges = [np.arange(8) * n // 8 for n in (height, width)]
    cells = np.add.reduceat(np.add.reduceat(luma, edges[0], axis=0, dtype=np.int64), edges[1], axis=1)
    area = np.outer(*(np.maximum(1, np.diff(np.append(e, n))) for e, n in zip(edges, (height, width))))
    bright = cells * int(area.sum()) > int(cells.sum()) * area
    return f"{width}x{height};rgb={means[0]:.3f},{means[1]:.3f},{means[2]:.3f};step={step:.3f};map={np.packbits(bright.ravel()).tobytes().hex()}"


def to_media(df: DataFrame, *, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row_id, n_bytes, media): the whole text in UTF-8, padded and encoded. A null text is empty: a payload of 192 blanks.

    Equal texts give equal files, null ids and repeated rows are kept, an empty table gives an empty table.
    """
    ship(df.sparkSession)
    schema = pa.schema([(row_id, pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                data = [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, data), pa.int64()), pa.array([encode(pad(x)) for x in data], pa.binary())], schema=schema)

    return df.select(F.col(row_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, f"`{row_id}` long, n_bytes long, media binary")


def from_media(df: DataFrame, *, row_id: str = "doc_id", tensor: bool = True) -> DataFrame:
    """Read the files in ``media`` back: the payload's digests, the file's digests, the feature and, with ``tensor``, the RGB tensor.

    The tensor is ``rgb`` (binary, row by row, three bytes a pixel) with ``height`` and ``width``. A null file gives nulls, one that
    is no whole progressive JPEG raises. Beside the file and its coefficients a task holds one tensor and a band of samples.
    """
    ship(df.sparkSession)
    fields = [(row_id, pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    fields += [("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary())] * tensor
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held = [], 0
            for own, n, media in zip(*(b.column(i) for i in range(3))):
                data = media.as_py()
                if data is None:
                    rows.append((own.as_py(), n.as_py(), *[None] * (len(schema) - 2)))
                    continue
                image = decode(data)
                payload, pixels = payload_of(image), rgb(image)
                row = (own.as_py(), n.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), describe(pixels))
                rows.append(row + ((*pixels.shape[:2], pixels.tobytes()) if tensor else ()))
                held += pixels.nbytes if tensor else 300
                if held > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), schema)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), schema)], schema=schema)

    ddl = f"`{row_id}` long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return df.select(row_id, "n_bytes", "media").mapInArrow(run, ddl + ", height int, width int, rgb binary" * tensor)
