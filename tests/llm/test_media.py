import hashlib
import random
import zlib

import numpy as np
import pytest

from xmlframe.llm import media


@pytest.mark.parametrize("data", [b"", b"a", bytes(range(256)) * 9, "ä€🙂".encode() * 700, b"x" * 20_000])
def test_payload_survives(data):
    payload = media.pad(data)
    assert len(payload) % 192 == 0 and len(payload) >= 192 and payload.startswith(data)
    image = media.decode(media.encode(payload))
    assert media.payload_of(image) == payload
    tensor = media.rgb(image)
    assert tensor.shape == (image.height, image.width, 3) and tensor.dtype == np.uint8


def test_sequential_decoding_agrees_with_the_array_paths(monkeypatch):
    file = media.encode(media.pad(bytes(random.Random(1).randbytes(3000))))
    whole = [c.coefficients for c in media.decode(file).components]
    monkeypatch.setattr(media, "_bytes_ac", lambda *a: False)
    for a, b in zip(whole, media.decode(file).components):
        assert (a == b.coefficients).all()


class Out:
    """A plain progressive encoder for one component, bit by bit, to test the decoder on files of another make."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in reversed(range(n))]

    def bytes(self):
        bits = self.bits + [1] * (-len(self.bits) % 8)
        return np.packbits(np.array(bits, np.uint8)).tobytes()


def _gray(blocks, wide, high):
    """All symbols have eight-bit codes; first scans at bit 1, then the refinement of bit 0."""
    symbols = list(range(255))
    code = {s: i for i, s in enumerate(symbols)}

    def size(v):
        return abs(v).bit_length()

    def magnitude(o, v):
        n = size(v)
        o.put(v if v > 0 else v + (1 << n) - 1, n)

    out = [b"\xff\xd8", media._segment(0xDB, bytes([0]) + bytes([2] * 64)), media._segment(0xC2, bytes([8, 0, 8 * high, 0, 8 * wide, 1, 1, 0x11, 0]))]
    for kind in (0x00, 0x10):
        out.append(media._table(kind, [0] * 7 + [255], symbols))
    o, last = Out(), 0
    for b in blocks:
        v = int(b[0]) >> 1
        o.put(code[size(v - last)], 8)
        magnitude(o, v - last) if v != last else None
        last = v
    out.append(media._scan([(1, 0)], (0, 0), 0, 1, o.bytes()))
    o = Out()
    for b in blocks:
        o.put(int(b[0]) & 1, 1)
    out.append(media._scan([(1, 0)], (0, 0), 1, 0, o.bytes()))
    o = Out()
    for b in blocks:
        run = 0
        high_bits = [int(np.sign(x)) * (abs(int(x)) >> 1) for x in b]
        top = max((k for k in range(1, 64) if high_bits[k]), default=0)
        for k in range(1, top + 1):
            if not high_bits[k]:
                run += 1
                continue
            while run > 15:
                o.put(code[0xF0], 8)
                run -= 16
            o.put(code[run << 4 | size(high_bits[k])], 8)
            magnitude(o, high_bits[k])
            run = 0
        if top < 63:
            o.put(code[0x00], 8)
    out.append(media._scan([(1, 0)], (1, 63), 0, 1, o.bytes()))
    o = Out()
    for b in blocks:
        new = [k for k in range(1, 64) if abs(int(b[k])) == 1]
        run, held, k = 0, [], 1
        while k <= (new[-1] if new else 0):
            v = int(b[k])
            if abs(v) > 1:
                held.append(abs(v) & 1)
            elif v == 0:
                run += 1
                if run == 16:
                    o.put(code[0xF0], 8)
                    for x in held:
                        o.put(x, 1)
                    run, held = 0, []
            else:
                o.put(code[run << 4 | 1], 8)
                o.put(int(v > 0), 1)
                for x in held:
                    o.put(x, 1)
                run, held = 0, []
            k += 1
        rest = held + [abs(int(b[j])) & 1 for j in range(k, 64) if abs(int(b[j])) > 1]
        if k <= 63 or rest:
            o.put(code[0x00], 8)
            for x in rest:
                o.put(x, 1)
    out.append(media._scan([(1, 0)], (1, 63), 1, 0, o.bytes()))
    return b"".join([*out, b"\xff\xd9"])


def test_decoder_on_sparse_coefficients_of_another_encoder():
    rng = np.random.default_rng(2)
    blocks = rng.integers(-40, 40, (6, 64)) * (rng.random((6, 64)) < 0.2)
    blocks[:, 0] = rng.integers(-200, 200, 6)
    blocks[5, 1:] = 0
    image = media.decode(_gray(blocks, 3, 2))
    assert (image.components[0].coefficients == blocks).all()
    natural = np.zeros(64)
    natural[media.ZIGZAG] = blocks[0] * 2
    u = np.arange(8)
    c = np.where(u == 0, np.sqrt(0.5), 1.0)
    cos = np.cos((2 * u[:, None] + 1) * u[None, :] * np.pi / 16)
    plain = np.einsum("xu,yv,u,v,uv->xy", cos, cos, c, c, natural.reshape(8, 8)) / 4
    want = np.clip(np.rint(plain + 128), 0, 255)
    assert np.abs(media.rgb(image)[:8, :8, 0] - want).max() <= 1


def test_damaged_files_raise():
    file = media.encode(media.pad(b"abc"))
    for bad in (b"", b"no image", file[:200]):
        with pytest.raises((media.JpegError, IndexError, ValueError)):
            media.payload_of(media.decode(bad))


def test_operator(spark):
    rows = [(1, "a"), (2, None), (3, ""), (4, "long " * 30_000), (1, "a"), (None, "ü")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, media string")
    out = media.from_media(media.to_media(df)).collect()
    assert len(out) == len(rows)
    for (i, t), r in zip(rows, out):
        data = (t or "").encode()
        payload = media.pad(data)
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (i, len(data), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        assert len(r.rgb) == r.height * r.width * 3
    assert out[0].media_sha256 == out[4].media_sha256 and out[0].feature == out[4].feature and out[1].feature == out[2].feature
    assert media.from_media(media.to_media(df.limit(0))).count() == 0


def test_bands_are_the_whole_and_null_files_are_null(spark):
    image = media.decode(media.encode(media.pad(bytes(range(256)) * 300)))
    assert (media.rgb(image, band=1) == media.rgb(image)).all() and (media.rgb(image, band=5000) == media.rgb(image)).all()
    df = spark.createDataFrame([(1, 5, None), (2, 3, bytearray(media.encode(media.pad(b"abc"))))], "doc_id long, n_bytes long, media binary")
    out = {r.doc_id: r for r in media.from_media(df).collect()}
    assert out[1].payload_sha256 is None and out[1].rgb is None and out[2].payload_bytes == 192 and len(out[2].rgb) == 3 * out[2].height * out[2].width
