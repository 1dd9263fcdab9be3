import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from lodestone.llm import tiff
from lodestone.llm.common import staged

R = random.Random(3)
DATA = [b"", b"a", b"ab" * 3000, bytes(R.randrange(256) for _ in range(70_000)), bytes(R.choice(b"abc ") for _ in range(90_000)), b"\0" * 10_000, b"".join(bytes((R.randrange(256),)) * R.randrange(1, 300) for _ in range(200))]


@pytest.mark.parametrize("data", DATA)
def test_codecs_round_trip(data):
    assert tiff.packbits_decode(tiff.packbits_encode(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


def test_lzw_known_bytes():
    # the format's own example: clear, 7, 258, 8, 8, 258, 6, end in nine-bit codes
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    bits += "0" * (-len(bits) % 8)
    assert tiff.lzw_decode(int(bits, 2).to_bytes(len(bits) // 8, "big")) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    assert tiff.packbits_decode(bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0xFD, 0xAA, 0x80, 0x03, 0x80, 0x00, 0x2A, 0x22, 0xF7, 0xAA])) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22" + "AA" * 10)


@pytest.mark.parametrize("scheme", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tiled", [False, True])
def test_layouts(scheme, predictor, tiled):
    payload = bytes(R.choice(b"abcdef \xff") for _ in range(576 * 150))
    pages = list(tiff.read_pages(tiff.write_tiff(payload, "bytes=5", (scheme, predictor, tiled))))
    assert [p.height for p in pages] == [64, 64, 22] and not any(p.error for p in pages)
    assert b"".join(p.pixels for p in pages) == payload and pages[0].description == "bytes=5"


def hand_made(order, big=False):
    """A 3 x 2 image of 16-bit samples with a predictor, by another byte order."""
    pixels = np.array([[1, 300, 65535], [7, 6, 5]], np.uint16)
    raw = np.diff(pixels, axis=1, prepend=np.uint16(0)).astype(order + "u2").tobytes()
    data = zlib.compress(raw)
    tags = [(256, 3), (257, 2), (258, 16), (259, 32946), (273, 16 if big else 8), (278, 2), (279, len(data)), (317, 2)]
    body = data + b"\0" * (len(data) % 2)
    if big:
        head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HHHQ", 43, 8, 0, 16 + len(body))
        entries = b"".join(struct.pack(order + "HHQQ", t, 16, 1, v) for t, v in tags)
        return head + body + struct.pack(order + "Q", len(tags)) + entries + b"\0" * 8, pixels
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8 + len(body))
    entries = b"".join(struct.pack(order + "HHII", t, 4, 1, v) for t, v in tags)
    return head + body + struct.pack(order + "H", len(tags)) + entries + b"\0" * 4, pixels


@pytest.mark.parametrize(("order", "big"), [("<", False), (">", False), ("<", True), (">", True)])
def test_other_writers(order, big):
    data, pixels = hand_made(order, big)
    (page,) = tiff.read_pages(data)
    assert page.error is None and page.pixels == pixels.tobytes() and page.bits == 16


def test_bad_media():
    good = tiff.write_tiff(b"x" * 576 * 70)
    for bad in (b"", b"II", b"not a tiff at all", good[:100], good[:-30], good[:4] + b"\xff\xff\xff\x7f" + good[8:]):
        assert list(tiff.read_pages(bad))[-1].error
    data, _ = hand_made("<")
    at = struct.unpack_from("<I", data, 4)[0]
    assert "turns back" in list(tiff.read_pages(data[:-4] + struct.pack("<I", at)))[-1].error


def test_documents(spark):
    texts = ["", None, "a", "ü" * 288, "ü" * 289, "long text " * 20_000, "tie", "tie"]
    docs = spark.createDataFrame([(None if k == 6 else k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, media long")
    media = staged(tiff.store_texts(docs), "media")
    got = {(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in tiff.media_digests(media).collect()}
    want = set()
    for k, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        want.add((None if k == 6 else k, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    assert got == want
    pages = tiff.tiff_pages(media)
    assert pages.filter("doc_id = 5").count() == -(-200_000 // (576 * 64)) and pages.filter("error IS NOT NULL").count() == 0
    assert tiff.tiff_pages(spark.createDataFrame([(1, None), (2, b"junk")], "doc_id long, media binary")).select("doc_id", "page").collect() == [(2, -1)]
    assert tiff.media_digests(media.limit(0)).count() == 0


def chained(pages):
    """A medium of directories, each a list of (tag, values) and its strips."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for tags, strips in pages:
        places = []
        for strip in strips:
            places.append(len(out))
            out += strip + b"\0" * (len(strip) % 2)
        entries = b""
        for tag, values in sorted([*tags, (273, places), (279, [len(x) for x in strips])]):
            at = values[0] if len(values) == 1 else len(out)
            if len(values) > 1:
                out += struct.pack(f"<{len(values)}I", *values)
            entries += struct.pack("<HHII", tag, 4, len(values), at)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries) // 12) + entries + b"\0" * 4
        link = len(out) - 4
    return bytes(out)


def test_pages_after_one_that_fails(spark):
    grey = ([(256, [2]), (257, [2]), (258, [8]), (278, [2])], [b"abcd"])
    odd = ([(256, [2]), (257, [2]), (258, [12]), (278, [2])], [b"abcdef"])
    data = chained([grey, odd, grey, odd, grey])
    pages = list(tiff.read_pages(data))
    assert [(p.page, p.pixels, bool(p.error)) for p in pages] == [(0, b"abcd", False), (1, None, True), (2, b"abcd", False), (3, None, True), (4, b"abcd", False)]
    row = tiff.media_digests(spark.createDataFrame([(1, data)], "doc_id long, media binary")).first()
    assert row.payload_sha256 is None and row.n_pages == 3 and "12 bits" in row.feature


def test_single_bits_and_planes():
    bits = np.array([R.choices((0, 1), k=11) for _ in range(5)], np.uint8)
    packed = np.packbits(bits, axis=1)
    one = ([(256, [11]), (257, [5]), (259, [tiff.PACKBITS]), (278, [3])], [tiff.packbits_encode(packed[:3].tobytes()), tiff.packbits_encode(packed[3:].tobytes())])
    colours = np.array([[[R.randrange(256) for _ in range(3)] for _ in range(4)] for _ in range(3)], np.uint8)
    planes = ([(256, [4]), (257, [3]), (258, [8, 8, 8]), (277, [3]), (278, [2]), (284, [2])], [colours[a : a + 2, :, k].tobytes() for k in range(3) for a in (0, 2)])
    first, second = tiff.read_pages(chained([one, planes]))
    assert (first.error, first.bits, first.pixels) == (None, 1, bits.tobytes())
    assert (second.error, second.samples, second.pixels) == (None, 3, colours.tobytes())


@pytest.mark.parametrize("bits", [1, 2, 4])
@pytest.mark.parametrize("turned", [False, True])
def test_samples_below_a_byte(bits, turned):
    pixels = np.array([R.choices(range(1 << bits), k=13) for _ in range(4)], np.uint8)
    rows = ["".join(f"{x:0{bits}b}" for x in row) for row in pixels]
    packed = [int(r + "0" * (-len(r) % 8), 2).to_bytes(-(-len(r) // 8), "big") for r in rows]
    stored = tiff.packbits_encode(b"".join(packed))
    stored = bytes(int(f"{b:08b}"[::-1], 2) for b in stored) if turned else stored
    (page,) = tiff.read_pages(chained([([(256, [13]), (257, [4]), (258, [bits]), (259, [tiff.PACKBITS]), (266, [1 + turned])], [stored])]))
    assert (page.error, page.bits, page.pixels) == (None, bits, pixels.tobytes())


@pytest.mark.parametrize("size", [2, 4, 8])
@pytest.mark.parametrize("samples", [1, 3])
def test_floating_point_predictor(size, samples):
    pixels = np.array([[[R.uniform(-9, 9) for _ in range(samples)] for _ in range(6)] for _ in range(5)], f"f{size}")
    rows = []
    for row in pixels:  # bytes by their significance, then differences of bytes, a pixel's samples apart
        planes = row.astype(f">f{size}").reshape(-1).view(np.uint8).reshape(-1, size).T.reshape(-1)
        rows.append(np.r_[planes[:samples], planes[samples:] - planes[:-samples]].tobytes())
    tags = [(256, [6]), (257, [5]), (258, [8 * size] * samples), (259, [tiff.DEFLATE]), (277, [samples]), (278, [2]), (317, [3]), (339, [3])]
    (page,) = tiff.read_pages(chained([(tags, [zlib.compress(b"".join(rows[a : a + 2])) for a in (0, 2, 4)])]))
    assert (page.error, page.predictor, page.pixels) == (None, 3, pixels.tobytes())


def test_wide_samples_and_wrong_headers():
    ints = np.array([[1, 2**31, 7], [9, 8, 2**32 - 1]], np.uint32)
    tags = [(256, [3]), (257, [2]), (258, [32]), (259, [tiff.LZW]), (278, [2]), (317, [2])]
    (page,) = tiff.read_pages(chained([(tags, [tiff.lzw_encode(np.diff(ints, axis=1, prepend=np.uint32(0)).tobytes())])]))
    assert (page.error, page.pixels) == (None, ints.tobytes())
    huge = [(256, [1 << 30]), (257, [1 << 20]), (258, [8]), (278, [1 << 20])]
    (page,) = tiff.read_pages(chained([(huge, [b"x"])]))
    assert "more samples" in page.error
    for predictor, kind in ((2, 3), (3, 1), (4, 1)):
        (page,) = tiff.read_pages(chained([([(256, [1]), (257, [1]), (258, [32]), (317, [predictor]), (339, [kind])], [b"abcd"])]))
        assert "predictor" in page.error


@pytest.mark.parametrize("scheme", [tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
def test_the_largest_page_of_one_value(scheme):
    """As small as a compression can make it: 16 million equal samples in one strip are read, one sample more than the strip can hold is refused."""
    side = 4000
    strip = tiff.compress(bytes(side * side), scheme)
    assert side * side <= tiff.MOST_MADE[scheme] * len(strip)
    head = 8 + len(strip) + len(strip) % 2

    def page(height):
        tags = [(256, 4, side), (257, 4, height), (258, 3, 8), (259, 3, scheme), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, height), (279, 4, len(strip))]
        entries = b"".join(struct.pack("<HHI", tag, kind, 1) + (struct.pack("<HH", value, 0) if kind == 3 else struct.pack("<I", value)) for tag, kind, value in tags)
        return b"II*\0" + struct.pack("<I", head) + strip.ljust(head - 8, b"\0") + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0)

    (got,) = tiff.read_pages(page(side))
    assert got.error is None and got.pixels == bytes(side * side)
    (refused,) = tiff.read_pages(page(400 * side))
    assert refused.pixels is None and "more samples" in refused.error
