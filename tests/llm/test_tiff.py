import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import tiff

RNG = np.random.default_rng(6)


def image(h, w, samples=1):
    base = np.cumsum(RNG.integers(0, 3, (h, w, samples)), axis=1) + RNG.integers(0, 40)
    return (base % 256).astype(np.uint8)


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("big_endian", [False, True])
def test_round_trip(compression, predictor, tile, big_endian):
    pages = [image(37, 53), image(5, 7, 3), image(70, 64)]
    data = tiff.write_tiff(pages, compression, predictor, rows_per_strip=8, tile=tile, big_endian=big_endian)
    got = list(tiff.Reader(data).pages())
    assert [(p.height, p.width, p.samples) for p in got] == [x.shape for x in pages]
    assert [p.pixels for p in got] == [x.tobytes() for x in pages]


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=3000) | st.text("ab", max_size=6000).map(str.encode))
def test_codecs(data):
    assert tiff.unpack_lzw(tiff.pack_lzw(data)) == data
    assert tiff.unpack_bits(tiff.pack_bits(data)) == data


def test_long_lzw_passes_a_full_table():
    data = RNG.integers(0, 256, 60_000, dtype=np.uint8).tobytes() + b"abc" * 20_000
    assert tiff.unpack_lzw(tiff.pack_lzw(data)) == data


def test_golden_packbits():
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert tiff.unpack_bits(packed) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")


def test_golden_lzw():
    # 7 7 7 8 8 7 7 6 6 as codes 256 7 258 8 8 258 6 6 257 of nine bits.
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.unpack_lzw(data) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_planes_and_sixteen_bits():
    cells = RNG.integers(0, 65536, (4, 6, 2)).astype(">u2")
    raw = [zlib.compress(np.ascontiguousarray(cells[:, :, i]).tobytes()) for i in (0, 1)]
    head = 8
    entries = [(256, 3, 1, 6), (257, 3, 1, 4), (258, 3, 2, 16 << 16 | 16), (259, 3, 1, 8), (273, 4, 2, None), (277, 3, 1, 2), (278, 3, 1, 4), (279, 4, 2, None), (284, 3, 1, 2)]
    at = head + len(raw[0]) + len(raw[1])
    body = raw[0] + raw[1] + struct.pack(">4I", head, head + len(raw[0]), len(raw[0]), len(raw[1]))
    ifd = struct.pack(">H", len(entries))
    for tag, kind, n, value in entries:
        value = at if tag == 273 else at + 8 if tag == 279 else value << 16 if kind == 3 and n == 1 else value
        ifd += struct.pack(">HHII", tag, kind, n, value)
    data = b"MM" + struct.pack(">HI", 42, at + 16) + body + ifd + struct.pack(">I", 0)
    (page,) = tiff.Reader(data).pages()
    assert page.bits == 16 and page.pixels == cells.astype("<u2").tobytes()


def test_pages_of_good_and_bad_files(spark):
    good = tiff.write_tiff([image(4, 4), image(3, 3)])
    loop = bytearray(tiff.write_tiff([image(4, 4)]))
    at = struct.unpack_from("<I", loop, 4)[0]
    n = struct.unpack_from("<H", loop, at)[0]
    struct.pack_into("<I", loop, at + 2 + 12 * n, at)
    rows = [(1, good), (2, None), (3, b""), (4, b"nonsense"), (5, good[: len(good) // 2]), (6, bytes(loop)), (None, good)]
    got = tiff.tiff_pages(spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in rows], "doc_id long, file binary"), "file", ("doc_id",)).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["page"], r["error"] is None))
    assert by[1] == [(0, True), (1, True)] == by[None] and 2 not in by and 3 not in by and by[4] == [(0, False)] and by[6] == [(0, True)]
    assert by[5][-1][1] is False
    assert tiff.tiff_pages(spark.createDataFrame([], "doc_id long, file binary"), "file", ("doc_id",)).count() == 0


def test_pages_after_an_unreadable_one_are_read(spark):
    pages = [image(4, 4), image(5, 5), image(6, 6)]
    data = bytearray(tiff.write_tiff(pages))
    at = struct.unpack_from("<I", data, 4)[0]
    at = struct.unpack_from("<I", data, at + 2 + 12 * struct.unpack_from("<H", data, at)[0])[0]  # the second directory
    for i in range(struct.unpack_from("<H", data, at)[0]):
        if struct.unpack_from("<H", data, at + 2 + 12 * i)[0] == tiff.COMPRESSION:
            struct.pack_into("<H", data, at + 10 + 12 * i, 7)  # JPEG
    got = tiff.tiff_pages(spark.createDataFrame([(1, data)], "doc_id long, file binary"), "file", ("doc_id",)).collect()
    assert [(r["page"], r["height"], r["error"]) for r in got] == [(0, 4, None), (1, None, "compression 7"), (2, 6, None)]
    assert bytes(got[2]["pixels"]) == pages[2].tobytes()


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 400), st.integers(0, 255))
def test_damaged_files_only_raise_their_own_error(at, value):
    data = bytearray(tiff.write_tiff([np.arange(64, dtype=np.uint8).reshape(8, 8)], tiff.LZW))
    data[at % len(data)] = value
    try:
        list(tiff.Reader(bytes(data)).pages())
    except tiff.TiffError:
        pass


def check(rows, texts):
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r)
    for doc, text in texts:
        raw = (text or "").encode()
        padded = raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff")
        for r in got[doc]:
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["error"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]), None)


def test_query(spark, sf, documents, odd, tmp_path):
    check(tiff.op4_tiff(spark, sf).collect(), [(r["doc_id"], r["text"]) for r in documents.collect()])
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    rows = tiff.op4_tiff(spark, str(tmp_path)).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in odd.collect()])
    fives = [tuple(r) for r in rows if r["doc_id"] == 5]
    assert len(fives) == 2 and fives[0] == fives[1]


def with_tags(data, page=0, **changes):
    """A classic little-endian file with values of tags of a page overwritten, as 32-bit numbers."""
    data = bytearray(data)
    at = struct.unpack_from("<I", data, 4)[0]
    for _ in range(page):
        at = struct.unpack_from("<I", data, at + 2 + 12 * struct.unpack_from("<H", data, at)[0])[0]
    for i in range(struct.unpack_from("<H", data, at)[0]):
        tag = struct.unpack_from("<H", data, at + 2 + 12 * i)[0]
        for name, (kind, n, value) in changes.items():
            if tag == getattr(tiff, name):
                struct.pack_into("<HII", data, at + 4 + 12 * i, kind, n, value)
    return bytes(data)


TAGS = ["WIDTH", "HEIGHT", "BITS", "COMPRESSION", "SAMPLES", "PREDICTOR", "STRIP_OFFSETS", "ROWS_PER_STRIP", "STRIP_BYTES", "TILE_WIDTH", "TILE_HEIGHT", "TILE_OFFSETS", "TILE_BYTES"]
NUMBERS = st.one_of(st.integers(0, 70), st.sampled_from([2**31 - 1, 2**31, 2**32 - 1, 65535, 65536, 100_000, 1 << 20, 32773]))


@settings(max_examples=500, deadline=None)
@given(st.sampled_from([tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS]), st.sampled_from([None, (16, 16)]), st.dictionaries(st.sampled_from(TAGS), st.tuples(st.sampled_from([*tiff.TYPES, 0, 5, 99]), st.sampled_from([1, 1, 1, 0, 2, 9, 2**32 - 1]), NUMBERS), min_size=1, max_size=4))
def test_any_tag_value_only_raises_its_own_error(compression, tile, changes):
    data = tiff.write_tiff([np.arange(1024, dtype=np.uint8).reshape(32, 32)], compression, 1, rows_per_strip=8, tile=tile)
    try:
        for p in tiff.Reader(with_tags(data, **changes)).pages():
            assert len(p.pixels) <= 5000 * len(data)
    except tiff.TiffError:
        pass


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
def test_pages_of_untrue_size_are_error_rows(spark, compression):
    pages = [image(4, 4), image(5, 5)]
    data = tiff.write_tiff(pages, compression)
    sizes = [(2**32 - 1, 2**32 - 1), (2**31, 2**20), (100_000, 100_000), (2**31 - 1, 1)]
    files = [(i, bytearray(with_tags(data, WIDTH=(4, 1, w), HEIGHT=(4, 1, h), ROWS_PER_STRIP=(4, 1, h)))) for i, (w, h) in enumerate(sizes)]
    got = tiff.tiff_pages(spark.createDataFrame(files, "doc_id long, file binary"), "file", ("doc_id",)).collect()
    assert len(got) == 8 and all((r["error"] is not None) == (r["page"] == 0) for r in got)
    assert all(bytes(r["pixels"]) == pages[1].tobytes() for r in got if r["page"] == 1)


@pytest.mark.parametrize("bits", [1, 2, 4])
@pytest.mark.parametrize("order", [1, 2])
def test_samples_under_a_byte(bits, order):
    cells = RNG.integers(0, 1 << bits, (5, 11), dtype=np.uint8)
    ones = np.stack([cells >> (bits - 1 - i) & 1 for i in range(bits)], axis=2).reshape(5, -1)
    raw = np.packbits(ones, axis=1, bitorder="little" if order == 2 else "big").tobytes()
    body = zlib.compress(raw)
    entries = [(256, 11), (257, 5), (258, bits), (259, 8), (266, order), (273, 8), (278, 5), (279, len(body))]
    ifd = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in entries) + struct.pack("<I", 0)
    (page,) = tiff.Reader(b"II" + struct.pack("<HI", 42, 8 + len(body)) + body + ifd).pages()
    assert (page.width, page.height, page.samples, page.bits) == (11, 5, 1, bits) and page.pixels == cells.tobytes()
