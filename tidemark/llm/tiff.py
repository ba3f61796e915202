"""TIFF columns: one row per page of every file.

The reader walks the chain of image directories of classic and big TIFF files in
either byte order, decodes strips and tiles that are stored plain or with
PackBits, LZW or deflate, undoes horizontal differencing, and joins planes. Samples
have 1, 2, 4, 8 or 16 bits; those under a byte come out one a byte, as they are
stored (a bilevel page has zeros and ones, whichever is white). The writer makes
files of 8-bit pages; the query stores texts with it.

Defined results: a null or empty file gives no page; a file or page that cannot
be read gives one row with ``error`` and null pixels, and the other pages
stay, as far as the chain of directories can be followed; no size that a file
states is believed beyond what its strips or tiles can unpack to, and a page of
more than ``MAX_PIXELS`` bytes is such an error; a chain of directories that turns back on itself ends there. Null ids and
repeated rows are kept; other columns are ignored unless named in ``keep``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import id_text, spread, table
from tidemark.runtime import ship

#: Tags, compressions and value sizes of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
FILL_ORDER, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 266, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPES = {1: ("B", 1), 2: ("B", 1), 3: ("H", 2), 4: ("I", 4), 6: ("b", 1), 7: ("B", 1), 8: ("h", 2), 9: ("i", 4), 13: ("I", 4), 16: ("Q", 8), 17: ("q", 8), 18: ("Q", 8)}
#: Bytes that one stored byte can unpack to at most.
MOST = {NONE: 1, PACKBITS: 64, DEFLATE: 1032, OLD_DEFLATE: 1032, LZW: 4096}
#: Bytes of a page that a row can hold.
MAX_PIXELS = (1 << 31) - (1 << 20)
#: Bytes of rows that one outgoing batch holds, about.
BATCH = 16 << 20


class TiffError(ValueError):
    pass


@dataclass
class Page:
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    pixels: bytes


def unpack_bits(data: bytes, want: int = 1 << 62) -> bytes:
    out, at, end = bytearray(), 0, len(data)
    while at < end and len(out) < want:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def pack_bits(row: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(row):
        run = 1
        while run < 128 and at + run < len(row) and row[at + run] == row[at]:
            run += 1
        if run > 2:
            out += bytes([257 - run, row[at]])
            at += run
            continue
        end = at + run
        while end < len(row) and end - at < 128 and row[end : end + 3] != row[end : end + 1] * 3:
            end += 1
        out += bytes([end - at - 1]) + row[at:end]
        at = end
    return bytes(out)


def unpack_lzw(data: bytes, want: int = 1 << 62) -> bytes:
    """Codes of 9 to 12 bits, highest bit first; 256 clears the table, 257 ends, and so do ``want`` bytes."""
    singles = [bytes([i]) for i in range(256)] + [b"", b""]
    words, out, last = list(singles), [], b""
    bits = have = 0
    width, size = 9, 0
    for byte in data:
        if size >= want:
            break
        bits, have = bits << 8 | byte, have + 8
        if have < width:
            continue
        have -= width
        code = bits >> have
        bits &= (1 << have) - 1
        if code == 256:
            words, width, last = list(singles), 9, b""
            continue
        if code == 257:
            break
        if code < len(words):
            word = words[code]
        elif code == len(words) and last:
            word = last + last[:1]
        else:
            raise TiffError("LZW code outside the table")
        out.append(word)
        size += len(word)
        if last and len(words) < 4096:
            words.append(last + word[:1])
        last = word
        if len(words) + 1 >= 1 << width and width < 12:
            width += 1
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    out, bits, have, width = bytearray(), 0, 0, 9
    words = {bytes([i]): i for i in range(256)}

    def put(code: int) -> None:
        nonlocal bits, have
        bits, have = bits << width | code, have + width
        while have >= 8:
            have -= 8
            out.append(bits >> have & 255)
        bits &= (1 << have) - 1

    put(256)
    free, word = 258, b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in words:
            word = longer
            continue
        put(words[word])
        words[longer] = free
        free += 1
        if free == 4095:
            put(256)
            words, free, width = {bytes([b]): b for b in range(256)}, 258, 9
        elif free == 1 << width:
            width += 1
        word = data[i : i + 1]
    if word:
        put(words[word])
        if free + 1 == 1 << width and width < 12:
            width += 1
    put(257)
    if have:
        out.append(bits << (8 - have) & 255)
    return bytes(out)


def inflate(data: bytes, size: int) -> bytes:
    return zlib.decompressobj().decompress(data, size)


class Reader:
    def __init__(self, data: bytes):
        self.data = data
        if data[:2] not in (b"II", b"MM"):
            raise TiffError("no byte order mark")
        self.order = "<" if data[:2] == b"II" else ">"
        version = self.number("H", 2)
        if version not in (42, 43):
            raise TiffError(f"version {version}")
        self.big = version == 43
        self.first = self.number("Q", 8) if self.big else self.number("I", 4)

    def number(self, kind: str, at: int, n: int = 0):
        try:
            found = struct.unpack_from(f"{self.order}{n or ''}{kind}", self.data, at)
        except (struct.error, OverflowError) as e:
            raise TiffError("the file ends early") from e
        return found if n else found[0]

    def directory(self, at: int) -> tuple[dict[int, tuple], int]:
        """The values of one directory by tag, and where the next one lies."""
        count, head, entry, slot = (self.number("Q", at), 8, 20, 8) if self.big else (self.number("H", at), 2, 12, 4)
        if count * entry > len(self.data):
            raise TiffError("the file ends early")
        tags = {}
        for i in range(count):
            where = at + head + i * entry
            tag, kind = self.number("H", where), self.number("H", where + 2)
            n = self.number("Q" if self.big else "I", where + 4)
            if kind not in TYPES or not n:
                continue
            code, size = TYPES[kind]
            value = where + (12 if self.big else 8)
            if n > len(self.data):
                raise TiffError("the file ends early")
            if n * size > slot:
                value = self.number("Q" if self.big else "I", value)
            if value + n * size > len(self.data):
                raise TiffError("the file ends early")
            tags[tag] = self.number(code, value, n)
        end = at + head + count * entry
        return tags, self.number("Q" if self.big else "I", end)

    def directories(self) -> Iterator[dict[int, tuple]]:
        at, seen = self.first, set()
        while at and at not in seen:
            seen.add(at)
            tags, at = self.directory(at)
            yield tags

    def pages(self) -> Iterator[Page]:
        return map(self.page, self.directories())

    def page(self, tags: dict[int, tuple]) -> Page:
        one = lambda tag, default: tags.get(tag, (default,))[0]
        width, height, samples = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
        bits, compression, predictor, planar = one(BITS, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1), one(PLANAR, 1)
        if bits not in (1, 2, 4, 8, 16) or len(set(tags.get(BITS, (bits,)))) > 1:
            raise TiffError(f"{bits} bits a sample")
        if predictor not in (1, 2) or (predictor == 2 and bits < 8):
            raise TiffError(f"predictor {predictor}")
        if compression not in MOST:
            raise TiffError(f"compression {compression}")
        tiled = TILE_OFFSETS in tags
        w, h = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
        if min(width, height, samples, w, h) < 1:
            raise TiffError("no size")
        offsets, sizes = tags.get(TILE_OFFSETS if tiled else STRIP_OFFSETS, ()), tags.get(TILE_BYTES if tiled else STRIP_BYTES, ())
        across, down, planes = -(-width // w), -(-height // h), samples if planar == 2 else 1
        blocks = across * down * planes
        if min(len(offsets), len(sizes)) < blocks:
            raise TiffError("strips or tiles are missing")
        if min(*offsets[:blocks], *sizes[:blocks]) < 0:
            raise TiffError("a strip or tile lies before the file")
        per = 1 if planar == 2 else samples
        wide = max(1, bits // 8)
        if width * height * samples * wide > MAX_PIXELS:
            raise TiffError(f"a page of {width} by {height} by {samples}")
        row = -(-w * per * bits // 8)  # bytes of a row of a strip or tile
        wanted = [(h if tiled else min(h, height - i % (across * down) // across * h)) * row for i in range(blocks)]
        for want, size in zip(wanted, sizes):
            if want > (size + 16) * MOST[compression]:
                raise TiffError("a strip or tile is too short")
        try:
            image = np.empty((height, width, samples), dtype=f"<u{wide}")
        except MemoryError as e:
            raise TiffError(f"a page of {width} by {height} by {samples}") from e
        for i, want in enumerate(wanted):
            plane, rest = divmod(i, across * down)
            y, x = rest // across * h, rest % across * w
            rows = want // row
            block = self.block(offsets[i], sizes[i], compression, want)
            if bits < 8:
                cells = unpacked(block, rows, w * per, bits, one(FILL_ORDER, 1) == 2).reshape(rows, w, per)
            else:
                cells = np.frombuffer(block, f"{self.order}u{wide}").reshape(rows, w, per)
            if predictor == 2:
                cells = np.cumsum(cells, axis=1, dtype=f"u{wide}")
            ny, nx = min(rows, height - y), min(w, width - x)
            if planar == 2:
                image[y : y + ny, x : x + nx, plane] = cells[:ny, :nx, 0]
            else:
                image[y : y + ny, x : x + nx] = cells[:ny, :nx]
        return Page(width, height, samples, bits, compression, predictor, image.tobytes())

    def block(self, at: int, size: int, compression: int, want: int) -> bytes:
        raw = self.data[at : at + size]
        if len(raw) < size:
            raise TiffError("the file ends early")
        try:
            out = raw if compression == NONE else unpack_lzw(raw, want) if compression == LZW else unpack_bits(raw, want) if compression == PACKBITS else inflate(raw, want)
        except zlib.error as e:
            raise TiffError(str(e)) from e
        if len(out) < want:
            raise TiffError("a strip or tile is too short")
        return out[:want]


def unpacked(block: bytes, rows: int, samples: int, bits: int, reverse: bool) -> np.ndarray:
    """Samples of 1, 2 or 4 bits, one a byte; rows start at bytes."""
    ones = np.unpackbits(np.frombuffer(block, np.uint8).reshape(rows, -1), axis=1, bitorder="little" if reverse else "big")
    parts = ones[:, : samples * bits].reshape(rows, samples, bits)
    out = np.zeros((rows, samples), np.uint8)
    for i in range(bits):
        out = out << 1 | parts[:, :, i]
    return out


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows_per_strip: int = 128, tile: tuple[int, int] | None = None, big_endian: bool = False) -> bytes:
    """A classic TIFF file of 8-bit pages, each of shape (height, width) or (height, width, samples)."""
    o = ">" if big_endian else "<"
    out = bytearray((b"MM" if big_endian else b"II") + struct.pack(o + "HI", 42, 0))
    link = 4
    for image in pages:
        image = image.reshape(*image.shape[:2], -1)
        height, width, samples = image.shape
        h, w = tile or (min(rows_per_strip, height), width)
        offsets, sizes = [], []
        for y in range(0, height, h):
            for x in range(0, width, w):
                cells = image[y : y + h, x : x + w]
                if tile:
                    cells = np.pad(cells, ((0, h - cells.shape[0]), (0, w - cells.shape[1]), (0, 0)))
                if predictor == 2:
                    cells = np.concatenate([cells[:, :1], cells[:, 1:] - cells[:, :-1]], axis=1)
                raw = cells.tobytes()
                if compression == DEFLATE:
                    raw = zlib.compress(raw, 1)
                elif compression == LZW:
                    raw = pack_lzw(raw)
                elif compression == PACKBITS:
                    step = cells.shape[1] * samples
                    raw = b"".join(pack_bits(raw[i : i + step]) for i in range(0, len(raw), step))
                offsets.append(len(out))
                sizes.append(len(raw))
                out += raw
        tags = [(WIDTH, "I", [width]), (HEIGHT, "I", [height]), (BITS, "H", [8] * samples), (COMPRESSION, "H", [compression]), (PHOTOMETRIC, "H", [1 if samples < 3 else 2]), (SAMPLES, "H", [samples]), (PREDICTOR, "H", [predictor])]
        if tile:
            tags += [(TILE_WIDTH, "I", [w]), (TILE_HEIGHT, "I", [h]), (TILE_OFFSETS, "I", offsets), (TILE_BYTES, "I", sizes)]
        else:
            tags += [(STRIP_OFFSETS, "I", offsets), (ROWS_PER_STRIP, "I", [h]), (STRIP_BYTES, "I", sizes)]
        entries = b""
        for tag, code, values in sorted(tags):
            raw = struct.pack(f"{o}{len(values)}{code}", *values)
            if len(raw) > 4:
                where = len(out)
                out += raw
                raw = struct.pack(o + "I", where)
            entries += struct.pack(o + "HHI", tag, 4 if code == "I" else 3, len(values)) + raw.ljust(4, b"\0")
        out += b"\0" * (len(out) % 2)
        struct.pack_into(o + "I", out, link, len(out))
        out += struct.pack(o + "H", len(tags)) + entries
        link = len(out)
        out += struct.pack(o + "I", 0)
    return bytes(out)


def feature(page: Page) -> str:
    """Size, mean and spread of the samples, and eight bits of rough brightness over eighths of the page."""
    cells = np.frombuffer(page.pixels, f"<u{page.bits // 8}")
    mean = float(cells.mean())
    coarse = "".join("1" if part.size and part.mean() > mean else "0" for part in np.array_split(cells, 8))
    return f"{page.width}x{page.height}x{page.samples} mean {mean:.4f} sd {float(cells.std()):.4f} {coarse}"


PAGE = "page int, width int, height int, samples int, bits int, compression int, predictor int, pixels binary, feature string, error string"


def tiff_pages(df: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per page of the files in ``media_col``, after the columns named in ``keep``. No shuffle."""
    ship(df.sparkSession)
    kept = df.select(*keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), PAGE])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows, held = [], [], 0

            def flush() -> pa.RecordBatch:
                columns = list(zip(*rows))
                arrays = [c.take(pa.array(at, pa.int64())) for c in batch.columns[:-1]] + [pa.array(c, t) for c, t in zip(columns, [pa.int32()] * 7 + [pa.binary(), pa.string(), pa.string()])]
                return pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], "page", "width", "height", "samples", "bits", "compression", "predictor", "pixels", "feature", "error"])

            for i, media in enumerate(batch.columns[-1]):
                data, no = media.as_py(), 0
                try:
                    reader = Reader(data) if data else None
                    for no, tags in enumerate(reader.directories() if reader else (), 1):
                        at.append(i)
                        try:
                            p = reader.page(tags)
                        except TiffError as e:  # the next directory is known all the same
                            rows.append((no - 1, *[None] * 8, str(e)))
                            continue
                        rows.append((no - 1, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.pixels, feature(p), None))
                        held += len(p.pixels)
                        if held > BATCH:
                            yield flush()
                            at, rows, held = [], [], 0
                except TiffError as e:
                    at.append(i)
                    rows.append((no, *[None] * 8, str(e)))
            if rows:
                yield flush()

    return df.select(*keep, F.col(media_col).alias("_media")).mapInArrow(read, schema)


def store_texts(df: DataFrame, width: int = 576, compression: int = DEFLATE, predictor: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and the text as a one-page TIFF: its UTF-8 bytes, padded with 255 to full rows, as samples."""
    ship(df.sparkSession)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, files, first, held = batch.column(1), [], 0, 0

            def flush(end: int) -> pa.RecordBatch:
                part = batch.slice(first, end - first)
                return pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

            for i, text in enumerate(texts):
                raw = (text.as_py() or "").encode()
                rows = max(1, -(-len(raw) // width))
                files.append(write_tiff([np.frombuffer(raw.ljust(rows * width, b"\xff"), np.uint8).reshape(rows, width)], compression, predictor))
                held += len(files[-1])
                if held > BATCH:
                    yield flush(i + 1)
                    files, first, held = [], i + 1, 0
            if files:
                yield flush(len(texts))

    rows = id_text(df, id_col, text_col).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    return rows.mapInArrow(store, "doc_id long, n_bytes long, media binary")


def op4_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tiff_pages(store_texts(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))), "media", ("doc_id", "n_bytes", "media"))
    size = F.octet_length("pixels")
    return pages.select(
        "doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"), F.crc32(F.substring("pixels", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", "page", "error",
    )
