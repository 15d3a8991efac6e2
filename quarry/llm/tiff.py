"""TIFF columns: write pages, walk image directories, decode strips and tiles, undo predictors.

Read: both byte orders, classic TIFF and BigTIFF, strips and tiles, chunky and planar samples,
unsigned ones of 1, 2, 4, 8, 16 and 32 bits, signed and floating ones of 16 and 32 (floats of 64 too),
either fill order, no compression, PackBits, LZW and deflate, predictors 1, 2 and 3. A file may hold many
pages; ``pages`` gives one row for each in the order of the directory chain.

Defined results: a null or empty file has no page; a file that cannot be read, whatever its bytes, gives one row whose
``error`` says why, and the pages before the fault stay; a page is refused if it has more pixels than
the file's bytes can code; other columns of the table are ignored; equal files give equal rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import scan

# Tags, field types and codes of the TIFF 6.0 specification.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_AT, TILE_BYTES, FILL_ORDER, SAMPLE_FORMAT = 284, 317, 322, 323, 324, 325, 266, 339
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 13: "I", 16: "Q", 17: "q", 18: "Q"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
LZW_CLEAR, LZW_END = 256, 257

#: Letters of numpy's kinds by the sample format.
KINDS = {1: "u", 2: "i", 3: "f"}

#: Pixels of a row of the pages that hold a text's bytes.
ROW = 64
#: Bytes that one byte of a strip stands for at most (LZW: a code of 12 bits for a string of 3,838).
MOST = 4096


class TiffError(ValueError):
    """The file breaks the format or uses a part of it that is not read here."""


def pack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        run = 1
        while run < 128 and i + run < len(data) and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        j = i + 1
        while j < len(data) and j - i < 128 and (j + 1 >= len(data) or data[j] != data[j + 1]):
            j += 1
        out.append(j - i - 1)
        out += data[i:j]
        i = j
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def lzw(data: bytes) -> bytes:
    table, size, width, held, n, out = {}, 258, 9, 0, 0, bytearray()

    def put(code: int) -> None:
        nonlocal held, n
        held, n = held << width | code, n + width
        while n >= 8:
            n -= 8
            out.append(held >> n & 255)
        held &= (1 << n) - 1

    put(LZW_CLEAR)
    word = b""
    for x in data:
        longer = word + bytes((x,))
        if len(longer) == 1 or longer in table:
            word = longer
            continue
        put(table[word] if len(word) > 1 else word[0])
        table[longer], size, word = size, size + 1, bytes((x,))
        if size == 1 << width:  # the reader's table is one entry behind: the width grows one code early
            width += 1
        if size == 4094:
            put(table[word] if len(word) > 1 else word[0])
            put(LZW_CLEAR)
            table, size, width, word = {}, 258, 9, b""
    if word:
        put(table[word] if len(word) > 1 else word[0])
        size += 1
        if size == 1 << width and width < 12:
            width += 1
    put(LZW_END)
    if n:
        out.append(held << (8 - n) & 255)
    return bytes(out)


def unlzw(data: bytes, size: int) -> bytes:
    fresh = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, held, n, last, out, total = list(fresh), 9, 0, 0, None, [], 0
    for x in data:
        held, n = held << 8 | x, n + 8
        if n < width:
            continue
        n -= width
        code, held = held >> n, held & ((1 << n) - 1)
        if code == LZW_END or total >= size:
            break
        if code == LZW_CLEAR:
            table, width, last = list(fresh), 9, None
            continue
        if last is None:
            if code > 255:
                raise TiffError("LZW code out of order")
            word = table[code]
        elif code < len(table):
            word = table[code]
            table.append(last + word[:1])
        elif code == len(table):
            word = last + last[:1]
            table.append(word)
        else:
            raise TiffError("LZW code out of order")
        out.append(word)
        total += len(word)
        last = word
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return b"".join(out)


def unpack(data: bytes, kind: int, size: int) -> bytes:
    """``size`` bytes of one strip or tile. Too few are an error, what follows them is left."""
    try:
        if kind == NONE:
            out = data
        elif kind == PACKBITS:
            out = unpack_bits(data, size)
        elif kind == LZW:
            out = unlzw(data, size)
        elif kind in (DEFLATE, OLD_DEFLATE):
            out = zlib.decompressobj().decompress(data, size)
        else:
            raise TiffError(f"compression {kind} is not read")
    except zlib.error as e:
        raise TiffError(f"deflate: {e}") from e
    if len(out) < size:
        raise TiffError(f"{len(out)} bytes where {size} are due")
    return out[:size]


def difference(part: np.ndarray, predictor: int) -> np.ndarray:
    """What predictor 2 stores of (rows, columns, samples), or predictor 3, as bytes, of floats."""
    if predictor == 2:
        return np.concatenate((part[:, :1], part[:, 1:] - part[:, :-1]), 1)
    high, wide, deep = part.shape
    planes = np.ascontiguousarray(part.astype(part.dtype.newbyteorder(">"))).view(np.uint8).reshape(high, wide * deep, -1)
    rows = planes.transpose(0, 2, 1).reshape(high, -1)
    return np.concatenate((rows[:, :deep], rows[:, deep:] - rows[:, :-deep]), 1)


def undo(raw: bytes, kind: np.dtype, shape: tuple[int, int, int], predictor: int) -> np.ndarray:
    """The samples that stand behind ``raw``, in native order."""
    high, wide, deep = shape
    native = kind.newbyteorder("=")
    if predictor == 3:
        rows = np.frombuffer(raw, np.uint8).reshape(high, -1, deep)
        rows = np.cumsum(rows, axis=1, dtype=np.uint8).reshape(high, kind.itemsize, wide * deep)
        return np.ascontiguousarray(rows.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(shape).astype(native)
    part = np.frombuffer(raw, kind).reshape(shape)
    if predictor == 2:
        whole = part.astype(native).view(f"u{kind.itemsize}")
        return np.cumsum(whole, axis=1, dtype=whole.dtype).view(native)
    return part


def spread(raw: bytes, bits: int, high: int, row: int) -> bytes:
    """A byte for each of the ``row`` samples of under 8 bits of each of ``high`` rows, which begin at whole bytes."""
    single = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(high, -1), axis=1)[:, : row * bits].reshape(high, row, bits)
    return (single @ (1 << np.arange(bits - 1, -1, -1, dtype=np.uint8))).astype(np.uint8).tobytes()


def write(
    images: list[np.ndarray], kind: int = DEFLATE, predictor: int = 1, tile: tuple[int, int] | None = None, rows: int = 512, order: str = "<", level: int = 1, planar: int = 1, bits: int | None = None, fill: int = 1
) -> bytes:
    """A classic TIFF with one page for each image: (rows, columns) or (rows, columns, samples).

    ``bits`` under 8 packs uint8 samples; ``fill`` 2 stores each byte's bits in reverse.
    """
    pack = {NONE: bytes, PACKBITS: pack_bits, LZW: lzw, DEFLATE: lambda x: zlib.compress(x, level)}[kind]
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for image in images:
        image = image[:, :, None] if image.ndim == 2 else image
        high, wide, samples = image.shape
        size, form = bits or image.dtype.itemsize * 8, {v: k for k, v in KINDS.items()}[image.dtype.kind]
        step = (tile[1], tile[0]) if tile else (max(1, min(rows, high)), wide)
        at, sizes = [], []
        for plane in [image] if planar == 1 else [image[:, :, k : k + 1] for k in range(samples)]:
            for y in range(0, high, step[0]):
                for x in range(0, wide, step[1]):
                    part = plane[y : y + step[0], x : x + step[1]]
                    if tile:
                        part = np.pad(part, ((0, step[0] - part.shape[0]), (0, step[1] - part.shape[1]), (0, 0)))
                    if predictor > 1:
                        part = difference(part, predictor)
                    if size < 8:
                        single = np.unpackbits(part.reshape(part.shape[0], -1, 1), axis=2)[:, :, 8 - size :]
                        part = np.packbits(single.reshape(part.shape[0], -1), axis=1)
                    data = pack(part.astype(part.dtype.newbyteorder(order)).tobytes())
                    data = data.translate(MIRROR) if fill == 2 else data
                    at.append(len(out))
                    sizes.append(len(data))
                    out += data + b"\0" * (len(data) % 2)
        tags = {WIDTH: (4, [wide]), LENGTH: (4, [high]), BITS: (3, [size] * samples), COMPRESSION: (3, [kind]), PHOTOMETRIC: (3, [2 if samples == 3 else 1]), SAMPLES: (3, [samples]), PLANAR: (3, [planar]), PREDICTOR: (3, [predictor])}
        tags |= {FILL_ORDER: (3, [fill])} if fill > 1 else {}
        tags |= {SAMPLE_FORMAT: (3, [form] * samples)} if form > 1 else {}
        tags |= {TILE_WIDTH: (4, [tile[0]]), TILE_LENGTH: (4, [tile[1]]), TILE_AT: (4, at), TILE_BYTES: (4, sizes)} if tile else {STRIP_AT: (4, at), STRIP_ROWS: (4, [step[0]]), STRIP_BYTES: (4, sizes)}
        entries = b""
        for tag, (field, values) in sorted(tags.items()):
            raw = struct.pack(f"{order}{len(values)}{TYPES[field]}", *values)
            if len(raw) > 4:
                place, raw = len(out), raw + b"\0" * (len(raw) % 2)
                out += raw
                raw = struct.pack(order + "I", place)
            entries += struct.pack(order + "HHI", tag, field, len(values)) + raw.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


#: Each byte with its bits in reverse.
MIRROR = bytes(int(f"{x:08b}"[::-1], 2) for x in range(256))


def directories(data: bytes) -> Iterator[dict[int, tuple]]:
    """The tags of each image directory, along the chain. A chain that returns to itself is an error."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or len(data) < 8:
        raise TiffError("no TIFF header")
    magic = struct.unpack_from(order + "H", data, 2)[0]
    if magic not in (42, 43):
        raise TiffError(f"magic number {magic}")
    many, entry, place, inline = ("H", 12, "I", 4) if magic == 42 else ("Q", 20, "Q", 8)
    seen = set()
    try:
        at = struct.unpack_from(order + place, data, 4 if magic == 42 else 8)[0]
        while at:
            if at in seen:
                raise TiffError("the directories form a ring")
            seen.add(at)
            n = struct.unpack_from(order + many, data, at)[0]
            at += struct.calcsize(order + many)
            tags: dict = {0: (order,)}
            for k in range(n):
                tag, field, count = struct.unpack_from(order + "HH" + place, data, at + k * entry)
                if field not in TYPES:
                    continue
                form, value = f"{order}{count}{TYPES[field]}", at + k * entry + entry - inline
                if struct.calcsize(form) > inline:
                    value = struct.unpack_from(order + place, data, value)[0]
                tags[tag] = struct.unpack_from(form, data, value)
            yield tags
            at = struct.unpack_from(order + place, data, at + n * entry)[0]
    except struct.error as e:
        raise TiffError(f"the file ends within a directory: {e}") from e


def image(data: bytes, tags: dict[int, tuple]) -> np.ndarray:
    """The samples of one page: (rows, columns, samples)."""

    def one(tag: int, default: int | None = None) -> int:
        value = tags[tag][0] if tags.get(tag) else default
        if tag and (not isinstance(value, int) or value < 0):
            raise TiffError(f"tag {tag} is {value}")
        return value

    order, wide, high, samples, predictor = one(0), one(WIDTH), one(LENGTH), one(SAMPLES, 1), one(PREDICTOR, 1)
    bits, form = set(tags.get(BITS, (1,))), set(tags.get(SAMPLE_FORMAT, (1,)))
    if not wide or not high or not samples or len(bits) != 1 or len(form) != 1:
        raise TiffError(f"{wide} x {high} pixels of {samples} samples of {sorted(map(str, bits))} bits are not read")
    (bits,), (form,) = bits, form
    if bits not in {1: (1, 2, 4, 8, 16, 32), 2: (16, 32), 3: (16, 32, 64)}.get(form, ()):
        raise TiffError(f"samples of {bits} bits and format {form} are not read")
    if predictor not in (1, 2, 3) or predictor == 2 and (bits < 8 or form == 3) or predictor == 3 and form != 3:
        raise TiffError(f"predictor {predictor} of {bits} bits and format {form} is not read")
    kind, tiled, planar = np.dtype(f"{KINDS[form]}{max(bits, 8) // 8}").newbyteorder(order), TILE_AT in tags, one(PLANAR, 1) == 2
    step = (one(TILE_LENGTH), one(TILE_WIDTH)) if tiled else (min(one(STRIP_ROWS, high), high), wide)
    if not all(step):
        raise TiffError(f"strips or tiles of {step[1]} x {step[0]} pixels")
    at, sizes = tags.get(TILE_AT if tiled else STRIP_AT, ()), tags.get(TILE_BYTES if tiled else STRIP_BYTES, ())
    planes, deep = (samples, 1) if planar else (1, samples)
    due = planes * -(-high // step[0]) * -(-wide // step[1])
    if not due == len(at) == len(sizes):
        raise TiffError(f"{len(at)} strips or tiles where {due} are due")
    row = -(-step[1] * deep * bits // 8)  # bytes
    if any(place < 0 or size < 0 or place + size > len(data) for place, size in zip(at, sizes)):
        raise TiffError("a strip or tile lies outside the file")
    if max(high * -(-wide * samples * bits // 8), row * step[0]) > MOST * (sum(sizes) + 1):
        raise TiffError(f"{wide} x {high} pixels are more than {len(data)} bytes can code")
    out = np.zeros((high, wide, samples), kind.newbyteorder("="))
    spots = ((p, y, x) for p in range(planes) for y in range(0, high, step[0]) for x in range(0, wide, step[1]))
    for (p, y, x), place, size in zip(spots, at, sizes):
        tall = step[0] if tiled else min(step[0], high - y)
        coded = data[place : place + size]
        raw = unpack(coded.translate(MIRROR) if one(FILL_ORDER, 1) == 2 else coded, one(COMPRESSION, NONE), tall * row)
        raw = spread(raw, bits, tall, step[1] * deep) if bits < 8 else raw
        out[y : y + tall, x : x + step[1], p : p + deep] = undo(raw, kind, (tall, step[1], deep), predictor)[: high - y, : wide - x]
    return out


def read(data: bytes | None) -> Iterator[tuple[int, np.ndarray | None, str | None]]:
    """(page, samples, error) of each page. No fault of the file leaves this function."""
    page = 0
    try:
        for tags in directories(data) if data else ():
            yield page, image(data, tags), None
            page += 1
    except TiffError as e:
        yield page, None, str(e)
    except (ArithmeticError, LookupError, MemoryError, TypeError, ValueError, struct.error) as e:  # a field that no test above foresees
        yield page, None, f"{type(e).__name__}: {e}"


def pages(files: DataFrame, key: str, content: str) -> DataFrame:
    """One row per page of the binary column ``content``: key, page, width, height, samples, bits, pixels (native order), error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = [
                    (page, *((x.shape[1], x.shape[0], x.shape[2], x.itemsize * 8, x.tobytes()) if x is not None else (None,) * 5), error)
                    for page, x, error in read(batch.column(1)[k].as_py())
                ]
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(),) * 5 + (pa.binary(), pa.string()))]
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[k].as_py()] * len(rows), batch.column(0).type), *columns], names)

    names = ["key", "page", "width", "height", "samples", "bits", "pixels", "error"]
    kind = files.schema[key].dataType.simpleString()
    return files.select(key, content).mapInArrow(run, f"key {kind}, page int, width int, height int, samples int, bits int, pixels binary, error string")


def of_text(text: bytes) -> bytes:
    """A TIFF whose pages hold the bytes, filled up with zeros to whole rows of 64 pixels.

    A checksum of the text deals the compression (deflate six times of eight, LZW, PackBits), strips or
    tiles, predictor 1 or 2 and one to three pages.
    """
    size = max(1, -(-len(text) // ROW)) * ROW
    whole = np.frombuffer(text.ljust(size, b"\0"), np.uint8).reshape(-1, ROW)
    deal = zlib.crc32(text)
    kind = (LZW, PACKBITS, *(DEFLATE,) * 6)[deal % 8]
    step = -(-len(whole) // (1 + deal // 8 % 3))
    parts = [whole[y : y + step] for y in range(0, len(whole), step)]
    return write(parts, kind, 1 + deal // 24 % 2, (ROW, 16) if deal // 48 % 2 else None, rows=512)


def feature(pixels: np.ndarray) -> str:
    """Mean, deviation, entropy and the shares of eight equal ranges of the samples."""
    counts = np.bincount(pixels.ravel(), minlength=256)
    share = counts / counts.sum()
    level = np.arange(256)
    mean = float(share @ level)
    some = share[share > 0]
    figures = [mean, float(np.sqrt(share @ (level - mean) ** 2)), float(-(some * np.log2(some)).sum()), *share.reshape(8, 32).sum(1).tolist()]
    return ",".join(f"{x:.4f}" for x in figures)


def text_features(docs: DataFrame) -> DataFrame:
    """Store each text (null: empty) as a TIFF, read the stored bytes back, and describe them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column("text").cast(pa.large_binary()):
                text = value.as_py() or b""
                media = of_text(text)
                found = list(read(media))
                if error := found[-1][2]:
                    raise TiffError(error)
                pixels = np.concatenate([x for _, x, _ in found])
                payload = pixels.tobytes()
                rows.append((len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(pixels)))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in zip(*rows))], names)
        scan.release()

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return scan.bounded(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
