"""Operator 2, TIFF columns: files in a binary column become one row per page, with decoded samples.

The reader follows the chain of image directories in either byte order, takes strips or tiles that are raw (1), LZW (5),
deflate (8 or 32946) or PackBits (32773), undoes the horizontal predictor (2) and crops tiles to the page. Samples are 8
or 16 bits, interleaved. The writer makes 8-bit grey pages in any of these forms.

Files are rows: Spark partitions them, and a task holds one file and its pages at a time. Nothing is shuffled.

Edge cases. Null media: one row, page null, error 'no data'. A file that is cut short, loops in its directories or
asks for something unknown, empty or larger than ``MOST_PAGE_BYTES``: one row for each page decoded so far and one with
the error, so no file is dropped in silence; no part is decoded beyond the size that its page needs. Repeated rows give their pages each. Columns named in ``keep`` pass through; their names must differ from those
of the result. Texts: null as empty; the payload is the text in UTF-8 with bytes 0 up to a positive multiple of 64. An
empty table gives an empty result.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.shared import text_bytes

RAW, LZW, DEFLATE, PACKBITS = 1, 5, 8, 32773
WIDTH, STRIP_ROWS, TILE = 64, 128, 64
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 16: "Q"}
_RUN = re.compile(rb"(.)\1{2,127}", re.S)
#: Width in bits of the k-th code after a clear, for a reader whose table grows by one entry a code after the first.
_WIDTHS = np.array([9 if k < 254 else 10 if k < 766 else 11 if k < 1790 else 12 for k in range(3839)])
_ENDS = np.cumsum(_WIDTHS)


def packbits_encode(data: bytes, row: int) -> bytes:
    """Runs and literals of each ``row`` bytes; none goes on into the next row."""
    out = bytearray()
    for start in range(0, len(data), row):
        part, at = data[start : start + row], 0
        for m in _RUN.finditer(part):
            for i in range(at, m.start(), 128):
                out += bytes([min(m.start() - i, 128) - 1]) + part[i : min(m.start(), i + 128)]
            out += bytes([257 - (m.end() - m.start()), part[m.start()]])
            at = m.end()
        for i in range(at, len(part), 128):
            out += bytes([min(len(part) - i, 128) - 1]) + part[i : i + 128]
    return bytes(out)


def packbits_decode(data: bytes, most: int) -> bytes:
    """At most ``most`` bytes."""
    parts, at, have = [], 0, 0
    while at < len(data) and have < most:
        n = data[at]
        if n < 128:
            parts.append(data[at + 1 : at + 2 + n])
            at += 2 + n
        elif n > 128:
            parts.append(data[at + 1 : at + 2] * (257 - n))
            at += 2
        else:
            at += 1
            continue
        have += len(parts[-1])
    return b"".join(parts)[:most]


def inflate(data: bytes, most: int) -> bytes:
    """At most ``most`` bytes."""
    return zlib.decompressobj().decompress(data, most) if most else b""


def lzw_encode(data: bytes) -> bytes:
    """Codes with the most significant bit first; the table is cleared when 12 bits are used up."""
    codes, widths, known, run, fresh, prefix = [256], [9], {}, 0, 258, -1
    for c in data:
        if prefix < 0:
            prefix = c
            continue
        key = prefix << 8 | c
        found = known.get(key)
        if found is not None:
            prefix = found
            continue
        codes.append(prefix)
        run += 1
        known[key] = fresh
        fresh += 1
        prefix = c
        if run == 3836:
            codes.append(256)
            widths.append(run + 1)
            known, run, fresh = {}, 0, 258
    if prefix >= 0:
        codes.append(prefix)
        run += 1
    codes.append(257)
    widths.append(run + 1)
    width = np.concatenate([[9], *(_WIDTHS[:n] for n in widths[1:])])
    bits = (np.array(codes, np.int64)[:, None] >> np.arange(11, -1, -1)) & 1
    return np.packbits(bits[np.arange(12) >= 12 - width[:, None]].astype(np.uint8)).tobytes()


def lzw_decode(data: bytes, most: int) -> bytes:
    """At most ``most`` bytes, or a few entries more. Bits are cut into codes many at a time, since a code's width follows from its place after the last clear."""
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    three = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    base, parts, at, end = [bytes([i]) for i in range(256)] + [b"", b""], [], 0, 8 * len(data)
    have = 0
    while at < end and have < most:
        fit = int(np.searchsorted(_ENDS, end - at, "right"))
        start = at + _ENDS[:fit] - _WIDTHS[:fit]
        codes = (three[start >> 3] >> (24 - (start & 7) - _WIDTHS[:fit])) & ((1 << _WIDTHS[:fit]) - 1)
        stops = np.flatnonzero((codes == 256) | (codes == 257))
        stop = int(stops[0]) if len(stops) else fit
        table, last = base.copy(), b""
        for code in codes[:stop].tolist():
            if code < len(table):
                entry = table[code]
            elif code == len(table) and last:
                entry = last + last[:1]
            else:
                raise ValueError("LZW code out of order")
            if last:
                table.append(last + entry[:1])
            parts.append(entry)
            last = entry
            have += len(entry)
            if have >= most:
                break
        if stop == fit or codes[stop] == 257:
            break
        at += int(_ENDS[stop])
    return b"".join(parts)


_ENCODE = {RAW: lambda data, row: data, LZW: lambda data, row: lzw_encode(data), DEFLATE: lambda data, row: zlib.compress(data), PACKBITS: packbits_encode}
_DECODE = {RAW: lambda data, most: data, LZW: lzw_decode, DEFLATE: inflate, 32946: inflate, PACKBITS: packbits_decode}
#: A page of more bytes is an error, since its size is only what the file says.
MOST_PAGE_BYTES = 1 << 30


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, tiled: bool = False, predictor: int = 1, order: str = "<") -> bytes:
    """A file of 8-bit pages (rows, columns) or (rows, columns, samples)."""
    out = bytearray(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 0))
    link = 4
    for page in pages:
        page = page[:, :, None] if page.ndim == 2 else page
        rows, columns, samples = page.shape
        parts = []
        for y in range(0, rows, TILE if tiled else STRIP_ROWS):
            for x in range(0, columns, TILE) if tiled else (0,):
                part = page[y : y + TILE, x : x + TILE] if tiled else page[y : y + STRIP_ROWS]
                if tiled:
                    part = np.pad(part, ((0, TILE - part.shape[0]), (0, TILE - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
                parts.append(_ENCODE[compression](np.ascontiguousarray(part).tobytes(), part.shape[1] * samples))
        offsets = []
        for part in parts:
            offsets.append(len(out))
            out += part
        tags = {256: [columns], 257: [rows], 258: [8] * samples, 259: [compression], 262: [1 if samples < 3 else 2], 277: [samples], 317: [predictor]}
        sizes = [len(p) for p in parts]
        tags |= {322: [TILE], 323: [TILE], 324: offsets, 325: sizes} if tiled else {273: offsets, 278: [STRIP_ROWS], 279: sizes}
        entries = b""
        for tag, values in sorted(tags.items()):
            kind = 3 if tag in (258, 259, 262, 277, 317) else 4
            data = struct.pack(f"{order}{len(values)}{_TYPES[kind]}", *values)
            if len(data) > 4:
                out += bytes(len(out) & 1)
                place = struct.pack(order + "I", len(out))
                out += data
            else:
                place = data.ljust(4, b"\0")
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + place
        out += bytes(len(out) & 1)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += bytes(4)
    return bytes(out)


#: Decoded bytes of the pages that leave a task together; one page may be more.
PAGES_BYTES = 8 << 20


def read_tiff(data: bytes) -> Iterator[tuple[np.ndarray, int]]:
    """(samples as rows x columns x samples a pixel, compression) of each page."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("directories form a loop")
        seen.add(at)
        count, tags = struct.unpack_from(order + "H", data, at)[0], {}
        for i in range(count):
            tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind in _TYPES and kind != 2:
                form = f"{order}{n}{_TYPES[kind]}"
                place = at + 10 + 12 * i
                if struct.calcsize(form) > 4:
                    place = struct.unpack_from(order + "I", data, place)[0]
                tags[tag] = struct.unpack_from(form, data, place)
        yield _page(data, tags, order)
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0]


def _page(data: bytes, tags: dict[int, tuple], order: str) -> tuple[np.ndarray, int]:
    one = lambda tag, default=None: tags[tag][0] if tag in tags or default is None else default
    columns, rows, samples, bits, compression, predictor = one(256), one(257), one(277, 1), one(258, 1), one(259, 1), one(317, 1)
    if bits not in (8, 16) or compression not in _DECODE or predictor not in (1, 2) or one(284, 1) != 1:
        raise ValueError(f"unsupported page: {bits} bits, compression {compression}, predictor {predictor}")
    kind = np.dtype(np.uint8 if bits == 8 else order + "u2")
    tiled = 324 in tags
    high, wide = (one(323), one(322)) if tiled else (min(one(278, rows), rows), columns)
    offsets, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    if min(columns, rows, samples, high, wide) < 1:
        raise ValueError(f"empty page: {columns} x {rows} x {samples}, parts of {wide} x {high}")
    if max(rows * columns, high * wide) * samples * kind.itemsize > MOST_PAGE_BYTES:
        raise ValueError(f"page too large: {columns} x {rows} x {samples}, parts of {wide} x {high}")
    if len(offsets) != len(sizes) or len(offsets) < -(-rows // high) * -(-columns // wide):
        raise ValueError(f"{len(offsets)} parts for {columns} x {rows}")
    out, across = np.zeros((rows, columns, samples), kind.newbyteorder("=")), -(-columns // wide)
    for k, (offset, size) in enumerate(zip(offsets, sizes, strict=True)):
        y, x = k // across * high, k % across * wide
        if y >= rows:
            break
        there = high if tiled else min(high, rows - y)
        raw = _DECODE[compression](data[offset : offset + size], there * wide * samples * kind.itemsize)
        part = np.frombuffer(raw, kind, there * wide * samples).reshape(there, wide, samples).astype(out.dtype)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=out.dtype)
        out[y : y + there, x : x + wide] = part[: rows - y, : columns - x]
    return out, compression


def feature_of(samples: np.ndarray) -> str:
    """16 hex digits: the histogram of samples in 16 bins, scaled to the fullest."""
    n = np.bincount(samples.reshape(-1) >> (samples.dtype.itemsize * 8 - 4), minlength=16)
    return "".join(f"{x:x}" for x in n * 15 // max(1, n.max()))


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's payload as a grey page 64 samples wide.

    The form follows from the payload's checksum (PackBits strips, LZW strips, deflate strips or deflate tiles, the
    deflated ones predicted), so equal texts give equal files and every form is used.
    """
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
    forms = [(PACKBITS, False, 1), (LZW, False, 1), (DEFLATE, False, 2), (DEFLATE, True, 2)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part, sizes, files = b.slice(at, 500), [], []
                for text in text_bytes(part.column(1)):
                    payload = text + bytes(-len(text) % WIDTH or (0 if text else WIDTH))
                    sizes.append(len(text))
                    files.append(write_tiff([np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)], *forms[zlib.crc32(payload) % 4]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], schema=out)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def tiff_pages(files: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per page: the columns ``keep``, then page, width, height, channels, compression, samples, feature, error."""
    own = T._parse_datatype_string("page int, width int, height int, channels int, compression int, samples binary, feature string, error string")
    some = files.select(*keep, F.col(media_col).alias("__media"))
    names = [*keep, *own.fieldNames()]

    def decoded(data: bytes | None) -> Iterator[tuple]:
        """A file's pages one after the other, then its error if it has one."""
        n = 0
        try:
            if data is None:
                raise ValueError("no data")
            for page, compression in read_tiff(data):
                yield n, page.shape[1], page.shape[0], page.shape[2], compression, page.tobytes(), feature_of(page), None
                n += 1
            if not n:
                raise ValueError("no page")
        except (ValueError, KeyError, IndexError, TypeError, ArithmeticError, struct.error, zlib.error, MemoryError) as e:
            yield (None,) * 7 + (f"{type(e).__name__}: {e}",)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32()] * 5 + [pa.binary(), pa.string(), pa.string()]
        for b in batches:
            took, rows, size = [], [], 0

            def made() -> pa.RecordBatch:
                columns = [b.column(i).take(pa.array(took)) for i in range(len(keep))] + [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                took.clear()
                rows.clear()
                return pa.RecordBatch.from_arrays(columns, names=names)

            for at in range(b.num_rows):
                for row in decoded(b.column(len(keep))[at].as_py()):
                    took.append(at)
                    rows.append(row)
                    size += len(row[5] or b"")
                    if size > PAGES_BYTES or len(rows) >= 500:  # pages wait until they are so many bytes, not files
                        yield made()
                        size = 0
            if rows:
                yield made()

    return some.mapInArrow(run, T.StructType([*(some.schema[k] for k in keep), *own.fields]))
