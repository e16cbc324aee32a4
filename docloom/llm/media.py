"""Media columns: baseline JPEG written and read in numpy.

Writing stores bytes losslessly: each byte becomes one flat 8x8 block of luminance
(quantiser 8 for the DC term), 64 blocks to a row, with a restart marker after each row.
More than 8,128 rows go into further JPEG images behind the first.  Reading parses the
markers, decodes the Huffman scan and rebuilds the luminance from the DC terms alone, a
thumbnail of an eighth of the size, which for stored bytes are the bytes themselves.

Rows of blocks between restart markers are independent, so all of them are decoded
together, one symbol of each at a time.  Any baseline or extended sequential JPEG with
8-bit samples can be read: colour, subsampling, AC terms, several scans.

Defined results: a null text is stored as an empty one (64 zero bytes); null or unreadable
media give null features with ``error`` set; a text of any length is handled in pieces of
about a megabyte; equal texts give equal media; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_arrow

WIDTH = 64  # blocks, and so bytes, in a row
FRAME_ROWS = 8128  # rows of blocks in an image; its height has 16 bits
CHUNK = 1 << 20  # bytes in hand at once

# The code lengths of the standard table for luminance DC terms, by category.
DC_COUNTS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = tuple(range(12))
#: Ours: the only AC symbol in use is the end of the block.
AC_COUNTS = (1, *[0] * 15)
AC_SYMBOLS = (0,)


def huffman_codes(counts: tuple[int, ...], symbols: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """(symbol, code, length), codes in canonical order."""
    out, code, at = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((symbols[at], code, length))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _block_codes() -> tuple[np.ndarray, np.ndarray]:
    """Code and length of a whole block, by the difference of DC terms plus 255."""
    dc = {s: (c, n) for s, c, n in huffman_codes(DC_COUNTS, DC_SYMBOLS)}
    codes, lengths = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = dc[size]
        codes[d + 255] = ((code << size) | (d if d >= 0 else d + (1 << size) - 1)) << 1
        lengths[d + 255] = n + size + 1
    return codes, lengths


_CODES, _LENGTHS = _block_codes()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(rows: int) -> bytes:
    return b"".join(
        (
            b"\xff\xd8",
            _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"),
            _segment(0xDB, bytes([0, 8, *[1] * 63])),
            _segment(0xC0, struct.pack(">BHHBBBB", 8, rows * 8, WIDTH * 8, 1, 1, 0x11, 0)),
            _segment(0xC4, bytes([0x00, *DC_COUNTS, *DC_SYMBOLS])),
            _segment(0xC4, bytes([0x10, *AC_COUNTS, *AC_SYMBOLS])),
            _segment(0xDD, struct.pack(">H", WIDTH)),
            _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
        )
    )


def _entropy(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The coded bytes of all rows, before stuffing, and where each row ends."""
    level = rows.astype(np.int64) - 128
    level[:, 1:] -= level[:, :-1].copy()
    level += 255
    codes, lengths = _CODES[level], _LENGTHS[level]
    upto = np.cumsum(lengths, axis=1)
    bits = upto[:, -1]
    ends = np.cumsum((bits + 7) >> 3)
    starts = ends - ((bits + 7) >> 3)
    at = (upto - lengths) + (starts * 8)[:, None]
    wide = (codes << (24 - lengths - (at & 7))).ravel()
    first = (at >> 3).ravel()
    total = int(ends[-1])
    out = np.zeros(total + 2)
    for k, shift in enumerate((16, 8, 0)):  # a code reaches over three bytes at most; its bits are its own
        out += np.bincount(first + k, weights=(wide >> shift) & 255, minlength=total + 2)[: total + 2]
    out = out[:total].astype(np.uint8)
    out[ends - 1] |= ((1 << (-bits & 7)) - 1).astype(np.uint8)
    return out, ends


def encode_bytes(payloads: list[bytes]) -> list[bytes]:
    """JPEG images of payloads whose lengths are positive multiples of 64."""
    frames: list[tuple[int, bytes]] = []
    for i, p in enumerate(payloads):
        if not p or len(p) % WIDTH:
            raise ValueError("a payload is a positive multiple of 64 bytes")
        frames += [(i, p[k : k + WIDTH * FRAME_ROWS]) for k in range(0, len(p), WIDTH * FRAME_ROWS)]
    media: list[list[bytes]] = [[] for _ in payloads]
    while frames:
        group, size = [], 0
        while frames and (not group or size + len(frames[-1][1]) <= CHUNK):
            group.append(frames.pop())
            size += len(group[-1][1])
        counts = np.array([len(f) // WIDTH for _, f in group])
        data, ends = _entropy(np.frombuffer(b"".join(f for _, f in group), np.uint8).reshape(-1, WIDTH))
        row = np.zeros(len(data), np.int64)
        row[ends[:-1]] = 1
        row = np.cumsum(row)
        last = np.cumsum(counts)
        number = np.arange(len(ends)) - np.repeat(last - counts, counts)  # of each row in its image
        full = data == 255
        place = np.arange(len(data)) + np.cumsum(full) - full + 2 * row
        out = np.zeros(len(data) + int(full.sum()) + 2 * len(ends), np.uint8)
        out[place] = data
        tail = place[ends - 1] + 1 + full[ends - 1]
        out[tail], out[tail + 1] = 0xFF, 0xD0 + (number & 7)
        out[tail[last - 1] + 1] = 0xD9
        cuts = np.concatenate(([0], tail[last - 1] + 2))
        for (i, _), rows, a, b in zip(group, counts, cuts[:-1], cuts[1:], strict=True):
            media[i].append(_head(int(rows)) + out[a:b].tobytes())
    return [b"".join(reversed(m)) for m in media]


@dataclass
class Scan:
    """What a scan needs: lanes are its stretches between restart markers."""

    key: tuple
    lanes: list[bytes]
    units: int
    interval: int


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    quantisers: dict[int, int] = field(default_factory=dict)
    tables: dict[int, tuple] = field(default_factory=dict)
    scan: Scan | None = None


_ENDS = re.compile(rb"\xff+[^\x00\xd0-\xd7\xff]")
_RESTART = re.compile(rb"\xff+[\xd0-\xd7]")


def parse_jpeg(data: bytes) -> list[Image]:
    """The images of a byte string, with the scan that holds their luminance."""
    images, at = [], 0
    while at < len(data):
        if data[at : at + 2] != b"\xff\xd8":
            if images:
                break
            raise ValueError("not a JPEG")
        image, interval, at = Image(), 0, at + 2
        while True:
            while data[at : at + 2] == b"\xff\xff":
                at += 1
            if at + 2 > len(data) or data[at] != 0xFF:
                raise ValueError("marker expected")
            marker, at = data[at + 1], at + 2
            if marker == 0xD9:
                break
            if marker == 0x01 or 0xD0 <= marker <= 0xD7:
                continue
            (size,) = struct.unpack_from(">H", data, at)
            body, at = data[at + 2 : at + size], at + size
            if marker == 0xDB:
                k = 0
                while k < len(body):
                    wide = body[k] >> 4
                    image.quantisers[body[k] & 15] = struct.unpack_from(">H", body, k + 1)[0] if wide else body[k + 1]
                    k += 129 if wide else 65
            elif marker in (0xC0, 0xC1):
                precision, image.height, image.width, n = struct.unpack_from(">BHHB", body)
                if precision != 8 or not image.width or not image.height:
                    raise ValueError("only 8-bit samples and stated sizes")
                image.components = [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * n, 3)]
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("only sequential Huffman coding")
            elif marker == 0xC4:
                k = 0
                while k < len(body):
                    counts = tuple(body[k + 1 : k + 17])
                    image.tables[body[k]] = (counts, tuple(body[k + 17 : k + 17 + sum(counts)]))
                    k += 17 + sum(counts)
            elif marker == 0xDD:
                (interval,) = struct.unpack_from(">H", body)
            elif marker == 0xDA:
                found = _ENDS.search(data, at)
                end = found.start() if found else len(data)
                chosen = {body[k]: body[k + 1] for k in range(1, 1 + 2 * body[0], 2)}
                if image.components[0][0] in chosen:
                    image.scan = _scan(image, chosen, interval, data[at:end])
                at = end
                if not found:
                    break
        if image.scan is None:
            raise ValueError("no scan of the luminance")
        images.append(image)
    if not images:
        raise ValueError("not a JPEG")
    return images


def _scan(image: Image, chosen: dict[int, int], interval: int, data: bytes) -> Scan:
    parts = [c for c in image.components if c[0] in chosen]
    most_h, most_v = max(c[1] for c in image.components), max(c[2] for c in image.components)
    if len(parts) == 1:  # not interleaved: the component's own blocks, row by row
        across = -(-(-(-image.width * parts[0][1] // most_h)) // 8)
        down = -(-(-(-image.height * parts[0][2] // most_v)) // 8)
        layout = ((0, 1, 1),)
    else:
        across, down = -(-image.width // (8 * most_h)), -(-image.height // (8 * most_v))
        layout = tuple((i, c[1], c[2]) for i, c in enumerate(parts))
    tables = tuple((image.tables[chosen[c[0]] >> 4], image.tables[0x10 | chosen[c[0]] & 15]) for c in parts)
    lanes = [x.replace(b"\xff\x00", b"\xff") for x in (_RESTART.split(data) if interval else [data])]
    units = across * down
    want = -(-units // interval) if interval else 1
    if len(lanes) != want:
        raise ValueError("restart markers are missing")
    return Scan((layout, tables), lanes, units, interval or units)


def _lookup(counts: tuple[int, ...], symbols: tuple[int, ...]) -> np.ndarray:
    """By the next 16 bits: length of the code times 256, plus its symbol; 0 if there is none."""
    out = np.zeros(1 << 16, np.int32)
    for symbol, code, length in huffman_codes(counts, symbols):
        out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
    return out


def _decode(key: tuple, lanes: list[bytes], units: np.ndarray) -> np.ndarray:
    """DC terms of the first component: a row per lane, its blocks in coded order.

    Raises for data that ends too early or holds no valid code."""
    layout, tables = key
    order = np.argsort(-units, kind="stable")
    sizes = np.array([len(x) for x in lanes])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))[order]
    raw = np.frombuffer(b"".join(lanes) + bytes(8), np.uint8).astype(np.uint32)
    words = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    at, limit = starts * 8, (starts + sizes[order]) * 8
    left = units[order]
    lookups = [(_lookup(*dc), _lookup(*ac)) for dc, ac in tables]
    first = layout[0][1] * layout[0][2]
    out = np.zeros((len(lanes), int(left[0]) * first), np.int32)
    carried = [np.zeros(len(lanes), np.int64) for _ in layout]

    def symbols(table: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        got = table[words[at >> 3] >> (16 - (at & 7)) & 0xFFFF]
        if not got.all():
            raise ValueError("no such code")
        return got & 255, at + (got >> 8)

    for unit in range(int(left[0])):
        n = int(np.searchsorted(-left, -unit, side="left"))  # lanes with a further unit
        for i, h, v in layout:
            dc, ac = lookups[i]
            for block in range(h * v):
                size, here = symbols(dc, at[:n])
                value = (words[here >> 3] >> (32 - (here & 7) - np.maximum(size, 1)).astype(np.uint32)).astype(np.int64) & ((1 << size) - 1)
                carried[i][:n] += np.where((size > 0) & (value < (1 << np.maximum(size - 1, 0))), value - (1 << size) + 1, value)
                if i == 0:
                    out[:n, unit * first + block] = carried[0][:n]
                at[:n] = here + size
                busy, k = np.arange(n), np.ones(n, np.int64)
                while busy.size:
                    got, here = symbols(ac, at[busy])
                    at[busy] = here + (got & 15)
                    k = k + np.where(got == 0xF0, 16, (got >> 4) + 1)
                    on = (got != 0) & (k < 64)
                    busy, k = busy[on], k[on]
                if (at[:n] > limit[:n]).any():
                    raise ValueError("the data end too early")
    back = np.empty_like(out)
    back[order] = out
    return back


def thumbnails(images: list[Image]) -> list[np.ndarray]:
    """DC-only luminance of each image: an eighth of its size, uint8."""
    out: list[np.ndarray | None] = [None] * len(images)
    groups: dict[tuple, list[int]] = {}
    for i, image in enumerate(images):
        groups.setdefault(image.scan.key, []).append(i)
    for key, members in groups.items():
        while members:
            batch, size = [], 0
            while members and (not batch or size < CHUNK):
                batch.append(members.pop())
                size += sum(map(len, images[batch[-1]].scan.lanes))
            lanes, units = [], []
            for i in batch:
                s = images[i].scan
                lanes += s.lanes
                units += [min(s.interval, s.units - k * s.interval) for k in range(len(s.lanes))]
            units = np.array(units)
            terms, k = _decode(key, lanes, units), 0
            for i in batch:
                s = images[i].scan
                rows = terms[k : k + len(s.lanes)]
                counts = units[k : k + len(s.lanes)]
                k += len(s.lanes)
                per = key[0][0][1] * key[0][0][2]
                flat = rows[:, : s.interval * per] if (counts == s.interval).all() else np.concatenate([r[: c * per] for r, c in zip(rows, counts, strict=True)])
                out[i] = _arrange(images[i], key[0], flat.reshape(-1))
    return out


def _arrange(image: Image, layout: tuple, terms: np.ndarray) -> np.ndarray:
    _, h, v, quantiser = image.components[0]
    most_h, most_v = max(c[1] for c in image.components), max(c[2] for c in image.components)
    wide, high = -(-(-(-image.width * h // most_h)) // 8), -(-(-(-image.height * v // most_v)) // 8)
    h, v = layout[0][1:]
    across = wide if len(layout) == 1 else -(-image.width // (8 * most_h))
    grid = terms.reshape(-1, across, v, h).transpose(0, 2, 1, 3).reshape(-1, across * h)[:high, :wide]
    return np.clip(np.floor(grid * image.quantisers[quantiser] / 8 + 128.5), 0, 255).astype(np.uint8)


def thumbnail_hash(thumb: np.ndarray) -> str:
    """64 bits in hex: which cells of an 8x8 grid over the thumbnail are lighter than the mean cell."""
    rows = np.add.reduceat(thumb, np.arange(8) * thumb.shape[0] // 8, axis=0, dtype=np.int64)
    cells = np.add.reduceat(rows, np.arange(8) * thumb.shape[1] // 8, axis=1)
    high = np.diff(np.append(np.arange(8) * thumb.shape[0] // 8, thumb.shape[0])).clip(1)
    wide = np.diff(np.append(np.arange(8) * thumb.shape[1] // 8, thumb.shape[1])).clip(1)
    means = cells / (high[:, None] * wide[None, :])
    return np.packbits((means > means.mean()).ravel()).tobytes().hex()


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The rows in order, about CHUNK bytes of the column at a time."""
    values = batch.column(batch.schema.get_field_index(column))
    values = values.cast(pa.large_binary() if not pa.types.is_large_string(values.type) else pa.large_string())
    first, size, held = 0, 0, []
    for i, x in enumerate(values):
        raw = x.as_py()
        raw = raw.encode() if isinstance(raw, str) else raw
        held.append(raw)
        size += len(raw or b"")
        if size >= CHUNK:
            yield batch.slice(first, i + 1 - first), held
            first, size, held = i + 1, 0, []
    if held:
        yield batch.slice(first), held


def _with(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def store_text(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``docs`` with a binary column of JPEG images that hold the UTF-8 bytes of the text,
    zeros appended up to a positive multiple of 64."""
    docs = docs.drop(media) if media != text else docs

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in _slices(batch, text):
                padded = [x + bytes((-len(x) % WIDTH) or (0 if x else WIDTH)) for x in (x or b"" for x in raw)]
                yield _with(part, {media: pa.array(encode_bytes(padded), pa.binary())})

    return map_arrow(docs, write, T.StructType([*docs.schema.fields, T.StructField(media, T.BinaryType())]))


FEATURES = T.StructType(
    [
        T.StructField("width", T.LongType()),
        T.StructField("height", T.LongType()),
        T.StructField("frames", T.LongType()),
        T.StructField("thumbnail_hash", T.StringType()),
        T.StructField("samples_bytes", T.LongType()),
        T.StructField("samples_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


def _features(media: list[bytes | None]) -> list[dict]:
    """Dimensions and hashes of thumbnails; those of several images lie below each other."""
    out: list[dict] = [{"error": "null"} if m is None else {"media_bytes": len(m), "media_sha256": hashlib.sha256(m).hexdigest()} for m in media]
    images: list[Image] = []
    owner: list[int] = []
    for i, m in enumerate(media):
        if m is not None:
            try:
                found = parse_jpeg(m)
            except (ValueError, IndexError, KeyError, struct.error) as e:
                out[i]["error"] = f"unreadable: {e}"
                continue
            images += found
            owner += [i] * len(found)
    try:
        thumbs = thumbnails(images)
    except (ValueError, IndexError) as e:
        if len(set(owner)) == 1:
            out[owner[0]]["error"] = f"unreadable: {e}"
            return out
        return [_features([m])[0] for m in media]  # one of them is broken: each by itself
    by_row: dict[int, list[int]] = {}
    for k, i in enumerate(owner):
        by_row.setdefault(i, []).append(k)
    for i, ks in by_row.items():
        samples = b"".join(thumbs[k].tobytes() for k in ks)
        whole = np.vstack([thumbs[k] for k in ks]) if len({thumbs[k].shape[1] for k in ks}) == 1 else thumbs[ks[0]]
        out[i] |= {
            "width": images[ks[0]].width,
            "height": sum(images[k].height for k in ks),
            "frames": len(ks),
            "thumbnail_hash": thumbnail_hash(whole),
            "samples_bytes": len(samples),
            "samples_sha256": hashlib.sha256(samples).hexdigest(),
            "tail_crc32": zlib.crc32(samples[-64:]),
        }
    return out


def media_features(table: DataFrame, media: str = "media") -> DataFrame:
    """``table`` without the media, with the columns of FEATURES read from them."""
    kept = [f for f in table.schema.fields if f.name != media and f.name not in FEATURES.names]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {f.name: {T.LongType(): pa.int64(), T.StringType(): pa.string()}[f.dataType] for f in FEATURES.fields}
        for batch in batches:
            for part, raw in _slices(batch, media):
                rows = _features(raw)
                yield _with(part.select([f.name for f in kept]), {n: pa.array([r.get(n) for r in rows], t) for n, t in types.items()})

    return map_arrow(table, look, T.StructType([*kept, *FEATURES.fields]))
