"""Media columns: baseline JPEG written and read in numpy; DC-only luminance thumbnails, dimensions and thumbnail hashes.

A byte is stored as one flat 8x8 block: with a quantiser of 8 the block's DC level is the byte less 128, so the DC-only
thumbnail of the picture is the payload itself. A row of 64 blocks is one restart interval; intervals start byte-aligned
with a fresh predictor, so all of a batch's intervals are Huffman-decoded side by side, one numpy step a symbol.
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

from shelfwise.llm.common import byte_view, pick

ROW = 64
#: Rows of a picture: its height of 8 pixels a row must fit in 16 bits. A longer payload is several pictures in a row.
MAX_ROWS = 8191
GROUP_BYTES = 4 << 20

# Code lengths and symbols of the usual luminance DC table (ITU T.81, annex K.3).
DC_BITS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = tuple(range(12))
#: AC codes: only the end of block occurs, so it gets the one-bit code.
AC_BITS = (1, *[0] * 15)
AC_SYMBOLS = (0,)
# Order of coefficients along the zigzag (ITU T.81, figure A.6) is not needed, as only DC is reconstructed.


def _codes(bits: tuple[int, ...], symbols: tuple[int, ...]) -> dict[int, tuple[int, int]]:
    """Canonical codes by symbol: (code, length)."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            out[symbols[k]] = code, length
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _lookup(bits: tuple[int, ...], symbols: tuple[int, ...]) -> np.ndarray:
    """By the next 16 bits: symbol << 8 | code length; 0 where there is no such code."""
    table = np.zeros(1 << 16, np.int32)
    for symbol, (code, length) in _codes(bits, symbols).items():
        table[code << 16 - length : code + 1 << 16 - length] = symbol << 8 | length
    return table


def _difference_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each DC difference from -255 to 255, end of block included."""
    dc, (eob, eob_length) = _codes(DC_BITS, DC_SYMBOLS), _codes(AC_BITS, AC_SYMBOLS)[0]
    value, length = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = dc[size]
        amplitude = d if d >= 0 else d + (1 << size) - 1
        value[d + 255] = (code << size | amplitude) << eob_length | eob
        length[d + 255] = n + size + eob_length
    return value, length


VALUE, LENGTH = _difference_codes()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


HEAD = b"\xff\xd8" + _segment(0xDB, b"\x00" + bytes([8] * 64))
TAIL = (
    _segment(0xC4, bytes([0x00, *DC_BITS, *DC_SYMBOLS])) + _segment(0xC4, bytes([0x10, *AC_BITS, *AC_SYMBOLS])) + _segment(0xDD, struct.pack(">H", ROW)) + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
)


def encode_rows(rows: np.ndarray, heights: list[int]) -> list[bytes]:
    """Pictures of the given heights (in rows of 64 bytes) that together hold all rows."""
    n = len(rows)
    level = np.ascontiguousarray(rows.T).astype(np.int32)  # a step works on one block of every row
    diff = np.empty((ROW, n), np.int32)
    diff[0] = level[0] - 128
    diff[1:] = level[1:] - level[:-1]
    diff += 255
    value, length = VALUE[diff], LENGTH[diff]
    end = np.cumsum(length, axis=0)
    start = end - length
    width = int((end[-1].max() + 7) // 8) + 4 if n else 4
    out = np.zeros((n, width), np.uint8)
    flat, base = out.reshape(-1), np.arange(n, dtype=np.int64) * width
    shifted = value << (24 - (start & 7) - length).astype(np.uint32)
    at = (start >> 3) + base
    for j in range(ROW):
        i, v = at[j], shifted[j]
        flat[i] |= (v >> 16).astype(np.uint8)
        flat[i + 1] |= (v >> 8).astype(np.uint8)
        flat[i + 2] |= v.astype(np.uint8)
    bits = end[-1]
    n_bytes = (bits + 7) >> 3
    flat[base + n_bytes - 1] |= ((1 << (n_bytes * 8 - bits)) - 1).astype(np.uint8)
    row_in_picture = np.arange(n) - np.repeat(np.cumsum([0, *heights[:-1]]), heights)
    last = row_in_picture == np.repeat(heights, heights) - 1
    stuffed = (out == 0xFF) & (np.arange(width) < n_bytes[:, None])
    flat[base + n_bytes] = 0xFF
    flat[base + n_bytes + 1] = 0xD0 + row_in_picture % 8
    taken = np.arange(width) < (n_bytes + 2 * ~last)[:, None]
    data, stuff = out[taken], stuffed[taken]
    if stuff.any():
        data = np.insert(data, np.flatnonzero(stuff) + 1, 0)
    row_bytes = taken.sum(axis=1) + stuffed.sum(axis=1)
    ends = np.cumsum(row_bytes)[np.cumsum(heights) - 1]
    data, pictures, before = data.tobytes(), [], 0
    for height, stop in zip(heights, ends.tolist(), strict=True):
        frame = _segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * height, 8 * ROW, 1, 1, 0x11, 0))
        pictures.append(b"".join((HEAD, frame, TAIL, data[before:stop], b"\xff\xd9")))
        before = stop
    return pictures


class MediaError(ValueError):
    """Not a picture that this reader can decode."""


@dataclass
class Scan:
    """What a scan needs for decoding: its components' tables, its blocks and its bytes."""

    components: list[tuple[int, int, int, int]]  # component, blocks in an MCU, DC table, AC table
    interval: int
    n_mcu: int
    data: bytes


@dataclass
class Picture:
    """A parsed baseline picture."""

    width: int = 0
    height: int = 0
    frame: dict[int, tuple[int, int, int]] = field(default_factory=dict)  # component: h, v, quantiser
    quantisers: dict[int, int] = field(default_factory=dict)  # DC step
    tables: dict[tuple[int, int], tuple] = field(default_factory=dict)
    scans: list[Scan] = field(default_factory=list)
    n_bytes: int = 0


def parse(data: bytes) -> list[Picture]:
    """All pictures of a byte string, one after the other, by their markers."""
    pictures, at = [], 0
    while at < len(data):
        p, start = Picture(), at
        if data[at : at + 2] != b"\xff\xd8":
            raise MediaError("no start of image")
        at, interval, tables = at + 2, 0, {}
        while True:
            if at + 2 > len(data) or data[at] != 0xFF:
                raise MediaError("marker expected")
            marker = data[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            if marker == 0xD9:
                at += 2
                break
            if at + 4 > len(data):
                raise MediaError("segment cut short")
            size = struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            try:
                if marker == 0xDB:
                    while body:
                        step = 2 if body[0] >> 4 else 1
                        p.quantisers[body[0] & 15] = int.from_bytes(body[1 : 1 + step], "big")
                        body = body[1 + 64 * step :]
                elif marker in (0xC0, 0xC1):
                    depth, p.height, p.width, n = struct.unpack_from(">BHHB", body)
                    if depth != 8 or not p.height or not p.width:
                        raise MediaError("only 8-bit samples and stated sizes")
                    p.frame = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
                elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    raise MediaError("not baseline")
                elif marker == 0xC4:
                    while body:
                        bits = tuple(body[1:17])
                        tables[body[0] >> 4, body[0] & 15] = bits, tuple(body[17 : 17 + sum(bits)])
                        body = body[17 + sum(bits) :]
                elif marker == 0xDD:
                    interval = struct.unpack(">H", body)[0]
                elif marker == 0xDA:
                    chosen = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
                    stop = at
                    while True:
                        stop = data.find(b"\xff", stop)
                        if stop < 0 or stop + 1 >= len(data):
                            raise MediaError("scan cut short")
                        if data[stop + 1] == 0 or 0xD0 <= data[stop + 1] <= 0xD7:
                            stop += 2
                            continue
                        break
                    h_max, v_max = max(h for h, _, _ in p.frame.values()), max(v for _, v, _ in p.frame.values())
                    if len(chosen) > 1:
                        across, down = -(-p.width // (8 * h_max)), -(-p.height // (8 * v_max))
                        parts = [(c, p.frame[c][0] * p.frame[c][1], d, a) for c, d, a in chosen]
                    else:
                        h, v, _ = p.frame[chosen[0][0]]
                        across, down = -(-(-(-p.width * h // h_max)) // 8), -(-(-(-p.height * v // v_max)) // 8)
                        parts = [(chosen[0][0], 1, *chosen[0][1:])]
                    p.tables |= {(len(p.scans), *k): v for k, v in tables.items()}
                    p.scans.append(Scan(parts, interval or across * down, across * down, data[at:stop]))
                    at = stop
            except (IndexError, struct.error, KeyError, ValueError) as e:
                raise MediaError(str(e)) from e
        p.n_bytes = at - start
        pictures.append(p)
    return pictures


def _intervals(scan: Scan) -> list[bytes]:
    """A scan's restart intervals without markers and stuffing."""
    data = np.frombuffer(scan.data, np.uint8)
    if scan.interval >= scan.n_mcu:
        return [scan.data.replace(b"\xff\x00", b"\xff")]
    marks = np.flatnonzero((data[:-1] == 0xFF) & (data[1:] >= 0xD0) & (data[1:] <= 0xD7))
    parts = [scan.data[a:b] for a, b in zip([0, *(marks + 2).tolist()], [*marks.tolist(), len(data)], strict=True)]
    return [x.replace(b"\xff\x00", b"\xff") for x in parts]


def decode_dc(parts: list[bytes], n_mcu: list[int], components: list[tuple[int, int, int, int]], tables: dict[tuple[int, int], np.ndarray]) -> dict[int, np.ndarray]:
    """DC levels by component, lane by block, of restart intervals that share their tables. AC symbols are walked over."""
    lanes = len(parts)
    stream = np.frombuffer(b"".join(x + b"\0" * 8 for x in parts), np.uint8).astype(np.uint32)
    window = stream[:-3] << 24 | stream[1:-2] << 16 | stream[2:-1] << 8 | stream[3:]
    sizes = np.fromiter((len(x) for x in parts), np.int64, lanes)
    position = (np.cumsum(sizes + 8) - sizes - 8) * 8
    limit = position + sizes * 8
    counts = np.asarray(n_mcu)
    most = int(counts.max())
    out = {c: np.zeros((most * blocks, lanes), np.int32) for c, blocks, _, _ in components}
    predictor = {c: np.zeros(lanes, np.int32) for c, *_ in components}
    half = np.array([0] + [1 << s - 1 for s in range(1, 17)], np.int32)
    everyone = np.arange(lanes)

    def peek(at: np.ndarray) -> np.ndarray:
        return window[at >> 3] >> (16 - (at & 7)).astype(np.uint32) & 0xFFFF

    for mcu in range(most):
        lane = everyone if mcu < counts.min() else np.flatnonzero(counts > mcu)
        for c, blocks, dc, ac in components:
            for b in range(blocks):
                at = position[lane]
                if (at > limit[lane]).any():
                    raise MediaError("interval cut short")
                found = tables[0, dc][peek(at)]
                if not found.all():
                    raise MediaError("no such code")
                at += found & 255
                size = found >> 8
                amplitude = (peek(at) >> (16 - size).astype(np.uint32)).astype(np.int32)
                at += size
                amplitude -= np.where(amplitude < half[size], 2 * half[size] - 1, 0)
                predictor[c][lane] += np.where(size > 0, amplitude, 0)
                out[c][mcu * blocks + b, lane] = predictor[c][lane]
                k, left = np.ones(len(lane), np.int32), np.arange(len(lane))
                while len(left):
                    found = tables[1, ac][peek(at[left])]
                    if not (found & 255).all():
                        raise MediaError("no such code")
                    symbol = found >> 8
                    at[left] += (found & 255) + (symbol & 15)
                    k[left] += (symbol >> 4) + 1
                    left = left[((symbol != 0) & (k[left] < 64))]
                    if len(left) and (at[left] > limit[lane[left]]).any():
                        raise MediaError("interval cut short")
                position[lane] = at
    return {c: np.ascontiguousarray(x.T) for c, x in out.items()}


def thumbnails(pictures: list[Picture]) -> list[np.ndarray]:
    """Each picture's DC-only luminance thumbnail: a pixel for each 8x8 block of its first component.

    Pictures whose scans have equal tables and layout are decoded together.
    """
    groups: dict = {}
    for i, p in enumerate(pictures):
        if not p.frame or not p.scans:
            raise MediaError("no frame or scan")
        first = next(iter(p.frame))
        k = next((k for k, s in enumerate(p.scans) if first in (c[0] for c in s.components)), None)
        if k is None:
            raise MediaError("no luminance scan")
        tables = tuple(sorted((kind, n, v) for (scan, kind, n), v in p.tables.items() if scan == k))
        groups.setdefault((tuple(p.scans[k].components), tables), []).append((i, first, k))
    out: list = [None] * len(pictures)
    for (components, tables), members in groups.items():
        parts, counts, shape = [], [], []
        for i, first, k in members:
            scan = pictures[i].scans[k]
            own = _intervals(scan)
            expected = [min(scan.interval, scan.n_mcu - a) for a in range(0, scan.n_mcu, scan.interval)]
            if len(own) != len(expected):
                raise MediaError("restart markers missing")
            shape.append((i, first, len(own), expected))
            parts += own
            counts += expected
        try:
            levels = decode_dc(parts, counts, list(components), {(kind, n): _lookup(*v) for kind, n, v in tables})
        except (KeyError, IndexError) as e:
            raise MediaError(f"damaged scan: {e}") from e
        at = 0
        for i, first, n, expected in shape:
            p = pictures[i]
            h, v, q = p.frame[first]
            per = next(c[1] for c in components if c[0] == first)
            own = levels[first][at : at + n]
            flat = own.reshape(-1) if len(set(expected)) == 1 else np.concatenate([own[j, : e * per] for j, e in enumerate(expected)])
            at += n
            if per > 1:  # blocks of an MCU are a small rectangle
                across = -(-p.width // (8 * max(x[0] for x in p.frame.values())))
                grid = flat.reshape(-1, across, v, h).swapaxes(1, 2).reshape(-1, across * h)
            else:
                wide = -(-(-(-p.width * h // max(x[0] for x in p.frame.values()))) // 8)
                grid = flat.reshape(-1, wide)
            out[i] = np.clip(np.floor(grid * p.quantisers[q] / 8 + 128.5), 0, 255).astype(np.uint8)
    return out


def thumbnail_hash(pixels: np.ndarray) -> str:
    """64 bits as hex: which of 8x8 areas of a thumbnail are lighter than their mean."""
    h, w = pixels.shape
    edges = lambda n: np.minimum(np.arange(8) * n // 8, n - 1)
    sums = np.add.reduceat(np.add.reduceat(pixels.astype(np.int64), edges(h), axis=0), edges(w), axis=1)
    size = lambda n: np.maximum(np.diff(np.append(edges(n), n)), 1)
    means = sums / np.outer(size(h), size(w))
    return np.packbits(means > means.mean()).tobytes().hex()


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Groups of (text, rows of a picture); a text's pictures follow one another."""
    group, held = [], 0
    for i in range(len(offsets) - 1):
        raw = data[offsets[i] : offsets[i + 1]]
        n = max(1, -(-len(raw) // ROW))
        for a in range(0, n, MAX_ROWS):
            part = raw[a * ROW : (a + MAX_ROWS) * ROW]
            rows = np.zeros((min(n - a, MAX_ROWS), ROW), np.uint8)
            rows.reshape(-1)[: len(part)] = part
            group.append((i, rows))
            held += rows.size
            if held >= GROUP_BYTES:
                yield group
                group, held = [], 0
    if group:
        yield group


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's UTF-8 bytes, padded with zero bytes to a positive multiple of 64, as JPEG pictures in column media.

    Null text: empty. Repeated rows stay; other columns are ignored; an empty table gives an empty table.
    Returns doc_id, n_bytes (unpadded), media.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = byte_view(b.column(1))
            media: list[list[bytes]] = [[] for _ in range(len(b))]
            for group in _pieces(data, offsets):
                for (i, _), picture in zip(group, encode_rows(np.concatenate([r for _, r in group]), [len(r) for _, r in group]), strict=True):
                    media[i].append(picture)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets)), pa.array([b"".join(m) for m in media], pa.binary())], ["doc_id", "n_bytes", "media"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, media binary")


def read_media(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Dimensions, DC-only thumbnail and thumbnail hash of a binary column of baseline JPEGs (or several in a row).

    A null or undecodable value gives nulls and the reason in error, and never fails the others.
    Returns id, n_pictures, width, height (of the first picture), thumbnail (all pictures' pixels), thumbnail_hash, error.
    """
    rows = pick(df, doc_id=id_col, media=media_col)

    def one(media: bytes | None) -> tuple:
        if not media:
            return None, None, None, None, None, "no media"
        try:
            pictures = parse(media)
            pixels = thumbnails(pictures)
        except MediaError as e:
            return None, None, None, None, None, str(e)
        return len(pictures), pictures[0].width, pictures[0].height, b"".join(x.tobytes() for x in pixels), "-".join(map(thumbnail_hash, pixels)), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [one(m.as_py()) for m in b.column(1)]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds))], ["doc_id", "n_pictures", "width", "height", "thumbnail", "thumbnail_hash", "error"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_pictures int, width int, height int, thumbnail binary, thumbnail_hash string, error string")


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as store() does, read the stored bytes back, and return digests of both and the picture's features.

    Pictures are made, read and hashed group by group, so a text of any length needs a few MB beside itself.
    Null text: empty. Equal texts have equal values. Repeated rows stay; empty table: empty.
    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature (the
    pictures' dimensions and thumbnail hashes).
    """
    rows = pick(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = byte_view(b.column(1))
            n = len(b)
            payload, media = [hashlib.sha256() for _ in range(n)], [hashlib.sha256() for _ in range(n)]
            payload_bytes, media_bytes, tail, feature = [0] * n, [0] * n, [0] * n, [[] for _ in range(n)]
            for group in _pieces(data, offsets):
                stored = encode_rows(np.concatenate([r for _, r in group]), [len(r) for _, r in group])
                pictures = [parse(x)[0] for x in stored]
                for (i, _), raw, picture, pixels in zip(group, stored, pictures, thumbnails(pictures), strict=True):
                    back = pixels.tobytes()
                    payload[i].update(back)
                    media[i].update(raw)
                    payload_bytes[i] += len(back)
                    media_bytes[i] += len(raw)
                    tail[i] = zlib.crc32(back[-64:])
                    feature[i].append(f"{picture.width}x{picture.height}:{thumbnail_hash(pixels)}")
            columns = [pa.array(np.diff(offsets)), pa.array(payload_bytes, pa.int64()), pa.array([h.hexdigest() for h in payload], pa.string()), pa.array(tail, pa.int64()), pa.array(media_bytes, pa.int64()), pa.array([h.hexdigest() for h in media], pa.string()), pa.array(["-".join(f) for f in feature], pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
