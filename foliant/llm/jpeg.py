"""Payload columns in baseline JPEG, and thumbnails from DC coefficients alone.

Stored form: a payload is cut into frames of at most 341 * 576 bytes, and each frame is a complete
baseline JPEG with one component, 24 blocks wide.  A byte b is one block whose quantised DC
coefficient is b - 128 with a quantiser of 8 and whose AC coefficients are zero, so the block's
mean sample is b and the DC-only luminance thumbnail is the payload.  A restart marker follows
each 576 blocks.

Reading parses markers and tables, undoes byte stuffing, and Huffman-decodes the scans.  Intervals
between restarts are lanes of numpy arrays: a table over 16 bits gives a whole block (DC code,
amplitude, end-of-block code) in one look.  Scans with AC coefficients, several components or
subsampling take the general symbol-by-symbol decoder.

Cases: a null text counts as empty and its payload is 576 filling bytes; texts of any length are
stored in whole; repeated rows and equal texts give equal values, so ties do not arise; a null id stays
null; an empty table gives no rows; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import column_values, map_arrow, slabs, text_bytes

UNIT = 576
ACROSS = 24
FRAME_UNITS = 341
SLAB_BYTES = 6 << 20
FILL = b"\xff"

#: Code lengths of the DC size categories 0 to 8, which byte differences need.
DC_LENGTHS = [3, 4, 4, 3, 3, 3, 3, 3, 4]
END_OF_SCAN = re.compile(rb"\xff[^\x00\xd0-\xd7]", re.S)
RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def canonical_codes(counts: list[int], symbols: list[int]) -> list[tuple[int, int, int]]:
    """(code, length, symbol) by the standard's rule: rising codes, doubled at each new length."""
    out, code, k = [], 0, 0
    for length, count in enumerate(counts, 1):
        for symbol in symbols[k : k + count]:
            out.append((code, length, symbol))
            code += 1
        k += count
        code <<= 1
    return out


DC_SYMBOLS = sorted(range(len(DC_LENGTHS)), key=lambda s: (DC_LENGTHS[s], s))
DC_COUNTS = [DC_LENGTHS.count(n) for n in range(1, 17)]
DC_CODES = {s: c for c, _, s in canonical_codes(DC_COUNTS, DC_SYMBOLS)}


def marker(code: int, body: bytes) -> bytes:
    return bytes([0xFF, code]) + (len(body) + 2).to_bytes(2, "big") + body


def header(rows: int) -> bytes:
    """All that precedes the scan of a frame with so many rows of blocks."""
    quantiser = bytes([0]) + bytes([8]) + bytes([1]) * 63
    size = bytes([8]) + (rows * 8).to_bytes(2, "big") + (ACROSS * 8).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])
    dc = bytes([0x00, *DC_COUNTS, *DC_SYMBOLS])
    ac = bytes([0x10, 1, *[0] * 15, 0x00])
    return b"\xff\xd8" + marker(0xDB, quantiser) + marker(0xC0, size) + marker(0xC4, dc) + marker(0xC4, ac) + marker(0xDD, UNIT.to_bytes(2, "big")) + marker(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))


def encode_units(values: np.ndarray) -> list[bytes]:
    """The entropy-coded bytes, stuffed, of each row of `values`."""
    lanes = values.T.astype(np.int16) - 128
    change = lanes.copy()
    change[1:] -= lanes[:-1]
    category = np.zeros(512, np.int64)
    category[1:] = np.floor(np.log2(np.arange(1, 512))).astype(np.int64) + 1
    diffs = np.arange(-511, 512)
    kind = category[np.abs(diffs)]
    kind[kind > 8] = 8
    amplitude = np.where(diffs >= 0, diffs, diffs + (1 << kind) - 1)
    length = np.array(DC_LENGTHS)[kind] + kind + 1
    code = (np.array([DC_CODES[k] for k in range(9)])[kind] << (kind + 1)) | (amplitude << 1)
    count = lanes.shape[1]
    room = UNIT * 2 + 4
    out = np.zeros(count * room, np.uint8)
    base, at = np.arange(count, dtype=np.int64) * room, np.zeros(count, np.int64)
    for row in change:
        look = row.astype(np.int64) + 511
        bits = length[look]
        value = code[look] << (24 - bits - (at & 7))
        place = base + (at >> 3)
        out[place] |= (value >> 16).astype(np.uint8)
        out[place + 1] |= (value >> 8 & 255).astype(np.uint8)
        out[place + 2] |= (value & 255).astype(np.uint8)
        at += bits
    out[base + (at >> 3)] |= np.where(at & 7, (1 << (8 - (at & 7))) - 1, 0).astype(np.uint8)  # ones up to the whole byte
    raw, ends = out.tobytes(), ((at + 7) >> 3).tolist()
    return [raw[k * room : k * room + e].replace(b"\xff", b"\xff\x00") for k, e in enumerate(ends)]


def encode(payloads: list[bytes]) -> list[bytes]:
    """The stored form of each payload, whose lengths are positive multiples of UNIT."""
    units = encode_units(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, UNIT))
    out, at = [], 0
    for payload in payloads:
        frames, count = [], len(payload) // UNIT
        for first in range(0, count, FRAME_UNITS):
            own = units[at + first : at + min(count, first + FRAME_UNITS)]
            scan = b"".join(u + bytes([0xFF, 0xD0 + k % 8]) for k, u in enumerate(own[:-1])) + own[-1]
            frames.append(header(len(own) * UNIT // ACROSS) + scan + b"\xff\xd9")
        at += count
        out.append(b"".join(frames))
    return out


@dataclass
class Frame:
    """A parsed baseline JPEG; intervals are the unstuffed scan bytes between restarts."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, horizontal, vertical, quantiser
    quantisers: dict[int, int] = field(default_factory=dict)  # the DC entry of each table
    tables: dict[int, tuple] = field(default_factory=dict)  # class * 16 + id: counts and symbols
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # component, DC table, AC table
    restart: int = 0
    intervals: list[bytes] = field(default_factory=list)


def parse(media: bytes) -> list[Frame]:
    """All frames of a stored value; a value that isn't baseline JPEG is an error."""
    frames, at = [], 0
    while at < len(media):
        if media[at : at + 2] != b"\xff\xd8":
            raise ValueError(f"no start of image at byte {at}")
        frame, at = Frame(), at + 2
        while media[at + 1] != 0xD9:
            if media[at] != 0xFF:
                raise ValueError(f"no marker at byte {at}")
            code, size = media[at + 1], int.from_bytes(media[at + 2 : at + 4], "big")
            body, at = media[at + 4 : at + 2 + size], at + 2 + size
            if code == 0xDB:
                while body:
                    wide = body[0] >> 4
                    frame.quantisers[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                    body = body[1 + 64 * (1 + wide) :]
            elif code == 0xC4:
                while body:
                    counts = tuple(body[1:17])
                    frame.tables[body[0]] = (counts, tuple(body[17 : 17 + sum(counts)]))
                    body = body[17 + sum(counts) :]
            elif code == 0xC0:
                frame.height, frame.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                frame.components = [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]
            elif code in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
                raise ValueError("not a baseline JPEG")
            elif code == 0xDD:
                frame.restart = int.from_bytes(body[:2], "big")
            elif code == 0xDA:
                frame.scan = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
                end = END_OF_SCAN.search(media, at).start()
                frame.intervals = [p.replace(b"\xff\x00", b"\xff") for p in RESTART.split(media[at:end])]
                at = end
        frames.append(frame)
        at += 2
    return frames


_BLOCKS: dict[tuple, np.ndarray] = {}
SLOW = -1


def block_table(dc: tuple, ac: tuple) -> np.ndarray:
    """For each 16 bits: 32 * (difference + 4096) + bits of a block that is a DC code, its amplitude and an end of block; SLOW otherwise."""
    if (dc, ac) not in _BLOCKS:
        table = np.full(1 << 16, SLOW, np.int64)
        ends = [(c, n) for c, n, s in canonical_codes(list(ac[0]), list(ac[1])) if s == 0]
        for code, length, size in canonical_codes(list(dc[0]), list(dc[1])):
            for end, end_length in ends:
                bits = length + size + end_length
                if bits > 16:
                    continue
                for amplitude in range(1 << size):
                    value = amplitude if size == 0 or amplitude >> (size - 1) else amplitude - (1 << size) + 1
                    first = ((code << size | amplitude) << end_length | end) << (16 - bits)
                    table[first : first + (1 << (16 - bits))] = 32 * (value + 4096) + bits
        _BLOCKS[dc, ac] = table
    return _BLOCKS[dc, ac]


def decode_lanes(intervals: list[bytes], table: np.ndarray, blocks: int) -> np.ndarray | None:
    """DC values of `blocks` blocks in each interval; None if a block has AC coefficients."""
    lengths = np.fromiter(map(len, intervals), np.int64, len(intervals))
    data = np.frombuffer(b"".join(i + FILL * 4 for i in intervals), np.uint8).astype(np.int32)
    window = np.zeros(len(data), np.int32)
    window[:-2] = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    at = 8 * (np.cumsum(lengths + 4) - lengths - 4)
    value, out = np.zeros(len(intervals), np.int64), np.empty((blocks, len(intervals)), np.int16)
    last = 8 * (len(data) - 3)
    for row in out:
        found = table[window[at >> 3] >> (8 - (at & 7)) & 0xFFFF]
        if found.min() < 0:
            return None
        at = np.minimum(at + (found & 31), last)
        value += (found >> 5) - 4096
        row[:] = value
    return out.T


def decode_general(frame: Frame) -> np.ndarray:
    """The luminance DC values of a frame in rows of blocks, symbol by symbol."""
    most_h, most_v = max(c[1] for c in frame.components), max(c[2] for c in frame.components)
    single = len(frame.scan) == 1
    by_id = {c[0]: c for c in frame.components}
    first = frame.components[0]
    across, down = (-(-frame.width // (8 * most_h)), -(-frame.height // (8 * most_v)))
    if single:
        across, down = -(-frame.width // 8), -(-frame.height // 8)
    grid = np.zeros((down * (1 if single else first[2]), across * (1 if single else first[1])), np.int32)
    look = {k: {(n, c): s for c, n, s in canonical_codes(list(v[0]), list(v[1]))} for k, v in frame.tables.items()}
    unit = 0
    for interval in frame.intervals:
        bits, at, size = int.from_bytes(interval, "big"), 0, 8 * len(interval)

        def take(n: int) -> int:
            nonlocal at
            at += n
            return bits >> (size - at) & ((1 << n) - 1) if at <= size else (1 << n) - 1

        def symbol(table: dict) -> int:
            code = 0
            for n in range(1, 17):
                code = code << 1 | take(1)
                if (n, code) in table:
                    return table[n, code]
            raise ValueError("bad Huffman code")

        before = dict.fromkeys(by_id, 0)
        for _ in range(min(frame.restart or across * down, across * down - unit)):
            for component, dc, ac in frame.scan:
                _, h, v, _ = by_id[component]
                for part in range(1 if single else h * v):
                    n = symbol(look[dc])
                    raw = take(n)
                    before[component] += raw if n == 0 or raw >> (n - 1) else raw - (1 << n) + 1
                    if component == first[0]:
                        y, x = divmod(unit, across)
                        if single:
                            grid[y, x] = before[component]
                        else:
                            grid[y * v + part // h, x * h + part % h] = before[component]
                    k = 1
                    while k < 64:
                        s = symbol(look[16 + ac])
                        if s == 0:
                            break
                        take(s & 15)
                        k += 1 + (s >> 4)
            unit += 1
    return grid


def thumbnails(media: list[bytes]) -> list[list[np.ndarray]]:
    """The DC-only luminance thumbnails (8-bit, one sample a block) of the frames of each stored value."""
    parsed = [parse(m) for m in media]
    simple: dict[tuple, list[tuple[Frame, bytes, int]]] = {}
    values: dict[int, list] = {}
    general = set()
    for frames in parsed:
        for f in frames:
            blocks = -(-f.width // 8) * -(-f.height // 8)
            if len(f.components) == 1 and len(f.scan) == 1 and f.restart and blocks % f.restart == 0 and len(f.intervals) == blocks // f.restart:
                key = (f.tables[f.scan[0][1]], f.tables[16 + f.scan[0][2]], f.restart)
                simple.setdefault(key, []).extend((f, i, n) for n, i in enumerate(f.intervals))
            else:
                general.add(id(f))
    for (dc, ac, restart), lanes in simple.items():
        found = decode_lanes([i for _, i, _ in lanes], block_table(dc, ac), restart)
        for k, (f, _, n) in enumerate(lanes):
            if found is None:
                general.add(id(f))
            else:
                values.setdefault(id(f), [None] * len(f.intervals))[n] = found[k]
    out = []
    for frames in parsed:
        own = []
        for f in frames:
            grid = decode_general(f) if id(f) in general else np.concatenate(values[id(f)]).reshape(-1, -(-f.width // 8))
            own.append(np.clip(np.rint(grid * f.quantisers[f.components[0][3]] / 8).astype(np.int32) + 128, 0, 255).astype(np.uint8))
        out.append(own)
    return out


def thumbnail_hash(thumbnail: np.ndarray) -> str:
    """16 hexadecimal digits: whether each cell of an 8 by 8 grid is above the mean."""
    rows = np.linspace(0, thumbnail.shape[0], 9).astype(int)
    columns = np.linspace(0, thumbnail.shape[1], 9).astype(int)
    sums = np.zeros((thumbnail.shape[0] + 1, thumbnail.shape[1] + 1), np.int64)
    sums[1:, 1:] = thumbnail.astype(np.int64).cumsum(0).cumsum(1)
    cells = np.diff(np.diff(sums[np.ix_(rows, columns)], axis=0), axis=1)
    area = np.outer(np.diff(rows), np.diff(columns))
    above = cells * thumbnail.size > area * int(sums[-1, -1])
    return np.packbits(above.reshape(-1)).tobytes().hex()


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n_bytes and media (the stored form) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), column_values(batch, "_text")
            for a, b in slabs(texts, SLAB_BYTES):
                payloads = [t + FILL * (-len(t) % UNIT if t else UNIT) for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(map(len, texts[a:b]), pa.int64()), pa.array(encode(payloads), pa.binary())], [id_col, "n_bytes", "media"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias(id_col), text_bytes(text_col).alias("_text")), f"{id_col} long, n_bytes long, media binary", run)


def read_back(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What the stored form (n_bytes, media) holds: digests of payload and form, dimensions and thumbnail hash of the frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            media, n_bytes = column_values(batch, "media"), column_values(batch, "n_bytes")
            rows = []
            for a, b in slabs(media, SLAB_BYTES):
                for value, frames, size in zip(media[a:b], thumbnails(media[a:b]), n_bytes[a:b]):
                    whole = np.concatenate(frames)
                    payload = whole.tobytes()
                    feature = f"{whole.shape[1] * 8}x{whole.shape[0] * 8}/{len(frames)}:{thumbnail_hash(whole)}"
                    rows.append((size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(value), hashlib.sha256(value).hexdigest(), feature))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], [id_col, *COLUMNS])

    return map_arrow(stored.select(id_col, "n_bytes", "media"), f"{id_col} long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", run)


COLUMNS = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
