"""AVI motion-JPEG columns: write and read RIFF files, decode intra frames, detect shots.

``read_avi`` parses the RIFF tree and its idx1 index; ``decode_frames`` decodes baseline JPEG frames
with one scan, all frames of a kind side by side: each step reads one symbol of every frame.
``find_shots`` cuts where the histogram difference of neighbouring frames stands out from its
surroundings. Texts are carried losslessly in the quantised coefficients, the unit in which JPEG
stores a picture exactly: each frame holds whole 8x8 blocks of three components, that is 192 bytes
for a column of blocks.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.llm.naming import quoted

UNIT = 192
COLUMNS, ROWS = 4, 2
MCUS = COLUMNS * ROWS
FPS = 10
BATCH = 4096
BINS = 16
#: Frames that are decoded together.
SIDE_BY_SIDE = 2048

ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8, 0) if (i // 8 + i % 8) % 2 else (i % 8, 0))))
DCT = np.array([[(0.5 if u else np.sqrt(0.125)) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)], np.float32)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, symbols: dict[int, int]) -> bytes:
    """A DHT segment for {symbol: code length}, symbols of a length in the given order."""
    lengths = list(symbols.values())
    return _segment(0xC4, bytes([kind]) + bytes(lengths.count(n) for n in range(1, 17)) + bytes(sorted(symbols, key=lambda s: symbols[s])))


#: A DC difference of c bits has a code of 16 - c bits; an AC value always has 8 bits and a code of 8.
HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, b"\0" + b"\1" * 64)
    + _segment(0xC0, struct.pack(">BHHB", 8, ROWS * 8, COLUMNS * 8, 3) + bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0]))
    + _table(0x00, {c: 16 - c for c in range(8, -1, -1)})
    + _table(0x10, {0x08: 8})
    + _segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
)


def _dc_words() -> np.ndarray:
    """The word of each difference from -255."""
    words, code = np.zeros(511, np.uint16), 0
    for c in range(8, -1, -1):
        for d in range(-255, 256):
            if abs(d).bit_length() == c:
                words[d + 255] = code << c | (d if d > 0 else d + (1 << c) - 1)
        code = (code + 1) << 1
    return words


DC_WORD = _dc_words()


def text_frames(payload: bytes) -> list[bytes]:
    """JPEG frames that hold the payload in their coefficients, the last one filled with spaces."""
    size = MCUS * UNIT
    frames = []
    for at in range(0, len(payload), BATCH * size):
        part = payload[at : at + BATCH * size]
        part += b" " * (-len(part) % size)
        x = np.frombuffer(part, np.uint8).reshape(-1, MCUS, 3, 64)
        dc = np.diff(x[..., 0].astype(np.int16) - 128, axis=1, prepend=np.int16(0))
        out = np.zeros((*x.shape, 2), np.uint8)
        out[..., 1] = x
        word = DC_WORD[dc + 255]
        out[..., 0, 0], out[..., 0, 1] = word >> 8, word & 255
        scan = out.tobytes()
        step = size * 2
        frames += [HEAD + scan[i : i + step].replace(b"\xff", b"\xff\0") + b"\xff\xd9" for i in range(0, len(scan), step)]
    return frames


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _list(name: bytes, kind: bytes, *parts: bytes) -> bytes:
    body = kind + b"".join(parts)
    return name + struct.pack("<I", len(body)) + body


def write_avi(frames: list[bytes], width: int, height: int, fps: int = FPS, note: str = "") -> bytes:
    """An AVI file of JPEG frames with an idx1 index. RIFF sizes are 32-bit; larger input is refused."""
    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    chunks = [_chunk(b"00dc", f) for f in frames]
    at, index = 4, []
    for f, c in zip(frames, chunks, strict=True):
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(c)
    parts = [
        _list(b"LIST", b"hdrl", _chunk(b"avih", avih), _list(b"LIST", b"strl", _chunk(b"strh", strh), _chunk(b"strf", strf))),
        _list(b"LIST", b"INFO", _chunk(b"ICMT", note.encode() + b"\0")),
        _list(b"LIST", b"movi", *chunks),
        _chunk(b"idx1", b"".join(index)),
    ]
    if sum(map(len, parts)) + 4 >= 1 << 32:
        raise ValueError("over the 32-bit sizes of RIFF")
    return _list(b"RIFF", b"AVI ", *parts)


@dataclass
class Avi:
    width: int = 0
    height: int = 0
    fps: float = 0.0
    note: str = ""
    frames: list[bytes] = field(default_factory=list)


def read_avi(data: bytes) -> Avi:
    """Parse the RIFF tree; frames come from the idx1 index, or in file order where there is none."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    avi, movi, index, plain = Avi(), 0, b"", []

    def walk(at: int, end: int, inside: bytes) -> None:
        nonlocal movi, index
        while at + 8 <= end:
            name, (size,) = data[at : at + 4], struct.unpack_from("<I", data, at + 4)
            body = at + 8
            if name == b"LIST":
                kind = data[body : body + 4]
                if kind == b"movi":
                    movi = body
                walk(body + 4, min(end, body + size), kind)
            elif name == b"avih":
                micros, avi.width, avi.height = struct.unpack_from("<I", data, body)[0], *struct.unpack_from("<II", data, body + 32)
                avi.fps = avi.fps or (1e6 / micros if micros else 0.0)
            elif name == b"strh" and data[body : body + 4] == b"vids":
                scale, rate = struct.unpack_from("<II", data, body + 20)
                avi.fps = rate / scale if scale else avi.fps
            elif name == b"ICMT":
                avi.note = data[body : body + size].rstrip(b"\0").decode()
            elif name == b"idx1":
                index = data[body : body + size]
            elif inside in (b"movi", b"rec ") and name[2:] in (b"dc", b"db"):
                plain.append((body, size))
            at = body + size + size % 2

    walk(12, len(data), b"AVI ")
    if index:
        found = [x for x in struct.iter_unpack("<4sIII", index[: len(index) // 16 * 16]) if x[0][2:] in (b"dc", b"db")]
        base = movi if found and data[movi + found[0][2] : movi + found[0][2] + 4] == found[0][0] else 0
        plain = [(base + at + 8, size) for _, _, at, size in found]
    avi.frames = [data[at : at + size] for at, size in plain]
    return avi


def carried(coefficients: np.ndarray) -> bytes:
    """The bytes that ``text_frames`` put into the coefficients."""
    x = coefficients + np.where(coefficients < 0, 255, 0)
    x[..., 0] = coefficients[..., 0] + 128
    return x.astype(np.uint8).tobytes()


def pictures(blocks: np.ndarray) -> np.ndarray:
    """Samples (..., 8, 8) of dequantised zigzag blocks (..., 64)."""
    plane = np.empty(blocks.shape, np.float32)
    plane[..., ZIGZAG] = blocks
    plane = plane.reshape(*blocks.shape[:-1], 8, 8)
    half = np.swapaxes((plane.reshape(-1, 8) @ DCT).reshape(-1, 8, 8), 1, 2)
    full = np.swapaxes((half.reshape(-1, 8) @ DCT).reshape(-1, 8, 8), 1, 2)
    return np.clip(np.rint(full + 128), 0, 255).astype(np.uint8).reshape(plane.shape)


@dataclass
class Part:
    """A component of a frame: its sampling, quantiser and code tables."""

    name: int
    across: int
    down: int
    quant: int
    dc: int = 0
    ac: int = 0


@dataclass
class Layout:
    """What a frame's segments say before its scan."""

    head: bytes = b""
    width: int = 0
    height: int = 0
    restart: int = 0
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    codes: dict[int, np.ndarray] = field(default_factory=dict)
    parts: list[Part] = field(default_factory=list)


def code_table(body: bytes) -> tuple[np.ndarray, int]:
    """(length << 8 | symbol for each 16 bits that start with a code, bytes read); 0 where none does."""
    table, code, at = np.zeros(1 << 16, np.int32), 0, 16
    for n in range(1, 17):
        for _ in range(body[n - 1]):
            first = code << (16 - n)
            table[first : first + (1 << (16 - n))] = n << 8 | body[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table, at


def read_layout(data: bytes) -> Layout:
    """The segments of a baseline frame up to its scan."""
    found, at = Layout(), 2
    while at + 4 <= len(data):
        marker, (size,) = data[at + 1], struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                found.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                found.codes[body[0]], used = code_table(body[1:])
                body = body[1 + used :]
        elif marker in (0xC0, 0xC1):
            found.height, found.width = struct.unpack_from(">HH", body, 1)
            found.parts = [Part(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
        elif marker == 0xDD:
            (found.restart,) = struct.unpack(">H", body)
        elif marker == 0xDA:
            for i in range(1, 1 + 2 * body[0], 2):
                part = next(p for p in found.parts if p.name == body[i])
                part.dc, part.ac = body[i + 1] >> 4, 0x10 | body[i + 1] & 15
            found.head = data[:at]
            return found
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("only baseline frames are intra frames of motion JPEG")
    raise ValueError("a frame without a scan")


#: Bytes after a scan that may be looked at before it is found to have ended.
SPARE = 8


class Bits:
    """The scans of frames, read at a place of its own in each."""

    def __init__(self, scans: list[bytes]) -> None:
        sizes = np.array([len(x) for x in scans])
        data = np.frombuffer(b"".join(x + b"\0" * SPARE for x in scans), np.uint8).astype(np.uint32)
        self.windows = data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]
        self.start = (np.cumsum(sizes + SPARE) - sizes - SPARE) * 8
        self.end = self.start + sizes * 8
        self.at = self.start.copy()

    def ahead(self, rows) -> np.ndarray:
        """The next 16 bits of the frames ``rows``."""
        at = self.at[rows]
        return (self.windows[at >> 3] >> (8 - (at & 7)).astype(np.uint32)) & np.uint32(0xFFFF)

    def symbol(self, table: np.ndarray, rows) -> np.ndarray:
        found = table[self.ahead(rows)]
        self.at[rows] += found >> 8
        # a bad code reads nothing, and a frame that ran out stands still
        if not found.all() or (self.at > self.end).any():
            raise ValueError("a scan with a bad code, or one that ends early")
        return found & 255

    def value(self, n: np.ndarray, rows) -> np.ndarray:
        """Signed numbers of ``n`` bits: those that start with 0 are negative."""
        x = (self.ahead(rows) >> (16 - n).astype(np.uint32)).astype(np.int32)
        self.at[rows] += n
        return x - np.where(x < HALF[n], FULL[n], 0)

    def skip_marker(self) -> None:
        self.at = self.start + (self.at - self.start + 7) // 8 * 8 + 16


HALF = np.array([0, *(1 << n for n in range(16))], np.int32)
FULL = np.array([(1 << n) - 1 for n in range(17)], np.int32)
SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7]")


def decode_scans(layout: Layout, frames: list[bytes]) -> list[np.ndarray]:
    """Quantised zigzag blocks (frame, row, column, 64) per component, of frames with one layout."""
    scans = []
    for f in frames:
        end = SCAN_END.search(f, len(layout.head))
        scans.append(f[len(layout.head) : end.start() if end else len(f)].replace(b"\xff\0", b"\xff"))
    bits, n = Bits(scans), len(frames)
    wide, high = max(p.across for p in layout.parts), max(p.down for p in layout.parts)
    across, down = -(-layout.width // (8 * wide)), -(-layout.height // (8 * high))
    blocks = [np.zeros((n, down * p.down, across * p.across, 64), np.int32) for p in layout.parts]
    last = [np.zeros(n, np.int32) for _ in layout.parts]
    every = np.arange(n)
    for mcu in range(across * down):
        if layout.restart and mcu and mcu % layout.restart == 0:
            bits.skip_marker()
            last = [np.zeros(n, np.int32) for _ in layout.parts]
        for c, p in enumerate(layout.parts):
            dc, ac = layout.codes[p.dc], layout.codes[p.ac]
            for y in range(p.down):
                for x in range(p.across):
                    block = blocks[c][:, mcu // across * p.down + y, mcu % across * p.across + x]
                    last[c] = last[c] + bits.value(bits.symbol(dc, every), every)
                    block[:, 0] = last[c]
                    k, rows = np.ones(n, np.int64), every
                    while len(rows):
                        said = bits.symbol(ac, rows)
                        size, here = said & 15, k + (said >> 4)
                        ended = (size == 0) & (said != 0xF0)
                        if (here[~ended] > 63).any():
                            raise ValueError("more than 64 coefficients")
                        here[ended] = 63
                        v = bits.value(size, rows)
                        set_ = size > 0
                        block[rows[set_], here[set_]] = v[set_]
                        k, going = here + 1, here < 63
                        if not going.all():
                            k, rows = k[going], rows[going]
    return blocks


def decode_frames(frames: list[bytes]) -> Iterator[tuple[Layout, list[np.ndarray]]]:
    """(layout, blocks per component) of the frames in order; neighbours of one layout come together."""
    at = 0
    while at < len(frames):
        layout, end = read_layout(frames[at]), at + 1
        while end < min(len(frames), at + SIDE_BY_SIDE) and frames[end].startswith(layout.head):
            end += 1
        yield layout, decode_scans(layout, frames[at:end])
        at = end


def planes(layout: Layout, blocks: list[np.ndarray], component: int) -> np.ndarray:
    """Samples (frame, height, width) of a component, in the frame's size."""
    p, found = layout.parts[component], blocks[component]
    shown = pictures(found * layout.quant[p.quant]).swapaxes(2, 3)
    shown = shown.reshape(len(found), found.shape[1] * 8, found.shape[2] * 8)
    shown = shown.repeat(max(x.down for x in layout.parts) // p.down, 1).repeat(max(x.across for x in layout.parts) // p.across, 2)
    return shown[:, : layout.height, : layout.width]


def frame_facts(frames: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """(bytes that each frame's coefficients carry, shares of the luma bins per frame)."""
    payloads, shares = [], []
    for layout, blocks in decode_frames(frames):
        luma = (planes(layout, blocks, 0) * (BINS / 256)).astype(np.int64).reshape(len(blocks[0]), -1)
        flat = (luma + np.arange(len(luma))[:, None] * BINS).ravel()
        shares.append(np.bincount(flat, minlength=len(luma) * BINS).reshape(-1, BINS) / luma.shape[1])
        alike = len({b.shape for b in blocks}) == 1  # as in frames that carry bytes
        payloads += [carried(np.stack([b[i].reshape(-1, 64) for b in blocks], axis=1)) if alike else b"" for i in range(len(luma))]
    return payloads, np.concatenate(shares) if shares else np.zeros((0, BINS))


def find_shots(histograms: np.ndarray, window: int = 8, factor: float = 3.0, floor: float = 0.25) -> list[tuple[int, int]]:
    """[first, end) frames of each shot: cuts are differences that stand out from their window."""
    n = len(histograms)
    if n < 2:
        return [(0, n)] if n else []
    d = np.abs(np.diff(histograms, axis=0)).sum(axis=1)
    s1, s2 = np.r_[0, np.cumsum(d)], np.r_[0, np.cumsum(d * d)]
    i = np.arange(n - 1)
    lo, hi = np.maximum(0, i - window), np.minimum(n - 1, i + window + 1)
    k = np.maximum(hi - lo - 1, 1)
    mean = (s1[hi] - s1[lo] - d) / k
    spread = np.sqrt(np.maximum((s2[hi] - s2[lo] - d * d) / k - mean * mean, 0))
    cuts = np.flatnonzero((d > floor) & (d > mean + factor * spread)) + 1
    edges = [0, *cuts.tolist(), n]
    return list(zip(edges, edges[1:], strict=False))


def text_media(text: str | None) -> bytes:
    """The AVI file of a text, padded with spaces to a positive multiple of 192 bytes."""
    raw = (text or "").encode()
    payload = raw + b" " * (-len(raw) % UNIT or UNIT * (not raw))
    return write_avi(text_frames(payload), COLUMNS * 8, ROWS * 8, note=f"payload={len(payload)} text={len(raw)}")


def note_value(avi: Avi, name: str) -> int:
    return int(dict(x.split("=") for x in avi.note.split())[name])


def media_payload(avi: Avi) -> bytes:
    """The payload, read back from the stored frames."""
    return b"".join(frame_facts(avi.frames)[0])[: note_value(avi, "payload")]


def clips_of(shares: np.ndarray, fps: float) -> list[dict]:
    """Timed clips of frames with these luma shares."""
    rate = fps or 1.0
    return [
        {"clip": i, "first_frame": a, "n_frames": b - a, "start_s": a / rate, "end_s": b / rate} for i, (a, b) in enumerate(find_shots(shares))
    ]


def clip_rows(data: bytes) -> list[dict]:
    """Timed clip rows of an AVI file."""
    avi = read_avi(data)
    return clips_of(frame_facts(avi.frames)[1], avi.fps)


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): the AVI file of each row's text. Null texts count as empty."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len((t or "").encode()) for t in texts], pa.int64()),
                        pa.array([text_media(t) for t in texts], pa.binary()),
                    ],
                    names=[id_col, "n_bytes", "media"],
                )

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {id_type}, n_bytes long, media binary")


def media_clips(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Timed clip rows (id, clip, first_frame, n_frames, start_s, end_s) of AVI files.

    A file without frames, and a null one, yields no row.
    """
    id_type = media.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, clip int, first_frame int, n_frames int, start_s double, end_s double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("clip", pa.int32()), ("first_frame", pa.int32()), ("n_frames", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())]
        for batch in batches:
            ids, clips = [], []
            for i, data in enumerate(batch.column(1).to_pylist()):
                found = clip_rows(data) if data else []
                ids += [i] * len(found)
                clips += found
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ids, pa.int64())), *(pa.array([c[k] for c in clips], t) for k, t in kinds)],
                names=[id_col, *(k for k, _ in kinds)],
            )

    return media.select(F.col(id_col), F.col(media_col)).mapInArrow(run, schema)


def media_digests(files: Iterable[bytes]) -> Iterator[tuple]:
    """Read stored files back: payload size and hash, its tail's checksum, the file's own, feature, clips.

    Frames of several files are decoded together, SIDE_BY_SIDE of them or those of one long file.
    """
    waiting: list[tuple[Avi, int, str]] = []

    def told() -> Iterator[tuple]:
        payloads, shares = frame_facts([f for avi, _, _ in waiting for f in avi.frames])
        at = 0
        for avi, size, sha in waiting:
            end = at + len(avi.frames)
            payload, mine = b"".join(payloads[at:end])[: note_value(avi, "payload")], shares[at:end]
            clips = clips_of(mine, avi.fps)
            mean = " ".join(f"{x:.4f}" for x in mine.mean(axis=0))
            feature = f"frames={len(mine)} shots={len(clips)} cuts={','.join(str(c['first_frame']) for c in clips[1:])} luma={mean}"
            yield len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), size, sha, feature, clips
            at = end
        waiting.clear()

    held = 0
    for data in files:
        avi = read_avi(data)
        waiting.append((avi, len(data), hashlib.sha256(data).hexdigest()))
        held += len(avi.frames)
        if held >= SIDE_BY_SIDE:
            yield from told()
            held = 0
    if waiting:
        yield from told()


CLIP = "struct<clip:int,first_frame:int,n_frames:int,start_s:double,end_s:double>"


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each row's text as a file, read the stored bytes back, and return what was read.

    Files live in a worker's memory until their frames are decoded; none travels between stages. Null
    texts count as empty. Equal texts give equal values, repeated rows repeated ones; ids may be
    null; an empty table has no rows. Texts are stored whole; one over the 32-bit sizes of RIFF (2
    GB of text) fails the query. The id can't be called like a new column; others don't take part.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"]
    clip = pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("n_frames", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())])
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(clip)]
    schema = (
        f"`{id_col}` {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        f"media_bytes long, media_sha256 string, feature string, clips array<{CLIP}>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            told = media_digests(text_media(x.as_py()) for x in texts)
            found = [(len((t.as_py() or "").encode()), *r) for t, r in zip(texts, told, strict=True)]
            columns = [pa.array([r[i] for r in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, *names])

    return docs.select(quoted(id_col), quoted(text_col)).mapInArrow(run, schema)
