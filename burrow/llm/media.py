"""Motion-JPEG in AVI: RIFF index, intra frames, shots.

Reading: the RIFF tree is walked to ``hdrl`` and ``idx1``; every frame that the index names is a baseline JPEG of its
own, whose coefficients are entropy-decoded and turned into luma samples. Further segments of an OpenDML file (AVIX), which that
index doesn't know, are walked chunk by chunk. Shots begin where the difference of neighbouring frames' histograms stands out
from the last differences that weren't cuts themselves. ``clips`` yields timed rows.

Storing: ``write_avi`` keeps any payload of bytes without loss, as quantised DCT coefficients (JPEG's unit; samples
would be rounded). A byte is the eight magnitude bits of a coefficient of category 8, for which the Huffman
tables have a single one-bit code: every unit takes nine bits, so blocks start on byte bounds, and both ways are vectorised.
Frames are grey, 32 x 32 samples (1,024 bytes); the last one is filled up with zeros, and an INFO chunk has the payload's length.

Edge cases: null and empty texts are stored as 64 zero bytes. A file that isn't an AVI, or frames that aren't
baseline JPEG, raise ``MediaError``; ``clips`` turns that into a row with the message. Repeated rows give repeated rows;
empty tables empty ones; extra columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, texts

SIDE, FPS = 32, 25
BLOCKS = (SIDE // 8) ** 2
FRAME_BYTES = 64 * BLOCKS
BINS = 16
#: A cut: a difference of histograms over MEAN + SPREAD deviations of the last WINDOW differences, and over LEAST.
WINDOW, SPREAD, LEAST = 8, 3.0, 0.1
#: With fewer than HISTORY differences known, a cut is one over START: half of all samples change their range.
HISTORY, START = 3, 1.0


class MediaError(ValueError):
    pass


def zigzag() -> np.ndarray:
    """Natural position of each coefficient in scan order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = zigzag()
_k = np.arange(8)
#: Row u, column x: the weight of frequency u in sample x.
BASIS = (np.where(_k == 0, np.sqrt(1 / 8), 0.5)[:, None] * np.cos((2 * _k[None, :] + 1) * _k[:, None] * np.pi / 16)).astype(np.float32)


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def frame_head() -> bytes:
    one = bytes([1]) + bytes(15)  # one code, of one bit
    return b"".join(
        [
            b"\xff\xd8",
            segment(0xDB, b"\0" + b"\1" * 64),
            segment(0xC0, struct.pack(">BHHBBBB", 8, SIDE, SIDE, 1, 1, 0x11, 0)),
            segment(0xC4, b"\x00" + one + b"\x08"),
            segment(0xC4, b"\x10" + one + b"\x08"),
            segment(0xDD, struct.pack(">H", SIDE // 8)),
            segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
        ]
    )


HEAD = frame_head()


def nine_bits(units: np.ndarray) -> np.ndarray:
    """Eight bytes become nine: a zero bit before each."""
    u = units.reshape(-1, 8).astype(np.uint16)
    out = np.zeros((len(u), 9), np.uint8)
    for k in range(9):
        low = u[:, k - 1] << (8 - k) & 0xFF if k else 0
        out[:, k] = low | (u[:, k] >> (k + 1) if k < 8 else 0)
    return out


def eight_bits(coded: np.ndarray) -> np.ndarray:
    c = coded.reshape(-1, 9).astype(np.uint16)
    out = np.empty((len(c), 8), np.uint8)
    for k in range(8):
        out[:, k] = (c[:, k] << (k + 1) & 0xFF) | c[:, k + 1] >> (7 - k)
    return out


def frames_of(payload: bytes) -> list[bytes]:
    fill = -len(payload) % FRAME_BYTES
    coded = nine_bits(np.frombuffer(payload + bytes(fill), np.uint8)).tobytes()
    row, out = 72 * (SIDE // 8), []
    for at in range(0, len(coded), row * (SIDE // 8)):
        scan = []
        for k in range(SIDE // 8):
            if k:
                scan.append(bytes([0xFF, 0xD0 + (k - 1) % 8]))
            scan.append(coded[at + k * row : at + (k + 1) * row].replace(b"\xff", b"\xff\0"))
        out.append(HEAD + b"".join(scan) + b"\xff\xd9")
    return out


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(payload: bytes) -> bytes:
    frames = frames_of(payload)
    most = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 24, b"MJPG", SIDE * SIDE * 3, 0, 0, 0, 0)
    strl = chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf))
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + strl)
    info = chunk(b"LIST", b"INFO" + chunk(b"ICMT", b"payload=%d\0" % len(payload)))
    parts, index, at = [], [], 4
    for f in frames:
        parts.append(chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(parts[-1])
    return chunk(b"RIFF", b"AVI " + hdrl + info + chunk(b"LIST", b"movi" + b"".join(parts)) + chunk(b"idx1", b"".join(index)))


@dataclass
class Avi:
    frames: list[memoryview]
    seconds: float
    payload: int | None = None


def tree(data: memoryview, at: int, end: int):
    """(name, kind of list, start, end) of each chunk, lists before what they hold."""
    while at + 8 <= end:
        name, size = bytes(data[at : at + 4]), int.from_bytes(data[at + 4 : at + 8], "little")
        stop = min(at + 8 + size, end)
        if name in (b"RIFF", b"LIST"):
            yield name, bytes(data[at + 8 : at + 12]), at + 12, stop
            if bytes(data[at + 8 : at + 12]) != b"movi":
                yield from tree(data, at + 12, stop)
        else:
            yield name, b"", at + 8, stop
        at += 8 + size + size % 2


def read_avi(raw: bytes) -> Avi:
    data = memoryview(raw)
    if raw[:4] != b"RIFF" or raw[8:12] != b"AVI ":
        raise MediaError("not an AVI file")
    found: dict[bytes, tuple[int, int]] = {}
    more: list[tuple[int, int]] = []
    for name, kind, a, b in tree(data, 0, len(raw)):
        if kind == b"movi" and kind in found:
            more.append((a, b))
        found.setdefault(kind or name, (a, b))
    if b"avih" not in found or b"movi" not in found:
        raise MediaError("an AVI file without header or frames")
    seconds = int.from_bytes(data[found[b"avih"][0] :][:4], "little") / 1e6
    movi, frames = found[b"movi"], []
    if b"idx1" in found:
        a, b = found[b"idx1"]
        rows = [struct.unpack_from("<4sIII", data, i) for i in range(a, b - 15, 16)]
        # offsets count from the list's kind or from the file's start
        base = movi[0] - 4 if rows and rows[0][2] < movi[0] else 0
        frames = [data[base + r[2] + 8 : base + r[2] + 8 + r[3]] for r in rows if r[0][2:] in (b"dc", b"db")]
    else:
        more.insert(0, movi)
    for part in more:
        frames += [data[a:b] for name, _, a, b in tree(data, *part) if name[2:] in (b"dc", b"db")]
    note = bytes(data[slice(*found[b"ICMT"])]).rstrip(b"\0") if b"ICMT" in found else b""
    return Avi(frames, seconds, int(note[8:]) if note.startswith(b"payload=") else None)


@dataclass
class Jpeg:
    width: int = 0
    height: int = 0
    parts: list[list[int]] = field(default_factory=list)  # id, horizontal and vertical factor, quantiser, DC and AC table
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    codes: dict[int, dict[tuple[int, int], int]] = field(default_factory=dict)  # (bits, code) -> symbol
    every: int = 0
    scan: bytes = b""


def parse_jpeg(data: memoryview) -> Jpeg:
    raw, j, at = bytes(data), Jpeg(), 2
    if raw[:2] != b"\xff\xd8":
        raise MediaError("not a JPEG frame")
    while at + 4 <= len(raw):
        marker, size = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
        body = raw[at + 4 : at + 2 + size]
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                q = np.frombuffer(body, ">u2" if wide else "u1", 64, k + 1).astype(np.int32)
                j.quant[body[k] & 15] = q
                k += 1 + 64 * (1 + bool(wide))
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                table, code, v = {}, 0, k + 17
                for bits in range(1, 17):
                    for _ in range(body[k + bits]):
                        table[bits, code] = body[v]
                        code, v = code + 1, v + 1
                    code <<= 1
                j.codes[body[k]] = table
                k = v
        elif marker in (0xC0, 0xC1):
            j.height, j.width, n = struct.unpack_from(">HHB", body, 1)
            j.parts = [[body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i], 0, 0] for i in range(n)]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise MediaError(f"a JPEG frame of kind {marker:02x}, not baseline")
        elif marker == 0xDD:
            j.every = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            by_id = {p[0]: p for p in j.parts}
            for i in range(body[0]):
                by_id[body[1 + 2 * i]][4:] = [body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15]
            end = raw.rfind(b"\xff\xd9")
            j.scan = raw[at + 2 + size : end if end > 0 else len(raw)]
            break
        at += 2 + size
    if not j.parts or not j.scan:
        raise MediaError("a JPEG frame without picture")
    return j


def intervals(scan: bytes) -> list[bytes]:
    """Entropy-coded bytes between restart markers, without stuffing."""
    out, start, at = [], 0, scan.find(b"\xff")
    while at >= 0 and at + 1 < len(scan):
        if 0xD0 <= scan[at + 1] <= 0xD7:
            out.append(scan[start:at].replace(b"\xff\0", b"\xff"))
            start = at + 2
        at = scan.find(b"\xff", at + 2)
    return [*out, scan[start:].replace(b"\xff\0", b"\xff")]


def coefficients(j: Jpeg) -> list[np.ndarray]:
    """Of each component: blocks in the order of the scan, 64 coefficients in scan order; one component's blocks run by rows."""
    alone = len(j.parts) == 1
    fixed = alone and j.codes.get(j.parts[0][4]) == {(1, 0): 8} and j.codes.get(16 + j.parts[0][5]) == {(1, 0): 8}
    if fixed:
        return [fixed_coefficients(b"".join(intervals(j.scan)), j.every)]
    out: list[list[np.ndarray]] = [[] for _ in j.parts]
    h, v = (1, 1) if alone else (max(p[1] for p in j.parts), max(p[2] for p in j.parts))
    units = -(-j.width // (8 * h)) * -(-j.height // (8 * v))
    parts, done = intervals(j.scan), 0
    codes = {k: lookup(tuple(t.items())) for k, t in j.codes.items()}
    for part in parts:
        todo = min(j.every or units, units - done)
        bits, last = Bits(part), [0] * len(j.parts)
        for _ in range(todo):
            for i, p in enumerate(j.parts):
                for _ in range(1 if alone else p[1] * p[2]):
                    block = np.zeros(64, np.int32)
                    last[i] += bits.value(bits.symbol(codes[p[4]]))
                    block[0], k = last[i], 1
                    while k < 64:
                        s = bits.symbol(codes[16 + p[5]])
                        if s == 0:
                            break
                        k += s >> 4
                        if s & 15 and k < 64:
                            block[k] = bits.value(s & 15)
                        k += 1
                    out[i].append(block)
        done += todo
    return [np.stack(b) for b in out]


@lru_cache(64)
def lookup(table: tuple[tuple[tuple[int, int], int], ...]) -> list[tuple[int, int] | None]:
    """Of each 16 bits the number of bits of the code that they start with, and its symbol."""
    out: list[tuple[int, int] | None] = [None] * (1 << 16)
    for (bits, code), symbol in table:
        first = code << (16 - bits)
        out[first : first + (1 << (16 - bits))] = [(bits, symbol)] * (1 << (16 - bits))
    return out


class Bits:
    """Bits of ``raw``, of which a few bytes at a time are held as a number."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.held, self.word = raw, 0, 0, 0

    def fill(self) -> None:
        more = self.raw[self.at : self.at + 8]
        self.at += len(more)
        self.word = (self.word & ((1 << self.held) - 1)) << (8 * len(more)) | int.from_bytes(more, "big")
        self.held += 8 * len(more)

    def take(self, k: int) -> int:
        if self.held < k:
            self.fill()
            if self.held < k:
                raise MediaError("a JPEG frame that ends early")
        self.held -= k
        return self.word >> self.held & ((1 << k) - 1)

    def symbol(self, table: list[tuple[int, int] | None]) -> int:
        if self.held < 16:
            self.fill()
        # beyond the end come ones, which no code consists of
        ahead = self.word >> (self.held - 16) & 0xFFFF if self.held >= 16 else ((self.word & ((1 << self.held) - 1)) + 1 << (16 - self.held)) - 1
        found = table[ahead]
        if found is None or found[0] > self.held:
            raise MediaError("a JPEG frame with an unknown code" if found is None else "a JPEG frame that ends early")
        self.held -= found[0]
        return found[1]

    def value(self, size: int) -> int:
        v = self.take(size) if size else 0
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


def fixed_coefficients(coded: bytes, every: int) -> np.ndarray:
    units = eight_bits(np.frombuffer(coded, np.uint8)[: len(coded) // 72 * 72]).reshape(-1, 64)
    out = np.where(units >= 128, units.astype(np.int16), units.astype(np.int16) - 255)
    n = every or len(out)
    for k in range(0, len(out) % n and len(out), n):  # a last interval that is shorter
        out[k : k + n, 0] = np.cumsum(out[k : k + n, 0])
    if len(out) % n == 0:
        out[:, 0] = np.cumsum(out[:, 0].reshape(-1, n), 1).ravel()
    return out


def units_of(blocks: np.ndarray, every: int) -> np.ndarray:
    """The payload bytes of coefficients that ``write_avi`` made."""
    c = blocks.astype(np.int16)
    n = every or len(c)
    first = c[:, 0].reshape(-1, n)
    c[:, 0] = np.diff(first, axis=1, prepend=0).ravel()
    return np.where(c >= 0, c, c + 255).astype(np.uint8)


def samples(blocks: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """8 x 8 samples of each block."""
    natural = np.empty(blocks.shape, np.float32)
    natural[:, ZIGZAG] = blocks * quant
    half = (natural.reshape(-1, 8) @ BASIS).reshape(-1, 8, 8).transpose(0, 2, 1)
    out = (half.reshape(-1, 8) @ BASIS).reshape(-1, 8, 8)  # transposed: the histogram doesn't mind, ``picture`` turns it
    np.rint(out, out=out)
    out += 128
    return np.clip(out, 0, 255, out=out).astype(np.uint8)


def histograms(blocks: np.ndarray, quant: np.ndarray, per_frame: int) -> np.ndarray:
    """Shares of BINS luma ranges in each frame."""
    s = samples(blocks, quant) >> 4
    frame = np.repeat(np.arange(len(blocks) // per_frame) * BINS, per_frame * 64)
    return np.bincount(s.ravel() + frame, minlength=len(blocks) // per_frame * BINS).reshape(-1, BINS) / (64.0 * per_frame)


def shots(hist: np.ndarray) -> list[int]:
    """First frames of the shots. Cuts are left out of the differences that the next ones are held against."""
    out, last, one, two = [0], [], 0.0, 0.0
    for i, d in enumerate(np.abs(np.diff(hist, axis=0)).sum(1).tolist()):
        k = len(last)
        mean = one / k if k else 0.0
        if d > (max(mean + SPREAD * max(two / k - mean * mean, 0.0) ** 0.5, LEAST) if k >= HISTORY else START):
            out.append(i + 1)
            continue
        last.append(d)
        one, two = one + d, two + d * d
        if k == WINDOW:
            gone = last.pop(0)
            one, two = one - gone, two - gone * gone
    return out


def luma(frames: list[memoryview]) -> tuple[np.ndarray, list[np.ndarray], int]:
    """Histograms of all frames, the luma blocks of each, and the restart interval."""
    parsed = [parse_jpeg(f) for f in frames]
    same = all(p.parts == parsed[0].parts and len(p.parts) == 1 and p.codes == parsed[0].codes and p.every == parsed[0].every for p in parsed[1:])
    if same and len(parsed[0].parts) == 1 and parsed[0].codes == {0: {(1, 0): 8}, 16: {(1, 0): 8}}:
        blocks = fixed_coefficients(b"".join(b"".join(intervals(p.scan)) for p in parsed), parsed[0].every)
        per = len(blocks) // len(parsed)
        return histograms(blocks, parsed[0].quant[parsed[0].parts[0][3]], per), [blocks], parsed[0].every
    first = [coefficients(p)[0] for p in parsed]
    return np.concatenate([histograms(b, p.quant[p.parts[0][3]], len(b)) for b, p in zip(first, parsed, strict=True)]), first, parsed[0].every


#: Frames decoded at a time.
STEP = 2048


def scan_media(raw: bytes) -> tuple[Avi, np.ndarray, list[int], bytes | None]:
    """The file, its frames' histograms, its shots and, if ``write_avi`` made it, its payload."""
    avi = read_avi(raw)
    if not avi.frames:
        raise MediaError("an AVI file without frames")
    hist, back = [], []
    for k in range(0, len(avi.frames), STEP):
        h, blocks, every = luma(avi.frames[k : k + STEP])
        hist.append(h)
        if avi.payload is not None:
            back += [units_of(b, every).tobytes() for b in blocks]
    whole = np.concatenate(hist)
    return avi, whole, shots(whole), b"".join(back)[: avi.payload] if avi.payload is not None else None


def clips(media: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """A row for each shot: name, shot, first_frame, frames, start_s, end_s, error (of a file that can't be read, alone)."""

    def run(b: pa.RecordBatch):
        rows: list[tuple] = []
        for n, raw in zip(b.column(name).to_pylist(), b.column(content).to_pylist(), strict=True):
            try:
                avi, hist, cuts, _ = scan_media(bytes(raw or b""))
                for i, c in enumerate(timed(avi, hist, cuts)):
                    rows.append((n, i, *c.values(), None))
            except (MediaError, struct.error, KeyError, IndexError, ValueError) as e:
                rows.append((n, None, None, None, None, None, str(e) or type(e).__name__))
        kinds = [b.schema.field(name).type, pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string()]
        cols = list(zip(*rows, strict=True)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[name, "shot", "first_frame", "frames", "start_s", "end_s", "error"])

    kind = media.schema[name].dataType.simpleString()
    return map_batches(media.select(name, content), run, f"{name} {kind}, shot int, first_frame long, frames long, start_s double, end_s double, error string")


def feature(hist: np.ndarray, cuts: list[int]) -> str:
    """Frames, shots, the mean histogram in hex (16 bits a bin) and a digest of the shots' first frames."""
    mean = np.rint(hist.mean(0) * 65_535).astype(">u2").tobytes().hex()
    return f"frames={len(hist)};shots={len(cuts)};luma={mean};cuts={zlib.crc32(np.array(cuts, '<u4').tobytes()):08x}"


CLIPS = pa.list_(pa.struct([("first_frame", pa.int64()), ("frames", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64())]))


def timed(avi: Avi, hist: np.ndarray, cuts: list[int]) -> list[dict]:
    return [{"first_frame": a, "frames": z - a, "start_s": a * avi.seconds, "end_s": z * avi.seconds} for a, z in zip(cuts, [*cuts[1:], len(hist)], strict=True)]


def stored(docs: DataFrame) -> DataFrame:
    """Every text as an AVI file and what reading it back shows, its timed clips (one for each shot) among it."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(b: pa.RecordBatch):
        cols: list[list] = [[] for _ in range(10)]
        for t in texts(b):
            raw = write_avi(t + bytes(-len(t) % 64 or (0 if t else 64)))
            avi, hist, cuts, back = scan_media(raw)
            row = (len(t), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(hist, cuts), len(hist), len(cuts), timed(avi, hist, cuts))
            for c, v in zip(cols, row, strict=True):
                c.append(v)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), CLIPS]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "n_shots", "clips"])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, n_shots long, clips array<struct<first_frame: long, frames: long, start_s: double, end_s: double>>")
