"""Media columns: ISO media files kept as binary values, described without decoding a payload.

`describe_media` walks the nested boxes of each file, decodes its sample tables (sizes, sample-to-chunk
runs, chunk offsets, sync samples, durations) and the runs of its fragments, and returns codec, duration and the
byte range of every keyframe of every track; the first video track, or else the first track, also stands for the file.
`wrap_frames` writes raw RGB frames of 8 by 8 pixels (192 bytes of 8-bit samples) as such a
file, and `read_payload` reads the samples back through the tables.

Defined cases: a null file has null properties and `error` 'null'; an empty one or one without a movie
box has `error` 'no movie'; a file cut short or with inconsistent tables has `error` with the reason and
what could be read before it. Unknown boxes are skipped by their size, 64-bit sizes and boxes that run to
the end included. Work and memory are per file; rows with the same bytes give the same values.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gleanery.llm.common import slices, stored, table, text_or_empty

#: Bytes of one frame: 8 x 8 pixels of three 8-bit samples.
FRAME = 192
#: Frames in a chunk; the first of each is listed as a keyframe, so a reader can start there.
CHUNK_FRAMES = 16
#: Ticks a second, and ticks a frame.
TIMESCALE, FRAME_TICKS = 1000, 40

#: Boxes that hold boxes (fixed values of the format).
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
#: Flag of a fragment's sample that is no sync sample.
NOT_SYNC = 0x10000
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", len(body) + 8) + kind + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


_FTYP = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ")
_HDLR = _full(b"hdlr", bytes(4), b"vide", bytes(12), b"frames\0")
_VMHD = _full(b"vmhd", bytes(8), flags=1)
_DINF = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
_STSD = _full(
    b"stsd",
    struct.pack(">I", 1),
    _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", 8, 8, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 24, -1)),
)


def wrap_frames(payload: bytes) -> bytes:
    """An ISO media file around whole raw frames."""
    n = len(payload) // FRAME
    if not n or n * FRAME != len(payload):
        raise ValueError("payload is not a positive number of whole frames")
    duration = n * FRAME_TICKS
    chunks = -(-n // CHUNK_FRAMES)
    full, rest = divmod(n, CHUNK_FRAMES)
    runs = ([(1, CHUNK_FRAMES)] if full else []) + ([(full + 1, rest)] if rest else [])

    def movie(base: int) -> bytes:
        places = base + np.arange(chunks, dtype=np.uint64) * (CHUNK_FRAMES * FRAME)
        wide = base + len(payload) >= 1 << 32
        table_ = _box(
            b"stbl",
            _STSD,
            _full(b"stts", struct.pack(">III", 1, n, FRAME_TICKS)),
            _full(b"stss", struct.pack(">I", chunks), (np.arange(chunks) * CHUNK_FRAMES + 1).astype(">u4").tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", first, k, 1) for first, k in runs]),
            _full(b"stsz", struct.pack(">II", FRAME, n)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), places.astype(">u8" if wide else ">u4").tobytes()),
        )
        head = struct.pack(">IIII", 0, 0, TIMESCALE, duration)
        return _box(
            b"moov",
            _full(b"mvhd", head, struct.pack(">IH", 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2)),
            _box(
                b"trak",
                _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, duration), bytes(16), MATRIX, struct.pack(">II", 8 << 16, 8 << 16), flags=3),
                _box(b"mdia", _full(b"mdhd", head, struct.pack(">HH", 0x55C4, 0)), _HDLR, _box(b"minf", _VMHD, _DINF, table_)),
            ),
        )

    start = len(_FTYP) + len(movie(0)) + 8
    return _FTYP + movie(start) + _box(b"mdat", payload)


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, body start and end of each box between two places."""
    while start + 8 <= end:
        size, head = int.from_bytes(data[start : start + 4], "big"), 8
        kind = bytes(data[start + 4 : start + 8])
        if size == 1:
            if start + 16 > end:
                raise ValueError("size cut short")
            size, head = int.from_bytes(data[start + 8 : start + 16], "big"), 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind.decode('latin-1')} leaves its parent")
        yield kind, start + head, start + size
        start += size


def _ints(data: memoryview, start: int, end: int, count: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if start + count * size > end:
        raise ValueError("table cut short")
    return np.frombuffer(data[start : start + count * size], kind).astype(np.int64)


def _u32(data: memoryview, at: int, end: int) -> int:
    return int(_ints(data, at, end, 1, ">u4")[0])


def _fields(data: memoryview, at: int, end: int, flags: int, known: tuple[tuple[int, str], ...]) -> tuple[list[int | None], int]:
    """Values of optional fields, null without their flag, and the place behind them."""
    out: list[int | None] = []
    for flag, kind in known:
        out.append(int(_ints(data, at, end, 1, kind)[0]) if flags & flag else None)
        at += np.dtype(kind).itemsize if flags & flag else 0
    return out, at


class Track:
    """Sample tables of one track, decoded into places, sizes and sync samples."""

    def __init__(self) -> None:
        self.handler = self.codec = ""
        self.number = self.timescale = self.ticks = 0
        #: Duration, size and flags of a fragment's sample that does not say them.
        self.defaults = (0, 0, 0)
        self.error: str | None = None
        #: Places, sizes, durations and sync marks of the samples of each fragment's run.
        self._pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.offsets = self.sizes = np.zeros(0, np.int64)
        self.sync: np.ndarray | None = None
        self._runs = self._chunks = self._sizes = np.zeros(0, np.int64)

    def take(self, data: memoryview, kind: bytes, at: int, end: int) -> None:
        if kind == b"tkhd":
            self.number = _u32(data, at + (20 if data[at] == 1 else 12), end)
        elif kind == b"hdlr" and data[at + 4 : at + 8] != b"dhlr":  # that one names where the data lie
            self.handler = bytes(data[at + 8 : at + 12]).decode("latin-1")
        elif kind == b"mdhd":
            long = data[at] == 1
            self.timescale = _u32(data, at + (20 if long else 12), end)
            self.ticks = int(_ints(data, at + (24 if long else 16), end, 1, ">u8" if long else ">u4")[0])
        elif kind == b"stsd":
            if _u32(data, at + 4, end):
                self.codec = bytes(data[at + 12 : at + 16]).decode("latin-1").strip()
        elif kind == b"stsc":
            self._runs = _ints(data, at + 8, end, 3 * _u32(data, at + 4, end), ">u4").reshape(-1, 3)
        elif kind in (b"stco", b"co64"):
            self._chunks = _ints(data, at + 8, end, _u32(data, at + 4, end), ">u4" if kind == b"stco" else ">u8")
        elif kind == b"stsz":
            one, count = _u32(data, at + 4, end), _u32(data, at + 8, end)
            if one and count > len(data) // one + 1:
                raise ValueError("more samples than bytes")
            self._sizes = np.full(count, one, np.int64) if one else _ints(data, at + 12, end, count, ">u4")
        elif kind == b"stz2":
            bits, count = data[at + 7], _u32(data, at + 8, end)
            if bits == 4:
                pairs = _ints(data, at + 12, end, (count + 1) // 2, ">u1")
                self._sizes = np.stack([pairs >> 4, pairs & 15], 1).reshape(-1)[:count]
            else:
                self._sizes = _ints(data, at + 12, end, count, ">u1" if bits == 8 else ">u2")
        elif kind == b"stss":
            self.sync = _ints(data, at + 8, end, _u32(data, at + 4, end), ">u4") - 1

    def settle(self) -> None:
        """Place of every sample: chunks by their runs, samples by running sizes within a chunk."""
        n, chunks = len(self._sizes), len(self._chunks)
        if n and not (chunks and len(self._runs)):
            raise ValueError("samples without chunks")
        if n:
            self._place(n, chunks)
        if self._pieces:
            # Samples of the movie box come first; its sync table speaks of them only.
            marks = np.ones(n, bool) if self.sync is None else np.isin(np.arange(n), self.sync)
            offsets, sizes, ticks, sync = (np.concatenate(x) for x in zip(*self._pieces))
            self.offsets, self.sizes = np.concatenate([self.offsets, offsets]), np.concatenate([self.sizes, sizes])
            self.sync = np.flatnonzero(np.concatenate([marks, sync]))
            self.ticks = (self.ticks if n else 0) + int(ticks.sum())

    def _place(self, n: int, chunks: int) -> None:
        first = self._runs[:, 0] - 1
        if first[0] != 0 or (np.diff(first) <= 0).any() or first[-1] >= chunks:
            raise ValueError("chunk runs out of order")
        per = np.repeat(self._runs[:, 1], np.diff(np.append(first, chunks)))
        if per.sum() != n:
            raise ValueError("chunks and samples differ")
        if self.sync is not None and len(self.sync) and (self.sync.min() < 0 or self.sync.max() >= n):
            raise ValueError("sync sample outside the track")
        before = np.concatenate([[0], np.cumsum(self._sizes)])
        lead = np.concatenate([[0], np.cumsum(per)])[:-1]
        self.offsets = np.repeat(self._chunks - before[np.minimum(lead, n)], per) + before[:-1]
        self.sizes = self._sizes

    def keyframes(self) -> np.ndarray:
        """(offset, length) of each sync sample; without a sync table every sample is one."""
        if not len(self.offsets):
            return np.zeros((0, 2), np.int64)
        at = np.arange(len(self.offsets)) if self.sync is None else self.sync
        return np.stack([self.offsets[at], self.sizes[at]], 1)


class Fragment:
    """Samples of one movie fragment, from the defaults of its tracks and its runs, handed to the tracks."""

    def __init__(self, start: int) -> None:
        self.start = self.after = start
        self.track: Track | None = None

    def take(self, data: memoryview, kind: bytes, at: int, end: int, found: list[Track]) -> None:
        if kind == b"tfhd":
            flags, number = _u32(data, at, end) & 0xFFFFFF, _u32(data, at + 4, end)
            (base, _, *own), _ = _fields(data, at + 8, end, flags, ((0x1, ">u8"), (0x2, ">u4"), (0x8, ">u4"), (0x10, ">u4"), (0x20, ">u4")))
            self.track = next((t for t in found if t.number == number), None)
            if self.track is None:
                raise ValueError("fragment of an unknown track")
            self.defaults = [b if a is None else a for a, b in zip(own, self.track.defaults)]
            # Without a base of its own a track goes on behind the data of the one before it.
            self.base = base if base is not None else self.start if flags & 0x20000 else self.after
            self.after = self.base
        elif kind == b"trun":
            if self.track is None:
                raise ValueError("run without a track")
            flags, count = _u32(data, at, end) & 0xFFFFFF, _u32(data, at + 4, end)
            (shift, first), at = _fields(data, at + 8, end, flags, ((0x1, ">i4"), (0x4, ">u4")))
            stated = [f for f in (0x100, 0x200, 0x400, 0x800) if flags & f]
            if not stated and count > len(data):
                raise ValueError("more samples than bytes")
            rows = _ints(data, at, end, count * len(stated), ">u4").reshape(count, len(stated))
            ticks, sizes, marks = (rows[:, stated.index(f)] if f in stated else np.full(count, d, np.int64) for f, d in zip((0x100, 0x200, 0x400), self.defaults))
            if count and first is not None:
                marks = np.append(first, marks[1:])
            offsets = (self.after if shift is None else self.base + shift) + np.cumsum(sizes) - sizes
            if count:
                self.after = int(offsets[-1] + sizes[-1])
                self.track._pieces.append((offsets, sizes, ticks, marks & NOT_SYNC == 0))


def tracks(blob: bytes) -> tuple[list[Track], float, str | None]:
    """Tracks, movie duration in seconds and the first error."""
    data, found, seconds, error = memoryview(blob), [], 0.0, None
    fragment, defaults = None, {}
    try:
        todo = list(boxes(data, 0, len(data)))[::-1]
        while todo:
            kind, at, end = todo.pop()
            if kind == b"mvhd":
                long = data[at] == 1
                scale = _u32(data, at + (20 if long else 12), end)
                seconds = int(_ints(data, at + (24 if long else 16), end, 1, ">u8" if long else ">u4")[0]) / scale if scale else 0.0
            elif kind in CONTAINERS:
                if kind == b"trak":
                    found.append(Track())
                elif kind == b"moov":
                    fragment = None
                elif kind == b"moof":
                    fragment = Fragment(at - (8 if data[at - 4 : at] == kind else 16))
                    for track in found:
                        track.defaults = defaults.get(track.number, track.defaults)
                elif kind == b"traf" and fragment:
                    fragment.track = None
                todo.extend(list(boxes(data, at, end))[::-1])
            elif kind == b"trex":
                number, _, *rest = _ints(data, at + 4, end, 5, ">u4").tolist()
                defaults[number] = tuple(rest)
            elif kind in (b"tfhd", b"trun") and fragment:
                fragment.take(data, kind, at, end, found)
            elif found and not fragment:
                found[-1].take(data, kind, at, end)
    except (ValueError, IndexError) as problem:
        error = str(problem)
    for track in found:  # an inconsistent track leaves the others readable
        try:
            track.settle()
            if len(track.offsets) and (int(track.offsets.min()) < 0 or int((track.offsets + track.sizes).max()) > len(data)):
                raise ValueError("sample outside the file")
        except (ValueError, IndexError) as problem:
            track.error = str(problem)
            error = error or track.error
    return found, seconds, error or (None if found else "no movie")


def read_payload(blob: bytes) -> bytes:
    """The first track's samples in order, found through the sample tables."""
    found, _, error = tracks(blob)
    if error:
        raise ValueError(error)
    track, parts = found[0], []
    ends = track.offsets + track.sizes
    cuts = np.flatnonzero(track.offsets[1:] != ends[:-1]) + 1  # neighbours in the file are read at once
    for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(ends)]])):
        parts.append(blob[int(track.offsets[a]) : int(ends[b - 1])])
    return b"".join(parts)


TRACK_FIELDS = "codec string, handler string, seconds double, samples long, keyframes array<struct<offset:long,length:long>>, error string"
MEDIA_FIELDS = f"{TRACK_FIELDS}, tracks array<struct<{TRACK_FIELDS.replace(' string', ':string').replace(' double', ':double').replace(' long', ':long').replace(' array', ':array')}>>"


def _about(track: Track, seconds: float) -> dict:
    seconds = track.ticks / track.timescale if track.timescale else seconds
    keys = [{"offset": int(a), "length": int(b)} for a, b in track.keyframes()]
    return {"codec": track.codec or None, "handler": track.handler or None, "seconds": seconds, "samples": len(track.offsets), "keyframes": keys, "error": track.error}


def _described(blob: bytes | None) -> dict:
    if blob is None:
        return {"codec": None, "handler": None, "seconds": None, "samples": None, "keyframes": None, "error": "null", "tracks": None}
    found, seconds, error = tracks(blob)
    each = [_about(track, seconds) for track in found]
    main = next((x for x in each if x["handler"] == "vide"), each[0] if each else _about(Track(), seconds))
    return main | {"error": error, "tracks": each}


def describe_media(files: DataFrame, id_column: str, media_column: str) -> DataFrame:
    """One row per file: its id, then codec, handler, seconds, samples and keyframe ranges of its first video track (or else
    its first track), the file's error, and `tracks` with the same of every track."""
    rows = files.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{media_column}`").cast("binary").alias("media"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            made = [_described(x) for x in batch.column("media").to_pylist()]
            out = pa.RecordBatch.from_pylist(made, schema=_ARROW)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *out.columns], names=["id", *_ARROW.names])

    return rows.mapInArrow(run, f"id {kind}, {MEDIA_FIELDS}").withColumnRenamed("id", id_column)


_TRACK = [
    ("codec", pa.string()),
    ("handler", pa.string()),
    ("seconds", pa.float64()),
    ("samples", pa.int64()),
    ("keyframes", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))),
    ("error", pa.string()),
]
_ARROW = pa.schema([*_TRACK, ("tracks", pa.list_(pa.struct(_TRACK)))])


def text_payload(text: str) -> tuple[bytes, int]:
    """UTF-8 of a text padded with spaces to a positive number of whole frames, and its own length."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw + b" " * (FRAME - len(raw) % FRAME if len(raw) % FRAME or not raw else 0), len(raw)


def store_texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """A table (id, n_bytes, media) with each text as the frames of an ISO media file."""
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), text_or_empty(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            made = [text_payload(x) for x in batch.column("text").to_pylist()]
            media = pa.array([wrap_frames(x) for x, _ in made], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([n for _, n in made], pa.int64()), media], names=["id", "n_bytes", "media"])

    return rows.mapInArrow(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_column)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as an ISO media file in a Parquet table, read back and described."""
    files = stored(store_texts(table(spark, sf_dir, "documents"), "doc_id", "text"), "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            out: list[tuple] = []
            for blob in batch.column("media").to_pylist():
                payload, about = read_payload(blob), _described(blob)
                keys = about["keyframes"]
                ranges = hashlib.sha256(np.array([[k["offset"], k["length"]] for k in keys], "<i8").tobytes()).hexdigest()[:16]
                feature = f"{about['handler']}/{about['codec']} {about['seconds']:.3f}s {about['samples']} samples {len(keys)} keyframes {keys[0]['offset']}+{keys[0]['length']}..{keys[-1]['offset']}+{keys[-1]['length']} {ranges}"
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(blob), hashlib.sha256(blob).hexdigest(), feature))
            made = [pa.array(x, kind) for x, kind in zip(zip(*out), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *made], names=names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return files.mapInArrow(
        run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
