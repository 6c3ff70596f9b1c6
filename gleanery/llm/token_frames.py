"""Token ids in seekable files of independent zstandard frames.

A file is a run of frames, an index and a seek table:

* each frame is a complete zstandard frame with the ids of consecutive documents (32-bit little-endian);
  a frame is closed once it holds `FRAME_BYTES`, and a document larger than that has a frame of its own;
* a skippable frame holds the index: the number of ids of every document, in file order;
* a skippable frame holds the seek table of the public zstandard seekable format: for every frame its
  compressed size, its size and the low 32 bits of XXH64 of its content, then the number of frames.

A reader seeks to the end, reads the table and the index, and decompresses only the frames of the documents
it wants, checking each against its checksum.

Documents are dealt by range of id and sorted, so that shards in order hold ascending ids; each task writes its
shard under a name of its own, and a manifest (one row for each finished shard, written by Spark) says
which files count. A lost or repeated attempt leaves a file that no manifest names. Files are opened by URI
through Arrow file systems, so any store with one works.

Defined cases: a null text is an empty one and has only its end id. Null ids come first. Rows with equal ids are
ordered by a hash of the text. An empty table writes no shard and reads back as no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from gleanery.llm.common import partitions, slices, stored, table, text_or_empty
from gleanery.llm.tokens import encoder, vocabulary
from gleanery.session import shared_path

FRAME_BYTES = 1 << 18
#: Marks of the format (fixed values).
SEEK_MAGIC, SKIPPABLE_SEEK, SKIPPABLE_INDEX = 0x8F92EAB1, 0x184D2A5E, 0x184D2A50


class FrameWriter:
    """Appends documents to an open binary file."""

    def __init__(self, out, level: int = 3) -> None:  # noqa: ANN001
        self.out, self.packer = out, zstandard.ZstdCompressor(level=level)
        self.waiting: list[bytes] = []
        self.held, self.frames, self.lengths = 0, [], []

    def add(self, ids: bytes) -> None:
        if self.held and self.held + len(ids) > FRAME_BYTES:
            self._close_frame()
        self.waiting.append(ids)
        self.held += len(ids)
        self.lengths.append(len(ids) // 4)
        if self.held >= FRAME_BYTES:
            self._close_frame()

    def _close_frame(self) -> None:
        body = b"".join(self.waiting)
        packed = self.packer.compress(body)
        self.out.write(packed)
        self.frames.append((len(packed), len(body), xxhash.xxh64_intdigest(body) & 0xFFFFFFFF, len(self.waiting)))
        self.waiting, self.held = [], 0

    def finish(self) -> None:
        if self.waiting:
            self._close_frame()
        index = struct.pack("<I", len(self.frames)) + np.array([f[3] for f in self.frames], "<u4").tobytes() + np.array(self.lengths, "<u8").tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        rows = b"".join(struct.pack("<III", *f[:3]) for f in self.frames)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(rows) + 9) + rows + struct.pack("<IBI", len(self.frames), 0x80, SEEK_MAGIC))


class FrameReader:
    """Random access to the documents of one open file."""

    def __init__(self, file) -> None:  # noqa: ANN001
        self.file = file
        end = file.size()
        count, kind, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEK_MAGIC or kind != 0x80:
            raise ValueError("no seek table")
        table_at = end - 9 - 12 * count
        rows = np.frombuffer(self._at(table_at, 12 * count), "<u4").reshape(-1, 3).astype(np.int64)
        index_at = int(rows[:, 0].sum()) + 8  # the index is the one frame between the last packed one and the table
        index = self._at(index_at, table_at - 8 - index_at)
        per = np.frombuffer(index[4 : 4 + 4 * count], "<u4").astype(np.int64)
        self.lengths = np.frombuffer(index[4 + 4 * count :], "<u8").astype(np.int64)
        self.packed, self.sizes, self.sums = rows.T if count else np.zeros((3, 0), np.int64)
        self.places = np.cumsum(self.packed) - self.packed
        self.frame_of = np.repeat(np.arange(count), per)
        starts = np.cumsum(self.lengths) - self.lengths
        self.starts = starts
        self.within = (starts * 4) - np.repeat(np.cumsum(self.sizes) - self.sizes, per)

    def _at(self, place: int, size: int) -> bytes:
        if place < 0:
            raise ValueError("file cut short")
        self.file.seek(place)
        return self.file.read(size)

    def frame(self, n: int) -> bytes:
        body = zstandard.ZstdDecompressor().decompress(self._at(int(self.places[n]), int(self.packed[n])), max_output_size=int(self.sizes[n]))
        if xxhash.xxh64_intdigest(body) & 0xFFFFFFFF != self.sums[n]:
            raise ValueError(f"frame {n} fails its checksum")
        return body

    def documents(self, wanted: list[int] | None = None) -> Iterator[tuple[int, bytes]]:
        """(place, ids) of the wanted documents in file order; a frame is decompressed once, unwanted ones never."""
        last, body = -1, b""
        for i in range(len(self.lengths)) if wanted is None else sorted(wanted):
            if self.frame_of[i] != last:
                last = int(self.frame_of[i])
                body = self.frame(last)
            at = int(self.within[i])
            yield i, body[at : at + 4 * int(self.lengths[i])]


def _open(uri: str, mode: str):  # noqa: ANN202
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    if mode == "w":
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        return system.open_output_stream(path, compression=None)  # the frames are compressed already
    return system.open_input_file(path)


def write_token_files(docs: DataFrame, id_column: str, text_column: str, vocabulary_name: str, end_id: int, folder: str) -> DataFrame:
    """Write the shards; the stored manifest has (shard, path, ids list of documents in file order, n_ids)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), text_or_empty(text_column).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    kind = rows.schema["id"].dataType.simpleString()
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, path = TaskContext.get().partitionId(), f"{folder}/{uuid.uuid4().hex}.zst"
        tool, end = encoder(vocabulary(vocabulary_name)), struct.pack("<I", end_id)
        ids, total, writer, out = [], 0, None, None
        for batch in slices(batches, "text", keeps="pieces"):
            if writer is None:
                out = _open(path, "w")
                writer = FrameWriter(out)
            for made in tool.encode(batch.column("text").to_pylist()):
                writer.add(made + end)
                total += len(made) // 4 + 1
            ids.append(batch.column("id"))
        if writer is not None:
            writer.finish()
            out.close()
            named = pa.chunked_array(ids).combine_chunks()
            named = named if isinstance(named, pa.Array) else named.chunk(0)
            lists = pa.ListArray.from_arrays(pa.array([0, len(named)], pa.int32()), named)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([path]), lists, pa.array([total], pa.int64())], names=["shard", "path", "ids", "n_ids"])

    return stored(rows.mapInArrow(run, f"shard int, path string, ids array<{kind}>, n_ids long"), "token-manifest")


def read_token_files(manifest: DataFrame, id_column: str, tokens: bool = True) -> DataFrame:
    """(id, start, n_tokens, ids_crc32 and, if asked for, tokens) of every document, from the files."""
    spark = manifest.sparkSession
    # One number for each shard reaches the driver.
    before, starts = 0, {}
    for row in manifest.select("shard", "n_ids").orderBy("shard").collect():
        starts[row.shard] = before
        before += row.n_ids
    kind = manifest.schema["ids"].dataType.elementType.simpleString()
    rows = manifest.repartition(max(1, len(starts)), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                lead, named = starts[batch.column("shard")[at].as_py()], batch.column("ids")[at].values
                with _open(batch.column("path")[at].as_py(), "r") as file:
                    reader = FrameReader(file)
                    out: list[tuple] = []
                    first = held = 0
                    for i, ids in reader.documents():
                        out.append((lead + int(reader.starts[i]), len(ids) // 4, zlib.crc32(ids), np.frombuffer(ids, "<i4") if tokens else None))
                        held += len(ids)
                        if held > 8 << 20 or i + 1 == len(reader.lengths):
                            a, b, c, d = zip(*out)
                            yield pa.RecordBatch.from_arrays(
                                [named.slice(first, len(out)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.list_(pa.int32()))],
                                names=["id", "start", "n_tokens", "ids_crc32", "tokens"],
                            )
                            first, held, out = first + len(out), 0, []

    return rows.mapInArrow(run, f"id {kind}, start long, n_tokens long, ids_crc32 long, tokens array<int>").withColumnRenamed("id", id_column)


def op8_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and checksum in the token files, read back from them."""
    docs = table(spark, sf_dir, "documents")
    manifest = write_token_files(docs, "doc_id", "text", "word_bpe_49k.json", 1, shared_path(spark, "token-files"))
    return read_token_files(manifest, "doc_id", tokens=False).drop("tokens")
