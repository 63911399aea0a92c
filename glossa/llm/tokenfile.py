"""Token ids in binary files: independent zstandard frames, a trailing seek table, a checksum for each frame.

One frame holds one document's ids (little-endian, 2 bytes each, or 4 for a vocabulary above 65,536), so a reader
decompresses the documents it wants and no others. A file ends with the seek table of the zstandard seekable format: a
skippable frame with each frame's compressed size, decompressed size and the low 32 bits of its contents' XXH64, then the
number of frames, a descriptor and a magic number. A plain zstandard decoder reads such a file too, and skips the table.

Each task attempt writes a file of its own in the output folder, by way of pyarrow's file systems, and reports its
documents; the reported rows are written as the manifest, so a repeated or lost attempt leaves at most a file that the
manifest does not name, and those are removed when the manifest stands.

Edge cases: null and empty texts are documents of no tokens with an empty frame; a repeated row has a frame of its own;
an empty table writes an empty manifest and no file; very long texts are one long frame (below the format's 4 GB). Only
doc_id and text of the input are read, so other columns cannot clash. A damaged frame or table raises ValueError on reading.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import bpe, runtime

SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
LEVEL = 3
MANIFEST = "doc_id long, shard string, frame int, n_tokens int, width int, frame_bytes long, checksum long"


def checksum(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class Writer:
    """Appends frames to a binary stream; ``close`` writes the seek table."""

    def __init__(self, out, level: int = LEVEL) -> None:
        self.out, self.entries = out, []
        self.compressor = zstandard.ZstdCompressor(level=level, write_content_size=True)

    def add(self, data: bytes) -> tuple[int, int, int]:
        """(frame's number, its compressed size, its checksum)."""
        packed = self.compressor.compress(data)
        self.out.write(packed)
        self.entries.append((len(packed), len(data), checksum(data)))
        return len(self.entries) - 1, len(packed), self.entries[-1][2]

    def close(self) -> None:
        table = b"".join(struct.pack("<III", *e) for e in self.entries) + struct.pack("<IBI", len(self.entries), CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class Reader:
    """Reads chosen frames of a seekable binary stream by its seek table."""

    def __init__(self, source) -> None:
        self.source = source
        source.seek(0, 2)
        end = source.tell()
        if end < 17:
            raise ValueError("too short for a seek table")
        source.seek(end - 9)
        count, descriptor, magic = struct.unpack("<IBI", source.read(9))
        size = 9 + count * 12
        if magic != SEEKABLE or descriptor != CHECKSUMS or size + 8 > end:
            raise ValueError("no seek table with checksums")
        source.seek(end - size - 8)
        if struct.unpack("<II", source.read(8)) != (SKIPPABLE, size):
            raise ValueError("damaged seek table")
        self.table = np.frombuffer(source.read(count * 12), "<u4").reshape(count, 3)
        self.at = np.cumsum(np.append(0, self.table[:, 0].astype(np.int64)))
        self.decompressor = zstandard.ZstdDecompressor()

    def frame(self, number: int) -> bytes:
        self.source.seek(int(self.at[number]))
        packed, size, digest = (int(x) for x in self.table[number])
        try:
            data = self.decompressor.decompress(self.source.read(packed), max_output_size=max(size, 1))
        except zstandard.ZstdError as e:
            raise ValueError(f"frame {number} is damaged") from e
        if len(data) != size or checksum(data) != digest:
            raise ValueError(f"frame {number} is damaged")
        return data


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def write_tokens(docs: DataFrame, folder: str, vocabulary: str = bpe.VOCABULARY, level: int = LEVEL) -> DataFrame:
    """Writes the documents' token ids under ``folder`` (a URI that all executors see) and returns the manifest."""
    spark = docs.sparkSession
    runtime.small_batches(spark)
    table = bpe.read_ranks(vocabulary)
    width = 2 if max(table.values()) < 1 << 16 else 4
    ranks = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"part-{context.partitionId() if context else 0:06d}-{uuid.uuid4().hex[:12]}.zst"
        encoder, writer, stream = bpe.encoder_for(ranks.value), None, None
        for batch in runtime.parts(batches, 2048):
            ids, first = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
            if writer is None:
                system, path = _open(folder)
                system.create_dir(path, recursive=True)
                stream = system.open_output_stream(f"{path}/{name}", compression=None)  # by its name it would be compressed again
                writer = Writer(stream, level)
            packed = memoryview(ids.astype(f"<u{width}").tobytes())
            at = (first * width).tolist()
            frames = [writer.add(bytes(packed[a:b])) for a, b in zip(at, at[1:])]
            n = len(frames)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([name] * n), pa.array([f[0] for f in frames], pa.int32()), pa.array(np.diff(first).astype(np.int32)), pa.array([width] * n, pa.int32()), pa.array([f[1] for f in frames], pa.int64()), pa.array([f[2] for f in frames], pa.int64())],
                names=["doc_id", "shard", "frame", "n_tokens", "width", "frame_bytes", "checksum"],
            )
        if writer is not None:
            writer.close()
            stream.close()
        runtime.release()

    path = f"{folder.rstrip('/')}/manifest"
    docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, MANIFEST).write.parquet(path)
    manifest = spark.read.schema(MANIFEST).parquet(path)
    _remove_others(folder, manifest)
    return manifest


def _remove_others(folder: str, manifest: DataFrame) -> None:
    """Removes the files of attempts that failed; there is one name a task."""
    named = {r[0] for r in manifest.select("shard").distinct().collect()}
    system, path = _open(folder)
    for info in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        if info.is_file and info.base_name.endswith(".zst") and info.base_name not in named:
            system.delete_file(info.path)


def read_frames(folder: str, shard: str, frames: Iterable[int], width: int = 2) -> list[np.ndarray]:
    """The ids of the chosen frames of one file."""
    system, path = _open(folder)
    with system.open_input_file(f"{path}/{shard}") as f:
        reader = Reader(f)
        return [np.frombuffer(reader.frame(i), f"<u{width}") for i in frames]


def read_tokens(spark: SparkSession, folder: str, wanted: DataFrame | None = None) -> DataFrame:
    """``(doc_id, tokens)`` of all documents, or of those whose doc_id is in ``wanted``; each file's frames are read by one task."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder.rstrip('/')}/manifest")
    if wanted is not None:
        manifest = manifest.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = sorted(batch.to_pylist(), key=lambda r: (r["shard"], r["frame"]))
            out, at = [], 0
            while at < len(rows):
                end = at
                while end < len(rows) and rows[end]["shard"] == rows[at]["shard"]:
                    end += 1
                out += read_frames(folder, rows[at]["shard"], [r["frame"] for r in rows[at:end]], rows[at]["width"])
                at = end
            lists = pa.array([x.astype(np.int32) for x in out], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([r["doc_id"] for r in rows], pa.int64()), lists], names=["doc_id", "tokens"])

    return manifest.select("doc_id", "shard", "frame", "width").repartition("shard").mapInArrow(run, "doc_id long, tokens array<int>")


def binary_output(docs: DataFrame, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """The manifest of the documents' token files, written to a new folder in the session's shared one."""
    return write_tokens(docs, runtime.new_path(docs.sparkSession, "tokens"), vocabulary)
