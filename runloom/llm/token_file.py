"""Token-id files: independent zstandard frames with a trailing seek table.

A file holds, in this order:

* data frames. Every document starts a new frame; one of more than ``FRAME_IDS`` ids goes on
  in further frames. A frame is a complete zstandard frame over little-endian unsigned
  32-bit ids.
* one skippable frame with the index: number of documents (u64), then for each the id (i64),
  whether it is null (u8), its first frame (u32) and its number of ids (u64), column by column.
* one skippable frame with the seek table of the public seekable format: compressed size,
  decompressed size and checksum (low 32 bits of XXH64 of the decompressed bytes) of every
  frame before it, the number of frames, a descriptor byte and the closing magic number.

Any zstandard program can decompress the whole file; a reader of one document touches the two
tables and that document's frames.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom.llm.common import BATCH_ROWS, durable, partitions, utf8
from runloom.llm.tokens import WordEncoder, pack
from runloom.session import new_folder

# Fixed values of the public formats.
INDEX_MAGIC = 0x184D2A51
TABLE_MAGIC = 0x184D2A5E
CLOSING_MAGIC = 0x8F92EAB1
WITH_CHECKSUMS = 0x80

FRAME_IDS = 1 << 20
LEVEL = 3
# A file is closed when it holds so many documents, or so many bytes of ids, whatever comes first:
# that bounds its two tables, which writer and reader hold whole.
FILE_DOCUMENTS = 1 << 18
FILE_BYTES = 1 << 30

MANIFEST = pa.schema(
    [
        ("shard", pa.int64()),
        ("number", pa.int64()),
        ("path", pa.string()),
        ("documents", pa.int64()),
        ("ids", pa.int64()),
    ]
)
DIGESTS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("n_tokens", pa.int64()),
        ("ids_crc32", pa.int64()),
    ]
)


def checksum(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class Writer:
    """Appends documents to one file; ``close`` writes the tables."""

    def __init__(self, path: str):
        import zstandard

        system, name = fs.FileSystem.from_uri(path)
        self.out = system.open_output_stream(name, compression=None)
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.entries: list[tuple[int, int, int]] = []
        self.doc_ids: list[int | None] = []
        self.first: list[int] = []
        self.counts: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.first.append(len(self.entries))
        self.counts.append(len(ids) // 4)
        for at in range(0, len(ids), 4 * FRAME_IDS):
            piece = ids[at : at + 4 * FRAME_IDS]
            frame = self.zstd.compress(piece)
            self.out.write(frame)
            self.entries.append((len(frame), len(piece), checksum(piece)))

    def close(self) -> None:
        index = struct.pack("<Q", len(self.doc_ids))
        index += np.array([x or 0 for x in self.doc_ids], "<i8").tobytes()
        index += bytes(x is None for x in self.doc_ids)
        index += np.array(self.first, "<u4").tobytes() + np.array(self.counts, "<u8").tobytes()
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        self.entries.append((len(index) + 8, 0, checksum(b"")))
        table = np.array(self.entries, "<u4").tobytes()
        table += struct.pack("<IBI", len(self.entries), WITH_CHECKSUMS, CLOSING_MAGIC)
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(table)) + table)
        self.out.close()


class Reader:
    """Random access to the documents of one file; every frame read is checked."""

    def __init__(self, path: str):
        import zstandard

        system, name = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(name)
        self.zstd = zstandard.ZstdDecompressor()
        size = self.file.size()
        frames, descriptor, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != CLOSING_MAGIC or not descriptor & WITH_CHECKSUMS:
            raise ValueError(f"{path}: no seek table with checksums at its end")
        self.table = np.frombuffer(self._at(size - 9 - 12 * frames, 12 * frames), "<u4")
        self.table = self.table.reshape(frames, 3).astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        index = self._at(int(self.offsets[-2]) + 8, int(self.table[-1, 0]) - 8)
        (n,) = struct.unpack_from("<Q", index)
        ids = np.frombuffer(index, "<i8", n, 8)
        null = np.frombuffer(index, "u1", n, 8 + 8 * n)
        self.doc_ids = [None if z else int(x) for x, z in zip(ids, null)]
        self.first = np.append(np.frombuffer(index, "<u4", n, 8 + 9 * n), frames - 1)
        self.counts = np.frombuffer(index, "<u8", n, 8 + 13 * n).astype(np.int64)

    def _at(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(length)

    def frame(self, k: int) -> bytes:
        packed, plain, want = map(int, self.table[k])
        data = self.zstd.decompress(self._at(int(self.offsets[k]), packed), max_output_size=plain)
        if len(data) != plain or checksum(data) != want:
            raise ValueError(f"frame {k} does not match its checksum")
        return data

    def read(self, k: int) -> bytes:
        """Ids of the k-th document; only its own frames are decompressed."""
        return b"".join(map(self.frame, range(int(self.first[k]), int(self.first[k + 1]))))


def _write_shards(
    folder: str, tokenizer: str, end_id: int, file_documents: int, file_bytes: int
) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, end, number = None, pack([end_id]), 0
        shard = TaskContext.get().partitionId()

        def closed() -> pa.RecordBatch:
            writer.close()
            row = [[shard], [number], [path], [len(writer.doc_ids)], [total]]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(row, MANIFEST)], schema=MANIFEST
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                if writer is None:
                    # A name of its own per attempt: what a lost attempt left is never listed.
                    path = f"{folder}/ids-{shard:06d}-{number:06d}-{uuid.uuid4().hex}.zst"
                    system, name = fs.FileSystem.from_uri(folder)
                    system.create_dir(name, recursive=True)
                    writer, encoder, total = Writer(path), WordEncoder.of_worker(tokenizer), 0
                ids = encoder.encode(text) + end
                writer.add(doc_id, ids)
                total += len(ids) // 4
                if len(writer.doc_ids) >= file_documents or 4 * total >= file_bytes:
                    yield closed()
                    writer, number = None, number + 1
        if writer is not None:
            yield closed()

    return write


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    doc_id: str = "doc_id",
    text: str = "text",
    file_documents: int = FILE_DOCUMENTS,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Encode every text and write the ids in ascending ``doc_id`` order; returns the manifest.

    One row per file: ``shard`` and ``number`` in it (files in this order hold the documents in
    order), ``path``, ``documents``, ``ids``. The next file is begun when one holds
    ``file_documents`` documents or ``file_bytes`` of ids; a document lies in one file. Null texts are empty; a null id sorts first; rows with equal ids
    keep all their rows, ordered by text. Other columns are not read. The files lie in the
    shared folder; the manifest names only files of attempts that ended well.
    """
    folder = new_folder(docs.sparkSession, "token-files")
    placed = (
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    return durable(
        placed.mapInArrow(
            _write_shards(folder, tokenizer, end_id, file_documents, file_bytes),
            "shard long, number long, path string, documents long, ids long",
        )
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            reader, rows = Reader(path), []
            for k, (doc_id, count) in enumerate(zip(reader.doc_ids, reader.counts.tolist())):
                rows.append((doc_id, start, count, zlib.crc32(reader.read(k))))
                start += count
                if len(rows) == BATCH_ROWS:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows), DIGESTS)], schema=DIGESTS
    )


def read_digests(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files.

    ``start`` counts the ids of all documents before it. The running sum is over one row per
    file.
    """
    before = Window.orderBy("shard", "number").rowsBetween(Window.unboundedPreceding, -1)
    start: Column = F.coalesce(F.sum("ids").over(before), F.lit(0))
    files = manifest.select("path", start.alias("start"))
    return files.repartition(partitions(manifest), "path").mapInArrow(
        _digests, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
