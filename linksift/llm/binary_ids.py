"""Token ids on disk: fixed-width bit packing in blocks, with offsets for random access.

A file holds the ids of documents in ascending order of their key. Each id takes the fewest bits
that hold every id of the vocabulary; eight ids share ``bits`` whole bytes. Ids lie in blocks of
``BLOCK_IDS``. The footer has the offset of each block, and of each document its key, whether the
key is null, and where its ids end; the last twelve bytes give the footer's place and the mark.

A null text counts as empty (only the end id); a null key sorts first and reads back as null;
documents that share a key are kept apart, ordered by text; an empty table gives no files.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linksift.llm.tables import fresh_path, settle
from linksift.llm.tokens import Encoder

MARK = b"IDS1"
BLOCK_IDS = 1 << 16


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold the ids 0 to ``vocabulary`` - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids as a bit string, lowest bit first, filled with zeros to a multiple of eight ids."""
    lanes = np.zeros((-(-len(ids) // 8), 8), np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(lanes), bits), np.uint8)
    for lane in range(8):
        first, shift = divmod(lane * bits, 8)
        moved = lanes[:, lane] << np.uint64(shift)
        for at in range(first, (lane * bits + bits - 1) // 8 + 1):
            out[:, at] |= (moved >> np.uint64(8 * (at - first))).astype(np.uint8)
    return out.tobytes()


def unpack_bits(data: bytes, count: int, bits: int) -> np.ndarray:
    """The first ``count`` ids of a bit string, as unsigned 32-bit numbers."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, bits)
    out = np.empty((len(rows), 8), np.uint32)
    for lane in range(8):
        first, shift = divmod(lane * bits, 8)
        value = np.zeros(len(rows), np.uint64)
        for at in range(first, (lane * bits + bits - 1) // 8 + 1):
            value |= rows[:, at].astype(np.uint64) << np.uint64(8 * (at - first))
        out[:, lane] = (value >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
    return out.reshape(-1)[:count]


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder given as a URI or as a plain path."""
    return fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)


class Writer:
    """Writes one file block by block; only the last block and the document index are held."""

    def __init__(self, out, bits: int):
        self.out, self.bits = out, bits
        self.waiting, self.held, self.n_ids = [], 0, 0
        self.offsets, self.keys, self.ends = [], [], []
        self.place = 0

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.held += len(ids)
        self.n_ids += len(ids)
        self.keys.append(key)
        self.ends.append(self.n_ids)
        if self.held >= BLOCK_IDS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.uint32)
        stop = len(ids) if last else len(ids) - len(ids) % BLOCK_IDS
        for at in range(0, stop, BLOCK_IDS):
            data = pack_bits(ids[at : min(at + BLOCK_IDS, stop)], self.bits)
            self.offsets.append(self.place)
            self.out.write(data)
            self.place += len(data)
        self.waiting, self.held = [ids[stop:]], len(ids) - stop

    def close(self) -> None:
        self._flush(True)
        head = {"bits": self.bits, "block_ids": BLOCK_IDS, "blocks": len(self.offsets), "docs": len(self.keys)}
        text = json.dumps(head).encode()
        nulls = np.array([k is None for k in self.keys], np.uint8)
        keys = np.array([k or 0 for k in self.keys], "<i8")
        parts = [np.array(self.offsets, "<u8"), nulls, keys, np.array(self.ends, "<u8")]
        self.out.write(text.rjust(256) + b"".join(p.tobytes() for p in parts))
        self.out.write(np.array([self.place], "<u8").tobytes() + MARK)


class Reader:
    """Reads any range of ids, or the documents one by one, from one file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail = source.read_at(12, size - 12)
        if tail[8:] != MARK:
            raise ValueError("not a file of packed ids")
        self.end = int(np.frombuffer(tail[:8], "<u8")[0])
        data = source.read_at(size - 12 - self.end, self.end)
        head = json.loads(data[:256])
        self.bits, self.block_ids, docs, blocks = head["bits"], head["block_ids"], head["docs"], head["blocks"]
        at = 256
        self.offsets = np.append(np.frombuffer(data, "<u8", blocks, at), self.end).astype(np.int64)
        at += 8 * blocks
        self.nulls = np.frombuffer(data, np.uint8, docs, at).astype(bool)
        self.keys = np.frombuffer(data, "<i8", docs, at + docs)
        self.ends = np.frombuffer(data, "<u8", docs, at + 9 * docs).astype(np.int64)
        self.n_ids = int(self.ends[-1]) if docs else 0
        self.kept = (-1, np.empty(0, np.uint32))

    def block(self, number: int) -> np.ndarray:
        if self.kept[0] != number:
            start, stop = self.offsets[number : number + 2]
            count = min(self.block_ids, self.n_ids - number * self.block_ids)
            data = self.source.read_at(int(stop - start), int(start))
            self.kept = (number, unpack_bits(data, count, self.bits))
        return self.kept[1]

    def ids(self, start: int, stop: int) -> Iterator[np.ndarray]:
        """The ids of a range, block by block."""
        while start < stop:
            number, inside = divmod(start, self.block_ids)
            part = self.block(number)[inside : inside + stop - start]
            yield part
            start += len(part)


def write_ids(
    docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int, files: int, folder: str | None = None, added_tokens: bool = False
) -> DataFrame:
    """Encode every document, write the files and return one row per file.

    Documents are dealt by ranges of ``doc_id`` to ``files`` files (text breaks ties), and each
    task writes its file under a name of its own before it takes its final name, so a task that
    runs again replaces it by the same bytes. Returns (file int, path string, docs, ids long).
    """
    folder = folder or fresh_path(docs.sparkSession, "ids")
    bits = bits_for(vocabulary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, out = Encoder(tokenizer, added_tokens), None, None
        system, root = file_system(folder)
        number = TaskContext.get().partitionId()
        final, own = f"{root}/ids-{number:06d}.bin", f"{root}/.{uuid.uuid4().hex}"
        for batch in batches:
            if writer is None and batch.num_rows:
                system.create_dir(root, recursive=True)
                out = system.open_output_stream(own)
                writer = Writer(out, bits)
            for key, text in zip(batch.column("doc_id"), batch.column("text")):
                ids = np.frombuffer(encoder.encode(text.as_py()), "<u4")
                writer.add(key.as_py(), np.append(ids, np.uint32(end_id)))
        if writer is not None:
            writer.close()
            out.close()
            system.move(own, final)
            row = {"file": [number], "path": [final], "docs": [len(writer.keys)], "ids": [writer.n_ids]}
            yield pa.RecordBatch.from_pydict(row, schema=rows)

    rows = pa.schema([("file", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])
    dealt = docs.select("doc_id", "text").repartitionByRange(files, "doc_id", F.xxhash64("text"))
    ordered = dealt.sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    written = ordered.mapInArrow(write, "file int, path string, docs long, ids long")
    return settle(written.withColumn("folder", F.lit(folder)), "id-files")


def read_documents(files: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens and the checksum of its ids.

    ``start`` counts the ids of all documents before it. Only the list of files, one row each,
    passes through the driver.
    """
    spark = files.sparkSession
    listed = sorted(tuple(r) for r in files.select("file", "path", "ids", "folder").collect())
    before = np.cumsum([0, *(ids for _, _, ids, _ in listed)]).tolist()
    starts = [(path, start, folder) for (_, path, _, folder), start in zip(listed, before)]
    schema = "path string, start long, folder string"
    todo = spark.createDataFrame(starts, schema).repartition(max(1, len(starts)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.to_pylist():
                system, _ = file_system(one["folder"])
                with system.open_input_file(one["path"]) as source:
                    reader = Reader(source)
                    begins = np.append(0, reader.ends)
                    sums = np.empty(len(reader.ends), np.int64)
                    for at in range(len(sums)):
                        crc = 0
                        for ids in reader.ids(int(begins[at]), int(begins[at + 1])):
                            crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                        sums[at] = crc
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(reader.keys, pa.int64(), mask=reader.nulls),
                            pa.array(begins[:-1] + one["start"], pa.int64()),
                            pa.array(np.diff(begins), pa.int64()),
                            pa.array(sums, pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return todo.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
