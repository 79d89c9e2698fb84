"""Files of token ids in shuffled planes.

A file holds the ids of a range of documents, in order of doc_id:

    MAGIC, chunks, index, length of the index (8 bytes, little-endian), MAGIC

A chunk is BLOCK ids (fewer in the last), transposed into planes - four byte planes, or 32 bit planes - each
compressed with zstandard; a plane of zeros takes no room. The index is JSON, compressed: the offset, number of ids
and plane lengths of each chunk, and the places of two more chunks that hold doc_ids and ids per document in planes of
their own. Any chunk can be read and decoded without the others.

Files are written to the shared folder through Arrow's file systems under a name with the attempt's number and then
moved; the manifest, one row a file, is made of finished tasks' rows only, so attempts that were lost leave no rows.

Edge cases: a null or empty text is its end id alone; rows with one doc_id follow each other, ordered by text; a null
doc_id comes first and is kept as null; all rows of one doc_id are in one file; only doc_id and text are read, so other
columns' names can't clash; an empty table gives no file and no rows. What follows the files is a row a file: the sum over
the files before it is one window, and its rows, of 16 bytes, are broadcast; a file is a task's range of documents, so there are as
many as the shuffle has partitions, thousands, not millions.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from . import ids as tokens
from .common import cut, new_path

MAGIC, BLOCK, END_ID, LEVEL = b"SLPLANE1", 1 << 16, 2, 3
MANIFEST = "shard long, file string, n_docs long, n_ids long"


def to_planes(values: np.ndarray, bits: bool = False) -> list[bytes]:
    """The byte planes, or bit planes, of little-endian integers."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize)
    if bits:
        return [p.tobytes() for p in np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1)]
    return [p.tobytes() for p in raw.T]


def from_planes(planes: list[bytes], n: int, dtype: np.dtype, bits: bool = False) -> np.ndarray:
    if bits:
        rows = np.array([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], dtype=np.uint8)
        return np.ascontiguousarray(np.packbits(rows.T, axis=1, bitorder="little")).view(dtype).reshape(n)
    return np.ascontiguousarray(np.array([np.frombuffer(p, np.uint8) for p in planes]).T).view(dtype).reshape(n)


class Writer:
    def __init__(self, out, bits: bool = False):
        import zstandard

        self.out, self.bits, self.zip = out, bits, zstandard.ZstdCompressor(level=LEVEL).compress
        self.at, self.chunks, self.docs, self.counts, self.held, self.size = 0, [], [], [], [], 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _chunk(self, values: np.ndarray, bits: bool) -> list:
        entry = [self.at, len(values), []]
        for plane in to_planes(values, bits):
            packed = self.zip(plane) if any(plane) else b""
            entry[2].append(len(packed))
            self._put(packed)
        return entry

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.counts.append(len(ids))
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= 8 * BLOCK:
            self._blocks(False)

    def _blocks(self, last: bool) -> None:
        ids = np.concatenate([*self.held, np.zeros(0, tokens.ID)])
        end = len(ids) if last else len(ids) - len(ids) % BLOCK
        for i in range(0, end, BLOCK):
            self.chunks.append(self._chunk(ids[i : min(i + BLOCK, end)], self.bits))
        self.held, self.size = [ids[end:]], len(ids) - end

    def close(self) -> None:
        import zstandard

        self._blocks(True)
        nulls = [i for i, d in enumerate(self.docs) if d is None]
        doc_chunk = self._chunk(np.array([d or 0 for d in self.docs], "<i8"), False)
        count_chunk = self._chunk(np.array(self.counts, "<u4"), False)
        index = zstandard.ZstdCompressor().compress(json.dumps({"bits": self.bits, "chunks": self.chunks, "docs": doc_chunk, "counts": count_chunk, "nulls": nulls}).encode())
        self._put(index + len(index).to_bytes(8, "little") + MAGIC)


class Reader:
    """source: a seekable binary file of `size` bytes."""

    def __init__(self, source, size: int):
        import zstandard

        self.source, self.unzip = source, zstandard.ZstdDecompressor().decompress
        n = len(MAGIC)
        tail = self._read(size - n - 8, n + 8)
        if tail[8:] != MAGIC or self._read(0, n) != MAGIC:
            raise ValueError("not a file of id planes")
        length = int.from_bytes(tail[:8], "little")
        self.index = json.loads(self.unzip(self._read(size - n - 8 - length, length)))

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _chunk(self, entry: list, dtype, bits: bool) -> np.ndarray:
        at, n, lengths = entry
        data, planes, width = self._read(at, sum(lengths)), [], (n + 7) // 8 if bits else n
        for length in lengths:
            planes.append(self.unzip(data[:length]) if length else bytes(width))
            data = data[length:]
        return from_planes(planes, n, np.dtype(dtype), bits) if n else np.zeros(0, dtype)

    def __len__(self) -> int:
        return len(self.index["chunks"])

    def ids(self, chunk: int) -> np.ndarray:
        return self._chunk(self.index["chunks"][chunk], tokens.ID, self.index["bits"])

    def documents(self) -> Iterator[tuple[int | None, int]]:
        """(doc_id, number of ids)."""
        nulls = set(self.index["nulls"])
        docs, counts = self._chunk(self.index["docs"], "<i8", False), self._chunk(self.index["counts"], "<u4", False)
        for i, (d, n) in enumerate(zip(docs.tolist(), counts.tolist())):
            yield (None if i in nulls else d), n

    def pieces(self) -> Iterator[tuple[int | None, int, list[np.ndarray]]]:
        """doc_id, number of ids, and the ids in parts, one chunk in memory at a time."""
        held, chunk = np.zeros(0, tokens.ID), 0
        for doc, n in self.documents():
            parts, left = [], n
            while left:
                if not len(held):
                    held, chunk = self.ids(chunk), chunk + 1
                parts.append(held[:left])
                held, left = held[left:], left - len(parts[-1])
            yield doc, n, parts


def write_ids(docs: DataFrame, folder: str, path: str, end: int = END_ID, bits: bool = False) -> DataFrame:
    """Writes the files and gives their manifest, ordered by shard."""

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"{base}/part-{task.partitionId():06d}-{task.taskAttemptId()}.ids"
        n_docs = n_ids = 0
        out = None
        for doc, ids in tokens.encoded(batches, path, end):
            if out is None:
                out = store.open_output_stream(f"{name}.open")
                writer = Writer(out, bits)
            writer.add(doc, ids)
            n_docs, n_ids = n_docs + 1, n_ids + len(ids)
        if out is not None:
            writer.close()
            out.close()
            store.move(f"{name}.open", name)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (task.partitionId(), name, n_docs, n_ids)], names=["shard", "file", "n_docs", "n_ids"])

    return cut(tokens.in_order(docs).mapInArrow(run, MANIFEST))


def read_ids(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of the files: a task for each file, as the manifest is dealt."""

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for b in batches:
            for shard, file in zip(b.column("shard").to_pylist(), b.column("file").to_pylist()):
                with store.open_input_file(file) as source:
                    rows, start = [], 0
                    for doc, n, parts in Reader(source, source.size()).pieces():
                        crc = 0
                        for part in parts:
                            crc = zlib.crc32(part.tobytes(), crc)
                        rows.append((shard, doc, start, n, crc))
                        start += n
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["shard", "doc_id", "local", "n_tokens", "ids_crc32"])

    found = manifest.mapInArrow(run, "shard long, doc_id long, local long, n_tokens long, ids_crc32 long")
    # One row a file: the ids of all files before it.
    before = manifest.select("shard", F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return found.join(F.broadcast(before), "shard").select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def stored(docs: DataFrame, path: str, end: int = END_ID) -> DataFrame:
    """write_ids to a fresh folder in the shared place, then read_ids."""
    folder = new_path(docs.sparkSession, "ids")
    return read_ids(write_ids(docs, folder, path, end), folder)
