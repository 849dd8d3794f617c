"""Token ids in fixed-width bit-packed files: a data source ``packed_ids`` with random access.

Each task writes one file; the driver commits a manifest that lists the files of the attempts that won,
so a lost or repeated task leaves at most an unlisted file. A file holds blocks of ``BLOCK`` ids, each id
in the fewest bits that hold the vocabulary (little-endian bit order; a block starts on a byte), then the
block offsets, then the document table, then a footer:

    magic "WFIDS001" | blocks | block offsets u64 | doc_id i64 | has doc_id u8 | first id of each document u64
    | footer: bits u32, block u32, blocks u64, documents u64, ids u64, magic

Any id is at a computable place, so a block, a document or a range of ids is read without what precedes it.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from wakeframe.llm.stored import in_small_batches
from wakeframe.llm.tokens import encoded, vocabulary_size
from wakeframe.session import qualified

MAGIC = b"WFIDS001"
FOOTER = "<IIQQQ8s"
FOOTER_BYTES = struct.calcsize(FOOTER)
BLOCK = 8192
MANIFEST = "manifest.json"
READ_IDS = 1 << 20


def id_bits(vocabulary: int) -> int:
    """Fewest bits that hold the ids 0 .. vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, least significant first; the last byte is filled with zeros."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {ids.max()} needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    wide = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(wide[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The first ``n`` ids of packed bytes."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = flat
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def _place(url: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(url) if "://" in url else (fs.LocalFileSystem(), url.removeprefix("file:"))


class PackedFile:
    """One file, opened for random access."""

    def __init__(self, url: str):
        system, path = _place(url)
        self.file = system.open_input_file(path)
        size = self.file.size()
        self.bits, self.block, blocks, docs, self.ids, magic = struct.unpack(FOOTER, self.file.read_at(FOOTER_BYTES, size - FOOTER_BYTES))
        if magic != MAGIC:
            raise ValueError(f"{url} is no file of packed ids")
        at = size - FOOTER_BYTES - 8 * (blocks + 1) - 17 * docs - 8
        table = self.file.read_at(size - FOOTER_BYTES - at, at)
        self.offsets = np.frombuffer(table, "<u8", blocks + 1).astype(np.int64)
        at = 8 * (blocks + 1)
        self.doc_id = np.frombuffer(table, "<i8", docs, at)
        self.known = np.frombuffer(table, np.uint8, docs, at + 8 * docs).astype(bool)
        self.first = np.frombuffer(table, "<u8", docs + 1, at + 9 * docs).astype(np.int64)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` .. ``stop`` - 1 of the file."""
        if stop <= start:
            return np.empty(0, np.uint32)
        a, z = start // self.block, -(-stop // self.block)
        data = self.file.read_at(int(self.offsets[z] - self.offsets[a]), int(self.offsets[a]))
        n = min(z * self.block, self.ids) - a * self.block
        if self.block * self.bits % 8 == 0:
            ids = unpack(data, n, self.bits)
        else:  # a block starts on a byte, so blocks are unpacked one by one
            cut = self.offsets[a : z + 1] - self.offsets[a]
            ids = np.concatenate([unpack(data[cut[k] : cut[k + 1]], min(self.block, n - k * self.block), self.bits) for k in range(z - a)])
        return ids[start - a * self.block : stop - a * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.first[k]), int(self.first[k + 1]))


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, bits: int, block: int, tokenizer: str = ""):
        self.path, self.bits, self.block, self.tokenizer = path.rstrip("/"), bits, block, tokenizer

    def _parts(self, iterator: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
        """(keys, ids of each) of the rows, in parts of some megabytes; texts are encoded here."""
        for batch in iterator:
            keys = batch.column(0)
            if not self.tokenizer:
                yield keys, [np.frombuffer(data.as_buffer() or b"", "<u4") for data in batch.column(1)]
                continue
            done, held, size = 0, [], 0
            for k, data in encoded(self.tokenizer, batch.column(1)):
                held.append(np.frombuffer(data, "<u4"))
                size += len(data)
                if size >= 4 << 20:
                    yield keys[done : k + 1], held
                    done, held, size = k + 1, [], 0
            yield keys[done:], held

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.ids"
        system, base = _place(self.path)
        file, offsets, rest = None, [len(MAGIC)], np.empty(0, np.uint32)
        doc_id, known, first, total = [], [], [0], 0

        def flush(ids):
            data = pack(ids, self.bits)
            file.write(data)
            offsets.append(offsets[-1] + len(data))

        for keys, pieces in self._parts(iterator):
            if not pieces:
                continue
            if file is None:
                system.create_dir(base, recursive=True)
                file = system.open_output_stream(f"{base}/{name}")
                file.write(MAGIC)
            known.append(np.asarray(keys.is_valid().to_numpy(zero_copy_only=False), np.uint8))
            doc_id.append(keys.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
            parts = [rest, *pieces]
            for ids in pieces:
                total += len(ids)
                first.append(total)
            ids = np.concatenate(parts)
            whole = len(ids) // self.block * self.block
            for k in range(0, whole, self.block):
                flush(ids[k : k + self.block])
            rest = ids[whole:].copy()
        if file is None:
            return WriterCommitMessage()
        if len(rest):
            flush(rest)
        docs = len(first) - 1
        file.write(np.array(offsets, "<u8").tobytes())
        file.write(np.concatenate(doc_id).tobytes() + np.concatenate(known).tobytes() + np.array(first, "<u8").tobytes())
        file.write(struct.pack(FOOTER, self.bits, self.block, len(offsets) - 1, docs, total, MAGIC))
        file.close()
        message = WriterCommitMessage()
        message.file = (part, name, docs, total)
        return message

    def commit(self, messages) -> None:
        files, start = [], 0
        for _, name, docs, ids in sorted(m.file for m in messages if m is not None and hasattr(m, "file")):
            files.append({"file": name, "start": start, "documents": docs, "ids": ids})
            start += ids
        system, base = _place(self.path)
        system.create_dir(base, recursive=True)
        with system.open_output_stream(f"{base}/{MANIFEST}") as out:
            out.write(json.dumps({"bits": self.bits, "block": self.block, "ids": start, "files": files}).encode())

    def abort(self, messages) -> None:
        """Files of a failed job stay unlisted; without a manifest the folder is no table."""


class _Part(InputPartition):
    def __init__(self, file: str, start: int):
        self.file, self.start = file, start


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def partitions(self):
        return [_Part(f"{self.path}/{f['file']}", f["start"]) for f in manifest(self.path)["files"]] or [_Part("", 0)]

    def read(self, partition):
        if not partition.file:
            return
        f = PackedFile(partition.file)
        k, docs = 0, len(f.doc_id)
        while k < docs:
            stop = max(k + 1, int(np.searchsorted(f.first, f.first[k] + READ_IDS, "right")) - 1)
            at = f.first[k : stop + 1]
            data = f.read(int(at[0]), int(at[-1])).astype("<u4").tobytes()
            places = pa.py_buffer(((at - at[0]) * 4).astype(np.int32).tobytes()) if 4 * (at[-1] - at[0]) < 1 << 31 else None
            if places is None:
                ids = pa.array([data[4 * (a - at[0]) : 4 * (z - at[0])] for a, z in zip(at, at[1:])], pa.binary())
            else:
                ids = pa.Array.from_buffers(pa.binary(), stop - k, [None, places, pa.py_buffer(data)])
            keys = pa.array(f.doc_id[k:stop], pa.int64(), mask=~f.known[k:stop])
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(partition.start + at[:-1], pa.int64()), pa.array(np.diff(at), pa.int64()), ids],
                ["doc_id", "start", "n_tokens", "ids"],
            )
            k = stop


class PackedIds(DataSource):
    """``spark.read.format("packed_ids").load(folder)``; the writer takes (doc_id, ids) in order, option ``bits``.

    With option ``tokenizer`` it takes (doc_id, text) and encodes the texts itself, so a task runs one Python worker.
    """

    @classmethod
    def name(cls):
        return "packed_ids"

    def schema(self):
        return "doc_id bigint, start bigint, n_tokens bigint, ids binary"

    def reader(self, schema):
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], int(self.options["bits"]), int(self.options.get("block", BLOCK)), self.options.get("tokenizer", ""))


def manifest(folder: str) -> dict:
    system, base = _place(folder.rstrip("/"))
    with system.open_input_stream(f"{base}/{MANIFEST}") as f:
        return json.loads(f.read())


def write_ids(pieces: DataFrame, folder: str, vocabulary: int, block: int = BLOCK) -> None:
    """Write (doc_id, ids BINARY of little-endian u32), already in file order, at ``folder``.

    An id that the vocabulary does not hold fails the job. An empty frame leaves a manifest without files.
    """
    spark = pieces.sparkSession
    spark.dataSource.register(PackedIds)
    rows = in_small_batches(pieces.select(pieces["doc_id"].cast("bigint").alias("doc_id"), "ids"))
    rows.write.format("packed_ids").mode("append").option("bits", id_bits(vocabulary)).option("block", block).save(folder)


def write_texts(docs: DataFrame, folder: str, tokenizer: str, block: int = BLOCK) -> None:
    """Encode (doc_id, text), already in file order, with a tokenizer file and write the ids at ``folder``.

    Each document ends with id 0; a null text has only that.
    """
    spark = docs.sparkSession
    spark.dataSource.register(PackedIds)
    rows = in_small_batches(docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text"))
    options = {"bits": id_bits(vocabulary_size(tokenizer)), "block": block, "tokenizer": tokenizer}
    rows.write.format("packed_ids").mode("append").options(**options).save(qualified(spark, folder))


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids BINARY): start counts the ids of all documents before, over all files."""
    spark.dataSource.register(PackedIds)
    return spark.read.format("packed_ids").load(qualified(spark, folder))


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents by ascending id (nulls first, equal ids by text): ranges over partitions, sorted inside.

    Equal ids meet in one partition, so they follow one another in the files too.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
