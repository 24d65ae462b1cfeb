"""Token sequences in files of length-delimited binary records, written and read by Spark as a data source.

A record is framed as: length (unsigned 64 bits), masked checksum of those 8 bytes (32 bits), data, masked checksum of the data
(32 bits), all little-endian. The checksum is CRC-32C; masked: rotated right by 15 bits, plus 0xa282ead8. The data are doc_id
(64 bits), flags (32 bits; 1: doc_id is null; 2: narrow) and the ids (32 bits each, or 16 in a narrow record, which all ids below 65536 make). Beside each data file lies an index file with 32 bytes a
record: offset, size of the frame, ids before it in the file, number of ids (64 bits each). A manifest lists the files in order.

A task writes files of names of its own; only the manifest, written last and put in place by one rename, says which of them count. So
a task that is lost and run again, or twice at once, leaves files that nobody reads. Files are read in slices of SLICE bytes, and with
the option `seed` slices come in another order and so do the records within each, found through the index.

Folders are addresses that `pyarrow.fs` opens (local, hdfs, s3, gs).

Defined results of `write_documents`: a null text counts as empty, so it has the end id alone; repeated rows are written each; null doc_ids
come first; equal doc_ids are ordered by text; a doc_id may hold most rows, as the ranges are cut within it too; an empty table
makes a manifest without records; further columns are left out.
"""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from palimpsest.llm._shared import ready

# Fixed values of the framing: the reflected polynomial and what masking adds.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
END_ID, FILE_BYTES, SLICE, BATCH = 1, 256 << 20, 64 << 20, 4 << 20
FRAME, HEAD = 16, 12
MANIFEST = "manifest.json"
WRITTEN = "doc_id long, ids binary"
READ = "file string, record long, doc_id long, start long, n_tokens long, ids binary"
INDEX = np.dtype([("offset", "<u8"), ("size", "<u8"), ("before", "<u8"), ("n", "<u8")])
_BLOCK, _UNIT = 128, 16


@functools.cache
def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


@functools.cache
def _zeros(n: int) -> np.ndarray:
    """What n zero bytes (a power of two) do to a register, as a table for each of its four bytes: the map is linear."""
    if n == 1:
        each = np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], dtype=np.uint32)
        return (each >> 8) ^ _byte_table()[each & 255]
    half = _zeros(n // 2)
    return _after(half, half)


def _after(table: np.ndarray, register: np.ndarray) -> np.ndarray:
    return table[0][register & 255] ^ table[1][(register >> 8) & 255] ^ table[2][(register >> 16) & 255] ^ table[3][register >> 24]


def _after_many(register: np.ndarray, units: np.ndarray, unit: int) -> np.ndarray:
    """Each register after its own number of units of `unit` zero bytes."""
    register, bit = register.copy(), 0
    while units.size and int(units.max()) >> bit:
        on = (units >> bit & 1).astype(bool)
        register[on] = _after(_zeros(unit << bit), register[on])
        bit += 1
    return register


@functools.cache
def _pair_tables() -> list[np.ndarray]:
    """For each of the 8 byte pairs of a unit, what it adds to the register at the unit's end."""
    pairs = np.arange(65536, dtype=np.uint32)
    last = _after(_zeros(1), _byte_table()[pairs & 255]) ^ _byte_table()[pairs >> 8]
    tables = [last]
    for _ in range(7):
        tables.append(_after(_zeros(2), tables[-1]))
    return tables[::-1]


def crc32c(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of each part, all parts at once: blocks front-padded with zeros, put together by the linearity of the register."""
    sizes = np.fromiter((len(p) for p in parts), dtype=np.int64, count=len(parts))
    blocks = -(-sizes // _BLOCK)
    ends = np.cumsum(blocks)
    out = np.zeros(len(parts), dtype=np.uint32)
    if blocks.any():
        padded = bytearray(int(ends[-1]) * _BLOCK)
        for part, end, size in zip(parts, (ends * _BLOCK).tolist(), sizes.tolist(), strict=True):
            padded[end - size : end] = part
        pairs = np.frombuffer(padded, dtype="<u2").reshape(-1, 8)
        register = np.bitwise_xor.reduce([t[pairs[:, n]] for n, t in enumerate(_pair_tables())])
        width = _UNIT
        while width < _BLOCK:
            register = _after(_zeros(width), register[0::2]) ^ register[1::2]
            width *= 2
        behind = np.repeat(ends, blocks) - 1 - np.arange(len(register))
        register = _after_many(register, behind, _BLOCK)
        some = blocks > 0
        out[some] = np.bitwise_xor.reduceat(register, (ends - blocks)[some])
    start = _after_many(np.full(len(parts), 0xFFFFFFFF, dtype=np.uint32), sizes, 1)
    return out ^ start ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """A checksum that may stand within data that are checksummed again."""
    return ((crc >> 15) | (crc << 17)) + np.uint32(MASK)


def _files(path: str):
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def _data(doc_id: int | None, ids: bytes) -> bytes:
    wide = np.frombuffer(ids, dtype="<u4")
    narrow = wide.max(initial=0) < 65536
    flags = (doc_id is None) + 2 * bool(narrow)
    return (doc_id or 0).to_bytes(8, "little", signed=True) + flags.to_bytes(4, "little") + (wide.astype("<u2").tobytes() if narrow else ids)


def _ids(data: bytes) -> bytes:
    return np.frombuffer(data, dtype="<u2", offset=HEAD).astype("<u4").tobytes() if data[8] & 2 else data[HEAD:]


def frames(doc_ids: list[int | None], ids: list[bytes]) -> list[bytes]:
    """The framed record of each sequence."""
    data = list(map(_data, doc_ids, ids))
    lengths = [len(d).to_bytes(8, "little") for d in data]
    of_length, of_data = masked(crc32c(lengths)).astype("<u4"), masked(crc32c(data)).astype("<u4")
    return [n + a.tobytes() + d + b.tobytes() for n, a, d, b in zip(lengths, of_length, data, of_data, strict=True)]


def unframed(block: bytes, sizes: list[int]) -> list[bytes]:
    """The data of frames of the given sizes that follow each other in block; a frame that doesn't fit its checksums is an error."""
    at = np.concatenate(([0], np.cumsum(np.array(sizes, dtype=np.int64)))).tolist()
    if at[-1] != len(block):
        raise ValueError("records are cut short")
    view = memoryview(block)
    lengths = [bytes(view[a : a + 8]) for a in at[:-1]]
    data = [bytes(view[a + HEAD : b - 4]) for a, b in zip(at, at[1:], strict=False)]
    said = np.array([[int.from_bytes(view[a + 8 : a + HEAD], "little"), int.from_bytes(view[b - 4 : b], "little")] for a, b in zip(at, at[1:], strict=False)], dtype=np.uint32).reshape(-1, 2)
    right = (masked(crc32c(lengths)) == said[:, 0]) & (masked(crc32c(data)) == said[:, 1])
    if not right.all() or any(int.from_bytes(n, "little") != len(d) for n, d in zip(lengths, data, strict=True)):
        raise ValueError("a record does not fit its checksums")
    return data


@dataclass
class Written(WriterCommitMessage):
    partition: int
    files: list[dict]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, file_bytes: int):
        self.path, self.file_bytes = path, file_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        files, base = _files(self.path)
        files.create_dir(base, recursive=True)
        partition, done, out, index = TaskContext.get().partitionId(), [], None, []
        offset = before = 0

        def close() -> None:
            out.close()
            with files.open_output_stream(f"{base}/{done[-1]['file']}.idx") as f:
                f.write(np.array(index, dtype=INDEX).tobytes())
            done[-1] |= {"records": len(index), "tokens": before, "bytes": offset}

        for batch in iterator:
            doc_ids, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for frame, part in zip(frames(doc_ids, ids), ids, strict=True):
                if out is None or offset >= self.file_bytes:
                    if out is not None:
                        close()
                    index, offset, before = [], 0, 0
                    done.append({"file": f"part-{partition:06d}-{len(done):04d}-{uuid.uuid4().hex}"})
                    out = files.open_output_stream(f"{base}/{done[-1]['file']}.rec")
                out.write(frame)
                index.append((offset, len(frame), before, len(part) // 4))
                offset += len(frame)
                before += len(part) // 4
        if out is not None:
            close()
        return Written(partition, done)

    def commit(self, messages: list[Written | None]) -> None:
        files, base = _files(self.path)
        files.create_dir(base, recursive=True)
        listed, start = [], 0
        for message in sorted((m for m in messages if m), key=lambda m: m.partition):
            for f in message.files:
                listed.append(f | {"start": start})
                start += f["tokens"]
        draft = f"{base}/{MANIFEST}-{uuid.uuid4().hex}"
        with files.open_output_stream(draft) as f:
            f.write(json.dumps({"tokens": start, "files": listed}).encode())
        files.move(draft, f"{base}/{MANIFEST}")

    def abort(self, messages: list[Written | None]) -> None:
        """Nothing to take back: without the manifest, no file counts."""


@dataclass
class Slice(InputPartition):
    file: str
    start: int
    first: int
    n: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, size: int, seed: int | None):
        self.path, self.size, self.seed = path, size, seed

    def partitions(self) -> list[Slice]:
        files, base = _files(self.path)
        with files.open_input_file(f"{base}/{MANIFEST}") as f:
            listed = json.loads(f.read())["files"]
        out = []
        for f in listed:
            each = max(1, f["records"] * self.size // max(f["bytes"], 1))
            out += [Slice(f["file"], f["start"], a, min(each, f["records"] - a)) for a in range(0, f["records"], each)]
        if self.seed is not None:
            out = [out[i] for i in np.random.default_rng(self.seed).permutation(len(out))]
        return out or [Slice("", 0, 0, 0)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        if not partition.n:
            return
        files, base = _files(self.path)
        with files.open_input_file(f"{base}/{partition.file}.idx") as f:
            f.seek(partition.first * INDEX.itemsize)
            index = np.frombuffer(f.read(partition.n * INDEX.itemsize), dtype=INDEX)
        with files.open_input_file(f"{base}/{partition.file}.rec") as f:
            for rows in self._groups(index, partition):
                # With a seed, rows are any; else they follow each other and are read at once.
                if self.seed is None:
                    f.seek(int(index["offset"][rows[0]]))
                    data = unframed(f.read(int(index["size"][rows].sum())), index["size"][rows].tolist())
                else:
                    data = []
                    for i in rows:
                        f.seek(int(index["offset"][i]))
                        data.append(f.read(int(index["size"][i])))
                    data = unframed(b"".join(data), index["size"][rows].tolist())
                known = [None if d[8] & 1 else int.from_bytes(d[:8], "little", signed=True) for d in data]
                yield pa.RecordBatch.from_arrays([
                    pa.array([partition.file] * len(rows)), pa.array(partition.first + rows), pa.array(known, pa.int64()), pa.array((partition.start + index["before"][rows]).astype(np.int64)),
                    pa.array(index["n"][rows].astype(np.int64)), pa.array(map(_ids, data), pa.binary()),
                ], names=[x.split()[0] for x in READ.split(", ")])

    def _groups(self, index: np.ndarray, partition: Slice) -> Iterator[np.ndarray]:
        """Numbers of records in the order they are read, about BATCH bytes at a time."""
        order = np.arange(partition.n)
        if self.seed is not None:
            order = np.random.default_rng([self.seed, partition.start, partition.first]).permutation(partition.n)
        behind = np.cumsum(index["size"][order].astype(np.int64)) // BATCH
        yield from np.split(order, np.flatnonzero(np.diff(behind)) + 1)


class TokenRecords(DataSource):
    """Options: path; on reading `slice_bytes` and `seed`, on writing `file_bytes`."""

    @classmethod
    def name(cls) -> str:
        return "token_records"

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> _Reader:  # noqa: ANN001
        seed = self.options.get("seed")
        return _Reader(self.options["path"], int(self.options.get("slice_bytes", SLICE)), None if seed is None else int(seed))

    def writer(self, schema, overwrite: bool) -> _Writer:  # noqa: ANN001
        return _Writer(self.options["path"], int(self.options.get("file_bytes", FILE_BYTES)))


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from palimpsest.llm.packing import document_ids

        end = END_ID.to_bytes(4, "little")
        for b in batches:
            texts, doc_ids, at = b.column(1).to_pylist(), b.column(0).to_pylist(), 0
            while at < len(texts):  # a few million characters at a time
                to, size = at, 0
                while to < len(texts) and size < BATCH:
                    size += len(texts[to] or "")
                    to += 1
                ids = [i + end for i in document_ids(texts[at:to], path)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids[at:to], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "ids"])
                at = to

    return run


def write_documents(documents: DataFrame, tokenizer_path: str, path: str) -> None:
    """Encode every row of documents (columns doc_id, text) and write its ids and the end id to `path`, in ascending order of doc_id over all files.

    Texts, which are smaller than their ids, are dealt to ranges of doc_id and sorted there.
    """
    spark = documents.sparkSession
    ready(spark)
    spark.dataSource.register(TokenRecords)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    ordered.mapInArrow(_encoded(tokenizer_path), WRITTEN).write.format("token_records").mode("append").save(path)


def read_documents(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """file, record, doc_id, start (ids of all records before it in all files), n_tokens, ids (little-endian unsigned 32-bit) of each record."""
    ready(spark)
    spark.dataSource.register(TokenRecords)
    return spark.read.format("token_records").options(**options).load(path)


def digests(records: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned CRC-32 of the ids of each record."""
    return records.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
