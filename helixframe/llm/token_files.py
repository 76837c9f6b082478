"""Token ids in binary files: frequency ranks in byte-aligned variable-length codes.

Ids are numbered anew by falling frequency in the whole corpus, so the frequent ones take one byte. A rank takes one to four
bytes, little-endian; the lengths of four ranks stand in a control byte, apart from the data, so that decoding is lookups in
tables over whole arrays and no loop over ids.

A data set is a folder:

- ``ranks.u32``: the id of every rank;
- ``part-*.tok``: blocks of whole documents in ascending order of their ids, then an index of the blocks;
- ``manifest.json``: the files with their numbers of documents and tokens and the number of the first token. It is
  written last, when all tasks have ended, and names the files of the attempts that count; others are ignored.

A block is a header, an Arrow stream of the documents' keys and lengths, the control bytes, the data, and a checksum.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import BinaryType, LongType, StructType

from helixframe.durable import cut_lineage, new_folder
from helixframe.llm.common import shape, slices
from helixframe.llm.encoders import byte_encoder

FORMAT = "ranked_tokens"
#: Magic, documents, tokens, bytes of the keys, of the control bytes and of the data, checksum of these three.
_HEADER = struct.Struct("<4sIQIQQI")
#: Of a block: its place in the file, documents and tokens before it. At the end of the file: the number of blocks, magic.
_ENTRY, _TRAILER, _MAGIC = struct.Struct("<QQQ"), struct.Struct("<I4s"), b"RTK1"
#: A block ends with the document that brings it to so many tokens, a file holds about so many.
BLOCK_TOKENS, FILE_TOKENS = 1 << 16, 1 << 26

#: The lengths of four codes, by control byte; and what is kept of four bytes, by length - 1.
_LENGTHS = ((np.arange(256)[:, None] >> np.arange(0, 8, 2)) & 3) + 1
_MASKS = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def compress(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data) of unsigned 32-bit integers."""
    ranks = ranks.astype("<u4")
    longer = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-len(ranks) % 4 + len(ranks), np.uint8)
    codes[: len(ranks)] = longer
    control = (codes.reshape(-1, 4) << np.arange(0, 8, 2, dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= longer[:, None]].tobytes()


def decompress(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The first n integers of (control bytes, data)."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    starts = np.cumsum(lengths) - lengths
    padded = np.frombuffer(data + bytes(3), np.uint8)
    out = padded[starts].astype(np.uint32)
    for k in range(1, int(lengths.max(initial=1))):
        out |= padded[starts + k].astype(np.uint32) << np.uint32(8 * k)
    return out & _MASKS[lengths - 1]


def place_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path there."""
    path = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    part: int
    name: str
    docs: int
    tokens: int


@dataclass
class Part(InputPartition):
    name: str | None
    start: int


class _Writer(DataSourceArrowWriter):
    """A task's rows (key, n_tokens, packed, width), in their order, to one file."""

    def __init__(self, path: str, kind: str):
        self.path, self.kind = path, kind

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = place_of(self.path)
        part, unpack = TaskContext.get().partitionId(), zstandard.ZstdDecompressor().decompress
        with system.open_input_stream(f"{root}/ranks.u32") as f:
            ids = np.frombuffer(f.read(), "<u4")
        rank = np.zeros(int(ids.max(initial=0)) + 1, np.uint32)
        rank[ids] = np.arange(len(ids), dtype=np.uint32)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.tok"
        index, docs, tokens = [], 0, 0
        keys, held = [], []

        with system.open_output_stream(f"{root}/{name}") as out:

            def flush() -> None:
                nonlocal docs, tokens
                sink, lengths = pa.BufferOutputStream(), [len(x) for x in held]
                batch = pa.RecordBatch.from_arrays([pa.concat_arrays(keys), pa.array(lengths, pa.int64())], names=["key", "n_tokens"])
                with pa.ipc.new_stream(sink, batch.schema) as stream:
                    stream.write_batch(batch)
                parts = [sink.getvalue().to_pybytes(), *compress(rank[np.concatenate(held)])]
                index.append((out.tell(), docs, tokens))
                body = b"".join(parts)
                out.write(_HEADER.pack(_MAGIC, len(lengths), sum(lengths), *map(len, parts), zlib.crc32(body)) + body)
                docs, tokens = docs + len(lengths), tokens + sum(lengths)
                keys.clear()
                held.clear()

            waiting = 0
            for batch in iterator:
                key, packed, width = (batch.column(c) for c in ("key", "packed", "width"))
                for k in range(batch.num_rows):
                    found = np.frombuffer(unpack(packed[k].as_py()), f"<u{width[k].as_py()}")
                    keys.append(key.slice(k, 1))
                    held.append(found)
                    waiting += len(found)
                    if waiting >= BLOCK_TOKENS or len(held) >= BLOCK_TOKENS:
                        flush()
                        waiting = 0
            if held:
                flush()
            out.write(b"".join(_ENTRY.pack(*x) for x in index) + _TRAILER.pack(len(index), _MAGIC))
        return Written(part, name, docs, tokens)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, start = [], 0
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.part):
            if m.docs:
                files.append({"name": m.name, "docs": m.docs, "tokens": m.tokens, "start": start})
            start += m.tokens
        system, root = place_of(self.path)
        with system.open_output_stream(f"{root}/manifest.json") as f:
            f.write(json.dumps({"format": FORMAT, "key": json.loads(self.kind), "tokens": start, "files": files}).encode())


def manifest(path: str) -> dict:
    """The manifest of a data set; a folder without one was never finished."""
    system, root = place_of(path)
    with system.open_input_stream(f"{root}/manifest.json") as f:
        return json.loads(f.read())


def _blocks(f: pa.NativeFile, ids: np.ndarray, at: int, end: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(keys and lengths, ids) of the blocks that start between two places of a file."""
    f.seek(at)
    while f.tell() < end:
        magic, _, n, keys, control, data, check = _HEADER.unpack(f.read(_HEADER.size))
        body = f.read(keys + control + data)
        if magic != _MAGIC or zlib.crc32(body) != check:
            raise ValueError("a block of tokens is damaged")
        batch = pa.ipc.open_stream(body[:keys]).read_next_batch()
        yield batch, ids[decompress(body[keys : keys + control], body[keys + control :], n)]


def _index(f: pa.NativeFile, size: int) -> tuple[np.ndarray, int]:
    """Rows (place, documents before, tokens before) of a file's blocks, and where the blocks end."""
    f.seek(size - _TRAILER.size)
    n, magic = _TRAILER.unpack(f.read(_TRAILER.size))
    if magic != _MAGIC:
        raise ValueError("no file of tokens")
    end = size - _TRAILER.size - n * _ENTRY.size
    f.seek(end)
    return np.frombuffer(f.read(n * _ENTRY.size), "<u8").reshape(-1, 3).astype(np.int64), end


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Part]:
        return [Part(x["name"], x["start"]) for x in manifest(self.path)["files"]] or [Part(None, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition.name is None:
            return
        system, root = place_of(self.path)
        with system.open_input_stream(f"{root}/ranks.u32") as f:
            ids, place = np.frombuffer(f.read(), "<u4"), f"{root}/{partition.name}"
        start = partition.start
        with system.open_input_file(place) as f:
            _, end = _index(f, f.size())
            for batch, found in _blocks(f, ids, 0, end):
                lengths = batch.column("n_tokens").to_numpy()
                offsets = np.concatenate([[0], np.cumsum(lengths)])
                raw = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer((4 * offsets).astype(np.int32)), pa.py_buffer(found.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(start + offsets[:-1]), batch.column("n_tokens"), raw], names=["doc_id", "start", "n_tokens", "ids"])
                start += int(offsets[-1])


class RankedTokens(DataSource):
    """``spark.read.format("ranked_tokens").load(folder)``, once it is registered: doc_id, start, n_tokens, ids.

    `start` counts the tokens of all documents before; `ids` are little-endian unsigned 32-bit integers.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        key = StructType.fromJson({"type": "struct", "fields": [manifest(self.options["path"])["key"]]})["key"].dataType
        return shape(doc_id=key, start=LongType(), n_tokens=LongType(), ids=BinaryType())

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], schema["key"].json())


def encoded(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """key, n_tokens, packed (the ids and the end id, compressed), width (bytes of an id there), crc, part and nth (a row's place)."""
    given = docs.select(F.col("doc_id").alias("key"), "text")
    kind = given.schema["key"].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, pack = byte_encoder(vocabulary), np.array([end_id], "<u4"), zstandard.ZstdCompressor(level=1).compress
        part, nth = TaskContext.get().partitionId(), 0
        width = 2 if max(len(encoder.token_bytes), end_id + 1) <= 1 << 16 else 4
        for batch, texts in slices(batches):
            found = [np.concatenate([encoder.encode(t.decode()), end]) for t in texts]
            n = len(found)
            columns = [pa.array(x, pa.int64()) for x in ([len(x) for x in found], [zlib.crc32(x) for x in found], [part] * n, range(nth, nth + n))]
            packed = pa.array([pack(x.astype(f"<u{width}").tobytes()) for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("key"), packed, pa.array([width] * n, pa.int32()), *columns], names=["key", "packed", "width", "n_tokens", "crc", "part", "nth"])
            nth += n

    return given.mapInArrow(encode, shape(key=kind, packed="binary", width="int", n_tokens="long", crc="long", part="long", nth="long"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack, total = zstandard.ZstdDecompressor().decompress, np.zeros(0, np.int64)
    for batch in batches:
        for packed, width in zip(batch.column("packed"), batch.column("width").to_pylist(), strict=True):
            found = np.bincount(np.frombuffer(unpack(packed.as_py()), f"<u{width}"), minlength=len(total))
            found[: len(total)] += total
            total = found
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])


def write(docs: DataFrame, vocabulary: str, path: str, end_id: int = 2) -> None:
    """Write the documents' ids, each with the end id behind them, to a new data set at `path`, in ascending order of doc_id.

    Null texts count as empty: their document is the end id alone. A null doc_id comes first; rows of one doc_id are ordered by a
    checksum of their ids, so equal ids stay together. Repeated rows are written as often as they occur. Other
    columns are not read. An empty table gives a data set without files. A text of any length is encoded whole.
    """
    spark = docs.sparkSession
    spark.dataSource.register(RankedTokens)
    rows = cut_lineage(encoded(docs, vocabulary, end_id))  # texts are encoded once
    counts = rows.select("packed", "width").mapInArrow(_counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranked = counts.orderBy(F.desc("n"), "id").collect()  # no more rows than the vocabulary has
    system, root = place_of(path)
    system.create_dir(root)
    with system.open_output_stream(f"{root}/ranks.u32") as f:
        f.write(np.array([r["id"] for r in ranked], "<u4").tobytes())
    files = max(-(-sum(r["n"] for r in ranked) // FILE_TOKENS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("key").asc_nulls_first(), "crc", "part", "nth"]
    sorted_rows = rows.repartitionByRange(files, *order).sortWithinPartitions(*order)
    sorted_rows.select("key", "n_tokens", "packed", "width").write.format(FORMAT).mode("append").save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of every document of a data set."""
    spark.dataSource.register(RankedTokens)
    return spark.read.format(FORMAT).load(path)


def window(path: str, start: int, length: int) -> np.ndarray:
    """Some consecutive ids of the whole data set, read from the blocks that hold them alone."""
    told, (system, root), out = manifest(path), place_of(path), []
    with system.open_input_stream(f"{root}/ranks.u32") as f:
        ids = np.frombuffer(f.read(), "<u4")
    for file in told["files"]:
        low, high = max(start, file["start"]), min(start + length, file["start"] + file["tokens"])
        if low >= high:
            continue
        with system.open_input_file(f"{root}/{file['name']}") as f:
            index, end = _index(f, f.size())
            first = int(np.searchsorted(index[:, 2], low - file["start"], "right")) - 1
            last = int(np.searchsorted(index[:, 2], high - file["start"], "left"))
            found = np.concatenate([x for _, x in _blocks(f, ids, int(index[first, 0]), int(index[last, 0]) if last < len(index) else end)])
            at = file["start"] + int(index[first, 2])
            out.append(found[low - at : high - at])
    return np.concatenate(out) if out else np.zeros(0, "<u4")


def stored(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """The documents' ids as read back from files in a new folder beside the checkpoints: doc_id, start, n_tokens, ids."""
    path = new_folder(docs.sparkSession, "tokens")
    write(docs, vocabulary, path, end_id)
    return read(docs.sparkSession, path)


def digests(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the documents' ids, as read back."""
    return stored(docs, vocabulary, end_id).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
