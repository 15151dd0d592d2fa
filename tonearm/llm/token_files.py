"""Token ids in binary files: fixed-width bit packing with block offsets.

A file holds documents in ascending id order, and the files of a folder follow one another. Layout, little-endian:

    payload   ids in blocks of BLOCK, each id in `width` bits (the least that hold the vocabulary), most significant bit
              first; a block starts on a byte
    index     per document: id (int64), id present (uint8), first token in this file (uint64)
    offsets   byte offset of each block (uint64)
    trailer   magic, width, BLOCK (uint32 each), documents, tokens, place of index, place of offsets (uint64 each)

Any id range is read by its block offsets alone and unpacked by numpy. A folder also has `_manifest`, a Parquet table
with one row per file: name, order, documents, tokens. Only files named there count, so what a lost or repeated task
attempt leaves behind is never read.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonearm.llm.shared import bound_batches, column
from tonearm.llm.wordbpe import encoder

BLOCK, MAGIC, TRAILER = 4096, 0x314B4E54, struct.Struct("<IIIQQQQ")


def width_of(vocabulary: int) -> int:
    """Bits that the largest id of a vocabulary needs."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    bits = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(bits[:, 32 - width :]).tobytes()


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    bits = np.zeros((n, 32), np.uint8)
    bits[:, 32 - width :] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width).reshape(n, width)
    return np.packbits(bits, axis=1).view(">u4").reshape(n).astype("<u4")


def open_folder(uri: str):
    """(file system, path) of a URI or of a plain local path."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


class TokenFileWriter:
    """Streams documents to one file; keeps one block and the document index in memory."""

    def __init__(self, out, width: int):
        self.out, self.width, self.tail, self.at, self.tokens = out, width, np.zeros(0, "<u4"), 0, 0
        self.index: list[tuple[int, int, int]] = []
        self.offsets: list[int] = []

    def _block(self, ids: np.ndarray) -> None:
        self.offsets.append(self.at)
        data = pack(ids, self.width)
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.index.append((doc_id or 0, doc_id is not None, self.tokens))
        self.tokens += len(ids)
        self.tail = np.concatenate([self.tail, ids])
        whole = len(self.tail) // BLOCK * BLOCK
        for at in range(0, whole, BLOCK):
            self._block(self.tail[at : at + BLOCK])
        self.tail = self.tail[whole:]

    def close(self) -> None:
        if len(self.tail):
            self._block(self.tail)
        cols = zip(*self.index, strict=True) if self.index else ((), (), ())
        index = b"".join(np.array(c, kind).tobytes() for c, kind in zip(cols, ("<i8", "u1", "<u8"), strict=True))
        self.out.write(index + np.array(self.offsets, "<u8").tobytes())
        self.out.write(TRAILER.pack(MAGIC, self.width, BLOCK, len(self.index), self.tokens, self.at, self.at + len(index)))
        self.out.close()


class TokenFile:
    """Random access to one file: reads its trailer and index, then only the blocks asked for."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        magic, self.width, self.block, docs, self.tokens, index, offsets = TRAILER.unpack(source.read_at(TRAILER.size, end - TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        raw = source.read_at(17 * docs, index)
        ids, present = np.frombuffer(raw, "<i8", docs), np.frombuffer(raw, "u1", docs, 8 * docs)
        self.doc_ids = [int(i) if p else None for i, p in zip(ids, present, strict=True)]
        self.starts = np.append(np.frombuffer(raw, "<u8", docs, 9 * docs), self.tokens).astype(np.int64)
        blocks = -(-self.tokens // self.block)
        self.offsets = np.append(np.frombuffer(source.read_at(8 * blocks, offsets), "<u8"), index).astype(np.int64)

    def read(self, first: int, end: int) -> np.ndarray:
        """The ids from token `first` to before token `end` of this file."""
        if end <= first:
            return np.zeros(0, "<u4")
        a, b = first // self.block, -(-end // self.block)
        raw, at = self.source.read_at(int(self.offsets[b] - self.offsets[a]), int(self.offsets[a])), self.offsets[a]
        if self.block * self.width % 8 == 0:
            found = unpack(raw, self.width, min(self.tokens, b * self.block) - a * self.block)
        else:
            found = np.concatenate([unpack(raw[self.offsets[k] - at : self.offsets[k + 1] - at], self.width, min(self.block, self.tokens - k * self.block)) for k in range(a, b)])
        return found[first - a * self.block : end - a * self.block]

    def documents(self, most: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, start in this file, ids) of every document, reading about `most` tokens at a time."""
        at = 0
        while at < len(self.doc_ids):
            end = max(at + 1, int(np.searchsorted(self.starts, self.starts[at] + most, "right")) - 1)
            ids = self.read(int(self.starts[at]), int(self.starts[end]))
            for k in range(at, end):
                yield self.doc_ids[k], int(self.starts[k]), ids[self.starts[k] - self.starts[at] : self.starts[k + 1] - self.starts[at]]
            at = end


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> DataFrame:
    """Encode all texts, append end_id to each, write them to `folder` in ascending id order; gives the manifest.

    Texts are exchanged once, by ranges of id, into `files` parts (default: the session's shuffle partitions). Nulls: a
    null text is empty (its document is end_id alone), a null id comes first. Rows that repeat an id are written one by
    one, by text. An empty table writes an empty manifest. Other columns are not read. Ids are whole numbers, which the
    format holds in 64 bits; others are refused. A very long text is encoded and written as it comes, in blocks.
    """
    spark = docs.sparkSession
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{id_col} must be a whole number")
    bound_batches(spark)

    def run(batches):
        enc, fs, width, out = encoder(tokenizer), None, 0, None
        end = np.array([end_id], "<u4")
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.tok"
        for b in batches:
            if b.num_rows and out is None:
                width = width_of(max(enc.size, end_id + 1))
                fs, path = open_folder(folder)
                fs.create_dir(path, recursive=True)
                out = TokenFileWriter(fs.open_output_stream(f"{path}/{name}"), width)
            for i, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist()), strict=True):
                out.add(i, np.concatenate([np.frombuffer(ids, "<u4"), end]))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"file": name, "part": part, "n_docs": len(out.index), "n_tokens": out.tokens, "width": width}])

    own = docs.select(column(id_col).cast("long").alias("id"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    manifest = own.repartitionByRange(n, "id").sortWithinPartitions("id", "text").mapInArrow(run, "file string, part long, n_docs long, n_tokens long, width long")
    manifest.write.parquet(f"{folder}/_manifest")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/_manifest")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document of a folder; ids as little-endian unsigned 32-bit integers, start
    the ids of all documents before it. A task reads whole files, a stretch of blocks at a time."""
    files = spark.read.schema("file string, part long, n_docs long, n_tokens long, width long").parquet(f"{folder}/_manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file, not per document
    placed = files.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))

    def run(batches):
        fs, path = open_folder(folder)
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held, size = [], 0
                with fs.open_input_file(f"{path}/{name}") as source:
                    for i, start, ids in TokenFile(source).documents():
                        held.append({"doc_id": i, "start": base + start, "n_tokens": len(ids), "ids": ids.tobytes()})
                        size += len(ids)
                        if size >= 1 << 20:
                            yield pa.RecordBatch.from_pylist(held, SCHEMA)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, SCHEMA)

    spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return placed.repartition(spread, "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
