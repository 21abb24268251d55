"""Token ids as length-delimited binary records with masked checksums and an offset index (operator 4)."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm import _common, _words
from strandline.llm._tokens import tokenizer

#: Byte length of a record's payload and the masked checksum of those eight bytes; behind the payload comes its own.
HEAD, TAIL = struct.Struct("<QI"), struct.Struct("<I")
#: doc_id, flags (1: doc_id is null; 2: ids are 32 bits wide, else 16).
LEAD = struct.Struct("<qB")
#: One index entry: byte offset of the record, number of ids.
ENTRY = struct.Struct("<QQ")
MANIFEST = "part int, file_no int, path string, n_records long, n_tokens long"


class CorruptRecord(ValueError):
    """A checksum or length in a record file does not fit."""


def masked(data: bytes) -> int:
    """CRC-32 rotated and offset, so that a checksum of data that holds checksums stays sound."""
    x = zlib.crc32(data)
    return ((x >> 15 | x << 17) + 0xA282EAD8) & 0xFFFFFFFF


def filesystem(uri: str):
    """Any file system that pyarrow can open by URI: file, hdfs, s3, gs."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class RecordWriter:
    """Files of one task: each is closed at about ``file_bytes``; its index is written beside it."""

    def __init__(self, folder: str, part: int, file_bytes: int):
        self.uri = folder
        self.fs, self.folder = filesystem(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.part, self.file_bytes, self.no, self.out = part, file_bytes, 0, None
        self.done: list[tuple] = []

    def write(self, doc_id: int | None, ids: np.ndarray, wide: bool) -> None:
        if self.out is None:
            # a task that runs twice writes other names; only those of the manifest count
            self.name = f"part-{self.part:06d}-{self.no:04d}-{uuid.uuid4().hex[:8]}.rec"
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}")
            self.index, self.at, self.tokens = bytearray(), 0, 0
        payload = LEAD.pack(doc_id or 0, (doc_id is None) | 2 * wide) + ids.astype("<u4" if wide else "<u2").tobytes()
        size = struct.pack("<Q", len(payload))
        self.out.write(size + TAIL.pack(masked(size)) + payload + TAIL.pack(masked(payload)))
        self.index += ENTRY.pack(self.at, len(ids))
        self.at += HEAD.size + len(payload) + TAIL.size
        self.tokens += len(ids)
        if self.at >= self.file_bytes:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            with self.fs.open_output_stream(f"{self.folder}/{self.name}.idx") as f:
                f.write(bytes(self.index) + TAIL.pack(masked(bytes(self.index))))
            path = f"{self.uri}/{self.name}"
            self.done.append((self.part, self.no, path, len(self.index) // ENTRY.size, self.tokens))
            self.out, self.no = None, self.no + 1


def _parse(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, flags = LEAD.unpack_from(payload)
    ids = np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=LEAD.size)
    return None if flags & 1 else doc_id, ids.astype("<u4")


def _record(f) -> tuple[int | None, np.ndarray] | None:
    head = f.read(HEAD.size)
    if not head:
        return None
    if len(head) < HEAD.size:
        raise CorruptRecord("a record's head is cut off")
    size, check = HEAD.unpack(head)
    if check != masked(head[:8]):
        raise CorruptRecord("a record's length doesn't fit its checksum")
    body = f.read(size + TAIL.size)
    if len(body) < size + TAIL.size or TAIL.unpack(body[size:])[0] != masked(body[:size]):
        raise CorruptRecord("a record doesn't fit its checksum")
    return _parse(body[:size])


def read_records(path: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of one file in its order, one record in memory at a time."""
    fs, own = filesystem(path)
    with fs.open_input_stream(own, buffer_size=1 << 20) as f:
        while (x := _record(f)) is not None:
            yield x


def read_index(path: str) -> np.ndarray:
    """Rows (byte offset, number of ids) of a file's index."""
    fs, own = filesystem(path)
    with fs.open_input_stream(f"{own}.idx") as f:
        data = f.read()
    if len(data) < TAIL.size or TAIL.unpack(data[-TAIL.size :])[0] != masked(data[: -TAIL.size]):
        raise CorruptRecord("an index doesn't fit its checksum")
    return np.frombuffer(data[: -TAIL.size], "<u8").reshape(-1, 2)


def read_at(path: str, numbers: list[int]) -> Iterator[tuple[int | None, np.ndarray]]:
    """Records by number in any order, by seeking to the offsets of the index."""
    fs, own = filesystem(path)
    index = read_index(path)
    with fs.open_input_file(own) as f:
        for k in numbers:
            f.seek(int(index[k, 0]))
            yield _record(f)


def write_records(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, spaced: bool = True, n_parts: int | None = None,
    file_bytes: int = 128 << 20,
) -> DataFrame:
    """Writes every text's ids with ``end_id`` behind them to ``folder``, in ascending doc_id order; returns the manifest.

    Range partitions follow doc_id, so files in (part, file_no) order hold the documents in order. A null text counts
    as empty and yields the end id alone; a null doc_id comes first; rows with one doc_id stand side by side, by a hash of
    the text, and if they are very many (null ids, copies) in several parts; an empty table makes no file. Other columns are ignored. A text takes about six times its bytes in a task, and one that
    holds a string of an added token or odd white space goes to the library whole.
    """
    n = n_parts or _common.parts(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(tokenizer_path, spaced)
        wide = max(own.library.get_vocab_size(), end_id + 1) > 65_536
        out = RecordWriter(folder, TaskContext.get().partitionId(), file_bytes)
        end = np.array([end_id], np.uint32)
        for b in batches:
            doc_ids = b.column(0).to_pylist()
            for i, j, data, offs in _words.blocks(b.column(1)):
                ids, at = own.encode(data, offs)
                for r in range(i, j):
                    out.write(doc_ids[r], np.concatenate([ids[at[r - i] : at[r - i + 1]], end]), wide)
        own.release()
        out.close()
        rows = list(zip(*out.done, strict=True)) or [[]] * 5
        kinds = pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], ["part", "file_no", "path", "n_records", "n_tokens"]
        )

    _common.small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), _common.text_or_empty().alias("text"))
    rows = rows.withColumn("_h", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(n, "doc_id", "_h", "_row").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    return dealt.mapInArrow(_common.lean(write), MANIFEST)


def scan_records(manifest: DataFrame) -> DataFrame:
    """Reads the files of a manifest back: doc_id, start, n_tokens, ids_crc32, with every checksum verified.

    ``start`` counts the ids of all records before; sums over the manifest give each file's first.
    """
    spark = manifest.sparkSession
    order = Window.orderBy("part", "file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("path", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("base"), "n_records")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start, n in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                rows = []
                got = 0
                for doc_id, ids in read_records(path):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                    got += 1
                    if len(rows) == 10_000:
                        yield _rows(rows)
                        rows = []
                if got != n:
                    raise CorruptRecord(f"{path} has {got} records instead of {n}")
                if rows:
                    yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"]
        )

    files = files.repartition(_common.parts(spark), "path")
    return files.mapInArrow(_common.lean(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_records(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    manifest = write_records(docs, _common.shared_dir(spark, "records"), path)
    return scan_records(_common.stage(manifest, "manifest"))
