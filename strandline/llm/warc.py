"""Records of web archives (WARC/1.1): files read and written as rows that ``revisits.resolve`` takes."""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from strandline.llm import _common
from strandline.llm.token_records import filesystem

RECORDS = (
    "record_id string, ts long, kind string, url string, etag string, last_modified string, digest string, "
    "headers map<string,string>, payload binary"
)
_KINDS = [
    pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary(),
]
_NAMES = [x.split()[0] for x in RECORDS.split(", ")]
#: The profile of a revisit that was answered with 304, and what the two record types begin with.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
STATUS = {"response": "HTTP/1.1 200 OK", "revisit": "HTTP/1.1 304 Not Modified"}


class CorruptArchive(ValueError):
    """A record's head or length does not fit."""


def _head(fields: Iterable[tuple[str, str]]) -> bytes:
    return "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields).encode()


def record_bytes(row: dict) -> bytes:
    """One record: its own head, then the HTTP answer with its headers and payload."""
    kind = row["kind"] if row["kind"] in STATUS else "response"
    answer = dict(row["headers"] or {})
    for name, value in (("etag", row["etag"]), ("last-modified", row["last_modified"])):
        if value is not None:
            answer[name] = value
    body = (STATUS[kind] + "\r\n").encode() + _head(sorted(answer.items())) + b"\r\n" + (row["payload"] or b"")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{row['record_id']}>")]
    if row["ts"] is not None:
        fields.append(("WARC-Date", datetime.fromtimestamp(row["ts"], UTC).strftime("%Y-%m-%dT%H:%M:%SZ")))
    if row["url"] is not None:
        fields.append(("WARC-Target-URI", row["url"]))
    if kind == "revisit":
        fields.append(("WARC-Profile", PROFILE))
    if row["digest"] is not None:
        fields.append(("WARC-Payload-Digest", row["digest"]))
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + _head(fields) + b"\r\n" + body + b"\r\n\r\n"


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """Writes rows of ``RECORDS`` as .warc.gz files, a gzip member for each record; returns path and n_records of each file.

    Rows keep their order within a partition. Null fields are left out; kinds other than revisit count as response; a
    task that runs again writes a file of another name, and only those that are returned count. An empty table makes no file.
    """

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, own = filesystem(folder)
        fs.create_dir(own, recursive=True)
        out, n = None, 0
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}.warc.gz"
        for b in batches:
            for row in b.to_pylist():
                row["headers"] = dict(row["headers"] or [])
                out = out or fs.open_output_stream(f"{own}/{name}", compression=None)
                out.write(gzip.compress(record_bytes(row), mtime=0))
                n += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n])], ["path", "n_records"])

    return records.select(*_NAMES).mapInArrow(_common.lean(write), "path string, n_records long")


class _Members:
    """The bytes of a file with one gzip member after the other, or of one that is not packed, read on demand."""

    def __init__(self, f):
        self.f, self.held, self.packed = f, b"", None
        self.z = zlib.decompressobj(31)

    def _more(self) -> bool:
        data = self.z.unused_data or self.f.read(1 << 16)
        if self.packed is None:
            self.packed = data[:2] == b"\x1f\x8b"
        if not data:
            return False
        if not self.packed:
            self.held += data
            return True
        if self.z.eof:
            self.z = zlib.decompressobj(31)
        self.held += self.z.decompress(data)
        return True

    def line(self) -> bytes:
        while b"\n" not in self.held:
            if not self._more():
                out, self.held = self.held, b""
                return out
        out, _, self.held = self.held.partition(b"\n")
        return out.rstrip(b"\r")

    def take(self, n: int) -> bytes:
        parts, have = [self.held[:n]], min(n, len(self.held))
        self.held = self.held[n:]
        while have < n:
            if not self._more():
                raise CorruptArchive("a record is cut off")
            part = self.held[: n - have]
            self.held = self.held[len(part) :]
            parts.append(part)
            have += len(part)
        return b"".join(parts)

    def ended(self) -> bool:
        while not self.held:
            if not self._more():
                return True
        return False


def _fields(lines: Iterable[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    for x in lines:
        name, colon, value = x.decode("utf-8", "replace").partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def read_records(f) -> Iterator[dict]:
    """Responses and revisits of an open file, one in memory at a time; records of other types are passed over."""
    data = _Members(f)
    while not data.ended():
        version = data.line()
        if not version:
            continue
        if not version.startswith(b"WARC/"):
            raise CorruptArchive("a record does not begin with its version")
        head = _fields(iter(data.line, b""))
        if "content-length" not in head:
            raise CorruptArchive("a record has no length")
        body = data.take(int(head["content-length"]))
        if head.get("warc-type") not in STATUS:
            continue
        answer, _, payload = body.partition(b"\r\n\r\n")
        headers = _fields(answer.split(b"\r\n")[1:])
        date = head.get("warc-date")
        ts = int(datetime.fromisoformat(date.replace("Z", "+00:00")).timestamp()) if date else None
        yield {
            "record_id": head.get("warc-record-id", "").strip("<>"), "ts": ts, "kind": head["warc-type"], "url": head.get("warc-target-uri"),
            "etag": headers.get("etag"), "last_modified": headers.get("last-modified"), "digest": head.get("warc-payload-digest"),
            "headers": headers, "payload": payload,
        }


def read_warc(spark: SparkSession, paths: list[str] | DataFrame) -> DataFrame:
    """Rows of ``RECORDS`` from .warc or .warc.gz files (a list, or a table with a column path); a file is one task's work.

    Files are read as streams, whatever their size. A file that is cut off fails its task. No paths give no rows.
    """
    files = paths.select("path") if isinstance(paths, DataFrame) else spark.createDataFrame([(p,) for p in paths], "path string")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] if k != "headers" else list(r[k].items()) for r in rows], t) for k, t in zip(_NAMES, _KINDS, strict=True)], _NAMES)

        for b in batches:
            for path in b.column(0).to_pylist():
                fs, own = filesystem(path)
                rows, size = [], 0
                with fs.open_input_stream(own, compression=None) as f:
                    for r in read_records(f):
                        rows.append(r)
                        size += len(r["payload"])
                        if size > 4 << 20 or len(rows) == 1000:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    return files.repartition(_common.parts(spark), "path").mapInArrow(_common.lean(read), RECORDS)


def payload_digest(payload: bytes) -> str:
    return "sha1:" + hashlib.sha1(payload).hexdigest()


def iter_bytes(data: bytes) -> Iterator[dict]:
    """``read_records`` over bytes in memory."""
    return read_records(io.BytesIO(data))
