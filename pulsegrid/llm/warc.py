"""WARC archives: a writer and a sequential reader, one gzip member per record.

Executors write archives below a folder that all of them share and return a manifest;
the reader takes the manifest and streams each archive through ``zlib`` in small pieces,
so neither side holds more than one record.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.shared import cut, fresh_dir

#: Bytes of compressed records after which a task begins another archive.
ARCHIVE_BYTES = 256 << 20
READ_BYTES = 1 << 16
#: Record ids are UUIDs whose low half is the page id; the high half tells a null id.
_PLAIN, _NULL = 0x5741524300004000, 0x5741524300004001
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2020-01-01T00:00:00Z"


def record_id(page_id: int | None) -> str:
    high = _NULL if page_id is None else _PLAIN
    return f"<urn:uuid:{uuid.UUID(int=(high << 64) | ((page_id or 0) & (1 << 64) - 1))}>"


def page_of(record: str) -> int | None:
    n = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    low = n & (1 << 64) - 1
    return None if n >> 64 == _NULL else low - (1 << 64) * (low >> 63)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One record as a gzip member of its own; a revisit carries the headers alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to else http + payload
    # A URI holds neither spaces nor line ends.
    uri = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {_DATE}",
        *([f"WARC-Target-URI: {uri}"] if uri else []),
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        *([f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {refers_to}"] if refers_to else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return packer.compress(data) + packer.flush()


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, unpacked one after the other from pieces of it.

    A stream that ends anywhere but between two members raises.
    """
    data = stream.read(READ_BYTES)
    while data:
        unpacker, out = zlib.decompressobj(31), []
        while not unpacker.eof:
            if not data:
                raise ValueError("the archive ends within a record")
            out.append(unpacker.decompress(data))
            data = unpacker.unused_data or stream.read(READ_BYTES)
        yield b"".join(out)


def _fields(lines: list[bytes]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines)}


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload), framed by content length; digests must hold."""
    head, sep, rest = member.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    fields = _fields(lines)
    n = int(fields["content-length"])
    if not sep or not version.startswith(b"WARC/") or rest[n:] != b"\r\n\r\n":
        raise ValueError("not a WARC record of the length that it states")
    block = rest[:n]
    if fields["warc-block-digest"] != f"sha1:{digest(block)}":
        raise ValueError(f"block digest of {fields['warc-record-id']} doesn't hold")
    http, _, payload = block.partition(b"\r\n\r\n")
    http_fields = _fields(http.split(b"\r\n")[1:])
    if fields["warc-type"] == "response" and (
        fields["warc-payload-digest"] != f"sha1:{digest(payload)}" or len(payload) != int(http_fields["content-length"])
    ):
        raise ValueError(f"payload of {fields['warc-record-id']} doesn't hold")
    return fields, http_fields, payload


def _open(path: str, mode: str):
    """A stream at a URI of any store that Arrow reaches; a plain path is local and shared."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")
    if mode == "w":
        store.create_dir(at.rpartition("/")[0], recursive=True)
        return store.open_output_stream(at, compression=None)
    return store.open_input_stream(at, compression=None)


def plan_records(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_revisit_bytes: int) -> DataFrame:
    """(id, url, payload, refers_to, refers): which pages repeat another page's payload.

    Equal payloads are told by SHA-256; the largest id of each, nulls last, is the response.
    The largest ids come from a partial aggregate and a join, so a payload that very many
    pages share is a split key of the join and never a group in one task.
    """
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.col(f"`{url_col}`").alias("url"),
        F.coalesce(F.col(f"`{payload_col}`"), F.lit("")).alias("payload"),
    ).withColumn("key", F.sha2("payload", 256))
    first = rows.groupBy("key").agg(F.max("id").alias("first"))
    known = rows.join(first, "key")
    repeats = (F.octet_length("payload") >= min_revisit_bytes) & ~F.col("id").eqNullSafe(F.col("first"))
    return known.select("id", "url", "payload", F.when(repeats, F.col("first")).alias("refers_to"), repeats.alias("refers"))


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes the records to ``folder`` and returns the manifest (path, n_records, n_bytes).

    A task's files carry its attempt in their names and only files of attempts that ended
    well are in the manifest, so a task that runs twice does no harm.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, n, out, done = TaskContext.get(), 0, None, []
        for frame in frames:
            for id_, null, url, payload, to, refers in frame.itertuples(index=False):
                if out is None:
                    path = f"{folder}/part-{task.partitionId():05d}-{n:05d}-{task.taskAttemptId()}.warc.gz"
                    out, count, size, n = _open(path, "w"), 0, 0, n + 1
                data = record(None if null else int(id_), url, payload.encode(), record_id(int(to)) if refers else None)
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((path, count, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, count, size))
        yield pd.DataFrame(done, columns=["path", "n_records", "n_bytes"])

    zero = F.lit(0).cast("long")
    plain = records.select(
        F.coalesce("id", zero).alias("id"), F.col("id").isNull().alias("null"), "url", "payload",
        F.coalesce("refers_to", zero).alias("refers_to"), "refers",
    )
    return cut(plain.mapInPandas(run, "path string, n_records long, n_bytes long"))


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """A row per record of the archives that the manifest names, every digest and each archive's number of records verified."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, n_records in zip(frame["path"], frame["n_records"]):
                rows, size, n = [], 0, 0
                with _open(path, "r") as stream:
                    for member in members(stream):
                        fields, http, payload = parse(member)
                        refers = fields.get("warc-refers-to")
                        row = (
                            page_of(fields["warc-record-id"]), fields.get("warc-target-uri"), int(http["content-length"]),
                            fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"], page_of(refers) if refers else None,
                        )
                        rows.append((*row, payload) if with_payload else row)
                        n += 1
                        size += len(payload) if with_payload else 200
                        if size > 8 << 20:
                            yield table(rows)
                            rows, size = [], 0
                if n != n_records:
                    raise ValueError(f"{path} holds {n} records and should hold {n_records}")
                yield table(rows)

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 7 if with_payload else 6]

    def table(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return manifest.select("path", "n_records").mapInPandas(run, schema + ", payload binary" * with_payload)


def round_trip(
    pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url",
    payload_col: str = "html", min_revisit_bytes: int = 0, with_payload: bool = False,
) -> DataFrame:
    """Writes a record per page, reads the archives back and returns a row per record.

    * null html: an empty payload; null url: no target URI
    * null id: a record with a marked id, never the response of a page that has an id; if all
      pages of a payload have null ids, all are responses
    * repeated rows: each has its record; with equal largest ids all of them are responses
    * very long payloads are written and read whole, one record at a time; ids are numbers
    * an empty table: no archive and no rows; other columns are not read
    """
    folder = folder or fresh_dir(pages.sparkSession, "warc")
    records = plan_records(pages, id_col, url_col, payload_col, min_revisit_bytes)
    out = read_archives(write_archives(records, folder), with_payload)
    return out.withColumnRenamed("page_id", id_col)
