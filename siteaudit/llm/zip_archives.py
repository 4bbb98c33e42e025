"""Web archives packed in ZIP files: a writer, and a reader that takes single records by byte ranges.

An archive is a ZIP file with two stored (uncompressed) members: ``archive/data.warc.gz``, WARC records each gzipped on
its own, and ``indexes/index.cdxj``, one line per record with its offset and length in that member. The reader looks
at the end of the file for the directory (plain or ZIP64), finds where the members' bytes lie, reads the index, and
reads each record by its range. Nothing is unpacked to disk.

Archives lie in the session's shared folder and are opened through ``pyarrow.fs``, so the folder can be a mounted disk,
HDFS or an object store. A task gives each archive a new name and reports it as a row; the list of archives is
written as a table before it is read, so files of lost or repeated attempts are never read.

Nulls, repeats, ties: a null html is an empty payload, equal to other empty ones; a null page_id is the smallest and comes
back null; a null url is written as an empty target. Rows that repeat the largest page_id of equal payloads are all
responses. An empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import sys
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteaudit.llm.common import shared_path, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:siteaudit:page:"
#: An archive is closed when its payloads reach so many bytes.
ARCHIVE_BYTES = 16 << 20

RECORD_SCHEMA = ("page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, "
                 "payload_digest string")


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- ZIP directories
class StoredZip:
    """The members of a ZIP file that is read by ranges: ``read_at(offset, length) -> bytes``."""

    def __init__(self, read_at: Callable[[int, int], bytes], size: int):
        self.read_at = read_at
        self.members = {name: (offset, length, method) for name, offset, length, method in self._directory(size)}

    def _end(self, size: int) -> tuple[int, int, int]:
        """Number of members, bytes and offset of the central directory."""
        tail_at = max(0, size - 65557)
        tail = self.read_at(tail_at, size - tail_at)
        at = tail.rfind(b"PK\x05\x06")
        while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError("no end of a central directory: not a ZIP file")
        count, length, offset = struct.unpack_from("<HII", tail, at + 10)
        if count == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF:
            locator = self.read_at(tail_at + at - 20, 20) if tail_at + at >= 20 else b""
            if locator[:4] == b"PK\x06\x07":
                end64 = self.read_at(struct.unpack_from("<Q", locator, 8)[0], 56)
                if end64[:4] != b"PK\x06\x06":
                    raise ValueError("the ZIP64 locator points at no ZIP64 directory end")
                count, length, offset = struct.unpack_from("<QQQ", end64, 32)
        return count, length, offset

    def _directory(self, size: int) -> Iterator[tuple[str, int, int, int]]:
        count, length, offset = self._end(size)
        data, at = self.read_at(offset, length), 0
        for _ in range(count):
            if data[at:at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<HH", data, at + 8)
            packed, full, n, extra_n, comment_n = struct.unpack_from("<IIHHH", data, at + 20)
            header = struct.unpack_from("<I", data, at + 42)[0]
            name = data[at + 46:at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            extra = data[at + 46 + n:at + 46 + n + extra_n]
            packed, header = self._wide(extra, full, packed, header)
            yield name, header, packed, method
            at += 46 + n + extra_n + comment_n

    @staticmethod
    def _wide(extra: bytes, full: int, packed: int, header: int) -> tuple[int, int]:
        """Packed size and header offset, from the ZIP64 field where the plain fields are full."""
        at = 0
        while at + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, at)
            if tag == 1:
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
                if full == 0xFFFFFFFF:
                    wide.pop(0)
                if packed == 0xFFFFFFFF:
                    packed = wide.pop(0)
                if header == 0xFFFFFFFF:
                    header = wide.pop(0)
            at += 4 + n
        return packed, header

    def span(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes lie: offset in the file and length."""
        header, length, method = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is compressed; only stored members can be read by ranges")
        local = self.read_at(header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header for {name}")
        n, extra_n = struct.unpack_from("<HH", local, 26)
        return header + 30 + n + extra_n, length

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        start, full = self.span(name)
        length = full - offset if length is None else length
        if offset < 0 or offset + length > full:
            raise ValueError(f"range outside of {name}")
        return self.read_at(start + offset, length)


# ---------------------------------------------------------------- WARC records
def warc_record(page_id: str | None, url: str | None, payload: bytes, digest: str, keeper: str | None,
                revisit: bool) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + payload
    key = page_id if isinstance(page_id, str) else ""
    target = "".join(c for c in url if c not in "\r\n") if isinstance(url, str) else ""
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{RECORD_ID}{key}>",
            f"WARC-Target-URI: {target}", "WARC-Date: 2026-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{RECORD_ID}{keeper}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The fields of one record; a response's payload is measured and hashed anew."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    out = {"page_id": _key(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"],
           "refers_to": _key(fields.get("WARC-Refers-To", "")), "payload_bytes": None,
           "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:")}
    if out["record_type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if digest32(payload) != out["payload_digest"]:
            raise ValueError(f"record {out['page_id']}: payload differs from its digest")
        out["payload_bytes"] = len(payload)
    return out


def _key(uri: str) -> int | None:
    key = uri.strip("<>").removeprefix(RECORD_ID)
    return int(key) if key else None


def pack(records: list[bytes], keys: list) -> bytes:
    """A ZIP archive of the records and their index."""
    data, index, at = io.BytesIO(), [], 0
    for raw, key in zip(records, keys, strict=True):
        member = gzip.compress(raw, 1, mtime=0)
        data.write(member)
        index.append(json.dumps({"page": key, "offset": at, "length": len(member), "filename": DATA}))
        at += len(member)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        for name, body in ((DATA, data.getvalue()), (INDEX, "\n".join(index).encode())):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=True) as f:
                f.write(body)
    return out.getvalue()


def read_archive(read_at: Callable[[int, int], bytes], size: int) -> Iterator[dict]:
    """Every record that the index lists, each read by its own range."""
    z = StoredZip(read_at, size)
    for line in z.read(INDEX).decode().splitlines():
        entry = json.loads(line)
        yield parse_record(gzip.decompress(z.read(entry["filename"], entry["offset"], entry["length"])))


# ---------------------------------------------------------------- Spark jobs
def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write (page_id, url, html) as archives; returns the table of their paths.

    Equal payloads are found by their SHA-1 in an aggregate that combines map-side; the page with the largest id stays a
    response and the others become revisits of it.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("sha"))
    keepers = rows.groupBy("sha").agg(F.max("page_id").alias("keeper"))
    folder = shared_path(pages.sparkSession, "archives")
    planned = rows.join(keepers, "sha").select(   # ids as text: pandas has no long with nulls
        F.col("page_id").cast("string").alias("page_id"), "url", "html",
        F.col("keeper").cast("string").alias("keeper"), (~F.col("page_id").eqNullSafe(F.col("keeper"))).alias("revisit"))

    def pack_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as pafs

        def close(records, keys):
            fs, root = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (
                pafs.LocalFileSystem(), folder)
            fs.create_dir(root, recursive=True)
            path = f"{root}/{uuid.uuid4().hex}.wacz"
            with fs.open_output_stream(path) as f:
                f.write(pack(records, keys))
            return pd.DataFrame({"path": [path], "records": [len(records)]})

        records, keys, size = [], [], 0
        for batch in batches:
            for page_id, url, text, keeper, revisit in batch.itertuples(index=False):
                payload = text.encode("utf-8")
                records.append(warc_record(page_id, url, payload, digest32(payload), keeper, revisit))
                keys.append(page_id)
                size += len(payload)
                if size >= archive_bytes:
                    yield close(records, keys)
                    records, keys, size = [], [], 0
        if records:
            yield close(records, keys)

    listed = written(planned.mapInPandas(pack_task, "path string, records bigint"), "archive-list")
    return listed.withColumn("folder", F.lit(folder))


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of the listed archives: page_id, url, record_type, refers_to, payload_bytes (null in revisits), digest."""

    def read_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as pafs

        for batch in batches:
            for folder, path in zip(batch["folder"], batch["path"], strict=True):
                fs = pafs.FileSystem.from_uri(folder)[0] if "://" in folder or folder.startswith("file:") else (
                    pafs.LocalFileSystem())
                with fs.open_input_file(path) as f:
                    rows = list(read_archive(lambda offset, length: f.read_at(length, offset), f.size()))
                out = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "refers_to", "payload_bytes",
                                                  "payload_digest"])
                for c in ("page_id", "refers_to", "payload_bytes"):
                    out[c] = out[c].astype("Int64")
                yield out

    return archives.select("folder", "path").mapInPandas(read_task, RECORD_SCHEMA)


def archive_round_trip(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """op9: write the pages as archives, read them back, and give revisits the size and digest of what they refer to."""
    records = written(read_archives(write_archives(pages, archive_bytes)), "records")
    responses = (records.where("record_type = 'response'").groupBy("page_id", "payload_digest")
                 .agg(F.max("payload_bytes").alias("full_bytes"))
                 .withColumnsRenamed({"page_id": "r_id", "payload_digest": "r_digest"}))
    joined = records.join(responses, (F.col("refers_to") == F.col("r_id"))
                          & (F.col("payload_digest") == F.col("r_digest")), "left")
    return joined.select("page_id", F.coalesce("payload_bytes", "full_bytes").alias("payload_bytes"), "payload_digest",
                         "record_type", "refers_to")
