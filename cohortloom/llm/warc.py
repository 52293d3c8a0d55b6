"""WARC archives of pages: written as one gzip stream a file, then normalised to one gzip member a record.

``write_archives`` deals pages to archive files in the shared folder. ``normalise`` inflates each file once as a
stream, rewrites every record as a member of its own and writes a sidecar index of offsets. ``read_archives``
seeks the members by that index. Manifests name archives by path and by the URI
they are opened by, so any shared store that the folder names will do. File names carry the task attempt and only manifests of finished tasks are read,
so a repeated task leaves nothing half-written in use.

Of pages with equal payloads of at least ``min_bytes``, the one with the largest id becomes the response and the
others refer to it. Defined cases: a null payload is empty; rows that repeat the largest id are responses too; null
ids sort lowest and are read back as null; null urls are empty; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh_path, hot_keys, salted_join

ARCHIVE_BYTES = 64 << 20
MANIFEST = "archive string, records bigint, bytes bigint, uri string"
RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, archive string, record_offset bigint"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(uri: str):
    """The file system of a URI or an absolute local path, and the path within it."""
    return pafs.FileSystem.from_uri(uri)


def _record(page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 2026-01-01T00:00:00Z"]
    lines.append(f"WARC-Target-URI: {''.join(c for c in url if c not in chr(13) + chr(10))}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _head(data: bytes) -> tuple[dict[str, str], int]:
    """Header fields, names in lower case, and where the block begins."""
    end = data.index(b"\r\n\r\n")
    fields = (line.split(":", 1) for line in data[:end].decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, v in fields}, end + 4


def decide(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(id, sha, refers_to) of the pages that revisit another; groups are pre-aggregated before the shuffle."""
    rows = pages.filter(F.octet_length("payload") >= min_bytes).select("id", "sha")
    groups = cut(rows.groupBy("sha").agg(F.max("id").alias("refers_to"), F.count("*").alias("n")), "digests")
    keep = groups.filter("n > 1 and refers_to is not null").drop("n")
    return salted_join(rows, keep, ["sha"], hot_keys(groups, ["sha"]), ["id"]).filter(~F.col("id").eqNullSafe(F.col("refers_to"))).select("id", "sha", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """The manifest of archives, each a single gzip stream of records."""
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    r = decide(rows, min_bytes).select(F.col("id").alias("r_id"), F.col("sha").alias("r_sha"), "refers_to")
    typed = rows.join(r, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("sha") == F.col("r_sha")), "left").select("id", "url", "payload", "sha", "refers_to")

    def write(batches):
        task = TaskContext.get()
        fs, root = _open(folder)
        out, done, size, records, path, uri = None, [], 0, 0, "", ""
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = f"raw-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):04d}.warc.gz"
                    path, uri = f"{root}/{name}", f"{folder}/{name}"
                    fs.create_dir(root, recursive=True)
                    out, gz, size, records = fs.open_output_stream(path, compression=None), zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0
                digest = base64.b32encode(bytes.fromhex(row["sha"])).decode()
                data = _record(row["id"], row["url"], row["payload"], digest, row["refers_to"])
                out.write(gz.compress(data))
                size, records = size + len(data), records + 1
                if size >= ARCHIVE_BYTES:
                    out.write(gz.flush())
                    out.close()
                    done.append((path, records, size, uri))
                    out = None
        if out is not None:
            out.write(gz.flush())
            out.close()
            done.append((path, records, size, uri))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["archive", "records", "bytes", "uri"])

    return cut(typed.mapInArrow(write, MANIFEST), "warc-manifest")


def _stream(fs, path: str):
    """Records of a gzip file, one or many members, inflated once in order."""
    with fs.open_input_stream(path, compression=None) as f:
        gz, data, need = zlib.decompressobj(31), bytearray(), 0
        while raw := f.read(1 << 20):
            while raw:
                if gz.eof:
                    gz = zlib.decompressobj(31)
                data += gz.decompress(raw)
                raw = gz.unused_data
            at = 0
            while len(data) - at >= need:
                end = data.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                size = end + 8 - at + int(_head(bytes(data[at : end + 4]))[0]["content-length"])
                if len(data) - at < size:
                    need = size
                    break
                yield bytes(data[at : at + size])
                at, need = at + size, 0
            del data[:at]
        if data or not gz.eof:
            raise ValueError(f"{path}: the last record is cut off")


def normalise(manifest: DataFrame, folder: str) -> DataFrame:
    """The manifest of rewritten archives; beside each stands ``<archive>.idx`` with offset, length and id of its members."""

    def rewrite(batches):
        task = TaskContext.get()
        fs, root = _open(folder)
        for batch in batches:
            done = []
            for uri in batch.column("uri").to_pylist():
                fs.create_dir(root, recursive=True)
                name = f"members-{task.taskAttemptId()}-{uri.rpartition('/')[2].removeprefix('raw-')}"
                offset, index = 0, []
                with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                    for record in _stream(*_open(uri)):
                        gz = zlib.compressobj(1, zlib.DEFLATED, 31)
                        member = gz.compress(record) + gz.flush()
                        out.write(member)
                        index.append(json.dumps({"offset": offset, "length": len(member), "id": _head(record)[0]["warc-record-id"]}))
                        offset += len(member)
                with fs.open_output_stream(f"{root}/{name}.idx", compression=None) as out:
                    out.write("\n".join(index).encode())
                done.append((f"{root}/{name}", len(index), offset, f"{folder}/{name}"))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["archive", "records", "bytes", "uri"])

    # One short row an archive: a row each to tasks of their own.
    n = max(1, min(10_000, manifest.count()))
    return cut(manifest.repartition(n).mapInArrow(rewrite, MANIFEST), "warc-members")


def _page(uri: str):
    name = uri.strip("<>").rpartition(":")[2]
    return None if name == "None" else int(name)


def read_archives(manifest: DataFrame) -> DataFrame:
    """RECORDS, each read by its own member; lengths and digests are taken from the payloads read, for revisits from their headers."""

    def read(batches):
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                fs, path = _open(uri)
                with fs.open_input_stream(path + ".idx", compression=None) as f:
                    index = [json.loads(x) for x in f.read().decode().splitlines()]
                rows = []
                with fs.open_input_file(path) as f:
                    for entry in index:
                        f.seek(entry["offset"])
                        data = zlib.decompress(f.read(entry["length"]), 31)
                        fields, at = _head(data)
                        http, start = _head(data[at:])
                        payload = data[at + start : at + int(fields["content-length"])]
                        kind = fields["warc-type"]
                        size, digest = int(http["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response":
                            size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        rows.append((_page(fields["warc-record-id"]), size, digest, kind, _page(fields["warc-refers-to"]) if kind == "revisit" else None, path, entry["offset"]))
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "record_offset"]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    n = max(1, min(10_000, manifest.count()))
    return manifest.repartition(n).mapInArrow(read, RECORDS)


def round_trip(pages: DataFrame, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write, normalise and read back."""
    folder = folder or fresh_path(pages.sparkSession, "warc")
    return read_archives(normalise(write_archives(pages, folder, min_bytes), folder))
