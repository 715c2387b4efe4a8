"""WARC files from page rows, and back.

Records are range-sorted by page_id into shards whose borders depend on the ids alone. A task
writes the shard's files one gzip member a record, starts a new file once the compressed size
is reached, and gives each file its final name only when complete; a repeated task writes the
same bytes under the same names. A manifest, committed by Spark after all files, lists the
files that make up the archive; readers trust nothing else.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from docketry.llm.common import join_skewed, materialise, running_total, scratch_path

MANIFEST = "file string, shard long, part int, records long, bytes long, sha256 string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_RECORDS = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
])
#: Up to so many groups of rows that each fill a shard are sent to every task (60 bytes each); more are joined by a shuffle.
BROADCAST_GROUPS = 500_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = re.sub("^file:/*", "/", path)
    if path.startswith("/"):
        return pa.fs.LocalFileSystem(), path
    return pa.fs.FileSystem.from_uri(path)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


@F.pandas_udf(BinaryType())
def packed(payload: pd.Series) -> pd.Series:
    """Payloads as they travel between tasks: html shrinks to a third, at little cost."""
    return payload.map(lambda x: zlib.compress(x, 1))


def _base32(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def _header(pairs: list[tuple[str, object]], block: bytes) -> bytes:
    sha1 = "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
    lines = [f"{k}: {v}" for k, v in [*pairs, ("WARC-Block-Digest", sha1), ("Content-Length", len(block))] if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block + b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes | None, n: int, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record; a revisit (payload None) has the HTTP header alone, which tells the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    revisit = payload is None
    return _header(
        [
            ("WARC-Type", "revisit" if revisit else "response"),
            ("WARC-Record-ID", record_id(page_id, digest)),
            ("WARC-Date", date),
            ("WARC-Target-URI", target),
            ("WARC-Payload-Digest", _base32(digest)),
            ("WARC-Profile", PROFILE if revisit else None),
            ("WARC-Refers-To", record_id(refers_to, digest) if revisit else None),
            ("X-Page-Id", page_id),
            ("X-Refers-To-Page-Id", refers_to if revisit else None),
            ("Content-Type", "application/http; msgtype=response"),
        ],
        http + (payload or b""),
    )


class _File:
    """An archive file under a temporary name until it is closed."""

    def __init__(self, folder: str, name: str, date: str, level: int):
        self.fs, self.folder = file_system(folder)
        self.name, self.level = name, level
        self.temporary = f"{self.folder}/_temporary-{uuid.uuid4().hex}-{name}"
        self.out = self.fs.open_output_stream(self.temporary, compression=None)
        self.bytes = self.records = 0
        self.sha256 = hashlib.sha256()
        self.add(_header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, name)), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        self.records = 0

    def add(self, data: bytes) -> None:
        packer = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        member = packer.compress(data) + packer.flush()
        self.out.write(member)
        self.sha256.update(member)
        self.bytes += len(member)
        self.records += 1

    def close(self) -> str:
        self.out.close()
        final = f"{self.folder}/{self.name}"
        if self.fs.get_file_info(final).type == pa.fs.FileType.File:  # an earlier attempt wrote the same bytes
            self.fs.delete_file(self.temporary)
        else:
            self.fs.move(self.temporary, final)
        return self.sha256.hexdigest()


def _write(batches: Iterator[pa.RecordBatch], folder: str, roll_bytes: int, date: str, level: int) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their shard; one without payload tells what the rows of its id and digest behind it refer to."""
    rows: list[tuple] = []
    shard = part = None
    now: _File | None = None
    told: tuple = ()

    def close() -> None:
        if now:
            rows.append((now.name, shard, part, now.records, now.bytes, now.close()))

    for batch in batches:
        for row in batch.to_pylist():
            if row["payload"] is None:
                told = (row["page_id"], row["payload_digest"], row["payload_bytes"], row["refers_to"])
                continue
            if row["shard"] != shard:
                close()
                now, shard, part = None, row["shard"], -1
            key = (row["page_id"], row["payload_digest"], row["payload_bytes"])
            revisit = told[:3] == key
            payload = None if revisit else zlib.decompress(row["payload"])
            written = record(row["page_id"], row["url"], payload, row["payload_bytes"], row["payload_digest"], told[3] if revisit else None, date)
            for _ in range(row["copies"]):
                if now and now.bytes >= roll_bytes:
                    close()
                    now = None
                if now is None:
                    part += 1
                    now = _File(folder, f"shard-{shard:06d}-{part:05d}.warc.gz", date, level)
                now.add(written)
    close()
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "shard", "part", "records", "bytes", "sha256"])


def _keys(known: np.ndarray, ids: np.ndarray, digests: list[str], serials: np.ndarray) -> np.ndarray:
    """Twenty bytes that sort as the id, an unknown one first, then by the digest, then by the serial number."""
    out = np.zeros(len(ids), [("id", ">u8"), ("digest", ">u4"), ("serial", ">u8")])
    out["id"] = np.where(known, ids.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63), np.uint64(0))
    out["digest"] = [int(d[:8], 16) for d in digests]
    out["serial"] = serials
    return out.view("S20")


def _borders(listed: DataFrame, shard_bytes: int) -> np.ndarray:
    """Keys at which shards begin, from the sums of payloads before each row in their order; a row for each shard reaches the driver."""
    order = ["known", "page_id", "head", "serial"]
    placed = running_total(listed, order, "bytes", into="before")
    first = placed.groupBy(F.floor(F.col("before") / shard_bytes).alias("shard")).agg(F.min(F.struct(*order)).alias("key"))
    found = first.filter("shard > 0").select("key.known", F.coalesce("key.page_id", F.lit(0)).alias("id"), "key.head", "key.serial").toArrow()
    return np.sort(_keys(found["known"].to_numpy(), found["id"].to_numpy(), found["head"].to_pylist(), found["serial"].to_numpy()))


def _clear(folder: str) -> None:
    """Remove what attempts that failed have left; the manifest is there, so nothing is being written."""
    fs, at = file_system(folder)
    for f in fs.get_file_info(pa.fs.FileSelector(at)):
        if f.base_name.startswith("_temporary-"):
            fs.delete_file(f.path)


def write_warc(
    pages: DataFrame, folder: str, shard_bytes: int = 32_000_000, roll_bytes: int = 6_000_000,
    revisit_bytes: int = 1000, date: str = "2000-01-01T00:00:00Z", level: int = 6,
) -> DataFrame:
    """Write pages(page_id, url, html) below `folder`; returns the committed manifest.

    Null html is the empty payload, a null url becomes urn:page:<id>. Of payloads of at least
    `revisit_bytes` that are equal, the row with the largest page_id is the response and the
    others are revisits without payload; rows that repeat that id are responses too. An empty
    table gives an empty manifest. Other columns are ignored.

    Records are sorted by page_id, null first, and digest, and cut into shards of about
    `shard_bytes` of payloads. Which copies are revisits and where shards begin is found on ids and
    digests alone; payloads travel once, to their shard. Rows that share id and digest and would
    fill a shard are counted first and dealt to as many shards as they fill.
    """
    fs, at = file_system(folder)
    fs.create_dir(at, recursive=True)
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumns(
        {"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")}
    )
    listed = materialise(rows.select("page_id", "payload_bytes", "payload_digest"), "warc-listed")
    content = F.concat_ws(":", "payload_digest", "payload_bytes").alias("content")
    ids = listed.filter(F.col("payload_bytes") >= revisit_bytes).select("page_id", "payload_bytes", "payload_digest", content)
    groups = materialise(ids.groupBy("content").agg(F.max("page_id").alias("response"), F.count("*").alias("copies")).filter("copies > 1 and response is not null"), "warc-groups")
    revisits = join_skewed(ids, groups, "content", "copies").filter("page_id is null or page_id <> response")
    revisits = revisits.select("page_id", "payload_bytes", "payload_digest", F.col("response").alias("refers_to")).distinct()
    name = F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "payload_digest", "payload_bytes")
    # Groups that fill a shard: fewer than there are shards, a few short values each.
    counted = listed.groupBy("page_id", "payload_digest", "payload_bytes").agg(F.count("*").alias("n")).filter((F.col("n") > 1) & (F.col("n") * F.col("payload_bytes") > shard_bytes))
    counted = materialise(counted.withColumns({"name": name, "parts": F.ceil(F.col("n") * F.col("payload_bytes") / shard_bytes).cast("long")}), "warc-hot")
    hot = counted.select("name", "parts")
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_GROUPS else hot
    serials = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    share = F.expr("n div parts + if(serial < n % parts, 1, 0)")
    rows = rows.withColumns({"name": name, "payload": packed("payload")})
    single = rows.join(hot, "name", "left_anti").withColumns({"copies": F.lit(1).cast("long"), "serial": F.lit(0).cast("long")})
    many = rows.join(hot, "name").groupBy("name", "page_id", "url", "payload_bytes", "payload_digest", "parts").agg(F.count("*").alias("n"), F.min("payload").alias("payload"))
    many = many.withColumn("serial", serials).withColumn("copies", share).filter("copies > 0")
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "payload", "copies", "serial"]
    given = single.select(*columns).unionByName(many.select(*columns)).withColumn("refers_to", F.lit(None).cast("long"))
    parts = revisits.withColumn("name", name).join(hot, "name", "left").withColumn("serial", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)))
    told = parts.select("page_id", "payload_bytes", "payload_digest", "serial", "refers_to", F.lit(0).cast("long").alias("copies"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"))
    cold = listed.withColumn("name", name).join(hot, "name", "left_anti").withColumns({"serial": F.lit(0).cast("long"), "bytes": F.col("payload_bytes")})
    filled = counted.withColumn("serial", serials).withColumn("bytes", share * F.col("payload_bytes"))
    key = [F.col("page_id").isNotNull().alias("known"), "page_id", F.substring("payload_digest", 1, 8).alias("head"), "serial", "bytes"]
    borders = _borders(cold.select(*key).unionByName(filled.select(*key)), shard_bytes)

    @F.pandas_udf("long")
    def shard(known: pd.Series, ids: pd.Series, digests: pd.Series, serials: pd.Series) -> pd.Series:
        keys = _keys(known.to_numpy(), ids.to_numpy(), digests.tolist(), serials.to_numpy())
        return pd.Series(np.searchsorted(borders, keys, side="right").astype(np.int64))

    both = given.unionByName(told)
    both = both.withColumns({"shard": shard(F.col("page_id").isNotNull(), F.coalesce("page_id", F.lit(0)), "payload_digest", "serial"), "told": F.col("payload").isNotNull()})
    written = (
        both.repartition("shard").sortWithinPartitions("shard", "page_id", F.substring("payload_digest", 1, 8), "serial", "payload_digest", "payload_bytes", "told", "url")
        .mapInArrow(partial(_write, folder=folder, roll_bytes=roll_bytes, date=date, level=level), MANIFEST)
    )
    written.write.parquet(f"{folder}/_manifest")
    _clear(folder)
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def _members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    rest, unpack, out = b"", zlib.decompressobj(31), []
    while data := rest or stream.read(1 << 20):
        out.append(unpack.decompress(data))
        rest = b""
        if unpack.eof:
            yield b"".join(out)
            rest, unpack, out = unpack.unused_data, zlib.decompressobj(31), []
    if out and any(out):
        raise ValueError("the archive ends inside a record")


def parse(data: bytes) -> dict | None:
    """The row of a record, after checking both digests; None for records that are not pages."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    block = rest[: int(fields["Content-Length"])]
    if "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() != fields["WARC-Block-Digest"]:
        raise ValueError(f"block digest of {fields['WARC-Record-ID']} is wrong")
    kind = fields["WARC-Type"]
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if kind == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "page_id": number("X-Page-Id"), "url": fields["WARC-Target-URI"], "payload_bytes": n, "payload_digest": digest,
        "record_type": kind, "refers_to": number("X-Refers-To-Page-Id"), "payload": payload if kind == "response" else None,
    }


def _read(batches: Iterator[pa.RecordBatch], folder: str, payloads: bool) -> Iterator[pa.RecordBatch]:
    fs, at = file_system(folder)
    for batch in batches:
        for name in batch.column("file").to_pylist():
            rows, held = [], 0
            with fs.open_input_stream(f"{at}/{name}", compression=None) as stream:
                for member in _members(stream):
                    if row := parse(member):
                        rows.append(row if payloads else row | {"payload": None})
                        held += len(member) if payloads else 200
                    if held > 4_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)
                        rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)


def read_warc(spark: SparkSession, folder: str, payloads: bool = True, task_bytes: int = 8_000_000) -> DataFrame:
    """The page records of the files that the manifest of `folder` lists, digests checked; a task reads about `task_bytes`."""
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")
    n, total = files.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    files = files.select("file").repartitionByRange(max(1, min(n, total // task_bytes)), "file")
    return files.mapInArrow(partial(_read, folder=folder, payloads=payloads), RECORDS)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write pages to a new folder in the shared directory and read them back, without payloads."""
    folder = scratch_path(pages.sparkSession, "warc")
    write_warc(pages, folder)
    return read_warc(pages.sparkSession, folder, payloads=False).drop("payload")
