"""A deterministic sharded WARC writer and its reader.

Writing: histograms of the ids' byte counts cut the ids into shards of about equal bytes; a cell that holds more
than a shard is cut again between its own least and greatest id, so far-off ids don't matter. Records are dealt by shard and sorted by id inside, so what is in a file depends on the
rows only, not on the cluster. Each task streams its shards: record headers, digests and gzip members are made
anew, and a file is closed before the member that would take it beyond the size. Files are written under a
temporary name of the task attempt; the written manifest names the attempts that count, their files are
renamed on the executors, and the manifest is published last. A rerun task leaves a temporary file at worst.

Revisits: of the records with equal payloads of at least `min_bytes`, that with the largest id is the
response, the others refer to it. Only digests are grouped and joined; what each revisit refers to meets the
page by being sorted before it.

Defined results: a null payload is empty; a null id is written first, refers to nothing and is a response;
equal rows are a record each, and rows that share the largest id of a payload are all responses; an empty
table gives no file; extra columns are ignored. Ids are 64-bit integers.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import delete, filesystem, written

DATE = "2024-01-01T00:00:00Z"
ROLL_BYTES = 64 << 20
SHARD_BYTES = 16 << 20
#: Shards grow with the input up to this number, then in size. The driver holds FAN cells for each at most.
MOST_SHARDS, FIRST_CELLS, FAN = 1 << 16, 4096, 64
LEVEL = 6
SPACE_ID = uuid.UUID("6f1a5a0e-5d0b-4c36-9d5e-0f5f3f4f7a11")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One record, as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("WARC-Block-Digest", "sha1:" + digest(block)), ("Content-Length", len(block))])
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE_ID, ' '.join(map(str, parts)))}>"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, nth: int) -> bytes:
    mine = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, mine, nth)), ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url or f"urn:page:{page_id}", safe="%/:=&?~#+!$,;'@()*[]")), ("WARC-Payload-Digest", "sha1:" + mine), ("Content-Type", "application/http;msgtype=response"),
    ]
    if page_id is not None:
        fields.append(("X-Page-Id", page_id))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, mine, 0)), ("X-Refers-To-Page-Id", refers_to)]
    return record(fields, http + (payload if refers_to is None else b""))


class Roller:
    """The files of one shard, one after the other."""

    def __init__(self, folder: str, shard: int, roll_bytes: int):
        self.folder, self.shard, self.roll_bytes, self.attempt = folder, shard, roll_bytes, uuid.uuid4().hex
        self.number, self.stream, self.rows = 0, None, []
        self.fs, self.path = filesystem(folder)

    def add(self, member: bytes) -> None:
        if self.stream and self.size + len(member) > self.roll_bytes:
            self.close()
        if not self.stream:
            self.name = f"part-{self.shard:06d}-{self.number:04d}.warc.gz"
            self.fs.create_dir(f"{self.path}/_temporary/{self.attempt}", recursive=True)
            self.stream = self.fs.open_output_stream(f"{self.path}/_temporary/{self.attempt}/{self.name}", compression=None)
            self.size, self.records, self.sum = 0, 0, hashlib.sha256()
            self.write(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("info", self.name)), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        self.write(member)
        self.records += 1

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.sum.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.stream:
            self.stream.close()
            self.rows.append((self.name, f"_temporary/{self.attempt}/{self.name}", self.records, self.size, self.sum.hexdigest()))
            self.number, self.stream = self.number + 1, None


MANIFEST = "file string, made_as string, records bigint, bytes bigint, sha256 string"


def place(starts: list[int]) -> Callable[[Column], Column]:
    """The number of the last of the sorted starts at or below an id, -1 before the first and for null; a binary search."""
    bounds = np.array(starts, dtype=np.int64)

    @F.pandas_udf("int")
    def found(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        out = np.full(len(ids), -1, dtype=np.int32)
        out[known] = np.searchsorted(bounds, np.array(ids[known].tolist(), dtype=np.int64), side="right") - 1
        return pd.Series(out)

    return found


def cells_of(low: int, high: int, n: int) -> list[int]:
    """The first ids of up to n equal parts of low..high."""
    n = min(n, high - low + 1)
    return [low + (high - low + 1) * k // n for k in range(n)]


def shard_starts(sized: DataFrame, shard_bytes: int) -> list[int]:
    """The first id of each shard; sized has page_id and n_bytes."""
    named = sized.filter("page_id IS NOT NULL")
    low, high, total = named.agg(F.min("page_id"), F.max("page_id"), F.sum("n_bytes")).head()
    if low is None:
        return [0]
    shard_bytes = max(shard_bytes, -(-total // MOST_SHARDS))
    done: list[tuple[int, int]] = []
    heavy, fan = [(low, high)], FIRST_CELLS
    while heavy:
        bounds = sorted({b for low, high in heavy for b in (*cells_of(low, high, fan), high + 1)})
        inside = [False] * len(bounds)
        at = {b: k for k, b in enumerate(bounds)}
        for low, high in heavy:
            inside[at[low] : at[high + 1]] = [True] * (at[high + 1] - at[low])
        if bounds[-1] >= 1 << 63:
            bounds.pop()
        found = named.groupBy(place(bounds)("page_id").alias("cell")).agg(F.min("page_id"), F.max("page_id"), F.sum("n_bytes"))
        heavy, fan = [], FAN
        for cell, low, high, size in found.filter("cell >= 0").collect():
            if not inside[cell]:
                continue
            if size > shard_bytes and low < high:
                heavy.append((low, high))
            else:
                done.append((low, size))
    starts, held = [], 0
    for low, size in sorted(done):
        if not starts or held + size > shard_bytes:
            starts.append(low)
            held = 0
        held += size
    return starts


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES, id_col: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write pages as WARC files to a folder; returns the manifest, which is also in <folder>/_manifest."""
    spark = pages.sparkSession
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.encode(F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit("")), "utf-8").alias("payload"))
    named = written(rows.select("page_id", F.sha1("payload").alias("sha"), F.octet_length("payload").cast("long").alias("n_bytes")), "digests")
    most = named.filter(F.col("page_id").isNotNull() & (F.col("n_bytes") >= min_bytes)).groupBy("sha", "n_bytes").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    revisits = named.join(most, ["sha", "n_bytes"]).filter("page_id < refers_to").select("page_id", "sha", "refers_to").distinct()
    starts = shard_starts(named, shard_bytes)
    shard = F.greatest(place(starts)(F.col("page_id")), F.lit(0))
    each = rows.withColumns({"shard": shard, "kind": F.lit(1), "refers_to": F.lit(None).cast("long"), "sha": F.lit(None).cast("string")})
    notes = revisits.withColumns({"shard": shard, "kind": F.lit(0), "url": F.lit(None).cast("string"), "payload": F.lit(None).cast("binary")})
    sorted_rows = each.unionByName(notes).repartitionById(len(starts), "shard").sortWithinPartitions("shard", "page_id", "kind", "sha", "payload", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(roller: Roller) -> pa.RecordBatch:
            roller.close()
            columns = list(zip(*roller.rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["file", "made_as", "records", "bytes", "sha256"])

        roller, last, nth, refers = None, object(), 0, {}
        for batch in batches:
            for page_id, url_, body, shard_, kind, refers_to, sha in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "shard", "kind", "refers_to", "sha")), strict=True):
                if roller is None or shard_ != roller.shard:
                    if roller:
                        yield out(roller)
                    roller = Roller(folder, shard_, roll_bytes)
                if page_id != last:
                    last, nth, refers = page_id, 0, {}
                if kind == 0:
                    refers[sha] = refers_to
                    continue
                target = refers.get(hashlib.sha1(body).hexdigest()) if refers else None
                roller.add(page_record(page_id, url_, body, target, nth))
                nth += 1
        if roller:
            yield out(roller)

    made = written(sorted_rows.mapInArrow(write, MANIFEST), "manifest")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = filesystem(folder)
        for batch in batches:
            for name, tmp, size in zip(batch.column("file").to_pylist(), batch.column("made_as").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                done = files.get_file_info(f"{path}/{name}")
                if not (done.is_file and done.size == size and not files.get_file_info(f"{path}/{tmp}").is_file):
                    files.move(f"{path}/{tmp}", f"{path}/{name}")
            yield batch

    made.mapInArrow(commit, MANIFEST).drop("made_as").write.mode("overwrite").parquet(f"{folder}/_manifest")
    delete(spark, f"{folder}/_temporary")
    return spark.read.parquet(f"{folder}/_manifest")


def members(stream) -> Iterator[bytes]:
    """The gzip members of a file, each decompressed."""
    data, out, inflate = b"", [], None
    while True:
        if not data:
            data = stream.read(1 << 20)
            if not data:
                break
        if inflate is None:
            inflate = zlib.decompressobj(31)
        out.append(inflate.decompress(data))
        data = b""
        if inflate.eof:
            data, inflate = inflate.unused_data, None
            yield b"".join(out)
            out = []
    if inflate is not None:
        raise ValueError("a WARC file ends within a record")


def fields_of(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}


READ = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary, file string"


def read_warc(manifest: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """The page records of the files that the manifest names; stored digests are checked against the content."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = filesystem(folder)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
        names = [f.split(" ")[0] for f in READ.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, held = [], 0
                with files.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for raw in members(stream):
                        head, _, rest = raw.partition(b"\r\n\r\n")
                        f = fields_of(head)
                        if f["warc-type"] not in ("response", "revisit"):
                            continue
                        block = rest[: int(f["content-length"])]
                        if "sha1:" + digest(block) != f["warc-block-digest"]:
                            raise ValueError(f"{name}: a block doesn't match its digest")
                        http, _, body = block.partition(b"\r\n\r\n")
                        mine = f["warc-payload-digest"].removeprefix("sha1:")
                        if f["warc-type"] == "response" and digest(body) != mine:
                            raise ValueError(f"{name}: a payload doesn't match its digest")
                        number = lambda k: int(f[k]) if k in f else None  # noqa: B023, E731
                        rows.append((number("x-page-id"), f["warc-target-uri"], int(fields_of(http)["content-length"]), mine, f["warc-type"], number("x-refers-to-page-id"), body if payload and f["warc-type"] == "response" else None, name))
                        held += len(body)
                        if held > 8 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    # A number keeps Spark from putting these few rows into one task.
    return manifest.select("file").repartition(min(10_000, max(1, manifest.count()))).mapInArrow(read, READ)


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last_id FROM pages
), d AS (
  SELECT *, list_transform([0, 1, 2, 3, 4, 5, 6, 7], lambda k: ('0x' || substr(h, 5 * k + 1, 5))::BIGINT) AS v FROM p
)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(v, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x // 32768) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x // 1024) % 32 + 1, 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x // 32) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x % 32 + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last_id THEN last_id END AS refers_to
FROM d
"""
