"""SentencePiece encoding and decoding by a table of distinct marked words.

In a model whose pieces hold the white-space marker at their front only, no merge crosses the place
before a marker. So a text falls into chunks - spaces, then what follows up to the next space - and each
distinct chunk of the corpus is segmented by the library once:

1. Every input partition asks for the distinct chunks of each of its slices of texts, dealt into buckets by hash.
2. A bucket's requests meet in one task, which segments each chunk the first time that it is asked for and answers
   every request. Only distinct chunks of slices move, never texts.
3. The answers are written by input partition to the shared folder. Each partition reads its own, and the ids come
   back by position. Where a partition finds other texts than it asked for (a plan that isn't deterministic), it
   segments the missing chunks itself.

Memory: a slice's distinct chunks in a reading task, and a bucket's share of the vocabulary in a segmenting one;
there are as many buckets as shuffle partitions, MIN_BUCKETS at least. A model with pieces that cross markers is
refused this path and encodes whole texts.

Defined results: null is the empty text and has no ids; an empty table gives an empty table; repeated
rows are encoded each; texts are never cut; extra columns pass through.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyarrow.fs import FileSelector
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate, filesystem, new_path

MARK = "▁"
CHUNK = re.compile(r" +[^ ]*")
#: Characters of text that share a set of distinct chunks.
SLICE_CHARS = 32 << 20
MIN_BUCKETS = 256
#: Between chunks without their first space: inside a chunk no space follows anything else.
BETWEEN = "\n "
BATCH_ROWS = 64

FIELDS = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


class Codec:
    """Encodes and decodes with one model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        #: Text goes through unchanged but for the dummy prefix, and no piece crosses a marker.
        self.by_chunk = not any(MARK in p.lstrip(MARK) for p in pieces) and self.plain()
        self.id_type = np.dtype("<u2" if len(pieces) <= 1 << 16 else "<u4")

    def plain(self) -> bool:
        """Whether the model keeps text as it is and adds one marker before it."""
        return all("".join(self.model.encode(x, out_type=str)) == y for x, y in (("a", MARK + "a"), (" a", MARK * 2 + "a"), ("a  b ", MARK + "a" + MARK * 2 + "b" + MARK)))

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text that isn't empty, without their first space: the library puts the first marker there by itself."""
        return [c[1:] for c in CHUNK.findall(" " + text.replace(MARK, " "))]

    def segment(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk."""
        ids = self.model.encode(chunks, num_threads=1)
        lone = [self.model.piece_to_id(MARK)]  # the library puts no marker before an empty text
        return [np.array(i if c else lone, dtype=self.id_type).tobytes() for c, i in zip(chunks, ids, strict=True)]

    def encode(self, text: str, table: dict[str, bytes]) -> list[int]:
        """The text's ids by a table of chunks, which gets those that it lacks."""
        if not text:
            return []
        if not self.by_chunk:
            return self.model.encode(text)
        chunks = self.chunks(text)
        try:
            found = b"".join(map(table.__getitem__, chunks))
        except KeyError:
            new = [c for c in dict.fromkeys(chunks) if c not in table]
            table.update(zip(new, self.segment(new), strict=True))
            found = b"".join(map(table.__getitem__, chunks))
        return np.frombuffer(found, dtype=self.id_type).tolist()

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids) if ids else ""


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


#: Chunks, and their ids' lengths in bytes and ids, are compressed where they are made.
ASKED = "bucket int, part int, slice int, chunks binary"
ANSWERED = "part int, slice int, chunks binary, ids binary"


def packed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def split_chunks(blob: bytes) -> list[str]:
    return unpacked(blob).decode().split(BETWEEN)


def ask(texts: DataFrame, model_path: str, buckets: int) -> DataFrame:
    """The distinct chunks of each slice of texts (text) in each partition, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, part, done = codec(model_path), TaskContext.get().partitionId(), 0
        now, seen = 0, {}

        def requests() -> Iterator[pa.RecordBatch]:
            dealt: dict[int, list[str]] = {}
            for x in seen:
                dealt.setdefault(zlib.crc32(x.encode()) % buckets, []).append(x)
            held = [(b, packed(BETWEEN.join(sorted(x)).encode())) for b, x in dealt.items()]
            for k in range(0, len(held), BATCH_ROWS):
                numbers, blobs = zip(*held[k : k + BATCH_ROWS], strict=True)
                n = len(blobs)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in ((numbers, pa.int32()), ([part] * n, pa.int32()), ([now] * n, pa.int32()), (blobs, pa.binary()))], names=["bucket", "part", "slice", "chunks"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if done // SLICE_CHARS != now:
                    yield from requests()
                    now, seen = done // SLICE_CHARS, {}
                if text:
                    seen.update(dict.fromkeys(c.chunks(text)))
                    done += len(text)
        yield from requests()

    return texts.mapInArrow(run, ASKED)


def answer(asked: DataFrame, model_path: str) -> DataFrame:
    """Every request with its ids; each chunk is segmented once, in its bucket's task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, last, table = codec(model_path), None, {}
        for whole in batches:
            for k in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(k, BATCH_ROWS)
                ids = []
                for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("chunks").to_pylist(), strict=True):
                    if bucket != last:
                        last, table = bucket, {}
                    chunks = split_chunks(blob)
                    new = [x for x in chunks if x not in table]
                    if new:
                        table.update(zip(new, c.segment(new), strict=True))
                    found = [table[x] for x in chunks]
                    ids.append(packed(np.fromiter(map(len, found), "<u4", len(found)).tobytes() + b"".join(found)))
                yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("part", "slice", "chunks")), pa.array(ids, pa.binary())], names=["part", "slice", "chunks", "ids"])

    return asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, ANSWERED)


def table_of(folder: str, part: int, number: int) -> dict[str, bytes]:
    """What the slice of that number was answered."""
    files, path = filesystem(f"{folder}/part={part}")
    out: dict[str, bytes] = {}
    for info in files.get_file_info(FileSelector(path, allow_not_found=True)):
        if not info.path.endswith(".parquet"):
            continue
        with files.open_input_file(info.path) as source:
            for batch in pq.ParquetFile(source).iter_batches(BATCH_ROWS, columns=["slice", "chunks", "ids"]):
                for n, blob, found in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    if n == number:
                        chunks, found = split_chunks(blob), unpacked(found)
                        ends = (np.cumsum(np.frombuffer(found, "<u4", len(chunks))) + 4 * len(chunks)).tolist()
                        out.update(zip(chunks, (found[a:b] for a, b in zip([4 * len(chunks), *ends], ends, strict=False)), strict=True))
    return out


def encode_texts(docs: DataFrame, model_path: str, keep: list[str] | None = None, text: str = "text", ids: bool = True) -> tuple[DataFrame, str]:
    """docs with a struct of the ids (if wanted), their number, and digests of ids and decoded text.

    docs is read twice, best from a table: partitions that differ between the readings cost time, not results.
    """
    spark = docs.sparkSession
    folder = None
    if codec(model_path).by_chunk:
        folder = new_path(spark, "chunks")
        buckets = max(MIN_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
        asked = ask(docs.select(F.col(f"`{text}`").cast("string").alias("text")), model_path, buckets)
        answer(asked, model_path).repartition("part").sortWithinPartitions("part", "slice").write.partitionBy("part").parquet(folder)

    def start() -> Callable[[pa.Array], dict[str, object]]:
        c, part, done, now, table = codec(model_path), TaskContext.get().partitionId(), 0, None, {}

        def run(col: pa.Array) -> dict[str, object]:
            nonlocal done, now, table
            found = []
            for t in col.to_pylist():
                if folder and done // SLICE_CHARS != now:
                    now = done // SLICE_CHARS
                    table = table_of(folder, part, now)
                found.append(c.encode(t or "", table))
                done += len(t or "")
            out: dict[str, object] = {"ids": pa.array(found, pa.list_(pa.int32()))} if ids else {}
            out["n_tokens"] = pa.array([len(x) for x in found], pa.int64())
            out["ids_sha256"] = pa.array([sha(",".join(map(str, x))) for x in found], pa.string())
            out["decoded_sha256"] = pa.array([sha(c.decode(x)) for x in found], pa.string())
            return out

        return run

    return annotate(docs, None, ("ids array<int>, " if ids else "") + FIELDS, "pieces", keep, text, start=start)


def decode_ids(rows: DataFrame, model_path: str, column: str = "ids", into: str = "text") -> DataFrame:
    """rows with the text that the ids stand for; null ids give null."""
    @F.pandas_udf("string")
    def decoded(x: pd.Series) -> pd.Series:
        c = codec(model_path)
        return x.map(lambda v: None if v is None else c.decode([int(i) for i in v]))

    return rows.withColumn(into, decoded(F.col(column)))
