"""Slices: runs of documents with a table of their distinct words, the unit in which words meet corpus counts.

One pass cuts every input partition into slices of about SLICE_CHARS bytes of text (a longer text is a slice of
its own, never cut) and writes one row a slice: its documents, its distinct words with their counts, and its
tokens as numbers of those words. After that texts never move: `asked` is one row for a slice's distinct word, so
the most frequent word of the corpus is one row a slice, and what the corpus says of a word comes back by slice
and number. Memory: one slice in a Python worker, one row of Spark. The rows are a written table, so that the
passes after it see the same slices whatever is lost or run again.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_slices, written

SLICE_CHARS = 16 << 20

#: ends: how many counted documents. words, groups, counts: of the distinct words, by their numbers.
FIELDS = "slice bigint, ends bigint, words array<binary>, groups array<string>, counts array<bigint>, lengths array<bigint>, tokens binary"


def packed(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, their bytes sorted by weight and compressed."""
    planes = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def slices(docs: DataFrame, keep: list[str], tokenize: Callable[[bytes], list[bytes]], tag: str, text: str = "text", counted: str = "true", group: str = "''", size: int = SLICE_CHARS) -> DataFrame:
    """docs as a written table of slices: FIELDS, and the columns `keep` of each document as array of structs `docs`.

    counted: SQL condition of the documents whose words are counted. group: SQL text; a word of another group is another word.
    """
    rows = docs.select(F.struct(*([F.col(f"`{c}`") for c in keep] or [F.lit(0).alias("none")])).alias("docs"), F.expr(counted).alias("counted"), F.expr(group).alias("group"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("text"))
    schema = T.StructType.fromDDL(FIELDS).add("docs", T.ArrayType(rows.schema["docs"].dataType))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, held = TaskContext.get().partitionId(), 0, 0
        kept: list[pa.RecordBatch] = []
        tables: dict[str, defaultdict[bytes, int]] = {}
        numbers, tokens, flags, owner = itertools.count(), [], [], []

        def row() -> pa.RecordBatch:
            nonlocal done, held, kept, tables, numbers, tokens, flags
            total = sum(map(len, tables.values()))
            words: list[bytes] = [b""] * total
            groups: list[str | None] = [None] * total
            for g, table in tables.items():
                for w, i in table.items():
                    words[i], groups[i] = w, g
            counts = np.zeros(total, dtype=np.int64)
            if any(flags):
                counts += np.bincount(np.concatenate([t for t, f in zip(tokens, flags, strict=True) if f]), minlength=total)
            every = pa.concat_arrays([b.column(0) for b in kept])
            whole = packed(np.concatenate(tokens))
            values = [part << 32 | done, sum(flags), words, groups, counts.tolist(), [len(t) for t in tokens], whole]
            arrays = [pa.array([v], t) for v, t in zip(values, (pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()), strict=True)]
            done, held, kept, tables, numbers, tokens, flags = done + 1, 0, [], {}, itertools.count(), [], []
            return pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array([0, len(every)], pa.int32()), every)], names=[*schema.names])

        for whole in batches:
            for batch in in_slices(whole, "text", size):
                texts, of, counts = (batch.column(c).to_pylist() for c in ("text", "group", "counted"))
                start = 0
                for k, data in enumerate(texts):
                    if held and held + len(data) > size:
                        kept.append(batch.slice(start, k - start))
                        yield row()
                        start = k
                    table = tables.get(of[k])
                    if table is None:
                        table = tables[of[k]] = defaultdict(numbers.__next__)
                    found = tokenize(data)
                    tokens.append(np.fromiter(map(table.__getitem__, found), np.uint32, len(found)))
                    flags.append(bool(counts[k]))
                    held += len(data) + 1
                kept.append(batch.slice(start))
        if tokens:
            yield row()

    return written(rows.mapInArrow(run, schema), tag)


def asked(table: DataFrame) -> DataFrame:
    """slice, at (the word's number there), word, group, n: one row for each distinct word of each slice."""
    each = F.posexplode(F.arrays_zip("words", "groups", "counts")).alias("at", "x")
    return table.select("slice", each).select("slice", "at", F.col("x.words").alias("word"), F.col("x.groups").alias("group"), F.col("x.counts").alias("n"))


def answered(rows: DataFrame, columns: list[str], n: int | None = None) -> DataFrame:
    """rows (slice, at, columns) gathered by slice: `at` and each column as arrays in one order. A slice's words bound a group.

    n: how many slices there are; a task then gathers a few of them, however many fit a partition of the usual size.
    """
    if n is not None:
        rows = rows.repartition(max(n, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "slice")
    each = rows.groupBy("slice").agg(F.collect_list(F.struct("at", *columns)).alias("_all"))
    return each.select("slice", *[F.col(f"_all.{c}").alias(c) for c in ("at", *columns)])
