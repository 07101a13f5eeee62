"""Shared plumbing: scratch tables in the cluster's shared folder, Arrow helpers, input clean-up."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import storage
from ..storage import delete, new_path, shared_dir  # noqa: F401

#: Java regex of one white-space separated word; ASCII white space only.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

def written(df: DataFrame, tag: str) -> DataFrame:
    """storage.written, after which the driver lets go of the shuffles that led there, so that executors can drop their files."""
    out = storage.written(df, tag)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | None], schema: str) -> DataFrame:
    """mapInArrow for a function of one batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from f(batch)

    return df.mapInArrow(run, schema)


def in_slices(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into row slices whose `column` holds about most_bytes; one longer row stands alone."""
    import numpy as np

    col = batch.column(column)
    ends = np.cumsum(np.asarray(_lengths(col)))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = int(np.searchsorted(ends, base + most_bytes, side="right"))
        stop = max(stop, start + 1)
        yield batch.slice(start, stop - start)
        start = stop


def _lengths(col: pa.Array):
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(col), 0)


def filesystem(uri: str):
    """A pyarrow file system and the path in it; local paths may come without a scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of df has it (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def annotate(
    df: DataFrame,
    f: Callable[[pa.Array], dict[str, object]] | None,
    fields: str,
    into: str,
    keep: list[str] | None = None,
    text: str = "text",
    slice_bytes: int = 1 << 20,
    start: Callable[[], Callable[[pa.Array], dict[str, object]]] | None = None,
) -> tuple[DataFrame, str]:
    """Add one struct column that f computes from the text column, slice by slice of Arrow batches.

    start gives each task an f of its own. keep: columns that are passed through (all by default), so that a caller who needs no text back
    doesn't pay for it. Returns the DataFrame and the struct's name, which never clashes.
    """
    keep = df.columns if keep is None else keep
    name = free_name(df.select(*keep), into)
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(free_name(df.select(*keep), "_text_in")))
    source = rows.columns[-1]
    out_schema = rows.drop(source).schema.add(name, T.StructType.fromDDL(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = start() if start else f
        for batch in batches:
            for part in in_slices(batch, source, slice_bytes):
                got = of(part.column(source))
                struct = pa.StructArray.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in got.values()], names=list(got))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns - 1)), struct], names=[*part.schema.names[:-1], name])

    return rows.mapInArrow(run, out_schema), name
