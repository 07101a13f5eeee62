"""Vector search in blocks of matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .keyword import ranked

#: Queries of one block, which each task holds beside its batch; more queries run as more blocks.
QUERY_BLOCK = 4096


def unit_rows(lists: list) -> np.ndarray:
    m = np.array(lists, dtype=np.float64)
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def top_cosine(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, id, score, rank: the k nearest vectors by cosine. queries: query_id, vector; vectors: id, vector.

    Each batch meets a block of queries in one matrix product and keeps its k best, so k rows a query and
    batch are all that is shuffled. The queries' number is the caller's bound; they are read in blocks.
    """
    rows = queries.filter("vector IS NOT NULL").orderBy("query_id").collect()
    fields = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("id", vectors.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    kinds = [to_arrow_type(f.dataType) for f in fields]
    out = None
    for start in range(0, max(len(rows), 1), QUERY_BLOCK):
        block = rows[start : start + QUERY_BLOCK]
        ids, q = [r["query_id"] for r in block], unit_rows([r["vector"] for r in block])

        def run(batches: Iterator[pa.RecordBatch], ids=ids, q=q) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows or not len(ids):
                    continue
                mine = np.array(b.column("id").to_pylist())
                v = unit_rows(b.column("vector").to_pylist())
                s = v @ q.T
                key = np.round(s, 9)
                for j in range(len(ids)):
                    # The order of the final rank, so that ties are cut the same way everywhere.
                    best = np.lexsort((mine, -key[:, j]))[:k] if len(mine) <= 4 * k else near_top(key[:, j], mine, k)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([ids[j]] * len(best), mine[best].tolist(), s[best, j]), kinds, strict=True)], names=["query_id", "id", "score"])

        part = vectors.filter("vector IS NOT NULL").select("id", "vector").mapInArrow(run, fields)
        out = part if out is None else out.unionByName(part)
    return ranked(out, ["query_id"], "score", "id", k)


def near_top(key: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    least = np.partition(key, len(key) - k)[len(key) - k]
    some = np.flatnonzero(key >= least)
    return some[np.lexsort((ids[some], -key[some]))[:k]]
