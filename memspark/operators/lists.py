"""A vector index of inverted lists: every vector stands in the list of its nearest centroid.

Centroids are fitted by spherical k-means on a sample of SAMPLE vectors a list at most (those whose ids hash lowest); every
vector of the table is indexed, whatever the sample. A list knows its radius, the widest angle between its centroid and a
vector of its own. By the triangle inequality on angles no vector of a list is nearer to a query than the centroid's angle less the
radius, which gives two searches: the nearest `probes` lists (fast, recall to be measured), or, from what these give, all
lists that the bound doesn't rule out (exact).

A list's vectors meet its queries in chunks of CHUNK vectors and blocks of QUERIES queries, so that a list that
holds a third of the table is many tasks. The driver holds the centroids: MOST_LISTS x dimensions numbers at most.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..storage import filesystem, new_path, read_text, write_text, written
from .keyword import ranked
from .vector import unit_rows

MOST_LISTS, SAMPLE, STEPS = 4096, 64, 8
CHUNK, QUERIES = 1 << 14, 1 << 12
#: Queries of a block that meet a chunk in one matrix product: CHUNK x ROWS numbers, 32 MiB.
ROWS = 1 << 8
#: Numbers that a task holds at once while it finds rows' lists, 32 MiB: angles and copies of vectors come in slices of a batch.
NUMBERS = 1 << 22
#: Lists of a tile's side: a task that finds similar pairs holds twice so many chunks.
TILE = 8
#: Radians that rounding in a cosine near 1 may cost.
SLACK = 1e-6


@dataclass(frozen=True)
class Lists:
    """A stored index: vectors (id, vector, list) by list; centroids, radii and sizes by number."""

    path: str
    id_type: str
    centroids: np.ndarray = field(compare=False)
    radius: np.ndarray = field(compare=False)
    size: np.ndarray = field(compare=False)

    def vectors(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"id {self.id_type}, vector array<double>, list int").parquet(f"{self.path}/vectors")


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Unit rows of a column of vectors, from Arrow's numbers themselves where all are of one length and without nulls."""
    whole = column.combine_chunks()
    flat = whole.flatten()
    n = len(whole)
    if n and not whole.null_count and not flat.null_count and len(flat) % n == 0 and (np.diff(whole.offsets.to_numpy()) == len(flat) // n).all():
        return unit_rows(flat.to_numpy(zero_copy_only=False).reshape(n, -1))
    return unit_rows(column.to_pylist())


def slices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Batches in slices of NUMBERS / width rows, where a row comes to `width` numbers."""
    rows = max(1, NUMBERS // max(1, width))
    for b in batches:
        for start in range(0, b.num_rows, rows):
            yield b.slice(start, rows)


def centroids_of(sample: np.ndarray, lists: int) -> np.ndarray:
    """Spherical k-means, started from evenly spaced rows of the sample."""
    now = sample[np.linspace(0, len(sample) - 1, lists).astype(int)].copy()
    for _ in range(STEPS):
        of = np.argmax(sample @ now.T, axis=1)
        total = np.zeros_like(now)
        np.add.at(total, of, sample)
        norm = np.linalg.norm(total, axis=1)
        now[norm > 0] = total[norm > 0] / norm[norm > 0, None]
    return now


def build(vectors: DataFrame, path: str | None = None, lists: int | None = None) -> Lists:
    """Index vectors (id, vector); rows without a vector stay out. lists: by default the root of their number."""
    spark = vectors.sparkSession
    path = path or new_path(spark, "lists")
    rows = vectors.filter("vector IS NOT NULL").select("id", F.col("vector").cast("array<double>").alias("vector"))
    n = rows.count()
    lists = max(1, min(MOST_LISTS, lists or math.isqrt(n), max(n, 1)))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE * lists).select("vector").collect()
    centroids = centroids_of(unit_rows([r[0] for r in sample]), lists) if sample else np.zeros((1, 1))
    schema = T.StructType([*rows.schema.fields, T.StructField("list", T.IntegerType()), T.StructField("angle", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, lists):
            s = unit_rows(b.column("vector").to_pylist()) @ centroids.T
            of = np.argmax(s, axis=1)
            angle = np.arccos(np.clip(s[np.arange(len(of)), of], -1, 1))
            yield pa.RecordBatch.from_arrays([b.column("id").cast(arrow.field("id").type), b.column("vector").cast(arrow.field("vector").type), pa.array(of, pa.int32()), pa.array(angle)], schema=arrow)

    dealt = rows.mapInArrow(run, schema).repartition("list", F.pmod(F.xxhash64("id"), F.lit(16)))
    dealt.write.partitionBy("list").parquet(f"{path}/vectors")
    radius, size = np.zeros(lists), np.zeros(lists, dtype=np.int64)
    if n:
        for r in spark.read.parquet(f"{path}/vectors").groupBy("list").agg(F.max("angle").alias("angle"), F.count(F.lit(1)).alias("n")).collect():
            radius[r["list"]], size[r["list"]] = r["angle"], r["n"]
    out = Lists(path, rows.schema["id"].dataType.simpleString(), centroids, radius, size)
    write_text(spark, f"{path}/lists.json", json.dumps({"id_type": out.id_type, "centroids": centroids.tolist(), "radius": radius.tolist(), "size": size.tolist()}))
    return out


def opened(spark: SparkSession, path: str) -> Lists | None:
    """The index that a folder holds; None unless it is whole."""
    text = read_text(spark, f"{path}/lists.json")
    if not text:
        return None
    m = json.loads(text)
    return Lists(path, m["id_type"], *(np.array(m[k]) for k in ("centroids", "radius", "size")))


def dealt(index: Lists, queries: DataFrame, probes: int, found: bool) -> DataFrame:
    """queries (query_id, vector; with found also floor: the least cosine of what they have, or null) with a row for each list to look into.

    Without found the nearest `probes` lists; with it the others that can hold something as near as the floor.
    """
    fields = [queries.schema["query_id"], T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("list", T.IntegerType())]
    arrow = to_arrow_schema(T.StructType(fields))
    centroids, radius, size = index.centroids, index.radius, index.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, centroids.size):  # a query can meet all lists, with its vector for each
            if not size.any():
                continue
            angle = np.arccos(np.clip(unit_rows(b.column("vector").to_pylist()) @ centroids.T, -1, 1))
            angle[:, size == 0] = np.inf
            near = np.argsort(np.argsort(angle, axis=1, kind="stable"), axis=1) < probes
            if found:
                floor = np.array([-1.0 if x is None else x for x in b.column("floor").to_pylist()])
                near = ~near & (angle - radius - SLACK <= np.arccos(np.clip(floor, -1, 1))[:, None])
            row, number = np.nonzero(near & np.isfinite(angle))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column("query_id").take(take), b.column("vector").take(take).cast(arrow.field("vector").type), pa.array(number, pa.int32())], schema=arrow)

    return queries.mapInArrow(run, T.StructType(fields))


def met(index: Lists, asked: DataFrame, k: int) -> DataFrame:
    """query_id, id, score: the k nearest of each chunk of the lists that are asked (query_id, vector, list)."""
    spark = asked.sparkSession
    asked = written(asked, "asked-lists")
    sizes = spark.createDataFrame([(i, max(1, -(-int(n) // CHUNK))) for i, n in enumerate(index.size)], "list int, chunks int")  # MOST_LISTS rows
    blocks = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("blocks")).join(F.broadcast(sizes), "list")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = asked.join(F.broadcast(blocks), "list").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).withColumn("chunk", each("chunks"))
    held = index.vectors(spark).join(F.broadcast(blocks), "list").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).withColumn("block", each("blocks"))
    out = T.StructType([asked.schema["query_id"], T.StructField("id", held.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(out)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        ids = np.array(right.column("id").to_pylist())
        u, v = matrix(left.column("vector")), matrix(right.column("vector"))
        row, col, score = [], [], []
        for start in range(0, len(u), ROWS):
            s = u[start : start + ROWS] @ v.T
            for i in range(len(s)):
                key = np.round(s[i], 9)
                some = np.flatnonzero(key >= np.partition(key, len(ids) - k)[len(ids) - k]) if len(ids) > k else np.arange(len(ids))
                some = some[np.lexsort((ids[some], -key[some]))[:k]]
                row.append(np.full(len(some), start + i))
                col.append(some)
                score.append(s[i, some])
        row, col = np.concatenate(row), np.concatenate(col)
        return pa.Table.from_arrays([left.column("query_id").take(pa.array(row)), right.column("id").take(pa.array(col)), pa.chunked_array([np.concatenate(score)])], schema=arrow)

    key = ["list", "chunk", "block"]
    return mine.select(*key, "query_id", "vector").groupBy(*key).cogroup(held.select(*key, "id", "vector").groupBy(*key)).applyInArrow(run, out)


def search(index: Lists, queries: DataFrame, k: int, probes: int = 8, exact: bool = True) -> DataFrame:
    """query_id, id, score, rank: the k nearest vectors by cosine. exact: whatever the probes missed as well."""
    asked = queries.filter("vector IS NOT NULL").select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    first = written(met(index, dealt(index, asked, probes, False), k), "near")
    if not exact:
        return ranked(first, ["query_id"], "score", "id", k)
    floor = ranked(first, ["query_id"], "score", "id", k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    rest = met(index, dealt(index, asked.join(floor, "query_id", "left"), probes, True), k)
    return ranked(first.unionByName(rest), ["query_id"], "score", "id", k)


def similar_pairs(index: Lists, spark: SparkSession, threshold: float) -> DataFrame:
    """a, b (a < b), score: all pairs of indexed vectors with at least this cosine (over 0), exactly; a zero vector has no pair.

    Two lists meet only if their centroids' angle less both radii leaves room for the threshold, chunk by chunk.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be over 0")
    between = np.arccos(np.clip(index.centroids @ index.centroids.T, -1, 1)) - index.radius[:, None] - index.radius[None]
    full = index.size > 0
    near = np.triu((between <= math.acos(max(-1.0, min(1.0, threshold))) + SLACK) & full[:, None] & full[None])
    one, two = np.nonzero(near)
    chunks = np.maximum(1, -(-index.size // CHUNK)).astype(np.int32)
    links = spark.createDataFrame(pa.table({"one": one.astype(np.int32), "two": two.astype(np.int32), "n_one": chunks[one], "n_two": chunks[two]}))
    # A task is two chunks; within a list the second chunk isn't before the first.
    tasks = links.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("n_one") - 1))).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("n_two") - 1)))
    tasks = written(tasks.filter("one < two OR x <= y").select("one", "x", "two", "y"), "pair-tasks")
    sizes = spark.createDataFrame(pa.table({"list": np.arange(len(chunks), dtype=np.int32), "chunks": chunks}))  # MOST_LISTS rows
    held = index.vectors(spark).join(F.broadcast(sizes), "list").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).select("list", "chunk", "id", "vector")
    # A chunk is written once, however many others it meets; tasks read the two chunks that they compare.
    path = new_path(spark, "chunks")
    held.repartition("list", "chunk").write.partitionBy("list", "chunk").parquet(path)
    kind = held.schema["id"].dataType
    out = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, where = filesystem(path)

        @lru_cache(2 * TILE)
        def chunk(number: int, part: int) -> tuple[np.ndarray, np.ndarray]:
            folder = f"{where}/list={number}/chunk={part}"
            if files.get_file_info(folder).type.name == "NotFound":
                return np.zeros(0), np.zeros((0, 1))
            got = ds.dataset(folder, filesystem=files, format="parquet").to_table(columns=["id", "vector"])
            return np.array(got.column("id").to_pylist()), matrix(got.column("vector"))

        for batch in batches:
            for one, x, two, y in zip(*(batch.column(c).to_pylist() for c in ("one", "x", "two", "y")), strict=True):
                (a, u), (b, v) = chunk(one, x), chunk(two, y)
                for start in range(0, len(a) if len(b) else 0, 1024):
                    s = u[start : start + 1024] @ v.T
                    i, j = np.nonzero(s >= threshold)
                    p, q, s = a[start + i], b[j], s[i, j]
                    keep = p < q if (one, x) == (two, y) else p != q
                    p, q, s = p[keep], q[keep], s[keep]
                    if len(p):
                        low, high = np.where(p < q, p, q), np.where(p < q, q, p)
                        yield pa.RecordBatch.from_arrays([pa.array(low.tolist(), arrow.field("a").type), pa.array(high.tolist(), arrow.field("b").type), pa.array(s)], schema=arrow)

    # Tiles of TILE x TILE lists are dealt out, so that a chunk that was read meets several others.
    tile = [F.floor(F.col(c) / TILE).alias(f"{c}_tile") for c in ("one", "two")]
    dealt_out = tasks.select("*", *tile).repartition("one_tile", "two_tile", "x").sortWithinPartitions("one_tile", "two_tile", "x", "one", "two", "y")
    return dealt_out.select("one", "x", "two", "y").mapInArrow(run, out)
