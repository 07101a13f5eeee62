"""Connected components and exact pair work in blocks, for operators on pairs.

Components: alternating large-star and small-star rounds (Kiveris et al. 2014). Every round is two joins
and writes its edges to the shared folder, so nothing is collected and a lost executor costs one stage.

Blocks: a set of candidates that may all have to meet (a component of unverified candidate links) is cut
into blocks of a bounded size; each pair of blocks is one task, whatever the size of the set, so no task
holds an unbounded group, and no pair is ever a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

MOST_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (a, b)."""
    if large:
        each = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        each = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = each.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = each.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node that it reaches), for the nodes of edges (a, b)."""
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    for _ in range(MOST_ROUNDS):
        now = written(_star(_star(now, True), False), "links")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError("components didn't settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def block_tasks(members: DataFrame, group: str, node: str, block: int) -> DataFrame:
    """members, each once for every block-pair task of its group: with `_lo`, `_hi` (the task's blocks) and `_side` (its own).

    Groups of one member need no task and go.
    """
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    own = members.join(sizes, group).withColumn("_blocks", F.ceil(F.col("_n") / block).cast("int"))
    own = own.withColumn("_side", F.pmod(F.xxhash64(node), F.col("_blocks")).cast("int"))
    each = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return each.withColumns({"_lo": F.least("_side", "_other"), "_hi": F.greatest("_side", "_other")}).drop("_other", "_blocks", "_n")


def map_groups(rows: DataFrame, keys: list[str], f: Callable[[pa.Table], pa.Table | None], schema: str, order: list[str] = ()) -> DataFrame:
    """f on each group's rows; groups are streamed in key order, many small ones share a batch and a task."""
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                got = f(pa.concat_tables(held).combine_chunks())
                held.clear()
                if got is not None and got.num_rows:
                    yield from got.select(names).to_batches()

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            change = np.zeros(batch.num_rows, dtype=bool)
            for k in keys:
                v = batch.column(k).to_numpy(zero_copy_only=False)
                change[1:] |= v[1:] != v[:-1]
            cuts = [0, *np.flatnonzero(change), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(batch.column(k)[int(a)].as_py() for k in keys)
                if key != last:
                    yield from done()
                    last = key
                held.append(t.slice(int(a), int(b - a)))
        yield from done()

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
