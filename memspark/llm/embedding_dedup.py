"""Embedding near-dedup with randomised-rotation binary codes (RaBitQ, Gao and Long 2024).

A unit vector o is rotated by a random orthogonal matrix; its code is the signs x of the rotated vector, and
its stored correction factor is <o, x> / sqrt(D), how well the code fits. For two coded vectors and one of
them known, <x, q> / <x, o> is an unbiased estimate of the cosine <o, q>, and its error is within
EPS * sqrt((1 - f^2) / (f^2 (D - 1))) except with a probability that falls exponentially in EPS^2.

1. Candidates. Pieces of the codes of several rotations are hash keys. Two vectors at the threshold's angle t
   agree on a bit with probability 1 - t / pi, which with the key's bits (one for each doubling of the rows,
   so that the keys' groups stay small) gives the number of keys for the recall that is asked for. In each
   key's group (streamed, in blocks of bounded size) pairs whose estimate plus bound stays below the
   threshold are dropped and the others recomputed exactly in double precision; a spanning forest of the true links
   goes on.
2. Components of true links are the result. In blocks of bounded size, all pairs of a component are decided in the
   same way, and counted in the task: no pair is ever a row. Equal vectors of one label are one vector with a weight.

Vectors are scaled by a power of two first, so that no square of a finite component overflows or vanishes.

Defined results: a null label or vector, a zero vector, and null or non-finite components link with
nothing; vectors of another length than their fellows' never meet them; rows that share an id are one node, each
row counting the links of its own vector; a row with a null id links with nothing and has a null component and kept;
an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import written
from .components import block_tasks, components

THRESHOLD = 0.93
RECALL = 0.9999
EPS = 3.0
BLOCK = 1024
#: Groups up to this size are compared together with others.
SMALL = 64
SEED = 20240527


@lru_cache(64)
def rotation(dim: int, number: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every process."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64([SEED, dim, number])).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def keys_needed(rows: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits of a key, and keys, for so many rows."""
    bits = max(8, min(62, math.ceil(math.log2(max(rows, 2)))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


class Coded:
    """Codes, correction factors and error bounds of unit vectors under one rotation."""

    def __init__(self, unit: np.ndarray, number: int = 0):
        dim = unit.shape[1]
        turned = unit @ rotation(dim, number)
        self.signs = np.where(turned >= 0, 1.0, -1.0).astype(np.float32)
        self.unit = turned.astype(np.float32)
        self.fit = np.abs(turned).sum(axis=1) / math.sqrt(dim)
        self.error = EPS * np.sqrt(np.maximum(1 - self.fit**2, 0) / (self.fit**2 * max(dim - 1, 1))) + 1e-5
        self.scale = math.sqrt(dim)

    def estimate(self, other: Coded) -> tuple[np.ndarray, np.ndarray]:
        """Estimated cosines of my codes with the other's vectors, and their bounds (by row)."""
        return (self.signs @ other.unit.T) / self.scale / self.fit[:, None].astype(np.float32), self.error


def vectors_of(col: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(-1, dim)


def unit(v: np.ndarray) -> np.ndarray:
    _, exponent = np.frexp(np.abs(v).max(axis=1))
    v = np.ldexp(v, -exponent[:, None])
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches as tables that hold whole groups, with each row's group number in the table."""
    held = None
    for batch in batches:
        if batch.num_rows:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            group = group_numbers(held, keys)
            last = int(np.searchsorted(group, group[-1]))
            if last:
                yield held.slice(0, last), group[:last]
                held = held.slice(last)
    if held is not None:
        yield held, group_numbers(held, keys)


def group_numbers(t: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(t.num_rows, dtype=np.int64)
    for k in keys:
        v = t.column(k).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.cumsum(change)


def close_pairs(u: np.ndarray, group: np.ndarray, label: np.ndarray, side: np.ndarray, across: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, of one group and label that reach the threshold; where across, only pairs of different sides.

    Codes first, exact cosines where they don't exclude. Small groups are taken together, diagonal by diagonal.
    """
    c = Coded(u)

    def exact(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for k in range(0, len(i), 1 << 16):
            a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            near = (u[a] * u[b]).sum(axis=1) >= threshold
            if near.any():
                yield a[near], b[near]

    sizes = np.bincount(group)
    small = sizes[group] <= SMALL
    for d in range(1, SMALL):
        i = np.flatnonzero(small[:-d] & (group[d:] == group[:-d]))
        if not len(i):
            break
        i = i[(label[i] == label[i + d]) & (~across[i] | (side[i] != side[i + d]))]
        for k in range(0, len(i), 1 << 16):
            a = i[k : k + (1 << 16)]
            est = (c.signs[a] * c.unit[a + d]).sum(axis=1) / c.scale / c.fit[a]
            a = a[est + c.error[a] >= threshold]
            yield from exact(a, a + d)
    ends = np.cumsum(sizes)
    for n in np.flatnonzero(sizes > SMALL):
        rows = np.arange(ends[n] - sizes[n], ends[n])
        for some in np.array_split(rows, -(-len(rows) // 512)):
            est = (c.signs[some] @ c.unit[rows].T) / c.scale / c.fit[some, None]
            maybe = (est + c.error[some, None] >= threshold) & (rows[None, :] > some[:, None]) & (label[some, None] == label[None, rows])
            maybe &= ~across[some, None] | (side[some, None] != side[None, rows])
            i, j = np.nonzero(maybe)
            yield from exact(some[i], rows[j])


def pairs_of(t: pa.Table, group: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The table's close pairs, as row numbers; vectors of one length meet."""
    dims = t.column("dim").to_numpy()
    label = t.column("label").combine_chunks().dictionary_encode()
    label = (label.chunk(0) if isinstance(label, pa.ChunkedArray) else label).indices.to_numpy()
    side, across = t.column("_side").to_numpy(), t.column("_lo").to_numpy() != t.column("_hi").to_numpy()
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        u = unit(vectors_of(t.column("v").take(pa.array(at)), int(dim)))
        for i, j in close_pairs(u, group[at], label[at], side[at], across[at], threshold):
            yield at[i], at[j]


def forest(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[list[int], list[int]]:
    """A spanning forest of pairs, given in arrays of their ends."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    left, right = [], []
    for one, two in pairs:
        for i, j in zip(one.tolist(), two.tolist(), strict=True):
            a, b = root(i), root(j)
            if a != b:
                parent[b] = a
                left.append(i)
                right.append(j)
    return left, right


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"), F.col(f"`{label}`").alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite, F.lit(False))
    # Equal vectors of a label are one; two hashes name it.
    named = rows.filter(usable).withColumns({"h1": F.xxhash64("label", "v"), "h2": F.xxhash64(F.lit(1), "v", "label")})
    single = named.groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("v").alias("v"), F.count(F.lit(1)).alias("times"), F.size(F.first("v")).alias("dim"))
    single = written(single.withColumn("node", F.monotonically_increasing_id()), "vectors")
    bits, n_keys = keys_needed(single.count(), threshold, recall)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                u, labels = unit(vectors_of(part.column("v"), int(dim))), part.column("mark").to_numpy().view(np.uint64)
                per = max(1, int(dim) // bits)  # keys of one rotation
                take = min(bits, int(dim))
                for number in range(-(-n_keys // per)):
                    signs = (u @ rotation(int(dim), number)) >= 0
                    for k in range(min(per, n_keys - number * per)):
                        key = signs[:, k * take : (k + 1) * take] @ (1 << np.arange(take, dtype=np.int64))
                        g = K.mix(K.mix(key.view(np.uint64), number * per + k) ^ labels, int(dim))
                        yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), part.column("node")], names=["g", "node"])

    # Keys travel without vectors; those join once it is known which groups have two members or more.
    keys = single.select("node", "v", "dim", F.xxhash64("label").alias("mark")).mapInArrow(keyed, "g bigint, node bigint")
    tasks = block_tasks(keys, "g", "node", BLOCK).join(single.select("node", "label", "v", "dim"), "node")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in whole_groups(batches, ["g", "_lo", "_hi"]):
            left, right = forest(pairs_of(t, group, threshold))
            node = t.column("node").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(node[left], pa.int64()), pa.array(node[right], pa.int64())], names=["a", "b"])

    dealt = lambda df, k: df.repartition(k, "_lo", "_hi").sortWithinPartitions(k, "_lo", "_hi")
    links = dealt(tasks, "g").mapInArrow(linked, "a bigint, b bigint").distinct()
    # Vectors that share an id reach each other.
    both = F.struct("h1", "h2")
    shared = named.groupBy("vec_id").agg(F.min(both).alias("x"), F.max(both).alias("y")).filter("x <> y").select("vec_id", F.col("x.h1").alias("x1"), F.col("x.h2").alias("x2"))
    known = single.select("h1", "h2", "node")
    alias = named.select("vec_id", "h1", "h2").distinct().join(shared, "vec_id").join(known, ["h1", "h2"]).select(F.col("node").alias("a"), "x1", "x2")
    alias = alias.join(known.select(F.col("h1").alias("x1"), F.col("h2").alias("x2"), F.col("node").alias("b")), ["x1", "x2"]).select("a", "b").filter("a <> b")
    links = written(links.unionByName(alias), "near")
    reached = components(links.select("a", "b"))
    least = reached.join(single.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("component_id"))
    reached = written(reached.join(least, "component"), "reached")
    members = single.select("node", "label", "v", "dim", "times").join(reached.select("node", "component"), "node")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in whole_groups(batches, ["component", "_lo", "_hi"]):
            n, times = np.zeros(t.num_rows, dtype=np.int64), t.column("times").to_numpy()
            for i, j in pairs_of(t, group, threshold):
                np.add.at(n, i, times[j])
                np.add.at(n, j, times[i])
            yield pa.RecordBatch.from_arrays([t.column("node").combine_chunks(), pa.array(n)], names=["node", "n"])

    counts = dealt(block_tasks(members, "component", "node", BLOCK), "component").mapInArrow(counted, "node bigint, n bigint").groupBy("node").agg(F.sum("n").alias("n"))
    found = single.select("h1", "h2", "node", "times", "least").join(counts, "node", "left").join(reached.select("node", "component_id"), "node", "left")
    found = found.select("h1", "h2", (F.col("times") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    every = rows.withColumns({"h1": F.when(usable, F.xxhash64("label", "v")), "h2": F.xxhash64(F.lit(1), "v", "label")}).drop("v", "label")
    out = every.join(found, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
