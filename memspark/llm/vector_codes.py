"""Product codes of vectors by Lloyd's rounds with Elkan's bounds (Elkan 2003), exact in integers.

Components become integers, floor(SCALE x); a vector is cut into equal consecutive parts, and each part position has a
codebook whose entries start as that part of the vectors with the least ids. A round assigns every part to its nearest
entry (ties to the lower index) and moves each used entry to the floor of its parts' mean.

Bounds persist between rounds in a written table: for every part an upper bound of the distance to its entry, and a lower
bound for each entry. After a move the upper bound grows by its entry's way and a lower bound shrinks by that entry's.
A part is left alone where its upper bound is strictly below half the way to the nearest other entry; an entry is left
out where the upper bound is strictly below its lower bound or half the way between the two entries. What is left is
measured in integers, and ties are decided there: a bound never decides one, since it is widened by more than rounding
can lose. Lower bounds are kept in a byte each, rounded down on a scale of their part, an upper bound in four.

A pass is one map over vectors (codebooks travel with the task: entries x dimensions numbers); a round's sums leave a task as
one row an entry, and Spark adds them up, so no group of vectors ever meets in one task.

Defined results: rows whose vector is null or holds a null or non-finite component go. The dimension is that of the least
kept id's vector among lengths that the number of parts divides; rows of other lengths go too. Rows that share an id are
coded each; null ids come last for the start, ties by vector. Fewer rows than entries give fewer entries; an empty
table gives an empty table. Components beyond +-2**62 / SCALE count as that. An error beyond 64 bits is null. Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
MOST = 1 << 62
LONG = (1 << 63) - 1
#: Wider than what square roots and sums of a few bounds lose in double precision.
SLACK = 1e-9
#: Rows of a block of distances.
BLOCK = 4096


def integers(col: pa.Array) -> np.ndarray:
    """floor(SCALE x) of a list column whose rows are of one length."""
    flat = np.asarray(col.values.to_numpy(zero_copy_only=False), dtype=np.float64)
    ends = col.offsets.to_numpy()
    x = np.floor(flat[ends[0] : ends[-1]] * SCALE).reshape(len(col), -1)
    return np.clip(x, -float(MOST), float(MOST)).astype(np.int64)


class Codebooks:
    """[part, entry, place] integers, and what the bounds need to know of them."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries
        parts, k, _ = entries.shape
        wide = entries.astype(np.float64)
        between = np.stack([np.sqrt(((wide[p][:, None] - wide[p][None]) ** 2).sum(axis=2)) for p in range(parts)])
        self.half = between / 2 * (1 - SLACK)
        alone = np.where(np.eye(k, dtype=bool), np.inf, self.half)
        self.nearest = alone.min(axis=2)
        self.moved = np.sqrt(((wide - before.astype(np.float64)) ** 2).sum(axis=2)) * (1 + SLACK) if before is not None else np.zeros((parts, k))

    def exact(self, part: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x and the entries in numbers whose squared distances can't overflow: 64-bit integers, or else Python's."""
        entries = self.entries[part]
        most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
        return (x, entries) if 4 * most * most * max(x.shape[1], 1) <= LONG else (x.astype(object), entries.astype(object))


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=1)


def assign(books: Codebooks, part: int, x: np.ndarray, code: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Codes, upper and lower bounds after the pass, squared distances where they were measured (else -1), and how many were."""
    n, k = len(x), books.entries.shape[1]
    x, entries = books.exact(part, x)
    best = np.full(n, -1, dtype=x.dtype)
    if code is None:
        code, upper, lower = np.zeros(n, dtype=np.int64), np.full(n, np.inf), np.zeros((n, k))
    else:
        code = code.astype(np.int64)
        upper = upper + books.moved[part][code]
        lower = np.maximum(lower - books.moved[part], 0)
    rows = np.flatnonzero(~(upper < books.nearest[part][code]))
    if not len(rows):
        return code, upper, lower, best, 0
    mine, own, have = x[rows], code[rows], apart(x[rows], entries[code[rows]])
    root = np.sqrt(have.astype(np.float64))
    u, low = root * (1 + SLACK), lower[rows]
    low[np.arange(len(rows)), own] = root * (1 - SLACK)
    measured = len(rows)
    for e in range(k):
        at = np.flatnonzero((own != e) & ~(u < low[:, e]) & ~(u < books.half[part][own, e]))
        if not len(at):
            continue
        found = apart(mine[at], entries[e])
        measured += len(at)
        root = np.sqrt(found.astype(np.float64))
        low[at, e] = root * (1 - SLACK)
        better = np.flatnonzero((found < have[at]) | ((found == have[at]) & (e < own[at])))
        to = at[better]
        own[to], have[to], u[to] = e, found[better], root[better] * (1 + SLACK)
    code[rows], best[rows], upper[rows], lower[rows] = own, have, u, low
    return code, upper, lower, best, measured


STATE = "_id bigint, _label string, _x array<bigint>, _code binary, _upper binary, _scale binary, _lower binary"


def state_pass(rows: DataFrame, books: Codebooks, first: bool, parts: int) -> DataFrame:
    """Every vector with its code, the bounds that go with it, and its places in integers."""
    k = books.entries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                b = whole.slice(start, BLOCK)
                x, code, upper, lower, _, _ = coded(books, b, first, parts, k)
                scale = np.maximum(lower.max(axis=2), np.finfo(np.float32).tiny).astype(np.float32)
                scale = np.nextafter(scale, np.float32(np.inf))
                small = np.floor(lower / scale[:, :, None].astype(np.float64) * 255 * (1 - SLACK)).astype(np.uint8)
                up = np.nextafter(upper.astype(np.float32), np.float32(np.inf))
                cells = [pa.array([r.tobytes() for r in y], pa.binary()) for y in (code.astype(np.uint8), up, scale, small)]
                ids = [b.column(c) for c in ("_id", "_label")]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*ids, flat, *cells], names=[c.split()[0] for c in STATE.split(", ")])

    return rows.mapInArrow(run, STATE)


def coded(books: Codebooks, b: pa.RecordBatch, first: bool, parts: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """The batch's places, codes, bounds and squared distances [row, part], and how many distances that took."""
    col = b.column("_x")
    flat, ends = col.values.to_numpy(), col.offsets.to_numpy()
    x = flat[ends[0] : ends[-1]].reshape(b.num_rows, -1)
    n, width = len(x), x.shape[1] // parts
    if first:
        code = upper = lower = None
    else:
        read = lambda c, kind: np.frombuffer(b"".join(b.column(c).to_pylist()), kind)
        code, upper = read("_code", np.uint8).reshape(n, parts), read("_upper", np.float32).reshape(n, parts).astype(np.float64)
        scale = read("_scale", np.float32).reshape(n, parts, 1).astype(np.float64)
        lower = read("_lower", np.uint8).reshape(n, parts, k) * (scale / 255 * (1 - SLACK))
    out = [assign(books, p, x[:, p * width : (p + 1) * width], *((None,) * 3 if first else (code[:, p], upper[:, p], lower[:, p]))) for p in range(parts)]
    best = np.stack([o[3].astype(object) for o in out], axis=1)
    return x, *(np.stack([o[i] for o in out], axis=1) for i in range(3)), best, sum(o[4] for o in out)


def moved(state: DataFrame, books: Codebooks, parts: int) -> Codebooks:
    """The codebooks after a round: floors of the means of what each entry has, unused ones as they were."""
    _, k, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * k, width), dtype=object), np.zeros(parts * k, dtype=np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            col = b.column("_x")
            flat, ends = col.values.to_numpy(), col.offsets.to_numpy()
            x = flat[ends[0] : ends[-1]].reshape(b.num_rows, parts, width)
            code = np.frombuffer(b"".join(b.column("_code").to_pylist()), np.uint8).reshape(b.num_rows, parts)
            cell = (code + np.arange(parts) * k).ravel()
            count += np.bincount(cell, minlength=parts * k)
            high, low = x >> 31, x & ((1 << 31) - 1)  # sums of either stay in 64 bits for two billion rows of a batch
            for w in range(width):
                for y, shift in ((high, 31), (low, 0)):
                    got = np.zeros(parts * k, dtype=np.int64)
                    np.add.at(got, cell, y[:, :, w].ravel())
                    total[:, w] += got.astype(object) * (1 << shift)
        at = np.flatnonzero(count)
        rows = [(int(i), w, int(count[i]), str(total[i, w])) for i in at for w in range(width)]
        yield pa.RecordBatch.from_pylist([dict(zip(("cell", "place", "n", "total"), r, strict=True)) for r in rows], pa.schema([("cell", pa.int32()), ("place", pa.int32()), ("n", pa.int64()), ("total", pa.string())]))

    sums = state.select("_x", "_code").mapInArrow(run, "cell int, place int, n bigint, total string")
    now = books.entries.copy()
    for r in sums.groupBy("cell", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).cast("string").alias("total")).collect():  # entries x dimensions rows
        now[r["cell"] // k, r["cell"] % k, r["place"]] = int(r["total"]) // r["n"]
    return Codebooks(now, books.entries)


def digest(books: Codebooks) -> str:
    return hashlib.sha256(",".join(map(str, books.entries.ravel().tolist())).encode()).hexdigest()


RESULT = "vec_id bigint, _label string, code string, error bigint"


def encode_vectors(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, vector: str = "embedding") -> tuple[DataFrame, np.ndarray | None]:
    """vec_id, code, error, label_error, codebooks_sha256 of vectors (vec_id, embedding, label), and the codebooks [part, entry, place]."""
    v = F.col(f"`{vector}`").cast("array<double>")
    fine = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("_id"), F.col("label").cast("string").alias("_label"), v.alias("_v")).filter(fine & (F.size("_v") > 0) & (F.size("_v") % parts == 0))
    order = [F.col("_id").asc_nulls_last(), F.col("_v")]
    head = rows.orderBy(*order).limit(1).collect()
    spark = vectors.sparkSession
    if not head:
        return spark.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string"), None
    rows = rows.filter(F.size("_v") == len(head[0]["_v"]))
    start = pa.array([r["_v"] for r in rows.orderBy(*order).limit(entries).collect()], pa.list_(pa.float64()))
    first = integers(start)
    books = Codebooks(np.ascontiguousarray(first.reshape(len(first), parts, -1).transpose(1, 0, 2)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = integers(b.column("_v"))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_label"), flat], names=["_id", "_label", "_x"])

    state = rows.mapInArrow(run, "_id bigint, _label string, _x array<bigint>")
    for n in range(rounds):
        state = written(state_pass(state, books, n == 0, parts), "codes")
        books = moved(state, books, parts)
    k = books.entries.shape[1]

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = books.entries.shape[2]
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                x, code, _, _, best, _ = coded(books, b, rounds == 0, parts, k)
                for p in range(parts):
                    rest = np.flatnonzero(best[:, p] < 0)
                    if len(rest):
                        own, entries = books.exact(p, x[rest, p * width : (p + 1) * width])
                        best[rest, p] = apart(own, entries[code[rest, p]])
                error = [e if e <= LONG else None for e in map(sum, best.tolist())]
                yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_label"), pa.array([r.tobytes().hex() for r in code.astype(np.uint8)], pa.string()), pa.array(error, pa.int64())], names=["vec_id", "_label", "code", "error"])

    out = written(state.mapInArrow(last, RESULT), "coded")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    fits = F.when((F.count("error") == F.count(F.lit(1))) & (total <= LONG), total.cast("bigint"))
    sums = out.groupBy("_label").agg(fits.alias("label_error")).withColumnRenamed("_label", "_of")
    joined = out.join(sums, F.col("_label").eqNullSafe(F.col("_of")), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")), books.entries


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same rows in SQL by full search, the rounds written out; k is distance * entries + entry, so its least decides ties."""
    steps = [
        f"kept AS (SELECT row_number() OVER () AS r, vec_id, label, len(embedding) // {parts} AS w, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x "
        "FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"part AS (SELECT r, vec_id, label, p, x[p * w + 1 : (p + 1) * w] AS v FROM kept, (SELECT unnest(range({parts})) AS p))",
        f"start AS (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < {entries})",
        "book0 AS (SELECT p, e, v AS c FROM part JOIN start USING (r))",
    ]
    for n in range(rounds + 1):
        steps.append(
            f"code{n} AS (SELECT r, vec_id, label, p, v, min(d * {entries} + e) AS k FROM (SELECT r, vec_id, label, part.p, v, e, "
            f"CAST(list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS HUGEINT) AS d FROM part JOIN book{n} USING (p)) GROUP BY r, vec_id, label, p, v)"
        )
        if n < rounds:
            steps.append(
                f"mean{n} AS (SELECT p, e, list(CAST((t - ((t % c) + c) % c) // c AS BIGINT) ORDER BY i) AS c FROM (SELECT p, k % {entries} AS e, i, sum(v[i]) AS t, count(*) AS c "
                f"FROM code{n}, (SELECT unnest(range(1, (SELECT max(w) FROM kept) + 1)) AS i) GROUP BY p, k % {entries}, i) GROUP BY p, e)"
            )
            steps.append(f"book{n + 1} AS (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{n} b LEFT JOIN mean{n} m ON m.p = b.p AND m.e = b.e)")
    steps.append(f"done AS (SELECT r, vec_id, label, string_agg(printf('%02x', CAST(k % {entries} AS BIGINT)), '' ORDER BY p) AS code, CAST(sum(k // {entries}) AS BIGINT) AS error FROM code{rounds} GROUP BY r, vec_id, label)")
    return (
        "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, "
        f"(SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256 FROM done"
    )


ORACLE = oracle()
