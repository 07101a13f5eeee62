"""Best-fit packing of token sequences by a configuration linear program.

The lengths' histogram (at most CAPACITY sizes, whatever the corpus) is all that the solver sees, on the
driver. A configuration is a multiset of sizes that fits one sequence. Multiplicative weights solve the
covering program: each round prices the sizes, a knapsack dynamic program finds the best configuration
for each size that leads one, and those near the best share the round's mass; sizes that are covered
too much lose weight. Rounding takes whole numbers of each configuration that is full; what is left is packed best
fit, the longest first with the subset of the rest that fills it best, again in whole histogram counts.

The plan is a list of runs "k sequences of this configuration". The pieces of one size are numbered by a
salted rank, so that no task holds all pieces of a common size, and a piece finds its sequence and offset
from its rank by binary search in the plan, whose length doesn't depend on the number of pieces.

Defined results: null and empty texts are one end token; equal rows are packed each; an empty table gives
no pieces; longer documents are cut into whole-capacity pieces after a first, shorter one; null ids are
kept; extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import in_slices, written

CAPACITY, END_ID = 1024, 2
ROUNDS, NEAR = 150, 0.02
#: How fast a weight grows with what its size is behind, and how far it may get from 1 (as a logarithm).
SHARPNESS, WIDEST = 0.03, 0.2
#: Ranks are counted apart for each of so many salts; one more for every SALT_ROWS pieces.
SALTS, SALT_ROWS = 16, 4_000_000


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes are themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(2)
def tokenizer(path: str):
    """A function text -> ids for a byte-level BPE file of the tokenizers library.

    The same ranks run in the faster tiktoken engine; texts that hold a special token's string, or that it
    can't take, go to the library itself, as do all for files with another pre-tokeniser or a normaliser.
    """
    from pathlib import Path

    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    special = [t["content"] for t in spec["added_tokens"]]
    symbols = byte_symbols()
    ranks = {bytes(symbols[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    if spec["normalizer"] or {k: spec["pre_tokenizer"].get(k) for k in ("type", "add_prefix_space", "use_regex")} != {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}:
        return lambda text: whole.encode(text, add_special_tokens=False).ids
    # What a byte-level pre-tokeniser with its own regex cuts at.
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> list[int]:
        if not any(s in text for s in special):
            try:
                return fast.encode_ordinary(text)
            except (ValueError, RuntimeError):
                pass
        return whole.encode(text, add_special_tokens=False).ids

    return ids


PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a piece; with `ids`, its token ids as well."""
    schema = PIECE + (", ids array<int>" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(tokenizer_path)
        for batch in batches:
            for part in in_slices(batch, "text", 4 << 20):
                out: list[list] = [[] for _ in range(6 if ids else 5)]
                for doc_id, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    tokens = np.array([*(encode(t) if t else ()), end_id], dtype="<u4")
                    head = len(tokens) % capacity or capacity
                    for k, start in enumerate([0, *range(head, len(tokens), capacity)]):
                        mine = tokens[start : head if k == 0 else start + capacity]
                        for column, value in zip(out, (doc_id, k, start, len(mine), zlib.crc32(mine.tobytes()), mine.astype(np.int32)), strict=False):
                            column.append(value)
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, types, strict=False)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(out)])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, schema)


def best_values(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the best value for each room, and the size to take first (0: none)."""
    value, take = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for room in range(1, capacity + 1):
        all_of = price[1 : room + 1] + value[room - 1 :: -1][:room]
        s = int(all_of.argmax())
        if all_of[s] > value[room - 1] + 1e-15:
            value[room], take[room] = all_of[s], s + 1
        else:
            value[room], take[room] = value[room - 1], -1
    return value, take


def follow(take: np.ndarray, room: int) -> list[int]:
    """The sizes of the knapsack's best filling of this room."""
    out = []
    while room > 0 and take[room]:
        if take[room] < 0:
            room -= 1
        else:
            out.append(int(take[room]))
            room -= int(take[room])
    return out


def fractional(counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """Configurations with their shares, by multiplicative weights; counts[s] items of size s."""
    sizes = np.flatnonzero(counts)
    lengths = np.arange(len(counts))
    mass = float(counts @ lengths) / capacity
    cover, found = np.zeros(len(counts)), {}
    for t in range(rounds):
        behind = np.zeros(len(counts))
        goal = (t + 1) / rounds
        behind[sizes] = goal - cover[sizes] / counts[sizes]
        price = np.zeros(len(counts))
        # A size's price is its length times a weight that grows with how far it is behind.
        price[sizes] = lengths[sizes] * np.exp(np.clip(SHARPNESS * rounds * behind[sizes], -WIDEST, WIDEST))
        value, take = best_values(price, capacity)
        lead = price[sizes] + value[capacity - sizes]
        near = sizes[(lead >= (1 - NEAR) * value[capacity]) | (behind[sizes] > 2 / rounds)]
        need = counts[near] * np.maximum(behind[near], 0.25 / rounds)
        share = need / need.sum() * mass / rounds
        for s, x in zip(near, share, strict=True):
            config = tuple(sorted([int(s), *follow(take, capacity - int(s))], reverse=True))
            found[config] = found.get(config, 0.0) + x
            for k in config:
                cover[k] += x
    return found


def best_subset(room: int, left: np.ndarray) -> list[int]:
    """Sizes that are left, each as often as it is, with the largest sum that fits the room."""
    reach, steps = 1, []
    full = (1 << (room + 1)) - 1
    for s in np.flatnonzero(left[: room + 1])[::-1]:
        for _ in range(min(int(left[s]), room // int(s))):
            steps.append((int(s), reach))
            more = (reach | reach << int(s)) & full
            if more == reach:
                steps.pop()
                break
            reach = more
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, []
    for s, before in reversed(steps):
        if not before >> at & 1:
            out.append(s)
            at -= s
    return out


def solve(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """Runs (how many sequences, the sizes in each) that hold every item once. counts has capacity + 1 entries."""
    left, plan = counts.astype(np.int64).copy(), []
    if left[capacity]:
        plan.append((int(left[capacity]), (capacity,)))
        left[capacity] = 0
    if not left.any():
        return plan

    def use(config: tuple[int, ...], most: int | None = None) -> bool:
        sizes, times = np.unique(config, return_counts=True)
        k = int((left[sizes] // times).min())
        k = k if most is None else min(k, most)
        if k:
            left[sizes] -= k * times
            plan.append((k, config))
        return k > 0

    shares = fractional(left, capacity)
    # Full configurations only: what rounding leaves behind packs better anew than what wastes room.
    for config, x in sorted(shares.items(), key=lambda c: (-c[1], c[0])):
        if sum(config) == capacity:
            use(config, int(x))
    while left.any():
        longest = int(np.flatnonzero(left)[-1])
        left[longest] -= 1
        config = (longest, *sorted(best_subset(capacity - longest, left), reverse=True))
        left[longest] += 1
        use(config)
    return plan


class Plan:
    """Where the n-th piece of each size goes."""

    def __init__(self, runs: list[tuple[int, tuple[int, ...]]]):
        rows, used, base = [], {}, 0
        for k, config in runs:
            offset = 0
            for s in dict.fromkeys(config):
                times = config.count(s)
                rows.append((s, used.get(s, 0), base, times, offset))
                used[s] = used.get(s, 0) + k * times
                offset += s * times
            base += k
        rows.sort()
        self.n_sequences = base
        self.size, self.first, self.base, self.times, self.offset = (np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 5

    def place(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = lambda s, r: s * (1 << 50) + r
        at = np.searchsorted(key(self.size, self.first), key(size, rank), side="right") - 1
        nth = rank - self.first[at]
        return self.base[at] + nth // self.times[at], self.offset[at] + nth % self.times[at] * size


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (with doc_id, piece, length up to capacity) with sequence_id and offset. Reads pieces twice: give a written table."""
    rows = pieces.count()
    salts = SALTS + rows // SALT_ROWS
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    each = salted.groupBy("length", "_salt").count()
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for r in each.groupBy("length").agg(F.sum("count")).collect():  # at most capacity rows
        histogram[r[0]] = r[1]
    plan = Plan(solve(histogram, capacity))
    # A piece's rank among those of its length: its rank in its salt after all of the salts before, which a join on the window's own keys brings.
    earlier = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    before = each.select("length", "_salt", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    ranked = salted.withColumn("_nth", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece"))).join(before, ["length", "_salt"])
    ranked = ranked.select(*pieces.columns, (F.col("_before") + F.col("_nth") - 1).alias("_rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = plan.place(b.column("length").to_numpy(), b.column("_rank").to_numpy())
            names = b.schema.names
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:-1]), pa.array(sequence), pa.array(offset)], names=[*names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(run, StructType(list(pieces.schema.fields)).add("sequence_id", "long").add("offset", "long"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """The pieces of docs with their places; ids: with their token ids."""
    return pack(written(pieces_of(docs, tokenizer_path, capacity, end_id, ids), "pieces"), capacity)
