"""N-gram Jaccard join with PartEnum signatures (Arasu, Ganti and Kaushik 2006).

Sets of word shingles are dealt into size bands such that sets similar enough are in the same band or in
neighbours. Within a band a Jaccard bound is a bound k on the Hamming distance. The feature domain is cut
into n1 x n2 partitions by hash range: of n1 first-level parts, one differs in at most k // n1 = k2
places, and there some n2 - k2 of the n2 second-level parts agree. So sets similar enough share a
signature: the hash of what they hold in an enumerated subset of partitions. A set emits the signatures
of its own band and of the next one.

Flow: signatures are combined within a batch first (equal sets, then equal signatures: one leader goes on, the
others stay with it), so a hot signature costs a row a batch. A window over the signature finds the groups of
two and more. Then

1. the members of each group meet as odd sketches (Mitzenmacher, Pagh and Pham 2014): the parities of how many
   elements fall into each of about as many buckets as there are elements. Every element in which two sets
   differ flips one bit, so sketches that differ in more bits than the Hamming bound allows prove a pair
   dissimilar, and no similar pair is dropped. What is left links into small candidate components;
2. the components are compared exactly, from the documents' whole texts, with a prefix filter.

In both steps a set to be compared is cut into blocks of bounded size and a pair of blocks is a task; a task passes
over pairs that it has connected already and returns a spanning forest. So every pair that shares a signature
is either compared or known to be connected: no link between components is lost, no group lands in one task,
and no pair is ever a row.

Small parts: a part that holds a single element matches by accident. A band has spare parts: two similar sets
agree on more parts than there are spare ones, so a set with no more small parts (fewer than FEW elements) than
that needn't emit those. Sets with more emit all of them. Under the next band's signatures a pair matters only
if one of it is of that band, so groups without such a member go.

Defined results: null, empty and wordless texts have the empty set and are linked with nothing; texts
with fewer words than a shingle have one shingle; rows of one id are one document, and a null id links
with nothing (its component is null); an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import in_slices, written
from .components import block_tasks, components, map_groups

FEW = 2
#: Members of a block, as texts and as sketches, of which a task holds two blocks.
BLOCK, SKETCH_BLOCK = 512, 2048
U64 = np.uint64


@lru_cache(None)
def bands(num: int, den: int, most: int = 1 << 31) -> np.ndarray:
    """The largest size of each band; a set is in the first band that is at least its size."""
    out, low = [], 1
    while low <= most:
        high = low * den // num
        out.append(high)
        low = high + 1
    return np.array(out, dtype=np.int64)


def spare_parts(size: int, k: int) -> int:
    """Enough spare parts for nearly all sets of `size` elements, by the Poisson share of small parts."""
    spare = FEW
    for _ in range(20):
        n = k + 1 + spare
        mean = size / n
        small = n * math.exp(-mean) * sum(mean**i / math.factorial(i) for i in range(FEW))
        if small + 2 * math.sqrt(small) <= spare:
            return spare
        spare = math.ceil(small + 2 * math.sqrt(small))
        if spare > 0.25 * (k + 1) + FEW:
            break
    return math.ceil(0.2 * (k + 1)) + FEW


@lru_cache(None)
def shape(size: int, num: int, den: int) -> tuple[int, int, int, int]:
    """n1, n2, k2 and spare parts for sets of up to `size`: the subsets that cover most, at a bounded number of signatures."""
    k = 2 * size * (den - num) // (den + num)
    if k == 0:
        return 1, 1, 0, 0
    spare = spare_parts(size * num // den, k)
    options = [(size / (k + 1 + spare), k + 1 + spare, 1, 0, spare)]
    limit = max(12, 1.2 * (k + 1) + 6)
    for n1 in range(1, k + 1):
        k2 = k // n1
        if k2 > 4:
            continue
        for n2 in range(k2 + 1, k2 + 12):
            if n1 * comb(n2, k2) > limit:
                break
            options.append((size / n1 * (n2 - k2) / n2, n1, n2, k2, 0))
    _, n1, n2, k2, spare = max(options)
    return n1, n2, k2, spare


def shingle_sets(col: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct shingles; A-Z are lowered."""
    w = K.words_of(col)
    h = w.hashes(fold=True)
    at, grams = K.windows(h, w.doc, width, K.WORD_BASES[0])
    n_words = np.diff(w.first)
    n_grams = np.maximum(n_words - width + 1, 0)
    ends = np.cumsum(n_grams)
    short = np.flatnonzero((n_words > 0) & (n_words < width))
    whole = dict(zip(short.tolist(), K.ranges_hash(h, w.first[short], w.first[short + 1], K.WORD_BASES[0]), strict=True)) if len(short) else {}
    none = np.zeros(0, dtype=U64)
    out = []
    for i in range(len(col)):
        if n_grams[i]:
            out.append(np.unique(grams[ends[i] - n_grams[i] : ends[i]]))
        else:
            out.append(np.array([whole[i]], dtype=U64) if i in whole else none)
    return out


def set_hashes(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, order-free."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, U64)
    ends = np.cumsum(sizes)
    out = []
    for salt in (11, 12):
        sums = np.zeros(len(flat) + 1, dtype=U64)
        np.cumsum(K.mix(flat, salt), out=sums[1:])
        out.append(K.mix((sums[ends] - sums[ends - sizes]) ^ sizes.astype(U64), salt))
    return out[0], out[1]


def signatures(sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position in sets, signature, whether it is of the set's own band) for sets that aren't empty."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    limits = bands(num, den)
    band = np.searchsorted(limits, sizes)
    rows_out, sig_out, own_out = [], [], []
    for tag in np.unique(np.concatenate([band, band + 1])):
        rows = np.flatnonzero((band == tag) | (band + 1 == tag))
        rows = rows[sizes[rows] > 0]
        if not len(rows):
            continue
        n1, n2, k2, spare = shape(int(limits[tag]), num, den)
        parts = n1 * n2
        flat = np.concatenate([sets[i] for i in rows])
        owner = np.repeat(np.arange(len(rows)), sizes[rows])
        part = ((flat >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)
        counts = np.bincount(owner * parts + part, minlength=len(rows) * parts)
        ends = np.cumsum(counts)
        sums = np.zeros(len(flat) + 1, dtype=U64)
        np.cumsum(K.mix(flat, 21), out=sums[1:])
        held = (sums[ends] - sums[ends - counts]).reshape(len(rows), n1, n2)
        held = K.mix(held ^ K.mix(np.arange(parts, dtype=U64).reshape(1, n1, n2), int(tag) + 31))
        if k2 == 0:
            sig = held.sum(axis=2, dtype=U64)
            large = counts.reshape(len(rows), n1, n2).sum(axis=2) >= FEW
            large[(~large).sum(axis=1) > spare] = True
            r, _ = np.nonzero(large)
            rows_out.append(rows[r])
            sig_out.append(sig[large])
        else:
            for number, some in enumerate(combinations(range(n2), n2 - k2)):
                sig = K.mix(held[:, :, list(some)].sum(axis=2, dtype=U64), number + 51)
                rows_out.append(np.repeat(rows, n1))
                sig_out.append(sig.reshape(-1))
        done = sum(map(len, own_out))
        own_out.append(band[np.concatenate(rows_out)[done:]] == tag)
    if not rows_out:
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, bool)
    return np.concatenate(rows_out), np.concatenate(sig_out), np.concatenate(own_out)


#: Rows of the first pass, as narrow as they can be, since most are signatures: key, doc, tag and the rest.
#: CLASS: the leader of equal sets in a batch (key, k2: the set; n: its size; sketch); SIGNATURE: a signature's leader in
#: a batch (key; OWN: a member is of its band; MANY: it has other members); MEMBER: such another member (k2: the
#: signature); COPY: a document and the leader with the same set. Keys of the kinds don't overlap.
CLASS, SIGNATURE, MEMBER, COPY = range(4)
OWN, MANY = 4, 8
FIRST = "key bigint, doc bigint, tag tinyint, rest struct<k2: bigint, lead: bigint, n: bigint, sketch: binary>"
KEY_BITS = 48
REST = pa.struct([("k2", pa.int64()), ("lead", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary())])


def first_pass(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """docs has (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaders: dict[tuple[int, int], int] = {}
            found: list[tuple[np.ndarray, ...]] = []
            out: list[tuple] = []
            for part in in_slices(batch, "text", 4 << 20):
                ids = part.column(0).to_numpy()
                sets = shingle_sets(part.column(1), width)
                h1, h2 = set_hashes(sets)
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                lead = ids.copy()
                fresh = []
                for i, key in enumerate(zip(h1.tolist(), h2.tolist(), strict=True)):
                    if not sizes[i]:
                        continue
                    lead[i] = leaders.setdefault(key, int(ids[i]))
                    if lead[i] == ids[i]:
                        fresh.append(i)
                new = np.zeros(len(ids), dtype=bool)
                new[fresh] = True
                scatter = K.mix(ids.astype(U64) ^ h1, 5) >> U64(2) | U64(1 << 62)
                sketches = pa.array([odd_sketch(x) if f else None for x, f in zip(sets, new.tolist(), strict=True)], pa.binary())
                rest = pa.StructArray.from_arrays([pa.array(np.where(new, h2, 0).astype(U64).view(np.int64)), pa.array(lead), pa.array(sizes), sketches], fields=list(REST))
                out.append((np.where(new, h1 | U64(1 << 63), scatter), ids, np.where(new, CLASS, COPY), rest))
                at, sig, own = signatures([sets[i] for i in fresh], num, den)
                found.append((sig >> U64(64 - KEY_BITS), ids[fresh][at], own))  # rows are many, and a chance match only adds a candidate
            sig, doc, own = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((doc, sig))
            sig, doc, own = sig[order], doc[order], own[order]
            head = np.ones(len(sig), dtype=bool)
            head[1:] = sig[1:] != sig[:-1]
            first = np.flatnonzero(head)
            if len(first):
                members = np.diff(np.append(first, len(sig)))
                out.append((sig[first], doc[first], SIGNATURE + OWN * np.logical_or.reduceat(own, first) + MANY * (members > 1), pa.nulls(len(first), REST)))
                others = ~head
                n = int(others.sum())
                rest = pa.StructArray.from_arrays([pa.array(sig[others].view(np.int64)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], fields=list(REST))
                out.append(((K.mix(doc[others].astype(U64), 6) ^ sig[others]) >> U64(2) | U64(1 << 62), doc[others], np.full(n, MEMBER), rest))
            for key, ids, tag, rest in out:
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(key).view(np.int64)), pa.array(ids), pa.array(np.asarray(tag, dtype=np.int8)), rest], names=["key", "doc", "tag", "rest"])

    return docs.mapInArrow(run, FIRST)


def odd_sketch(elements: np.ndarray) -> bytes:
    """The parities of the elements' counts in a power of two of buckets, at least 64 and as many as elements."""
    bits = 1 << max(6, (len(elements) - 1).bit_length())
    counts = np.bincount((K.mix(elements, 77) & U64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """The sketches as rows of words, larger ones folded to the size of the smallest: halving the buckets adds parities."""
    rows = [np.frombuffer(x, dtype="<u8") for x in sketches]
    width = min(map(len, rows))
    out = np.empty((len(rows), width), dtype=U64)
    for i, r in enumerate(rows):
        while len(r) > width:
            half = len(r) // 2
            r = r[:half] ^ r[half:]
        out[i] = r
    return out


def maybe_similar(words: np.ndarray, sizes: np.ndarray, side: np.ndarray, across: bool, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose sketches don't prove them dissimilar."""
    n = len(words)
    label, forest = np.arange(n), []
    step = max(1, (1 << 20) // max(1, n * words.shape[1]))
    for lo in range(0, n, step):
        some = np.arange(lo, min(lo + step, n))
        differ = np.bitwise_count(words[some, None, :] ^ words[None, :, :]).sum(axis=2, dtype=np.int64)
        near = differ <= (sizes[some, None] + sizes[None, :]) * (den - num) // (den + num)
        near &= np.arange(n)[None, :] > some[:, None]
        if across:
            near &= side[some, None] != side[None, :]
        for i in np.flatnonzero(near.any(axis=1)):
            for j in np.flatnonzero(near[i] & (label != label[some[i]])).tolist():
                if label[j] != label[some[i]]:
                    forest.append((int(some[i]), j))
                    label[label == label[j]] = label[some[i]]
    return forest


def joined_within(sets: list[np.ndarray], side: np.ndarray, across: bool, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets that are similar enough (across: only pairs of different sides)."""
    label = np.arange(len(sets))
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(inverse)
    order = np.lexsort((np.arange(len(flat)), often))
    rank = np.empty(len(flat), dtype=np.int64)
    rank[order] = np.arange(len(flat))
    ranked, at = [], 0
    for s in sizes:
        ranked.append(np.sort(rank[inverse[at : at + s]]))
        at += s
    # Two similar sets share one of their rarest n - ceil(n * num / den) + 1 shingles.
    prefix = sizes - -(-sizes * num // den) + 1
    forest: list[tuple[int, int]] = []
    postings: dict[int, list[int]] = {}
    for i in np.argsort(sizes, kind="stable"):
        near: set[int] = set()
        for token in ranked[i][: prefix[i]].tolist():
            mine = postings.setdefault(token, [])
            near.update(mine)
            mine.append(int(i))
        if not near:
            continue
        c = np.fromiter(near, dtype=np.int64, count=len(near))
        c = c[(label[c] != label[i]) & (sizes[c] * den >= sizes[i] * num) & ((side[c] != side[i]) if across else True)]
        for j in c.tolist():
            if label[j] == label[i]:
                continue
            both = len(np.intersect1d(ranked[i], ranked[j], assume_unique=True))
            if den * both >= num * (sizes[i] + sizes[j] - both):
                forest.append((int(i), j))
                label[label == label[j]] = label[i]
    return forest


def pairs_table(ids: np.ndarray, forest: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([ids[i] for i, _ in forest], pa.int64()), "b": pa.array([ids[j] for _, j in forest], pa.int64())})


def likely_links(members: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between members of a group (g, doc) that their sketches (doc, n, sketch) leave possible."""
    work = block_tasks(members, "g", "doc", SKETCH_BLOCK).join(sketches.hint("merge"), "doc").select("g", "_lo", "_hi", "_side", "doc", "n", "sketch")

    def meet(t: pa.Table) -> pa.Table | None:
        if t.num_rows < 2:
            return None
        across = t.column("_lo")[0].as_py() != t.column("_hi")[0].as_py()
        forest = maybe_similar(folded(t.column("sketch").to_pylist()), t.column("n").to_numpy(), t.column("_side").to_numpy(), across, num, den)
        return pairs_table(t.column("doc").to_numpy(), forest) if forest else None

    return map_groups(work, ["g", "_lo", "_hi"], meet, "a bigint, b bigint")


def true_links(groups: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """True links (a, b) between members of a group (g, doc): a spanning forest for each task."""
    # The same plan at every size: a broadcast of the tasks would only work while they are few.
    work = block_tasks(groups, "g", "doc", BLOCK).join(texts.hint("merge"), "doc").select("g", "_lo", "_hi", "_side", "doc", "text")

    def verify(t: pa.Table) -> pa.Table | None:
        column = t.column("text").combine_chunks()
        sets = shingle_sets(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column, width)
        keep = np.array([i for i, s in enumerate(sets) if len(s)], dtype=np.int64)
        if len(keep) < 2:
            return None
        across = t.column("_lo")[0].as_py() != t.column("_hi")[0].as_py()
        forest = joined_within([sets[i] for i in keep], t.column("_side").to_numpy()[keep], across, num, den)
        return pairs_table(t.column("doc").to_numpy()[keep], forest)

    return map_groups(work, ["g", "_lo", "_hi"], verify, "a bigint, b bigint")


def similar_components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id for every row of docs; links are pairs with at least `percent` Jaccard similarity."""
    num, den = percent, 100
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    named = rows.filter("doc IS NOT NULL")
    over = Window.partitionBy("key")
    kind, has = F.col("tag").bitwiseAND(3), lambda flag: F.col("tag").bitwiseAND(flag) != 0
    met = first_pass(named, width, num, den).withColumns({"times": F.sum(F.when(has(MANY), 2).otherwise(1)).over(over), "any": F.max(F.col("tag").bitwiseAND(OWN)).over(over)})
    met = met.filter((kind != SIGNATURE) | ((F.col("times") > 1) & (F.col("any") != 0)))
    met = written(met.select(
        kind.alias("kind"), F.when(kind == SIGNATURE, F.col("key")).when(kind == MEMBER, F.col("rest.k2")).alias("sig"), F.when(kind == CLASS, F.col("key")).alias("k1"), F.when(kind == CLASS, F.col("rest.k2")).alias("k2"), "doc", "rest.lead", "rest.n", "rest.sketch"
    ), "met")
    classes = met.filter(F.col("kind") == CLASS).withColumn("lead", F.min("doc").over(Window.partitionBy("k1", "k2")))
    copies = met.filter(F.col("kind") == COPY)
    sets = classes.select("doc", "lead", "n").unionByName(copies.select("doc", "lead", "n"))

    same = sets.filter("doc <> lead").select(F.col("doc").alias("a"), F.col("lead").alias("b"))
    # One document stands for equal sets. Members of a group whose leader row went had no partner of the band.
    stands = classes.filter("doc <> lead").select(F.col("doc").alias("d"), F.col("lead").alias("r")).distinct()
    heads = met.filter(F.col("kind") == SIGNATURE).select("sig").distinct()
    members = met.filter(F.col("kind").isin(SIGNATURE, MEMBER)).select("sig", "doc").join(heads, "sig", "left_semi")
    members = members.join(stands, F.col("doc") == F.col("d"), "left").select(F.col("sig").alias("g"), F.coalesce("r", "doc").alias("doc")).distinct()
    sketches = classes.filter("doc = lead").select("doc", "n", "sketch").distinct()
    whole = components(likely_links(members, sketches, num, den))
    links = true_links(whole.select(F.col("component").alias("g"), F.col("node").alias("doc")), named, width, num, den)
    final = components(links.unionByName(same))
    out = sets.select("doc", "n").join(final.withColumnRenamed("node", "doc"), "doc", "left")
    out = out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_slices(batch, "text", 4 << 20):
                n = [len(s) for s in shingle_sets(part.column(1), width)]
                none = pa.nulls(len(n), pa.int64())
                yield pa.RecordBatch.from_arrays([none, pa.array(n, pa.int64()), none], names=["doc_id", "n_shingles", "component_id"])

    return out.unionByName(rows.filter("doc IS NULL").mapInArrow(count, "doc_id bigint, n_shingles bigint, component_id bigint"))
