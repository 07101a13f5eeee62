"""Substring dedup by compacting a de Bruijn graph of token k-mers.

An edge is a window of WIDTH words, a node a window of WIDTH - 1. An edge that starts at two places or
more is repeated, and the words under its starts go. Storing every edge would cost many times the input,
so edges are sieved first:

1. Anchors. Of the ANCHOR-grams in a window the one with the least hash is its anchor. Equal windows have
   equal anchors, so a window can only repeat if its anchor occurs more than once. Consecutive windows
   mostly share an anchor, which leaves about a tenth of the words as rows. A window function over the
   anchor tells which repeat.
2. Edges. Texts meet their repeated anchors in a join on the document, and emit only the edges above such
   anchors. Consecutive edges with one anchor travel as one row (a super-k-mer, as in BCALM 2, Chikhi et al.
   2016) to the anchor's partition, where a window function finds those that start at two places - an edge is
   known by two 64-bit hashes, its anchor's and its own, under different bases. Where the predecessors or the
   successors of an edge differ, the node before or after it branches.
3. Paths. Each super-k-mer's findings fold into bits, which meet the text in a second join on the same key (so
   that the text moves once). There, runs of repeated edges, cut at branching nodes, are compacted into walks
   along nonbranching paths: (first word, number of edges). All places of an edge see the same branches, so a
   path is cut alike in all its copies.
4. Verification. Each walk's words are read at its source coordinates; a walk whose words (by SHA-256) are met at
   no other coordinates came from equal hashes of unequal edges, and is refuted. Words under the other walks go.
   Only refuted walks are joined back, so a passage's copies never meet: they are counted map-side.

What a map task sees twice itself is combined before the shuffle: equal anchors, and equal super-k-mers, become one row
that lists the places of the others. So a hot anchor or passage costs a row a batch, wherever its copies are. What
stands around a passage's copies differs, though, and so do the super-k-mers above the anchors near its ends. The first
step counts these, and an anchor with more than HOT of them is split: its edges travel alone, to a task for each edge.

Defined results: null and empty texts have no words; a text shorter than a window loses nothing; equal
rows are two occurrences each of their windows; very long texts are read whole; rows are told apart by
document id and 32 bits of the text, a null id is an id like any other; an empty table gives an empty
table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import in_slices

WIDTH, ANCHOR = 35, 17
U64 = np.uint64
#: Stands for a null document id in the joins.
NO_ID = -(1 << 63)
SLICE = 1 << 20
#: An anchor with more super-k-mers than these, equal ones of a batch counted once, is split by edges.
HOT = 512
PLACES = "array<struct<id: bigint, tk: bigint, pos: int>>"


def least_anchor(grams: np.ndarray, span: int) -> np.ndarray:
    """Where the least of grams[i : i + span] stands, for each i (the first of equals), by doubling."""
    n = len(grams) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.arange(len(grams))
    size = 1
    while size * 2 <= span:
        a, b = at[: len(at) - size], at[size:]
        at = np.where(grams[b] < grams[a], b, a)
        size *= 2
    a, b = at[:n], at[span - size : span - size + n]
    return np.where(grams[b] < grams[a], b, a)


def anchors(w: K.Words, h: np.ndarray, width: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows' first words, each one's anchor's first word, and the hashes of all anchor-size grams."""
    at, _ = K.windows(h, w.doc, width, K.WORD_BASES[0])
    n = len(h) - size + 1
    if n <= 0 or not len(at):
        return at, at, np.zeros(0, U64)
    grams = K.ranges_hash(h, np.arange(n), np.arange(n) + size, K.WORD_BASES[0])
    return at, least_anchor(grams, width - size + 1)[at], grams


def alike(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows in an order that puts equal keys together, and where in it each key starts."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
    return order, np.flatnonzero(new)


def slices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, K.Words, np.ndarray, pa.RecordBatch]]:
    for part in in_slices(batch, "text", SLICE):
        w = K.words_of(part.column("text"))
        yield part.column("id").to_numpy(), part.column("tk").to_numpy(), w, w.hashes(), part


def listed(order: np.ndarray, starts: np.ndarray, columns: tuple[np.ndarray, ...]) -> tuple[np.ndarray, pa.Array, pa.ListArray]:
    """Each group's first row, its weight (2 for more rows than one) and the places (id, tk, pos) of the other rows."""
    times = np.diff(np.append(starts, len(order)))
    rest = np.delete(order, starts)
    places = pa.StructArray.from_arrays([pa.array(x[rest]) for x in columns], names=["id", "tk", "pos"])
    offsets = np.append(0, np.cumsum(times - 1)).astype(np.int32)
    return order[starts], pa.array(np.minimum(times, 2).astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), places)


def all_places() -> Column:
    own = F.array(F.struct("id", "tk", "pos"))
    return F.when(F.size("others") > 0, F.concat(own, "others")).otherwise(own)


def find_anchors(rows: DataFrame, width: int, size: int) -> DataFrame:
    """a, id, tk, pos, weight, kinds, others: each anchor of a batch once, with the number of its different super-k-mers.

    If there are more places, a second row of weight 0 lists them, under a key of its own and the first place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for ids, tks, w, h, _ in slices(batch):
                starts, at, grams = anchors(w, h, width, size)
                if not len(starts):
                    continue
                first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                last = np.append(first[1:], len(starts)) - 1
                at, doc = at[first], w.doc[starts[first]]
                spans = K.ranges_hash(h, starts[first], starts[last] + width, K.WORD_BASES[1])
                for column, x in zip(out, (grams[at], spans, ids[doc], tks[doc], (at - w.first[doc]).astype(np.int32)), strict=True):
                    column.append(x)
            if not out[0]:
                continue
            a, spans, ids, tks, pos = (np.concatenate(x) for x in out)
            order, each = alike([a, spans])
            starts = np.flatnonzero(np.append(True, a[order[1:]] != a[order[:-1]]))
            kinds = np.diff(np.searchsorted(each, np.append(starts, len(order))))
            head, weight, others = listed(order, starts, (ids, tks, pos))
            # The lists meet nobody, so they go anywhere, and not where a hot anchor is counted.
            some = np.flatnonzero(np.diff(np.append(starts, len(order))) > 1)
            own = head[some]
            away = K.mix(a[own] ^ ids[own].astype(U64) ^ K.mix(pos[own].astype(U64)), 7)
            none = np.zeros(len(some), np.int32)
            at = np.append(head, own)
            empty = pa.ListArray.from_arrays(pa.array(np.zeros(len(head) + 1, np.int32)), others.values.slice(0, 0))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.append(a[head], away).view(np.int64)), pa.array(ids[at]), pa.array(tks[at]), pa.array(pos[at]),
                    pa.concat_arrays([weight, pa.array(none)]), pa.array(np.append(kinds.astype(np.int32), none)), pa.concat_arrays([empty, others.take(pa.array(some))]),
                ],
                names=["a", "id", "tk", "pos", "weight", "kinds", "others"],
            )

    return rows.mapInArrow(run, f"a bigint, id bigint, tk bigint, pos int, weight int, kinds int, others {PLACES}")


EDGES = f"a bigint, id bigint, tk bigint, pos int, weight int, before_lo bigint, before_hi bigint, after_lo bigint, after_hi bigint, edges array<bigint>, others {PLACES}"


def find_edges(rows: DataFrame, width: int, size: int) -> DataFrame:
    """The edges above each of the given anchors, a batch's equal ones in one row.

    Consecutive windows with one anchor are a super-k-mer: edges holds their hashes in order, pos is the first
    one's first word; before and after are the least and greatest hashes of the words around (0 at a text's ends);
    others are the further places of the same super-k-mer. A given anchor is twice its place, and 1 more if it is
    split: then each of its edges is a row, under a key of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(8)]
            for ids, tks, w, h, part in slices(batch):
                mine = part.column("anchors")
                lengths = mine.value_lengths().fill_null(0).to_numpy()
                if not lengths.sum():
                    continue
                doc = np.repeat(np.arange(len(ids)), lengths)
                marked, split = (np.zeros(len(h) + 1, dtype=bool) for _ in range(2))
                given = mine.flatten().to_numpy()
                marked[w.first[doc] + (given >> 1)] = True
                split[w.first[doc] + (given >> 1)] = given & 1
                starts, at, grams = anchors(w, h, width, size)
                some = marked[at]
                starts, at = starts[some], at[some]
                if not len(starts):
                    continue
                doc = w.doc[starts]
                edges = K.ranges_hash(h, starts, starts + width, K.WORD_BASES[1])
                head = np.append(True, at[1:] != at[:-1])
                tail = np.append(head[1:], True)
                alone = split[at]
                first = np.flatnonzero(head | alone)
                last = np.append(first[1:], len(starts)) - 1
                word = (h >> U64(1)).astype(np.int64) | 1
                d = doc[first]
                before = np.where(starts[first] > w.first[d], word[np.maximum(starts[first] - 1, 0)], 0)
                ends = starts[last] + width
                after = np.where(ends < w.first[d + 1], word[np.minimum(ends, len(h) - 1)], 0)
                # Within its super-k-mer a lone edge's neighbours are edges, as in the rows that aren't split.
                near = edges.view(np.int64)
                before = np.where(head[first], before, near[first - 1])
                after = np.where(tail[last], after, near[np.minimum(last + 1, len(near) - 1)])
                a = np.where(alone[first], K.mix(grams[at[first]] ^ edges[first], 9), grams[at[first]])
                for column, x in zip(out, (a, ids[d], tks[d], (starts[first] - w.first[d]).astype(np.int32), before, after, last - first + 1, edges), strict=True):
                    column.append(x)
            if not out[0]:
                continue
            a, ids, tks, pos, before, after, lengths, edges = (np.concatenate(x) for x in out)
            ends = np.cumsum(lengths)
            order, starts = alike([a, K.ranges_hash(edges, ends - lengths, ends, K.WORD_BASES[0])])
            head, weight, others = listed(order, starts, (ids, tks, pos))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(edges.view(np.int64))).take(pa.array(head))
            around = [pa.array(f.reduceat(x[order], starts)) for x in (before, after) for f in (np.minimum, np.maximum)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)[head]), pa.array(ids[head]), pa.array(tks[head]), pa.array(pos[head]), weight, *around, lists, others],
                names=["a", "id", "tk", "pos", "weight", "before_lo", "before_hi", "after_lo", "after_hi", "edges", "others"],
            )

    return rows.mapInArrow(run, EDGES)


def repeated_edges(found: DataFrame) -> DataFrame:
    """id, tk, pos and bits for each super-k-mer with repeated edges: which repeat, and before or after which the path branches.

    Equal edges have equal anchors, so one exchange by anchor brings them together; they unfold after it, and fold
    into bits again before the next. A row's other places travel with its first edge, which repeats if there are any.
    """
    each = found.repartition("a").select("*", F.posexplode("edges").alias("i", "e"))
    near = lambda step, end: F.coalesce(F.get("edges", F.col("i") + step), F.col(end))
    each = each.select(
        "a", "id", "tk", "pos", "weight", "i", "e", F.when((F.col("i") == 0) & (F.size("others") > 0), F.col("others")).alias("others"),
        near(-1, "before_lo").alias("prev_lo"), near(-1, "before_hi").alias("prev_hi"), near(1, "after_lo").alias("next_lo"), near(1, "after_hi").alias("next_hi"),
    )
    over = Window.partitionBy("a", "e")
    marked = each.select(
        "a", "id", "tk", "pos", "i", "others", F.sum("weight").over(over).alias("times"),
        (F.min("prev_lo").over(over) != F.max("prev_hi").over(over)).alias("joins"), (F.min("next_lo").over(over) != F.max("next_hi").over(over)).alias("parts"),
    ).filter("times > 1")
    bit = F.expr("shiftleft(1L, i)")
    bits = lambda c: F.bit_or(F.when(F.col(c), bit).otherwise(F.lit(0).cast("long"))).alias(c)
    folded = marked.groupBy("a", "id", "tk", "pos").agg(F.bit_or(bit).alias("repeats"), bits("joins"), bits("parts"), F.flatten(F.collect_list("others")).alias("others"))
    return folded.select(F.explode(all_places()).alias("at"), "repeats", "joins", "parts").select("at.*", "repeats", "joins", "parts")


def walks_of(marks: list[dict], width: int) -> tuple[np.ndarray, np.ndarray]:
    """First edge and number of edges of a text's walks along nonbranching paths of repeated edges."""
    pos = np.array([m["pos"] for m in marks], dtype=np.int64)
    rows = {k: np.array([m[k] for m in marks], dtype=np.int64) for k in ("repeats", "joins", "parts")}
    bit = np.arange(width, dtype=np.int64)
    flags = {k: (v[:, None] >> bit & 1).astype(bool) for k, v in rows.items()}
    at = (pos[:, None] + bit)[flags["repeats"]]
    # Equal rows of the table give their marks more than once.
    at, order = np.unique(at, return_index=True)
    joins, parts = flags["joins"][flags["repeats"]][order], flags["parts"][flags["repeats"]][order]
    cut = np.ones(len(at), dtype=bool)
    cut[1:] = (at[1:] != at[:-1] + 1) | joins[1:] | parts[:-1]
    start = np.flatnonzero(cut)
    return at[start], np.diff(np.append(start, len(at)))


def texts_and_marks(docs: DataFrame, width: int, size: int, id_col: str, text: str) -> DataFrame:
    """id, tk, text and marks (of the super-k-mers with repeated edges, or null) for every row."""
    if not 1 <= width - size + 1 <= 62:
        raise ValueError("an anchor must be shorter than a window, by 61 words at most")
    rows = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("tk"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")
    )
    over = Window.partitionBy("a")
    found = find_anchors(rows, width, size).withColumns({"times": F.sum("weight").over(over), "split": (F.sum("kinds").over(over) > HOT).cast("int")}).filter("times > 1 OR weight = 0")
    found = found.groupBy("id", "tk", "pos").agg(F.max("split").alias("split"), F.flatten(F.collect_list(F.when(F.size("others") > 0, F.col("others")))).alias("others"))
    found = found.select(F.explode(all_places()).alias("at"), "split").select("at.*", "split")
    places = found.groupBy("id", "tk").agg(F.collect_set(F.col("pos") * 2 + F.col("split")).alias("anchors"))
    both = rows.join(places, ["id", "tk"], "left")
    edges = repeated_edges(find_edges(both.filter("anchors IS NOT NULL"), width, size))
    marks = edges.groupBy("id", "tk").agg(F.collect_list(F.struct("pos", "repeats", "joins", "parts")).alias("marks"))
    return both.join(marks, ["id", "tk"], "left").select("id", "tk", "text", "marks")


def walks(rows: DataFrame, width: int) -> DataFrame:
    """id, tk, start, n_words and path of the walks of texts_and_marks' rows; path digests the words at these coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # The rows without marks are left out here: a filter in the plan would keep it from sharing the texts' exchange.
            batch = batch.filter(batch.column("marks").is_valid())
            for part in in_slices(batch, "text", 4 << 20):
                out: list[list] = [[], [], [], [], []]
                for doc, tk, t, marks in zip(*(part.column(c).to_pylist() for c in ("id", "tk", "text", "marks")), strict=True):
                    words = t.encode().split()
                    for start, n in zip(*(x.tolist() for x in walks_of(marks, width)), strict=True):
                        span = words[start : start + n + width - 1]
                        for column, x in zip(out, (doc, tk, start, len(span), hashlib.sha256(b" ".join(span)).digest()), strict=True):
                            column.append(x)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)], names=["id", "tk", "start", "n_words", "path"])

    return rows.mapInArrow(run, "id bigint, tk bigint, start bigint, n_words bigint, path binary")


def refuted(found: DataFrame) -> DataFrame:
    """id, tk, wrong: the starts of a text's walks whose words stand at no other coordinates."""
    once = found.groupBy("path").agg(F.count(F.lit(1)).alias("times"), F.min("id").alias("id"), F.min("tk").alias("tk"), F.min("start").alias("start")).filter("times = 1")
    return once.groupBy("id", "tk").agg(F.collect_list("start").alias("wrong"))


def repeated_spans(docs: DataFrame, width: int = WIDTH, size: int = ANCHOR, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start_word, n_words, path: the repeated passages by their verified source coordinates; copies have one path."""
    found = walks(texts_and_marks(docs, width, size, id_col, text), width)
    kept = found.join(refuted(found), ["id", "tk"], "left").filter(~F.coalesce(F.array_contains("wrong", F.col("start")), F.lit(False)))
    return kept.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), F.col("start").alias("start_word"), "n_words", F.lower(F.hex("path")).alias("path"))


def dedup_substrings(docs: DataFrame, width: int = WIDTH, size: int = ANCHOR, id_col: str = "doc_id", text: str = "text", kept_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and the kept words joined by single spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_slices(batch, "text", 4 << 20):
                out: list[list] = [[], [], [], [], []]
                for doc, t, marks, wrong in zip(*(part.column(c).to_pylist() for c in ("id", "text", "marks", "wrong")), strict=True):
                    words = t.encode().split()
                    kept = words
                    if marks:
                        start, n = walks_of(marks, width)
                        if wrong:
                            right = ~np.isin(start, wrong)
                            start, n = start[right], n[right]
                        gone = K.covered(len(words), start, n + width - 1)
                        kept = [x for x, g in zip(words, gone.tolist(), strict=True) if not g]
                    left = b" ".join(kept)
                    for column, x in zip(out, (None if doc == NO_ID else doc, len(words), len(words) - len(kept), hashlib.sha256(left).hexdigest(), left.decode() if kept_text else None), strict=True):
                        column.append(x)
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, types, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    rows = texts_and_marks(docs, width, size, id_col, text)
    return rows.join(refuted(walks(rows, width)), ["id", "tk"], "left").mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string")
