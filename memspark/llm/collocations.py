"""Phrase collocations by depth-limited count tries.

Words (ASCII letters in lower case) stand in pieces between the marks .,;:!? and line ends; a phrase never leaves its piece,
and everything is counted by language.

1. Slices (slices.py) read texts once. Words are summed over all slices; only those met often enough can be part
   of a frequent phrase. Every word of a slice gets an answer, its number or 0, so that a rare word can't be
   taken for an answer that is missing. A word of 0 ends a path, as a piece's end does.
2. A slice is a shard. Each place in it gives one path, the (up to) WIDTH words from there on; the sorted distinct
   paths with their counts are the shard's trie, serialised front-coded (the words shared with the path before, then the
   rest), in blocks of BLOCK paths.
3. Paths are dealt out by ranges. The ranges' limits are quantiles of a sample of the paths, evenly spaced in each block from
   a place of its own, whole paths and not first words, so that a frequent word is split like anything else; a block is cut where a
   limit falls in it. The blocks' first paths would not do: shards are alike, so the first paths of their n-th blocks stand together,
   and the range after them would hold a whole block of every shard.
   A range's task merges its sorted blocks as they come by their first path, adds the counts of equal paths, and reads off the
   nodes of every depth. What a limit cuts in two is written out on both sides and added up after.
4. A node's key is its path. Walking up the trie gives the left part of each cut of a phrase, following suffix links
   (the path without its first word) the right part: both are joins of the node table with itself and the words.
   Scores are exact in decimals of 38 digits.

Memory: a slice, or a range (about RANGE paths while there are fewer than MOST_RANGES ranges). Slices meet their answers in
as many partitions as there are slices. The driver gets a sample of SAMPLE paths a range, the limits and one row a partition of words.

Defined results: null text is empty; null language is `und`; empty texts and pieces give nothing; texts are read whole
however long; repeated rows count each; an empty table gives an empty table; extra columns are ignored. There may
be up to 2**32 - 2 words met often enough.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import slices
from .common import written

WIDTH, LEAST, TOP, PERCENT = 5, 100, 2000, 100
UNKNOWN = "und"
MARKS = b".,;:!?\n\x0b\x0c\r"
STOP = b"."
FOLD = bytes.maketrans(bytes(range(65, 91)) + MARKS, bytes(range(97, 123)) + STOP * len(MARKS))

#: Bytes of text of a shard: sorting its paths takes about 15 times that.
SHARD = 8 << 20
#: Paths of a block, and how many of a full one are sampled.
BLOCK, SAMPLED = 1 << 16, 16
RANGE, MOST_RANGES = 1 << 21, 1 << 16
SAMPLE = 64
#: Merged paths that wait in a task before those that are complete leave it.
PENDING = 1 << 21


def words_of(text: bytes) -> list[bytes]:
    """The words, and STOP (which no word holds) for each mark. Bytes split at ASCII white space only."""
    return text.translate(FOLD).replace(STOP, b" . ").split()


def numbered(words: DataFrame) -> DataFrame:
    """words with `id`, dense from 1."""
    rows = written(words.select("*", F.monotonically_increasing_id().alias("_m")), "frequent")
    part = F.shiftright("_m", 33)
    sizes = sorted((r["_part"], r["n"]) for r in rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).collect())
    total = 0
    before = []
    for p, n in sizes:
        before.append((p, total + 1))
        total += n
    if total > (1 << 32) - 2:
        raise OverflowError("more words than 32-bit numbers")
    starts = words.sparkSession.createDataFrame(before, "_part bigint, _start bigint")
    return rows.withColumn("_part", part).join(F.broadcast(starts), "_part").select(*words.columns, (F.col("_start") + F.col("_m").bitwiseAND((1 << 33) - 1)).alias("id"))


# Tries: a matrix of paths (word numbers, 0 after the last) and their counts


def keys_of(paths: np.ndarray, bits: int) -> list[np.ndarray]:
    """The paths as few 64-bit numbers that sort alike."""
    each = 64 // bits
    out = []
    for start in range(0, paths.shape[1], each):
        key = np.zeros(len(paths), dtype=np.uint64)
        for c in range(start, min(start + each, paths.shape[1])):
            key = key << np.uint64(bits) | paths[:, c].astype(np.uint64)
        out.append(key)
    return out


def summed(paths: np.ndarray, counts: np.ndarray, bits: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct paths with the sums of their counts."""
    if not len(paths):
        return paths, counts
    keys = keys_of(paths, bits)
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(paths), dtype=bool)
    new[0] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    return paths[order[at]], np.add.reduceat(counts[order], at)


def shared(paths: np.ndarray) -> np.ndarray:
    """How many words each path shares with the one before."""
    same = np.zeros(len(paths), dtype=np.uint8)
    alike = np.ones(len(paths) - 1, dtype=bool)
    for c in range(paths.shape[1]):
        alike &= paths[1:, c] == paths[:-1, c]
        same[1:] += alike
    return same


def serialised(paths: np.ndarray, counts: np.ndarray) -> bytes:
    """Front-coded: shared words, path's own words, count."""
    front = shared(paths)
    size = (paths > 0).sum(axis=1).astype(np.uint8)
    column = np.arange(paths.shape[1])
    own = paths[(column >= front[:, None]) & (column < size[:, None])]
    body = front.tobytes() + size.tobytes() + np.ascontiguousarray(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() + np.ascontiguousarray(own.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(paths).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(body)


def read(data: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[4:]), np.uint8)
    front, size = body[:n], body[n : 2 * n]
    counts = np.ascontiguousarray(body[2 * n : 10 * n].reshape(8, n).T).view("<u8").ravel().astype(np.int64)
    own = np.ascontiguousarray(body[10 * n :].reshape(4, -1).T).view("<u4").ravel()
    paths = np.zeros((n, width), dtype=np.uint32)
    column = np.arange(width)
    paths[(column >= front[:, None]) & (column < size[:, None])] = own
    rows = np.arange(n)
    for c in range(width):
        paths[:, c] = paths[np.maximum.accumulate(np.where(front <= c, rows, 0)), c]
    return paths, counts


def binary(paths: np.ndarray) -> np.ndarray:
    """Paths as byte strings that sort alike."""
    return np.ascontiguousarray(paths.astype(">u4")).view(f"S{4 * paths.shape[1]}").ravel()


def shard(seq: np.ndarray, width: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The trie of a run of words (0: a break): the paths of two words and more."""
    n = len(seq)
    tail = np.concatenate([seq, np.zeros(width, dtype=seq.dtype)])
    at = np.flatnonzero((seq > 0) & (tail[1 : n + 1] > 0))
    paths = np.zeros((len(at), width), dtype=np.uint32)
    alive = np.ones(len(at), dtype=bool)
    for c in range(width):
        found = tail[at + c]
        alive &= found > 0
        paths[:, c] = np.where(alive, found, 0)
    return summed(paths, np.ones(len(at), dtype=np.int64), bits)


TRIE = "first binary, paths int, trie binary"
WITH_SAMPLE = f"{TRIE}, sample array<binary>"


def tries(found: DataFrame, width: int) -> DataFrame:
    """The blocks of every slice's trie; found: (size: its words, lengths, tokens, at, id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                lengths, tokens, at, ids = (batch.column(c)[k] for c in ("lengths", "tokens", "at", "id"))
                tokens, place, ids, ends = slices.unpacked(tokens.as_py()), at.values.to_numpy(), ids.values.to_numpy(), np.cumsum(lengths.values.to_numpy())
                answers = np.full(batch.column("size")[k].as_py(), -1, dtype=np.int64)
                answers[place] = ids
                if (answers < 0).any():
                    raise RuntimeError("a slice's words lack answers")
                place = np.flatnonzero(answers)
                ids = answers[place]
                order = np.argsort(ids)
                rank = np.zeros(len(answers), dtype=np.uint32)
                rank[place[order]] = np.arange(1, len(ids) + 1)
                name = np.concatenate([[0], ids[order]]).astype(np.uint32)
                paths, counts = shard(np.insert(rank[tokens], ends, 0), width, max(1, len(ids).bit_length()))
                paths = name[paths]
                rows = [(paths[s : s + BLOCK], counts[s : s + BLOCK]) for s in range(0, len(paths), BLOCK)]
                part = blocks(rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([sampled(p, max(1, BLOCK // SAMPLED)) for p, _ in rows], pa.list_(pa.binary()))], names=[*part.schema.names, "sample"])

    return found.mapInArrow(run, WITH_SAMPLE)


def sampled(paths: np.ndarray, every: int) -> list[bytes]:
    """Paths of a block, so many apart, the first at a place that differs from block to block; none of many a short block."""
    start = zlib.crc32(paths.tobytes()) % every
    return [row.tobytes() for row in paths[start::every].astype(">u4")]


def blocks(rows: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([p[0].astype(">u4").tobytes() for p, _ in rows], pa.binary()), pa.array([len(p) for p, _ in rows], pa.int32()), pa.array([serialised(p, c) for p, c in rows], pa.binary()),
    ], names=["first", "paths", "trie"])


def limits(table: DataFrame, ranges: int) -> list[bytes]:
    """Paths that cut the table's into so many ranges of about a size: quantiles of the sampled paths. They decide who merges, not what."""
    if ranges < 2:
        return []
    n = table.agg(F.sum(F.size("sample"))).head()[0] or 0
    share = min(1.0, SAMPLE * ranges / max(n, 1))
    each = table.select(F.explode("sample"))
    found = sorted(bytes(r[0]) for r in (each.sample(share, seed=1) if share < 1 else each).collect())  # about SAMPLE a range
    return sorted({found[len(found) * k // ranges] for k in range(1, ranges)}) if found else []


def dealt(table: DataFrame, at: list[bytes], width: int) -> DataFrame:
    """The blocks, cut at the limits, with the number of their range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = np.array(at, dtype=f"S{4 * width}")
        for batch in batches:
            for k in range(batch.num_rows):
                paths, counts = read(batch.column("trie")[k].as_py(), width)
                where = np.searchsorted(binary(paths), cuts, side="left") if len(cuts) else np.zeros(0, dtype=np.int64)
                edges = np.concatenate([[0], where, [len(paths)]])
                full = np.flatnonzero(edges[1:] > edges[:-1])
                part = blocks([(paths[edges[r] : edges[r + 1]], counts[edges[r] : edges[r + 1]]) for r in full])
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *part.columns], names=["range", "first", "paths", "trie"])

    return table.mapInArrow(run, f"range int, {TRIE}")


def nodes_of(paths: np.ndarray, counts: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The nodes of each depth from 2 in a sorted run: those met `least` times, and the first and last, which may go on elsewhere."""
    front = shared(paths)
    for depth in range(2, paths.shape[1] + 1):
        start = np.flatnonzero(front < depth)
        total = np.add.reduceat(counts, start)
        keep = total >= least
        keep[[0, -1]] = True
        keep &= paths[start, depth - 1] > 0
        yield paths[start[keep], :depth], total[keep]


def merged(parts: DataFrame, ranges: int, width: int, least: int) -> DataFrame:
    """path (4 bytes a word), f: the nodes of all tries, of two words and more, met `least` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, now, grown = [], 0, None, PENDING

        def out(paths: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(paths):
                for node, total in nodes_of(paths, counts, least):
                    keys = [row.tobytes() for row in node.astype(">u4")]
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(total, pa.int64())], names=["path", "f"])

        def together() -> tuple[np.ndarray, np.ndarray]:
            return summed(np.concatenate([p for p, _ in held]), np.concatenate([c for _, c in held]))

        for batch in batches:
            for r, first, data in zip(*(batch.column(c).to_pylist() for c in ("range", "first", "trie")), strict=True):
                if held and r != now:
                    yield from out(*together())
                    held, waiting, grown = [], 0, PENDING
                elif waiting >= grown:
                    paths, counts = together()
                    done = int(np.searchsorted(binary(paths), np.bytes_(first), side="left"))
                    yield from out(paths[:done], counts[:done])
                    held = [(paths[done:], counts[done:])]
                    waiting = len(paths) - done
                    grown = waiting + PENDING
                now = r
                held.append(read(data, width))
                waiting += len(held[-1][0])
        if held:
            yield from out(*together())

    sorted_ = parts.repartition(max(1, ranges), "range").sortWithinPartitions("range", "first").select("range", "first", "trie")
    return sorted_.mapInArrow(run, "path binary, f bigint").groupBy("path").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)


def key_of(n):
    """A word's number as a path."""
    return F.unhex(F.lpad(F.hex(n), 8, "0"))


def mine_phrases(docs: DataFrame, width: int = WIDTH, least: int = LEAST, top: int | None = TOP, percent: int = PERCENT, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's strongest phrases of 2 to `width` words met `least` times.

    A phrase goes where a longer one that holds it has `percent` per cent of its count. top: so many of each language; None: all.
    """
    spark = docs.sparkSession
    group = f"coalesce(cast(`{lang}` as string), '{UNKNOWN}')"
    table = slices.slices(docs, [], words_of, "phrase-slices", text, group=group, size=SHARD)
    asked = slices.asked(table)
    every = written(asked.groupBy("group", "word").agg(F.sum("n").alias("f")), "phrase-words")
    real = F.col("word") != F.lit(STOP)
    often = real & (F.col("f") >= least)
    totals = every.filter(real).groupBy("group").agg(F.sum("f").alias("n"))
    words = written(numbered(every.filter(often)), "phrase-ids")
    ids = words.select("group", "word", "id").unionByName(every.filter(~often).select("group", "word", F.lit(0).cast("bigint").alias("id")))
    answers = slices.answered(asked.select("slice", "at", "group", "word").join(ids, ["group", "word"]), ["id"], table.count())
    table = written(tries(table.select("slice", F.size("words").alias("size"), "lengths", "tokens").join(answers, "slice"), width), "tries")
    paths = table.agg(F.sum("paths")).head()[0] or 0
    wanted = min(MOST_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-paths // RANGE)))
    at = limits(table, wanted)
    nodes = written(merged(dealt(table.drop("sample"), at, width), len(at) + 1, width, least), "nodes")
    return scored(nodes, words, totals, top, percent)


def scored(nodes: DataFrame, words: DataFrame, totals: DataFrame, top: int | None, percent: int) -> DataFrame:
    """The strongest of nodes (path, f); words (id, group, word, f); totals (group, n)."""
    size = (F.length("path") / 4).cast("int")
    every = nodes.unionByName(words.select(key_of(F.col("id")).alias("path"), "f"))
    cut = nodes.select("path", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cut = cut.withColumns({"left": F.expr("substring(path, 1, 4 * k)"), "right": F.expr("substring(path, 4 * k + 1)")})
    cut = cut.join(every.select(F.col("path").alias("left"), F.col("f").alias("l")), "left").join(every.select(F.col("path").alias("right"), F.col("f").alias("r")), "right")

    spelled = nodes.select("path", F.posexplode(F.sequence(F.lit(0), size - 1)).alias("at", "i")).withColumn("key", F.expr("substring(path, 4 * i + 1, 4)"))
    spelled = spelled.join(words.select(key_of(F.col("id")).alias("key"), "group", "word"), "key")
    spelled = spelled.groupBy("path").agg(F.first("group").alias("group"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("_words"))
    spelled = spelled.select("path", "group", F.array_join(F.transform("_words", lambda w: w["word"].cast("string")), " ").alias("phrase"))

    longer = nodes.filter(size > 2).select(F.explode(F.array(F.expr("substring(path, 1, length(path) - 4)"), F.expr("substring(path, 5)"))).alias("path"), F.col("f").alias("_longer"))
    longer = longer.groupBy("path").agg(F.max("_longer").alias("_longer"))

    wide = lambda c: F.col(c).cast("decimal(19,0)")
    of = cut.join(spelled.join(totals, "group"), "path")
    of = of.withColumn("score", F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n"), wide("l") * wide("r")))
    best = of.groupBy("path", "group", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("_b"))
    kept = best.join(longer, "path", "left").filter(F.col("_longer").isNull() | (F.lit(100).cast("decimal(3,0)") * wide("_longer") < F.lit(percent).cast("decimal(3,0)") * wide("a")))
    out = kept.select(F.col("group").alias("lang"), "phrase", "a", F.col("_b.l").alias("l"), F.col("_b.r").alias("r"), "n", F.col("_b.score").alias("score"))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))).cast("bigint"))
    return (out if top is None else out.filter(F.col("rank") <= top)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle(width: int = WIDTH, least: int = LEAST, top: int = TOP, percent: int = PERCENT) -> str:
    return rf"""WITH docs AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
piece AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM docs)),
total AS (SELECT lang, sum(len(w)) AS n FROM piece GROUP BY lang),
gram AS (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase, count(*) AS f FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM piece, (SELECT unnest(range(1, {width + 1})) AS m) WHERE len(w) >= m)
  GROUP BY lang, m, phrase HAVING count(*) >= {least}),
cut AS (SELECT lang, m, phrase, f AS a, k, array_to_string(s[1 : k], ' ') AS x, array_to_string(s[k + 1 : m], ' ') AS y FROM (SELECT *, string_split(phrase, ' ') AS s, unnest(range(1, m)) AS k FROM gram WHERE m > 1)),
rated AS (SELECT c.lang, c.m, c.phrase, c.a, c.k, u.f AS l, v.f AS r, t.n, CAST(1000::HUGEINT * c.a * t.n // (u.f::HUGEINT * v.f) AS BIGINT) AS score
  FROM cut c JOIN gram u ON u.lang = c.lang AND u.phrase = c.x JOIN gram v ON v.lang = c.lang AND v.phrase = c.y JOIN total t ON t.lang = c.lang),
best AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM gram g WHERE g.lang = b.lang AND g.m > b.m AND contains(' ' || g.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * g.f >= {percent} * b.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM kept QUALIFY rank <= {top}"""


ORACLE = oracle()
