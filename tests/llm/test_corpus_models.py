"""Lattice scores, vector codes and collocations against brute-force versions and SQL, on small tables with odd rows."""

import math
import random
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest

from memspark.llm import collocations, lattice_lm, queries, slices, vector_codes
from tests.compare import assert_same, counted

ODD = [None, "", " ", "\n\n\n", "one", "a b", "😀 é　x ▁▁ ▁", "word " * 400, "x" * 3000, "Zu\tund\x0bviel\n" * 30, "A.b,C;d!E?f:g", "\x00\x01 \x1c \x85"]
DOCS = "doc_id bigint, text string, lang string, slice int, lm string, docs int, `at` int"
PATH = public_tokenizers.path("piece_bpe_32k.model")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "x", 7, 2) for i, t, lang in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(60).select("text").collect()]


# 11


def splits(word, weights):
    """Every segmentation of a word, and its probability."""
    if not word:
        yield (), 1.0
    for k in range(1, len(word) + 1):
        if word[:k] in weights:
            for rest, p in splits(word[k:], weights):
                yield (word[:k], *rest), weights[word[:k]] * p


def log_sum(word, weights, longest):
    """Log of the sum over segmentations, with rescaling, by ends."""
    got, scale = [1.0], 0.0
    for end in range(1, len(word) + 1):
        got.append(sum(got[max(0, end - k)] * weights.get(word[end - k : end], 0.0) for k in range(1, min(end, longest) + 1)))
        if got[-1] < 1e-200:
            got = [x * 1e150 for x in got]
            scale -= 150 * math.log(10)
    return math.log(got[-1]) + scale


def test_lattice_sums_every_segmentation():
    pieces = [bytes([b]) for b in range(256)] + [b"ab", b"abc", b"bc", b"ca", b"\xe2\x96\x81a", b"\xe2\x96\x81"]
    lattice = lattice_lm.Lattice(pieces, np.arange(1.0, len(pieces) + 1))
    weights = {p: math.exp(lattice.log[i]) for i, p in enumerate(pieces)}
    words, counts = [b"", b"a", b"abc", b"abcabca", b"zz", b"bcbc"], np.array([2.0, 1, 3, 2, 5, 1])
    found, uses = lattice.pass_over(words, counts)
    want = Counter()
    for w, c, log in zip(words, counts, found, strict=True):
        every = list(splits(lattice_lm.MARK + w, weights))
        total = sum(p for _, p in every)
        assert math.isclose(log, math.log(total), rel_tol=1e-12)
        for way, p in every:
            for piece in way:
                want[piece] += c * p / total
    assert np.allclose(uses, [want[p] for p in pieces], rtol=1e-9, atol=1e-12)


def brute_lattice(rows, train, rounds=2):
    """Base parts and the log10 score of every row; training by enumeration over a forward and backward pass in Python."""
    words = [(t or "").encode().lower().split() for t in rows]
    c = Counter(w for ws, t in zip(words, train, strict=True) if t for w in ws)
    ends = sum(train)
    n, v = sum(c.values()) + ends, len(c) + bool(ends)
    lattice = lattice_lm.Lattice(*lattice_lm.vocabulary(PATH))
    pieces = lattice_lm.vocabulary(PATH)[0]
    longest = max(map(len, pieces))
    for _ in range(rounds if ends else 0):
        weights = {p: math.exp(lattice.log[i]) for i, p in enumerate(pieces)}
        uses = Counter()
        for w, times in c.items():
            s = lattice_lm.MARK + w
            if len(s) > 400:  # by halves of its log only: such words are left to the other test
                uses.update({p: x for p, x in zip(pieces, lattice.pass_over([w], np.array([float(times)]))[1], strict=True) if x})
                continue
            ahead, back = [1.0] + [0.0] * len(s), [0.0] * len(s) + [1.0]
            for e in range(1, len(s) + 1):
                ahead[e] = sum(ahead[e - k] * weights.get(s[e - k : e], 0.0) for k in range(1, min(e, longest) + 1))
            for b in range(len(s) - 1, -1, -1):
                back[b] = sum(weights.get(s[b : b + k], 0.0) * back[b + k] for k in range(1, min(len(s) - b, longest) + 1))
            for b in range(len(s)):
                for k in range(1, min(len(s) - b, longest) + 1):
                    if s[b : b + k] in weights:
                        uses[s[b : b + k]] += times * ahead[b] * weights[s[b : b + k]] * back[b + k] / ahead[-1]
        lattice.learn(np.array([uses[p] for p in pieces] + [float(ends)]))
    weights = {p: math.exp(lattice.log[i]) for i, p in enumerate(pieces)}
    base = lambda x: math.log10((x + 0.5) / (n + 0.5 * (v + 1)))
    logs = {}
    for ws in words:
        for w in ws:
            if w not in logs:
                logs[w] = log_sum(lattice_lm.MARK + w, weights, longest)
    return [(len(ws) + 1, sum(c[w] > 0 for w in ws) + bool(ends), n, sum(base(c[w]) for w in ws) + base(ends), (sum(logs[w] for w in ws) + lattice.log[len(pieces)]) / math.log(10)) for ws in words]


@pytest.mark.parametrize("size", [1 << 24, 700])
def test_lattice_scores(spark, texts, size, monkeypatch):
    every = [*texts[:12], *ODD, *texts[:3]]
    monkeypatch.setattr(slices.slices, "__defaults__", (*slices.slices.__defaults__[:-1], size))
    out, s = lattice_lm.score_texts(docs(spark, [(i, t, None) for i, t in enumerate(every)]), PATH, "doc_id % 5 <> 1")
    assert s == "_lm" and set(DOCS.replace("`", "").split()[::2]) <= set(out.columns)
    got = {r["doc_id"]: r[s] for r in out.collect()}
    want = brute_lattice(every, [i % 5 != 1 for i in range(len(every))])
    assert len(got) == len(every)
    for i, w in enumerate(want):
        assert tuple(got[i])[:3] == w[:3]
        assert math.isclose(got[i]["base_score"], w[3], rel_tol=1e-9) and math.isclose(got[i]["score"], w[4], rel_tol=1e-7)


def test_lattice_without_training_or_rows(spark):
    out, s = lattice_lm.score_texts(docs(spark, [(1, "some words", None), (2, None, None)]), PATH, "false", keep=["doc_id"])
    got = {r["doc_id"]: r[s] for r in out.collect()}
    assert got[1]["train_tokens"] == got[1]["n_known"] == 0 and got[1]["base_score"] == 0 and got[2]["n_tokens"] == 1 and got[1]["score"] < got[2]["score"] < 0
    assert lattice_lm.score_texts(docs(spark, []), PATH, "true")[0].count() == 0


def test_lattice_query(spark, sf_dir):
    rows = queries.op11_lattice_lm(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1) and r["score"] < 0 and r["base_score"] < 0 for r in rows)


def test_lattice_fits_the_corpus(spark, sf_dir):
    """Fitted weights explain held-out texts better than the file's do."""
    held = lambda **k: lattice_lm.score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), PATH, "doc_id % 5 <> 1", keep=["doc_id"], **k)
    total = [df.filter("doc_id % 5 = 1").selectExpr(f"sum({s}.score)").head()[0] for df, s in (held(rounds=0), held())]
    assert total[1] > 0.9 * total[0] and total[1] > total[0]


# 12

VECTORS = "vec_id bigint, embedding array<float>, label int, code string, p int"


def by_sql(rows, **sizes):
    c = duckdb.connect()
    c.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    if rows:
        c.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    cursor = c.execute(vector_codes.oracle(**sizes))
    return counted(cursor.fetchall(), [d[0] for d in cursor.description])


def coded(spark, rows, **sizes):
    df, _ = vector_codes.encode_vectors(spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS).repartition(3), **sizes)
    return counted(df.collect(), df.columns)


@pytest.mark.parametrize("seed", range(3))
def test_vector_codes_are_a_full_search(spark, seed):
    rng = random.Random(seed)
    grid = [lambda: rng.gauss(0, 1), lambda: rng.randrange(-2, 3) / 256, lambda: rng.choice([-1000.0, 1e5, 0.0, 3.5])][seed]
    rows = [(i * 3, [grid() for _ in range(8)], rng.choice([None, 1, 2])) for i in range(400)]
    rows += [(5000, None, 1), (5001, [1.0] * 7 + [None], 1), (5002, [math.nan] * 8, 2), (5003, [math.inf] + [0.0] * 7, 2), *[(6000 + i, rows[0][1], 1) for i in range(150)]]
    sizes = {"parts": 4, "entries": 16, "rounds": 3}
    assert coded(spark, rows, **sizes) == by_sql(rows, **sizes)


def test_vector_codes_prune(spark):
    """Bounds leave most distances out, and only distances that can't matter."""
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(3000, 4)) * 256).astype(np.int64)
    entries = x[:32][None].copy()
    books = vector_codes.Codebooks(entries)
    code, upper, lower, _, first = vector_codes.assign(books, 0, x, None, None, None)
    after = vector_codes.Codebooks(np.stack([[x[code == e].sum(axis=0) // max(1, (code == e).sum()) for e in range(32)]]), entries)
    again, upper, lower, best, second = vector_codes.assign(after, 0, x, code, upper, lower)
    full = ((x[:, None] - after.entries[0][None]) ** 2).sum(axis=2)
    assert (again == full.argmin(axis=1)).all() and second < 0.35 * first
    assert (upper >= np.sqrt(full[np.arange(3000), again])).all() and (lower <= np.sqrt(full)).all()


def test_vector_codes_odd_tables(spark):
    empty = [(1, None, 1), (2, [math.nan] * 4, 1)]
    for rows in ([], empty):
        assert vector_codes.encode_vectors(spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS), parts=2)[0].count() == 0
    few = [(None, [1.0, 2.0, 3.0, 4.0], 1), (7, [0.5, 0.5, 0.25, 0.0], None), (7, [0.0, 0.5, 0.25, 0.0], None), (9, [1.0, 2.0], 1), (10, [], 1)]
    got, books = vector_codes.encode_vectors(spark.createDataFrame([(*r, "x", 1) for r in few], VECTORS), parts=2)
    rows = got.collect()
    assert books.shape == (2, 3, 2) and len(rows) == 3 and all(r["error"] == 0 for r in rows)
    big = [(i, [float(3e38 if i % 2 else -1e30), 1e12, 0.0, float(i)], 1) for i in range(6)]
    rows = vector_codes.encode_vectors(spark.createDataFrame([(*r, "x", 1) for r in big], VECTORS), parts=2, entries=2)[0].collect()
    assert len(rows) == 6 and all(len(r["code"]) == 4 for r in rows)


# 13


def sentences(rng, n, vocabulary=12):
    words = [f"w{k}" for k in range(vocabulary)] + ["Aa", "b\x01", "ß|", "x\x1cy", "．"]
    out = []
    for _ in range(n):
        out.append("".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"]) for _ in range(rng.randrange(0, 60))))
    return out + ["new york city of lights ." * 5] * 4


@pytest.mark.parametrize(("block", "ranged", "pending", "size"), [(1 << 16, 1 << 22, 1 << 21, 1 << 24), (7, 40, 50, 900), (3, 1 << 22, 20, 300)])
def test_collocations(spark, monkeypatch, block, ranged, pending, size):
    rng = random.Random(block)
    rows = [(i, t, rng.choice(["en", "de", None, "und"])) for i, t in enumerate([*sentences(rng, 120), *ODD, *ODD])]
    for name, value in (("BLOCK", block), ("RANGE", ranged), ("PENDING", pending), ("SHARD", size)):
        monkeypatch.setattr(collocations, name, value)
    for percent, least, top in ((100, 3, 2000), (60, 5, 9)):
        c = duckdb.connect()
        c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
        c.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
        df = collocations.mine_phrases(docs(spark, rows), least=least, percent=percent, top=top)
        assert_same(df, c, collocations.oracle(least=least, percent=percent, top=top))
        assert df.count() > 20


def test_ranges_are_even_where_shards_are_alike(spark):
    """The n-th blocks of all shards start at about the same path; no range may hold a block of each."""
    rng = np.random.default_rng(3)
    every, rows = [], []
    for _ in range(48):
        paths, counts = collocations.shard(rng.integers(1, 60, 6000).astype(np.uint32), 5, 6)
        every.append(paths)
        cut = [paths[s : s + 1500] for s in range(0, len(paths), 1500)]
        of = collocations.blocks([(p, counts[: len(p)]) for p in cut])
        rows += zip(*(c.to_pylist() for c in of.columns), [collocations.sampled(p, 1500 // collocations.SAMPLED) for p in cut], strict=True)
    at = collocations.limits(spark.createDataFrame(rows, collocations.WITH_SAMPLE), 24)
    cuts = np.array(at, dtype="S20")
    sizes = np.bincount(np.concatenate([np.searchsorted(cuts, collocations.binary(p), side="right") for p in every]))
    assert len(sizes) == 24 and sizes.max() < 1.5 * sizes.mean()


def test_collocations_trie_round_trip():
    rng = np.random.default_rng(3)
    seq = rng.integers(0, 6, 5000)
    paths, counts = collocations.shard(seq, 5, 3)
    assert counts.sum() == ((seq[:-1] > 0) & (seq[1:] > 0)).sum()
    back, again = collocations.read(collocations.serialised(paths, counts), 5)
    assert (back == paths).all() and (again == counts).all()
    assert [tuple(p) for p in paths.tolist()] == sorted({tuple(p) for p in paths.tolist()})
    assert collocations.binary(paths)[0] == struct.pack(">5I", *paths[0].tolist()).rstrip(b"\0")


def test_collocations_of_nothing(spark):
    assert collocations.mine_phrases(docs(spark, [])).count() == 0
    assert collocations.mine_phrases(docs(spark, [(1, None, "en"), (2, "a b c", None)])).count() == 0


def test_new_queries_equal_their_sql(spark, duck, sf_dir):
    for name in ("op12_vector_codes", "op13_collocations"):
        assert_same(queries.QUERIES[name](spark, sf_dir), duck, queries.ORACLE_SQL[name])
