"""The ten operators and the pipeline against brute-force versions, on small tables with odd rows."""

import hashlib
import random
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from memspark.llm import embedding_dedup, jaccard_join, language_id, line_dedup, packing, pii, quality, queries, sentencepiece_codec, substring_dedup, warc
from tests.compare import assert_same

from . import brute

ODD = [None, "", " ", "\n\n\n", "one", "a b", "😀 é　x", "word " * 400, "x" * 5000, "Zu\tund\x0bviel\n" * 30]
DOCS = "doc_id bigint, text string, lang string, quality int, kept string, n_words int"


def docs(spark, texts, start=0):
    """Documents with columns whose names clash with results."""
    return spark.createDataFrame([(start + i, t, "en", 1, "x", 7) for i, t in enumerate(texts)], DOCS).repartition(3)


def near_copies(seed, n_bases=25, sizes=(3, 8, 12, 20, 36, 60, 120, 300)):
    """Texts in groups of copies with a few words changed, dropped or added."""
    rng, out = random.Random(seed), []
    for _ in range(n_bases):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice(sizes))]
        for _ in range(rng.choice([1, 2, 4, 20])):
            w = list(base)
            for _ in range(rng.randrange(0, 2 + len(w) // 25)):
                at = rng.randrange(len(w))
                change = rng.random()
                w[at : at + 1] = [] if change < 0.3 else [f"w{rng.randrange(300)}"] if change < 0.7 else [w[at], "new"]
                if not w:
                    break
            out.append(" ".join(w))
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(120).select("text").collect()]


# 4


def plain_quality(text):
    text = text or ""
    words = brute.WORD.findall(text)
    lines = [x for x in text.split("\n") if brute.WORD.search(x)]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {g for g in grams if grams.count(g) > 1}
    repeat = {k for i, g in enumerate(grams) if g in twice for k in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeat)


def test_quality(spark, texts):
    every = [*texts[:60], *ODD]
    out, q = quality.quality_rules(docs(spark, every))
    assert set(docs(spark, []).columns) <= set(out.columns)
    for r in out.select("doc_id", f"{q}.*").collect():
        want = plain_quality(every[r["doc_id"]])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r["base_failed"] and r["kept"])


def test_quality_rejects_noise_and_keeps_prose(spark, texts):
    rng = random.Random(1)
    noise = " ".join("".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(9)) for _ in range(300))
    prose = max((t for t in texts if t), key=lambda t: len(set(t.split())))
    out, q = quality.quality_rules(docs(spark, [noise, "same words again " * 500, prose]))
    kept = {r["doc_id"]: r["k"] for r in out.select("doc_id", F.col(f"{q}.kept").alias("k")).collect()}
    assert kept == {0: False, 1: False, 2: True}
    assert quality.quality_rules(docs(spark, []))[0].count() == 0


# 10


def test_sentencepiece_is_the_librarys(spark, texts):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = [*texts[:40], *ODD, " lead", "trail  ", "a▁b ▁ c", "<s> </s>", "\x00 tab\t", "é ​"]
    out, p = sentencepiece_codec.encode_texts(docs(spark, every), path)
    for r in out.select("doc_id", f"{p}.*").collect():
        ids = model.encode(every[r["doc_id"]] or "")
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(model.decode(ids).encode()).hexdigest()
    back = sentencepiece_codec.decode_ids(out.select("doc_id", f"{p}.ids"), path).collect()
    assert all(r["text"] == model.decode(model.encode(every[r["doc_id"]] or "")) for r in back)


def test_sentencepiece_odd_tables(spark, monkeypatch):
    """Slices of few texts, repeated rows, a clashing struct name, rows that differ between the readings, an empty table."""
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    monkeypatch.setattr(sentencepiece_codec, "SLICE_CHARS", 50)
    rows = [(i, t, "p") for i, t in enumerate([*ODD, "a\n b", "a\n\n  b\n", *ODD])]
    df = spark.createDataFrame([*rows, *rows[:4]], "doc_id bigint, text string, pieces string")
    for some in (df.repartition(3), df.select("doc_id", F.concat("text", F.rand().cast("string")).alias("text"), "pieces")):
        out, p = sentencepiece_codec.encode_texts(some, path)
        got = out.select("*", f"{p}.*").collect()
        assert p != "pieces" and all(r["pieces"] == "p" for r in got) and len(got) == len(rows) + 4
        assert all(r["ids"] == model.encode(r["text"] or "") for r in got)
    assert sentencepiece_codec.encode_texts(df.limit(0), path)[0].count() == 0


# 5


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    every = [*texts, *ODD, "<|endoftext|> in text"]
    rows = packing.pack_documents(docs(spark, every), path, ids=True).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
        assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r["ids"]))
    for i, t in enumerate(every):
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        assert [x for r in pieces for x in r["ids"]] == ids and all(r["length"] == 1024 for r in pieces[1:])
        assert [r["start"] for r in pieces] == [sum(p["length"] for p in pieces[:k]) for k in range(len(pieces))]
    for s in by_seq.values():
        s.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in s] == [sum(x["length"] for x in s[:k]) for k in range(len(s))] and sum(r["length"] for r in s) <= 1024
    assert len(by_seq) <= -(-sum(r["length"] for r in rows) // 1024) * 1.03 + 1
    assert packing.pack_documents(docs(spark, []), path).count() == 0


def test_plan_holds_every_item_once():
    import numpy as np

    rng = np.random.default_rng(3)
    for most in (1, 5, 5000):
        counts = rng.integers(0, most + 1, 65)
        counts[0] = 0
        runs = packing.solve(counts, 64)
        held = np.zeros(65, dtype=np.int64)
        for k, config in runs:
            assert sum(config) <= 64
            np.add.at(held, list(config), k)
        assert (held == counts).all()
        assert sum(k for k, _ in runs) <= least_bins(counts, 64) * 1.02 + 2


def least_bins(counts, capacity):
    """A lower bound (Martello and Toth's L2): large items stand alone, middle ones leave only so much room."""
    import numpy as np

    size, best = np.arange(len(counts)), 0
    for k in range(capacity // 2 + 1):
        alone, middle, small = size > capacity - k, (size > capacity // 2) & (size <= capacity - k), (size >= k) & (size <= capacity // 2)
        room = counts[middle].sum() * capacity - (counts * size)[middle].sum()
        best = max(best, counts[alone].sum() + counts[middle].sum() + max(0, -(-((counts * size)[small].sum() - room) // capacity)))
    return best


# 6


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_jaccard_join(spark, monkeypatch, width, percent):
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)  # several blocks a group
    monkeypatch.setattr(jaccard_join, "SKETCH_BLOCK", 16)
    every = [*near_copies(width), *ODD, "one", "ONE"]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_components(docs(spark, every), width, percent).collect()}
    assert got == brute.jaccard_components(list(enumerate(every)), width, percent)


def test_jaccard_join_odd_tables(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (1, "q r s t u v"), (2, "q r s t u v")]
    got = jaccard_join.similar_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in got) == [(0, 2, 0), (1, 2, 1), (1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert jaccard_join.similar_components(docs(spark, [])).count() == 0


def test_signatures_meet():
    """Sets as similar as asked share a signature, at every size."""
    import numpy as np

    rng = np.random.default_rng(5)
    for num, den in ((9, 10), (8, 10)):
        for size in [*range(1, 60), 99, 250, 1000, 3000]:
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
            b = a
            while den * len(np.intersect1d(a, np.delete(b, 0))) >= num * len(np.union1d(a, np.delete(b, 0))):
                b = np.delete(b, rng.integers(len(b)))
                extra = np.append(b, rng.integers(0, 1 << 63, 1, dtype=np.uint64))
                if den * len(np.intersect1d(a, extra)) >= num * len(np.union1d(a, extra)):
                    b = np.sort(extra)
            at, sig, own = jaccard_join.signatures([a, b], num, den)
            assert set(sig[at == 0]) & set(sig[at == 1]), (num, size, len(b))


# 2


@pytest.mark.parametrize("hot", [512, 1])
def test_substring_dedup(spark, texts, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    long = " ".join(f"v{i}" for i in range(60))
    every = [*texts, *near_copies(9), *ODD, long, "x " + long + " y", long + " " + long]
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.dedup_substrings(docs(spark, every)).collect())
    assert got == sorted(brute.substring_dedup(list(enumerate(every))))
    spans = substring_dedup.repeated_spans(docs(spark, [long, "x " + long, "no"])).collect()
    assert sorted((r["doc_id"], r["start_word"], r["n_words"]) for r in spans) == [(0, 0, 60), (1, 1, 60)] and len({r["path"] for r in spans}) == 1


@pytest.mark.parametrize("batch", [1, 10000])
@pytest.mark.parametrize("hot", [512, 2, 0])
def test_substring_paths_are_cut_alike_in_all_copies(spark, monkeypatch, batch, hot):
    """Copies that one batch has combined, or whose anchors are split, see the branches of copies elsewhere."""
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    p, q = (" ".join(f"{c}{i}" for i in range(80)) for c in "pq")
    every = [p, "x " + p, p + " y", p, q, p + " " + q, "z " + " ".join(q.split()[20:]) + " w", p, q]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        spans = substring_dedup.repeated_spans(docs(spark, every)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {}
    for r in spans:
        got.setdefault(r["path"], set()).add((r["doc_id"], r["start_word"], r["n_words"]))
    # q's first edge before the shorter copy, and the rest, are two paths; p is one, wherever it stands.
    assert sorted(map(sorted, got.values())) == [
        [(0, 0, 80), (1, 1, 80), (2, 0, 80), (3, 0, 80), (5, 0, 80), (7, 0, 80)],
        [(4, 0, 54), (5, 80, 54), (8, 0, 54)],
        [(4, 20, 60), (5, 100, 60), (6, 1, 60), (8, 20, 60)],
    ]


def test_substring_walks_without_a_second_place_are_refuted(spark):
    rows = [(1, 7, 0, 40, b"a"), (2, 8, 3, 40, b"a"), (1, 7, 50, 35, b"b"), (1, 7, 90, 35, b"c"), (5, 9, 0, 35, b"d"), (5, 9, 0, 35, b"d")]
    got = substring_dedup.refuted(spark.createDataFrame(rows, "id bigint, tk bigint, start bigint, n_words bigint, path binary")).collect()
    assert [(r["id"], r["tk"], sorted(r["wrong"])) for r in got] == [(1, 7, [50, 90])]


def test_rows_without_ids_whose_texts_share_a_32_bit_hash(spark):
    shared = " ".join(f"w{i}" for i in range(70))
    many = spark.range(200_000).select(F.concat(F.lit("v"), F.col("id").cast("string"), F.lit(" " + shared)).alias("text"))
    alike = many.groupBy(F.hash("text").alias("h")).agg(F.collect_list("text").alias("t"), F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy("h").head()["t"][:2]
    rows = spark.createDataFrame([(None, t) for t in alike], "doc_id bigint, text string")
    got = substring_dedup.dedup_substrings(rows).collect()
    assert sorted(r["kept_text"] for r in got) == sorted(t.split()[0] for t in alike) and all(r["n_removed"] == 70 for r in got)


def test_substring_dedup_odd_tables(spark):
    long = " ".join(f"v{i}" for i in range(50))
    rows = [(None, long), (None, long), (3, "q " * 40), (3, "q " * 40), (4, long + " z")]
    got = substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in got) == [(0, 50, 50), (0, 50, 50), (3, 40, 40), (3, 40, 40), (4, 51, 50)]
    assert substring_dedup.dedup_substrings(docs(spark, [])).count() == 0


@pytest.mark.parametrize("hot", [512, 0])
def test_substring_dedup_of_a_table_met_twice(spark, monkeypatch, hot):
    """Equal rows in several partitions, each with copies beside it: no place of a combined row is lost."""
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    long = " ".join(f"v{i}" for i in range(50))
    some = docs(spark, [long, "x " + long, long + " z", long]).coalesce(1)
    got = substring_dedup.dedup_substrings(some.unionByName(some).unionByName(some)).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in got) == sorted([(0, 50, 50), (1, 51, 51), (2, 51, 51), (3, 50, 50)] * 3)


# 7


def test_embeddings(spark):
    rng = random.Random(2)
    rows = []
    for g in range(12):
        base = [rng.gauss(0, 1) for _ in range(32)]
        for _ in range(rng.choice([1, 3, 30])):
            rows.append((len(rows), [x + rng.gauss(0, 0.3) for x in base], g % 3))
    rows += [(900, None, 1), (901, [0.0] * 32, 1), (902, [1.0] * 31 + [None], 1), (903, [1.0] * 31 + [float("nan")], 1), (904, [1.0] * 31 + [float("inf")], 1), (905, [1.0] * 32, None), (906, [1.0] * 8, 1), (907, [1.0] * 8, 1), (908, [2.0] * 8, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, n_links string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df).collect()}
    stored = {r["vec_id"]: r["embedding"] for r in df.collect()}
    assert got == brute.near_vectors([(i, stored[i], lab) for i, _, lab in rows])
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_odd_rows(spark, monkeypatch):
    """Huge and tiny components, repeated ids with other vectors, null ids, blocks of few vectors, ties of one label only."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 4)
    rows = [(1, [1e200, 0.0], 1), (2, [1e200, 1.0], 1), (3, [1e-170, 0.0], 1), (4, [0.0, 1e-310], 1), (5, [0.0, 2.0], 1), (6, [1e200, 0.0], 2), (7, [3.0, 3.0], 1), (8, [-1e308, -1e308], 1)]
    rng = random.Random(4)
    base = [rng.gauss(0, 1) for _ in range(2)]
    rows += [(20 + i, [x + rng.gauss(0, 0.2) for x in base], 3) for i in range(90)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()}
    scaled = [(i, [x / max(map(abs, v)) for x in v], lab) for i, v, lab in rows]
    assert got == brute.near_vectors(scaled) and got[1] == (2, 1) and got[4] == (1, 4)
    rows = [(5, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (3, [1.0, 0.01], 1), (9, [0.01, 1.0], 1), (9, [0.01, 1.0], 1), (None, [1.0, 0.0], 1), (4, [1.0, 1.0, 1.0], 1)]
    out = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"] or False) for r in out)
    assert got == [(0, 0, 0, False), (3, 1, 3, True), (4, 0, 4, True), (5, 1, 3, False), (5, 2, 3, False), (9, 2, 3, False), (9, 2, 3, False)]


def test_estimates_are_unbiased_and_bounded():
    import numpy as np

    rng = np.random.default_rng(1)
    u = embedding_dedup.unit(rng.standard_normal((400, 64)))
    est, error = embedding_dedup.Coded(u).estimate(embedding_dedup.Coded(u))
    off = est - u @ u.T
    np.fill_diagonal(off, 0)
    assert abs(off.mean()) < 0.005 and (np.abs(off) > error[:, None]).mean() < 0.005


# 8


def test_warc(spark, tmp_path):
    rows = [(i, f"http://h/{i % 7}\r\nx", "p" * (i % 5) if i % 3 else f"page {i} é") for i in range(200)] + [(None, "u", "p"), (300, None, None), (301, "u", None), (5, "again", "pppp"), (5, "again", "pppp")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, record_type int").repartition(4)
    want = sorted((-1 if r[0] is None else r[0], (r[2] or "").encode()) for r in rows)
    seen = []
    for n, parts in enumerate((4, 2)):
        folder = f"file://{tmp_path}/w{n}"
        manifest = warc.write_warc(df.repartition(parts), folder, roll_bytes=4000, shard_bytes=300)
        back = warc.read_warc(manifest, folder).collect()
        last = {}
        for i, body in want:
            if i >= 0:
                last[body] = max(last.get(body, -1), i)
        for r in back:
            body = next(b for i, b in want if i == (r["page_id"] if r["page_id"] is not None else -1) and warc.digest(b) == r["payload_digest"])
            assert r["payload_bytes"] == len(body)
            first = r["page_id"] is None or r["page_id"] == last[body]
            assert (r["record_type"], r["refers_to"]) == (("response", None) if first else ("revisit", last[body]))
            assert r["payload"] is None or bytes(r["payload"]) == body
        assert sorted(r["page_id"] if r["page_id"] is not None else -1 for r in back) == [i for i, _ in want]
        seen.append(sorted((r["file"], r["sha256"], r["records"]) for r in manifest.collect()))
        assert len(seen[-1]) > 3
    assert seen[0] == seen[1]  # the files depend on the rows only
    empty = f"file://{tmp_path}/none"
    assert warc.read_warc(warc.write_warc(df.limit(0), empty), empty).count() == 0


def test_warc_shards_are_quantiles(spark):
    """One far-off id, or a range at the ends of 64 bits, leaves the shards as they are."""
    ids = spark.range(2000).select(F.col("id").alias("page_id"), F.lit(100).cast("long").alias("n_bytes"))
    far = lambda *x: ids.unionByName(spark.createDataFrame([(i, 100) for i in x], "page_id long, n_bytes long"))
    plain = warc.shard_starts(ids, 10_000)
    assert len(plain) == 20 and plain[0] == 0
    assert all(20 <= len(warc.shard_starts(far(*x), 10_000)) <= 24 for x in ([1 << 62], [-(1 << 63), (1 << 63) - 1]))
    assert warc.shard_starts(ids.limit(0), 10) == [0]


# 9


def test_line_dedup_odd_rows(spark):
    a = "l1\nl2\nl3\nl4"
    rows = [(1, a), (2, "x\n" + a + "\ny"), (2, "x\n" + a + "\ny"), (3, "l1\n\nl2\n \nl3"), (None, a), (5, None), (6, ""), (7, "z\n" * 5)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id bigint, text string, n_lines int").repartition(3)
    out = line_dedup.dedup_lines(df)
    got = sorted((r["doc_id"] or 0, r["text"], r["_n_lines"], r["n_removed"]) for r in out.collect() if r["text"] is not None)
    assert got == sorted([(0, a, 4, 0), (1, "", 4, 4), (2, "x\ny", 6, 4), (2, "x\ny", 6, 4), (3, "\n ", 5, 3), (6, "", 1, 0), (7, "z\n", 6, 4)])
    assert out.filter("doc_id = 5").head()["text"] is None
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_frees_its_names(spark):
    rows = [(i, "a1\nb1\nc1", "x", i, "y", "z") for i in range(2)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, _lines string, _gone long, _gone_id string, _stay string"))
    got = sorted(tuple(r[c] for c in ("doc_id", "text", "_lines", "_gone", "_gone_id", "_stay", "n_removed")) for r in out.collect())
    assert got == [(0, "a1\nb1\nc1", "x", 0, "y", "z", 0), (1, "", "x", 1, "y", "z", 3)]


# 1


def test_personal_data(spark, texts):
    rng = random.Random(3)
    parts = [*("0123456789" * 3), *"ab.@ -+()%_,\n", "é", "😀", ".1", "4111 1111 1111 1111", "+1 (234) 555-1234", "x@y.zz", "1.2.3.4", "255."]
    every = [*("".join(rng.choice(parts) for _ in range(rng.randrange(0, 60))) for _ in range(500)), *texts, *ODD]
    out, n = pii.find_personal_data(docs(spark, every))
    kinds = list(pii.PATTERNS)
    for r in out.collect():
        spans = brute.personal_data(every[r["doc_id"]])
        want = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)
        assert r[n["base_sha256"]] == hashlib.sha256(want.encode()).hexdigest()
        assert [r[n[f"n_{k}"]] for k in kinds] == [sum(s[1] == i for s in spans) for i in range(4)]
        assert set(want.split(",")) <= set(r[n["spans"]].split(",")) or not want
        if every[r["doc_id"]] is None:
            assert r[n["sanitised"]] is None
    assert pii.find_personal_data(docs(spark, []))[0].count() == 0


def test_terms_are_those_of_brute_force(spark, sf_dir):
    """Smoothed PMI over all documents, and over texts that share values and words."""
    rng = random.Random(8)
    shared = [" ".join([*rng.sample([f"name{i}" for i in range(12)], 3), *rng.sample([f"pad{i}" for i in range(90)], 12), *rng.sample(["a@b.cc", "9.8.7.6", "+1 234 555 1234", "Q@b.cc", "", ""], 2)]) for _ in range(60)]
    plain = [" ".join(rng.sample([f"pad{i}" for i in range(90)], 9)) for _ in range(1500)]
    every = [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    for some in ([*shared, *plain, *shared[:9], *ODD], every):
        out, n = pii.find_personal_data(docs(spark, some))
        want = brute.term_spans(some)
        found = 0
        for r in out.collect():
            terms = [tuple(map(int, x.split(":")[1:])) for x in r[n["spans"]].split(",") if x.startswith("term:")]
            assert terms == want[some[r["doc_id"]] or ""], r["doc_id"]
            found += len(terms)
        assert found > 10 or some is every


def test_internal_names_are_free(spark):
    rows = [(1, "mail a@b.cc now", "x", "y", 5), (2, None, "z", None, 6)]
    out, n = pii.find_personal_data(spark.createDataFrame(rows, "_id long, text string, _text string, _spans string, _key int"))
    got = sorted(tuple(r[c] for c in ("_id", "text", "_text", "_spans", "_key")) for r in out.collect())
    assert got == rows and [r[n["n_email"]] for r in out.orderBy("_id").collect()] == [1, 0]


def test_terms_that_disclose(spark):
    told = [f"pad {i} words the man Moriarty wrote from m@x.org about case{i} and more{i}" for i in range(6)]
    clean = [f"clean{i} text about the man and what wrote words from pad" for i in range(200)]
    out, n = pii.find_personal_data(docs(spark, [*told, *clean, "Only Moriarty here"]))
    rows = {r["doc_id"]: r for r in out.collect()}
    assert all("term" in rows[i][n["spans"]] and "Moriarty" not in rows[i][n["sanitised"]] for i in range(6))
    assert "Moriarty" not in rows[206][n["sanitised"]] and rows[206][n["sanitised"]].startswith("Only ")
    assert all(rows[i][n["spans"]] == "" and rows[i][n["sanitised"]] == clean[i - 6] for i in range(6, 206))


@pytest.mark.parametrize("n_clean", [100, 2000])
def test_one_meeting_tells_nothing_and_owners_stand_for_values_of_one_text(spark, n_clean):
    """However large the corpus, a word met once with a value stays; a word that goes with a domain, network or area goes, anywhere in its texts."""
    far = "the man wrote words " * 60
    once = [f"Watson {far} w@alone.org"]
    owned = [f"Moriarty {far} m{i}@x.org" for i in range(3)] + [f"Lestrade {far} 10.1.2.{i}" for i in range(3)] + [f"Adler {far} +1 (234) 555-{i:04}" for i in range(3)]
    clean = [f"clean{i} text the man wrote words" for i in range(n_clean)]
    rows = [*once, *owned, *clean]
    out, n = pii.find_personal_data(docs(spark, rows))
    got = {r["doc_id"]: r[n["sanitised"]] for r in out.collect()}
    assert got[0] == f"Watson {far} [EMAIL]"
    assert [got[i] for i in range(1, 10)] == [f"[NAME] {far} [{kind}]" for kind in ("EMAIL", "IP", "PHONE") for _ in range(3)]
    assert all(got[i] == rows[i] for i in range(10, len(rows)))


def test_planted_terms_are_caught_and_clean_words_stay(spark, sf_dir):
    """Names planted beside addresses of one domain in the documents are found; of other words one in 1,000 at most is lost."""
    every = [r[0] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    planted = [f"{t} Zqname{i % 5} zq{i}@owner{i % 5}.net" if i < 20 else t for i, t in enumerate(every)]
    out, n = pii.find_personal_data(docs(spark, planted))
    got = {r["doc_id"]: r[n["sanitised"]] for r in out.collect()}
    assert all("Zqname" not in (got[i] or "") for i in range(20))
    spans = brute.term_spans(planted)
    lost = sum(len(spans[t]) for t in planted) - 20
    assert 0 <= lost <= sum(len(t.split()) for t in every) / 1000


def test_copies_do_not_hide_terms(spark):
    """Copies of the texts of a value count once for the value, the term and the corpus."""
    told = [f"Moriarty wrote words {i} m@x.org" for i in range(3)] * 30
    clean = [f"clean{i} text the man wrote words" for i in range(300)]
    out, n = pii.find_personal_data(docs(spark, [*told, *clean]))
    got = {r["doc_id"]: r[n["sanitised"]] for r in out.collect()}
    assert all(got[i] == f"[NAME] wrote words {i % 3} [EMAIL]" for i in range(90))
    assert all(got[90 + i] == clean[i] for i in range(300))


# 3


def test_language(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op3_language_id(spark, sf_dir).collect()}
    want = {r["doc_id"]: r["lang"] for r in d.collect()}
    out_of = [i for i in want if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sorted(i for i in got if got[i]["held_out"]) == sorted(out_of)
    assert sum(got[i]["lang_pred"] == want[i] for i in out_of) >= 0.97 * len(out_of)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_odd_rows(spark, texts):
    train = spark.createDataFrame([(i, t, "en" if i % 2 else "fr") for i, t in enumerate(["le chat est la", "the dog is here"] * 20)] + [(None, "x", "de"), (90, None, "de"), (91, "y", None)], "id bigint, text string, lang string")
    model = language_id.fit(train)
    assert model.langs == ["en", "fr"]
    out, name = language_id.identify(docs(spark, [*ODD, "123 !", "the dog", "le chat"]), model)
    got = {r["doc_id"]: (r["p"], r["s"]) for r in out.select("doc_id", F.col(f"{name}.lang_pred").alias("p"), F.col(f"{name}.score").alias("s")).collect()}
    assert all(got[i] == ("und", 0.0) for i in (0, 1, 2, 3, 10))
    assert got[11][0] == "en" and got[12][0] == "fr"
    assert language_id.fit(train.limit(0)).predict("the dog") == ("und", 0.0)


# registered queries and the pipeline


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(name, spark, duck, sf_dir):
    assert_same(queries.QUERIES[name](spark, sf_dir), duck, queries.ORACLE_SQL[name])


def test_pipeline(spark, sf_dir):
    """Every stage of the pipeline from plain versions of its operator, on all that the stage before it kept."""
    import corpus_pipeline as p

    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    now = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for name, stage in p.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in now.collect()}
        now = p.written(stage(spark, now, sf_dir), "test")
        assert now.columns == columns
        kept[name] = (before, {r["doc_id"]: r["text"] for r in now.collect()})
        assert all(len(r["text"]) == r["n_chars"] for r in now.collect())
    before, after = kept["quality rules"]
    bad = {i for i, t in before.items() if (m := plain_quality(t))[0] < 20 or 100 * m[4] > 30 * m[0]}
    assert not bad & set(after) and all(after[i] == before[i] for i in after) and len(after) > 0.7 * (len(before) - len(bad))
    before, after = kept["line dedup"]
    assert set(before) == set(after) and any(after[i] != before[i] for i in after)
    before, after = kept["n-gram Jaccard join"]
    found = brute.jaccard_components(list(before.items()), 5, 80)
    assert set(after) == {i for i, (_, c) in found.items() if c == i}
    before, after = kept["PII"]
    assert set(before) == set(after)
    for i, t in before.items():
        if not brute.personal_data(t):
            assert after[i] == t
    pieces = p.STAGES[-1][1](spark, now, sf_dir).collect()
    assert {r["doc_id"] for r in pieces} == set(after)
    key = lambda r: (r["doc_id"], r["piece"], r["length"], r["ids_crc32"])
    assert sorted(map(key, pieces)) == sorted(map(key, p.run(spark, sf_dir).collect()))
