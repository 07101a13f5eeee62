"""Stored postings, the index kept in parts, and what a session reads from them, against full builds and plain searches."""

import json
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from memspark import session as S
from memspark.config import Config, merged
from memspark.operators import graph, index, keyword, lists, postings, vector
from memspark.sources import models, state
from memspark.storage import read_text, write_text
from tests.test_notes import BASE, PUMP, rows_of


def found(df):
    return sorted((r["query_id"], r["passage_id"], r["rank"], round(r["score"], 6)) for r in df.collect())


def test_stored_search_is_the_plain_one(spark, tmp_path):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(words[min(59, int(rng.expovariate(0.08)))] for _ in range(n))
    rows = [(f"p{i:03}", rng.choice([text(rng.randrange(40)), None, ""]), text(3)) for i in range(300)] + [("same-a", "w1 w2 w2", "w50"), ("same-b", "w1 w2 w2", "w50")]
    p = spark.createDataFrame(rows, "passage_id string, text string, title string")
    q = spark.createDataFrame([(i, text(rng.randrange(1, 9))) for i in range(25)] + [(90, "nowhere"), (91, ""), (92, "w1 w2 w50")], "query_id int, text string")
    for fields, stem in (({"text": 1.0}, False), ({"title": 2.0, "text": 1.0}, False), ({"text": 1.0}, True)):
        path = f"file://{tmp_path}/{len(fields)}{stem}"
        held = postings.build(p, path, fields, stem, block=4, salt_posts=30, bucket_posts=200)
        assert held.buckets > 1 and postings.opened(spark, path) == held and held.posts(spark).filter("block > 2").count() > 0
        for limit in (1, 5):
            assert found(postings.search(held, q, limit)) == found(keyword.bm25_search(q, p, limit, fields, stem))
    assert found(postings.overlap(held, q, 5)) == found(keyword.overlap_search(q, p, 5))
    parts = postings.parts_of(held, postings.asked_terms(held, q), 1)
    assert {r["opens"] for r in parts.select("opens").distinct().collect()} == {True, False}  # some terms bring no passage
    nothing = postings.build(p.limit(0), f"file://{tmp_path}/none")
    assert postings.search(nothing, q, 5).count() == 0 and postings.search(held, q.limit(0), 5).count() == 0


def test_pairs_move_no_vectors(spark):
    """Each list meets each other one; vectors are written once and not shuffled for every pair of lists."""
    rng = np.random.default_rng(4)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(120, 4)))], "id int, vector array<double>")
    pairs = lists.similar_pairs(lists.build(table), spark, 0.4)
    assert "vector" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    x = np.array([r["vector"] for r in table.orderBy("id").collect()])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == set(zip(*np.nonzero(np.triu(x @ x.T >= 0.4, 1)), strict=True))


def test_overlap_sends_few_rows(spark, monkeypatch):
    """Every passage holds a word of every query: what leaves a batch is bounded by the queries, and ties go by id over batches."""
    monkeypatch.setattr(keyword, "COUNTED", 7)
    monkeypatch.setattr(keyword, "QUERY_BLOCK", 3)
    rng = random.Random(8)
    texts = {f"p{i:03}": ["common", *(f"w{rng.randrange(5)}" for _ in range(rng.randrange(4)))] for i in range(200)}
    asked = {q: {"common", f"w{q % 5}", f"w{q * 3 % 5}", "nowhere"} for q in range(8)}
    p = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()] + [("none", None)], "passage_id string, text string").repartition(3)
    q = spark.createDataFrame([(k, " ".join(sorted(v))) for k, v in asked.items()] + [(99, "")], "query_id int, text string")
    want = {(k, i, n + 1) for k, t in asked.items() for n, (_, i) in enumerate(sorted((-len(t & set(v)), i) for i, v in texts.items())[:4])}
    assert {(r["query_id"], r["passage_id"], r["rank"]) for r in keyword.overlap_search(q, p, 4).collect()} == want
    batch = pa.RecordBatch.from_arrays([pa.array(list(texts)), pa.array([list(set(v)) for v in texts.values()])], names=["passage_id", "t"])
    out = list(keyword.counting([1], {"common": [0]}, 4, [pa.int32(), pa.string()])(iter([batch, batch])))
    assert sum(b.num_rows for b in out) <= 4 * 2 * -(-len(texts) // 7)


def test_a_chunk_meets_its_queries_in_small_products(spark, monkeypatch):
    """A block of 4,096 queries and a chunk of 16,384 vectors would be a product of half a gigabyte."""
    assert lists.CHUNK * lists.ROWS * 8 <= 1 << 26
    monkeypatch.setattr(lists, "ROWS", 3)
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)]
    table = spark.createDataFrame(rows, "id int, vector array<float>")
    asked = table.filter("id < 20").withColumnRenamed("id", "query_id")
    plain = lambda df: sorted((r["query_id"], r["rank"], r["id"]) for r in df.collect())
    assert plain(lists.search(lists.build(table), asked, 5)) == plain(vector.top_cosine(asked, table, 5))


def test_a_scope_is_worked_out_for_its_hits(spark):
    nodes = spark.createDataFrame([("d1", "note", None, "a", ["en"]), ("d1#0", "passage", "d1", "a", ["en"]), ("d1#1", "passage", "d1", "a", ["en"]), ("d2", "note", None, "b", ["fr"]), ("d2#0", "passage", "d2", "b", ["fr"])], "id string, kind string, note_id string, path string, tags array<string>")
    among = spark.createDataFrame([("d1#1",), ("d2#0",), ("d2#0",), ("gone",)], "id string")
    for scope, want in (("tag:en", ["d1#1"]), ("tag:fr", ["d2#0"]), ("tag:de", []), ("a", ["d1#1"])):
        assert [r["id"] for r in graph.scope_ids(nodes, scope, among=among).collect()] == want


def test_the_index_is_updated_in_place(spark, tmp_path):
    root, store = tmp_path / "v", f"file://{tmp_path}/store"
    extra = [(f"entities/n{i}.md", f"---\ntype: entity\nid: n{i}\n---\n# N{i}\nSee [[n{(i + 1) % 12}]].\n", 1) for i in range(12)]
    for path, text, _ in [*BASE, *extra]:
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    open_ = lambda **k: S.MemorySession.open(spark, str(root), store=store, **k)
    pointer = lambda: json.loads((tmp_path / "store" / "index.json").read_text())
    one = open_()
    q = one.queries("pump sensors", "see n3")
    first = one.recall(q, mode="typed", now=1_790_000_000_000).count()
    assert first and one.recall(q, mode="typed", now=1_790_000_000_000).count() == first and one.graphs.built == 1
    assert open_().version == "1"  # nothing is read or written again
    again = open_()
    assert again.recall(q, mode="typed", now=1_790_000_000_000).count() == first and again.graphs.built == 0 and again.postings().path.endswith("postings/v1")
    before = pointer()["tables"]
    (root / "entities/pump.md").write_text(PUMP + "\n[[n3]]\n")  # changed
    (root / "entities/n5.md").rename(root / "entities/n5b.md")  # renamed: its id stays, its path doesn't
    (root / "entities/n7.md").unlink()  # removed: links to it lose their note
    (root / "entities/new.md").write_text("---\ntype: entity\nid: new\n---\n# New\n[[pump]] [[n7]]\n")  # added
    two = open_()
    after = pointer()["tables"]
    assert two.version == "2"
    kept = {t: sum(after[t]["parts"].get(k) == v for k, v in before[t]["parts"].items()) for t in ("nodes", "edges", "notes")}
    assert all(kept[t] > 0 for t in kept) and any(v[0] == 1 for v in after["nodes"]["parts"].values())
    full = index.build(two.notes, Config())
    stored = state.open_index(spark, store, Config())
    assert rows_of(stored) == rows_of(full)
    assert two.recall(q, mode="typed", now=1_790_000_000_000).count() and two.graphs.built == 1 and two.postings().path.endswith("postings/v2")
    assert one.nodes.count() > 0  # a session that was opened before can go on reading


def test_a_lost_write_leaves_the_version_before(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}"
    cfg = Config()
    state.store_index({"nodes": spark.range(5)}, root, cfg)

    def lost(*a):
        raise OSError("gone")

    monkeypatch.setattr(state, "write_text", lost)
    for _ in range(2):
        try:
            state.store_index({"nodes": spark.range(9)}, root, cfg)
        except OSError:
            pass
    monkeypatch.undo()
    assert state.open_index(spark, root, cfg)["nodes"].count() == 5 and state.index_version(spark, root) == "1"
    assert state.store_index({"nodes": spark.range(9)}, root, cfg)["nodes"] > 0 and state.open_index(spark, root, cfg)["nodes"].count() == 9
    for i in range(3):  # never a moment without a pointer
        write_text(spark, f"{root}/p.json", str(i))
        assert read_text(spark, f"{root}/p.json") == str(i)
    assert [p.name for p in tmp_path.iterdir() if p.name.endswith(".tmp")] == []


def test_recognition_is_a_list_of_seeds(spark):
    nodes = [(f"n#{i}", "passage", "n", f"text {i}", None, None) for i in range(4)]
    frame = spark.createDataFrame(nodes, "id string, kind string, note_type string, text string, title string, heading string")
    vectors = spark.createDataFrame([(f"n#{i}", [1.0, i / 10]) for i in range(4)], "id string, vector array<double>")
    triples = spark.createDataFrame([("n#0", "pump", "feeds", "field"), ("n#1", "cat", "eats", "fish"), ("n#2", "pump", "has", "valve"), ("n#9", "pump", "is", "old")], "passage_id string, subject string, predicate string, object string")
    names = spark.createDataFrame([], "name string, node_id string, tier int")
    cfg = merged(Config(), {"graph": {"recognition": {"enabled": True}}})
    s = S.MemorySession(spark, frame, None, names, cfg, vectors=vectors, triples=triples, verifier=models.WordJudge)
    q = spark.createDataFrame([(1, "which pump feeds the field", [1.0, 0.0])], "query_id int, text string, vector array<double>")
    seeds, _ = s.seeds(q)
    got = {r["node"]: r["value"] for r in seeds.collect()}
    # cosine ranks 0, 1, 2, 3; the judge is sure of n#0 (1), half sure of n#2 (0.75), and turns n#1 down
    want = {"n#0": 2 / 61, "n#1": 1 / 62, "n#2": 1 / 63 + 1 / 62, "n#3": 1 / 64}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    off = S.MemorySession(spark, frame, None, names, Config(), vectors=vectors, triples=triples, verifier=models.WordJudge)
    assert abs({r["node"]: r["value"] for r in off.seeds(q)[0].collect()}["n#0"] - 1 / 61) < 1e-12


def test_vector_lists(spark, tmp_path, sf_dir, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 900)] + 0.35 * rng.normal(size=(900, 16))
    x[300:600] = x[0]  # a third of all rows in one list
    rows = [(f"v{i:04}", [float(c) for c in v]) for i, v in enumerate(x)] + [("none", None), ("zero", [0.0] * 16)]
    table = spark.createDataFrame(rows, "id string, vector array<float>")
    asked = table.filter("id LIKE 'v%5'").withColumnRenamed("id", "query_id").unionByName(spark.createDataFrame([("null", None)], "query_id string, vector array<float>"))
    monkeypatch.setattr(lists, "CHUNK", 100)
    monkeypatch.setattr(lists, "QUERIES", 20)
    held = lists.build(table, f"file://{tmp_path}/l")
    assert held.size.sum() == 901 and held.size.max() >= 300
    assert (lists.opened(spark, held.path).centroids == held.centroids).all()
    plain = lambda df: sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 6)) for r in df.collect())
    want = plain(vector.top_cosine(asked, table, 7))
    assert plain(lists.search(held, asked, 7, probes=2)) == want
    got = plain(lists.search(held, asked, 7, probes=4, exact=False))
    share = len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}) / len(want)
    assert share >= 0.9
    assert lists.search(lists.build(table.limit(0)), asked, 3).count() == 0
    unit = x.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(unit @ unit.T >= 0.8, 1))
    pairs = lists.similar_pairs(held, spark, 0.8)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {(f"v{a:04}", f"v{b:04}") for a, b in zip(i, j, strict=True)} and pairs.count() == len(i)
    assert lists.similar_pairs(lists.build(table.limit(0)), spark, 0.5).count() == 0


def test_queries_are_dealt_to_many_lists_in_slices(monkeypatch):
    """A batch's vectors aren't copied for all lists at once, however many there are, and the rows are those of one piece."""

    class Asked:
        schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vector", T.ArrayType(T.DoubleType()))])
        mapInArrow = staticmethod(lambda run, schema: run)

    rng = np.random.default_rng(1)
    made = rng.normal(size=(60, 8))
    index = lists.Lists("", "bigint", made / np.linalg.norm(made, axis=1)[:, None], np.full(60, 3.0), np.full(60, 5))
    batch = pa.record_batch({"query_id": pa.array(range(50), pa.int64()), "vector": pa.array(rng.normal(size=(50, 8)).tolist())})
    whole = pa.Table.from_batches(lists.dealt(index, Asked, 8, False)(iter([batch])))
    floor = batch.append_column("floor", pa.array([None] * 50, pa.float64()))
    rest = pa.Table.from_batches(lists.dealt(index, Asked, 8, True)(iter([floor])))
    assert whole.num_rows == 50 * 8 and rest.num_rows == 50 * 52
    monkeypatch.setattr(lists, "NUMBERS", 4 * 60 * 8)
    for found, given, want in ((False, batch, whole), (True, floor, rest)):
        got = list(lists.dealt(index, Asked, 8, found)(iter([given])))
        assert all(b.num_rows * 8 <= lists.NUMBERS for b in got) and len(got) == 13
        assert pa.Table.from_batches(got).equals(want)
