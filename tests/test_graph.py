"""Graph operators against hand-made graphs: mass, both PageRank paths, distances, budget, expansion, supersession."""

import random

import numpy as np
import pytest

from memspark.config import Config, checked, merged
from memspark.operators import activation, dreams, graph, push, recall, temporal
from memspark.streaming import access


def edges(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, weight double")


def test_mass_is_one_and_both_ways_agree(spark):
    e = edges(spark, [("a", "b", 1.0), ("b", "c", 2.0), ("c", "a", 0.5), ("d", "e", 1.0), ("a", "a", 5.0), ("b", "a", 1.0), ("x", "y", 0.0)])
    seeds = spark.createDataFrame([(1, "a", 2.0), (1, "d", 1.0), (2, "c", 1.0), (2, "gone", 9.0)], "query_id int, node string, value double")
    adjacent = graph.adjacency(e, "weight")
    one = {(r["query_id"], r["node"]): r["mass"] for r in graph.pagerank(seeds, adjacent).collect()}
    parted = push.prepared(adjacent, bucket_edges=4, hub=1)
    assert parted.buckets > 1 and parted.nodes(spark).filter("relay").count() > 2
    two = {(r["query_id"], r["node"]): r["mass"] for r in graph.pagerank(seeds, parted, tolerance=1e-4).collect()}
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 2e-4 for k in one)
    for q in (1, 2):
        assert abs(sum(v for k, v in one.items() if k[0] == q) - 1) < 1e-9
    assert (2, "gone") not in one and (1, "x") not in one
    for g, tolerance in ((adjacent, 1e-8), (parted, 1e-4)):
        top = {(r["query_id"], r["node"]) for r in graph.pagerank(seeds, g, tolerance=tolerance, top=2).collect()}
        assert top == {(q, n) for q in (1, 2) for _, n in sorted((-round(m, 9), n) for (k, n), m in one.items() if k == q)[:2]}
    alone = graph.with_isolated(graph.pagerank(seeds, adjacent), seeds, 0.5).filter("node = 'gone'").head()
    assert alone["mass"] == 4.5


def exact(adjacent, seeds, damping=0.5):
    """Masses by solving the linear system."""
    names = sorted({r["a"] for r in adjacent})
    at = {n: i for i, n in enumerate(names)}
    w = np.zeros((len(names), len(names)))
    for r in adjacent:
        w[at[r["a"]], at[r["b"]]] = r["w"]
    s = np.zeros(len(names))
    for n, v in seeds:
        s[at[n]] += v
    return names, w.sum(axis=1), np.linalg.solve(np.eye(len(names)) - damping * (w / w.sum(axis=1, keepdims=True)).T, (1 - damping) * s / s.sum())


@pytest.mark.parametrize(("bucket_edges", "hub", "tolerance"), [(1 << 21, 1 << 18, 1e-8), (90, 1 << 18, 1e-4), (60, 12, 1e-4)])
def test_push_stays_within_its_bound(spark, bucket_edges, hub, tolerance):
    """Every node's error is at most its share of the volume of the tolerance, with hubs and buckets of any size."""
    rng = random.Random(5)
    rows = [(f"n{rng.randrange(80)}", f"n{rng.randrange(80)}", rng.uniform(0.1, 3)) for _ in range(150)] + [("hub", f"n{i}", 1.0) for i in range(80)]
    adjacent = graph.adjacency(edges(spark, rows), "weight")
    g = push.prepared(adjacent, bucket_edges=bucket_edges, hub=hub)
    assert (g.buckets > 1) == (bucket_edges < 1000) and (g.nodes(spark).filter("relay").count() > 0) == (hub < 100)
    wanted = {1: [("n1", 1.0)], 2: [("hub", 2.0), ("n2", 1.0)], 3: [(f"n{i}", 1.0) for i in range(20)]}
    present = {r["a"] for r in adjacent.collect()}
    seeds = spark.createDataFrame([(q, n, v) for q, every in wanted.items() for n, v in every if n in present], "query_id int, node string, value double")
    got = {(r["query_id"], r["node"]): r["mass"] for r in push.ranked(seeds, g, 0.5, tolerance).collect()}
    for q, every in wanted.items():
        names, degree, mass = exact(adjacent.collect(), [(n, v) for n, v in every if n in present])
        mine = np.array([got.get((q, n), 0.0) for n in names])
        assert abs(mine.sum() - 1) < 1e-12 and np.abs(mine - mass).sum() <= 2 * tolerance + 1e-12
        assert (np.abs(mine - mass) <= 2 * tolerance * degree / degree.sum() + 1e-12).all()


def test_rounds_leave_nothing_behind(spark, monkeypatch):
    """With many buckets a round writes a row for a query and bucket, not for each pair of buckets, and the round before is deleted, as is a graph that was made for the call."""
    import glob

    from memspark import storage

    most, store = [], push.store

    def counted(df, path, *by):
        store(df, path, *by)
        if "/push-" in path:
            most.append((spark.read.parquet(path).count(), len(glob.glob(path.rsplit("/", 1)[0].removeprefix("file://") + "/push-*"))))

    monkeypatch.setattr(push, "store", counted)
    rng = random.Random(3)
    rows = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}", 1.0) for _ in range(120)]
    seeds = spark.createDataFrame([(1, rows[0][0], 1.0), (2, rows[1][0], 1.0)], "query_id int, node string, value double")
    g = push.prepared(graph.adjacency(edges(spark, rows), "weight"), bucket_edges=60)
    assert 2 < g.buckets < 10
    before = len(storage._made)
    assert graph.pagerank(seeds, g, tolerance=1e-2).count() > 2
    assert most and max(n for n, _ in most) <= 2 * g.buckets and max(folders for _, folders in most) <= 2
    made = graph.pagerank(seeds, graph.adjacency(edges(spark, rows), "weight"))
    left = [p.rsplit("/", 1)[1].split("-")[0] for _, p in storage._made[before:] if storage.exists(spark, p)]
    assert made.count() > 2 and sorted(left) == ["asked", "asked", "masses", "masses"]


def test_few_senders_touch_few_nodes(spark):
    """On a long chain one sender reaches its two neighbours, and only these are looked at next, not every node of the bucket."""
    g = push.prepared(graph.adjacency(edges(spark, [(f"n{i:04}", f"n{i + 1:04}", 1.0) for i in range(900)]), "weight"))
    b = push.Bucket(g.path, 0)
    y = np.zeros(b.n)
    got = b.pull(y, 0, b.n, np.array([500]), np.array([0.5]))
    assert sorted(got) == [499, 501] and y[499] == y[501] == 0.5 and y.sum() == 1.0
    amount, sent = b.push(y, got, 0.5, 1e-9)
    assert list(amount) == [0.5, 0.5] and list(sent) == [0.125, 0.125] and not y.any()
    assert len(push.packed(b.n, got, sent)) < 100


def test_many_senders_need_no_fresh_arrays(spark):
    """When all nodes send, what moves over the edges goes through one array of the bucket's: no array of all edges is made anew."""
    import tracemalloc

    g = push.prepared(graph.adjacency(spark.range(60_000).selectExpr("concat('n', id % 300) AS src", "concat('n', id DIV 300) AS dst", "1d AS weight"), "weight"))
    b = push.Bucket(g.path, 0)
    x, y = np.arange(b.n) / b.n, np.zeros(b.n)
    want = np.bincount(b.dst, x[b.src] * b.w, b.n)
    tracemalloc.start()
    got = b.pull(y, 0, b.n, None, x)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got is None and np.array_equal(y, want) and len(b.dst) > 50_000 and most < 4 * len(b.dst)


def test_isolated_seeds_leave_the_masses_where_they_are(spark):
    mass = spark.range(5000).selectExpr("CAST(id % 5 AS INT) AS query_id", "concat('n', id) AS node", "1d AS mass")
    seeds = spark.createDataFrame([(0, "n5", 2.0), (1, "n5", 4.0), (0, "gone", 6.0)], "query_id int, node string, value double")
    out = graph.with_isolated(mass, seeds, 0.5)
    assert {(r["query_id"], r["node"], r["mass"]) for r in out.filter("mass > 1").collect()} == {(1, "n5", 2.0), (0, "gone", 3.0)} and out.count() == 5002
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 1  # of the masses only the seeds' rows go on


def test_isolated_seeds_are_those_without_a_node(spark):
    """A seed in the graph that isn't among the heaviest isn't isolated, and looking for isolated ones doesn't read the masses."""
    e = edges(spark, [("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0)])
    seeds = spark.createDataFrame([(1, "a", 90.0), (1, "d", 1.0), (1, "gone", 6.0), (2, "gone", 2.0)], "query_id int, node string, value double")
    out = graph.pagerank(seeds, graph.adjacency(e, "weight"), top=1, isolated=True)
    assert {(r["query_id"], r["node"]): round(r["mass"], 9) for r in out.filter("node = 'gone'").collect()} == {(1, "gone"): 3.0, (2, "gone"): 1.0}
    assert {(r["query_id"], r["node"]) for r in out.collect()} == {(1, "a"), (1, "gone"), (2, "gone")}
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_edges_meet_their_numbers_one_end_at_a_time(spark, monkeypatch):
    """No step of the build shuffles all edges more than once, and each deletes what it has read, the table behind the edges first."""
    from memspark import storage

    at, seen, store = storage.new_path(spark, "edges"), [], push.store

    def counted(df, path, *by):
        store(df, path, *by)
        tag = path.rsplit("/", 1)[1].split("-")[0]
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        seen.append((tag, plan.count("Join "), sorted(p.rsplit("/", 1)[1].split("-")[0] for _, p in storage._made[before:] if storage.exists(spark, p))))

    before = len(storage._made) - 1
    monkeypatch.setattr(push, "store", counted)
    rows = [(f"n{i % 7}", f"n{i % 11 + 3}", 1.0) for i in range(60)]
    g = push.prepared(graph.adjacency(push.stored(edges(spark, rows), at), "weight"), bucket_edges=20, source=at)
    steps = [(tag, joins) for tag, joins, _ in seen]
    assert 4 < g.buckets < 13  # on four cores, each deal of four buckets at most
    assert steps == [("edges", 0), ("adjacency", 0), ("degrees", 0), ("nodes", 0), ("numbered", 1), ("numbered", 1)] + [("edges", 0)] * -(-g.buckets // 4)
    assert seen[1][2] == ["adjacency", "edges"] and seen[2][2] == ["adjacency", "degrees"] and seen[-1][2] == ["degrees", "graph", "numbered"]
    assert [p.rsplit("/", 1)[1].split("-")[0] for _, p in storage._made[before:] if storage.exists(spark, p)] == ["graph"]
    adjacent = graph.adjacency(edges(spark, rows), "weight")
    assert spark.read.parquet(f"{g.path}/edges").count() == adjacent.count()


def test_nodes_and_orders_are_not_broadcast(spark, sf_dir, monkeypatch):
    """Under Spark's own limit for small tables, which a compact file of a million nodes stays below."""
    from memspark.plans import inputs

    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    plan, seen, store = lambda df: df._jdf.queryExecution().executedPlan().toString(), [], push.store
    monkeypatch.setattr(push, "store", lambda df, path, *by: (seen.append((path.rsplit("/", 1)[1].split("-")[0], plan(df))), store(df, path, *by)))
    g = push.prepared(graph.adjacency(edges(spark, [(f"n{i % 7}", f"n{i % 11 + 3}", 1.0) for i in range(60)]), "weight"), bucket_edges=20)
    seeds = spark.createDataFrame([(1, "n1", 1.0), (1, "gone", 1.0)], "query_id int, node string, value double")
    push.ranked(seeds, g)
    joins = [p for tag, p in seen if tag in ("numbered", "asked")] + [plan(push.outside(seeds, g)), plan(inputs.link_pairs(spark, sf_dir))]
    assert len(joins) == 5 and all("SortMergeJoin" in p and "Broadcast" not in p for p in joins)


def test_a_task_holds_one_bucket(spark, monkeypatch):
    """The old bucket is let go before the new one is read, and unsorted edges are put in order."""
    made = push.Bucket.__init__

    def alone(self, *at):
        assert not push._held
        made(self, *at)

    monkeypatch.setattr(push.Bucket, "__init__", alone)
    g = push.prepared(graph.adjacency(edges(spark, [(f"n{i % 7}", f"n{i % 11 + 3}", 1.0) for i in range(60)]), "weight"), bucket_edges=20)
    held = [push.bucket_of(g.path, i) for i in range(g.buckets)]
    assert push.bucket_of(g.path, g.buckets - 1) is held[-1]
    every = spark.read.parquet(f"{g.path}/edges").orderBy("w", "dst")
    mixed = push.Graph(f"{g.path}-mixed", g.buckets, g.volume, g.size)
    every.coalesce(1).write.partitionBy("bucket").parquet(f"{mixed.path}/edges")
    g.nodes(spark).write.partitionBy("bucket").parquet(f"{mixed.path}/nodes")
    for i, b in enumerate(held):
        other = push.bucket_of(mixed.path, i)
        y, z = np.zeros(b.n), np.zeros(b.n)
        for source, block in b.blocks.items():
            n = held[source].n
            b.pull(y, source, n, None, np.arange(n) + 1.0)
            other.pull(z, source, n, None, np.arange(n) + 1.0)
            assert (np.diff(b.src[block]) >= 0).all() and block == other.blocks[source]
        assert np.allclose(y, z) and y.any()


def test_a_graph_is_not_built_over_another(spark):
    e = graph.adjacency(edges(spark, [("a", "b", 1.0)]), "weight")
    g = push.prepared(e)
    with pytest.raises(FileExistsError):
        push.prepared(e, g.path)


def test_graphs_are_stored_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return graph.adjacency(edges(spark, [("a", "b", 1.0), ("b", "c", 1.0)]), "weight")

    root = f"file://{tmp_path}"
    cache = push.GraphCache(spark, "1", root)
    first = cache.get("typed", None, make)
    assert cache.get("typed", None, make) == first and len(made) == 1 == cache.built
    again = push.GraphCache(spark, "1", root)  # another session
    assert again.get("typed", None, make) == first and len(made) == 1 and again.built == 0
    assert again.get("typed", 5, make) != first and push.GraphCache(spark, "2", root).get("typed", None, make).path != first.path and len(made) == 3
    (tmp_path / "graphs" / "v1" / "typed-now" / "graph.json").unlink()  # lost before its end
    assert push.GraphCache(spark, "1", root).get("typed", None, make) == first and len(made) == 4
    seeds = spark.createDataFrame([(1, "a", 1.0)], "query_id int, node string, value double")
    assert abs(sum(r["mass"] for r in push.ranked(seeds, first).collect()) - 1) < 1e-12
    empty = push.prepared(graph.adjacency(edges(spark, []), "weight"))
    assert push.ranked(seeds, empty).count() == 0 and push.ranked(seeds.limit(0), first).count() == 0


def test_paths_and_hops(spark):
    e = edges(spark, [("a", "b", 1.0), ("b", "d", 1.0), ("a", "c", 1.0), ("c", "d", 1.0), ("a", "e", 1.0), ("e", "d", 1.0), ("a", "f", 1.0), ("f", "d", 1.0), ("d", "z", 1.0)])
    pairs = spark.createDataFrame([(1, "a", "d"), (2, "a", "a"), (3, "a", "nowhere"), (4, "z", "a")], "pair_id int, src string, dst string")
    got = {(r["pair_id"], r["nth"]): r["nodes"] for r in graph.shortest_paths(pairs, e).collect()}
    assert got == {(1, 1): ["a", "b", "d"], (1, 2): ["a", "c", "d"], (1, 3): ["a", "e", "d"], (2, 1): ["a"], (4, 1): ["z", "d", "b", "a"], (4, 2): ["z", "d", "c", "a"], (4, 3): ["z", "d", "e", "a"]}


def every_shortest(links, src, dst, most):
    """All shortest paths of up to `most` links, in order, by one search from the source."""
    paths = [[src]]
    for _ in range(most + 1):
        done = [p for p in paths if p[-1] == dst]
        if done:
            return sorted(done)
        seen = {n for p in paths for n in p}
        paths = [[*p, n] for p in paths for n in links.get(p[-1], ()) if n not in seen]
    return []


def test_paths_meet_in_the_middle(spark):
    """Random graphs with a hub, loops and repeated edges: every pair's paths are those of a plain search, and no search goes past the meeting."""
    rng = random.Random(11)
    rows = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}", 1.0) for _ in range(75)] + [("hub", f"n{i}", 1.0) for i in range(0, 60, 2)] + [("hub", "n2", 1.0), ("n1", "n1", 1.0)]
    links = {}
    for a, b, _ in rows:
        if a != b:
            links.setdefault(a, set()).add(b)
            links.setdefault(b, set()).add(a)
    asked = [(i, f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for i in range(80)] + [(80, "hub", "n7"), (81, "n3", "n3"), (82, "gone", "n1"), (83, None, "n1")]
    pairs = spark.createDataFrame(asked, "pair_id int, src string, dst string")
    for most in (5, 3):
        got = {}
        for r in graph.shortest_paths(pairs, edges(spark, rows), most).collect():
            got.setdefault(r["pair_id"], []).append((r["nth"], r["nodes"], r["depth"]))
        for i, a, b in asked:
            want = every_shortest(links, a, b, most)[:3] if a else []
            assert sorted(got.get(i, [])) == [(n + 1, p, len(p) - 1) for n, p in enumerate(want)], (i, a, b)
    # A path's end beside a hub of 500: the other side grows, so the hub is never opened.
    star = edges(spark, [("big", f"leaf{i}", 1.0) for i in range(500)] + [("s", "big", 1.0), ("t", "u", 1.0), ("u", "v", 1.0), ("v", "s", 1.0)])
    one = star.select(star.src.alias("a"), star.dst.alias("b"))
    both = one.unionByName(one.selectExpr("b AS a", "a AS b")).distinct()
    both = both.join(both.groupBy("a").count().withColumnsRenamed({"a": "b", "count": "degree"}), "b")
    seen, met = graph.meetings(spark.createDataFrame([(1, "s", "t")], "pair_id int, src string, dst string"), both, 5)
    assert met.count() >= 1 and seen.count() < 12
    # Both ends are leaves of hubs, so one hub must be opened: its other leaves are not walked, in neither direction.
    stars = edges(spark, [("root", "h1", 1.0), ("root", "h2", 1.0)] + [(h, f"{h}-{i}", 1.0) for h in ("h1", "h2") for i in range(300)])
    pair = spark.createDataFrame([(1, "h1-1", "h2-2"), (2, "h1-1", "h1-3"), (3, "h1-1", "h1"), (4, "h1-1", "gone")], "pair_id int, src string, dst string")
    got = {r["pair_id"]: r["nodes"] for r in graph.shortest_paths(pair, stars).collect()}
    assert got == {1: ["h1-1", "h1", "root", "h2", "h2-2"], 2: ["h1-1", "h1", "h1-3"], 3: ["h1-1", "h1"]}
    one = stars.select(stars.src.alias("a"), stars.dst.alias("b"))
    both = one.unionByName(one.selectExpr("b AS a", "a AS b"))
    both = both.join(both.groupBy("a").count().withColumnsRenamed({"a": "b", "count": "degree"}), "b")
    assert graph.meetings(pair, both, 5)[0].count() < 30


def test_budget_skips_what_is_too_large(spark):
    rows = [(1, i, f"p{i}", "x" * n) for i, n in enumerate([9000, 4, 7000, 8, 4], 1)]
    hits = spark.createDataFrame(rows, "query_id int, rank int, passage_id string, text string")
    got = recall.within_budget(hits, 3, 2000).orderBy("rank").collect()
    assert [r["passage_id"] for r in got] == ["p1"]
    got = recall.within_budget(hits.filter("rank > 1"), 3, 2000).orderBy("rank").collect()
    assert [(r["rank"], r["passage_id"]) for r in got] == [(1, "p2"), (2, "p3"), (3, "p4")]


def test_compaction_agrees_with_the_stream(spark, tmp_path):
    rows = [(f"n{i % 3}", (i * 7919) % 1000) for i in range(200)]
    df = spark.createDataFrame(rows, "node string, t bigint")
    batch = {r["node"]: r for r in activation.compact(df.repartition(5)).collect()}
    df.repartition(4).write.parquet(str(tmp_path / "log"))
    stream = access.compact_stream(access.events_as_stream(spark, str(tmp_path / "log"), df.schema, per_batch=1))
    streamed = {r["node"]: r for r in access.run_to_end(stream, "test").collect()}
    for n in batch:
        assert [batch[n][c] for c in ("count", "first", "last", "accesses")] == [streamed[n][c] for c in ("count", "first", "last", "accesses")]
        assert batch[n]["accesses"] == sorted(t for m, t in rows if m == n)[-10:]


def test_summary_stands_for_its_events(spark):
    df = spark.createDataFrame([("a", 1000 * i) for i in range(1, 101)], "node string, t bigint")
    from pyspark.sql import functions as F

    now = F.lit(101_000)
    exact = activation.activation(activation.presentations(activation.compact(df.limit(0)), df, 0), now).head()["total"]
    folded = activation.activation(activation.presentations(activation.compact(df), df, 100_000), now).head()["total"]
    assert abs(folded / exact - 1) < 0.1
    before = activation.presentations(activation.compact(df), df, 100_000, as_of=50_000)
    assert before.count() == 50 and before.filter("count IS NOT NULL").count() == 0


def test_supersession_chain(spark):
    kinds = "id bigint, src string, type string, object string, valid_from bigint, valid_to bigint, expired_at bigint"
    old = spark.createDataFrame([(1, "s", "runs_on", "a", 10, None, None), (2, "s", "likes", "x", 10, None, None), (3, "s", "runs_on", "z", 99, None, None)], kinds)
    new = spark.createDataFrame([(4, "s", "runs_on", "b", 20, None, None), (5, "s", "runs_on", "c", 30, None, None)], kinds)
    got = {r["id"]: r for r in temporal.superseded(old, new, 50).collect()}
    assert (got[1]["valid_to"], got[1]["expired_at"]) == (20, 50) and got[2]["expired_at"] is None
    assert got[3]["expired_at"] is None  # it would be turned around
    assert (got[4]["valid_to"], got[4]["expired_at"], got[5]["valid_to"], got[5]["expired_at"]) == (30, 50, None, None)


def test_draws_are_the_nights(spark):
    assert dreams.seed_of("") == 2166136261 and dreams.seed_of("a") == 0xE40C292C
    a, b = dreams.Draws(7), dreams.Draws(7)
    assert [a() for _ in range(5)] == [b() for _ in range(5)] and all(0 <= a() <= 1 for _ in range(100))
    assert dreams.partners("a", dreams.Draws(1), [("x", 0.0), ("y", 1.0)]) == "y"


def test_sampling_is_far_and_blocked(spark):
    nodes = spark.createDataFrame([(f"n{i}", "note", None, "high" if i != 5 else "low") for i in range(8)], "id string, kind string, note_id string, trust string")
    rows = [(f"n{i}", f"n{i + 1}", "link", 1.0) for i in range(7)]
    e = spark.createDataFrame(rows, "src string, dst string, origin string, weight double")
    active = spark.createDataFrame([("n0", 1.0, 1)], "node string, base double, nth int")
    pairs = dreams.sample_pairs(nodes, active, e, nodes, Config(), "2026-09-01")
    assert pairs and all(a == "n0" and b != "n5" for a, b in pairs) and len(set(pairs)) == len(pairs)
    assert pairs == dreams.sample_pairs(nodes, active, e, nodes, Config(), "2026-09-01")
    blocked = {tuple(sorted(pairs[0]))}
    assert pairs[0] not in dreams.sample_pairs(nodes, active, e, nodes, Config(), "2026-09-01", blocked)


def test_settings():
    cfg = checked(merged(Config(), {"graph": {"origin_weights": {"dream": 0.5}}}))
    assert cfg.graph.origin_weights["dream"] == 0.5 and cfg.graph.origin_weights["fact"] == 1.5
    with pytest.raises(ValueError):
        merged(Config(), {"nothing": 1})
    with pytest.raises(ValueError):
        checked(merged(Config(), {"graph": {"damping": 1.5}}))


def test_expansion_follows_facts(spark):
    cfg = merged(Config(), {"retrieval": {"expansion": {"enabled": True, "per_hit": 1, "max_inserted": 2}}})
    hits = spark.createDataFrame([(1, i, p, p.split("#")[0], p, 1.0 / i) for i, p in enumerate(["e#0", "o#0", "t#0", "e#facts", "u#0"], 1)], "query_id int, rank int, passage_id string, note_id string, text string, score double")
    queries = spark.createDataFrame([(1, "who maintains e")], "query_id int, text string")
    cues = spark.createDataFrame([(1, "e")], "query_id int, node_id string")
    null = {c: None for c in ("valid_from", "valid_to", "recorded_at", "expired_at", "declared_created")}
    rows = [{"id": "1", "src": "e", "dst": "u", "origin": "fact", "type": "near_to", "trust": "high", **null}, {"id": "2", "src": "e", "dst": "t", "origin": "fact", "type": "maintained_by", "trust": "high", **null}]
    kinds = "id string, src string, dst string, origin string, type string, trust string, " + ", ".join(f"{c} bigint" for c in null)
    e = spark.createDataFrame([[r[c.split(" ")[0]] for c in kinds.split(", ")] for r in rows], kinds)
    got = recall.expanded(hits, queries, cues, e, cfg, "typed", 0).orderBy("rank").collect()
    assert [r["passage_id"] for r in got] == ["e#0", "e#facts", "t#0", "o#0", "u#0"]
    assert [r["via"] for r in got] == [None, "e", "e maintained_by", None, None]
    plain = recall.expanded(hits, queries, cues, e, cfg, "wikilink", 0).orderBy("rank").collect()
    assert [r["passage_id"] for r in plain] == ["e#0", "o#0", "t#0", "e#facts", "u#0"]


def test_vectors_may_have_any_ids(spark):
    from memspark.operators.vector import top_cosine

    queries = spark.createDataFrame([("q1", [1.0, 0.0]), ("q2", None)], "query_id string, vector array<double>")
    vectors = spark.createDataFrame([("a#0", [1.0, 0.1]), ("a#1", [0.0, 1.0]), ("b#0", [2.0, 0.0]), ("c", None)], "id string, vector array<double>")
    got = top_cosine(queries, vectors, 2).orderBy("rank").collect()
    assert [(r["query_id"], r["id"]) for r in got] == [("q1", "b#0"), ("q1", "a#0")]


def test_compaction_keeps_the_latest(spark):
    from memspark.operators.activation import compact

    rows = [("a", t) for t in range(50)] + [("b", 3), ("b", None), ("c", None), (None, 7)]
    got = {r["node"]: (r["count"], r["first"], r["last"], r["accesses"]) for r in compact(spark.createDataFrame(rows, "node string, t long")).collect()}
    assert got == {"a": (50, 0, 49, list(range(40, 50))), "b": (2, 3, 3, [3]), "c": (1, None, None, []), None: (1, 7, 7, [7])}


def test_quotes_in_passages(spark):
    from memspark.operators.dreams import quoted_in

    passages = [(1, "xThe quick  brown\nfox jumps over it"), (2, "The quick brown fox"), (3, None), (4, "brown fox jumps " * 30)]
    quotes = [(7, "The quick brown fox jump"), (8, "fox jumps brown fox jumps"), (9, "too short"), (10, None)]
    got = quoted_in(spark.createDataFrame(quotes, "quote_id int, quote string"), spark.createDataFrame(passages, "passage_id int, passage string"))
    assert sorted(map(tuple, got.collect())) == [(7, 1), (8, 4)]
