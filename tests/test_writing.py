"""Consolidation, review, note texts, stored state, slots and evaluation runs, each against a case worked out by hand."""

import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from memspark.config import Config, merged
from memspark.functions import schedule
from memspark.operators import consolidate, evaluate
from memspark.operators import writing as w
from memspark.sources import state

CFG = merged(Config(), {"predicates": {"works_at": {"object": "entity", "cardinality": "one"}, "likes": {}}, "consolidation": {"corroboration": True}})
NOW = 1_700_000_000_000
CANDIDATE = "seq int, subject string, predicate string, object string, episode string, by string, trust string, origin string, explicit boolean, confidence double, claimed_at bigint, priority boolean"
CURRENT = "id string, src string, type string, dst string, value string, valid_from bigint, valid_to bigint, expired_at bigint, conf double, provenance string"
RECORD = "subject string, predicate string, object string, episode string, by string"
NAMES = [("ada", "ada", 0), ("acme", "acme", 0), ("beta corp", "beta", 1)]


def claim(seq, subject, predicate, obj, episode, by="user", explicit=True):
    return (seq, subject, predicate, obj, episode, by, {"user": "high", "agent": "medium"}.get(by, "low"), "episode", explicit, 0.9, 1000 + seq, False)


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame(NAMES, "name string, node_id string, tier int")


def night(spark, names, rows, current=(), pending=(), rejected=(), cfg=CFG):
    frames = [spark.createDataFrame(list(r), s) for r, s in ((rows, CANDIDATE), (current, CURRENT), (pending, RECORD), (rejected, RECORD))]
    out = w.consolidation(frames[0], names, *frames[1:], cfg, NOW, "2023-11-14")
    return {k: v.collect() for k, v in out.items()}


def test_a_night_promotes_supersedes_queues_and_makes_stubs(spark, names):
    rows = [
        claim(1, "Ada", "works_at", "[[Beta Corp]]", "e1"),  # says otherwise: supersedes
        claim(2, "Ada", "likes", "tea", "e1"),
        claim(3, "Ada", "likes", "tea", "e1"),  # the same key again
        claim(4, "Nobody", "likes", "tea", "e2", by="agent"),  # no note, one weak source
        claim(5, "Acme", "works_at", "Gamma Ltd", "e3"),  # an entity object without a note
        claim(6, "Acme", "likes", "web things", "e4", by="web"),
    ]
    out = night(spark, names, rows, current=[("f0", "ada", "works_at", "acme", None, 500, None, None, 1.0, "e0")])
    told = {r["seq"]: (r["action"], r["reason"]) for r in out["decided"]}
    assert told[1][0] == "supersede" and told[2][0] == "promote" and 3 not in told and told[4][0] == "queue" and told[5][0] == "promote" and told[6] == ("queue", "untrusted source")
    facts = {(r["src"], r["type"], r["object"]): r for r in out["facts"]}
    assert facts["ada", "works_at", "[[acme]]"]["expired_at"] == NOW and facts["ada", "works_at", "[[acme]]"]["valid_to"] == 1001
    assert facts["ada", "works_at", "[[beta]]"]["expired_at"] is None and ("acme", "works_at", "[[gamma-ltd]]") in facts
    assert [r["path"] for r in out["stubs"]] == ["entities/gamma-ltd.md"]
    assert {r["subject"] for r in out["pending"]} == {"Nobody", "Acme"}


def test_corroboration_strengthens_promotes_and_clears_the_queue(spark, names):
    rows = [claim(1, "Ada", "likes", "tea", "e9"), claim(2, "Newton", "likes", "apples", "e8", by="agent")]
    held = [("f0", "ada", "likes", None, "tea", 500, None, None, 0.5, "e0")]
    out = night(spark, names, rows, current=held, pending=[("Newton", "likes", "apples", "e7", "agent")])
    assert [(r["id"], r["conf"]) for r in out["strengthened"]] == [("f0", 0.75)]
    assert [r["reason"] for r in out["decided"]] == ["corroborated by 2 independent episode(s)"] and out["pending"] == []
    assert [r["id"] for r in out["stubs"]] == ["newton"] and out["written"][0]["conf"] == 0.75
    refused = night(spark, names, rows[1:], pending=[("Newton", "likes", "apples", "e7", "agent")], rejected=[("Newton", "likes", "apples", "e6", "agent")])
    assert refused["written"] == [] and len(refused["pending"]) == 2


def test_a_second_night_and_an_empty_one_write_nothing(spark, names):
    first = night(spark, names, [claim(1, "Ada", "likes", "tea", "e1")])
    f = first["written"][0]
    again = night(spark, names, [claim(1, "Ada", "likes", "tea", "e1")], current=[(f["fact_id"], "ada", "likes", None, "tea", f["valid_from"], None, None, 0.9, "e1")])
    assert again["decided"] == [] and len(again["facts"]) == 1
    assert all(v == [] for v in night(spark, names, []).values())


def test_nulls_and_odd_names_wait(spark, names):
    rows = [claim(1, None, "likes", "tea", "e1"), claim(2, "Ada", "works_at", "src/main.ts", "e1"), claim(3, "Ada", None, None, None)]
    out = night(spark, names, rows)
    assert {r["reason"] for r in out["decided"] if r["seq"] == 2} == {"entity object not resolvable"} and out["written"] == []


def test_short_keys_that_meet_by_chance_lose_no_claim(spark, names):
    """Two claims of one 40-bit key are two decisions."""
    rows = [claim(n, "ann", "likes", o, "e1") for n, o in enumerate(("o301007", "o547800"))]
    out = night(spark, names, rows)
    assert len({r["key"] for r in out["decided"]}) == 1 and {r["object"] for r in out["decided"]} == {"o301007", "o547800"}
    later = night(spark, names, rows[1:], pending=[("ann", "likes", "o301007", "e1", "user")])
    assert [r["object"] for r in later["decided"]] == ["o547800"]


def test_review(spark, names):
    records = spark.createDataFrame([(1, "Ada", "works_at", "[[Beta Corp]]", "e1", 900), (2, "Ada", "likes", "tea", "e1", None), (3, "Bob", "likes", "tea", "e1", 5), (4, "Ada", "likes", "x", "e1", 5)], "key int, subject string, predicate string, object string, episode string, claimed_at bigint")
    decisions = spark.createDataFrame([(1, "accept", None), (2, "reject", None), (3, "accept", None), (4, "edit", "coffee")], "key int, decision string, object string").withColumns({"subject": F.lit(None).cast("string"), "predicate": F.lit(" ")})
    current = spark.createDataFrame([("f0", "ada", "works_at", "acme", None, 500, None, None)], "id string, src string, type string, dst string, value string, valid_from bigint, valid_to bigint, expired_at bigint")
    out = {k: v.collect() for k, v in w.accepted(records, decisions, names, current, CFG, NOW, "2023-11-14").items()}
    assert [(r["key"], r["predicate"], r["object"]) for r in out["pending"]] == [(4, "likes", "coffee")] and [r["key"] for r in out["rejected"]] == [2]
    assert {(r["src"], r["object"]): r["expired_at"] for r in out["facts"]} == {("ada", "[[acme]]"): NOW, ("ada", "[[beta]]"): None, ("bob", "tea"): None}
    assert all(r["by"] == "user" and r["trust"] == "high" and r["conf"] == 1.0 for r in out["written"]) and [r["id"] for r in out["stubs"]] == ["bob"]


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, text string")


def test_lines_go_into_their_section_once(spark):
    notes = texts(spark, "# a\n\n## Facts\n- x\n\n## History\n", "# a", "## Facts\n- new\n", "")
    put = notes.select("i", w.with_lines(F.col("text"), F.array(F.lit("- new"), F.lit("- new")), "Facts").alias("t"))
    got = [r["t"] for r in put.orderBy("i").collect()]
    assert got == ["# a\n\n## Facts\n- x\n- new\n\n## History\n", "# a\n\n## Facts\n- new\n", "## Facts\n- new\n", "\n\n## Facts\n- new\n"]
    again = put.select(w.with_lines(F.col("t"), F.array(F.lit("- new")), "Facts").alias("u"), "t").collect()
    assert all(r["u"] == r["t"] for r in again)
    none = notes.select(w.with_lines(F.col("text"), F.array().cast("array<string>"), "Facts").alias("t"), "text").collect()
    assert all(r["t"] == r["text"] for r in none)


def test_marks_change_one_line(spark):
    notes = texts(spark, "---\nby: user\n---\nbody\n---\n", "---\r\nconsolidated: 1\r\n---\r\n", "no fence", "---\nopen", None)
    got = [r["t"] for r in notes.select("i", w.marked(F.col("text"), F.lit("D")).alias("t")).orderBy("i").collect()]
    assert got == ["---\nby: user\nconsolidated: D\n---\nbody\n---\n", "---\r\nconsolidated: D\r\n---\r\n", "no fence", "---\nopen", None]
    lines = notes.select("i", w.line_replaced(F.col("text"), F.lit(2), F.lit("X")).alias("t")).orderBy("i").collect()
    assert [r["t"] for r in lines][:3] == ["---\nX\n---\nbody\n---\n", "---\r\nX\n---\r\n", "no fence"]


def test_changes_and_diff(spark):
    schema = "path string, text string"
    before = spark.createDataFrame([("a.md", "1\n2\n"), ("b.md", "same")], schema)
    after = spark.createDataFrame([("a.md", "1\n3\n"), ("b.md", "same"), ("c.md", "new")], schema)
    rows = {r["path"]: r for r in w.with_diff(w.changes(before, after)).collect()}
    assert set(rows) == {"a.md", "c.md"} and rows["c.md"]["change"] == "added"
    assert "-2" in rows["a.md"]["diff"].split("\n") and "+3" in rows["a.md"]["diff"].split("\n")


def test_state_is_versioned(spark, tmp_path):
    root = f"file://{tmp_path}"
    access = spark.createDataFrame([("a", 10), ("a", 20), ("b", 30)], "node string, t bigint")
    assert state.stored(spark, root, "summaries") is None
    assert state.store_summaries(access, root) == 30
    more = access.unionByName(spark.createDataFrame([("b", 40)], "node string, t bigint"))
    rows = {(r["node"], r["t"], r["count"], r["first"]) for r in state.presentations(spark, root, more).collect()}
    assert rows == {("a", None, 2, 10), ("b", None, 1, 30), ("b", 40, None, None)}
    for i in range(3):
        state.store(spark.range(i + 1), root, "t", {"i": i})
    df, meta = state.stored(spark, root, "t")
    assert df.count() == 3 and meta == {"i": 2, "version": 3}


def test_index_is_reopened_unless_its_settings_changed(spark, tmp_path):
    root = f"file://{tmp_path}"
    edges = spark.createDataFrame([("a", "b", "link"), ("a", "c", "fact")], "src string, dst string, origin string")
    state.store_index({"edges": edges, "nodes": spark.range(2)}, root, CFG)
    held = state.open_index(spark, root, CFG)
    assert held["nodes"].count() == 2 and held["edges"].filter("origin = 'fact'").count() == 1
    assert state.open_index(spark, root, merged(CFG, {"retrieval": {"top_k": 3}})) is not None
    assert state.open_index(spark, root, merged(CFG, {"graph": {"default_extraction": "wikilink"}})) is None


def test_a_night_is_told_once(spark, tmp_path):
    root = f"file://{tmp_path}"
    part = lambda a, s, **x: {"a": a, "b": "z", "gist": "g", "salience": s, "status": "kept", **x}
    state.write_night(spark, root, "2024-01-01", {"ran": True, "samples": 4, "errors": {"bad": 1}}, [part("x", 1), part("y", 2), part("w", 3, status="dropped"), part("v", 9, gist=None)])
    now = int(datetime.now(UTC).timestamp() * 1000)
    out = state.woken(spark, root, 1, 48, now)
    assert [f["a"] for f in out["fragments"]] == ["y"] and out["forgotten"] == 1 and out["summary"] == "slept fine (bad=1)"
    assert state.woken(spark, root, 1, 48, now)["recalled"] is False
    state.write_night(spark, root, "2024-01-02", {"ran": True}, [])
    assert state.expire_nights(spark, root, 0, now + 10**9) == [] and state.expire_nights(spark, root, 1, now + 10**8) == ["2024-01-02"]
    assert state.slept({"ran": False}, 0) == "slept badly" and state.slept({"skipped": True}, 0).endswith("no dreaming happened")


def test_registry(spark, tmp_path):
    good = {"workspace": 1, "vaults": {"g": {}, "p": {"project": "work"}, "pa": {"project": "work", "agent": "bot"}}, "writes": {"agents": {"bot": ["project"]}}}
    path = tmp_path / "w.json"
    path.write_text(json.dumps(good))
    registry, warnings = state.read_registry(spark, f"file://{path}", there={"g", "p"})
    assert [c for _, c, _ in warnings] == ["workspace.missing-dir"]
    assert state.targets_of(registry, "bot") == ["project"] and state.targets_of(registry, None) == ["self"]
    assert state.target_vault(registry, "work", "bot", "self") == "pa" and state.target_vault(registry, "work", "bot", "global-agent") is None
    with pytest.raises(ValueError, match="registered: work"):
        state.binding(registry, project="play")
    bad = {"workspace": 2, "vaults": {"A!": {}, "b": {}, "c": 3}, "defaults": {"index": 1}, "writes": {"default": ["x"]}, "recall": {"layerWeights": {"global": 2, "q": 1}}}
    codes = {c.split(".")[1] for _, c, _ in state.problems_of(bad)}
    assert codes == {"bad-version", "bad-id", "duplicate-cell", "bad-coords", "defaults-index", "bad-write-target", "bad-layer-weight", "bad-layer"}


def at(*parts):
    return int(datetime(*parts, tzinfo=UTC).timestamp() * 1000)


def test_slots():
    new_york = "America/New_York"
    assert schedule.slot(datetime(2024, 7, 1), "03:00", new_york) == at(2024, 7, 1, 7)
    assert schedule.slot(datetime(2024, 3, 10), "02:30", new_york) == at(2024, 3, 10, 7)  # the hour is skipped
    assert schedule.slot(datetime(2024, 11, 3), "01:30", new_york) == at(2024, 11, 3, 5, 30)  # the first of two
    assert schedule.next_slot(at(2024, 7, 1, 7), "03:00", new_york) == at(2024, 7, 2, 7)
    assert schedule.due(at(2024, 7, 1, 8), "03:00", new_york, None) and not schedule.due(at(2024, 7, 1, 8), "03:00", new_york, at(2024, 7, 1, 7))
    with pytest.raises(ValueError):
        schedule.clock("24:00")


def test_dream_gate(spark):
    rows = []
    for split in ("dev", "holdout"):
        for weight, remote, plain in ((0.0, 0.2, 0.5), (0.5, 0.4, 0.5), (1.0, 0.6, 0.5)):
            rows += [("true+decoys", "typed", weight, split, "remote-association-2hop", remote), ("decoys-only", "typed", weight, split, "single-hop", plain - (0.1 if weight == 1.0 else 0.0))]
    results = spark.createDataFrame(rows, "config string, mode string, weight double, split string, kind string, recall_5 double")
    none = spark.createDataFrame([], "config string, mode string, weight double, n long")
    out = {r["weight"]: r for r in evaluate.dream_gate(results, none).collect()}
    assert out[0.5]["passes"] and out[1.0]["remote_rises"] and not out[1.0]["no_regression"] and 0.0 not in out
    broken = spark.createDataFrame([("true+decoys", "typed", 0.5, 1)], none.schema)
    assert not {r["weight"]: r for r in evaluate.dream_gate(results, broken).collect()}[0.5]["passes"]


def test_tuning_keeps_kinds_and_violations():
    def measure(settings, split):
        x = settings["x"]
        return {"score": x, "kinds": {"a": 0.5 - (0.1 if x == 3 else 0)}, "violations": {"trust": int(x == 4)}}

    out = evaluate.tune_safely({"x": 1}, {"x": [2, 3, 4]}, measure)
    assert out["best"] == {"x": 2} and out["holdout"]["best"]["score"] == 2 and len(out["tried"]) == 4


def test_workspace_cases(spark):
    hits = spark.createDataFrame([(1.0, "c1", "p", "v", "global"), (1.0, "c2", "q", "v", "agent"), (0.5, "c1", "p", "v", "global")], "weight double, case_id string, passage_id string, vault string, layer string")
    expected = spark.createDataFrame([("c1", "p", "v", "global"), ("c2", "q", "v", "global"), ("c2", "r", "v", "global")], "case_id string, passage_id string, vault string, layer string")
    absent = spark.createDataFrame([("c2", "q")], "case_id string, passage_id string")
    one = hits.filter("weight = 1").drop("weight")
    assert {(r["passage_id"], r["problem"]) for r in evaluate.workspace_cases(one, expected, absent).collect()} == {("q", "mislabeled"), ("r", "missing"), ("q", "absent")}
    cases = spark.createDataFrame([("c1",), ("c2",)], "case_id string")
    assert {r["weight"]: (r["passed"], r["total"]) for r in evaluate.layer_sweep(hits, expected, absent, cases, ["weight"]).collect()} == {1.0: (1, 2), 0.5: (1, 2)}


def test_overrides_and_ablations():
    assert evaluate.checked_overrides({"scope": "x"}) == {"scope": "x"}
    with pytest.raises(ValueError):
        evaluate.checked_overrides({"retrieval.topK": 1})
    from memspark.config import MODE_ORIGINS

    assert len(evaluate.ablation_settings(MODE_ORIGINS)) == 3 + 2 + 14


def test_triple_statistics(spark):
    t = spark.createDataFrame([("likes", 0.9), ("likes", None), ("is", 0.8)], "predicate string, conf double")
    assert {tuple(r) for r in consolidate.triple_statistics(t).collect()} == {("likes", 2, 1), ("is", 1, 1)}
