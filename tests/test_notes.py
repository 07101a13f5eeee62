"""Notes, facts and periods; the index; incremental equals full; lint."""

import json

import pytest
from pyspark.sql import functions as F

from memspark.config import Config, merged
from memspark.operators import index
from memspark.sources import notes, vault

ENTITY = """---
type: entity
kind: project
title: Orchard
aliases: [sensors, "The, Orchard"]
tags: ['#farm', iot]
created: 2026-06-01
importance: 0.8
---
Intro with [[Pump|the pump]] and [[Pump]].

# Orchard

Text [[nowhere]].

```
## Facts
not a fact [[Pump]]
```

## Facts
- [runs_on:: [[Pump]]] [valid:: 2026-01..2026-03] [by:: agent] [src:: [[talk]]] [conf:: 0.5] ^f1
- [status:: active] [at:: 2026-02]
- ~~[status:: planned] [superseded:: 2026-02-03]~~
- [a:: 1] [b:: 2]
no item

## History
- [owner:: "Sam"] [valid:: 2020..2021]

### Deep
more
"""
PUMP = "---\ntype: entity\nkind: tool\ncreated: 2026-01-01\n---\n# Pump\nA pump in [[Orchard]].\n"
TALK = "---\ntype: episode\nstarted: 2026-02-02T10:00:00Z\nby: web\nsource: web\n---\nAlice: about [[pump]]\n"


def test_periods_and_intervals():
    assert notes.period("2026") == (1767225600000, 1798761600000)
    assert notes.period("2026-02") == (1769904000000, 1772323200000)
    assert notes.period("2026-02-30") is None and notes.period("2026-13") is None and notes.period("x") is None
    assert notes.interval("..") == (None, None) and notes.interval("2026..2025") is None
    assert notes.interval("2026 → 2027") == (1767225600000, 1798761600000)
    assert notes.instant("2026-01-01T00:00:00Z") == 1767225600000


def test_a_note():
    n = notes.parse("entities/projects/orchard.md", ENTITY, 5)
    assert (n["id"], n["type"], n["title"], n["importance"], n["created"]) == ("orchard", "entity", "Orchard", 0.8, 1780272000000)
    assert n["aliases"] == ["sensors", "The, Orchard"] and n["tags"] == ["farm", "iot"]
    assert [p["id"] for p in n["passages"]] == ["orchard#0", "orchard#1", "orchard#facts"]
    assert [x["target"] for x in n["links"]] == ["Pump", "Pump", "nowhere"]
    facts = {f["id"]: f for f in n["facts"]}
    assert len(facts) == 4 and facts["f1"]["object"] == "Pump" and facts["f1"]["trust"] == "medium" and facts["f1"]["conf"] == 0.5
    assert [f["status"] for f in n["facts"]] == ["current", "current", "superseded", "historical"]
    assert n["facts"][3]["object"] == "Sam"
    codes = {p["code"] for p in n["problems"]}
    assert {"fact.multiple-predicates", "fact.not-list-item"} <= codes and "note.folder" not in codes


def test_bad_notes_give_problems_not_errors():
    for text in ("", "---\n", "---\ntype: entity\n", "no front matter", "---\ntype: 3\nnested:\n  a: 1\n---\n", "---\ntags:\n  - a\n  - b\n---\n- [x:: [[a]\n"):
        notes.parse("x.md", text, 0)
    assert notes.parse("x.md", "---\ntags:\n  - a\n  - b\n---\n", 0)["tags"] == ["a", "b"]


def files(spark, rows):
    return spark.createDataFrame(rows, "path string, text string, mtime bigint")


BASE = [("entities/orchard.md", ENTITY, 1), ("entities/pump.md", PUMP, 1), ("episodes/talk.md", TALK, 1)]


def test_index(spark):
    built = index.build(vault.parsed(files(spark, BASE)), Config())
    nodes = {r["id"]: r for r in built["nodes"].collect()}
    assert nodes["?nowhere"]["kind"] == "placeholder" and nodes["talk"]["trust"] == "low" and nodes["pump"]["trust"] == "high"
    assert nodes["orchard#facts"]["trust"] == "medium"
    edges = built["edges"].collect()
    weight = {(e["src"], e["dst"]): e["weight"] for e in edges if e["origin"] == "link"}
    assert abs(weight["orchard#0", "pump"] - 1.6931471805599454) < 1e-12 and weight["talk#0", "pump"] == 1.0
    fact = next(e for e in edges if e["type"] == "runs_on")
    assert (fact["dst"], fact["provenance"], fact["trust"], fact["weight"]) == ("pump", "talk", "medium", 0.5)
    assert sum(e["origin"] == "provenance" for e in edges) == 1
    assert next(e for e in edges if e["value"] == "planned")["expired_at"] is not None


def rows_of(built):
    return {k: sorted(map(str, built[k].select(*sorted(c for c in built[k].columns)).collect())) for k in ("nodes", "names", "edges", "files")}


def test_incremental_equals_full(spark):
    old = vault.parsed(files(spark, BASE)).cache()
    before = {k: v.cache() for k, v in index.build(old, Config()).items()}
    changes = {
        "changed": [BASE[0], ("entities/pump.md", PUMP.replace("# Pump", "# Water pump") + "\nnew [[talk]]", 2), BASE[2]],
        "removed, added, touched": [(*BASE[0][:2], 9), BASE[2], ("entities/nowhere.md", PUMP.replace("Pump", "Nowhere"), 2)],
    }
    for rows in changes.values():
        new = vault.parsed(files(spark, rows))
        assert rows_of(index.incremental(before, old, new, Config())) == rows_of(index.build(new, Config()))


def test_vault_on_disk_and_session(spark, tmp_path):
    from memspark.session import MemorySession

    for path, text, _ in [*BASE, ("_meta/x.md", PUMP, 1), (".hidden/x.md", PUMP, 1), ("drafts/a/x.md", PUMP, 1)]:
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    cfg = merged(Config(), {"vault": {"ignore": ("drafts/**",)}, "predicates": {"status": {"object": "link"}}})
    s = MemorySession.open(spark, str(tmp_path), cfg)
    assert {r["path"] for r in s.notes.select("path").collect()} == {p for p, _, _ in BASE}
    q = s.queries("what runs on the pump", "orchard sensors")
    hits = s.recall(q, mode="typed", now=1790000000000).collect()
    assert {h["query_id"] for h in hits} == {0, 1} and all(h["rank"] >= 1 for h in hits)
    assert s.recall(q, mode="auto", now=1790000000000, scope="entities").filter("path LIKE 'episodes%'").count() == 0
    assert s.recall(q.limit(0), mode="auto", now=1790000000000).count() == 0
    paths = s.relate(spark.createDataFrame([(1, "sensors", "talk")], "pair_id int, a string, b string")).collect()
    assert paths[0]["nodes"][0] == "orchard" and paths[0]["nodes"][-1] == "talk"
    line = s.timeline(spark.createDataFrame([("Orchard",)], "name string")).orderBy("nth").collect()
    assert len(line) == 4 and line[0]["valid_from"] is None
    assert {"predicate.object-kind", "fact.multiple-predicates"} <= {r["code"] for r in s.lint().collect()}


def test_slugs_and_triples(spark):
    df = spark.createDataFrame([("Café  Öl!",), ("x" * 150,)], "s string")
    got = [r[0] for r in df.select(index.slug(df["s"])).collect()]
    assert got[0] == "cafe-ol" and len(got[1]) == 100
    built = index.build(vault.parsed(files(spark, BASE)), merged(Config(), {"graph": {"default_extraction": "hipporag"}}))
    p = built["nodes"].filter("id = 'pump#0'").select("id", index.content_hash(built["nodes"]["text"]).alias("h")).head()
    triples = spark.createDataFrame([(p["id"], p["h"], "Pump", "moves", "Water", 0.9), (p["id"], "stale", "Pump", "is", "Old", 0.9)], "passage_id string, content_hash string, subject string, predicate string, object string, conf double")
    phrases, edges = index.triple_edges(triples, built["nodes"], built["names"])
    assert {r["id"] for r in phrases.collect()} == {"p:pump", "p:water"}
    assert {(e["src"], e["dst"], e["type"]) for e in edges.collect()} == {("pump#0", "p:pump", "mentions"), ("pump#0", "p:water", "mentions"), ("p:pump", "p:water", "moves"), ("p:pump", "pump", "names")}


def test_incremental_keeps_triples(spark):
    cfg = merged(Config(), {"graph": {"default_extraction": "hipporag"}})
    old = vault.parsed(files(spark, BASE)).cache()
    nodes = index.nodes_of(old, cfg).filter("kind = 'passage'")
    said = nodes.select(F.col("id").alias("passage_id"), index.content_hash(F.col("text")).alias("content_hash"), F.lit("Pump").alias("subject"), F.lit("moves").alias("predicate"), F.col("id").alias("object"), F.lit(0.9).alias("conf")).cache()
    before = {k: v.cache() for k, v in index.build(old, cfg, said).items()}
    assert before["edges"].filter("origin = 'triple'").count() > 0
    new = vault.parsed(files(spark, [BASE[0], ("entities/pump.md", PUMP + "\nmore", 2), BASE[2]]))
    assert rows_of(index.incremental(before, old, new, cfg, said)) == rows_of(index.build(new, cfg, said))


def test_workspace(spark, tmp_path):
    from memspark import session as S

    root, store = tmp_path / "v", f"file://{tmp_path}/store"
    for path, text, _ in BASE:
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    version = lambda: json.loads((tmp_path / "store" / "index.json").read_text())["version"]
    one = S.MemorySession.open(spark, str(root), store=store)
    assert version() == 1 and S.MemorySession.open(spark, str(root), store=store).nodes.count() == one.nodes.count() and version() == 1
    (root / "entities/pump.md").write_text(PUMP + "\n[[talk]]")
    again = S.MemorySession.open(spark, str(root), store=store)
    assert version() == 2 and again.edges.filter("src = 'pump#0' AND dst = 'talk'").count() == 1
    sessions, vaults = {"p": again, "g": again}, {"g": {}, "p": {"project": "work"}, "other": {"project": "play"}}
    line = S.workspace_timeline(sessions, vaults, ["Orchard"], project="work").groupBy("layer").count().collect()
    assert {(r["layer"], r["count"]) for r in line} == {("project", 4), ("global", 4)}
    pairs = spark.createDataFrame([(1, "sensors", "talk")], "pair_id int, a string, b string")
    assert {r["vault"] for r in S.workspace_relate(sessions, vaults, pairs, project="work").collect()} == {"p"}
    assert {r["vault"] for r in S.workspace_relate(sessions, vaults, pairs, project="work", layer="global").collect()} == {"g"}
    assert S.workspace_relate({}, vaults, pairs) is None and S.workspace_timeline({}, vaults, ["x"]) is None
    ran = S.every_vault({"b": one, "a": None}, lambda s: s.nodes.count())
    assert list(ran) == ["a", "b"] and ran["a"][0] == "failed" and ran["b"][0] == "ok"


def test_remembering_and_the_review_queue(spark):
    from memspark import session as S

    said = spark.createDataFrame([(1, "A walk", "we walked"), (2, "Two parts", "# one\nx\n# two\ny")], "id int, title string, text string")
    got = {r["path"]: r["text"] for r in S.remembered(said, "agent", "2024-02-01").collect()}
    assert len(got) == 3 and got["episodes/2024/02/2024-02-01-a-walk.md"].endswith("# A walk\n\nwe walked\n")
    assert notes.parse("episodes/2024/02/2024-02-01-a-walk.md", got["episodes/2024/02/2024-02-01-a-walk.md"], 1)["by"] == "agent"
    with pytest.raises(ValueError):
        S.remembered(said, "user", "2024-02-01")
    pending = spark.createDataFrame([("k1", "e1", False, 1), ("k2", "e2", True, 5), ("k3", "e1", None, 0)], "key string, episode string, priority boolean, queued_at bigint")
    episodes = spark.createDataFrame([("e1", "bot", "t"), ("e1", "bot", "t")], "episode string, agent string, text string")
    assert [(r["key"], r["agent"]) for r in S.review_queue(pending, episodes).collect()] == [("k2", None), ("k3", "bot"), ("k1", "bot")]
