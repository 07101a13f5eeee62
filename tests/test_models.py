"""Model connectors with recorded replies, stems, recognition, proposals and consolidation's smaller rules."""

import http.server
import json
import threading

import pytest

from memspark.functions.porter import stem
from memspark.operators import consolidate, dreams, federate, index, keyword
from memspark.sources import models


def test_stems():
    pairs = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "vietnamization": "vietnam", "triplicate": "triplic", "hopefulness": "hope", "adoption": "adopt", "controll": "control", "rate": "rate", "sky": "sky", "é": "é"}
    assert {w: stem(w) for w in pairs} == pairs


def test_stemmed_search(spark):
    p = spark.createDataFrame([("a", "motoring hopes"), ("b", "nothing here")], "passage_id string, text string")
    q = spark.createDataFrame([(1, "motored hope")], "query_id int, text string")
    assert keyword.bm25_search(q, p, 5).count() == 0
    assert [r["passage_id"] for r in keyword.bm25_search(q, p, 5, stem=True).collect()] == ["a"]


def test_http_clients_retry():
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["content-length"])))
            seen.append(body)
            if len(seen) == 1:
                self.send_response(503)
                self.end_headers()
                return
            out = {"data": [{"embedding": [1.0, 2.0]} for _ in body["input"]]} if "input" in body else {"choices": [{"message": {"content": "hi"}}]}
            self.send_response(200 if body.get("model") != "bad" else 400)
            self.end_headers()
            self.wfile.write(json.dumps(out).encode())

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    assert models.HttpChat(url, "m").reply("x") == "hi" and len(seen) == 2
    assert models.HttpEmbedder(url, "m", batch=2).vectors(["a", "b", "c"]) == [[1.0, 2.0]] * 3
    with pytest.raises(models.ModelError):
        models.HttpChat(url, "bad").reply("x")
    server.shutdown()


def test_triples_recognition_and_proposals(spark):
    passages = spark.createDataFrame([("n#0", "Pumps move water."), ("n#1", "Nothing.")], "id string, text string")
    todo = models.stale_passages(passages, spark.createDataFrame([("n#1", "x", "m")], "passage_id string, content_hash string, model string"), "m")
    assert todo.count() == 2
    reply = 'Here:\n```json\n[{"subject": "Pump", "predicate": "moves", "object": "Water"}, {"subject": " ", "predicate": "x", "object": "y"}]\n```'
    triples = models.extracted_triples(todo.filter("id = 'n#0'"), lambda: models.RecordedChat(otherwise=reply), "m")
    assert [(r["passage_id"], r["subject"], r["conf"]) for r in triples.collect()] == [("n#0", "Pump", 1.0)]
    assert models.stale_passages(passages, triples, "m").count() == 1
    near = spark.createDataFrame([(1, "n#0", 1), (1, "n#1", 2)], "query_id int, passage_id string, rank int")
    asked = spark.createDataFrame([(1, "what moves water")], "query_id int, text string")
    good = models.recognised(near, triples, asked, lambda: models.RecordedChat(otherwise="0.8")).collect()
    assert [(r["passage_id"], r["confidence"]) for r in good] == [("n#0", 0.9)]
    assert models.recognised(near, triples, asked, lambda: models.RecordedChat(otherwise="0.1")).count() == 0
    pairs = spark.createDataFrame([("a", "b", "the long quote of a", "the long quote of b"), ("c", "d", "x", "y")], "a string, b string, text_a string, text_b string")
    said = json.dumps({"association": {"gist": "both", "quote_a": "the long quote of a", "quote_b": "long  quote of b", "confidence": 0.5}})
    got = dreams.accepted(models.proposed(pairs, lambda: models.RecordedChat(otherwise=said))).orderBy("a").collect()
    assert [r["kept"] for r in got] == [True, False] and got[0]["code"] is None
    codes = [models.proposed(pairs, lambda r=r: models.RecordedChat(otherwise=r)).orderBy("a").head()["code"] for r in ('{"association": null}', "no json", None)]
    assert codes == ["none", "malformed", "none"]
    vectors = models.embedded(passages, models.TrigramEmbedder, "trigrams").collect()
    assert len(vectors[0]["vector"]) == 256 and abs(sum(x * x for x in vectors[0]["vector"]) - 1) < 1e-5


def test_review_lift_and_candidates(spark):
    pending = spark.createDataFrame([("k1", "a"), ("k2", "b"), ("k3", "c")], "key string, object string")
    decisions = spark.createDataFrame([("k1", "accept", None), ("k2", "edit", "z")], "key string, decision string, object string")
    got = {r["key"]: (r["state"], r["object"]) for r in consolidate.reviewed(pending, decisions).collect()}
    assert got == {"k1": ("accepted", "a"), "k2": ("accepted", "z"), "k3": ("pending", "c")}
    rows = spark.createDataFrame([("Sam", "likes", "tea", 0.5), ("Sam", "Likes", "tea", 0.5), ("a/b.ts", "likes", "tea", 0.5), ("Sam", "likes", " ", None), ("Sam", "likes", "x", 2.0)], "subject string, predicate string, object string, confidence double")
    assert [r["dropped"] for r in consolidate.valid_candidates(rows).collect()] == [False, True, True, True, True]
    facts = spark.createDataFrame([("s", "runs_on", "p", None)], "src string, type string, dst string, value string")
    assert consolidate.lifted(facts, "vault-a", "2026-01-01").head()["text"] == "s runs on p"


def test_lineage_and_targets():
    vaults = {"g": {}, "p": {"project": "x"}, "a": {"agent": "bot"}, "pa": {"project": "x", "agent": "bot"}, "sib": {"project": "y"}}
    assert federate.lineage(vaults, "x", "bot") == [("agent", "pa"), ("project", "p"), ("global-agent", "a"), ("global", "g")]
    assert federate.lineage(vaults, "x") == [("project", "p"), ("global", "g")] and federate.lineage(vaults) == [("global", "g")]
    assert federate.write_target({"writes": {"default": "d", "agents": {"bot": "b"}}}, "bot") == "b" and federate.write_target({}) == "self"


def test_synonyms_are_capped_and_trusted(spark):
    rows = [("p:a", [1.0, 0.0], "high"), ("p:b", [0.9, 0.1], "low"), ("p:c", [0.0, 1.0], "high"), ("p:d", [0.1, 0.9], None), ("p:e", None, "high")]
    df = spark.createDataFrame(rows, "id string, vector array<float>, trust string")
    got = [(r["src"], r["dst"], r["trust"]) for r in index.synonym_edges(df, 0.7, 3).collect()]
    assert sorted(got) == [("p:a", "p:b", "low"), ("p:c", "p:d", "low")]
    assert index.synonym_edges(df, 0.7, 1).count() == 1
