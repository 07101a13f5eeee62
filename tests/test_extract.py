"""Extraction runs: what is asked, what is kept, and what a failure costs."""

import json
from dataclasses import dataclass

from memspark.operators import extract
from memspark.sources import models
from memspark.storage import new_path


@dataclass
class Says:
    """Answers with the text's first and last words; 'bad' isn't JSON, 'down' fails until `up`."""

    up: bool = False
    field: str = "conf"

    def reply(self, prompt):
        text = prompt.rpartition("\n\n")[2]
        if "down" in text and not self.up:
            raise models.ModelError("timeout")
        if "bad" in text:
            return "I can't say."
        first, *_, last = text.split()
        return "Here:\n```json\n" + json.dumps([{"subject": first, "predicate": "goes_with", "object": last, self.field: 0.9}, {"subject": " ", "predicate": "x", "object": "y"}]) + "\n```"


ROWS = [("a", "Pumps move water"), ("b", "Pumps move water"), ("c", "bad reply here"), ("d", "the line is down"), ("e", None), ("f", " "), ("g", "Rain falls")]


def test_a_second_run_asks_nothing_and_a_bad_reply_loses_one_text(spark):
    path = new_path(spark, "answers")
    passages = spark.createDataFrame(ROWS, "id string, text string")
    assert extract.triples(passages, path, "m").count() == 0
    # Equal texts are asked once; null and blank ones never.
    assert extract.run(passages, path, extract.TRIPLES, Says, "m") == {"asked": 4, "failed": 2}
    got = {(r["passage_id"], r["subject"], r["object"], r["conf"]) for r in extract.triples(passages, path, "m").collect()}
    assert got == {("a", "Pumps", "water", 0.9), ("b", "Pumps", "water", 0.9), ("g", "Rain", "falls", 0.9)}
    assert {(r["id"], r["code"], r["attempts"]) for r in extract.failures(passages, path, "m").collect()} == {("c", "malformed", 1), ("d", "timeout", 1)}
    # Failures are asked again, the rest isn't; what comes right stays right.
    assert extract.run(passages, path, extract.TRIPLES, lambda: Says(up=True), "m") == {"asked": 2, "failed": 1}
    assert extract.run(passages, path, extract.TRIPLES, lambda: Says(up=True), "m") == {"asked": 1, "failed": 1}
    assert extract.run(passages, path, extract.TRIPLES, lambda: Says(up=True), "m") == {"asked": 0, "failed": 0}
    assert {r["id"]: r["attempts"] for r in extract.failures(passages, path, "m").collect()} == {"c": extract.MOST_ATTEMPTS}
    assert extract.triples(passages, path, "m").count() == 4
    # A changed text and another model are new questions; a text that comes back isn't.
    changed = spark.createDataFrame([("a", "Pumps move oil"), *ROWS[1:]], "id string, text string")
    assert extract.run(changed, path, extract.TRIPLES, Says, "m")["asked"] == 1
    assert {r["passage_id"]: r["object"] for r in extract.triples(changed, path, "m").filter("passage_id < 'c'").collect()} == {"a": "oil", "b": "water"}
    assert extract.run(passages, path, extract.TRIPLES, Says, "m")["asked"] == 0
    assert extract.run(passages, path, extract.TRIPLES, lambda: Says(up=True), "n") == {"asked": 4, "failed": 1}


def test_episodes_become_candidates(spark):
    path = new_path(spark, "answers")
    episodes = spark.createDataFrame([(1, "Ann moved Paris"), (2, "bad day"), (3, "src/a.ts uses sed")], "id int, text string")
    assert extract.run(episodes, path, extract.CANDIDATES, lambda: Says(field="confidence"), "m") == {"asked": 3, "failed": 1}
    got = extract.candidates(episodes, path, "m").collect()
    assert {(r["episode"], r["nth"], r["subject"], r["dropped"]) for r in got} == {(1, 0, "Ann", False), (1, 1, " ", True), (3, 0, "src/a.ts", True), (3, 1, " ", True)}
    empty = spark.createDataFrame([], "id int, text string")
    assert extract.run(empty, path, extract.CANDIDATES, Says, "m") == {"asked": 0, "failed": 0} and extract.candidates(empty, path, "m").count() == 0
