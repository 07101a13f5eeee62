"""Pluggable models: HTTP clients, recorded replies and deterministic stand-ins, and the columns they fill.

A client is made once a task from a picklable factory. Calls are never part of an expression that Spark may run
again: what a model says is written to a table first. Failures are rows with an error code, not failed jobs.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.vectors import embed
from ..operators.index import content_hash
from ..storage import written


class Chat(Protocol):
    def reply(self, prompt: str) -> str: ...


class Embedder(Protocol):
    model: str

    def vectors(self, texts: list[str]) -> list[list[float]]: ...


class ModelError(Exception):
    """A call that gave nothing; code is one of timeout, http-error, malformed, none."""

    def __init__(self, code: str, message: str = "", transient: bool = False):
        super().__init__(message or code)
        self.code, self.transient = code, transient


def post(url: str, body: dict, token: str | None, timeout: float, attempts: int, delay: float = 0.5, most_delay: float = 8.0) -> Any:
    """A JSON reply; fast failures that may pass (429, 5xx, no connection, a broken body) are tried again, ever later."""
    headers = {"content-type": "application/json"} | ({"authorization": f"Bearer {token}"} if token else {})
    for attempt in range(attempts):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=timeout) as r:
                return json.loads(r.read())
        except TimeoutError as e:
            raise ModelError("timeout") from e
        except urllib.error.HTTPError as e:
            error = ModelError("http-error", str(e.code), e.code == 429 or e.code >= 500)
        except urllib.error.URLError as e:
            error = ModelError("timeout" if isinstance(e.reason, TimeoutError) else "http-error", str(e), not isinstance(e.reason, TimeoutError))
        except ValueError as e:
            error = ModelError("malformed", str(e), True)
        if not error.transient or attempt == attempts - 1:
            raise error
        time.sleep(min(delay * 2**attempt, most_delay))


@dataclass
class HttpChat:
    url: str
    model: str
    token: str | None = None
    timeout: float = 60.0
    attempts: int = 3

    def reply(self, prompt: str) -> str:
        got = post(self.url, {"model": self.model, "messages": [{"role": "user", "content": prompt}]}, self.token, self.timeout, self.attempts)
        try:
            return got["choices"][0]["message"]["content"]
        except (KeyError, IndexError, TypeError) as e:
            raise ModelError("malformed") from e


@dataclass
class HttpEmbedder:
    url: str
    model: str
    token: str | None = None
    batch: int = 32

    def vectors(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for i in range(0, len(texts), self.batch):
            part = texts[i : i + self.batch]
            got = post(self.url, {"input": part, "model": self.model}, self.token, 60.0, 2).get("data")
            if not isinstance(got, list) or len(got) != len(part) or not all(isinstance(d.get("embedding"), list) for d in got):
                raise ModelError("malformed")
            out += [d["embedding"] for d in got]
        return out


@dataclass
class RecordedChat:
    """Replies by the SHA-256 of the prompt; an unknown prompt is an error, or gives `otherwise`."""

    replies: dict[str, str] = field(default_factory=dict)
    otherwise: str | None = None

    @staticmethod
    def key(prompt: str) -> str:
        return hashlib.sha256(prompt.encode()).hexdigest()

    def reply(self, prompt: str) -> str:
        got = self.replies.get(self.key(prompt), self.otherwise)
        if got is None:
            raise ModelError("none")
        return got


@dataclass
class WordJudge:
    """A stand-in for a model that judges facts: the share of a fact's two ends that are words of the question."""

    def reply(self, prompt: str) -> str:
        question, _, fact = prompt.rpartition("\nFact: ")
        known = set(re.findall(r"\w+", question.partition("\nQuestion: ")[2].lower()))
        ends = fact.split(" ")
        return str(((ends[0] in known) + (ends[-1] in known)) / 2)


@dataclass
class FirstWords:
    """A stand-in for a model that lists facts: a text's first two runs of small letters; plain words where it has fewer."""

    def reply(self, prompt: str) -> str:
        words = re.findall("[a-z]+", prompt.partition("\n\n")[2])
        return json.dumps([{"subject": words[0], "predicate": "before", "object": words[1], "conf": 0.9}]) if len(words) > 1 else "There are none."


@dataclass
class TrigramEmbedder:
    """Vectors of hashed trigrams: no model, the same everywhere."""

    model: str = "trigrams"

    def vectors(self, texts: list[str]) -> list[list[float]]:
        return [embed(t) for t in texts]


def asked(rows: DataFrame, prompt: str, client: Callable[[], Chat], tag: str = "replies") -> DataFrame:
    """rows with `reply` and `error`, written once: each row's prompt is one call, a failed call is an error code."""
    schema = StructType(list(rows.schema.fields)).add("reply", "string").add("error", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = client()
        for b in batches:
            replies, errors = [], []
            for p in b.column(prompt).to_pylist():
                try:
                    replies.append(model.reply(p))
                    errors.append(None)
                except ModelError as e:
                    replies.append(None)
                    errors.append(e.code)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(replies, pa.string()), pa.array(errors, pa.string())], names=[*b.schema.names, "reply", "error"])

    return written(rows.mapInArrow(run, schema), tag)


def embedded(passages: DataFrame, client: Callable[[], Embedder], model: str) -> DataFrame:
    """id, vector, vector_model of passages (id, text), written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = client()
        for b in batches:
            if b.num_rows:
                found = c.vectors([t or "" for t in b.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found, pa.list_(pa.float32()))], names=["id", "vector"])

    kind = passages.schema["id"].dataType.simpleString()
    return written(passages.select("id", "text").mapInArrow(run, f"id {kind}, vector array<float>"), "vectors").withColumn("vector_model", F.lit(model))


def json_in(reply: str, schema: str):
    """A reply's JSON, bare or in a fenced block; null if it has none of that shape."""
    block = F.nullif(F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit(""))
    text = F.coalesce(block, F.trim(F.col(reply)))
    return F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, schema))


TRIPLE = "array<struct<subject: string, predicate: string, object: string, conf: double>>"


def stale_passages(passages: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Passages (id, text) without triples of this text and model in the cache (passage_id, content_hash, model)."""
    hashed = passages.withColumn("content_hash", content_hash(F.col("text")))
    known = cache.filter(F.col("model") == model).select(F.col("passage_id").alias("id"), "content_hash").distinct()
    return hashed.join(known, ["id", "content_hash"], "left_anti")


def extracted_triples(passages: DataFrame, client: Callable[[], Chat], model: str) -> DataFrame:
    """passage_id, content_hash, subject, predicate, object, conf, model of passages (id, text, content_hash)."""
    prompts = passages.withColumn("prompt", F.concat(F.lit("List the facts of this text as a JSON array of subject, predicate, object, conf.\n\n"), "text"))
    said = asked(prompts, "prompt", client, "triples").withColumn("t", F.explode(json_in("reply", TRIPLE)))
    ok = "trim(t.subject) <> '' AND trim(t.object) <> '' AND t.predicate IS NOT NULL"
    return said.filter(ok).select(F.col("id").alias("passage_id"), "content_hash", "t.subject", "t.predicate", "t.object", F.coalesce("t.conf", F.lit(1.0)).alias("conf"), F.lit(model).alias("model"))


def recognised(nearest: DataFrame, triples: DataFrame, queries: DataFrame, client: Callable[[], Chat], most: int = 10, least: float = 0.7) -> DataFrame:
    """query_id, passage_id, confidence: passages whose triples a model finds to the query's point.

    nearest: query_id, passage_id, rank (a vector search). The first `most` triples of the nearest passages are
    judged; a triple's confidence is the mean of 1 and the judgement.
    """
    order = Window.partitionBy("query_id").orderBy("rank", "passage_id", "subject", "predicate", "object")
    some = nearest.join(triples, "passage_id").withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most).join(queries.select("query_id", "text"), "query_id")
    prompt = F.concat(F.lit("From 0 to 1, how much does this fact help to answer?\nQuestion: "), "text", F.lit("\nFact: "), F.concat_ws(" ", "subject", "predicate", "object"))
    judged = asked(some.withColumn("prompt", prompt), "prompt", client, "judged")
    score = F.expr("try_cast(regexp_extract(reply, '([01](?:[.][0-9]+)?)', 1) AS DOUBLE)")
    return judged.withColumn("confidence", (1.0 + score) / 2).filter(F.col("confidence") >= least).groupBy("query_id", "passage_id").agg(F.max("confidence").alias("confidence"))


ASSOCIATION = "association struct<gist: string, quote_a: string, quote_b: string, confidence: double>"


def proposed(pairs: DataFrame, client: Callable[[], Chat]) -> DataFrame:
    """pairs (a, b, text_a, text_b) with gist, quotes, confidence and `code`: why a pair gave nothing (none: the model saw no link)."""
    prompt = F.concat(F.lit('Is there a remote link between these notes? Answer {"association": null} or {"association": {"gist", "quote_a", "quote_b", "confidence"}}.\nA: '), "text_a", F.lit("\nB: "), "text_b")
    said = asked(pairs.withColumn("prompt", prompt), "prompt", client, "associations").withColumn("j", json_in("reply", ASSOCIATION))
    code = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("j").isNull(), "malformed").when(F.col("j.association").isNull(), "none")
    return said.withColumn("code", code).select(*pairs.columns, "j.association.*", "code")
