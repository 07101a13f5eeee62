"""Extraction runs: passages become triples and episodes candidates, and each text is asked once for a model.

Answers are an append-only table: content_hash, model, attempt, reply, code (null for a reply that could be read). A run
asks the distinct texts that have no answer yet, however many passages hold one, and appends what came back in one
write; a run that is lost before it has asked again. A failed call is a row with its code and is asked again by later runs,
up to MOST_ATTEMPTS; it takes nothing from other texts. Changed texts have other hashes, so nothing stale is read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import models
from ..storage import file_of, written
from .consolidate import candidate_key, valid_candidates
from .index import content_hash

MOST_ATTEMPTS = 3
ANSWERS = "content_hash string, model string, attempt int, reply string, code string"
CANDIDATE = "array<struct<subject: string, predicate: string, object: string, confidence: double>>"


@dataclass(frozen=True)
class Task:
    """What a text is asked for: the words before it and the shape of a reply's JSON."""

    prompt: str
    shape: str


TRIPLES = Task("List the facts of this text as a JSON array of subject, predicate, object, conf.\n\n", models.TRIPLE)
CANDIDATES = Task("List what this episode says that should be remembered, as a JSON array of subject, predicate, object, confidence.\n\n", CANDIDATE)


def answers(spark: SparkSession, path: str) -> DataFrame:
    """The last answer to each text and model, with the number of attempts; no rows if nothing was asked."""
    fs, where = file_of(spark, path)
    held = spark.read.schema(ANSWERS).parquet(path) if fs.exists(where) else spark.createDataFrame([], ANSWERS)
    last = held.groupBy("content_hash", "model").agg(F.max_by(F.struct("reply", "code"), "attempt").alias("a"), F.max("attempt").alias("attempts"))
    return last.select("content_hash", "model", "attempts", "a.*")


def due(texts: DataFrame, known: DataFrame, model: str, most_attempts: int = MOST_ATTEMPTS) -> DataFrame:
    """content_hash, text, attempt: the distinct texts (column text; null and empty ones ask nothing) without an answer of this model."""
    each = texts.filter(F.trim("text") != "").select(content_hash(F.col("text")).alias("content_hash"), "text").groupBy("content_hash").agg(F.any_value("text").alias("text"))
    closed = F.col("code").isNull() | (F.col("attempts") >= most_attempts)
    mine = known.filter(F.col("model") == model)
    open_ = each.join(mine.filter(closed), "content_hash", "left_anti")
    return open_.join(mine.select("content_hash", "attempts"), "content_hash", "left").select("content_hash", "text", (F.coalesce("attempts", F.lit(0)) + 1).alias("attempt"))


def run(texts: DataFrame, path: str, task: Task, client: Callable[[], models.Chat], model: str, most_attempts: int = MOST_ATTEMPTS) -> dict[str, int]:
    """Ask what is due and append the answers; how many were asked and how many failed."""
    spark = texts.sparkSession
    # Calls are slow and texts small: as many tasks as there are partitions to shuffle into, dealt by hash.
    todo = written(due(texts, answers(spark, path), model, most_attempts), "due").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "content_hash")
    said = models.asked(todo.withColumn("prompt", F.concat(F.lit(task.prompt), "text")), "prompt", client, "answers")
    code = F.when(F.col("error").isNotNull(), F.col("error")).when(models.json_in("reply", task.shape).isNull(), "malformed")
    rows = written(said.select("content_hash", F.lit(model).alias("model"), "attempt", "reply", code.alias("code")), "answers")
    asked, failed = rows.agg(F.count(F.lit(1)), F.count("code")).head()
    if asked:
        rows.coalesce(max(1, asked // 100_000)).write.mode("append").parquet(path)
    return {"asked": asked, "failed": failed}


def items(things: DataFrame, path: str, task: Task, model: str) -> DataFrame:
    """things (with text) and, for each item of the answer to its text, `nth` and `item`; things without an answer give none."""
    read = answers(things.sparkSession, path).filter((F.col("model") == model) & F.col("code").isNull())
    said = read.select("content_hash", models.json_in("reply", task.shape).alias("_items"))
    met = things.withColumn("content_hash", content_hash(F.col("text"))).join(said, "content_hash")
    return met.select(*[f"`{c}`" for c in things.columns], "content_hash", F.posexplode("_items").alias("nth", "item"))


def triples(passages: DataFrame, path: str, model: str) -> DataFrame:
    """passage_id, content_hash, subject, predicate, object, conf, model of passages (id, text); shapeless triples are dropped."""
    ok: Column = (F.trim("item.subject") != "") & (F.trim("item.object") != "") & F.col("item.predicate").isNotNull()
    each = items(passages.select("id", "text"), path, TRIPLES, model).filter(ok)
    return each.select(F.col("id").alias("passage_id"), "content_hash", "item.subject", "item.predicate", "item.object", F.coalesce("item.conf", F.lit(1.0)).alias("conf"), F.lit(model).alias("model"))


def candidates(episodes: DataFrame, path: str, model: str) -> DataFrame:
    """episode, nth, subject, predicate, object, confidence, key and `dropped` of episodes (id, text)."""
    each = items(episodes.select("id", "text"), path, CANDIDATES, model).select(F.col("id").alias("episode"), "nth", "item.*")
    return valid_candidates(each).withColumn("key", candidate_key(F.col("subject"), F.col("predicate"), F.col("object"), F.col("episode").cast("string")))


def failures(things: DataFrame, path: str, model: str) -> DataFrame:
    """id, code, attempts of the things (id, text) whose text has failed so far."""
    bad = answers(things.sparkSession, path).filter((F.col("model") == model) & F.col("code").isNotNull())
    return things.select("id", content_hash(F.col("text")).alias("content_hash")).join(bad, "content_hash").select("id", "code", "attempts")
