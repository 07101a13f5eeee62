"""Vaults: folders of notes as DataFrames, and the engine's logs and tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..config import Vault
from ..functions.text import glob_pattern
from . import notes

# The logs' schemas.
ACCESS = "t bigint, node string, kind string, q string, session string"
TRIPLES = "passageId string, contentHash string, subject string, predicate string, object string, conf double, model string, extractedAt string"
RECORDS = "v int, key string, subject string, predicate string, object string, episode string, by string, trust string, origin string, reason string, queuedAt bigint, priority boolean"


def scan(spark: SparkSession, root: str, ignore: tuple[str, ...] = (), since: int | None = None) -> DataFrame:
    """path (in the vault), text, mtime of every note: no hidden, _meta or node_modules folders, nothing that a glob ignores.

    Without the text no file is opened. since: only files changed then (epoch milliseconds) or later; older ones aren't opened.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    if since is not None:
        files = files.filter(F.col("modificationTime") >= F.timestamp_millis(F.lit(since)))
    # Spark gives full URIs; what follows the root, with or without a scheme, is the path in the vault.
    skip = len(root.split("://", 1)[-1].rstrip("/")) + 2
    inside = files.withColumn("path", F.regexp_replace("path", r"^[a-z0-9]+:/*/", "/")).withColumn("path", F.expr(f"substring(path, {skip})"))
    kept = inside.filter(~F.col("path").rlike(r"(^|/)(\.|_meta/|node_modules/)"))
    for g in ignore:
        kept = kept.filter(~F.col("path").rlike(glob_pattern(g)))
    return kept.select("path", F.decode("content", "utf-8").alias("text"), F.unix_millis("modificationTime").alias("mtime"))


def parsed(files: DataFrame, vault: Vault = Vault()) -> DataFrame:
    """Notes as nested rows from path, text, mtime."""
    schema = StructType.fromDDL(notes.SCHEMA)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                rows = zip(*(b.column(c).to_pylist() for c in ("path", "text", "mtime")), strict=True)
                yield from pa.Table.from_pylist(list(notes.parse_all(rows, vault)), schema=arrow).to_batches()

    return files.select("path", "text", "mtime").mapInArrow(run, schema)


def read_vault(spark: SparkSession, root: str, vault: Vault = Vault()) -> DataFrame:
    return parsed(scan(spark, root, vault.ignore), vault)


def read_access(spark: SparkSession, path: str) -> DataFrame:
    """The access log; malformed lines and lines without a node or a time are dropped."""
    return spark.read.schema(ACCESS).option("mode", "DROPMALFORMED").json(path).filter("t IS NOT NULL AND node IS NOT NULL")


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_triples(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(triples, bad lines)."""
    raw = spark.read.schema(TRIPLES + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    ok = F.col("_bad").isNull() & F.col("passageId").isNotNull() & F.col("subject").isNotNull() & F.col("object").isNotNull()
    return raw.filter(ok).drop("_bad"), raw.filter(~ok).select(F.coalesce("_bad", F.lit("")).alias("line"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Pending or rejected records, those with priority first."""
    return spark.read.schema(RECORDS).option("mode", "DROPMALFORMED").json(path).filter("key IS NOT NULL").orderBy(F.coalesce("priority", F.lit(False)).desc(), "queuedAt", "key")


def tolerant_json(text: str, schema: str):
    """A struct from a JSON text, or from a fenced block in it; null if there is none."""
    block = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.coalesce(F.from_json(F.col(text), schema), F.from_json(F.nullif(block, F.lit("")), schema))


def versions_at(versions: DataFrame, times: DataFrame) -> DataFrame:
    """For each t of times the text of each path at its last commit up to t. versions: path, committed_at, hash, text."""
    met = versions.join(F.broadcast(times), F.col("committed_at") <= F.col("t"))  # a few moments
    return met.groupBy("path", "t").agg(F.max_by(F.struct("committed_at", "hash", "text"), F.struct("committed_at", "hash")).alias("v")).select("path", "t", "v.*")


def folder_hash(files: DataFrame) -> DataFrame:
    """One row: a hash over the files' sorted (path, content hash)."""
    return files.select(F.concat_ws("\u0000", "path", F.sha2("text", 256)).alias("x")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("x")), "\n"), 256).alias("hash"))


def episode_paths(episodes: DataFrame) -> DataFrame:
    """episodes (title, started date, body) with id and path; equal slugs of a day are numbered."""
    slug = F.regexp_replace(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    named = episodes.withColumn("_slug", F.concat_ws("-", F.date_format("started", "yyyy-MM-dd"), slug))
    nth = F.row_number().over(Window.partitionBy("_slug").orderBy("body"))
    named = named.withColumn("id", F.when(nth > 1, F.concat_ws("-", "_slug", nth.cast("string"))).otherwise(F.col("_slug")))
    return named.withColumn("path", F.concat(F.lit("episodes/"), F.date_format("started", "yyyy/MM/"), F.col("id"), F.lit(".md"))).drop("_slug")


def eval_questions(spark: SparkSession, path: str) -> DataFrame:
    """query_id, text, answer, kind of a local question set: a JSON array of records with a question, or with a list `qa`."""
    raw = spark.read.option("multiLine", True).json(path)
    if "qa" in raw.columns:
        raw = raw.select(F.posexplode("qa").alias("n", "q"), *[c for c in raw.columns if c != "qa"]).select("q.*", F.col("n").alias("question_id"))
    kind = F.coalesce(*[F.col(c).cast("string") for c in ("question_type", "category") if c in raw.columns], F.lit("single-hop"))
    return raw.select(F.col("question_id").cast("string").alias("query_id"), F.col("question").alias("text"), F.col("answer").cast("string").alias("answer"), kind.alias("kind"))
