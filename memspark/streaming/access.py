"""The access log as a stream: compaction that never drops a late event, and index maintenance by micro-batch.

No event-time watermark is set: it would drop late rows, and a summary must count each. First and last are least
and greatest, so order doesn't matter; the checkpoint's offsets make each event count once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import new_path

LAST = 10
SUMMARY = "node string, count bigint, first bigint, last bigint, accesses array<bigint>"
STATE = "count bigint, first bigint, last bigint, recent array<bigint>"


def compact_stream(events: DataFrame, last: int = LAST) -> DataFrame:
    """A streaming DataFrame of node summaries, updated with every batch. events: node, t."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, first, latest, recent = state.get if state.exists else (0, None, None, [])
        for b in batches:
            t = b["t"]
            count += len(t)
            first = int(t.min()) if first is None else min(first, int(t.min()))
            latest = int(t.max()) if latest is None else max(latest, int(t.max()))
            recent = sorted([*recent, *map(int, t.nlargest(last))])[-last:]
        state.update((count, first, latest, recent))
        yield pd.DataFrame({"node": [key[0]], "count": [count], "first": [first], "last": [latest], "accesses": [recent]})

    return events.select("node", "t").groupBy("node").applyInPandasWithState(fold, SUMMARY, STATE, "update", GroupStateTimeout.NoTimeout)


def compact_counts(events: DataFrame) -> DataFrame:
    """Counts, first and last by Spark's own streaming aggregate, when the latest times aren't wanted."""
    return events.groupBy("node").agg(F.count(F.lit(1)).alias("count"), F.min("t").alias("first"), F.max("t").alias("last"))


def run_to_end(stream: DataFrame, tag: str, mode: str = "update") -> DataFrame:
    """Run a streaming aggregate over all that is there now; returns the last state of each node."""
    spark = stream.sparkSession
    out, checkpoint = new_path(spark, tag), new_path(spark, tag + "-checkpoint")

    def keep(batch: DataFrame, number: int) -> None:
        # A folder for each batch: one that runs again replaces its own rows.
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(StructType(list(stream.schema.fields)).add("_batch", "integer")).parquet(out)
    newest = rows.groupBy("node").agg(F.max_by(F.struct(*stream.columns), "_batch").alias("v"))
    return newest.select("v.*")


def events_as_stream(spark: SparkSession, folder: str, schema, name: str = "*.parquet", per_batch: int | None = None) -> DataFrame:
    """A folder's Parquet files as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(folder)


def maintain(files: DataFrame, apply: Callable[[DataFrame], None], checkpoint: str):
    """Run `apply` on every batch of changed files; a batch whose apply fails is run again."""
    return files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: apply(batch)).trigger(availableNow=True).start()
