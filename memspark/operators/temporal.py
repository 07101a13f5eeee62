"""Bi-temporal facts: versions, timelines, as-of reads and supersession."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config, Predicate
from ..functions.scoring import mapped


def versions(rows: DataFrame, key: list[str], at: str, tie: str) -> DataFrame:
    """rows as facts: valid from their time to the next one's of the same key."""
    order = Window.partitionBy(*key).orderBy(at, tie)
    return rows.withColumns({"valid_from": F.col(at), "valid_to": F.lead(at).over(order)})


def status(expired: Column, valid_to: Column) -> Column:
    return F.when(expired.isNotNull(), "superseded").when(valid_to.isNotNull(), "historical").otherwise("current")


def timeline(facts: DataFrame, entities: DataFrame, predicates: dict[str, Predicate] | None = None) -> DataFrame:
    """Each entity's facts as subject and as object (by the inverse name), with `nth` in time order, nulls first.

    facts: id, src, dst, value, type, valid_from, valid_to, recorded_at, expired_at; entities: entity.
    """
    inverses = {k: p.inverse for k, p in (predicates or {}).items() if p.inverse}
    mine = facts.join(entities, F.col("src") == F.col("entity")).withColumn("as_object", F.lit(False))
    # A loop is one row, as the subject's.
    other = facts.filter("dst IS NOT NULL AND dst <> src").join(entities, F.col("dst") == F.col("entity")).withColumn("as_object", F.lit(True))
    both = mine.unionByName(other)
    inverse = mapped(F.col("type"), inverses) if inverses else F.lit(None).cast("string")
    out = both.withColumns({
        "predicate": F.when(F.col("as_object"), F.coalesce(inverse, F.col("type"))).otherwise(F.col("type")),
        "inverse": F.col("as_object") & inverse.isNotNull(),
        "object": F.when(F.col("as_object"), F.col("src")).otherwise(F.coalesce("dst", "value", F.lit(""))),
        "status": status(F.col("expired_at"), F.col("valid_to")),
    })
    order = Window.partitionBy("entity").orderBy(F.col("valid_from").asc_nulls_first(), F.col("recorded_at").asc_nulls_first(), "id")
    return out.withColumn("nth", F.row_number().over(order))


def as_of_rows(rows: DataFrame, times: DataFrame, key: list[str], at: str, value: list[str]) -> DataFrame:
    """For each of times (key, t), the latest row at or before it. The key is an equi-join, so the time range only filters."""
    met = rows.join(times, key).filter(F.col(at) <= F.col("t"))
    return met.groupBy(*key, "t").agg(F.max_by(F.struct(at, *value), F.struct(F.col(at), *value)).alias("_v")).select(*key, "t", "_v.*")


def superseded(current: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """current with the facts that new ones of the same (src, type) and another object close, and the new ones.

    A new fact closes at its own valid_from unless that would turn the interval around. New facts of one key are
    taken in time order, each closing the one before, so a chain comes out as if applied one by one.
    """
    order = Window.partitionBy("src", "type").orderBy("valid_from", "id")
    chain = new.withColumn("valid_to", F.coalesce(F.lead("valid_from").over(order), F.col("valid_to"))).withColumn("expired_at", F.when(F.lead("valid_from").over(order).isNotNull(), F.lit(now)))
    first = new.groupBy("src", "type").agg(F.min_by("object", F.struct("valid_from", "id")).alias("_object"), F.min("valid_from").alias("_from"))
    old = current.join(first, ["src", "type"], "left")
    closes = F.col("expired_at").isNull() & F.col("_object").isNotNull() & (F.col("_object") != F.col("object")) & (F.col("valid_from").isNull() | (F.col("valid_from") <= F.col("_from")))
    old = old.withColumns({"expired_at": F.when(closes, F.lit(now)).otherwise(F.col("expired_at")), "valid_to": F.when(closes, F.least(F.coalesce("valid_to", "_from"), F.col("_from"))).otherwise(F.col("valid_to"))}).drop("_object", "_from")
    return old.unionByName(chain.select(old.columns))


def cardinality_violations(facts: DataFrame, cfg: Config) -> DataFrame:
    """src, type, n for single-valued predicates with more than one current fact."""
    single = [k for k, p in cfg.predicates.items() if p.cardinality == "one"]
    return facts.filter(F.col("type").isin(single) & F.col("expired_at").isNull() & F.col("valid_to").isNull()).groupBy("src", "type").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
