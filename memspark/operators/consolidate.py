"""Consolidation: candidate facts through a gate, as sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.scoring import source_weight, support_confidence
from ..functions.text import short_hash

# File endings that a name of a thing doesn't have.
FILE_ENDINGS = "ts tsx js mjs cjs jsx json md txt yml yaml py rb go rs sh css scss html sql toml lock"


def plausible_name(name: Column) -> Column:
    """Whether a name can be a thing's: no path, hash, number or file."""
    s = F.trim(name)
    return (F.length(s) <= 80) & ~s.rlike(r"[/\\]") & ~s.rlike(r"(?i)^[0-9a-f]{7,40}$") & ~s.rlike(r"^[0-9]+$") & ~s.rlike(rf"(?i)\.({FILE_ENDINGS.replace(' ', '|')})$")


def valid_candidates(rows: DataFrame) -> DataFrame:
    """Rows with `dropped`: candidates of the wrong shape are kept apart, not lost."""
    ok = F.col("predicate").rlike("^[a-z][a-z0-9_]*$") & (F.trim("subject") != "") & (F.trim("object") != "") & F.coalesce("confidence", F.lit(1.0)).between(0, 1) & plausible_name(F.col("subject"))
    return rows.withColumn("dropped", ~F.coalesce(ok, F.lit(False)))


def resolve(candidates: DataFrame, names: DataFrame, column: str, into: str) -> DataFrame:
    """candidates with `into`: the node that the name means, by the lowest tier; null if none."""
    best = names.groupBy("name").agg(F.min_by("node_id", F.struct("tier", "node_id")).alias(into))
    return candidates.join(best.withColumnRenamed("name", "_name"), F.lower(F.col(column)) == F.col("_name"), "left").drop("_name")


#: Hex digits by which rows are told apart: those of an id (40 bits) meet by chance among some million rows.
WHOLE = 64


def candidate_key(subject: Column, predicate: Column, obj: Column, src: Column, n: int = 10) -> Column:
    return short_hash(subject, predicate, obj, src, n=n)


def new_candidates(candidates: DataFrame, seen: DataFrame, order: str, key: str = "key") -> DataFrame:
    """The first candidate of each key that isn't among the seen keys."""
    fresh = candidates.join(seen.select(key).distinct(), key, "left_anti")
    return fresh.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_nth = 1").drop("_nth")


def with_support(candidates: DataFrame, pending: DataFrame, order: str) -> DataFrame:
    """candidates with `support`: the weights of the distinct episodes that made the claim, pending ones and this run's up to here.

    candidates and pending have claim, episode, by.
    """
    before = pending.groupBy("claim", "episode").agg(F.first("by").alias("by")).select("claim", "episode", source_weight(F.col("by")).alias("w"))
    old = before.groupBy("claim").agg(F.sum("w").cast("double").alias("_old"))
    fresh = candidates.join(before.select("claim", "episode", F.lit(True).alias("_known")), ["claim", "episode"], "left")
    once = F.row_number().over(Window.partitionBy("claim", "episode").orderBy(order)) == 1
    fresh = fresh.withColumn("_w", F.when(once & F.col("_known").isNull(), source_weight(F.col("by"))).otherwise(0).cast("double"))
    so_far = F.sum("_w").over(Window.partitionBy("claim").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    out = fresh.withColumn("_new", so_far).join(old, "claim", "left")
    out = out.withColumn("support", F.col("_new") + F.coalesce("_old", F.lit(0.0)))
    return out.withColumn("confidence_by_support", support_confidence(F.col("support"))).drop("_w", "_new", "_old", "_known")


def gate(rows: DataFrame, cfg: Config) -> DataFrame:
    """rows with `action` (promote, queue, supersede, noop) and `reason`, the first rule that holds.

    rows: by, trust, origin, explicit, predicate, subject_ref, same_object and conflict_from, has_conflict (of the
    current facts of the same predicate), claimed_at, support, rejected.
    """
    known = F.col("predicate").isin(list(cfg.predicates))
    single = F.col("predicate").isin([k for k, p in cfg.predicates.items() if p.cardinality == "one"])
    named = F.col("subject_ref").isNotNull()
    both = known & named
    clash = both & single & F.col("has_conflict")
    older = clash & (F.col("conflict_from") > F.col("claimed_at"))
    enough = F.lit(cfg.consolidation.corroboration) & ~F.col("rejected") & (F.col("support") >= cfg.consolidation.min_support)
    rules = [
        (F.col("by").isin("web", "tool") | (F.col("trust") == "low"), "queue", F.lit("untrusted source")),
        (F.col("origin") == "triple", "queue", F.lit("derived from triple cache")),
        (both & F.col("same_object"), "noop", F.lit("corroborates a current fact")),
        (F.coalesce(older, F.lit(False)), "queue", F.lit("older than the current fact")),
        (clash & (F.col("by") == "user") & F.col("explicit"), "supersede", F.lit("contradicts a current fact (user-confirmed)")),
        (clash, "queue", F.lit("contradicts a current fact")),
        (both, "promote", F.lit("known entity + known predicate + no conflict")),
        (enough, "promote", F.concat(F.lit("corroborated by "), F.format_string("%.0f", "support"), F.lit(" independent episode(s)"))),
        (F.lit(True), "queue", F.concat_ws(", ", F.when(~named, "new entity"), F.when(~known, "unknown predicate"))),
    ]
    action, reason = F, F
    for holds, what, why in rules:
        action, reason = action.when(holds, F.lit(what)), reason.when(holds, why)
    return rows.withColumns({"action": action, "reason": reason})


def against_current(candidates: DataFrame, current: DataFrame) -> DataFrame:
    """candidates (subject_ref, predicate, object) with what current facts (src, type, object, valid_from) say: same_object, has_conflict, conflict_from."""
    facts = current.groupBy(F.col("src").alias("subject_ref"), F.col("type").alias("predicate")).agg(F.collect_set("object").alias("_objects"), F.min_by("valid_from", F.struct("valid_from", "object")).alias("conflict_from"))
    out = candidates.join(facts, ["subject_ref", "predicate"], "left")
    return out.withColumns({"same_object": F.coalesce(F.array_contains("_objects", F.col("object")), F.lit(False)), "has_conflict": F.col("_objects").isNotNull()}).drop("_objects")


def priority(candidates: DataFrame, recalled: DataFrame) -> DataFrame:
    """candidates with `priority`: the subject was recalled in the candidate's session. recalled: session, node."""
    seen = recalled.select("session", F.col("node").alias("subject_ref"), F.lit(True).alias("priority")).distinct()
    return candidates.join(seen, ["session", "subject_ref"], "left").withColumn("priority", F.coalesce("priority", F.lit(False)))


def left_pending(pending: DataFrame, promoted: DataFrame) -> DataFrame:
    """The queue without the claims that were promoted."""
    return pending.join(promoted.select("claim").distinct(), "claim", "left_anti")


def unconsolidated(episodes: DataFrame, state: DataFrame) -> DataFrame:
    """Episodes (path, body, consolidated) never consolidated, or with another body hash than the state (path, body_hash) recorded."""
    hashed = episodes.withColumn("body_hash", F.sha2("body", 256)).join(state.select("path", F.col("body_hash").alias("_old")), "path", "left")
    return hashed.filter(F.col("consolidated").isNull() | ~F.col("body_hash").eqNullSafe(F.col("_old"))).drop("_old")


def reflections(facts: DataFrame, least: float = 3.0) -> DataFrame:
    """node, importance, sources: subjects whose facts' confidences add up to a schema note."""
    return facts.groupBy(F.col("src").alias("node")).agg(F.sum("conf").alias("importance"), F.sort_array(F.collect_set("provenance")).alias("sources")).filter(F.col("importance") >= least)


def triple_candidates(triples: DataFrame, promoted: DataFrame, least: float = 0.8) -> DataFrame:
    """Cached triples that are sure enough and whose passage changed since they were last promoted."""
    sure = triples.filter(F.col("conf") >= least)
    return sure.join(promoted.select("passage_id", "content_hash").distinct(), ["passage_id", "content_hash"], "left_anti").withColumn("origin", F.lit("triple"))


def triple_statistics(triples: DataFrame, least: float = 0.8) -> DataFrame:
    """predicate, n, eligible: cached triples and those that are sure enough to be proposed; without a confidence one counts as half sure."""
    sure = F.coalesce("conf", F.lit(0.5)) >= least
    return triples.groupBy("predicate").agg(F.count(F.lit(1)).alias("n"), F.count_if(sure).alias("eligible"))


def reviewed(pending: DataFrame, decisions: DataFrame) -> DataFrame:
    """pending with the decision on each key (accept, reject, edit with a new object) applied: `state`, object."""
    met = pending.join(decisions.select("key", "decision", F.col("object").alias("_object")), "key", "left")
    state = F.when(F.col("decision").isin("accept", "edit"), "accepted").when(F.col("decision") == "reject", "rejected").otherwise("pending")
    return met.withColumns({"state": state, "object": F.when(F.col("decision") == "edit", F.coalesce("_object", "object")).otherwise(F.col("object"))}).drop("_object")


def lifted(facts: DataFrame, origin: str, today: str) -> DataFrame:
    """Facts as episodes for another vault."""
    text = F.concat_ws(" ", "src", F.regexp_replace("type", "_", " "), F.coalesce("dst", "value"))
    return facts.select(F.lit("user").alias("by"), F.lit("import").alias("source"), F.lit(origin).alias("origin"), text.alias("text"), F.lit(today).alias("started"))
