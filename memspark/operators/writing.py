"""What a consolidation run and a review write: facts, entity stubs, note texts, marks, overviews.

Nothing here touches a file. Each step gives the rows or the texts as they would be; `changes` compares them with what is
there, which is a dry run, and the caller writes.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SOURCE_TRUST, Config
from ..functions.scoring import source_trust, source_weight, strengthened, support_confidence
from ..functions.text import short_hash
from ..storage import written as stored
from . import consolidate as c
from .index import slug
from .temporal import superseded

# Columns of a fact that is to be written, the predicate of a confirmed association, an overview's least importance.
FACT_COLUMNS = ("fact_id", "src", "type", "dst", "value", "valid_from", "valid_to", "recorded_at", "expired_at", "by", "trust", "conf", "episode")
RELATED = "related_to"
IMPORTANT = 3.0


def day(ms: Column) -> Column:
    """The date of an epoch-millisecond time, in the session's time zone."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def stripped(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def link_name(obj: Column) -> Column:
    """The target of a lone [[link]], else the text itself."""
    inside = F.regexp_extract(stripped(obj), r"^\[\[([^\[\]|#]+)[^\[\]]*\]\]$", 1)
    return F.coalesce(F.nullif(F.trim(inside), F.lit("")), obj)


def object_key(ref: Column, obj: Column) -> Column:
    """How an object counts in keys: its node as a link, else its own text."""
    return F.coalesce(F.concat(F.lit("[["), ref, F.lit("]]")), link_name(obj))


def fact_parts() -> list[Column]:
    """What a fact says and since when, of which its id is a hash."""
    return [F.col("src"), F.col("predicate"), object_key(F.col("object_ref"), F.col("object")), F.col("claimed_at")]


def built_facts(rows: DataFrame, by: str | None = None, now: int | None = None) -> DataFrame:
    """rows with the fact that each becomes (FACT_COLUMNS); the id hashes what the fact says and since when, not when it was written.

    rows: src, predicate, object, object_ref, claimed_at, trust, confidence, episode, and by, recorded_at unless they are given.
    A fact confirmed by a user has the user's trust and full confidence.
    """
    made = {
        "type": F.col("predicate"), "dst": F.col("object_ref"), "value": F.when(F.col("object_ref").isNull(), link_name(F.col("object"))), "valid_from": F.col("claimed_at"), "valid_to": F.lit(None).cast("long"),
        "fact_id": F.concat(F.lit("f-"), short_hash(*fact_parts())), "expired_at": F.lit(None).cast("long"),
        "conf": F.lit(1.0) if by == "user" else F.coalesce(F.col("confidence").cast("double"), F.lit(1.0)),
    }
    if by is not None:
        made["by"] = F.lit(by)
    if by == "user":
        made["trust"] = F.lit(SOURCE_TRUST["user"])
    if now is not None:
        made["recorded_at"] = F.lit(now).cast("long")
    return rows.withColumns(made)


def fact_line() -> Column:
    """The line of a fact (FACT_COLUMNS) in a note. Fields that say nothing new are left out."""
    field = lambda name, v: F.concat(F.lit(f"[{name}:: "), v, F.lit("]"))
    claim = F.concat(F.lit("["), F.col("type"), F.lit(":: "), F.coalesce(F.concat(F.lit("[["), F.col("dst"), F.lit("]]")), F.col("value"), F.lit("")), F.lit("]"))
    ends = [F.coalesce(day(F.col(x)), F.lit("")) for x in ("valid_from", "valid_to")]
    span = F.when(F.col("valid_from").isNotNull() | F.col("valid_to").isNotNull(), field("valid", F.concat(ends[0], F.lit(".."), ends[1])))
    head = F.concat_ws(" ", claim, span)
    number = F.regexp_replace(F.col("conf").cast("string"), r"\.0$", "")
    return F.concat_ws(
        " ", F.lit("-"), F.when(F.col("expired_at").isNotNull(), F.concat(F.lit("~~"), head, F.lit("~~"))).otherwise(head), field("at", day(F.col("recorded_at"))), field("superseded", day(F.col("expired_at"))), field("by", F.col("by")),
        field("src", F.concat(F.lit("[["), F.col("episode"), F.lit("]]"))), F.when(F.col("trust") != source_trust(F.col("by")), field("trust", F.col("trust"))), F.when(F.col("conf") != 1, field("conf", number)), F.concat(F.lit("^"), F.col("fact_id")),
    )


def with_lines(text: Column, lines: Column, heading: str) -> Column:
    """A note's text with lines (an array) put after the last line of its section, each once; all other bytes stay.

    A note without the section gets one at its end.
    """
    title = f"## {heading}"
    parts = F.split(text, "\n", -1)
    at = F.array_position(F.transform(parts, stripped), F.lit(title)).cast("int")
    after = F.slice(parts, at + 1, F.size(parts))
    end = F.array_position(F.transform(after, lambda x: x.rlike(r"^#{1,6}\s")), F.lit(True)).cast("int")
    section = F.when(end > 0, F.slice(after, F.lit(1), F.greatest(end - 1, F.lit(0)))).otherwise(after)
    full = F.coalesce(F.array_max(F.transform(section, lambda x, i: F.when(stripped(x) != "", i + 1).otherwise(0))), F.lit(0))
    fresh = F.array_except(lines, F.transform(section, stripped))
    inside = F.concat(F.slice(parts, F.lit(1), at + full), fresh, F.slice(parts, at + full + 1, F.size(parts)))
    body = F.when(F.endswith(text, F.lit("\n")), text).otherwise(F.concat(text, F.lit("\n")))
    gap = F.when(F.endswith(body, F.lit("\n\n")), F.lit("")).otherwise(F.lit("\n"))
    outside = F.concat(body, gap, F.lit(title + "\n"), F.array_join(F.array_distinct(lines), "\n"), F.lit("\n"))
    return F.when(F.coalesce(F.size(lines), F.lit(0)) <= 0, text).when(at == 0, outside).when(F.size(fresh) == 0, text).otherwise(F.array_join(inside, "\n"))


def line_replaced(text: Column, number: Column, line: Column) -> Column:
    """text with its line of that number (from 1) replaced; unchanged if there is none."""
    parts = F.split(text, "\n", -1)
    return F.when(number.between(F.lit(1), F.size(parts)), F.array_join(_with(parts, number, line), "\n")).otherwise(text)


def _with(parts: Column, number: Column, line: Column) -> Column:
    # No lambda over the lines may hold the number: it would be worked out for each line.
    return F.concat(F.slice(parts, F.lit(1), number - 1), F.array(line), F.slice(parts, number + 1, F.size(parts)))


def _fence(text: Column) -> tuple[Column, Column]:
    """(lines, the closing line's number from 1, or 0) of a text's front matter."""
    parts = F.split(F.regexp_replace(text, "^﻿", ""), "\n", -1)
    shut = F.array_position(F.transform(parts, lambda x, i: (i > 0) & x.rlike("^(---|\\.\\.\\.)\r?$")), F.lit(True)).cast("int")
    return parts, F.when(F.get(parts, F.lit(0)).rlike("^---\r?$"), shut).otherwise(F.lit(0))


def has_front_matter(text: Column) -> Column:
    return F.coalesce(_fence(text)[1] > 0, F.lit(False))


def marked(text: Column, date: Column) -> Column:
    """An episode's text with `consolidated:` set in its front matter, one line changed or added; without front matter as it is."""
    parts, shut = _fence(text)
    bom = F.when(F.startswith(text, F.lit("﻿")), F.lit("﻿")).otherwise(F.lit(""))
    end = F.when(F.endswith(F.get(parts, shut - 1), F.lit("\r")), F.lit("\r")).otherwise(F.lit(""))
    line = F.concat(F.lit("consolidated: "), date, end)
    inside = F.slice(parts, F.lit(2), F.greatest(shut - 2, F.lit(0)))
    old = F.array_position(F.transform(inside, lambda x: x.rlike(r"^consolidated\s*:")), F.lit(True)).cast("int")
    added = F.concat(F.slice(parts, F.lit(1), shut - 1), F.array(line), F.slice(parts, shut, F.size(parts)))
    return F.when(shut > 0, F.concat(bom, F.array_join(F.when(old > 0, _with(parts, old + 1, line)).otherwise(added), "\n"))).otherwise(text)


def stubs(names: DataFrame, today: str, known: DataFrame | None = None) -> DataFrame:
    """id, path, text: a least entity note for each name (column name) that has none; names of one slug are one note, by the first name.

    known: id of the notes that exist; they are never written anew.
    """
    named = names.filter("name IS NOT NULL").withColumn("id", F.coalesce(F.nullif(slug(F.col("name")), F.lit("")), F.lit("entity")))
    one = named.groupBy("id").agg(F.min("name").alias("name"))
    if known is not None:
        one = one.join(known.select("id"), "id", "left_anti")
    head = F.concat(F.lit("---\ntype: entity\nid: "), F.col("id"), F.lit(f"\nkind: concept\naliases: []\ntags: []\ncreated: {today}\nupdated: {today}\nimportance: 0.5\n---\n# "))
    return one.select("id", F.concat(F.lit("entities/"), "id", F.lit(".md")).alias("path"), F.concat(head, "name", F.lit("\n\n")).alias("text"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, before, after, change (added or changed) of the texts that differ. Both: path, text; a path missing from after stays as it is."""
    met = after.select("path", F.col("text").alias("after")).join(before.select("path", F.col("text").alias("before")), "path", "left")
    return met.filter(~F.col("after").eqNullSafe(F.col("before"))).withColumn("change", F.when(F.col("before").isNull(), "added").otherwise("changed"))


def with_diff(rows: DataFrame) -> DataFrame:
    """changes with `diff`, in the unified form. Aligning lines has no built-in form, so it runs in Arrow batches."""

    @F.pandas_udf("string")
    def unified(path: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
        lines = lambda s: (s or "").splitlines()
        each = zip(path, before, after, strict=True)
        return pd.Series(["\n".join(difflib.unified_diff(lines(b), lines(a), f"a/{p}", f"b/{p}", lineterm="")) for p, b, a in each])

    return rows.withColumn("diff", unified("path", "before", "after"))


def claim_of(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Candidates or records (subject, predicate, object) with subject_ref, object_ref, object_key and `claim`."""
    met = c.resolve(rows.withColumn("_object", link_name(F.col("object"))), names, "subject", "subject_ref")
    met = c.resolve(met, names, "_object", "object_ref").drop("_object")
    met = met.withColumn("object_key", object_key(F.col("object_ref"), F.col("object")))
    return met.withColumn("claim", F.concat_ws("|", F.coalesce("subject_ref", "subject"), "predicate", "object_key"))


def consolidation(candidates: DataFrame, names: DataFrame, current: DataFrame, pending: DataFrame, rejected: DataFrame, cfg: Config, now: int, today: str) -> dict[str, DataFrame]:
    """One run, as tables: decided, written, facts (old with what the run closed, and new), strengthened, stubs, pending.

    candidates: seq (their order), subject, predicate, object, episode, by, trust, origin, explicit, confidence, claimed_at, priority.
    names: name, node_id, tier. current: id, src, type, dst, value, valid_from, valid_to, expired_at, conf, provenance.
    pending, rejected: subject, predicate, object, episode, by. Empty tables give empty tables; a candidate whose key (claim
    and episode) is current, pending or rejected, or came before in the run, is not decided again. A candidate without a
    subject, predicate or object says nothing and is left out. The decisions are written once, in the shared folder, for
    all tables come from them.
    """
    candidates = candidates.filter("trim(subject) <> '' AND trim(predicate) <> '' AND trim(object) <> ''")
    held = current.filter("expired_at IS NULL AND valid_to IS NULL").withColumn("object_key", object_key(F.col("dst"), F.col("value")))
    queue, refused = claim_of(pending, names), claim_of(rejected, names)
    key_of = lambda n: c.candidate_key(F.coalesce("subject_ref", "subject"), F.col("predicate"), F.col("object_key"), F.col("episode"), n)
    key = lambda t: t.withColumn("key", key_of(10))
    same_as = lambda t: t.withColumn("_same", key_of(c.WHOLE))
    known = held.select(c.candidate_key(F.col("src"), F.col("type"), F.col("object_key"), F.coalesce("provenance", F.lit("")), c.WHOLE).alias("_same"))
    seen = same_as(queue).select("_same").unionByName(same_as(refused).select("_same")).unionByName(known)
    fresh = key(c.new_candidates(same_as(claim_of(candidates, names)), seen, "seq", "_same").drop("_same"))
    fresh = c.with_support(fresh, queue.select("claim", "episode", "by"), "seq").drop("confidence_by_support")
    fresh = fresh.join(refused.select("claim", F.lit(True).alias("rejected")).distinct(), "claim", "left").withColumn("rejected", F.coalesce("rejected", F.lit(False)))
    # A claim that holds already gets surer, before the gate sees it.
    on = F.lit(cfg.consolidation.corroboration) & ~F.col("rejected")
    same = held.select(F.col("src").alias("subject_ref"), F.col("type").alias("predicate"), "object_key", F.col("id").alias("held_id"), F.col("conf").alias("held_conf"))
    once = Window.partitionBy("subject_ref", "predicate", "object_key").orderBy("held_id")
    same = same.withColumn("_nth", F.row_number().over(once)).filter("_nth = 1").drop("_nth")
    fresh = fresh.join(same, ["subject_ref", "predicate", "object_key"], "left").withColumn("agrees", on & F.col("held_id").isNotNull())
    # Each agreeing source moves the confidence once; weights add up, so their order doesn't matter.
    surer = fresh.filter("agrees").groupBy("held_id", "held_conf").agg(F.sum(source_weight(F.col("by"))).alias("w"))
    surer = surer.select(F.col("held_id").alias("id"), F.least(F.lit(1.0), F.col("held_conf") + 0.125 * F.col("w")).alias("conf")).join(held.select("id", F.col("conf").alias("_old")), "id").filter("conf > _old").drop("_old")
    rows = fresh.filter("NOT agrees").withColumnRenamed("object", "said").withColumn("object", F.col("object_key"))
    facts = held.select("src", "type", F.col("object_key").alias("object"), "valid_from")
    rows = c.gate(c.against_current(rows, facts), cfg).drop("object").withColumnRenamed("said", "object")
    # A predicate that wants an entity gets a link; a name that can't be a thing's waits for a reviewer.
    wants = F.col("predicate").isin([k for k, p in cfg.predicates.items() if p.object == "entity"])
    new_thing = wants & F.col("object_ref").isNull() & c.plausible_name(link_name(F.col("object")))
    written = F.col("action").isin("promote", "supersede")
    blocked = written & wants & F.col("object_ref").isNull() & ~new_thing
    rows = rows.withColumns({"action": F.when(blocked, "queue").otherwise(F.col("action")), "reason": F.when(blocked, "entity object not resolvable").otherwise(F.col("reason")), "new_object": new_thing})
    rows = stored(rows, "decided")
    named = rows.withColumn("src", F.coalesce("subject_ref", slug(F.col("subject")))).withColumn("object_ref", F.when(F.col("new_object"), slug(link_name(F.col("object")))).otherwise(F.col("object_ref")))
    sure = F.when(F.startswith(F.col("reason"), F.lit("corroborated by")), support_confidence(F.col("support"))).otherwise(F.col("confidence"))
    made = built_facts(named.withColumn("confidence", sure).filter(written), by="agent", now=now)
    # A claim of several episodes is one fact; what it says and since when tells facts apart, not the short id.
    one = Window.partitionBy(short_hash(*fact_parts(), n=c.WHOLE)).orderBy("seq")
    made = made.withColumn("_nth", F.row_number().over(one)).filter("_nth = 1").drop("_nth")
    columns = ("id", "src", "type", "object", "valid_from", "valid_to", "expired_at")
    as_facts = lambda t, i: t.withColumns({"id": F.col(i).cast("string"), "object": F.coalesce(F.concat(F.lit("[["), "dst", F.lit("]]")), "value")}).select(*columns)
    closing = as_facts(made.filter("action = 'supersede'"), "fact_id")
    out = superseded(as_facts(current, "id"), closing, now).unionByName(as_facts(made.filter("action = 'promote'"), "fact_id"))
    things = made.filter("subject_ref IS NULL").select(F.col("subject").alias("name")).unionByName(made.filter("new_object").select(link_name(F.col("object")).alias("name")))
    sure_claims = rows.filter("action = 'promote' AND reason LIKE 'corroborated by%'").select("claim")
    waiting = rows.filter("action = 'queue'").select("key", "subject", "predicate", "object", "episode", "by", "trust", "origin", "reason", F.lit(now).cast("long").alias("queued_at"), F.coalesce("priority", F.lit(False)).alias("priority"), "claim")
    kept = key(queue).select("key", "subject", "predicate", "object", "episode", "by", *[F.lit(None).cast("string").alias(x) for x in ("trust", "origin", "reason")], F.lit(None).cast("long").alias("queued_at"), F.lit(False).alias("priority"), "claim")
    return {"decided": rows, "written": made, "facts": out, "strengthened": surer, "stubs": stubs(things, today, names.select(F.col("node_id").alias("id")).distinct()), "pending": c.left_pending(kept.unionByName(waiting), sure_claims).drop("claim")}


def accepted(records: DataFrame, decisions: DataFrame, names: DataFrame, current: DataFrame, cfg: Config, now: int, today: str) -> dict[str, DataFrame]:
    """A review, as tables: pending (left or edited), rejected, facts after the accepted ones, written, stubs.

    records: key, subject, predicate, object, episode, claimed_at (null: now). decisions: key, decision (accept, reject, edit; others
    leave the record), subject, predicate, object (edits; null or blank keeps). An accepted fact of a single-valued
    predicate closes the one that says otherwise; a subject without a note gets a stub.
    """
    new = lambda x: F.coalesce(F.nullif(F.trim(F.col(f"_{x}")), F.lit("")), F.col(x))
    told = decisions.select("key", "decision", *[F.col(x).alias(f"_{x}") for x in ("subject", "predicate", "object")])
    met = records.join(told, "key", "left")
    edited = F.col("decision") == "edit"
    left = met.filter(F.col("decision").isNull() | ~F.col("decision").isin("accept", "reject")).withColumns({x: F.when(edited, new(x)).otherwise(F.col(x)) for x in ("subject", "predicate", "object")}).select(records.columns)
    refused = met.filter("decision = 'reject'").select(records.columns)
    yes = claim_of(met.filter("decision = 'accept'").select(records.columns), names)
    yes = yes.withColumn("src", F.coalesce("subject_ref", slug(F.col("subject")))).withColumn("claimed_at", F.coalesce("claimed_at", F.lit(now).cast("long")))
    made = built_facts(yes, by="user", now=now)
    single = F.col("type").isin([k for k, p in cfg.predicates.items() if p.cardinality == "one"])
    columns = ("id", "src", "type", "object", "valid_from", "valid_to", "expired_at")
    as_facts = lambda t, i: t.withColumns({"id": F.col(i).cast("string"), "object": F.coalesce(F.concat(F.lit("[["), "dst", F.lit("]]")), "value")}).select(*columns)
    out = superseded(as_facts(current, "id"), as_facts(made.filter(single), "fact_id"), now).unionByName(as_facts(made.filter(~single), "fact_id"))
    known = names.select(F.col("node_id").alias("id")).distinct()
    return {"pending": left, "rejected": refused, "facts": out, "written": made, "stubs": stubs(made.filter("subject_ref IS NULL").select(F.col("subject").alias("name")), today, known)}


def associations(candidates: DataFrame, current: DataFrame, nodes: DataFrame, now: int) -> DataFrame:
    """candidates (id, a, b) with `outcome`: written, present (the fact holds already) or unresolved (a note is missing), and the fact's id."""
    notes = nodes.select("id").distinct()
    there = lambda t, x: t.join(notes.select(F.col("id").alias(x), F.lit(True).alias(f"_{x}")), x, "left")
    held = current.filter(f"type = '{RELATED}' AND expired_at IS NULL AND valid_to IS NULL").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(True).alias("_held")).distinct()
    met = there(there(candidates, "a"), "b").join(held, ["a", "b"], "left")
    outcome = F.when(F.col("_a").isNull() | F.col("_b").isNull(), "unresolved").when(F.col("_held"), "present").otherwise("written")
    made = F.concat(F.lit("f-"), short_hash(F.col("a"), F.lit(RELATED), F.concat(F.lit("[["), "b", F.lit("]]")), F.lit(now)))
    return met.withColumn("outcome", outcome).withColumn("fact_id", F.when(F.col("outcome") == "written", made)).drop("_a", "_b", "_held")


def overviews(facts: DataFrame, today: str, least: float = IMPORTANT) -> DataFrame:
    """id, path, body, body_hash, text: the overview of each subject whose facts' confidences add up.

    facts: src, type, dst, value, valid_from, valid_to, expired_at, by, conf, provenance. A subject's facts are in the order of time.
    """
    at = lambda x: F.coalesce(day(F.col(x)), F.lit("…"))
    gone = F.when(F.col("expired_at").isNotNull(), F.concat(F.lit("  - superseded: "), day(F.col("expired_at"))))
    told = F.concat_ws("\n", F.concat(F.lit("- "), "type", F.lit(" "), F.coalesce(F.concat(F.lit("[["), "dst", F.lit("]]")), "value", F.lit(""))), F.concat(F.lit("  - valid: "), at("valid_from"), F.lit(".."), at("valid_to")), F.concat(F.lit("  - by: "), "by"), gone, F.lit(""))
    important = facts.groupBy("src").agg(F.sum(F.coalesce("conf", F.lit(1.0))).alias("_sum")).filter(F.col("_sum") >= least).select("src")
    rows = facts.join(important, "src").select("src", "provenance", F.struct(F.coalesce("valid_from", F.lit(0)).alias("t"), told.alias("told")).alias("x"))
    one = rows.groupBy("src").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["told"]), "\n").alias("list"), F.sort_array(F.collect_set("provenance")).alias("from"))
    body = F.concat(F.lit("# "), "src", F.lit("\n\n## Summary\n\n"), "list")
    sources = F.coalesce(F.nullif(F.array_join(F.transform("from", lambda s: F.concat(F.lit("[["), s, F.lit("]]"))), ", "), F.lit("")), F.lit("none"))
    made = one.withColumns({"body": body, "_from": sources}).withColumn("body_hash", F.sha2("body", 256))
    head = F.concat(F.lit("---\ntype: schema\nderived: true\nsources: "), "_from", F.lit(f"\ngenerated: {today}\ngenerated_hash: "), "body_hash", F.lit("\n---\n"))
    return made.select(F.col("src").alias("id"), F.concat(F.lit("schemas/"), "src", F.lit("-overview.md")).alias("path"), "body", "body_hash", F.concat(head, "body").alias("text"))


def untouched(made: DataFrame, existing: DataFrame) -> DataFrame:
    """The overviews that may be written: no note is there, or its body still has the hash it was written with. existing: path, body, generated_hash."""
    own = existing.select("path", (F.col("generated_hash").isNull() | (F.sha2(F.coalesce("body", F.lit("")), 256) != F.col("generated_hash"))).alias("_human"))
    return made.join(own, "path", "left").filter(~F.coalesce("_human", F.lit(False))).drop("_human")


def confidence_moves(facts: DataFrame, by: Column) -> DataFrame:
    """facts with `conf` one step surer by a source that agrees."""
    return facts.withColumn("conf", strengthened(F.col("conf"), by))
