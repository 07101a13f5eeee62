"""What consolidation and review write: facts, lines, marks, stubs, overviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import consolidate as c
from ..operators import evaluate
from ..operators import writing as w
from . import evaluation
from . import inputs as I
from .facts import CFG, CLAIMS, CURRENT, DECIDE, DECIDED, FRESH, old_and_new
from .inputs import sql, table
from .registry import query

TODAY = "2024-02-01"
FACT_ID = "'f-' || substr(sha256({} || chr(0) || {} || chr(0) || {} || chr(0) || {}), 1, 10)"


def node_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda t, k, col: table(spark, sf_dir, t).select(F.concat(F.lit(k), F.col(col).cast("string")).alias("name"))
    both = name("customer", "c", "c_custkey").unionByName(name("supplier", "s", "s_suppkey"))
    return both.select("name", F.col("name").alias("node_id"), F.lit(0).alias("tier"))


@query(sql(I.FACTS, f"made AS (SELECT *, (id % 4 + 1) / 4e0 AS conf, coalesce('[[' || dst || ']]', value) AS o, {FACT_ID.format('src', 'type', 'coalesce(chr(91) || chr(91) || dst || chr(93) || chr(93), value)', 'valid_from')} AS fact_id FROM facts)",
           select=f"""SELECT id, fact_id, '- [' || type || ':: ' || o || '] [valid:: ' || strftime(epoch_ms(valid_from), '%Y-%m-%d') || '..] [at:: {TODAY}] [by:: agent] [src:: [[e' || (id % 50) || ']]]' || CASE WHEN trust <> 'medium' THEN ' [trust:: ' || trust || ']' ELSE '' END
  || CASE WHEN conf <> 1 THEN ' [conf:: ' || conf || ']' ELSE '' END || ' ^' || fact_id AS line FROM made"""))  # fmt: skip
def q79_fact_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = I.facts(spark, sf_dir)
    rows = f.select(
        "id", "src", F.col("type").alias("predicate"), F.coalesce(F.concat(F.lit("[["), "dst", F.lit("]]")), "value").alias("object"), F.col("dst").alias("object_ref"), F.col("valid_from").alias("claimed_at"), "trust",
        ((F.col("id") % 4 + 1) / 4.0).alias("confidence"), F.concat(F.lit("e"), (F.col("id") % 50).cast("string")).alias("episode"),
    )
    return w.built_facts(rows, by="agent", now=I.NOW).select("id", "fact_id", w.fact_line().alias("line"))


@query(f"""WITH named AS (SELECT c_name AS name, c_custkey AS k FROM customer UNION ALL SELECT s_name, s_suppkey FROM supplier),
slugs AS (SELECT *, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS id FROM named)
SELECT id, 'entities/' || id || '.md' AS path, sha256('---' || chr(10) || 'type: entity' || chr(10) || 'id: ' || id || chr(10) || 'kind: concept' || chr(10) || 'aliases: []' || chr(10) || 'tags: []' || chr(10) || 'created: {TODAY}' || chr(10) || 'updated: {TODAY}' || chr(10) || 'importance: 0.5' || chr(10) || '---' || chr(10) || '# ' || min(name) || chr(10) || chr(10)) AS sha
FROM slugs WHERE id NOT IN (SELECT id FROM slugs WHERE k % 3 = 0) GROUP BY id""")
def q80_entity_stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("k")).unionByName(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("k")))
    known = named.filter("k % 3 = 0").select(w.slug(F.col("name")).alias("id")).distinct()
    return w.stubs(named, TODAY, known).select("id", "path", F.sha2("text", 256).alias("sha"))


LINE = "'- [n:: ' || doc_id || '] ^f' || doc_id"
NL = "chr(10)"


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {LINE} AS line, CASE WHEN ends_with(coalesce(text, ''), {NL}) THEN coalesce(text, '') ELSE coalesce(text, '') || {NL} END AS body FROM documents)
SELECT doc_id, sha256(CASE doc_id % 4 WHEN 0 THEN body || CASE WHEN ends_with(body, {NL} || {NL}) THEN '' ELSE {NL} END || '## Facts' || {NL} || line || {NL}
  WHEN 1 THEN '# t' || {NL} || {NL} || '## Facts' || {NL} || '- old' || {NL} || line || {NL} || {NL} || '## History' || {NL} || '- gone' || {NL} || t
  WHEN 2 THEN '## Facts' || {NL} || line || {NL} || '# after' || {NL} || t ELSE t || {NL} || '## Facts' || {NL} || line END) AS sha FROM d""")
def q81_fact_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes: without the section, with one that other sections follow, with one that has the line, and with an empty one."""
    k, t, key = F.col("doc_id") % 4, F.coalesce("text", F.lit("")), F.col("doc_id").cast("string")
    line = F.concat(F.lit("- [n:: "), key, F.lit("] ^f"), key)
    note = F.when(k == 0, t).when(k == 1, F.concat(F.lit("# t\n\n## Facts\n- old\n\n## History\n- gone\n"), t)).when(k == 2, F.concat(F.lit("## Facts\n"), line, F.lit("\n# after\n"), t)).otherwise(F.concat(t, F.lit("\n## Facts")))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(w.with_lines(note, F.array(line), "Facts"), 256).alias("sha"))


@query(f"""SELECT doc_id, doc_id % 4 <> 0 AS has_front_matter, sha256(CASE doc_id % 4 WHEN 0 THEN t WHEN 1 THEN '---' || {NL} || 'type: episode' || {NL} || 'consolidated: {TODAY}' || {NL} || '---' || {NL} || t
  WHEN 2 THEN '---' || {NL} || 'consolidated: {TODAY}' || chr(13) || {NL} || 'by: user' || chr(13) || {NL} || '---' || chr(13) || {NL} || t
  ELSE chr(65279) || '---' || chr(13) || {NL} || 'by: user' || chr(13) || {NL} || 'consolidated: {TODAY}' || chr(13) || {NL} || '...' || chr(13) || {NL} || t END) AS sha FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def q82_episode_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as episodes: without front matter, unmarked, marked before, and with a byte order mark and the other ending."""
    k, t = F.col("doc_id") % 4, F.coalesce("text", F.lit(""))
    note = F.when(k == 0, t).when(k == 1, F.concat(F.lit("---\ntype: episode\n---\n"), t)).when(k == 2, F.concat(F.lit("---\nconsolidated: old\r\nby: user\r\n---\r\n"), t)).otherwise(F.concat(F.lit("﻿---\r\nby: user\r\n...\r\n"), t))
    return table(spark, sf_dir, "documents").select("doc_id", w.has_front_matter(note).alias("has_front_matter"), F.sha2(w.marked(note, F.lit(TODAY)), 256).alias("sha"))


KNOWN = "known AS (SELECT 'c' || c_custkey AS n FROM customer UNION SELECT 's' || s_suppkey FROM supplier)"
YES = f"""yes AS (SELECT *, {FACT_ID.format('src', 'type', 'object', 'valid_from')} AS fact_id FROM (
  SELECT CASE WHEN id % 17 = 0 THEN 'new-' || src ELSE src END AS src, type, CASE WHEN type = 'supplied_by' AND object IN (SELECT n FROM known) THEN '[[' || object || ']]' ELSE object END AS object, valid_from FROM fresh WHERE id % 5 < 2))"""


@query(sql(I.FACTS, CURRENT, FRESH, KNOWN, YES, "heads AS (SELECT src, type, arg_min(object, (valid_from, fact_id)) AS first_object, min(valid_from) AS since FROM yes WHERE type = 'status' GROUP BY 1, 2)", select=f"""SELECT id::VARCHAR AS id, src, type, object, valid_from, CASE WHEN shut THEN since END AS valid_to, CASE WHEN shut THEN {I.NOW} END AS expired_at FROM (
  SELECT id, c.src, c.type, CASE WHEN c.type = 'supplied_by' THEN '[[' || object || ']]' ELSE object END AS object, valid_from, since, coalesce(first_object <> object AND valid_from <= since, false) AS shut FROM current_facts c LEFT JOIN heads USING (src, type))
UNION ALL SELECT fact_id, src, type, object, valid_from, CASE WHEN type = 'status' THEN lead(valid_from) OVER k END, CASE WHEN type = 'status' AND lead(valid_from) OVER k IS NOT NULL THEN {I.NOW} END FROM yes WINDOW k AS (PARTITION BY src, type ORDER BY valid_from, fact_id)"""))  # fmt: skip
def q83_review_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the last years wait for review; two in five are accepted, some of them about things without a note."""
    old, new = old_and_new(spark, sf_dir)
    subject = F.when(F.col("id") % 17 == 0, F.concat(F.lit("New "), "src")).otherwise(F.col("src"))
    said = F.when(F.col("type") == "supplied_by", F.concat(F.lit("[["), "object", F.lit("]]"))).otherwise(F.col("object"))
    records = new.select(F.col("id").alias("key"), subject.alias("subject"), F.col("type").alias("predicate"), said.alias("object"), F.concat(F.lit("e"), F.col("id").cast("string")).alias("episode"), F.col("valid_from").alias("claimed_at"))
    null = F.lit(None).cast("string")
    decisions = records.select("key", F.when(F.col("key") % 5 < 2, "accept").when(F.col("key") % 5 == 2, "reject").otherwise("edit").alias("decision"), null.alias("subject"), null.alias("predicate"), null.alias("object"))
    linked = F.col("type") == "supplied_by"
    current = old.withColumns({"dst": F.when(linked, F.col("object")), "value": F.when(~linked, F.col("object"))})
    return w.accepted(records, decisions, node_names(spark, sf_dir), current, CFG, I.NOW, TODAY)["facts"]


@query(sql(KNOWN, f"pairs AS (SELECT o_orderkey AS id, 'c' || o_custkey AS a, 's' || (o_orderkey % 97 + 1) AS b FROM orders), held AS (SELECT DISTINCT a, b FROM pairs WHERE id % 6 = 0)",
           f"""told AS (SELECT pairs.*, CASE WHEN pairs.a NOT IN (SELECT n FROM known) OR pairs.b NOT IN (SELECT n FROM known) THEN 'unresolved' WHEN held.a IS NOT NULL THEN 'present' ELSE 'written' END AS outcome FROM pairs LEFT JOIN held ON held.a = pairs.a AND held.b = pairs.b)""",
       select=f"SELECT id, outcome, CASE WHEN outcome = 'written' THEN {FACT_ID.format('a', chr(39) + 'related_to' + chr(39), 'chr(91) || chr(91) || b || chr(93) || chr(93)', str(I.NOW))} END AS fact_id FROM told"))
def q84_dream_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    pairs = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("a"), F.concat(F.lit("s"), (F.col("o_orderkey") % 97 + 1).cast("string")).alias("b"))
    null = F.lit(None).cast("long")
    held = pairs.filter("id % 6 = 0").select(F.col("a").alias("src"), F.lit("related_to").alias("type"), F.col("b").alias("dst"), null.alias("valid_to"), null.alias("expired_at"))
    nodes = node_names(spark, sf_dir).select(F.col("node_id").alias("id"))
    return w.associations(pairs, held, nodes, I.NOW).select("id", "outcome", "fact_id")


OVERVIEW = f"""said AS (SELECT src, 'e' || (id % 50) AS provenance, valid_from AS t, CASE WHEN id % 2 = 0 THEN 5e-1 ELSE 1e0 END AS conf, '- ' || type || ' ' || coalesce('[[' || dst || ']]', value) || {NL} || '  - valid: ' || strftime(epoch_ms(valid_from), '%Y-%m-%d') || '..' || coalesce(strftime(epoch_ms(valid_to), '%Y-%m-%d'), '…') || {NL} || '  - by: agent' || {NL}
    || CASE WHEN expired_at IS NOT NULL THEN '  - superseded: ' || strftime(epoch_ms(expired_at), '%Y-%m-%d') || {NL} ELSE '' END AS told FROM facts
), made AS (SELECT src AS id, '# ' || src || {NL} || {NL} || '## Summary' || {NL} || {NL} || string_agg(told, {NL} ORDER BY t, told) AS body FROM said GROUP BY src HAVING sum(conf) >= 3)"""


@query(sql(I.FACTS, OVERVIEW, select="SELECT id, 'schemas/' || id || '-overview.md' AS path, sha256(body) AS body_hash FROM made WHERE CAST(substr(id, 2) AS BIGINT) % 3 <> 0"))
def q85_overviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overviews of customers; a person edited every third, another third is as it was written."""
    conf = F.when(F.col("id") % 2 == 0, 0.5).otherwise(1.0)
    f = I.facts(spark, sf_dir).withColumns({"conf": conf, "by": F.lit("agent"), "provenance": F.concat(F.lit("e"), (F.col("id") % 50).cast("string"))})
    made = w.overviews(f, TODAY)
    k = F.substring("id", 2, 20).cast("long") % 3
    there = made.filter(k < 2).select("path", F.when(k == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body")).alias("body"), F.col("body_hash").alias("generated_hash"))
    return w.untouched(made, there).select("id", "path", "body_hash")


@query(sql(I.FACTS, select="SELECT type AS predicate, count(*) AS n, count(*) FILTER (coalesce(conf, 5e-1) >= 8e-1) AS eligible FROM (SELECT type, CASE WHEN id % 7 <> 0 THEN (id % 10) / 1e1 END AS conf FROM facts) GROUP BY type"))
def q86_triple_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = I.facts(spark, sf_dir).select(F.col("type").alias("predicate"), F.when(F.col("id") % 7 != 0, (F.col("id") % 10) / 10.0).alias("conf"))
    return c.triple_statistics(f)


NIGHT = CLAIMS.replace("(id % 4)::DOUBLE AS support", "0e0 AS support")


@query(sql(I.FACTS, CURRENT, FRESH, NIGHT, DECIDED, f"verdicts AS ({DECIDE})", select=f"""SELECT id, decision, CASE WHEN starts_with(decision, 'promote') OR starts_with(decision, 'supersede') THEN {FACT_ID.format('subject_ref', 'said', "CASE WHEN said = 'supplied_by' THEN chr(91) || chr(91) || object || chr(93) || chr(93) ELSE object END", 'claimed_at')} END AS fact_id
FROM decided JOIN verdicts USING (id)"""))  # fmt: skip
def q87_consolidation_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A night over the facts of the last years as claims of their own episodes."""
    old, new = old_and_new(spark, sf_dir)
    by = F.element_at(F.array(*[F.lit(k) for k in ("user", "agent", "import", "web", "tool", "user")]), (F.col("id") % 6 + 1).cast("int"))
    linked = F.col("type") == "supplied_by"
    rows = new.select(
        F.col("id").alias("seq"), F.when(F.col("id") % 17 == 0, F.concat(F.lit("nobody "), F.col("id").cast("string"))).otherwise(F.col("src")).alias("subject"), F.when(F.col("id") % 13 == 0, "likes").otherwise(F.col("type")).alias("predicate"),
        F.when(linked & (F.col("id") % 13 != 0), F.concat(F.lit("[["), "object", F.lit("]]"))).otherwise(F.col("object")).alias("object"), F.concat(F.lit("e"), F.col("id").cast("string")).alias("episode"), by.alias("by"), F.lit("high").alias("trust"),
        F.when(F.col("id") % 11 == 0, "triple").otherwise("episode").alias("origin"), (F.col("id") % 2 == 0).alias("explicit"), F.lit(1.0).alias("confidence"), (F.col("valid_from") - (F.col("id") % 5) * 60 * 86_400_000).alias("claimed_at"), F.lit(False).alias("priority"),
    )
    current = old.withColumns({"dst": F.when(linked, F.col("object")), "value": F.when(~linked, F.col("object")), "conf": F.lit(1.0), "provenance": F.concat(F.lit("e"), F.col("id").cast("string"))})
    every = I.facts(spark, sf_dir)
    names = every.select(F.col("src").alias("name")).unionByName(every.filter("dst IS NOT NULL").select(F.col("dst").alias("name"))).distinct().select("name", F.col("name").alias("node_id"), F.lit(0).alias("tier"))
    none = spark.createDataFrame([], "subject string, predicate string, object string, episode string, by string")
    out = w.consolidation(rows, names, current, none, none, CFG, I.NOW, TODAY)
    made = out["written"].select("seq", "fact_id")
    # Claims of one wording and time are one fact; each of them is answered with it.
    told = out["decided"].withColumn("src", F.col("subject_ref")).drop("fact_id")
    with_id = w.built_facts(told, by="agent", now=I.NOW).select(F.col("seq").alias("id"), F.concat_ws(": ", "action", "reason").alias("decision"), F.when(F.col("action").isin("promote", "supersede"), F.col("fact_id")).alias("fact_id"))
    return with_id.join(made.select("fact_id").distinct().withColumn("_w", F.lit(True)), "fact_id", "left").select("id", "decision", F.when(F.col("_w"), F.col("fact_id")).alias("fact_id"))


@query(sql(*evaluation.HITS, select="SELECT (SELECT count(DISTINCT query_id) FROM hits) AS n_queries, (SELECT count(*) FROM hits WHERE passage_id % 3 = 0) AS trust, (SELECT count(*) FROM hits WHERE rank > 3) AS missing, (SELECT count(*) FROM hits WHERE passage_id % 3 = 0) > 0 AS failed"))
def q88_violation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = evaluation.hits_of(spark, sf_dir)
    return evaluate.totals({"trust": evaluation.q43_trust_violations(spark, sf_dir), "missing": hits.filter("rank > 3")}, hits.select("query_id").distinct())
