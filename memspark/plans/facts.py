"""Bi-temporal facts and consolidation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, merged
from ..operators import consolidate as c
from ..operators import graph as g
from ..operators import temporal
from . import inputs as I
from .graphs import TIMES, times
from .inputs import sql, table
from .registry import query

CFG = merged(Config(), {"predicates": {"status": {"object": "literal", "cardinality": "one"}, "supplied_by": {"object": "link", "inverse": "supplies"}}})
AT = 915_148_800_000


@query(sql(I.FACTS, select="SELECT id, src, type, valid_from, valid_to FROM facts"))
def q33_fact_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.facts(spark, sf_dir).select("id", "src", "type", "valid_from", "valid_to")


WHO = "who AS (SELECT 'c' || c_custkey AS entity FROM customer UNION ALL SELECT 's' || s_suppkey FROM supplier)"


@query(sql(I.FACTS, WHO, select="""SELECT entity, id, predicate, object, status, row_number() OVER (PARTITION BY entity ORDER BY valid_from NULLS FIRST, recorded_at NULLS FIRST, id) AS nth FROM (
  SELECT entity, f.*, type AS predicate, coalesce(dst, value, '') AS object, CASE WHEN expired_at IS NOT NULL THEN 'superseded' WHEN valid_to IS NOT NULL THEN 'historical' ELSE 'current' END AS status FROM facts f JOIN who ON src = entity
  UNION ALL SELECT entity, f.*, CASE type WHEN 'supplied_by' THEN 'supplies' ELSE type END, src, CASE WHEN expired_at IS NOT NULL THEN 'superseded' WHEN valid_to IS NOT NULL THEN 'historical' ELSE 'current' END FROM facts f JOIN who ON dst = entity)"""))
def q34_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda t, k, col: table(spark, sf_dir, t).select(F.concat(F.lit(k), F.col(col).cast("string")).alias("entity"))
    who = name("customer", "c", "c_custkey").unionByName(name("supplier", "s", "s_suppkey"))
    out = temporal.timeline(I.facts(spark, sf_dir), who, dict(CFG.predicates))
    return out.select("entity", "id", "predicate", "object", "status", F.col("nth").cast("long").alias("nth"))


@query(sql(I.FACTS, select=f"SELECT id, src, type FROM facts WHERE valid_from <= {AT} AND (valid_to IS NULL OR valid_to > {AT})"))
def q35_world_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.facts(spark, sf_dir).filter(g.true_at(F.lit(AT))).select("id", "src", "type")


@query(sql(I.FACTS, select=f"SELECT id, src, type FROM facts WHERE declared_created <= {AT} AND recorded_at <= {AT} AND (expired_at IS NULL OR expired_at > {AT})"))
def q36_system_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = I.facts(spark, sf_dir).drop("valid_from", "valid_to").withColumns({"valid_from": F.lit(None).cast("long"), "valid_to": F.lit(None).cast("long")})
    return f.filter(g.believed_at(F.lit(AT))).select("id", "src", "type")


@query(sql(TIMES, select="""SELECT o_custkey, t, id, status FROM (
  SELECT o_custkey, t, o_orderkey AS id, o_orderstatus AS status, row_number() OVER (PARTITION BY o_custkey, t ORDER BY o_orderdate DESC, o_orderkey DESC) AS nth FROM orders, times WHERE epoch_ms(o_orderdate) <= t)
WHERE nth = 1"""))
def q37_asof_version_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", I.millis("o_orderdate").alias("at"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    asked = o.select("o_custkey").distinct().join(F.broadcast(times(spark).select("t")))  # three moments for each key
    return temporal.as_of_rows(o, asked, ["o_custkey"], "at", ["id", "status"]).select("o_custkey", "t", "id", "status")


# Old facts end where a customer's orders of the last year begin; those supersede them.
SPLIT = 946_684_800_000
CURRENT = f"current_facts AS (SELECT id, src, type, coalesce(dst, value) AS object, valid_from, CAST(NULL AS BIGINT) AS valid_to, CAST(NULL AS BIGINT) AS expired_at FROM facts WHERE valid_from < {SPLIT} AND (valid_to IS NULL OR valid_to >= {SPLIT}))"
FRESH = f"fresh AS (SELECT id, src, type, coalesce(dst, value) AS object, valid_from, CAST(NULL AS BIGINT) AS valid_to, CAST(NULL AS BIGINT) AS expired_at FROM facts WHERE valid_from >= {SPLIT})"


def old_and_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = I.facts(spark, sf_dir).withColumn("object", F.coalesce("dst", "value"))
    null = F.lit(None).cast("long")
    old = f.filter((F.col("valid_from") < SPLIT) & (F.col("valid_to").isNull() | (F.col("valid_to") >= SPLIT)))
    cut = lambda x: x.select("id", "src", "type", "object", "valid_from", null.alias("valid_to"), null.alias("expired_at"))
    return cut(old), cut(f.filter(F.col("valid_from") >= SPLIT))


@query(sql(I.FACTS, CURRENT, FRESH, f"heads AS (SELECT src, type, arg_min(object, (valid_from, id)) AS first_object, min(valid_from) AS since FROM fresh GROUP BY 1, 2)", select=f"""SELECT id, src, type, object, valid_from, least(CASE WHEN shut THEN since END, valid_to) AS valid_to, CASE WHEN shut THEN {I.NOW} END AS expired_at FROM (
  SELECT c.*, since, coalesce(first_object <> object AND valid_from <= since, false) AS shut FROM current_facts c LEFT JOIN heads USING (src, type))
UNION ALL SELECT id, src, type, object, valid_from, lead(valid_from) OVER k, CASE WHEN lead(valid_from) OVER k IS NOT NULL THEN {I.NOW} END FROM fresh WINDOW k AS (PARTITION BY src, type ORDER BY valid_from, id)"""))  # fmt: skip
def q38_supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = old_and_new(spark, sf_dir)
    return temporal.superseded(old, new, I.NOW)


@query(sql(I.FACTS, select="SELECT src, type, count(*) AS n FROM facts WHERE type = 'status' AND expired_at IS NULL GROUP BY 1, 2 HAVING count(*) > 1"))
def q39_cardinality_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    still = I.facts(spark, sf_dir).withColumn("valid_to", F.lit(None).cast("long"))
    return temporal.cardinality_violations(still, CFG)


# Candidates: conversation turns claim something of their conversation.
TURNS = """turns AS (
  SELECT conv_id, turn, CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'agent' ELSE 'tool' END AS source_kind, 'k' || (conv_id % 40) AS subject,
         'says' AS predicate, length(coalesce(text, '')) % 5 AS object, 'e' || conv_id AS episode, row_number() OVER (ORDER BY conv_id, turn, role, text) AS seq FROM conversations
), keyed AS (SELECT *, substr(sha256(subject || chr(0) || predicate || chr(0) || object || chr(0) || episode), 1, 10) AS key, subject || '|' || predicate || '|' || object AS claim FROM turns)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    by = F.when(F.col("role") == "user", "user").when(F.col("role") == "assistant", "agent").otherwise("tool")
    rows = t.select(
        "conv_id", "turn", "role", "text", by.alias("by"), F.concat(F.lit("k"), (F.col("conv_id") % 40).cast("string")).alias("subject"), F.lit("says").alias("predicate"),
        (F.length(F.coalesce("text", F.lit(""))) % 5).cast("string").alias("object"), F.concat(F.lit("e"), F.col("conv_id").cast("string")).alias("episode"),
    )
    rows = rows.withColumns({"key": c.candidate_key(F.col("subject"), F.col("predicate"), F.col("object"), F.col("episode")), "claim": F.concat_ws("|", "subject", "predicate", "object")})
    return rows.withColumn("seq", F.struct("conv_id", "turn", "role", "text"))


@query(sql(TURNS, "seen AS (SELECT DISTINCT key FROM keyed WHERE conv_id % 10 = 0)", select="SELECT key, conv_id, turn FROM keyed WHERE key NOT IN (SELECT key FROM seen) QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq) = 1"))
def q47_candidate_key_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    return c.new_candidates(t, t.filter("conv_id % 10 = 0").select("key"), "seq").select("key", "conv_id", "turn")


CLAIMS = f"""claims AS (
  SELECT id, src AS subject_ref, type AS predicate, object, valid_from - (id % 5) * 60::BIGINT * 86400000 AS claimed_at, CASE id % 6 WHEN 0 THEN 'user' WHEN 1 THEN 'agent' WHEN 2 THEN 'import' WHEN 3 THEN 'web' WHEN 4 THEN 'tool' ELSE 'user' END AS source_kind,
         id % 11 = 0 AS from_triple, id % 2 = 0 AS explicit, CASE WHEN id % 13 = 0 THEN 'likes' ELSE type END AS said, id % 17 = 0 AS nameless, (id % 4)::DOUBLE AS support, id % 19 = 0 AS rejected FROM fresh
), held AS (SELECT src, type, list(object) AS objects, arg_min(valid_from, (valid_from, object)) AS conflict_from FROM current_facts GROUP BY 1, 2)"""
DECIDED = """decided AS (
  SELECT claims.*, coalesce(list_contains(objects, claims.object), false) AS same_object, objects IS NOT NULL AS clash, conflict_from,
         said IN ('status', 'supplied_by') AS known, NOT nameless AS named FROM claims LEFT JOIN held ON held.src = claims.subject_ref AND NOT nameless AND held.type = claims.said
)"""
DECIDE = """SELECT id, CASE WHEN source_kind IN ('web', 'tool') THEN 'queue: untrusted source' WHEN from_triple THEN 'queue: derived from triple cache'
  WHEN known AND named AND same_object THEN 'noop: corroborates a current fact' WHEN known AND named AND said = 'status' AND clash AND conflict_from > claimed_at THEN 'queue: older than the current fact'
  WHEN known AND named AND said = 'status' AND clash AND source_kind = 'user' AND explicit THEN 'supersede: contradicts a current fact (user-confirmed)' WHEN known AND named AND said = 'status' AND clash THEN 'queue: contradicts a current fact'
  WHEN known AND named THEN 'promote: known entity + known predicate + no conflict' WHEN NOT rejected AND support >= 2 THEN 'promote: corroborated by ' || support::INT || ' independent episode(s)'
  ELSE 'queue: ' || concat_ws(', ', CASE WHEN NOT named THEN 'new entity' END, CASE WHEN NOT known THEN 'unknown predicate' END) END AS decision FROM decided"""


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = old_and_new(spark, sf_dir)
    kinds = ["user", "agent", "import", "web", "tool", "user"]
    by = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("id") % 6 + 1).cast("int"))
    rows = new.select(
        "id", F.when(F.col("id") % 17 != 0, F.col("src")).alias("subject_ref"), F.when(F.col("id") % 13 == 0, "likes").otherwise(F.col("type")).alias("predicate"), "object",
        (F.col("valid_from") - (F.col("id") % 5) * 60 * 86_400_000).alias("claimed_at"), by.alias("by"), F.lit("high").alias("trust"), F.when(F.col("id") % 11 == 0, "triple").otherwise("episode").alias("origin"),
        (F.col("id") % 2 == 0).alias("explicit"), (F.col("id") % 4).cast("double").alias("support"), (F.col("id") % 19 == 0).alias("rejected"),
    )
    return c.gate(c.against_current(rows, old), merged(CFG, {"consolidation": {"corroboration": True}}))


@query(sql(I.FACTS, CURRENT, FRESH, CLAIMS, DECIDED, select=DECIDE))
def q48_gate_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir).select("id", F.concat_ws(": ", "action", "reason").alias("decision"))


WEIGHT = "CASE source_kind WHEN 'user' THEN 2e0 WHEN 'import' THEN 2e0 WHEN 'agent' THEN 1e0 ELSE 0e0 END"


@query(sql(TURNS, "pending AS (SELECT DISTINCT ON (claim, episode) claim, episode, source_kind FROM keyed WHERE conv_id % 10 = 0 AND source_kind = 'user')", f"fresh AS (SELECT k.*, p.episode IS NULL AS new FROM keyed k LEFT JOIN pending p USING (claim, episode) WHERE k.conv_id % 10 <> 0 OR k.conv_id % 20 = 0)",
           f"old AS (SELECT claim, sum({WEIGHT}) AS w FROM pending GROUP BY claim)",
           f"counted AS (SELECT f.*, CASE WHEN new AND row_number() OVER (PARTITION BY claim, episode ORDER BY seq) = 1 THEN {WEIGHT} ELSE 0e0 END AS w FROM fresh f)",
       select="SELECT conv_id, turn, support, least(1e0, 5e-1 + 2.5e-1 * greatest(0e0, support - 1e0)) AS confidence FROM (SELECT conv_id, turn, sum(c.w) OVER (PARTITION BY c.claim ORDER BY seq ROWS UNBOUNDED PRECEDING) + coalesce(old.w, 0e0) AS support FROM counted c LEFT JOIN old USING (claim))"))
def q49_corroboration_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    pending = t.filter("conv_id % 10 = 0 AND by = 'user'").select("claim", "episode", "by").distinct()
    out = c.with_support(t.filter("conv_id % 10 <> 0 OR conv_id % 20 = 0"), pending, "seq")
    return out.select("conv_id", "turn", "support", F.col("confidence_by_support").alias("confidence"))


@query(sql(I.ACCESS, "recalled AS (SELECT DISTINCT session, node FROM access)", "claims AS (SELECT event_id, session, 'd' || (user_id + event_id % 2) AS subject FROM access JOIN events USING (event_id))", select="SELECT event_id, node IS NOT NULL AS priority FROM claims LEFT JOIN recalled r ON r.session = claims.session AND r.node = claims.subject"))
def q50_reconsolidation_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = I.access(spark, sf_dir)
    users = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("d"), (F.col("user_id") + F.col("event_id") % 2).cast("string")).alias("subject_ref"))
    return c.priority(a.select("event_id", "session").join(users, "event_id"), a.select("session", "node")).select("event_id", "priority")


@query(sql(I.FACTS, CURRENT, FRESH, CLAIMS, DECIDED, f"verdicts AS ({DECIDE})", "queued AS (SELECT d.id, subject_ref || '|' || said || '|' || object AS claim, decision FROM decided d JOIN verdicts USING (id) WHERE NOT nameless)",
           select="SELECT id, claim FROM queued WHERE starts_with(decision, 'queue') AND claim NOT IN (SELECT claim FROM queued WHERE starts_with(decision, 'promote'))"))
def q51_pending_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decided(spark, sf_dir).filter("subject_ref IS NOT NULL").withColumn("claim", F.concat_ws("|", "subject_ref", "predicate", "object"))
    return c.left_pending(d.filter("action = 'queue'"), d.filter("action = 'promote'")).select("id", "claim")


@query(sql(I.FACTS, select="SELECT src AS node, sum(conf) AS importance, count(DISTINCT provenance) AS n_sources FROM (SELECT src, CASE trust WHEN 'high' THEN 1e0 WHEN 'medium' THEN 7.5e-1 ELSE 5e-1 END AS conf, 'o' || (id % 8) AS provenance FROM facts) GROUP BY src HAVING sum(conf) >= 3"))
def q52_reflection_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    conf = F.when(F.col("trust") == "high", 1.0).when(F.col("trust") == "medium", 0.75).otherwise(0.5)
    f = I.facts(spark, sf_dir).select("src", conf.alias("conf"), F.concat(F.lit("o"), (F.col("id") % 8).cast("string")).alias("provenance"))
    return c.reflections(f).select("node", "importance", F.size("sources").cast("long").alias("n_sources"))


@query("""SELECT doc_id, sha256(coalesce(text, '')) AS body_hash FROM documents WHERE doc_id % 5 = 0 OR doc_id % 3 <> 0 OR doc_id % 7 = 0 OR doc_id % 11 = 0""")
def q53_body_hash_reselect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents consolidated on dates of every third one; of those some have changed, some were never recorded."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("body"))
    episodes = d.withColumn("consolidated", F.when((F.col("doc_id") % 5 != 0) & (F.col("doc_id") % 3 == 0), F.lit("2024-01-01")))
    state = d.filter("doc_id % 11 <> 0").select("path", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body")), 256).alias("body_hash"))
    return c.unconsolidated(episodes, state).select("doc_id", "body_hash")


