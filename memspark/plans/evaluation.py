"""Metrics, violations, comparisons, ablations; and smaller rules of review and lint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import source_trust
from ..functions.text import fenced, light_stem, link_target, period, wikilinks, words
from ..operators import consolidate, dreams, index, vector
from ..operators import evaluate as e
from . import inputs as I
from .inputs import sql, table
from .registry import query
from .retrieval import COSINE, VECTORS
from .upkeep import SCORES, scored

# Hits: the twenty nearest vectors of every twentieth. Gold: vectors of the query's label, any of a group counts.
HITS = (
    VECTORS,
    f"near AS (SELECT a.vec_id AS query_id, b.vec_id AS passage_id, {COSINE} AS score FROM vectors a, vectors b WHERE a.vec_id % 20 = 0)",
    "hits AS (SELECT query_id, passage_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, passage_id) AS rank FROM near) WHERE rank <= 20)",
    "gold AS (SELECT a.vec_id AS query_id, b.vec_id % 5 AS group_id, b.vec_id AS passage_id FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 20 = 0)",
)
METRICS = """ranks AS (SELECT query_id, group_id, min(rank) AS rank FROM gold LEFT JOIN hits USING (query_id, passage_id) GROUP BY 1, 2),
metrics AS (SELECT query_id, """ + ", ".join(f"count(*) FILTER (rank <= {k}) / count(*)::DOUBLE AS recall_{k}, count(*) FILTER (rank <= {k}) / {k}e0 AS precision_{k}" for k in e.KS) + """, coalesce(1e0 / min(rank), 0e0) AS mrr FROM ranks GROUP BY query_id)"""
ROUNDED = ", ".join(f"round({m}_{k}, 6) AS {m}_{k}" for k in e.KS for m in ("recall", "precision")) + ", round(mrr, 6) AS mrr"
RESULTS = """results AS (SELECT m.*, CASE label % 4 WHEN 0 THEN 'single-hop' WHEN 1 THEN 'multi-hop' WHEN 2 THEN 'temporal' ELSE 'trust' END AS kind, CASE WHEN query_id % 60 = 0 THEN 'holdout' ELSE 'dev' END AS split,
  CASE WHEN query_id % 40 = 0 THEN 'typed' ELSE 'wikilink' END AS mode, CASE WHEN query_id % 40 = 0 THEN 'wikilink->typed' ELSE 'none' END AS escalation FROM metrics m JOIN embeddings ON vec_id = query_id)"""


def hits_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vector.top_cosine(v.filter("id % 20 = 0").withColumnRenamed("id", "query_id"), v, 20).withColumnRenamed("id", "passage_id")


def gold_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    asked = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label")
    return asked.join(v, "label").select("query_id", (F.col("vec_id") % 5).alias("group_id"), F.col("vec_id").alias("passage_id"))


def metrics_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.metrics(hits_of(spark, sf_dir), gold_of(spark, sf_dir))


def results_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "label")
    k = F.col("label") % 4
    late = F.col("query_id") % 40 == 0
    return metrics_of(spark, sf_dir).join(v, "query_id").withColumns({
        "kind": F.when(k == 0, "single-hop").when(k == 1, "multi-hop").when(k == 2, "temporal").otherwise("trust"), "split": F.when(F.col("query_id") % 60 == 0, "holdout").otherwise("dev"),
        "mode": F.when(late, "typed").otherwise("wikilink"), "escalation": F.when(late, "wikilink->typed").otherwise("none"),
    })


def rounded(df: DataFrame) -> list:
    return [F.round(c, 6).alias(c) for c in df.columns if c.startswith(("recall_", "precision_")) or c == "mrr"]


@query(sql(*HITS, METRICS, select=f"SELECT query_id, {ROUNDED} FROM metrics"))
def q40_metrics_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics_of(spark, sf_dir)
    return m.select("query_id", *rounded(m))


@query(sql(*HITS, METRICS, RESULTS, select="SELECT kind AS value, count(*) AS n, round(avg(mrr), 6) AS mrr FROM results WHERE kind <> 'trust' GROUP BY kind"))
def q41_mrr_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.aggregate(results_of(spark, sf_dir), ["kind"]).select("value", "n", F.round("mrr", 6).alias("mrr"))


@query(sql(*HITS, METRICS, RESULTS, select="""SELECT CASE WHEN grouping(mode) = 0 THEN 'mode' WHEN grouping(kind) = 0 THEN 'kind' WHEN grouping(split) = 0 THEN 'split' WHEN grouping(kind_split) = 0 THEN 'kind_split' ELSE 'escalation' END AS grouping,
  coalesce(mode, kind, split, kind_split, escalation) AS value, count(*) AS n, round(avg(recall_5), 6) AS recall_5, round(avg(mrr), 6) AS mrr
FROM (SELECT *, kind || ':' || split AS kind_split FROM results) WHERE kind <> 'trust' GROUP BY GROUPING SETS ((mode), (kind), (split), (kind_split), (escalation))"""))
def q42_grouping_five_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results_of(spark, sf_dir).withColumn("kind_split", F.concat_ws(":", "kind", "split"))
    # The filter is on a key, so a copy of it goes by another name.
    out = e.aggregate(r.withColumn("kind_key", F.col("kind")), ["mode", "kind_key", "split", "kind_split", "escalation"])
    return out.select(F.when(F.col("grouping") == "kind_key", "kind").otherwise(F.col("grouping")).alias("grouping"), "value", "n", F.round("recall_5", 6).alias("recall_5"), F.round("mrr", 6).alias("mrr"))


@query(sql(*HITS, select="SELECT query_id, passage_id, rank FROM hits WHERE passage_id % 3 = 0"))
def q43_trust_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 6 != 0, (F.col("vec_id") % 3).cast("int")).alias("trust_rank"))
    return e.trust_violations(hits_of(spark, sf_dir), nodes, 1).select("query_id", "passage_id", F.col("rank").cast("long").alias("rank"))


@query(sql(*HITS, "before AS (SELECT a.query_id, a.passage_id AS first, b.passage_id AS second, a.rank AS r1, b.rank AS r2 FROM hits a JOIN hits b ON a.query_id = b.query_id AND b.passage_id % 97 = (a.passage_id + 1) % 97)",
           select="SELECT 'order' AS violation, query_id, first AS passage_id FROM before WHERE r2 < r1 UNION ALL SELECT 'absent', query_id, passage_id FROM hits WHERE passage_id = query_id UNION ALL SELECT 'vacuous', query_id, query_id FROM hits WHERE rank = 1 AND NOT EXISTS (SELECT 1 FROM hits o WHERE o.query_id = (hits.query_id + 20) % (SELECT max(query_id) + 20 FROM hits) AND o.passage_id = hits.query_id) UNION ALL SELECT 'missing', query_id, passage_id FROM gold WHERE passage_id % 50 = 7"))
def q44_order_absence(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hits_of(spark, sf_dir).select("query_id", "passage_id", "rank")
    a, b = (h.select("query_id", F.col("passage_id").alias(c)) for c in ("first", "second"))
    before = a.join(b, "query_id").filter("second % 97 = (first + 1) % 97")
    own = h.filter("rank = 1").select("query_id", F.col("query_id").alias("passage_id"))
    most = h.agg((F.max("query_id") + 20).alias("m"))
    paired = own.join(F.broadcast(most)).select("query_id", ((F.col("query_id") + 20) % F.col("m")).alias("paired_with"))  # one row
    nodes = table(spark, sf_dir, "embeddings").filter("vec_id % 50 <> 7").select(F.col("vec_id").alias("id"))
    parts = {
        "order": e.order_violations(h, before).select("query_id", F.col("first").alias("passage_id")), "absent": e.absence_violations(h, own).select("query_id", "passage_id"),
        "vacuous": e.vacuous(h, own, paired), "missing": e.missing_gold(gold_of(spark, sf_dir), nodes).select("query_id", "passage_id"),
    }
    out = None
    for name, rows in parts.items():
        rows = rows.select(F.lit(name).alias("violation"), "query_id", "passage_id")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(sql(*HITS, METRICS, "run AS (SELECT query_id, CASE WHEN query_id % 3 = 0 THEN round(mrr, 3) + 1e0 ELSE round(mrr, 6) END AS mrr FROM metrics WHERE query_id % 100 <> 0 UNION ALL SELECT -1, 0e0)",
           select="SELECT coalesce(a.query_id, b.query_id) AS query_id, CASE WHEN a.query_id IS NULL THEN 'added' WHEN b.query_id IS NULL THEN 'removed' WHEN round(a.mrr, 6) IS NOT DISTINCT FROM b.mrr THEN 'same' ELSE 'changed' END AS change FROM metrics a FULL JOIN run b ON a.query_id = b.query_id"))
def q45_baseline_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics_of(spark, sf_dir).select("query_id", F.round("mrr", 6).alias("mrr"))
    run = m.filter("query_id % 100 <> 0").withColumn("mrr", F.when(F.col("query_id") % 3 == 0, F.col("mrr") + 1.0).otherwise(F.col("mrr")))
    new = spark.createDataFrame([(-1, 0.0)], "query_id bigint, mrr double")
    return e.difference(m, run.unionByName(new), ["mrr"])


@query(sql(*SCORES, "settings AS (SELECT * FROM (VALUES ('all', 1e0, 3e-1, 2e-1), ('no-activation', 1e0, 0e0, 2e-1), ('no-importance', 1e0, 3e-1, 0e0)) x(setting, a, b, c))",
           select="SELECT setting, query_id, passage_id, rank FROM (SELECT setting, query_id, passage_id, row_number() OVER (PARTITION BY setting, query_id ORDER BY round(a * graph + b * activation + c * importance, 9) DESC, passage_id) AS rank FROM scored, settings) WHERE rank <= 8"))
def q46_ablation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = spark.createDataFrame([("all", 1.0, 0.3, 0.2), ("no-activation", 1.0, 0.0, 0.2), ("no-importance", 1.0, 0.3, 0.0)], "setting string, w_graph double, w_activation double, w_importance double")
    out = e.ablations(scored(spark, sf_dir).select("query_id", "passage_id", "graph", "activation", "importance"), settings).filter(F.col("rank") <= 8)
    return out.select("setting", "query_id", "passage_id", F.col("rank").cast("long").alias("rank"))


@query("SELECT event_type AS mode, quantile_disc(value, 5e-1) AS p50, quantile_disc(value, 9.5e-1) AS p95, max(value) AS most FROM events GROUP BY event_type")
def q68_latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.latencies(table(spark, sf_dir, "events").select(F.col("event_type").alias("mode"), F.col("value").alias("ms")))


@query(sql(*HITS, METRICS, RESULTS, select="SELECT round(avg(m), 6) AS macro_recall_5 FROM (SELECT kind, avg(recall_5) AS m FROM results GROUP BY kind)"))
def q69_macro_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.macro(results_of(spark, sf_dir)).select(F.round("macro_recall_5", 6).alias("macro_recall_5"))


@query("SELECT event_id AS a, user_id AS b, round(value, 6) AS salience FROM events WHERE event_type = 'purchase' ORDER BY value DESC, event_id, user_id LIMIT 3")
def q70_wake_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("a"), F.col("user_id").alias("b"), F.col("value").alias("salience"), F.when(F.col("event_type") == "purchase", "kept").otherwise("pruned").alias("status"))
    return dreams.wake(rows, 3).select("a", "b", F.round("salience", 6).alias("salience"))


ENDINGS = "|".join(consolidate.FILE_ENDINGS.split())
ODD = "CASE doc_id % 6 WHEN 0 THEN sha256(doc_id::VARCHAR)[1:10] WHEN 1 THEN doc_id::VARCHAR WHEN 2 THEN source || '/x' WHEN 3 THEN 'file' || doc_id || '.ts' WHEN 4 THEN repeat('long ', 20) ELSE 'Name ' || doc_id END"


@query(rf"SELECT doc_id, length(trim(n)) <= 80 AND NOT regexp_matches(trim(n), '[/\\]') AND NOT regexp_matches(trim(n), '(?i)^[0-9a-f]{{7,40}}$') AND NOT regexp_matches(trim(n), '^[0-9]+$') AND NOT regexp_matches(trim(n), '(?i)\.({ENDINGS})$') AS plausible FROM (SELECT doc_id, {ODD} AS n FROM documents)")
def q72_plausible_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id").cast("string")
    k = F.col("doc_id") % 6
    name = F.when(k == 0, F.substring(F.sha2(key, 256), 1, 10)).when(k == 1, key).when(k == 2, F.concat("source", F.lit("/x"))).when(k == 3, F.concat(F.lit("file"), key, F.lit(".ts"))).when(k == 4, F.lit("long " * 20)).otherwise(F.concat(F.lit("Name "), key))
    return table(spark, sf_dir, "documents").select("doc_id", consolidate.plausible_name(name).alias("plausible"))


@query("SELECT doc_id, coalesce(list_aggregate(list_transform(list_transform(regexp_extract_all(t, '\\[\\[([^\\[\\]\\n]+)\\]\\]', 1), lambda x: trim(regexp_extract(x, '^([^|#]*)', 1))), lambda x: regexp_replace(regexp_extract(x, '([^/]*)$', 1), '\\.(md|MD)$', '')), 'string_agg', ','), '') AS targets FROM (SELECT doc_id, '[[' || source || '/d' || doc_id || '.md|alias]] and [[d' || (doc_id + 1) || '#part]] x [[' || lang || ']]' AS t FROM documents)")
def q73_wikilink_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, after = F.col("doc_id").cast("string"), (F.col("doc_id") + 1).cast("string")
    text = F.concat(F.lit("[["), "source", F.lit("/d"), key, F.lit(".md|alias]] and [[d"), after, F.lit("#part]] x [["), "lang", F.lit("]]"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(wikilinks(text), link_target), ",").alias("targets"))


RAW = "CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END"


@query("""SELECT id, CASE k WHEN 3 THEN NULL ELSE epoch_ms(date_trunc(unit, d)) END AS start, CASE k WHEN 0 THEN epoch_ms(date_trunc('year', d) + INTERVAL 1 YEAR) WHEN 1 THEN epoch_ms(date_trunc('month', d) + INTERVAL 1 MONTH) WHEN 2 THEN epoch_ms(date_trunc('day', d) + INTERVAL 1 DAY) WHEN 4 THEN epoch_ms(date_trunc('second', d)) + 1 END AS stop FROM (
  SELECT o_orderkey AS id, o_orderkey % 5 AS k, o_orderdate AS d, ['year', 'month', 'day', 'day', 'second'][(o_orderkey % 5 + 1)::INT] AS unit FROM orders)""")
def q74_period_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    raw = F
    for i, pattern in enumerate(("yyyy", "yyyy-MM", "yyyy-MM-dd", None, "yyyy-MM-dd'T'HH:mm:ss")):
        raw = raw.when(k == i, F.date_format("o_orderdate", pattern) if pattern else F.lit("soon"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), raw.alias("raw")).withColumn("p", period(F.col("raw")))
    return rows.select("id", "p.start", "p.stop")


@query("""SELECT doc_id, coalesce(list_aggregate(list_transform(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+'), lambda w: CASE WHEN length(w) > 4 AND suffix(w, 'ing') THEN w[1:length(w) - 3] WHEN length(w) > 3 AND suffix(w, 'ed') THEN w[1:length(w) - 2] WHEN length(w) > 3 AND suffix(w, 'er') THEN w[1:length(w) - 2] WHEN length(w) > 3 AND suffix(w, 'es') THEN w[1:length(w) - 2] WHEN length(w) > 2 AND suffix(w, 's') THEN w[1:length(w) - 1] ELSE w END), 'string_agg', ' '), '') AS stems FROM documents""")
def q75_light_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(w, light_stem), " ").alias("stems"))


@query("SELECT conv_id, turn, CASE role WHEN 'user' THEN 'high' WHEN 'assistant' THEN 'medium' ELSE 'low' END AS trust, sha256(CASE WHEN role IN ('user', 'assistant') THEN coalesce(text, '') ELSE coalesce(text, '') || '!' END) AS sha FROM conversations")
def q76_source_trust_and_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = F.when(F.col("role") == "user", "user").when(F.col("role") == "assistant", "agent").otherwise("tool")
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", source_trust(by).alias("trust"), F.sha2(F.when(by == "tool", F.concat(fenced(t), F.lit("!"))).otherwise(t), 256).alias("sha"))


# Triples: adjacent tokens of a document's first line; every fourth is of another version of it.
TRIPLES = "held AS (SELECT doc_id, substr(sha256(coalesce(text, '')), 1, 16) AS content_hash FROM documents), triples AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'old' ELSE content_hash END AS content_hash, (doc_id % 10) / 1e1 AS conf FROM held)"


@query(sql(TRIPLES, select="SELECT t.doc_id AS passage_id, h.content_hash IS NULL AS stale, conf >= 8e-1 AND t.doc_id % 3 <> 0 AS candidate FROM triples t LEFT JOIN held h ON h.doc_id = t.doc_id AND h.content_hash = t.content_hash"))
def q77_triple_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("passage_id"), index.content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"))
    triples = held.select("passage_id", F.when(F.col("passage_id") % 4 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"), ((F.col("passage_id") % 10) / 10.0).alias("conf"))
    promoted = triples.filter("passage_id % 3 = 0")
    sure = consolidate.triple_candidates(triples, promoted).select("passage_id", F.lit(True).alias("candidate"))
    fresh = triples.join(held, ["passage_id", "content_hash"], "left_semi").select("passage_id", F.lit(False).alias("stale"))
    out = triples.join(fresh, "passage_id", "left").join(sure, "passage_id", "left")
    return out.select("passage_id", F.coalesce("stale", F.lit(True)).alias("stale"), F.coalesce("candidate", F.lit(False)).alias("candidate"))


@query(sql(I.ACCESS, select="SELECT session, count(*) AS n, count(DISTINCT node) AS n_nodes, min(t) AS first, max(t) AS last FROM access GROUP BY session"))
def q78_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.access(spark, sf_dir).groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("node").alias("n_nodes"), F.min("t").alias("first"), F.max("t").alias("last"))
