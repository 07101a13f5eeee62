"""Usage, scoring and recall; federation, associations, maintenance and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config, merged
from ..functions.scoring import base_level, compacted_sum, decayed, retrieval_probability
from ..functions.text import tokens
from ..operators import activation as act
from ..operators import dreams, extract, federate, index
from ..operators import graph as g
from ..operators import recall as r
from ..sources.models import FirstWords
from ..sources.vault import versions_at
from ..storage import new_path, spread, written
from ..streaming import access as stream
from . import graphs
from . import inputs as I
from .inputs import NOW, sql, table
from .registry import query
from .retrieval import LIMIT, SEARCH, searched

CFG = Config()
DECAY, DAYS, NOISE = CFG.retrieval.decay, CFG.retrieval.threshold_days, CFG.retrieval.noise
MIDDLE = 1_705_276_800_000

COMPACT = "SELECT node, count(*) AS count, min(t) AS first, max(t) AS last, list_aggregate(list_reverse(list_slice(list(t ORDER BY t DESC), 1, 10)), 'string_agg', ',') AS accesses FROM access GROUP BY node"


def listed(c: str):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)


@query(sql(I.ACCESS, select=COMPACT))
def q23_access_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return act.compact(I.access(spark, sf_dir)).select("node", "count", "first", "last", listed("accesses"))


def age(t: str) -> str:
    return f"pow(greatest(1e0, ({NOW} - {t}) / 1e3), -5e-1)"


TAIL = f"""summary AS (SELECT node, count(*) AS n, min(t) AS first FROM access WHERE t <= {MIDDLE} GROUP BY node),
shown AS (
  SELECT node, n * 2e0 * {age("first")} AS w, n, NULL::BIGINT AS t FROM summary UNION ALL SELECT node, {age("t")}, NULL, t FROM access WHERE t > {MIDDLE}
)"""


def tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = I.access(spark, sf_dir)
    return act.presentations(act.compact(a.filter(F.col("t") <= MIDDLE)), a, MIDDLE)


@query(sql(I.ACCESS, TAIL, select="SELECT node, coalesce(max(n), 0) AS folded, count(t) AS recent, max(t) AS last FROM shown GROUP BY node"))
def q24_presentations_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tail(spark, sf_dir).groupBy("node").agg(F.coalesce(F.max("count"), F.lit(0)).alias("folded"), F.count("t").alias("recent"), F.max("t").alias("last"))


@query(sql(I.ACCESS, select=f"SELECT node, round(ln(sum({age('t')})), 6) AS base FROM access GROUP BY node"))
def q25_base_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = I.access(spark, sf_dir).groupBy("node").agg(base_level(F.sum(decayed(F.col("t"), F.lit(NOW), DECAY))).alias("base"))
    return out.select("node", F.round("base", 6).alias("base"))


@query(sql(I.ACCESS, TAIL, f"whole AS (SELECT node, ln(count(*) * 2e0 * {age('min(t)')}) AS approximate FROM access GROUP BY node)", select="SELECT node, round(ln(sum(w)), 6) AS base, round(any_value(approximate), 6) AS approximate FROM shown JOIN whole USING (node) GROUP BY node"))
def q26_optimized_learning(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = act.compact(I.access(spark, sf_dir)).select("node", F.log(compacted_sum(F.col("count"), F.col("first"), F.lit(NOW), DECAY)).alias("approximate"))
    both = act.activation(tail(spark, sf_dir), F.lit(NOW), DECAY).join(whole, "node")
    return both.select("node", F.round("base", 6).alias("base"), F.round("approximate", 6).alias("approximate"))


PROBABILITY = "1e0 / (1e0 + exp(-({} + 5e-1 * ln(2592000e0))))"


@query(sql(I.ACCESS, f"bases AS (SELECT node, ln(sum({age('t')})) AS base FROM access GROUP BY node)", select=f"SELECT 'd' || doc_id AS node, round(coalesce({PROBABILITY.format('base')}, 0e0), 6) AS p FROM documents LEFT JOIN bases ON node = 'd' || doc_id"))
def q27_retrieval_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.access(spark, sf_dir).select("node", "t", F.lit(None).cast("long").alias("count"), F.lit(None).cast("long").alias("first"))
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("node"))
    met = docs.join(act.activation(rows, F.lit(NOW), DECAY), "node", "left")
    return met.select("node", F.round(retrieval_probability(F.col("base"), DECAY, DAYS, NOISE), 6).alias("p"))


# Scores: customers are passages; their masses come from nation seeds, their usage from the users' events.

SCORES = (*graphs.BASE, I.ACCESS, graphs.ADJACENT.format("'contains'"), graphs.SEEDS, graphs.SHARES, graphs.WALK, f"""masses AS (
  SELECT query_id, node, mass FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(mass, 9) DESC, node) AS nth FROM walk WHERE i = {graphs.ROUNDS} AND mass > 0) WHERE nth <= 400
), bases AS (SELECT 'c' || substr(node, 2) AS node, ln(sum({age('t')})) AS base FROM access GROUP BY 1),
scored AS (
  SELECT query_id, node AS passage_id, (c_custkey * 37) % 3000 AS size, mass / greatest(1e-12, max(mass) OVER (PARTITION BY query_id)) AS graph,
         coalesce({PROBABILITY.format("base")}, 0e0) AS activation, CASE WHEN c_acctbal > 5000 THEN 8e-1 WHEN c_acctbal > 0 THEN 5e-1 ELSE 2e-1 END AS importance
  FROM masses JOIN customer ON node = 'c' || c_custkey LEFT JOIN bases USING (node)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, passage_id) AS rank FROM (SELECT *, 1e0 * graph + 3e-1 * activation + 2e-1 * importance AS score FROM scored))""")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = graphs.nation_seeds(spark, sf_dir)
    mass = g.pagerank(seeds, g.adjacency(I.tree_edges(spark, sf_dir), "weight"), CFG.graph.damping, CFG.graph.tolerance, top=CFG.retrieval.candidates)
    c = table(spark, sf_dir, "customer")
    importance = F.when(F.col("c_acctbal") > 5000, 0.8).when(F.col("c_acctbal") > 0, 0.5).otherwise(0.2)
    passages = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("passage_id"), importance.alias("importance"), F.lit("high").alias("trust"), F.lit(None).cast("long").alias("created"), ((F.col("c_custkey") * 37) % 3000).alias("size"))
    rows = I.access(spark, sf_dir).select(F.concat(F.lit("c"), F.substring("node", 2, 20)).alias("node"), "t", F.lit(None).cast("long").alias("count"), F.lit(None).cast("long").alias("first"))
    return r.in_order(r.scored(r.candidates(mass, CFG.retrieval.candidates), passages, act.activation(rows, F.lit(NOW), DECAY), CFG))


@query(sql(*SCORES, select="SELECT query_id, passage_id, rank, round(score, 6) AS score FROM ranked"))
def q28_final_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("query_id", "passage_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


BUDGETED = """budgeted AS (
  SELECT query_id, 1::BIGINT AS at_rank, 1 AS taken, 2000 - (SELECT ceil(size / 4e0) FROM ranked x WHERE x.query_id = q.query_id AND x.rank = 1) AS room, 1 AS place, true AS kept FROM (SELECT DISTINCT query_id FROM ranked) q
  UNION ALL
  SELECT b.query_id, b.at_rank + 1, b.taken + fits::INT, b.room - CASE WHEN fits THEN cost ELSE 0 END, b.taken + fits::INT, fits FROM (
    SELECT b.*, ceil(r.size / 4e0) AS cost, b.taken < 8 AND ceil(r.size / 4e0) <= b.room AS fits FROM budgeted b JOIN ranked r ON r.query_id = b.query_id AND r.rank = b.at_rank + 1) b
)"""


def budgeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.within_budget(scored(spark, sf_dir), CFG.retrieval.top_k, CFG.retrieval.token_budget, cost=F.ceil(F.col("size") / F.lit(4.0)))


@query(sql(*SCORES, BUDGETED, select="SELECT b.query_id, passage_id, place::BIGINT AS rank FROM budgeted b JOIN ranked r ON r.query_id = b.query_id AND r.rank = at_rank WHERE kept"))
def q29_topk_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budgeted(spark, sf_dir).select("query_id", "passage_id", F.col("rank").cast("long").alias("rank"))


@query(sql(*SCORES, select="""SELECT query_id, n_hits, round(margin, 6) AS margin, margin < 5e-2 AS escalates FROM (
  SELECT query_id, count(*) AS n_hits, CASE WHEN count(*) > 1 THEN (max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2)) / max(score) FILTER (rank = 1) ELSE 0e0 END AS margin FROM ranked GROUP BY query_id)"""))
def q30_margin_escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.margins(scored(spark, sf_dir)).select("query_id", "n_hits", F.round("margin", 6).alias("margin"), (F.col("margin") < CFG.graph.ladder.min_top_margin).alias("escalates"))


# Recall over documents: passages are lines, importance comes from labels, links join notes that share a rare token.


def memory(spark: SparkSession, sf_dir: str) -> tuple[r.Memory, DataFrame]:
    docs, labels = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")), table(spark, sf_dir, "labels")
    label = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    note = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    lines = docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text")).join(label, "doc_id", "left")
    day = 86_400_000
    passages = lines.select(
        F.concat(note, F.lit("#"), F.col("pos").cast("string")).alias("passage_id"), note.alias("note_id"), F.concat("source", F.lit("/"), note, F.lit(".md")).alias("path"), note.alias("title"), F.lit(None).cast("string").alias("heading"), "text",
        F.when(F.col("quality") == 1, 0.8).when(F.col("quality") == 0, 0.2).alias("importance"), (F.lit(NOW) - (F.col("doc_id") % 365) * day).alias("created"), F.lit(None).cast("long").alias("updated"),
        F.when(F.col("toxic") == 1, "low").otherwise("high").alias("trust"),
    )
    passages = written(passages, "passages")  # an index is a table; here it is made first
    contains = passages.select(F.col("note_id").alias("src"), F.col("passage_id").alias("dst"), F.lit("contains").alias("origin"), F.lit(1.0).alias("weight"))
    # Notes that share a token of two to four notes are linked through its least note.
    words = written(docs.select(note.alias("note"), F.explode(F.array_distinct(tokens(F.coalesce("text", F.lit(""))))).alias("term")), "words")
    rare = words.groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter("n BETWEEN 2 AND 4").select("term")
    few = words.join(rare, "term").withColumn("least", F.min("note").over(Window.partitionBy("term")))  # only rare tokens' notes are put in order
    links = index.link_weights(few.filter("note <> least").select(F.col("note").alias("src"), F.col("least").alias("dst"))).withColumn("origin", F.lit("link"))
    edges = contains.unionByName(links.select("src", "dst", "origin", "weight"))
    null = {c: F.lit(None).cast("long") for c in ("valid_from", "valid_to", "recorded_at", "expired_at", "declared_created")}
    facts = passages.select("note_id").distinct().select(F.col("note_id").alias("src"), F.concat(F.lit("d"), (F.substring("note_id", 2, 20).cast("long") + 1).cast("string")).alias("dst"), F.lit("fact").alias("origin"), F.lit(1.0).alias("weight"))
    edges = edges.unionByName(facts).withColumns({**null, "trust": F.lit(None).cast("string"), "type": F.when(F.col("origin") == "fact", "follows").otherwise(F.col("origin"))}).withColumn("id", F.concat_ws(">", "src", "dst"))
    used = table(spark, sf_dir, "events").select(F.concat(F.lit("d"), F.col("user_id").cast("string"), F.lit("#0")).alias("node"), I.millis("ts").alias("t"), F.lit(None).cast("long").alias("count"), F.lit(None).cast("long").alias("first"))
    return r.Memory(passages, edges, presentations=used), passages


def recalled(spark: SparkSession, sf_dir: str, cfg: Config = CFG, mode: str = "auto", cued: bool = False) -> DataFrame:
    mem, _ = memory(spark, sf_dir)
    mem.edges = written(mem.edges, "edges")
    asked = I.queries(spark, sf_dir)
    hits = written(searched(spark, sf_dir), "hits")
    seeds = hits.select("query_id", F.col("passage_id").alias("node"), (1.0 / (60.0 + F.col("rank"))).alias("value"))
    cues = hits.filter("rank = 1").select("query_id", F.substring_index("passage_id", "#", 1).alias("node_id")) if cued else None
    return r.recall(asked, seeds, mem, cfg, mode, NOW, cues=cues, has_triples=False)


@query()
def q31_fact_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = recalled(spark, sf_dir, merged(CFG, {"retrieval": {"expansion": {"enabled": True}}}), "typed", cued=True)
    return out.select("query_id", "rank", "passage_id", F.round("score", 6).alias("score"), "via")


@query()
def q32_recall_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = recalled(spark, sf_dir)
    rounded = [F.round(c, 6).alias(c) for c in ("score", "graph", "activation", "importance")]
    return out.select("query_id", "rank", "passage_id", *rounded, "trust", "mode")


# Federation: each language is a vault.
LAYERS = [("agent", "en"), ("project", "fr"), ("global-agent", "de"), ("global", "es")]


@query(sql(*SEARCH, "layers AS (SELECT * FROM (VALUES ('en', 0, 1e0), ('fr', 1, 9e-1), ('de', 2, 8e-1), ('es', 3, 7e-1)) x(vault, precedence, weight))",
           "own AS (SELECT query_id, passage_id, score, lang AS vault, row_number() OVER (PARTITION BY query_id, lang ORDER BY round(score, 9) DESC, passage_id) AS rank FROM bm25 JOIN (SELECT passage_id, lang FROM passages) USING (passage_id))",
           select="SELECT query_id, vault, passage_id, round(fused, 9) AS fused, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 9) DESC, precedence, round(score, 9) DESC, passage_id) AS place FROM (SELECT *, weight / (60e0 + rank) AS fused FROM own JOIN layers USING (vault))"))
def q54_lineage_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.keyword import ranked

    hits = searched(spark, sf_dir).drop("rank").join(I.passages(spark, sf_dir).select("passage_id", F.col("lang").alias("vault")), "passage_id")
    out = federate.merged(ranked(hits, ["query_id", "vault"], "score", "passage_id"), LAYERS)
    return out.select("query_id", "vault", "passage_id", F.round("fused", 9).alias("fused"), F.col("place").cast("long").alias("place"))


@query("""WITH old AS (SELECT 'd' || doc_id AS path, sha256(coalesce(text, '')) AS h, 0 AS mtime FROM documents WHERE doc_id % 10 <> 1),
new AS (SELECT 'd' || doc_id AS path, sha256(CASE WHEN doc_id % 10 = 2 THEN coalesce(text, '') || '!' ELSE coalesce(text, '') END) AS h, CASE WHEN doc_id % 10 = 3 THEN 1 ELSE 0 END AS mtime FROM documents WHERE doc_id % 10 <> 4)
SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.h <> n.h THEN 'changed' WHEN o.mtime <> n.mtime THEN 'touched' ELSE 'same' END AS change FROM old o FULL JOIN new n ON o.path = n.path""")
def q55_file_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    file = lambda rows, text, mtime: rows.select("path", F.sha2(text, 256).alias("sha256"), mtime.cast("long").alias("mtime"))
    k = F.col("doc_id") % 10
    old = file(d.filter(k != 1), F.col("text"), F.lit(0))
    new = file(d.filter(k != 4), F.when(k == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text")), F.when(k == 3, 1).otherwise(0))
    return index.file_changes(old, new)


SPOKEN = "spoken AS (SELECT conv_id, list_aggregate(list(upper(substr(role, 1, 1)) || substr(role, 2) || ': ' || replace(coalesce(text, ''), chr(10), ' ') ORDER BY turn, role, text), 'string_agg', chr(10)) AS text FROM conversations GROUP BY conv_id)"


@query(sql(SPOKEN, "lines AS (SELECT conv_id, u.line, u.pos FROM (SELECT conv_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'line': x, 'pos': i - 1})) AS u FROM spoken))",
           "marked AS (SELECT *, regexp_matches(line, '^#+\\s+') AS h, regexp_matches(line, '^[\\w\\s]+:') AS s FROM lines)",
           "counted AS (SELECT *, count(*) FILTER (h) OVER w AS hs, count(*) FILTER (s) OVER w AS ss, count(*) FILTER (h) OVER o AS hn, count(*) FILTER (s) OVER o AS sn FROM marked WINDOW w AS (PARTITION BY conv_id), o AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING))",
       select="""SELECT conv_id, nth::BIGINT AS nth, boundary, sha256(text) AS sha FROM (SELECT conv_id, nth, boundary, string_agg(line, chr(10) ORDER BY pos) AS text FROM (
  SELECT *, CASE WHEN hs > 0 THEN 'heading' WHEN ss > 10 THEN 'turn' ELSE 'none' END AS boundary, CASE WHEN hs > 0 THEN hn WHEN ss > 10 THEN CASE WHEN sn = 0 THEN 0 ELSE (sn - 1) // greatest(5, ss // 5) + 1 END ELSE 0 END AS nth FROM counted) GROUP BY 1, 2, 3) WHERE trim(text) <> ''"""))  # fmt: skip
def q56_turn_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    line = F.concat(F.initcap("role"), F.lit(": "), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")))
    spoken = c.groupBy(F.col("conv_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    return index.segments(spoken).select(F.col("id").alias("conv_id"), F.col("nth").cast("long").alias("nth"), "boundary", F.sha2("text", 256).alias("sha"))


SQUEEZED = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


@query(f"""SELECT doc_id, item_id, true AS grounded FROM (SELECT doc_id, {SQUEEZED.format('text')} AS passage FROM documents) JOIN (SELECT item_id, {SQUEEZED.format('text')} AS quote FROM benchmark) ON contains(passage, quote) WHERE length(quote) >= 12
UNION ALL SELECT doc_id, -1, length({SQUEEZED.format('quote')}) >= 12 AND contains({SQUEEZED.format('text')}, {SQUEEZED.format('quote')}) FROM (SELECT doc_id, text, substr(text, 3, 10 + (doc_id % 5)::INT) AS quote FROM documents WHERE text IS NOT NULL)""")
def q57_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, b = table(spark, sf_dir, "documents").filter("text IS NOT NULL"), table(spark, sf_dir, "benchmark")
    one = dreams.quoted_in(b.select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote")), d.select(F.col("doc_id").alias("passage_id"), F.col("text").alias("passage")))
    own = F.substr("text", F.lit(3), (10 + F.col("doc_id") % 5).cast("int"))
    two = d.select("doc_id", F.lit(-1).cast("long").alias("item_id"), dreams.grounded(own, F.col("text")).alias("grounded"))
    return one.select(F.col("passage_id").alias("doc_id"), F.col("quote_id").alias("item_id"), F.lit(True).alias("grounded")).unionByName(two)


@query(sql(*graphs.BASE, I.ACCESS, graphs.ADJACENT.format("'contains'"), graphs.REACH, f"bases AS (SELECT 'n' || (CAST(substr(node, 2) AS BIGINT) % 25) AS node, ln(sum({age('t')})) AS base FROM access GROUP BY 1)",
           "norms AS (SELECT node, CASE WHEN max(base) OVER () > min(base) OVER () THEN (base - min(base) OVER ()) / (max(base) OVER () - min(base) OVER ()) ELSE 1e0 END AS norm FROM bases)",
       select="SELECT source, h.node, round(least(hops, 6) / 6e0 * 7.5e-1 * norm, 6) AS salience FROM hops h JOIN norms ON norms.node = source WHERE hops >= 2"))
def q58_salience(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.scoring import salience

    rows = I.access(spark, sf_dir).select(F.concat(F.lit("n"), (F.substring("node", 2, 20).cast("long") % 25).cast("string")).alias("node"), "t", F.lit(None).cast("long").alias("count"), F.lit(None).cast("long").alias("first"))
    norms = act.activation(rows, F.lit(NOW), DECAY).select(F.col("node").alias("source"), dreams.normalised(F.col("base")).alias("norm"))
    far = graphs.q21_bfs_hops(spark, sf_dir).filter(F.col("hops") >= CFG.dreaming.min_hops)
    return far.join(norms, "source").select("source", "node", F.round(salience(F.col("hops"), F.lit(0.75), F.col("norm")), 6).alias("salience"))


@query("""SELECT o_orderkey AS id, CASE WHEN NOT live THEN state WHEN expires < DATE '1998-01-01' THEN 'expired' WHEN action = 'endorse' THEN 'endorsed' WHEN action = 'dismiss' THEN 'dismissed' WHEN action = 'accept' THEN 'accepted' WHEN action = 'reject' THEN 'rejected' ELSE state END AS state FROM (
  SELECT *, state IN ('open', 'endorsed') AS live FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'endorsed' ELSE 'dismissed' END AS state, ['endorse', 'dismiss', 'accept', 'reject', 'none'][(o_orderkey % 5 + 1)::INT] AS action, CAST(o_orderdate AS DATE) + 14 AS expires FROM orders))""")
def q59_candidate_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "P", "endorsed").otherwise("dismissed")
    action = F.element_at(F.array(*[F.lit(x) for x in ("endorse", "dismiss", "accept", "reject", "none")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("id"), dreams.next_state(state, action, F.date_add(F.to_date("o_orderdate"), 14), F.lit("1998-01-01").cast("date")).alias("state"))


@query()
def q60_trigram_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.vectors import trigram_embedding

    return table(spark, sf_dir, "benchmark").select("item_id", trigram_embedding(F.col("text")).alias("vector"))


@query("""SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'wikilink' WHEN regexp_matches(source || '/d' || doc_id || '.md', '^src1[^/]*/.*$') THEN 'hipporag' WHEN regexp_matches(source || '/d' || doc_id || '.md', '^(?:.*/)?d[^/]*7\\.md$') THEN 'wikilink' ELSE 'typed' END AS mode FROM documents""")
def q63_extraction_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = merged(CFG, {"graph": {"scopes": (("src1*/**", "hipporag"), ("**/d*7.md", "wikilink"))}})
    path = F.concat("source", F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".md"))
    own = F.when(F.col("doc_id") % 50 == 0, "wikilink")
    return table(spark, sf_dir, "documents").select("doc_id", index.extraction_mode(cfg, own, path).alias("mode"))


@query("""SELECT event_id, TRY_CAST(json_extract_string(CASE WHEN json_valid(p) THEN p END, '$.k') AS BIGINT) AS k FROM (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN props || '}{' ELSE props END AS p FROM events)""")
def q64_json_props_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 9 == 0, F.concat("props", F.lit("}{"))).otherwise(F.col("props"))
    # A second value after the first is malformed, which the reader by itself would let pass.
    whole = F.when(text.rlike(r"^\s*\{[^{}]*\}\s*$"), text)
    return e.select("event_id", F.from_json(whole, "k bigint")["k"].alias("k"))


@query(sql(I.ACCESS, select=COMPACT))
def q65_stream_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    events = stream.events_as_stream(spark, sf_dir, schema, "events.parquet")
    access = events.select(F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("node"), I.millis("ts").alias("t"))
    return stream.run_to_end(stream.compact_stream(access), "compaction").select("node", "count", "first", "last", listed("accesses"))


@query("""WITH t AS (SELECT * FROM (VALUES (915148800000), (978307200000)) x(t)) SELECT path, t, hash FROM (
  SELECT 'c' || o_custkey AS path, t, o_orderkey AS hash, row_number() OVER (PARTITION BY o_custkey, t ORDER BY o_orderdate DESC, o_orderkey DESC) AS nth FROM orders, t WHERE epoch_ms(o_orderdate) <= t) WHERE nth = 1""")
def q66_versions_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    versions = o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("path"), I.millis("o_orderdate").alias("committed_at"), F.col("o_orderkey").alias("hash"), F.col("o_orderstatus").alias("text"))
    return versions_at(versions, spark.createDataFrame([(915148800000,), (978307200000,)], "t bigint")).select("path", "t", "hash")


@query(sql(I.ACCESS, select=f"SELECT max(t) AS watermark, {LIMIT} AS seed_limit FROM access"))
def q67_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return act.watermark(I.access(spark, sf_dir)).withColumn("seed_limit", F.lit(LIMIT))


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[a-z]+') AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id AS passage_id, w[1] AS subject, 'before' AS predicate, w[2] AS object, 0.9e0 AS conf FROM w WHERE len(w) >= 2""")
def q92_extraction_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of every document by a run with a stand-in model; a reply without JSON loses its own text alone."""
    passages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    path = new_path(spark, "answers")
    extract.run(passages, path, extract.TRIPLES, FirstWords, "first-words")
    return extract.triples(passages, path, "first-words").select("passage_id", "subject", "predicate", "object", "conf")
