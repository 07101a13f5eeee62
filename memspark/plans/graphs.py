"""Edges, filters, PageRank, distances and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import graph as g
from ..operators import push
from ..storage import delete, new_path
from . import inputs as I
from .inputs import sql, table
from .registry import query

CFG = Config()
ROUNDS = g.iterations(CFG.graph.damping, CFG.graph.tolerance, CFG.graph.max_iterations)
BASE = (I.FACTS, I.EDGES)
RANK = "CASE trust WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 END"


@query(sql(*BASE, select="SELECT src, dst, round(1e0 + ln(n::DOUBLE), 6) AS weight FROM link_counts"))
def q11_edge_build_link_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.link_edges(spark, sf_dir).select("src", "dst", F.round("weight", 6).alias("weight"))


@query(sql(*BASE, select="SELECT origin, count(*) AS n, round(sum(w), 4) AS w FROM (SELECT origin, weight * CASE origin WHEN 'fact' THEN 1.5e0 ELSE 1e0 END AS w FROM edges WHERE origin IN ('contains', 'link', 'fact', 'provenance')) GROUP BY origin"))
def q12_edge_mode_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = g.mode_edges(I.edges(spark, sf_dir), "typed", CFG.graph.origin_weights)
    return used.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("w"), 4).alias("w"))


@query(sql(*BASE, select=f"SELECT origin, trust, count(*) AS n FROM edges WHERE trust IS NULL OR {RANK} >= 1 GROUP BY 1, 2"))
def q13_edge_trust_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.edges(spark, sf_dir).filter(g.trusted("medium")).groupBy("origin", "trust").agg(F.count(F.lit(1)).alias("n"))


@query(sql(I.FACTS, select="SELECT id, src, type FROM facts WHERE expired_at IS NULL"))
def q14_edges_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.facts(spark, sf_dir).filter(g.believed_now()).select("id", "src", "type")


TIMES = "times AS (SELECT * FROM (VALUES (1, 852076800000), (2, 915148800000), (3, 978307200000)) x(time_id, t))"


def times(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, 852076800000), (2, 915148800000), (3, 978307200000)], "time_id int, t bigint")


BELIEVED = "declared_created <= t AND recorded_at <= t AND (expired_at IS NULL OR expired_at > t) AND valid_from <= t AND (valid_to IS NULL OR valid_to > t)"


@query(sql(I.FACTS, TIMES, select=f"SELECT time_id, id, src, type FROM facts, times WHERE {BELIEVED}"))
def q15_edges_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = I.facts(spark, sf_dir).join(F.broadcast(times(spark)), g.believed_at(F.col("t")))  # three moments
    return met.select("time_id", "id", "src", "type")


ADJACENT = """used AS (SELECT src, dst, weight AS w FROM edges WHERE origin IN ({})), adjacent AS (
  SELECT a, b, sum(w) AS w FROM (SELECT src AS a, dst AS b, w FROM used UNION ALL SELECT dst, src, w FROM used) WHERE a <> b GROUP BY 1, 2
), moves AS (SELECT a, b, w / sum(w) OVER (PARTITION BY a) AS p FROM adjacent)"""
WALK = f"""walk AS (
  SELECT 0 AS i, query_id, node, s AS mass FROM shares
  UNION ALL
  SELECT i, query_id, node, sum(mass) AS mass FROM (
    SELECT w.i + 1 AS i, w.query_id, m.b AS node, 5e-1 * w.mass * m.p AS mass FROM walk w JOIN moves m ON w.node = m.a WHERE w.i < {ROUNDS}
    UNION ALL SELECT k.i + 1, s.query_id, s.node, 5e-1 * s.s FROM shares s JOIN (SELECT DISTINCT i, query_id FROM walk WHERE i < {ROUNDS}) k ON k.query_id = s.query_id)
  GROUP BY i, query_id, node
)"""
MASSES = f"SELECT query_id, node, round(mass, 6) AS mass FROM walk WHERE i = {ROUNDS} AND round(mass, 6) > 0"


# The typed mode's edges, by the weights of their origins.
TYPED = ADJACENT.format("'contains', 'link', 'fact'").replace("weight AS w FROM edges", "weight * CASE origin WHEN 'fact' THEN 1.5e0 ELSE 1e0 END AS w FROM edges")


@query(sql(*BASE, ADJACENT.format("'contains', 'link'"), select="SELECT a AS node, round(sum(w), 5) AS degree FROM adjacent GROUP BY a"))
def q16_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = g.mode_edges(I.edges(spark, sf_dir), "wikilink", CFG.graph.origin_weights)
    return g.degrees(g.adjacency(used)).select("node", F.round("degree", 5).alias("degree"))


def ranked(seeds: DataFrame, edges: DataFrame, weight: str = "weight", isolated: bool = False, source: str | None = None) -> DataFrame:
    """source: the scratch table that the edges are read from, if any; it is deleted as soon as they have been read."""
    spark = seeds.sparkSession
    graph = push.prepared(g.adjacency(edges, weight), source=source)
    mass = g.pagerank(seeds, graph, CFG.graph.damping, CFG.graph.tolerance, isolated=isolated)
    delete(spark, graph.path)  # the masses are stored
    return mass.withColumn("mass", F.round("mass", 6)).filter("mass > 0")


@query(sql(*BASE, ADJACENT.format("'contains'"), "shares AS (SELECT 1 AS query_id, 'r1' AS node, 1e0 AS s)", WALK, select=MASSES))
def q17_ppr_single_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark.createDataFrame([(1, "r1", 1.0)], "query_id int, node string, value double"), I.tree_edges(spark, sf_dir))


SEEDS = "seeds AS (SELECT n_nationkey AS query_id, 'n' || n_nationkey AS node, 3e0 AS value FROM nation UNION ALL SELECT n_nationkey, 'r' || n_regionkey, 1e0 FROM nation UNION ALL SELECT n_nationkey, 'x' || n_nationkey, 2e0 FROM nation)"
SHARES = "shares AS (SELECT query_id, node, value / sum(value) OVER (PARTITION BY query_id) AS s FROM seeds WHERE node IN (SELECT a FROM adjacent))"


def nation_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey").cast("string")
    each = F.array(*[F.struct(F.concat(F.lit(k), c).alias("node"), F.lit(v).alias("value")) for k, c, v in (("n", key, 3.0), ("r", F.col("n_regionkey").cast("string"), 1.0), ("x", key, 2.0))])
    return n.select(F.col("n_nationkey").alias("query_id"), F.explode(each).alias("s")).select("query_id", "s.node", "s.value")


def typed_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """src, dst, w and the scratch table that holds them, made in two steps: the shuffles of the join are gone before the pairs are counted."""
    pairs, at = new_path(spark, "pairs"), new_path(spark, "edges")
    used = g.mode_edges(I.edges(spark, sf_dir, push.stored(I.link_pairs(spark, sf_dir), pairs)), "typed", CFG.graph.origin_weights)
    out = push.stored(used.select("src", "dst", "w"), at)
    delete(spark, pairs)
    return out, at


@query(sql(*BASE, TYPED, SEEDS, SHARES, WALK, select=MASSES))
def q18_ppr_multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, at = typed_edges(spark, sf_dir)
    return ranked(nation_seeds(spark, sf_dir), edges, "w", source=at)


SCOPE = "scope AS (SELECT 'r1' AS id UNION SELECT 'n' || n_nationkey FROM nation WHERE n_regionkey = 1 UNION SELECT 'c' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 UNION SELECT 's' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1)"
SCOPED = """used AS (SELECT src, dst, weight AS w FROM edges WHERE origin IN ('contains', 'link') AND src IN (SELECT id FROM scope) AND dst IN (SELECT id FROM scope)), adjacent AS (
  SELECT a, b, sum(w) AS w FROM (SELECT src AS a, dst AS b, w FROM used UNION ALL SELECT dst, src, w FROM used) WHERE a <> b GROUP BY 1, 2
), moves AS (SELECT a, b, w / sum(w) OVER (PARTITION BY a) AS p FROM adjacent)"""


@query(sql(*BASE, SCOPE, SCOPED, "shares AS (SELECT 1 AS query_id, 'r1' AS node, 1e0 AS s)", WALK, select=MASSES))
def q19_ppr_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").filter("n_regionkey = 1").select("n_nationkey")
    name = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string")).alias("id")
    ids = spark.createDataFrame([("r1",)], "id string").unionByName(nation.select(name("n", "n_nationkey")))
    ids = ids.unionByName(table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(name("c", "c_custkey")))
    ids = ids.unionByName(table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(name("s", "s_suppkey")))
    used = g.mode_edges(I.edges(spark, sf_dir), "wikilink", CFG.graph.origin_weights)
    return ranked(spark.createDataFrame([(1, "r1", 1.0)], "query_id int, node string, value double"), g.scoped(used, ids))


@query(sql(*BASE, TYPED, SEEDS, SHARES, WALK, select=MASSES + " UNION ALL SELECT query_id, node, value * 5e-1 FROM seeds WHERE node NOT IN (SELECT a FROM adjacent)"))
def q20_isolated_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, at = typed_edges(spark, sf_dir)
    return ranked(nation_seeds(spark, sf_dir), edges, "w", isolated=True, source=at)


REACH = """reach AS (
  SELECT 0 AS hops, 'n' || n_nationkey AS source, 'n' || n_nationkey AS node FROM nation
  UNION SELECT hops + 1, source, b FROM reach JOIN adjacent ON node = a WHERE hops < 4
), hops AS (SELECT source, node, min(hops) AS hops FROM reach GROUP BY 1, 2)"""


@query(sql(*BASE, ADJACENT.format("'contains'"), REACH, select="SELECT source, node, hops FROM hops"))
def q21_bfs_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"))
    return g.hops(nations, g.adjacency(I.tree_edges(spark, sf_dir), "weight"), 4)


PAIRS = "pairs AS (SELECT c_custkey AS pair_id, 'c' || c_custkey AS src, 'c' || (c_custkey * 7 % (SELECT max(c_custkey) FROM customer) + 1) AS dst FROM customer WHERE c_custkey % 20 = 0)"


@query(sql(*BASE, "tree AS (SELECT src AS a, dst AS b FROM edges WHERE origin = 'contains' UNION SELECT dst, src FROM edges WHERE origin = 'contains')", PAIRS, """paths AS (
  SELECT pair_id, src AS here, dst, [src] AS nodes FROM pairs
  UNION ALL SELECT pair_id, b, dst, list_append(nodes, b) FROM paths JOIN tree ON here = a WHERE len(nodes) <= 5 AND NOT list_contains(nodes, b) AND here <> dst AND (b = dst OR substr(b, 1, 1) <> 'c')
)""", select="SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY nodes) AS nth, list_aggregate(nodes, 'string_agg', '>') AS nodes, depth FROM (SELECT pair_id, nodes, len(nodes) - 1 AS depth, min(len(nodes)) OVER (PARTITION BY pair_id) AS least FROM paths WHERE here = dst) WHERE depth + 1 = least QUALIFY nth <= 3"))  # fmt: skip
def q22_relate_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    most = c.agg(F.max("c_custkey").alias("most"))
    pairs = c.filter("c_custkey % 20 = 0").join(F.broadcast(most)).select(F.col("c_custkey").alias("pair_id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("src"), F.concat(F.lit("c"), (F.col("c_custkey") * 7 % F.col("most") + 1).cast("string")).alias("dst"))
    out = g.shortest_paths(pairs, I.tree_edges(spark, sf_dir))
    return out.select("pair_id", F.col("nth").cast("long").alias("nth"), F.array_join("nodes", ">").alias("nodes"), F.col("depth").cast("long").alias("depth"))


@query(sql(*BASE, "one AS (SELECT DISTINCT src, dst FROM edges)", select="SELECT a, b, c, nth FROM (SELECT x.src AS a, x.dst AS b, y.dst AS c, row_number() OVER (PARTITION BY x.src ORDER BY x.dst, y.dst) AS nth FROM one x JOIN one y ON x.dst = y.src WHERE x.src <> y.dst) WHERE nth <= 3"))
def q62_two_hop_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.two_hop_chains(I.edges(spark, sf_dir)).select("a", "b", "c", F.col("nth").cast("long").alias("nth"))


@query(sql(*BASE, select="SELECT 'nodes' AS what, kind AS key, count(*) AS n FROM (SELECT 'region' AS kind FROM region UNION ALL SELECT 'nation' FROM nation UNION ALL SELECT 'customer' FROM customer UNION ALL SELECT 'supplier' FROM supplier UNION ALL SELECT 'part' FROM part) GROUP BY kind UNION ALL SELECT 'edges', origin, count(*) FROM edges GROUP BY origin UNION ALL SELECT 'superseded', 'fact', count(*) FROM facts WHERE expired_at IS NOT NULL"))
def q61_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.index import stats

    nodes = None
    for kind in ("region", "nation", "customer", "supplier", "part"):
        part = table(spark, sf_dir, kind).select(F.lit(kind).alias("kind"))
        nodes = part if nodes is None else nodes.unionByName(part)
    edges = I.edges(spark, sf_dir).select("origin", F.lit(None).cast("long").alias("expired_at"))
    old = I.facts(spark, sf_dir).select(F.lit("fact").alias("origin"), "expired_at").filter("expired_at IS NOT NULL")
    return stats(nodes, edges).unionByName(stats(nodes.limit(0), old).filter("what = 'superseded'"))


