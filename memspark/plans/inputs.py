"""How the driver's tables stand for the engine's: notes and passages from documents, facts from orders, edges from the star schema, the access log from events.

Each view is defined twice, as a DataFrame and as SQL for DuckDB, from the same rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, tokens
from ..operators import postings
from ..storage import files_of, spread

#: The moment at which queries are asked, after the last event (epoch milliseconds).
NOW = 1_706_745_600_000
STOP_SQL = "[" + ",".join(f"'{w}'" for w in STOP_WORDS) + "]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens_sql(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+'), lambda t: length(t) > 1 AND NOT list_contains({STOP_SQL}, t))"


def millis(c: str):
    return F.unix_millis(F.col(c).cast("timestamp"))


# Passages: the lines of documents.

PASSAGES = """passages AS (
  SELECT doc_id, lang, source, 'd' || doc_id || '#' || u.pos AS passage_id, u.line AS text FROM (
    SELECT doc_id, lang, source, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'line': x, 'pos': i - 1})) AS u FROM documents WHERE text IS NOT NULL)
)"""


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    each = docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))
    return each.select("doc_id", "lang", "source", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("#"), F.col("pos").cast("string")).alias("passage_id"), "text")


_stored: dict[tuple, postings.Postings] = {}


def stored_passages(spark: SparkSession, sf_dir: str) -> postings.Postings:
    """The passages' stored postings: built by the first query of a session that asks, and again when a file of the table changes."""
    key = (spark.sparkContext.applicationId, sf_dir, tuple(files_of(spark, f"{sf_dir}/documents.parquet")))
    if key not in _stored:
        _stored[key] = postings.build(passages(spark, sf_dir))
    return _stored[key]


# Queries: the content tokens of the benchmark's whole texts.

QUERIES = f"""queries AS (
  SELECT item_id AS query_id, list_aggregate({tokens_sql("text")}, 'string_agg', ' ') AS text FROM benchmark
)"""


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.array_join(tokens(F.col("text")), " ").alias("text"))


# Facts: a customer's order status, valid until its next order, recorded some days later.

FACTS = """facts AS (
  SELECT o_orderkey AS id, 'c' || o_custkey AS src, CASE WHEN o_orderkey % 4 = 0 THEN 's' || (o_orderkey % 97 + 1) END AS dst, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END AS value,
         CASE WHEN o_orderkey % 4 = 0 THEN 'supplied_by' ELSE 'status' END AS type, epoch_ms(o_orderdate) AS valid_from,
         lead(epoch_ms(o_orderdate)) OVER (PARTITION BY o_custkey, o_orderkey % 4 = 0 ORDER BY o_orderdate, o_orderkey) AS valid_to,
         epoch_ms(o_orderdate) + (o_orderkey % 30)::BIGINT * 86400000 AS recorded_at,
         CASE WHEN o_orderkey % 7 = 0 THEN epoch_ms(o_orderdate) + 90::BIGINT * 86400000 END AS expired_at,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'high' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END AS trust, epoch_ms(o_orderdate) AS declared_created
  FROM orders
)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.temporal import versions

    o = table(spark, sf_dir, "orders")
    linked = F.col("o_orderkey") % 4 == 0
    day = 86_400_000
    t = millis("o_orderdate")
    first = F.substring("o_orderpriority", 1, 1)
    rows = o.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.when(linked, F.concat(F.lit("s"), (F.col("o_orderkey") % 97 + 1).cast("string"))).alias("dst"),
        F.when(~linked, F.col("o_orderstatus")).alias("value"), F.when(linked, "supplied_by").otherwise("status").alias("type"), t.alias("at"), (t + (F.col("o_orderkey") % 30) * day).alias("recorded_at"),
        F.when(F.col("o_orderkey") % 7 == 0, t + 90 * day).alias("expired_at"), F.when(first.isin("1", "2"), "high").when(first == "3", "medium").otherwise("low").alias("trust"), t.alias("declared_created"),
    )
    return versions(rows, ["src", "type"], "at", "id").drop("at")


# Edges: regions contain nations, these customers; customers are linked to their suppliers; facts with an object.

EDGES = """link_counts AS (
  SELECT 'c' || o_custkey AS src, 's' || l_suppkey AS dst, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2
), edges AS (
  SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 'contains' AS origin, 1e0 AS weight, CAST(NULL AS VARCHAR) AS trust FROM nation
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'contains', 1e0, NULL FROM customer
  UNION ALL SELECT src, dst, 'link', 1e0 + ln(n::DOUBLE), CASE CAST(substr(dst, 2) AS BIGINT) % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END FROM link_counts
  UNION ALL SELECT src, dst, 'fact', 5e-1, trust FROM facts WHERE dst IS NOT NULL
)"""


def link_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer, supplier: a row for each item that one ordered from the other. Two columns of the orders pass for a small table; they aren't broadcast."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return orders.hint("merge").join(items, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("customer"), F.col("l_suppkey").alias("supplier"))


def link_edges(spark: SparkSession, sf_dir: str, pairs: DataFrame | None = None) -> DataFrame:
    """pairs: those of link_pairs, where they are stored. They are counted by their numbers, which are shorter than the names."""
    from ..operators.index import link_weights

    pairs = link_pairs(spark, sf_dir) if pairs is None else pairs
    name = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    return link_weights(pairs.select(F.col("customer").alias("src"), F.col("supplier").alias("dst"))).withColumns({"src": name("c", "src"), "dst": name("s", "dst")})


def tree_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    name = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    a = nation.select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst"))
    b = customer.select(name("n", "c_nationkey").alias("src"), name("c", "c_custkey").alias("dst"))
    return a.unionByName(b).select("src", "dst", F.lit("contains").alias("origin"), F.lit(1.0).alias("weight"), F.lit(None).cast("string").alias("trust"))


def edges(spark: SparkSession, sf_dir: str, pairs: DataFrame | None = None) -> DataFrame:
    k = F.substring("dst", 2, 20).cast("long") % 3
    links = link_edges(spark, sf_dir, pairs).select("src", "dst", F.lit("link").alias("origin"), "weight", F.when(k == 0, "low").when(k == 1, "medium").otherwise("high").alias("trust"))
    own = facts(spark, sf_dir).filter("dst IS NOT NULL").select("src", "dst", F.lit("fact").alias("origin"), F.lit(0.5).alias("weight"), "trust")
    return tree_edges(spark, sf_dir).unionByName(links).unionByName(own)


# Access log: a user's events are accesses of a document.

ACCESS = "access AS (SELECT 'd' || user_id AS node, epoch_us(ts) // 1000 AS t, 'u' || user_id || '-' || CAST(ts AS DATE) AS session, event_id FROM events)"


def access(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    return e.select(F.concat(F.lit("d"), user).alias("node"), millis("ts").alias("t"), F.concat(F.lit("u"), user, F.lit("-"), F.to_date("ts").cast("string")).alias("session"), "event_id")


def sql(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select if parts else select
