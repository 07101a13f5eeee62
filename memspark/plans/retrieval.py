"""Tokens, keyword and vector search, fusion, scopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import keyword, lists, postings, vector
from ..operators.fusion import fuse, in_scope
from ..sources import models
from ..storage import spread, written
from . import inputs as I
from .inputs import sql, table, tokens_sql
from .registry import query

LIMIT = 20

# Shared SQL: BM25 over the passages for every query.
POSTINGS = f"""postings AS (
  SELECT passage_id, term, count(*)::DOUBLE AS tf FROM (SELECT passage_id, unnest({tokens_sql("text")}) AS term FROM passages) GROUP BY 1, 2
), lengths AS (SELECT passage_id, len({tokens_sql("text")})::DOUBLE AS length FROM passages),
stats AS (SELECT count(*)::DOUBLE AS n, avg(length) AS avg_length FROM lengths),
terms AS (SELECT DISTINCT query_id, unnest({tokens_sql("text")}) AS term FROM queries),
df AS (SELECT term, count(*)::DOUBLE AS df FROM postings GROUP BY term)"""
BM25 = f"""bm25 AS (
  SELECT query_id, passage_id, rank, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, passage_id) AS rank FROM (
      SELECT query_id, passage_id, sum(ln(1e0 + (n - df + 5e-1) / (df + 5e-1)) * tf * 2.2e0 / (tf + 1.2e0 * (2.5e-1 + 7.5e-1 * length / avg_length))) AS score
      FROM terms JOIN postings USING (term) JOIN df USING (term) JOIN lengths USING (passage_id), stats GROUP BY 1, 2))
  WHERE rank <= {LIMIT}
)"""
OVERLAP = f"""shared AS (
  SELECT query_id, passage_id, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM (
      SELECT query_id, passage_id, count(*) AS score FROM terms JOIN postings USING (term) GROUP BY 1, 2))
  WHERE rank <= {LIMIT}
)"""
SEARCH = (I.PASSAGES, I.QUERIES, POSTINGS, BM25)
FUSED = """fused AS (
  SELECT query_id, passage_id, sum(1e0 / (60e0 + rank)) AS score, string_agg(via, ',' ORDER BY via) AS via FROM (
    SELECT query_id, passage_id, rank, 'keyword' AS via FROM bm25 UNION ALL SELECT query_id, passage_id, rank, 'overlap' FROM shared)
  GROUP BY 1, 2
)"""


def searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.search(I.stored_passages(spark, sf_dir), I.queries(spark, sf_dir), LIMIT)


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = keyword.overlap_search(I.queries(spark, sf_dir), I.passages(spark, sf_dir), LIMIT)
    return fuse({"keyword": searched(spark, sf_dir), "overlap": other})


@query(f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, {tokens_sql('coalesce(text, chr(32))')} AS t FROM documents)")
def q01_tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", tokens(F.coalesce("text", F.lit(" "))).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query(sql(I.PASSAGES, f"t AS (SELECT {tokens_sql('text')} AS t FROM passages)", f"w AS (SELECT passage_id, unnest({tokens_sql('text')}) AS term FROM passages)",
       select="SELECT (SELECT count(*) FROM t) AS n_passages, (SELECT round(avg(len(t)), 6) FROM t) AS avg_length, (SELECT count(DISTINCT term) FROM w) AS n_terms, (SELECT count(*) FROM (SELECT DISTINCT passage_id, term FROM w)) AS n_postings"))
def q02_bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.passages(spark, sf_dir)
    posts = keyword.postings(p).groupBy("term").agg(F.count(F.lit(1)).alias("df")).agg(F.count(F.lit(1)).alias("n_terms"), F.sum("df").alias("n_postings"))
    return keyword.statistics(p).join(F.broadcast(posts)).select(F.col("n").alias("n_passages"), F.round("avg_length", 6).alias("avg_length"), "n_terms", "n_postings")


@query(sql(*SEARCH, select="SELECT query_id, passage_id, rank, round(score, 6) AS score FROM bm25"))
def q03_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searched(spark, sf_dir).select("query_id", "passage_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


NAMES = """names AS (
  SELECT 'b' || item_id AS node_id, list_aggregate(list_slice(string_split(lower(text), ' '), 1, 1 + (item_id % 3)::INT), 'string_agg', ' ') AS name FROM benchmark
)"""
NORM = "' ' || regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' '"


@query(sql(NAMES, f"asked AS (SELECT doc_id AS query_id, {NORM.format('text')} AS q FROM documents WHERE text IS NOT NULL)", "known AS (SELECT node_id, ' ' || trim(regexp_replace(name, '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ' AS needle FROM names WHERE length(name) >= 3)",
       select="SELECT DISTINCT query_id, node_id FROM asked JOIN known ON contains(q, needle) WHERE trim(needle) <> ''"))
def q04_entity_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    name = F.array_join(F.slice(F.split(F.lower("text"), " "), F.lit(1), (1 + F.col("item_id") % 3).cast("int")), " ")
    names = b.select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("node_id"), name.alias("name"))
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("query_id"), "text")
    return keyword.entity_cues(docs, names)


COSINE = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"
VECTORS = "vectors AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"


@query(sql(VECTORS, f"near AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {COSINE} AS score FROM vectors a, vectors b WHERE a.vec_id % 20 = 0)",
       select="SELECT query_id, id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM near) WHERE rank <= 10"))
def q05_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    asked = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    out = vector.top_cosine(asked, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 10)
    return out.select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(sql(VECTORS, f"near AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {COSINE} AS score FROM vectors a, vectors b WHERE a.vec_id % 20 = 0)",
       select="SELECT query_id, id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM near) WHERE rank <= 10"))
def q91_vector_lists_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = e.filter("id % 20 = 0").withColumnRenamed("id", "query_id")
    out = lists.search(lists.build(e), asked, 10)
    return out.select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(sql(*SEARCH, OVERLAP, FUSED, select="SELECT query_id, passage_id, round(score, 9) AS score, via FROM fused"))
def q06_rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(spark, sf_dir).select("query_id", "passage_id", F.round("score", 9).alias("score"), F.array_join("via", ",").alias("via"))


def scope_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.passages(spark, sf_dir)
    note = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    path = F.concat("source", F.lit("/"), note, F.lit(".md"))
    passages = p.select(F.col("passage_id").alias("id"), F.lit("passage").alias("kind"), note.alias("note_id"), path.alias("path"), F.array("lang").alias("tags"))
    notes = table(spark, sf_dir, "documents").select(note.alias("id"), F.lit("note").alias("kind"), F.lit(None).cast("string").alias("note_id"), path.alias("path"), F.array("lang").alias("tags"))
    return notes.unionByName(passages)


@query(sql(*SEARCH, "placed AS (SELECT passage_id, source || '/d' || doc_id || '.md' AS path FROM passages)", select="SELECT query_id, passage_id, rank FROM bm25 JOIN placed USING (passage_id) WHERE path = 'src1' OR starts_with(path, 'src1/')"))
def q07_scope_path_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.graph import scope_ids

    return in_scope(searched(spark, sf_dir), scope_ids(scope_nodes(spark, sf_dir), "src1/")).select("query_id", "passage_id", F.col("rank").cast("long").alias("rank"))


@query(sql(*SEARCH, select="SELECT query_id, passage_id, rank FROM bm25 JOIN (SELECT passage_id FROM passages WHERE lang = 'en') USING (passage_id)"))
def q08_scope_tag_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.graph import scope_ids

    hits = written(searched(spark, sf_dir), "hits")  # few, so that the scope is worked out for them alone
    return in_scope(hits, scope_ids(scope_nodes(spark, sf_dir), "tag:en", among=hits.select(F.col("passage_id").alias("id")))).select("query_id", "passage_id", F.col("rank").cast("long").alias("rank"))


WEB = f"""web AS (
  SELECT page_id AS passage_id, {tokens_sql("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title, {tokens_sql("regexp_replace(html, '<[^>]*>', ' ', 'g')")} AS body FROM pages
), q3 AS (SELECT DISTINCT item_id AS query_id, unnest({tokens_sql("text")}) AS term FROM benchmark),
weighted AS (
  SELECT passage_id, term, sum(w) AS tf FROM (SELECT passage_id, unnest(title) AS term, 2e0 AS w FROM web UNION ALL SELECT passage_id, unnest(body), 1e0 FROM web) GROUP BY 1, 2
), sizes AS (SELECT passage_id, (len(title) + len(body))::DOUBLE AS length FROM web),
totals AS (SELECT count(*)::DOUBLE AS n, avg(length) AS avg_length FROM sizes),
found AS (SELECT term, count(*)::DOUBLE AS df FROM weighted GROUP BY term)"""


@query(sql(WEB, select=f"""SELECT query_id, passage_id, rank, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, passage_id) AS rank FROM (
    SELECT query_id, passage_id, sum(ln(1e0 + (n - df + 5e-1) / (df + 5e-1)) * tf * 2.2e0 / (tf + 1.2e0 * (2.5e-1 + 7.5e-1 * length / avg_length))) AS score
    FROM q3 JOIN weighted USING (term) JOIN found USING (term) JOIN sizes USING (passage_id), totals GROUP BY 1, 2))
WHERE rank <= {LIMIT}"""))
def q09_field_weighted_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("passage_id"), F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_replace("html", "<[^>]*>", " ").alias("body"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(tokens(F.col("text")), " ").alias("text"))
    out = keyword.bm25_search(asked, pages, LIMIT, {"title": 2.0, "body": 1.0})
    return out.select("query_id", "passage_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(sql(VECTORS, select=f"SELECT a, b, round(score, 6) AS score FROM (SELECT a.vec_id AS a, b.vec_id AS b, {COSINE} AS score FROM vectors a JOIN vectors b ON a.vec_id < b.vec_id) WHERE score >= 4e-1"))
def q10_synonym_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return lists.similar_pairs(lists.build(e), spark, 0.4).select("a", "b", F.round("score", 6).alias("score"))


NEAR = f"""near AS (
  SELECT query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM (
    SELECT a.vec_id AS query_id, b.vec_id AS id, {COSINE} AS score FROM vectors a, vectors b WHERE a.vec_id % 20 = 0)) WHERE rank <= {2 * LIMIT}
), said AS (SELECT doc_id, {tokens_sql("text")} AS t FROM documents WHERE text IS NOT NULL),
triples AS (SELECT DISTINCT doc_id, t[i] AS subject, t[i + 1] AS object FROM (SELECT doc_id, t, unnest(range(1, len(t))) AS i FROM said)),
judged AS (
  SELECT query_id, id, 5e-1 + (list_contains(q, subject)::INT + list_contains(q, object)::INT) / 4e0 AS confidence FROM (
    SELECT n.query_id, n.id, x.subject, x.object, s.q, row_number() OVER (PARTITION BY n.query_id ORDER BY n.rank, n.id, x.subject, x.object) AS nth
    FROM near n JOIN triples x ON x.doc_id = n.id JOIN (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS q FROM documents) s ON s.doc_id = n.query_id) WHERE nth <= 10
), known AS (SELECT query_id, id, max(confidence) AS confidence FROM judged WHERE confidence >= 7e-1 GROUP BY 1, 2)"""


def recognition_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nearest, triples, queries): a vector is its document's; a document's triples are its adjacent content tokens."""
    e = table(spark, sf_dir, "embeddings")
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text").filter("text IS NOT NULL"))
    asked = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    near = vector.top_cosine(asked, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 2 * LIMIT).withColumnRenamed("id", "passage_id")
    each = docs.select(F.col("doc_id").alias("passage_id"), tokens(F.col("text")).alias("t"))
    pairs = each.select("passage_id", F.explode(F.arrays_zip(F.expr("slice(t, 1, greatest(size(t) - 1, 0))").alias("subject"), F.expr("slice(t, 2, greatest(size(t) - 1, 0))").alias("object"))).alias("x"))
    triples = pairs.select("passage_id", "x.subject", F.lit("next").alias("predicate"), "x.object").distinct()
    return near, triples, asked.select("query_id").join(docs.withColumnRenamed("doc_id", "query_id"), "query_id")


@query(sql(VECTORS, NEAR, select="SELECT query_id, id AS passage_id, confidence FROM known"))
def q89_recognition_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.recognised(*recognition_inputs(spark, sf_dir), models.WordJudge)


@query(sql(VECTORS, NEAR, """lists AS (
  SELECT query_id, id, rank, 'vector' AS via FROM near WHERE rank <= 20 UNION ALL SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, id), 'recognition-memory' FROM known
)""", select="SELECT query_id, id AS passage_id, round(sum(1e0 / (60e0 + rank)), 9) AS score, string_agg(via, ',' ORDER BY via) AS via FROM lists GROUP BY query_id, id"))  # fmt: skip
def q90_recognition_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    near, triples, asked = recognition_inputs(spark, sf_dir)
    near = written(near, "nearest")
    known = models.recognised(near, triples, asked, models.WordJudge)
    out = fuse({"vector": near.filter(F.col("rank") <= LIMIT), "recognition-memory": keyword.ranked(known, ["query_id"], "confidence", "passage_id")})
    return out.select("query_id", "passage_id", F.round("score", 9).alias("score"), F.array_join("via", ",").alias("via"))
