"""Every registered query of the engine against its SQL; those without run and give rows."""

import pytest
from pyspark.sql import functions as F

from memspark.plans import ORACLE_SQL, QUERIES
from tests.compare import assert_same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(name, spark, duck, sf_dir):
    assert_same(QUERIES[name](spark, sf_dir), duck, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_gives_rows(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert {"query_id", "rank", "passage_id", "score"} <= set(df.columns)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_recall_keeps_its_rules(spark, sf_dir):
    rows = QUERIES["q32_recall_end_to_end"](spark, sf_dir).collect()
    by = {}
    for r in rows:
        by.setdefault(r["query_id"], []).append(r)
    for hits in by.values():
        hits.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in hits] == list(range(1, len(hits) + 1)) and len(hits) <= 8
        assert all(a["score"] >= b["score"] for a, b in zip(hits, hits[1:], strict=False))


def test_recall_reads_documents_once_for_its_links(spark, sf_dir):
    """Notes that share a token of two to four notes are linked through its least note; the edges come from stored tokens and passages."""
    import math
    from collections import Counter, defaultdict

    from memspark.functions.text import tokens
    from memspark.plans.upkeep import memory

    edges = memory(spark, sf_dir)[0].edges
    assert "documents.parquet" not in edges._jdf.queryExecution().executedPlan().toString()
    notes = defaultdict(set)
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", tokens(F.coalesce("text", F.lit(""))).alias("t")).collect():
        for t in r["t"]:
            notes[t].add(f"d{r['doc_id']}")
    want = Counter((n, min(held)) for held in notes.values() if 2 <= len(held) <= 4 for n in held if n != min(held))
    got = {(r["src"], r["dst"]): r["weight"] for r in edges.filter("origin = 'link'").collect()}
    assert got.keys() == want.keys() and got and all(abs(got[k] - 1 - math.log(n)) < 1e-12 for k, n in want.items())
