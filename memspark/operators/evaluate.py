"""Evaluation: ranks of gold groups, metrics, violations, comparison and tuning."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KS = (1, 3, 5, 10)


def group_ranks(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """query_id, group_id, rank of the group's first member among the hits (null if none). gold: query_id, group_id, passage_id."""
    return gold.join(hits.select("query_id", "passage_id", "rank"), ["query_id", "passage_id"], "left").groupBy("query_id", "group_id").agg(F.min("rank").alias("rank"))


def metrics(hits: DataFrame, gold: DataFrame, ks: Iterable[int] = KS) -> DataFrame:
    """query_id, recall_k and precision_k for each k, mrr."""
    ranks = group_ranks(hits, gold)
    found = lambda k: F.count_if(F.col("rank") <= k)
    n = F.count(F.lit(1))
    return ranks.groupBy("query_id").agg(*[(found(k) / n).alias(f"recall_{k}") for k in ks], *[(found(k) / F.lit(k)).alias(f"precision_{k}") for k in ks], F.coalesce(1.0 / F.min("rank"), F.lit(0.0)).alias("mrr"))


def aggregate(results: DataFrame, keys: list[str], ks: Iterable[int] = KS) -> DataFrame:
    """Means of the metrics by each of the keys, in one pass: grouping (the key's name), value, n and the means. Trust queries don't count."""
    means = ", ".join(f"avg({c}) AS {c}" for c in [*(f"recall_{k}" for k in ks), *(f"precision_{k}" for k in ks), "mrr"])
    name = "CASE " + " ".join(f"WHEN grouping({k}) = 0 THEN '{k}'" for k in keys) + " END"
    value = "coalesce(" + ", ".join(f"CAST({k} AS STRING)" for k in keys) + ")"
    sets = ", ".join(f"({k})" for k in keys)
    return results.sparkSession.sql(f"SELECT {name} AS grouping, {value} AS value, count(*) AS n, {means} FROM {{r}} WHERE kind <> 'trust' GROUP BY GROUPING SETS ({sets})", r=results)


def macro(results: DataFrame, metric: str = "recall_5") -> DataFrame:
    """The mean over kinds of the kinds' means."""
    return results.groupBy("kind").agg(F.avg(metric).alias("m")).agg(F.avg("m").alias(f"macro_{metric}"))


def trust_violations(hits: DataFrame, nodes: DataFrame, floor: int) -> DataFrame:
    """Hits whose node, looked up anew, is below the floor. nodes: id, trust_rank (null: low)."""
    return hits.join(nodes.select(F.col("id").alias("passage_id"), F.coalesce("trust_rank", F.lit(0)).alias("_r")), "passage_id").filter(F.col("_r") < floor).drop("_r")


def order_violations(hits: DataFrame, before: DataFrame) -> DataFrame:
    """Pairs (query_id, first, second) whose second stands before the first, or has it missing."""
    at = lambda c, r: hits.select("query_id", F.col("passage_id").alias(c), F.col("rank").alias(r))
    met = before.join(at("first", "r1"), ["query_id", "first"], "left").join(at("second", "r2"), ["query_id", "second"], "left")
    return met.filter(F.col("r2").isNotNull() & (F.col("r1").isNull() | (F.col("r2") < F.col("r1"))))


def absence_violations(hits: DataFrame, absent: DataFrame) -> DataFrame:
    return hits.join(absent, ["query_id", "passage_id"], "left_semi")


def vacuous(hits: DataFrame, absent: DataFrame, paired: DataFrame) -> DataFrame:
    """Absences (query_id, passage_id) that mean nothing: the paired query (query_id, paired_with) doesn't find the passage either."""
    other = absent.join(paired, "query_id")
    return other.join(hits.select(F.col("query_id").alias("paired_with"), "passage_id"), ["paired_with", "passage_id"], "left_anti").select("query_id", "passage_id")


def missing_gold(gold: DataFrame, nodes: DataFrame) -> DataFrame:
    return gold.join(nodes.select(F.col("id").alias("passage_id")), "passage_id", "left_anti")


def difference(base: DataFrame, run: DataFrame, columns: list[str]) -> DataFrame:
    """query_id, change: added, removed, changed or same, with null-safe comparison."""
    a, b = base.alias("a"), run.alias("b")
    met = a.join(b, F.col("a.query_id") == F.col("b.query_id"), "full_outer")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    change = F.when(F.col("a.query_id").isNull(), "added").when(F.col("b.query_id").isNull(), "removed").when(same, "same").otherwise("changed")
    return met.select(F.coalesce("a.query_id", "b.query_id").alias("query_id"), change.alias("change"))


def latencies(runs: DataFrame) -> DataFrame:
    """mode, p50, p95, most: exact nearest-rank percentiles of ms."""
    return runs.groupBy("mode").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY ms)").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY ms)").alias("p95"), F.max("ms").alias("most"))


def ablations(components: DataFrame, settings: DataFrame) -> DataFrame:
    """Every setting's (setting, w_graph, w_activation, w_importance) score of every hit and the rank in it; settings are a few rows."""
    met = components.join(F.broadcast(settings))
    score = F.col("w_graph") * F.col("graph") + F.col("w_activation") * F.col("activation") + F.col("w_importance") * F.col("importance")
    return met.withColumn("score", score).withColumn("rank", F.row_number().over(Window.partitionBy("setting", "query_id").orderBy(F.round("score", 9).desc(), "passage_id")))


def tune(start: dict[str, float], grid: dict[str, list[float]], measure: Callable[[dict[str, float]], float]) -> tuple[dict[str, float], float]:
    """Coordinate by coordinate: a value is taken only if the measure gets better. Each measure is a batch recall."""
    best, value = dict(start), measure(start)
    for name, options in grid.items():
        for x in options:
            tried = {**best, name: x}
            if tried != best and (got := measure(tried)) > value:
                best, value = tried, got
    return best, value


def relation_queries(edges: DataFrame, per_source: int = 3) -> DataFrame:
    """Generated questions: one of each edge by its type's words, and one of each two-hop chain."""
    from .graph import two_hop_chains

    one = edges.select(F.concat_ws(" ", F.lit("what is the"), F.regexp_replace("type", "_", " "), F.lit("of"), "src").alias("text"), F.col("dst").alias("answer"), F.lit("single-hop").alias("kind"))
    two = two_hop_chains(edges, per_source).select(F.concat_ws(" ", F.lit("what does"), "a", F.lit("reach through"), "b").alias("text"), F.col("c").alias("answer"), F.lit("multi-hop").alias("kind"))
    return one.unionByName(two).distinct()


# The settings that a question may change, the kinds that ask for remote associations, the kinds that tuning averages over.
OVERRIDES = ("retrieval.trustFloor", "scope")
REMOTE = ("remote-association-2hop", "remote-association-3hop")
OBJECTIVE = ("single-hop", "multi-hop", "temporal", "preference", *REMOTE)
SLACK = 1e-9


def checked_overrides(overrides: dict[str, object]) -> dict[str, object]:
    """A question's own settings, if they are ones that it may change."""
    if bad := sorted(set(overrides) - set(OVERRIDES)):
        raise ValueError(f"a question may not set {', '.join(bad)}")
    return overrides


def totals(violations: dict[str, DataFrame], queries: DataFrame) -> DataFrame:
    """One row: n_queries, a count for each kind of violation, and `failed`, which trust alone decides."""
    counts = queries.agg(F.count(F.lit(1)).alias("n_queries"))
    for name, rows in violations.items():
        counts = counts.join(F.broadcast(rows.agg(F.count(F.lit(1)).alias(name))))  # one row each
    return counts.withColumn("failed", (F.col("trust") > 0) if "trust" in violations else F.lit(False))


def ablation_settings(modes: dict[str, tuple[str, ...]]) -> list[dict]:
    """The settings of an ablation run: each mode alone, activation and importance off, and each origin of each mode off."""
    out = [{"name": f"mode:{m}", "mode": m} for m in modes]
    out += [{"name": f"weights:{w}=0", f"{w}_weight": 0.0} for w in ("activation", "importance")]
    return out + [{"name": f"origin:{m}:{o}=0", "mode": m, "origin_weights": {o: 0.0}} for m, origins in modes.items() for o in origins]


def by_kind(results: DataFrame, settings: list[str], metric: str = "recall_5") -> DataFrame:
    """settings..., split, kind, value: the mean of each kind but trust, which is a gate and no average."""
    return results.filter("kind <> 'trust'").groupBy(*settings, "split", "kind").agg(F.avg(metric).alias("value"))


def regressions(cells: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """keys..., split, kind, base, value of the kinds that got worse, or that a setting no longer answers.

    cells: keys..., split, kind, value; base: split, kind, value and those of the keys by which baselines differ.
    """
    shared = [k for k in keys if k in base.columns]
    settings = cells.select(*keys).distinct()
    wanted = base.withColumnRenamed("value", "base")
    wanted = settings.join(wanted, shared) if shared else settings.join(F.broadcast(wanted))  # a row for each kind and split
    met = wanted.join(cells, [*keys, "split", "kind"], "left")
    return met.filter(F.col("value").isNull() | (F.col("value") < F.col("base") - SLACK)).select(*keys, "split", "kind", "base", "value")


def dream_gate(results: DataFrame, violations: DataFrame) -> DataFrame:
    """mode, weight, remote_rises, no_regression, trust_zero, passes for each weight but 0 of a sweep over the weight of dream edges.

    results: config (true+decoys, decoys-only), mode, weight, split (dev, holdout), kind, recall_5. violations: config, mode, weight, n.
    A weight passes if remote questions gain on both splits, nothing gets worse when only decoys are there, and no hit is below its trust floor.
    """
    remote = results.filter(F.col("kind").isin(*REMOTE) & (F.col("config") == "true+decoys")).groupBy("mode", "weight", "split").agg(F.avg("recall_5").alias("r"))
    at_zero = remote.filter("weight = 0").select("mode", "split", F.col("r").alias("r0"))
    gains = remote.join(at_zero, ["mode", "split"], "left").filter("weight <> 0 AND r > coalesce(r0, 0) + 1e-9").groupBy("mode", "weight").agg((F.countDistinct("split") == 2).alias("remote_rises"))
    decoys = by_kind(results.filter("config = 'decoys-only'"), ["mode", "weight"])
    worse = regressions(decoys.filter("weight <> 0"), decoys.filter("weight = 0").drop("weight"), ["mode", "weight"]).select("mode", "weight").distinct().withColumn("_worse", F.lit(True))
    tested = decoys.select("mode", "weight").distinct().withColumn("_tested", F.lit(True))
    broken = violations.filter("n > 0").select("mode", "weight").distinct().withColumn("_broken", F.lit(True))
    keys = ["mode", "weight"]
    out = results.filter("config = 'true+decoys' AND weight <> 0").select(*keys).distinct().join(gains, keys, "left").join(worse, keys, "left").join(tested, keys, "left").join(broken, keys, "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    out = out.select(*keys, yes(F.col("remote_rises")).alias("remote_rises"), (yes(F.col("_tested")) & ~yes(F.col("_worse"))).alias("no_regression"), (~yes(F.col("_broken"))).alias("trust_zero"))
    return out.withColumn("passes", F.col("remote_rises") & F.col("no_regression") & F.col("trust_zero"))


def tune_safely(start: dict, grid: dict[str, list], measure: Callable[[dict, str], dict]) -> dict:
    """Coordinate by coordinate on dev, then one look at the holdout.

    measure(settings, split) gives score, kinds (name to recall) and violations (name to count). A value is taken only
    if the score rises, no violation count does, and no kind, scoped ones included, falls below the baseline.
    """
    base = measure(start, "dev")
    best, now, tried = dict(start), base, [(dict(start), base)]
    for name, options in grid.items():
        for value in options:
            settings = {**best, name: value}
            if settings == best:
                continue
            got = measure(settings, "dev")
            tried.append((settings, got))
            sound = all(got["violations"].get(k, 0) <= n for k, n in base["violations"].items()) and all(got["kinds"].get(k, 0.0) >= v - SLACK for k, v in base["kinds"].items())
            if sound and got["score"] > now["score"]:
                best, now = settings, got
    return {"baseline": base, "best": best, "score": now, "tried": tried, "holdout": {"baseline": measure(start, "holdout"), "best": measure(best, "holdout")}}


def workspace_cases(hits: DataFrame, expected: DataFrame, absent: DataFrame) -> DataFrame:
    """case_id, passage_id, problem (missing, mislabeled, absent) of federated hits (case_id, passage_id, vault, layer).

    expected: case_id, passage_id, vault, layer. absent: case_id, passage_id that must not be found.
    """
    own = hits.select("case_id", "passage_id", F.struct("vault", "layer").alias("_got"))
    met = expected.join(own, ["case_id", "passage_id"], "left").groupBy("case_id", "passage_id", "vault", "layer").agg(F.count("_got").alias("_n"), F.max(F.col("_got") == F.struct("vault", "layer")).alias("_right"))
    wrong = met.filter(~F.coalesce("_right", F.lit(False))).select("case_id", "passage_id", F.when(F.col("_n") == 0, "missing").otherwise("mislabeled").alias("problem"))
    there = hits.join(absent.select("case_id", "passage_id").distinct(), ["case_id", "passage_id"], "left_semi").select("case_id", "passage_id", F.lit("absent").alias("problem")).distinct()
    return wrong.unionByName(there)


def layer_sweep(hits: DataFrame, expected: DataFrame, absent: DataFrame, cases: DataFrame, settings: list[str]) -> DataFrame:
    """settings..., passed, total: how many cases (case_id) come out clean under each set of layer weights. hits has the settings' columns, of a few sets."""
    key = [*settings, "case_id"]
    runs = F.broadcast(hits.select(*settings).distinct())
    tagged = lambda t: t.join(runs).withColumn("_case", F.struct(*key))
    own = hits.withColumn("_case", F.struct(*key))
    as_case = lambda t: t.drop("case_id").withColumnRenamed("_case", "case_id")
    bad = workspace_cases(as_case(own), as_case(tagged(expected)), as_case(tagged(absent))).select("case_id").distinct()
    every = as_case(tagged(cases)).select("case_id").join(bad.withColumn("_bad", F.lit(True)), "case_id", "left")
    return every.groupBy(*[F.col(f"case_id.{s}").alias(s) for s in settings]).agg(F.count_if(F.col("_bad").isNull()).alias("passed"), F.count(F.lit(1)).alias("total"))
