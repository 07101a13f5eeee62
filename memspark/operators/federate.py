"""Federated recall: the cells of a lattice of vaults, and the merge of their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fusion import RRF_K
from .recall import within_budget

# Weights of the layers, in their order of precedence.
LAYER_WEIGHTS = {"agent": 1.0, "project": 0.9, "global-agent": 0.8, "global": 0.7}


def lineage(vaults: dict[str, dict[str, str]], project: str | None = None, agent: str | None = None) -> list[tuple[str, str]]:
    """(layer, vault) of the cells that a binding reads: its own cell, the project's, the agent's everywhere, and the global one. Siblings are never in it."""
    cells = {(v.get("project"), v.get("agent")): name for name, v in vaults.items()}
    wanted = [("agent", (project, agent)), ("project", (project, None)), ("global-agent", (None, agent)), ("global", (None, None))]
    out = []
    for layer, cell in wanted:
        needs = {"agent": project and agent, "project": project, "global-agent": agent, "global": True}[layer]
        if needs and cell in cells:
            out.append((layer, cells[cell]))
    return out


def write_target(registry: dict, agent: str | None = None) -> str:
    """Where a write goes: the agent's own rule instead of the default; `self` if nothing is said."""
    writes = registry.get("writes", {})
    return writes.get("agents", {}).get(agent) or writes.get("default") or "self"


def merged(hits: DataFrame, layers: list[tuple[str, str]], weights: dict[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    """Hits of several vaults (vault, query_id, passage_id, rank, score, text) in one order: `fused`, `place`.

    The same passage id in two vaults is two hits. Ties go by the layer's precedence, then by the vault's own score.
    """
    weights = LAYER_WEIGHTS | (weights or {})
    spark = hits.sparkSession
    table = spark.createDataFrame([(v, layer, i, float(weights[layer])) for i, (layer, v) in enumerate(layers)], "vault string, layer string, precedence int, weight double")
    met = hits.join(F.broadcast(table), "vault")  # four rows at most
    met = met.withColumn("fused", F.col("weight") / (F.lit(float(k)) + F.col("rank")))
    order = Window.partitionBy("query_id").orderBy(F.round("fused", 9).desc(), "precedence", F.round("score", 9).desc(), "passage_id")
    return met.withColumn("place", F.row_number().over(order))


def federated(hits: DataFrame, layers: list[tuple[str, str]], top_k: int, budget: int, weights: dict[str, float] | None = None) -> DataFrame:
    """merged, within one budget for all vaults."""
    return within_budget(merged(hits, layers, weights).drop("rank"), top_k, budget, order="place")


def first_by_layer(rows: DataFrame, layers: list[tuple[str, str]], key: str) -> DataFrame:
    """Of rows with a vault, those of the first layer that has the key."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(v, i) for i, (_, v) in enumerate(layers)], "vault string, precedence int")
    met = rows.join(F.broadcast(table), "vault")
    return met.withColumn("_first", F.min("precedence").over(Window.partitionBy(key))).filter("precedence = _first").drop("_first", "precedence")
