"""The property graph: edge filters, scopes, PageRank, hop distances and shortest paths.

Edges: src, dst, origin, weight, trust, valid_from, valid_to, recorded_at, expired_at (epoch milliseconds),
and what else the caller has. Nodes and edges are tables; a mode is a set of origins, so an edge table that is
partitioned by origin is pruned to what the mode reads.
"""

from __future__ import annotations

import math
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MODE_ORIGINS, TRUST_RANKS, Config
from ..functions.scoring import mapped, trust_rank
from ..storage import delete, written
from . import push


def mode_edges(edges: DataFrame, mode: str, weights: dict[str, float]) -> DataFrame:
    """Edges that the mode follows, with the effective weight `w`; origins of weight 0 aren't read at all."""
    used = [o for o in MODE_ORIGINS[mode] if weights.get(o, 1.0) > 0]
    return edges.filter(F.col("origin").isin(used)).withColumn("w", mapped(F.col("origin"), {o: float(weights.get(o, 1.0)) for o in used}) * F.col("weight"))


def trusted(floor: str, trust: Column | None = None) -> Column:
    """Whether an edge passes the trust floor; an edge without trust does."""
    c = F.col("trust") if trust is None else trust
    return c.isNull() | (trust_rank(c, None) >= TRUST_RANKS[floor])


def hit_trusted(floor: str) -> Column:
    """Whether a passage passes; one without trust counts as low."""
    return trust_rank(F.col("trust")) >= TRUST_RANKS[floor]


def believed_now(include_superseded: bool = False) -> Column:
    return F.lit(True) if include_superseded else F.col("expired_at").isNull()


def believed_at(t: Column, include_superseded: bool = False) -> Column:
    """Whether an edge was in memory, and said of the world, at t."""
    known = (F.col("declared_created").isNull() | (F.col("declared_created") <= t)) & (F.col("recorded_at").isNull() | (F.col("recorded_at") <= t))
    held = F.lit(True) if include_superseded else (F.col("expired_at").isNull() | (F.col("expired_at") > t))
    return known & held & true_at(t)


def true_at(t: Column) -> Column:
    """World time: valid_from <= t < valid_to, open where null."""
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= t)) & (F.col("valid_to").isNull() | (F.col("valid_to") > t))


def allowed(edges: DataFrame, cfg: Config, as_of: Column | int | None = None) -> DataFrame:
    """Edges past the trust floor and the time filters of a recall."""
    r = cfg.retrieval
    out = edges.filter(trusted(r.trust_floor))
    if as_of is None:
        return out.filter(believed_now(r.include_superseded))
    return out.filter(believed_at(as_of if isinstance(as_of, Column) else F.lit(as_of), r.include_superseded))


def scope_ids(nodes: DataFrame, scope: str, mentions: DataFrame | None = None, among: DataFrame | None = None) -> DataFrame:
    """Column id: nodes of a tag (`tag:x`), or at or under a path. mentions (src, dst) add the phrases of passages in scope.

    among: the only ids that are asked for (column id), few; notes and nodes are cut to theirs before they meet.
    """
    every = nodes
    if among is not None:
        nodes = written(nodes.join(among.select("id"), "id", "left_semi"), "asked-nodes")
    if scope.startswith("tag:") and among is not None:
        own = F.coalesce("note_id", "id").alias("note")
        notes = every.filter((F.col("kind") == "note") & F.array_contains("tags", scope[4:])).select(F.col("id").alias("note")).join(nodes.select(own), "note", "left_semi")
        ids = nodes.select("id", own).join(notes, "note", "left_semi").select("id")
    elif scope.startswith("tag:"):
        notes = nodes.filter((F.col("kind") == "note") & F.array_contains("tags", scope[4:])).select(F.col("id").alias("note"))
        ids = nodes.join(notes, F.coalesce(nodes["note_id"], nodes["id"]) == notes["note"], "left_semi").select("id")
    else:
        prefix = scope.rstrip("/")
        ids = nodes.filter((F.col("path") == prefix) | F.col("path").startswith(prefix + "/")).select("id") if prefix else nodes.select("id").limit(0)
    if mentions is not None:
        ids = ids.unionByName(mentions.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")))
    return ids.distinct()


def scoped(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in scope."""
    for end in ("src", "dst"):
        edges = edges.join(ids.select(F.col("id").alias(end)), end, "left_semi")
    return edges


def adjacency(edges: DataFrame, weight: str = "w") -> DataFrame:
    """a, b, w: both directions, parallel edges added, no loops and nothing of weight 0 or less."""
    real = edges.filter(F.col("dst").isNotNull() & (F.col("src") != F.col("dst")) & (F.col(weight) > 0))
    one = real.groupBy(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).agg(F.sum(weight).alias("w"))
    way = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    return one.select(F.explode(F.array(way("x", "y"), way("y", "x"))).alias("e"), "w").select("e.*", "w")


def degrees(adjacent: DataFrame) -> DataFrame:
    return adjacent.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("degree"))


def transitions(adjacent: DataFrame) -> DataFrame:
    """a, b, p: the share of a's mass that goes to b."""
    return adjacent.join(degrees(adjacent).withColumnRenamed("node", "a"), "a").select("a", "b", (F.col("w") / F.col("degree")).alias("p"))


def iterations(damping: float, tolerance: float, most: int) -> int:
    """How many rounds bring the change below the tolerance: a round shrinks it by the damping at least."""
    return min(most, max(1, math.ceil(math.log(tolerance / 2) / math.log(damping))))


def pagerank(seeds: DataFrame, graph: DataFrame | push.Graph, damping: float = 0.5, tolerance: float = 1e-8, top: int | None = None, isolated: bool = False) -> DataFrame:
    """query_id, node, mass > 0: p = (1 - d) s + d W'p for every query of seeds (query_id, node, value), s their shares in the graph.

    graph: adjacency (a, b, w), which is stored first, or a stored one. The masses lack at most the tolerance for a query.
    top: only each query's heaviest nodes (by nine digits, then by name). isolated: with the seeds that the graph doesn't hold, which
    keep (1 - d) of their raw value; they are found among the graph's nodes, so the masses are neither read nor moved for it.
    """
    if not isinstance(graph, push.Graph):
        made = push.prepared(graph)
        mass = pagerank(seeds, made, damping, tolerance, top, isolated)
        delete(seeds.sparkSession, made.path)  # the masses are stored
        return mass
    mass = push.ranked(seeds, graph, damping, tolerance, top)
    if not isolated:
        return mass
    alone = push.outside(seeds, graph).select("query_id", "node", (F.col("value") * (1 - damping)).alias("mass"))
    return mass.unionByName(written(alone, "isolated"))


def heaviest(mass: DataFrame, limit: int) -> DataFrame:
    """Each query's heaviest nodes."""
    order = Window.partitionBy("query_id").orderBy(F.round("mass", 9).desc(), "node")
    return mass.withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= limit).drop("_nth")


def with_isolated(mass: DataFrame, seeds: DataFrame, damping: float) -> DataFrame:
    """Seeds that the graph doesn't hold keep (1 - d) of their raw value."""
    held = mass.join(seeds.select("query_id", "node"), ["query_id", "node"], "left_semi")  # few, so masses aren't moved for it
    alone = seeds.join(held, ["query_id", "node"], "left_anti").select("query_id", "node", (F.col("value") * (1 - damping)).alias("mass"))
    return mass.unionByName(alone)


def hops(sources: DataFrame, adjacent: DataFrame, most: int) -> DataFrame:
    """source, node, hops up to `most`: a frontier that grows by one join a level, without what it has seen."""
    links = written(adjacent.select("a", "b").distinct(), "links")
    seen = written(sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("hops")).distinct(), "seen")
    frontier = seen
    for level in range(1, most + 1):
        near = frontier.join(links, frontier["node"] == links["a"]).select("source", F.col("b").alias("node")).distinct()
        frontier = written(near.join(seen, ["source", "node"], "left_anti").withColumn("hops", F.lit(level)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def meetings(pairs: DataFrame, links: DataFrame, most_depth: int) -> tuple[DataFrame, DataFrame]:
    """(seen, met): what each pair's two searches have seen (pair_id, side, node, hops), and the nodes where they meet (pair_id, node, near, far).

    links: a, b, degree (of b). A round adds one level to every open pair, on the side whose last level has fewer links, so the
    two depths add up to the round and the first meeting is the distance. A pair that has met, or can't grow, is closed: no
    ball reaches over the meeting, and a hub is opened from one side only. A node with one link is on no path but at its end, so
    it is met only by the pair that asks for it, and a hub's leaves aren't walked. seen keeps from which nodes (parents) of the level
    before each node was reached.
    """
    inner = links.filter("degree > 1")
    inner = written(inner.drop("degree").join(inner.groupBy(F.col("a").alias("b")).agg(F.count(F.lit(1)).alias("degree")), "b", "left").select("a", "b", F.coalesce("degree", F.lit(0)).alias("degree")), "inner")
    leaves = links.filter("degree = 1").select(F.col("a").alias("node"), F.col("b").alias("goal"))
    ends = pairs.filter("src IS NOT NULL AND dst IS NOT NULL").select("pair_id", "src", "dst").distinct()
    met = ends.filter("src = dst").select("pair_id", F.col("src").alias("node"), F.lit(0).alias("near"), F.lit(0).alias("far"))
    ends = written(ends.filter("src <> dst"), "ends")
    seen = ends.select("pair_id", F.explode(F.array(*[F.struct(F.lit(e).alias("side"), F.col(e).alias("node")) for e in ("src", "dst")])).alias("e")).select("pair_id", "e.*", F.lit(0).alias("hops"), F.array().cast("array<string>").alias("parents"))
    open_ = ends.select("pair_id", "src", "dst", *[F.lit(0).alias(f"{e}_{what}") for e in ("src", "dst") for what in ("depth", "cost")])
    for _ in range(most_depth):
        turn = open_.withColumn("side", F.when(F.col("src_cost") <= F.col("dst_cost"), "src").otherwise("dst"))
        turn = turn.withColumn("hops", F.when(F.col("side") == "src", F.col("src_depth")).otherwise(F.col("dst_depth")))
        goal = F.when(F.col("side") == "src", F.col("dst")).otherwise(F.col("src")).alias("goal")
        last = seen.drop("parents").join(turn.select("pair_id", "side", "hops", goal), ["pair_id", "side", "hops"])
        near = last.join(inner, last["node"] == inner["a"]).select("pair_id", "side", F.col("b").alias("node"), "degree", "hops", last["node"].alias("parent"))
        near = near.unionByName(last.join(leaves, ["node", "goal"]).select("pair_id", "side", F.col("goal").alias("node"), F.lit(0).alias("degree"), "hops", F.col("node").alias("parent")))
        near = near.groupBy("pair_id", "side", "node").agg(F.first("degree").alias("degree"), (F.first("hops") + 1).alias("hops"), F.collect_list("parent").alias("parents"))
        # Of an open pair no node is seen from both sides, so one join finds what is known and where the sides meet.
        known = near.join(seen.select("pair_id", "node", F.col("side").alias("_side"), F.col("hops").alias("other")), ["pair_id", "node"], "left")
        fresh = written(known.filter("_side IS NULL OR side <> _side").drop("_side"), "fresh")
        of = lambda e: F.when(F.col("side") == e, F.col("hops")).otherwise(F.col("other"))
        now = fresh.filter("other IS NOT NULL").select("pair_id", "node", of("src").alias("near"), of("dst").alias("far"))
        grown = fresh.groupBy("pair_id").agg(F.sum("degree").alias("cost"))
        still = turn.join(now, "pair_id", "left_anti").join(grown, "pair_id")
        moved = [
            c
            for e in ("src", "dst")
            for c in ((F.col(f"{e}_depth") + (F.col("side") == e).cast("int")).alias(f"{e}_depth"), F.when(F.col("side") == e, F.col("cost")).otherwise(F.col(f"{e}_cost")).alias(f"{e}_cost"))
        ]
        open_ = written(still.select("pair_id", "src", "dst", *moved), "open")
        seen, met = seen.unionByName(fresh.drop("degree", "other")), met.unionByName(now)
        if open_.isEmpty():
            break
    return seen, met


def shortest_paths(pairs: DataFrame, edges: DataFrame, most_depth: int = 5, most_paths: int = 3) -> DataFrame:
    """pair_id, nth, nodes, depth: up to most_paths shortest paths of each pair (pair_id, src, dst), undirected.

    Two searches meet in the middle; from the nodes where they meet only the links by which the searches came are followed back,
    so no path is built that doesn't arrive. Paths go by their node lists in order.
    """
    one = edges.filter("dst IS NOT NULL AND src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    links = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    links = written(links.join(links.groupBy(F.col("a").alias("b")).agg(F.count(F.lit(1)).alias("degree")), "b").select("a", "b", "degree"), "links")
    seen, met = meetings(pairs, links, most_depth)

    def walked(walks: DataFrame, side: str, start: list[str], longer: Column) -> DataFrame:
        """walks (pair_id, at, nodes, left) at the side's end; of those that came to one node from one of `start`, the first most_paths."""
        nearer = seen.filter(F.col("side") == side).select("pair_id", F.col("node").alias("at"), F.explode("parents").alias("b"))
        order = Window.partitionBy("pair_id", *start, "at").orderBy("nodes")
        done = walks.filter("left = 0")
        for _ in range(walks.agg(F.max("left")).head()[0] or 0):
            walks = walks.filter("left > 0").join(nearer, ["pair_id", "at"])
            walks = walks.withColumns({"nodes": longer, "left": F.col("left") - 1, "at": F.col("b")}).drop("b")
            walks = walks.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most_paths).drop("nth")
            done = done.unionByName(walks.filter("left = 0"))
        return done

    middle = met.select("pair_id", F.col("node").alias("at"), F.array("node").alias("nodes"), F.col("far").alias("left"), F.col("node").alias("middle"), "near", (F.col("near") + F.col("far")).alias("depth"))
    # Of one middle's halves only the first can be part of the pair's first paths.
    ahead = written(walked(middle, "dst", ["middle"], F.concat("nodes", F.array("b"))), "walks")
    whole = walked(ahead.select("pair_id", F.col("middle").alias("at"), "nodes", F.col("near").alias("left"), "depth"), "src", [], F.concat(F.array("b"), "nodes"))
    return whole.withColumn("nth", F.row_number().over(Window.partitionBy("pair_id").orderBy("nodes"))).filter(F.col("nth") <= most_paths).select("pair_id", "nth", "nodes", "depth")


def two_hop_chains(edges: DataFrame, per_source: int = 3) -> DataFrame:
    """a, b, c for edges a -> b -> c with a <> c, the first few of each a."""
    one = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    two = edges.select(F.col("src").alias("b"), F.col("dst").alias("c")).distinct()
    chains = one.join(two, "b").filter("a <> c").select("a", "b", "c")
    return chains.withColumn("nth", F.row_number().over(Window.partitionBy("a").orderBy("b", "c"))).filter(F.col("nth") <= per_source)
