"""The engine's front: one object over a memory's tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config, checked
from .operators import activation as act
from .operators import consolidate, evaluate, federate, graph, index, keyword, postings, push, temporal, vector
from .operators.fusion import fuse, in_scope
from .operators.recall import Memory, access_events, recall
from .sources import models, state
from .sources import vault as source
from .storage import delete, written


@dataclass
class MemorySession:
    """Queries over one vault's index. Everything takes and gives DataFrames; a single query is a table of one row."""

    spark: SparkSession
    nodes: DataFrame
    edges: DataFrame
    names: DataFrame
    cfg: Config = field(default_factory=Config)
    access: DataFrame | None = None
    notes: DataFrame | None = None
    vectors: DataFrame | None = None
    versions: DataFrame | None = None
    triples: DataFrame | None = None
    verifier: Callable[[], models.Chat] | None = None
    store: str | None = None
    version: str = "0"
    graphs: push.GraphCache | None = None
    words: postings.Postings | None = None

    @classmethod
    def open(cls, spark: SparkSession, root: str, cfg: Config | None = None, access_log: str | None = None, store: str | None = None, **more) -> MemorySession:
        """The session of a vault; more: other fields of the session.

        store: a folder that keeps the index. While the settings are those that it was built with, files are told by path and
        time, only files that changed are read, and only the parts of the index that differ are written.
        """
        cfg = checked(cfg or Config())
        built = state.open_index(spark, store, cfg) if store else None
        if built is not None:
            now = source.scan(spark, root, cfg.vault.ignore).select("path", "mtime")
            met = now.join(built["files"].select("path", F.col("mtime").alias("_then")), "path", "full_outer")
            other = written(met.filter(~F.col("mtime").eqNullSafe(F.col("_then"))), "other")
            n, since = other.agg(F.count(F.lit(1)), F.min("mtime")).head()
            if n:
                stay = built["notes"].join(other.select("path"), "path", "left_anti").select(*built["notes"].columns)
                read = source.scan(spark, root, cfg.vault.ignore, since) if since is not None else None
                notes = stay if read is None else stay.unionByName(source.parsed(read.join(other.select("path"), "path", "left_semi"), cfg.vault))
                notes = written(notes, "notes")
                state.store_index({**index.incremental(built, built["notes"], notes, cfg), "notes": notes}, store, cfg)
                built = state.open_index(spark, store, cfg)
        else:
            # The index is tables: queries start from them and not from the files.
            notes = written(source.read_vault(spark, root, cfg.vault), "notes")
            built = {**index.build(notes, cfg), "notes": notes}
            if store:
                state.store_index(built, store, cfg)
                built = state.open_index(spark, store, cfg)
            else:
                built = {k: v if k == "notes" else written(v, k) for k, v in built.items()}
        version = state.index_version(spark, store) if store else "0"
        access = source.read_access(spark, access_log) if access_log else None
        return cls(spark, built["nodes"], built["edges"], built["names"], cfg, access, built["notes"], store=store, version=version, graphs=push.GraphCache(spark, version, store), **more)

    def postings(self) -> postings.Postings:
        """The passages' stored postings, made once for a version of the index."""
        if self.words is None:
            path = f"{self.store}/postings/v{self.version}" if self.store else None
            self.words = postings.opened(self.spark, path) if path else None
            if self.words is None:
                if path:
                    delete(self.spark, path)  # what a build that was lost left behind
                self.words = postings.build(self.passages(), path, {"title": 1.0, "heading": 1.0, "text": 1.0})
        return self.words

    def queries(self, *texts: str) -> DataFrame:
        return self.spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id bigint, text string")

    def passages(self) -> DataFrame:
        return self.nodes.filter("kind = 'passage'").withColumn("passage_id", F.col("id"))

    def seeds(self, queries: DataFrame, scope: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(seeds, cues): keyword, entity and, where both sides have vectors, vector and recognition lists fused."""
        limit = self.cfg.retrieval.seed_limit
        words = postings.search(self.postings(), queries, limit)
        entities = self.names.join(self.nodes.filter("note_type = 'entity' AND kind = 'note'").select(F.col("id").alias("node_id")), "node_id", "left_semi")
        cues = keyword.entity_cues(queries, entities)
        cued = keyword.ranked(cues.select("query_id", F.col("node_id").alias("passage_id"), F.lit(0.0).alias("score")), ["query_id"], "score", "passage_id")
        lists = {"keyword": words, "entity": cued}
        if self.vectors is not None and "vector" in queries.columns:
            near = written(vector.top_cosine(queries, self.vectors, 2 * limit).withColumnRenamed("id", "passage_id"), "nearest")
            lists["vector"] = near.filter(F.col("rank") <= limit)
            known = self.cfg.graph.recognition
            if known.enabled and self.triples is not None and self.verifier is not None:
                found = models.recognised(near, self.triples, queries, self.verifier, known.top_candidates, known.min_confidence)
                lists["recognition-memory"] = keyword.ranked(found, ["query_id"], "confidence", "passage_id")
        fused = fuse(lists, self.cfg.retrieval.rrf_k)
        if scope is not None:
            fused = in_scope(fused, scope)
        return fused.select("query_id", F.col("passage_id").alias("node"), F.col("score").alias("value")), cues

    def recall(self, queries: DataFrame, mode: str = "auto", now: int = 0, as_of: int | None = None, scope: str | None = None) -> DataFrame:
        ids = graph.scope_ids(self.nodes, scope, self.edges.filter("origin = 'triple' AND type = 'mentions'")) if scope else None
        seeds, cues = self.seeds(queries, ids)
        shown = None
        if self.access is not None:
            shown = state.presentations(self.spark, self.store, self.access, as_of) if self.store else act.presentations(act.compact(self.access.limit(0)), self.access, 0, as_of)
        created = self.nodes.filter("kind = 'note'").select(F.col("id").alias("declared_in"), F.col("created").alias("declared_created"))
        memory = Memory(self.passages(), self.edges.join(created, "declared_in", "left"), self.nodes, shown, self.versions, self.graphs)
        has_triples = not self.edges.filter("origin = 'triple'").isEmpty()
        return recall(queries, seeds, memory, self.cfg, mode, now, as_of, ids, cues, has_triples)

    def log(self, hits: DataFrame, queries: DataFrame, now: int, path: str, session: str | None = None) -> None:
        source.append_json(access_events(hits, queries, now, session), path)

    def relate(self, pairs: DataFrame, mode: str = "typed") -> DataFrame:
        """Shortest paths between named notes. pairs: pair_id, a, b. Unconfirmed associations never make a path."""
        found = index.resolved(index.resolved(pairs, self.names, "a", "src"), self.names, "b", "dst").select("pair_id", "src", "dst")
        used = graph.mode_edges(self.edges.filter("origin <> 'dream'"), mode, self.cfg.graph.origin_weights).filter(graph.trusted(self.cfg.retrieval.trust_floor))
        return graph.shortest_paths(found, used)

    def timeline(self, entities: DataFrame) -> DataFrame:
        named = index.resolved(entities, self.names, "name", "entity").select("entity")
        return temporal.timeline(self.edges.filter("origin = 'fact'"), named, dict(self.cfg.predicates))

    def stats(self) -> DataFrame:
        return index.stats(self.nodes, self.edges)

    def history(self, path: str) -> DataFrame:
        return self.versions.filter(F.col("path") == path).orderBy(F.col("committed_at").desc(), "hash")

    def note(self, key: str) -> DataFrame:
        return self.notes.filter((F.col("id") == key) | (F.col("path") == key))

    def lint(self) -> DataFrame:
        facts = self.notes.select("path", F.explode("facts").alias("f")).select("path", "f.*")
        return index.problems_of(self.notes, facts, self.cfg)

    def gate(self, candidates: DataFrame) -> DataFrame:
        """candidates (subject, predicate, object, by, trust, origin, explicit, claimed_at, support, rejected) with their decisions."""
        found = consolidate.resolve(candidates, self.names, "subject", "subject_ref")
        current = self.edges.filter("origin = 'fact' AND expired_at IS NULL").withColumn("object", F.coalesce("dst", "value"))
        return consolidate.gate(consolidate.against_current(found, current), self.cfg)

    def evaluate(self, hits: DataFrame, gold: DataFrame) -> DataFrame:
        return evaluate.metrics(hits, gold)


def remembered(texts: DataFrame, by: str, today: str, as_user: bool = False) -> DataFrame:
    """path, text of the episodes that keep what was said (texts: id, title, text), one for each segment.

    Only a caller that speaks for the user may say that the user said it.
    """
    if by == "user" and not as_user:
        raise ValueError("only the user can remember as the user")
    parts = index.segments(texts.select("id", "text")).join(texts.select("id", "title"), "id")
    several = F.when(F.col("nth") > 0, F.concat("title", F.lit(" "), F.col("nth").cast("string"))).otherwise(F.col("title"))
    named = source.episode_paths(parts.select(several.alias("title"), F.lit(today).cast("date").alias("started"), F.col("text").alias("body")))
    head = F.concat(F.lit("---\ntype: episode\nid: "), "id", F.lit(f"\nstarted: {today}\nby: {by}\nsource: remember\n---\n# "), "title", F.lit("\n\n"))
    return named.select("path", F.concat(head, "body", F.lit("\n")).alias("text"))


def review_queue(pending: DataFrame, episodes: DataFrame) -> DataFrame:
    """pending with its episode's agent and text, priority first and then as it was queued. episodes: episode, agent, text."""
    met = pending.join(episodes.dropDuplicates(["episode"]), "episode", "left")
    return met.orderBy(F.coalesce("priority", F.lit(False)).desc(), F.col("queued_at").asc_nulls_first(), "key")


def open_layers(sessions: dict[str, MemorySession], vaults: dict[str, dict[str, str]], project: str | None, agent: str | None) -> list[tuple[str, str]]:
    """(layer, vault) of a binding's lineage that are open, in their order."""
    return [(layer, v) for layer, v in federate.lineage(vaults, project, agent) if v in sessions]


def workspace_timeline(sessions: dict[str, MemorySession], vaults: dict[str, dict[str, str]], names: list[str], project: str | None = None, agent: str | None = None) -> DataFrame | None:
    """The timelines of a binding's vaults one after the other, with vault and layer; None without an open vault."""
    out = None
    for layer, v in open_layers(sessions, vaults, project, agent):
        s = sessions[v]
        part = s.timeline(s.spark.createDataFrame([(n,) for n in names], "name string")).withColumns({"vault": F.lit(v), "layer": F.lit(layer)})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def workspace_relate(sessions: dict[str, MemorySession], vaults: dict[str, dict[str, str]], pairs: DataFrame, project: str | None = None, agent: str | None = None, mode: str = "typed", layer: str | None = None) -> DataFrame | None:
    """Each pair's paths in the first vault of the lineage that has one, or in that of the layer asked for."""
    layers = [(x, v) for x, v in open_layers(sessions, vaults, project, agent) if layer in (None, x)]
    out = None
    for _, v in layers:
        part = sessions[v].relate(pairs, mode).withColumn("vault", F.lit(v))
        out = part if out is None else out.unionByName(part)
    return federate.first_by_layer(out, layers, "pair_id") if out is not None else None


def every_vault(sessions: dict[str, MemorySession], run: Callable[[MemorySession], object]) -> dict[str, tuple[str, object]]:
    """run on each vault in the order of their ids; one that fails is told and doesn't stop the others: id to (ok, result) or (failed, message)."""
    out: dict[str, tuple[str, object]] = {}
    for name in sorted(sessions):
        try:
            out[name] = ("ok", run(sessions[name]))
        except Exception as e:  # any failure is the vault's own
            out[name] = ("failed", f"{type(e).__name__}: {e}")
    return out


def workspace_recall(sessions: dict[str, MemorySession], vaults: dict[str, dict[str, str]], queries: DataFrame, project: str | None = None, agent: str | None = None, weights: dict[str, float] | None = None, **how) -> DataFrame:
    """Recall over the vaults of a binding's lineage, in one order and one budget. A vault that isn't open is left out."""
    layers = open_layers(sessions, vaults, project, agent)
    hits = None
    for _, v in layers:
        part = sessions[v].recall(queries, **how).withColumn("vault", F.lit(v))
        hits = part if hits is None else hits.unionByName(part)
    r = next(iter(sessions.values())).cfg.retrieval
    return federate.federated(hits, layers, r.top_k, r.token_budget, weights)
