"""Remote associations: note-level graph, sampling, grounding, salience and the candidates' states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.scoring import salience, trust_rank
from ..functions.text import short_hash, squeezed
from . import graph as g

#: Words of a quote that find the passages to test.
KEY_WORDS = 3
LEAST_QUOTE, MOST_GIST = 12, 200
# The linear congruential generator and the 32-bit hash that seeds it.
LCG_MULTIPLIER, LCG_STEP = 1664525, 1013904223
HASH_START, HASH_PRIME = 2166136261, 16777619


def seed_of(night: str) -> int:
    """FNV-1a over the UTF-16 units of a night's date."""
    h = HASH_START
    units = night.encode("utf-16-le")
    for i in range(0, len(units), 2):
        h = ((h ^ int.from_bytes(units[i : i + 2], "little")) * HASH_PRIME) & 0xFFFFFFFF
    return h


class Draws:
    """Numbers in [0, 1] from the seeded generator."""

    def __init__(self, seed: int):
        self.state = seed & 0xFFFFFFFF

    def __call__(self) -> float:
        self.state = (self.state * LCG_MULTIPLIER + LCG_STEP) & 0xFFFFFFFF
        return self.state / 0xFFFFFFFF


def note_edges(edges: DataFrame, nodes: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Edges between notes (and phrases): passages fall together with their note, dreams stay out."""
    owner = nodes.select("id", F.when(F.col("kind") == "passage", F.coalesce("note_id", "id")).otherwise(F.col("id")).alias("note"))
    used = g.mode_edges(edges.filter("origin <> 'dream' AND dst IS NOT NULL"), "hipporag", weights)
    for end in ("src", "dst"):
        used = used.join(owner.withColumnsRenamed({"id": end, "note": f"_{end}"}), end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
    return used


def recent(notes: DataFrame, activity: DataFrame, cfg: Config, now: int) -> DataFrame:
    """node, base, nth: trusted notes active within the window, the most active first. activity: node, base, last_active."""
    d = cfg.dreaming
    rank = {"low": 0, "medium": 1, "high": 2}[d.trust_floor]
    met = notes.filter(trust_rank(F.col("trust")) >= rank).join(activity, notes["id"] == activity["node"]).filter(F.col("base").isNotNull() & (F.col("last_active") >= now - d.recent_days * 86_400_000))
    # As many rows as notes of a few days: one ordered pass numbers them.
    return met.select("node", "base").withColumn("nth", F.row_number().over(Window.orderBy(F.round("base", 9).desc(), "node")))


def normalised(value: Column) -> Column:
    """Min-max over all rows; 1 where all are equal."""
    w = Window.partitionBy()
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high > low, (value - low) / (high - low)).otherwise(1.0)


def partners(a: str, draws: Draws, pool: list[tuple[str, float]]) -> str | None:
    """One of the pool (id, weight) by inverse cumulative weight; uniform if all weigh nothing."""
    if not pool:
        return None
    total = sum(w for _, w in pool)
    if total <= 0:
        return pool[min(int(draws() * len(pool)), len(pool) - 1)][0]
    r = draws() * total
    for name, w in pool:
        r -= w
        if r <= 0:
            return name
    return pool[-1][0]


def sample_pairs(notes: DataFrame, active: DataFrame, edges: DataFrame, nodes: DataFrame, cfg: Config, night: str, blocked: set[tuple[str, str]] = frozenset()) -> list[tuple[str, str]]:
    """The night's pairs: some with a uniform older note, the others with a far one of little mass.

    Masses and hops of all the recent notes that can be drawn come from two batch jobs; the draws themselves are
    a sequence by definition and run on the driver over the pool of trusted notes.
    """
    d = cfg.dreaming
    first = [r["node"] for r in active.filter(F.col("nth") <= d.samples).orderBy("nth").collect()]
    if not first:
        return []
    spark = notes.sparkSession
    rank = {"low": 0, "medium": 1, "high": 2}[d.trust_floor]
    trusted = [r["id"] for r in notes.filter(trust_rank(F.col("trust")) >= rank).select("id").orderBy("id").collect()]
    fresh = {r["node"] for r in active.select("node").collect()}
    old = [n for n in trusted if n not in fresh]
    adjacent = g.adjacency(note_edges(edges, nodes, cfg.graph.origin_weights))
    seeds = spark.createDataFrame([(n, n, 1.0) for n in first], "query_id string, node string, value double")
    mass = {(r["query_id"], r["node"]): r["mass"] for r in g.pagerank(seeds, adjacent, cfg.graph.damping, cfg.graph.tolerance).join(notes.select(F.col("id").alias("node")), "node", "left_semi").collect()}
    near = {(r["source"], r["node"]) for r in g.hops(seeds.select("node"), adjacent, d.min_hops - 1).collect()}
    draws, noise, out = Draws(seed_of(night)), round(d.samples * d.noise_share), []
    for i in range(d.samples):
        a = first[i % len(first)]
        if i < noise:
            pool = [n for n in old if n != a] or [n for n in trusted if n != a]
            b = partners(a, draws, [(n, 0.0) for n in pool])
        else:
            far = [n for n in old if n != a and (a, n) not in near]
            masses = [mass.get((a, n), 0.0) for n in far]
            top = max(masses, default=0.0)
            b = partners(a, draws, [(n, 1 - m / top if top > 0 else 1.0) for n, m in zip(far, masses, strict=True)])
        pair = tuple(sorted((a, b))) if b else None
        if b and pair not in blocked and pair not in {tuple(sorted(p)) for p in out}:
            out.append((a, b))
    return out


def grounded(quote: Column, passage: Column) -> Column:
    """Whether a quote of some length stands in the passage, white space aside."""
    return (F.length(squeezed(quote)) >= LEAST_QUOTE) & F.contains(squeezed(passage), squeezed(quote))


def quoted_in(quotes: DataFrame, passages: DataFrame) -> DataFrame:
    """quote_id, passage_id of all grounded pairs. quotes: quote_id, quote, of KEY_WORDS + 2 words at least (others give none); passages: passage_id, passage.

    A quote's first and last words may be parts of the passage's, those between are whole words of it. So the pairs
    meet by the quote's words after its first one, and then are tested; no passage meets all quotes.
    """
    parts = lambda c: F.split(squeezed(F.col(c)), " ")
    key = lambda w, at: F.xxhash64(*[F.get(w, at + k) for k in range(KEY_WORDS)])
    asked = quotes.filter(F.size(parts("quote")) >= KEY_WORDS + 2).select("quote_id", "quote", key(parts("quote"), F.lit(1)).alias("key"))
    listed = passages.select("passage_id", parts("passage").alias("w")).filter(F.size("w") >= KEY_WORDS)
    places = listed.select("passage_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - KEY_WORDS), lambda i: key(F.col("w"), i))).alias("key"))
    met = places.join(asked, "key").select("passage_id", "quote_id", "quote").distinct()
    return met.join(passages, "passage_id").filter(grounded(F.col("quote"), F.col("passage"))).select("quote_id", "passage_id").distinct()


def accepted(rows: DataFrame) -> DataFrame:
    """rows with `kept`: a short gist, and two different grounded quotes. rows: gist, quote_a, quote_b, text_a, text_b."""
    ok = (F.length("gist") <= MOST_GIST) & grounded(F.col("quote_a"), F.col("text_a")) & grounded(F.col("quote_b"), F.col("text_b")) & (squeezed(F.col("quote_a")) != squeezed(F.col("quote_b")))
    return rows.withColumn("kept", F.coalesce(ok, F.lit(False)))


def new_candidates(rows: DataFrame, existing: DataFrame, night: str, cfg: Config) -> DataFrame:
    """Kept associations as open candidates, without the ids that exist. rows: a, b, hops, confidence, activation_norm."""
    made = rows.withColumns({
        "id": F.concat(F.lit(f"d-{night}-"), short_hash(F.col("a"), F.col("b"))), "salience": salience(F.coalesce("hops", F.lit(6)), F.col("confidence"), F.col("activation_norm")),
        "hops": F.coalesce("hops", F.lit(6)), "night": F.lit(night), "expires": F.date_add(F.lit(night).cast("date"), cfg.dreaming.ttl_nights), "state": F.lit("open"),
    })
    return made.join(existing.select("id"), "id", "left_anti")


def next_state(state: Column, action: Column, expires: Column, today: Column) -> Column:
    """open and endorsed candidates follow actions, past their date they expire; other states stay."""
    live = state.isin("open", "endorsed")
    moves = {"endorse": "endorsed", "dismiss": "dismissed", "accept": "accepted", "reject": "rejected"}
    out = F.when(~live, state).when(expires < today, F.lit("expired"))
    for verb, to in moves.items():
        out = out.when(action == verb, F.lit(to))
    return out.otherwise(state)


def visible(candidates: DataFrame, today: Column) -> DataFrame:
    """Candidates that make dream edges."""
    return candidates.filter(F.col("state").isin("open", "endorsed") & (F.col("expires") >= today))


def wake(fragments: DataFrame, n: int) -> DataFrame:
    """The kept fragments of most salience."""
    return fragments.filter("status = 'kept'").orderBy(F.col("salience").desc(), "a", "b").limit(n)


def error_counts(fragments: DataFrame) -> DataFrame:
    return fragments.filter("code IS NOT NULL").groupBy("code").agg(F.count(F.lit(1)).alias("n"))
