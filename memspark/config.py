"""Settings as frozen dataclasses, with deep merge and validation."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any

# The defaults of the engine whose results these queries match.
DEFAULT_ORIGIN_WEIGHTS = {"contains": 1.0, "link": 1.0, "fact": 1.5, "provenance": 0.5, "triple": 1.0, "synonym": 0.5, "dream": 0.0}
MODE_ORIGINS = {
    "wikilink": ("contains", "link"),
    "typed": ("contains", "link", "fact", "provenance", "dream"),
    "hipporag": ("contains", "link", "fact", "provenance", "triple", "synonym", "dream"),
}
TRUST_RANKS = {"low": 0, "medium": 1, "high": 2}
SOURCE_TRUST = {"user": "high", "import": "high", "agent": "medium", "tool": "low", "web": "low"}
SOURCE_WEIGHTS = {"user": 2, "import": 2, "agent": 1, "tool": 0, "web": 0}


@dataclass(frozen=True)
class Predicate:
    """What a fact's predicate allows."""

    object: str = "any"
    inverse: str | None = None
    values: tuple[str, ...] = ()
    cardinality: str = "many"


@dataclass(frozen=True)
class Ladder:
    modes: tuple[str, ...] = ("wikilink", "typed", "hipporag")
    min_top_margin: float = 0.05
    min_seeds: int = 2
    multi_entity_threshold: int = 2


@dataclass(frozen=True)
class Recognition:
    enabled: bool = False
    min_confidence: float = 0.7
    top_candidates: int = 10


@dataclass(frozen=True)
class Graph:
    default_extraction: str = "typed"
    scopes: tuple[tuple[str, str], ...] = ()
    origin_weights: Mapping[str, float] = field(default_factory=lambda: dict(DEFAULT_ORIGIN_WEIGHTS))
    synonym_threshold: float = 0.7
    max_synonym_edges: int = 3
    damping: float = 0.5
    max_iterations: int = 100
    tolerance: float = 1e-8
    ladder: Ladder = Ladder()
    recognition: Recognition = Recognition()


@dataclass(frozen=True)
class Expansion:
    enabled: bool = False
    per_hit: int = 1
    max_inserted: int = 3


@dataclass(frozen=True)
class Retrieval:
    top_k: int = 8
    token_budget: int = 2000
    seed_limit: int = 20
    candidates: int = 400
    rrf_k: int = 60
    graph_weight: float = 1.0
    activation_weight: float = 0.3
    importance_weight: float = 0.2
    decay: float = 0.5
    threshold_days: float = 30.0
    noise: float = 1.0
    trust_floor: str = "low"
    include_superseded: bool = False
    expansion: Expansion = Expansion()


@dataclass(frozen=True)
class Dreaming:
    samples: int = 20
    min_hops: int = 2
    recent_days: int = 7
    noise_share: float = 0.25
    trust_floor: str = "medium"
    fragments: int = 3
    ttl_nights: int = 14


@dataclass(frozen=True)
class Consolidation:
    corroboration: bool = False
    min_support: int = 2


@dataclass(frozen=True)
class Vault:
    facts_heading: str = "Facts"
    history_heading: str = "History"
    ignore: tuple[str, ...] = ()


@dataclass(frozen=True)
class Config:
    vault: Vault = Vault()
    graph: Graph = Graph()
    retrieval: Retrieval = Retrieval()
    dreaming: Dreaming = Dreaming()
    consolidation: Consolidation = Consolidation()
    predicates: Mapping[str, Predicate] = field(default_factory=dict)


def merged(base: Any, changes: Mapping[str, Any]) -> Any:
    """base with the nested changes applied; unknown names are an error."""
    known = {f.name: getattr(base, f.name) for f in fields(base)}
    if unknown := set(changes) - set(known):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    new = {}
    for name, value in changes.items():
        old = known[name]
        if is_dataclass(old) and isinstance(value, Mapping):
            new[name] = merged(old, value)
        elif name == "origin_weights":
            new[name] = {**old, **value}
        elif name == "predicates":
            new[name] = {**old, **{k: v if isinstance(v, Predicate) else Predicate(**v) for k, v in value.items()}}
        else:
            new[name] = value
    return replace(base, **new)


def checked(cfg: Config) -> Config:
    """cfg, if its values make sense."""
    g, r = cfg.graph, cfg.retrieval
    rules = {
        "damping must be in (0, 1)": 0 < g.damping < 1,
        "unknown edge origin": set(g.origin_weights) <= set(DEFAULT_ORIGIN_WEIGHTS),
        "origin weights can't be negative": all(w >= 0 for w in g.origin_weights.values()),
        "unknown mode in the ladder": set(g.ladder.modes) <= set(MODE_ORIGINS),
        "unknown trust": {r.trust_floor, cfg.dreaming.trust_floor} <= set(TRUST_RANKS),
        "top_k, token_budget and seed_limit must be positive": min(r.top_k, r.token_budget, r.seed_limit) > 0,
        "decay must be positive": r.decay > 0,
        "cardinality is one or many": all(p.cardinality in ("one", "many") for p in cfg.predicates.values()),
    }
    for message, ok in rules.items():
        if not ok:
            raise ValueError(message)
    return cfg
