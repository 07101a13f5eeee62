"""Stored state: usage summaries with their watermark, dream candidates and logs, baselines, index versions, the registry of vaults.

Tables are Parquet in folders of their own version and a pointer that is written last, so a reader sees a whole state or
the one before it. Small records (registry, report of a night, pointers) are JSON.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..config import Config
from ..operators import activation as act
from ..operators.federate import LAYER_WEIGHTS
from ..storage import delete, file_of, read_text, write_text

HOUR = 3_600_000
#: What a stored index depends on besides the notes; another number means a full rebuild.
INDEX_VERSION = 2
#: Parts of a stored index's tables, and the columns that name the note a row belongs to.
PARTS = 64
OWNERS = ("declared_in", "note_id", "node_id", "id", "path")
#: How long a replaced part stays for readers that have opened it.
KEEP_MS = 24 * HOUR
# Names of the registry's write targets, what its ids look like, the words that tell of a night, keys and text of stored settings.
# The codes of RULES are fixed values as well.
TARGETS = ("self", "project", "global-agent", "global")
VAULT_ID = r"[a-z0-9][a-z0-9-]*"
ELSEWHERE = "<absolute-path>"
NIGHT = {"good": "slept fine", "bad": "slept badly", "idle": "no dreaming happened", "blank": "no dreams it remembers"}
VOLATILE = ("built_at", "builtAt", "timestamp", "generatedAt", "now", "mtime", "createdAt", "updatedAt")


def listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, modified) of a folder's files."""
    fs, where = file_of(spark, path)
    return sorted((s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(where)) if fs.exists(where) else []


# Versioned tables.


def store(df: DataFrame, root: str, name: str, meta: dict) -> None:
    """Write a table's next version, then its pointer with meta; versions that were replaced go when they are KEEP_MS old."""
    spark = df.sparkSession
    at = json.loads(read_text(spark, f"{root}/{name}.json") or "{}")
    version = at.get("version", 0) + 1
    df.write.mode("overwrite").parquet(f"{root}/{name}/v{version}")
    write_text(spark, f"{root}/{name}.json", json.dumps({**meta, "version": version}, sort_keys=True))
    expire(spark, f"{root}/{name}", {f"v{version}"})


def stored(spark: SparkSession, root: str, name: str) -> tuple[DataFrame, dict] | None:
    """(table, meta) of the last whole version."""
    text = read_text(spark, f"{root}/{name}.json")
    if text is None:
        return None
    meta = json.loads(text)
    return spark.read.parquet(f"{root}/{name}/v{meta['version']}"), meta


def store_summaries(access: DataFrame, root: str) -> int:
    """Fold the access log into summaries and store them; the watermark up to which they speak."""
    mark = act.watermark(access).first()["watermark"]
    store(act.compact(access.filter(F.col("t") <= mark)), root, "summaries", {"watermark": mark})
    return mark


def presentations(spark: SparkSession, root: str, access: DataFrame, as_of: int | None = None) -> DataFrame:
    """Presentations from the stored summaries and the log after their watermark; from the whole log if nothing is stored."""
    held = stored(spark, root, "summaries")
    summaries, mark = (held[0], held[1]["watermark"]) if held else (act.compact(access.limit(0)), 0)
    return act.presentations(summaries, access, mark, as_of)


def fingerprint(cfg: Config) -> str:
    """A hash of the settings that an index is built from; those of recall don't change it."""
    built = {"version": INDEX_VERSION, "vault": asdict(cfg.vault), "graph": [cfg.graph.default_extraction, cfg.graph.scopes, cfg.graph.synonym_threshold, cfg.graph.max_synonym_edges], "predicates": {k: asdict(p) for k, p in cfg.predicates.items()}}
    return hashlib.sha256(json.dumps(built, sort_keys=True, default=list).encode()).hexdigest()[:16]


def owned(df: DataFrame) -> DataFrame:
    """df with `part`, by the note that a row belongs to."""
    of = [F.col(c).cast("string") for c in OWNERS if c in df.columns]
    return df.withColumn("part", F.pmod(F.xxhash64(F.coalesce(*of, F.lit(""))), F.lit(PARTS)).cast("int"))


def marks(df: DataFrame) -> dict[str, str]:
    """For each part that has rows, their number and a sum of their hashes."""
    row = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).cast("decimal(38,0)")
    found = owned(df).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(row).cast("string").alias("h")).collect()  # PARTS rows at most
    return {str(r["part"]): f"{r['n']}:{r['h']}" for r in found}


def store_index(tables: dict[str, DataFrame], root: str, cfg: Config) -> dict[str, int]:
    """Store an index's tables; how many parts of each were written.

    A table is kept in parts by its rows' notes (edges also by origin, so that a mode prunes). A part whose rows are those of
    the version before is not written again: the new version points to it. The pointer is replaced last and in one
    step, so readers and a run that is lost in between keep the version before. Parts that no version points to go
    when they are KEEP_MS old, so that a reader that has opened them can finish.
    """
    spark = next(iter(tables.values())).sparkSession
    before = json.loads(read_text(spark, f"{root}/index.json") or "{}")
    held = before.get("tables", {}) if before.get("config") == fingerprint(cfg) else {}
    version = before.get("version", 0) + 1
    out: dict[str, dict] = {}
    written_parts: dict[str, int] = {}
    for name, df in tables.items():
        old = held.get(name, {})
        same = old and StructType.fromJson(json.loads(old["schema"])).simpleString() == df.schema.simpleString()
        old = old["parts"] if same else {}
        now = marks(df)
        new = [k for k, mark in now.items() if k not in old or old[k][1] != mark]
        if new:
            writer = owned(df).filter(F.col("part").isin([int(k) for k in new])).repartition("part").write.mode("overwrite")
            writer.partitionBy(*(["part", "origin"] if "origin" in df.columns else ["part"])).parquet(f"{root}/index/{name}/v{version}")
        out[name] = {"schema": df.schema.json(), "parts": {k: [version if k in new else old[k][0], mark] for k, mark in now.items()}}
        written_parts[name] = len(new)
    write_text(spark, f"{root}/index.json", json.dumps({"version": version, "config": fingerprint(cfg), "tables": out}))
    for name, t in out.items():
        expire(spark, f"{root}/index/{name}", {f"v{v}" for v, _ in t["parts"].values()})
    for name in ("graphs", "postings"):
        expire(spark, f"{root}/{name}", {f"v{version}"})
    return written_parts


def expire(spark: SparkSession, folder: str, used: set[str]) -> None:
    """Delete a folder's versions that aren't used and have not been written to for KEEP_MS."""
    now = spark.sparkContext._jvm.java.lang.System.currentTimeMillis()
    for name, modified in listed(spark, folder):
        if name not in used and now - modified > KEEP_MS:
            delete(spark, f"{folder}/{name}")


def index_version(spark: SparkSession, root: str) -> str:
    return str(json.loads(read_text(spark, f"{root}/index.json") or "{}").get("version", 0))


def open_index(spark: SparkSession, root: str, cfg: Config) -> dict[str, DataFrame] | None:
    """The stored index, read only; None if there is none, or it was built from other settings and must be rebuilt."""
    text = read_text(spark, f"{root}/index.json")
    if text is None or json.loads(text)["config"] != fingerprint(cfg):
        return None
    out = {}
    for name, t in json.loads(text)["tables"].items():
        schema = StructType.fromJson(json.loads(t["schema"]))
        by_version: dict[int, list[str]] = {}
        for part, (v, _) in t["parts"].items():
            by_version.setdefault(v, []).append(part)
        df = None
        for v, parts in sorted(by_version.items()):
            base = f"{root}/index/{name}/v{v}"
            got = spark.read.schema(StructType([*schema.fields, StructField("part", IntegerType())])).option("basePath", base).parquet(*[f"{base}/part={k}" for k in parts])
            df = got if df is None else df.unionByName(got)
        out[name] = df.select(*schema.names) if df is not None else spark.createDataFrame([], schema)
    return out


# Dream candidates and the night's log.


def store_candidates(rows: DataFrame, root: str) -> None:
    store(rows, root, "candidates", {})


def open_candidates(spark: SparkSession, root: str, today: str) -> DataFrame | None:
    """Candidates as of a day: those past their date are expired, whether or not that was written."""
    held = stored(spark, root, "candidates")
    if held is None:
        return None
    late = F.col("state").isin("open", "endorsed") & (F.col("expires") < F.lit(today).cast("date"))
    return held[0].withColumn("state", F.when(late, "expired").otherwise(F.col("state")))


def write_night(spark: SparkSession, root: str, night: str, report: dict, fragments: list[dict]) -> None:
    """A night's log: its report, and a bounded number of fragments."""
    write_text(spark, f"{root}/log/{night}.json", json.dumps({"night": night, "report": report, "fragments": fragments}))


def expire_nights(spark: SparkSession, root: str, ttl_hours: float, now: int) -> list[str]:
    """Delete logs that nobody read in time; 0 hours keeps them. The nights that went."""
    if ttl_hours <= 0:
        return []
    old = [n for n, modified in listed(spark, f"{root}/log") if n.endswith(".json") and modified < now - ttl_hours * HOUR]
    for name in old:
        delete(spark, f"{root}/log/{name}")
    return [n.removesuffix(".json") for n in old]


def claim_night(spark: SparkSession, root: str) -> dict | None:
    """The latest night's log, read once: the reader that renames the file has it, and it is gone afterwards."""
    nights = [n for n, _ in listed(spark, f"{root}/log") if n.endswith(".json")]
    if not nights:
        return None
    fs, where = file_of(spark, f"{root}/log/{nights[-1]}")
    mine = f"{root}/log/{nights[-1]}.reading-{hashlib.sha256(str(id(fs)).encode()).hexdigest()[:8]}"
    if not fs.rename(where, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(mine)):
        return None
    try:
        log = json.loads(read_text(spark, mine) or "null")
        return log if isinstance(log, dict) and isinstance(log.get("night"), str) else None
    except ValueError:
        return None
    finally:
        delete(spark, mine)


def slept(report: dict, shown: int) -> str:
    """One line on a night. It was bad if the pass failed or errors took every sample; what is told beside that is the first that applies."""
    errors = report.get("errors", {})
    lost = sum(errors.values())
    whole = report.get("ran", False) and (lost == 0 or lost < report.get("samples", 0) or report.get("samples", 0) <= 0)
    how = NIGHT["good" if whole or report.get("skipped") else "bad"]
    beside = ((report.get("skipped"), ", " + NIGHT["idle"]), (errors, " (" + " ".join(map("=".join, zip(errors, map(str, errors.values()), strict=True))) + ")"), (whole and not shown, ", " + NIGHT["blank"]))
    return how + next((text for applies, text in beside if applies), "")


def woken(spark: SparkSession, root: str, shown: int, ttl_hours: float, now: int) -> dict:
    """What is recalled on waking: the heaviest kept fragments, how many are forgotten, and a summary. Late logs go first."""
    expire_nights(spark, root, ttl_hours, now)
    log = claim_night(spark, root)
    if log is None or not log.get("report"):
        return {"night": None, "fragments": [], "forgotten": 0, "summary": "nothing left to recall", "recalled": False}
    kept = sorted((f for f in log.get("fragments", []) if f.get("status") == "kept" and f.get("gist") is not None), key=lambda f: (-f["salience"], f["a"], f["b"]))
    top = kept[: max(shown, 0)]
    name = lambda f: f"d-{log['night']}-" + hashlib.sha256(f"{f['a']}\0{f['b']}".encode()).hexdigest()[:10]
    return {"night": log["night"], "fragments": [{"id": name(f), "a": f["a"], "b": f["b"], "gist": f["gist"]} for f in top], "forgotten": len(kept) - len(top), "summary": slept(log["report"], len(top)), "recalled": True}


# Baselines of an evaluation.


def portable(settings: dict) -> dict:
    """Settings as one flat table, dotted name to value, without times; a path of this machine is replaced."""
    out, todo = {}, [("", settings)]
    while todo:
        name, value = todo.pop()
        if isinstance(value, (dict, list, tuple)):
            inside = value.items() if isinstance(value, dict) else enumerate(value)
            todo += [(f"{name}.{k}".lstrip("."), v) for k, v in inside if k not in VOLATILE]
        else:
            out[name] = ELSEWHERE if isinstance(value, str) and PurePosixPath(value).is_absolute() else value
    return dict(sorted(out.items()))


def store_baseline(results: DataFrame, root: str, fixture_hash: str, settings: dict, totals: dict) -> None:
    """results: a row for each query, with its hits and metrics."""
    store(results, root, "baseline", {"fixture": fixture_hash, "settings": portable(settings), "totals": totals})


def open_baseline(spark: SparkSession, root: str) -> tuple[DataFrame, dict] | None:
    return stored(spark, root, "baseline")


# The registry of vaults.


def places(tree, where: str) -> list[tuple[tuple[str, ...], object]]:
    """(names of the way, value) of what stands at a dotted place; `*` is every key of a mapping, `[]` every item of a list."""
    found: list[tuple[tuple[str, ...], object]] = [((), tree)]
    for step in where.split("."):
        inside = [(way, (list(enumerate(v)) if isinstance(v, list) else []) if step == "[]" else list(v.items()) if isinstance(v, dict) else []) for way, v in found]
        found = [((*way, str(k)), x) for way, each in inside for k, x in each if step in ("*", "[]", k)]
    return found


def proper(x) -> bool:
    return isinstance(x, str) and re.fullmatch(VAULT_ID, x) is not None


def is_weight(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and 0 <= x <= 1


#: What has to hold at each place of a registry, by the name of its problem: a test of (last name, value), and what it says.
RULES = (
    ("bad-version", "workspace", lambda k, v: v == 1, "must be 1"),
    ("bad-vaults", "vaults", lambda k, v: isinstance(v, dict), "must map ids to coordinates"),
    ("bad-id", "vaults.*", lambda k, v: proper(k), "is no proper id"),
    ("bad-coords", "vaults.*", lambda k, v: isinstance(v, dict), "must hold coordinates"),
    ("bad-coord", "vaults.*.project", lambda k, v: proper(v), "is no proper name"),
    ("bad-coord", "vaults.*.agent", lambda k, v: proper(v), "is no proper name"),
    ("bad-defaults", "defaults", lambda k, v: isinstance(v, dict), "must be a mapping"),
    ("defaults-index", "defaults.index", lambda k, v: False, "belongs to each vault"),
    ("bad-writes", "writes.default", lambda k, v: isinstance(v, list), "must be a list"),
    ("bad-writes", "writes.agents", lambda k, v: isinstance(v, dict), "must map agents to targets"),
    ("bad-writes", "writes.agents.*", lambda k, v: isinstance(v, list), "must be a list"),
    ("bad-write-target", "writes.default.[]", lambda k, v: v in TARGETS, "is no target"),
    ("bad-write-target", "writes.agents.*.[]", lambda k, v: v in TARGETS, "is no target"),
    ("bad-layer", "recall.layerWeights.*", lambda k, v: k in LAYER_WEIGHTS, "is no layer"),
    ("bad-layer-weight", "recall.layerWeights.*", lambda k, v: k not in LAYER_WEIGHTS or is_weight(v), "must be from 0 to 1"),
)
#: Without these there is no registry.
REQUIRED = ("workspace", "vaults")


def problems_of(registry: dict, there: set[str] | None = None) -> list[tuple[str, str, str]]:
    """(severity, code, message) of what is wrong with a registry. there: the folders that exist."""
    tree = {**dict.fromkeys(REQUIRED), **registry}
    out = [("error", f"workspace.{code}", f"{'.'.join(way)} {said}") for code, where, holds, said in RULES for way, value in places(tree, where) if not holds(way[-1], value)]
    cells: dict[tuple, list[str]] = {}
    for (_, name), at in places(tree, "vaults.*"):
        if isinstance(at, dict):
            cells.setdefault((str(at.get("project")), str(at.get("agent"))), []).append(name)
    out += [("error", "workspace.duplicate-cell", f"{', '.join(names)} are in one cell") for names in cells.values() if len(names) > 1]
    names = [name for known in cells.values() for name in known]
    return out + [("warning", "workspace.missing-dir", f"{name} has no folder") for name in sorted(names) if there is not None and proper(name) and name not in there]


def read_registry(spark: SparkSession, path: str, there: set[str] | None = None) -> tuple[dict, list[tuple[str, str, str]]]:
    """(registry, its warnings); errors are raised together."""
    text = read_text(spark, path)
    if text is None:
        raise FileNotFoundError(path)
    registry = json.loads(text)
    if not isinstance(registry, dict):
        raise ValueError("a registry is an object")
    found = problems_of(registry, there)
    if errors := [m for severity, _, m in found if severity == "error"]:
        raise ValueError("; ".join(errors))
    return registry, found


def binding(registry: dict, project: str | None = None, agent: str | None = None) -> tuple[str | None, str | None]:
    """(project, agent), if the registry knows both."""
    for axis, name in (("project", project), ("agent", agent)):
        known = sorted({v[axis] for v in registry["vaults"].values() if v.get(axis)})
        if name is not None and name not in known:
            raise ValueError(f"unknown {axis} {name!r}; registered: {', '.join(known) or '(none)'}")
    return project, agent


def targets_of(registry: dict, agent: str | None) -> list[str]:
    """Where an agent may write: its own rule replaces the default, which is its own vault alone."""
    writes = registry.get("writes", {})
    own = writes.get("agents", {}).get(agent) if agent else None
    return list(own if own is not None else writes.get("default", ["self"]))


def target_vault(registry: dict, project: str | None, agent: str | None, target: str) -> str | None:
    """The vault of a write target; None if its cell has none."""
    cell = {"self": (project, agent), "project": (project, None), "global-agent": (None, agent), "global": (None, None)}[target]
    return next((name for name, v in registry["vaults"].items() if (v.get("project"), v.get("agent")) == cell), None)
