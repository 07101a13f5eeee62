"""Markdown notes: front matter, passages, wikilinks and fact lines of one file, in plain Python.

Parsing a note is a walk with state (fences, sections, balanced brackets), so it runs file by file in Arrow batches;
everything after it is columns again.
"""

from __future__ import annotations

import hashlib
import re
from calendar import monthrange
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

from ..config import SOURCE_TRUST, TRUST_RANKS, Vault

# What a note's type requires, where such notes live, and the fields of a fact line that aren't its predicate.
REQUIRED = {"entity": ("kind", "created"), "episode": ("started", "by", "source"), "schema": ("generated",), "procedure": ("created",)}
FOLDERS = {"entity": "entities/", "episode": "episodes/", "schema": "schemas/", "procedure": "procedures/"}
FACT_FIELDS = ("valid", "at", "src", "by", "conf", "trust", "id", "superseded")
MODES = ("wikilink", "typed", "hipporag")

NULLS = ("", "null", "~")
LINK = re.compile(r"\[\[([^\[\]\n]+?)\]\]")
HEADING = re.compile(r"(#{1,6})\s+(.*?)\s*#*\s*")
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def scalar(raw: str):
    """A value of the YAML subset."""
    s = raw.strip()
    if s in NULLS:
        return None
    if s[0] in "\"'" and s[-1] == s[0] and len(s) > 1:
        return s[1:-1]
    if s in ("true", "false"):
        return s == "true"
    if re.fullmatch(r"-?\d+", s):
        return int(s)
    if re.fullmatch(r"-?\d+\.\d+", s):
        return float(s)
    return s


def inline_list(raw: str) -> list:
    """The items of [a, b, "c, d", [[x]]]: commas inside quotes and brackets don't separate."""
    items, depth, quote, now = [], 0, "", ""
    for c in raw.strip()[1:-1]:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'" and not now.strip():
            quote = c
        elif c in "[]":
            depth += 1 if c == "[" else -1
        elif c == "," and depth == 0:
            items.append(now)
            now = ""
            continue
        now += c
    return [scalar(x) for x in [*items, now] if x.strip()]


def front_matter(text: str) -> tuple[dict, str, int, list[tuple[int, str]]]:
    """(fields, body, lines before the body, errors)."""
    lines = text.removeprefix("﻿").split("\n")
    if lines[0].rstrip() != "---":
        return {}, text, 0, []
    try:
        end = next(i for i, x in enumerate(lines[1:], 1) if x.rstrip() == "---")
    except StopIteration:
        return {}, text, 0, [(1, "front matter isn't closed")]
    out, errors, key = {}, [], None
    for n, line in enumerate(lines[1:end], 2):
        line = line.rstrip()
        if not line or line.lstrip().startswith("#"):
            continue
        if (m := re.match(r"\s+-\s+(.*)", " " + line)) and key is not None:
            out[key] = [*(out[key] if isinstance(out[key], list) else []), scalar(m[1])]
        elif line[0] in " \t":
            errors.append((n, "nested values aren't supported"))
        elif m := re.match(r"([A-Za-z_][\w-]*):(.*)", line):
            key, raw = m[1], m[2].strip()
            bracketed = raw.startswith("[") and raw.endswith("]") and not raw.startswith("[[")
            out[key] = inline_list(raw) if bracketed else scalar(raw)
        else:
            errors.append((n, "not a key: value line"))
    return out, "\n".join(lines[end + 1 :]), end + 1, errors


def millis(t: datetime) -> int:
    return (t - EPOCH) // timedelta(milliseconds=1)


def period(raw) -> tuple[int, int] | None:
    """Start and end of a named year, month, day or instant in UTC, or None."""
    s = str(raw).strip()
    try:
        if m := re.fullmatch(r"(\d{4})(?:-(\d{2})(?:-(\d{2}))?)?", s):
            year, month, day = (int(x) if x else None for x in m.groups())
            start = datetime(year, month or 1, day or 1, tzinfo=UTC)
            days = 1 if day else monthrange(year, month)[1] if month else (datetime(year + 1, 1, 1, tzinfo=UTC) - start).days
            return millis(start), millis(start + timedelta(days=days))
        if re.match(r"\d{4}-\d{2}-\d{2}T", s):
            t = datetime.fromisoformat(s)
            at = millis(t if t.tzinfo else t.replace(tzinfo=UTC))
            return at, at + 1
    except (ValueError, OverflowError):
        pass
    return None


def instant(raw) -> int | None:
    if raw is None or isinstance(raw, int | float) and not isinstance(raw, bool) and raw > 9999:
        return raw
    found = period(raw)
    return found[0] if found else None


def interval(raw: str) -> tuple[int | None, int | None] | None:
    """from..to, half open; one side may be missing, a lone value is from. None if malformed or turned around."""
    s = re.sub(r"\s*→\s*", "..", raw.strip())
    left, dots, right = s.partition("..")
    ends = [period(x) if x.strip() else None for x in (left, right)]
    if any(x.strip() and e is None for x, e in zip((left, right), ends, strict=True)):
        return None
    low, high = (e[0] if e else None for e in ends)
    return None if low is not None and high is not None and high <= low else (low, high)


def link_of(inside: str) -> dict:
    target, _, alias = inside.partition("|")
    target, _, heading = target.partition("#")
    return {"target": re.sub(r"(?i)\.md$", "", target.strip().rsplit("/", 1)[-1]), "alias": alias.strip() or None, "heading": heading.strip() or None}


def lone_link(s: str) -> dict | None:
    m = LINK.fullmatch(s.strip())
    return link_of(m[1]) if m else None


def short_hash(*parts) -> str:
    return hashlib.sha256("\0".join("null" if p is None else str(p) for p in parts).encode()).hexdigest()[:10]


def inline_fields(body: str) -> tuple[list[tuple[str, str]], str, bool]:
    """[key:: value] fields (values may hold brackets), the text outside, and whether the line is struck through."""
    out, rest, struck, i = [], "", False, 0
    while i < len(body):
        if body.startswith("~~", i):
            struck = True
            i += 2
            continue
        m = re.compile(r"\[([A-Za-z_][\w-]*)::").match(body, i)
        if m:
            depth, j = 1, m.end()
            while j < len(body) and depth:
                depth += {"[": 1, "]": -1}.get(body[j], 0)
                j += 1
            if depth == 0:
                out.append((m[1], body[m.end() : j - 1].strip()))
                i = j
                continue
        rest += body[i]
        i += 1
    return out, re.sub(r"\s+", " ", rest).strip(), struck


class Problems(list):
    def __init__(self, path: str):
        super().__init__()
        self.path = path

    def add(self, severity: str, code: str, message: str, line: int | None = None) -> None:
        self.append({"severity": severity, "path": self.path, "line": line, "code": code, "message": message})


def fact_of(line: str, note: str, number: int, section: str, default_time: int | None, problems: Problems) -> dict | None:
    """The fact of one list item, or None."""
    say = lambda severity, code, message: problems.add(severity, "fact." + code, message, number)
    m = re.match(r"\s*[-*+]\s+(.*)", line)
    if not m:
        say("warning", "not-list-item", "text outside list items is ignored")
        return None
    body, block = m[1].strip(), None
    if b := re.search(r"(?:^|\s)\^([A-Za-z0-9-]+)\s*$", body):
        body, block = body[: b.start()].strip(), b[1]
    fields, rest, struck = inline_fields(body)
    claims = [(k, v) for k, v in fields if k not in FACT_FIELDS]
    if len(claims) != 1:
        if not fields:
            say("warning", "no-fields", "no [key:: value] field")
        else:
            say("error", "multiple-predicates" if claims else "no-predicate", f"one predicate a line, not {len(claims)}")
        return None
    predicate, value = claims[0]
    if not re.fullmatch(r"[a-z][a-z0-9_]*", predicate):
        say("warning", "predicate-case", f"{predicate} isn't snake_case")
    meta = {}
    for k, v in fields:
        if k in FACT_FIELDS:
            if k in meta:
                say("warning", "duplicate-field", f"{k} is there twice; the last counts")
            meta[k] = v

    def read(key, parse, otherwise, message):
        if key not in meta:
            return otherwise
        got = parse(meta[key])
        if got is None:
            say("error", "bad-" + key, message)
            return otherwise
        return got

    link = lone_link(value)
    if not link and "[[" in value:
        say("warning", "mixed-object", "text and links together are a literal")
    obj = link["target"] if link else re.sub(r"^[\"']|[\"']$", "", value)
    low, high = read("valid", interval, (None, None), "not from..to")
    by = read("by", lambda v: v if v in SOURCE_TRUST else None, "user", "unknown source")
    src = read("src", lone_link, None, "not a single link")
    number_of = lambda v: float(v) if re.fullmatch(r"\d+(\.\d+)?", v) and float(v) <= 1 else None
    superseded = read("superseded", instant, None, "not a time")
    fact = {
        "predicate": predicate, "object_kind": "link" if link else "literal", "object": obj, "valid_from": low, "valid_to": high,
        "recorded_at": read("at", instant, default_time, "not a time"), "superseded_at": superseded, "by": by,
        "trust": read("trust", lambda v: v if v in TRUST_RANKS else None, SOURCE_TRUST[by], "not high, medium or low"),
        "conf": read("conf", number_of, 1.0, "not a number from 0 to 1"), "src": src["target"] if src else None,
        "status": "superseded" if struck or superseded is not None else "historical" if section == "history" else "current", "line": number,
    }
    if by not in ("user", "import") and not src:
        say("error", "missing-src", f"a fact by {by} must name its episode")
    if struck and superseded is None:
        say("warning", "struck-no-date", "struck through without a date")
    if rest and not re.match(r"(—|--)", rest):
        say("warning", "stray-text", "text outside fields")
    key = f"[[{obj}]]" if link else obj
    return {"id": block or meta.get("id") or "f-" + short_hash(note, predicate, key, low), **fact}


def strings(v) -> list[str]:
    return [] if v is None else [str(x) for x in (v if isinstance(v, list) else [v]) if x is not None]


def in_text(x):
    return None if x is None else str(x)


def parse(path: str, text: str, mtime: int, vault: Vault = Vault()) -> dict:
    """One note as nested rows."""
    problems = Problems(path)
    fm, body, offset, errors = front_matter(text)
    for n, message in errors:
        problems.add("error", "frontmatter.parse", message, n)
    note = fm["id"] if isinstance(fm.get("id"), str) and fm["id"] else re.sub(r"(?i)\.md$", "", path.rsplit("/", 1)[-1])
    kind = fm.get("type") if fm.get("type") in REQUIRED else None
    if kind is None:
        problems.add("error", "note.bad-type" if "type" in fm else "note.missing-type", "type is one of " + ", ".join(REQUIRED))
    else:
        for k in REQUIRED[kind]:
            if fm.get(k) in (None, ""):
                problems.add("error", "note.missing-field", f"{kind} notes need {k}")
        if not path.startswith(FOLDERS[kind]):
            problems.add("warning", "note.folder", f"{kind} notes live under {FOLDERS[kind]}")
    importance = fm.get("importance")
    if importance is None:
        importance = 0.5
    elif isinstance(importance, bool) or not isinstance(importance, int | float) or not 0 <= importance <= 1:
        problems.add("error", "note.bad-importance", "importance is a number from 0 to 1")
        importance = 0.5
    created = instant(next((fm[k] for k in ("created", "started", "generated") if fm.get(k) is not None), None))
    updated = instant(fm.get("updated"))
    for k, got in (("created", created), ("updated", updated)):
        if fm.get(k) is not None and got is None:
            problems.add("error", "note.bad-date", f"{k} isn't a date")
    if fm.get("graph") is not None and fm["graph"] not in MODES:
        problems.add("error", "note.bad-graph", "graph is one of " + ", ".join(MODES))
    sections = {vault.facts_heading.lower(): "facts", vault.history_heading.lower(): "history"}
    default_time = next((t for t in (updated, created, mtime) if t is not None), None)
    title = fm.get("title") if isinstance(fm.get("title"), str) else None
    passages, links, facts, fact_lines = [], [], [], []
    open_lines: list[str] = []
    heading, level, section, fence = None, 0, None, False

    def close() -> None:
        joined = "\n".join(open_lines).strip()
        if joined:
            passages.append({"id": f"{note}#{len(passages)}", "heading": heading, "level": level, "text": joined, "kind": "prose"})
        open_lines.clear()

    for n, line in enumerate(body.replace("\r\n", "\n").split("\n"), offset + 1):
        if re.match(r"\s*(```|~~~)", line):
            fence = not fence
        h = None if fence else HEADING.fullmatch(line)
        if h and len(h[1]) <= 3:
            close()
            heading, level = h[2], len(h[1])
            if level == 1 and title is None:
                title = heading
            if level <= 2:
                section = sections.get(heading.lower()) if level == 2 else None
            if not section:
                open_lines.append(line)
        elif section and not fence:
            if line.strip():
                fact_lines.append(line.strip())
                if fact := fact_of(line, note, n, section, default_time, problems):
                    facts.append(fact)
        else:
            open_lines.append(line)
            if not fence:
                links += [{**link_of(m), "line": n, "passage": f"{note}#{len(passages)}"} for m in LINK.findall(line)]
    close()
    if fact_lines:
        passages.append({"id": f"{note}#facts", "heading": vault.facts_heading, "level": 2, "text": "\n".join(fact_lines), "kind": "facts"})
    for k, v in fm.items():
        if k not in ("id", "title"):
            links += [{**link_of(m), "line": 1, "passage": None} for x in strings(v) for m in LINK.findall(x)]
    seen = set()
    for f in facts:
        if f["id"] in seen:
            problems.add("error", "fact.duplicate-id", f"{f['id']} is there twice", f["line"])
        seen.add(f["id"])
    return {
        "id": note, "path": path, "type": kind, "title": title or note, "aliases": strings(fm.get("aliases")), "tags": [t.removeprefix("#") for t in strings(fm.get("tags"))],
        "importance": float(importance), "created": created, "updated": updated, "mtime": mtime, "sha256": hashlib.sha256(text.encode()).hexdigest(),
        **{k: in_text(fm.get(k)) for k in ("kind", "by", "source", "session", "agent", "origin", "graph", "consolidated")},
        "passages": passages, "links": links, "facts": facts, "problems": list(problems),
    }


SCHEMA = (
    "id string, path string, type string, title string, aliases array<string>, tags array<string>, importance double, created bigint, updated bigint, mtime bigint, sha256 string, "
    "kind string, by string, source string, session string, agent string, origin string, graph string, consolidated string, "
    "passages array<struct<id: string, heading: string, level: int, text: string, kind: string>>, "
    "links array<struct<target: string, alias: string, heading: string, line: int, passage: string>>, "
    "facts array<struct<id: string, predicate: string, object_kind: string, object: string, valid_from: bigint, valid_to: bigint, recorded_at: bigint, superseded_at: bigint, "
    "by: string, trust: string, conf: double, src: string, status: string, line: int>>, "
    "problems array<struct<severity: string, path: string, line: int, code: string, message: string>>"
)


def parse_all(rows: Iterator[tuple[str, str, int]], vault: Vault) -> Iterator[dict]:
    for path, text, mtime in rows:
        yield parse(path, text, mtime, vault)
