"""Line dedup with overlapping windows of three lines, in DataFrame functions only.

Lines that hold no word take no part and always stay. Every three consecutive other lines of a text form
a window, named by two 64-bit hashes over two hashes of each line. A window that occurs more than once in
the corpus keeps its first occurrence, by document id and then position; the lines that any later
occurrence covers are merged and removed.

Counting windows combines before the shuffle, so a window of a third of all rows costs one row for each
map task; the join back has one row a window on its right side, and Spark may split a hot left side. Each
text meets the lines to remove in one join on its own key.

Defined results: rows with the same id and text are one document (they never repeat each other); a null
id sorts first and is an id like any other; a null text has no lines and stays null; an empty table gives
an empty table; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

WINDOW = 3
#: At least one character other than ASCII white space.
HAS_WORD = r"[^\x20\x09-\x0D]"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows_of(docs: DataFrame, id_col: str, text: str, width: int = WINDOW) -> DataFrame:
    """id, key, h1, h2, at (the window's first line) and places (all its lines), one row a window."""
    hashed = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.xxhash64(F.col(f"`{text}`")).alias("key"),
        F.filter(
            F.transform(lines_of(F.col(f"`{text}`")), lambda x, i: F.struct(i.alias("at"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit("b"), x).alias("b"), x.rlike(HAS_WORD).alias("full"))),
            lambda s: s["full"],
        ).alias("lines"),
    ).filter(F.size("lines") >= width)

    def window(i: Column) -> Column:
        part = [F.get("lines", i + k) for k in range(width)]
        return F.struct(
            F.xxhash64(*[p["a"] for p in part]).alias("h1"),
            F.xxhash64(*[p["b"] for p in reversed(part)]).alias("h2"),
            part[0]["at"].alias("at"),
            F.array(*[p["at"] for p in part]).alias("places"),
        )

    each = hashed.select("id", "key", F.explode(F.transform(F.sequence(F.lit(0), F.size("lines") - width), window)).alias("w"))
    return each.select("id", "key", "w.h1", "w.h2", "w.at", "w.places")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """docs with the text's later lines removed, and `n_lines` and `n_removed` (renamed where they clash)."""
    found = windows_of(docs, id_col, text, width)
    first = (
        found.groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("id", "key", "at")).alias("first"))
        .filter("times > 1")
        .select("h1", "h2", "first")
    )
    later = found.join(first, ["h1", "h2"]).filter(~F.struct("id", "key", "at").eqNullSafe(F.col("first")))
    n_lines, n_removed = free_name(docs, "n_lines"), free_name(docs, "n_removed")
    own = {c: free_name(docs, c) for c in ("_gone_id", "_gone_key", "_gone", "_lines", "_stay")}
    gone = later.groupBy(F.col("id").alias(own["_gone_id"]), F.col("key").alias(own["_gone_key"])).agg(F.array_distinct(F.flatten(F.collect_set("places"))).alias(own["_gone"]))
    joined = docs.join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col(own["_gone_id"])) & (F.xxhash64(F.col(f"`{text}`")) == F.col(own["_gone_key"])), "left")
    # The lines are cut after the join: the text moves, not the text and its lines.
    stay = joined.withColumn(own["_lines"], lines_of(F.col(f"`{text}`"))).withColumn(own["_stay"], F.when(F.col(own["_gone"]).isNotNull(), F.array_except(F.sequence(F.lit(0), F.size(own["_lines"]) - 1), F.col(own["_gone"]))))
    kept = F.when(F.col(own["_gone"]).isNull(), F.col(f"`{text}`")).otherwise(F.array_join(F.transform(own["_stay"], lambda i: F.get(own["_lines"], i)), "\n"))
    return stay.select(
        *[(kept.alias(c) if c == text else F.col(f"`{c}`")) for c in docs.columns],
        F.when(F.col(f"`{text}`").isNull(), 0).otherwise(F.size(own["_lines"])).cast("long").alias(n_lines),
        F.when(F.col(own["_gone"]).isNull(), 0).otherwise(F.size(own["_gone"])).cast("long").alias(n_removed),
    )


#: The same rows from whole lines instead of hashes.
ORACLE = r"""
WITH lines AS (
  SELECT doc_id, text, u.line AS line, u.at AS pos FROM (
    SELECT doc_id, text, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'line': x, 'at': i - 1})) AS u FROM documents WHERE text IS NOT NULL)
), filled AS (
  SELECT doc_id, line, pos FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), runs AS (
  SELECT doc_id, pos AS a0, lead(pos) OVER o AS a1, lead(pos, 2) OVER o AS a2, line AS l0, lead(line) OVER o AS l1, lead(line, 2) OVER o AS l2
  FROM filled WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), ranked AS (
  SELECT doc_id, a0, a1, a2, row_number() OVER (PARTITION BY l0, l1, l2 ORDER BY doc_id, a0) AS nth FROM runs WHERE l2 IS NOT NULL
), gone AS (
  SELECT doc_id, unnest([a0, a1, a2]) AS pos FROM ranked WHERE nth > 1
), cut AS (SELECT DISTINCT doc_id, pos FROM gone),
kept AS (
  SELECT l.doc_id, string_agg(CASE WHEN c.pos IS NULL THEN l.line END, chr(10) ORDER BY l.pos) AS text, count(*) AS n_lines, count(c.pos) AS n_removed
  FROM lines l LEFT JOIN cut c ON l.doc_id = c.doc_id AND l.pos = c.pos GROUP BY l.doc_id
)
SELECT doc_id, n_lines, n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM kept
"""
