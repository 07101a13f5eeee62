"""Text expressions: tokens, stems, names, hashes, links and periods, all in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no content.
STOP_WORDS = "a an and are as at be by for from has have how i in is it its of on or that the this to was what when where which who why will with".split(" ")
# Suffixes of the light stem, tried in this order.
SUFFIXES = ("ing", "ed", "er", "es", "s")

#: Runs of two and more letters, digits and underscores that are no stop word: one pattern, so that no lambda runs for each token.
TOKEN = rf"(?<![\p{{L}}\p{{N}}_])(?!(?:{'|'.join(STOP_WORDS)})(?![\p{{L}}\p{{N}}_]))[\p{{L}}\p{{N}}_]{{2,}}+"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores, without single characters and stop words."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def light_stem(word: Column) -> Column:
    """word without the first suffix that fits and leaves two characters or more."""
    out = F
    for s in SUFFIXES:
        fits = (F.length(word) > len(s) + 1) & word.endswith(s)
        cut = F.substr(word, F.lit(1), F.length(word) - len(s))
        out = out.when(fits, cut)
    return out.otherwise(word)


def with_stems(list_of_words: Column) -> Column:
    """Distinct words and their light stems."""
    return F.array_distinct(F.concat(list_of_words, F.transform(list_of_words, light_stem)))


def predicate_match(predicate: Column, query_words: Column) -> Column:
    """How many parts of a predicate are among the query's words and stems."""
    parts = F.regexp_extract_all(F.lower(predicate), F.lit("[a-z0-9]+"), F.lit(0))
    return F.size(F.filter(parts, lambda p: F.array_contains(query_words, p) | F.array_contains(query_words, light_stem(p))))


def name_key(name: Column) -> Column:
    return F.lower(F.trim(name))


def short_hash(*parts: Column, n: int = 10) -> Column:
    """The first n hex digits of the SHA-256 of the parts, joined by NUL; a null part is the word null."""
    joined = F.concat_ws("\u0000", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.substring(F.sha2(joined, 256), 1, n)


def token_cost(text: Column) -> Column:
    """A passage's cost: a token for every four characters."""
    return F.ceil(F.length(text) / F.lit(4)).cast("long")


def squeezed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def wikilinks(text: Column) -> Column:
    """The insides of [[links]]."""
    return F.regexp_extract_all(text, F.lit(r"\[\[([^\[\]\n]+?)\]\]"), F.lit(1))


def link_target(inside: Column) -> Column:
    """The note that a link's inside names: without alias, heading, folders and file ending."""
    target = F.trim(F.regexp_extract(inside, r"^([^|#]*)", 1))
    base = F.regexp_extract(target, r"([^/]*)$", 1)
    return F.regexp_replace(base, r"(?i)\.md$", "")


def glob_pattern(glob: str) -> str:
    """A glob (**, *, ?) as a regular expression over whole paths."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            c = glob[i]
            out.append({"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if c in r".+^${}()|[]\\" else c))
            i += 1
    return "^" + "".join(out) + "$"


def period(raw: Column) -> Column:
    """A named period as struct (start, stop) of epoch milliseconds: a year, a month, a day, or an instant; null if malformed."""
    s = F.trim(raw)
    ms = lambda t: F.unix_millis(t.cast("timestamp"))
    day = F.when(s.rlike(r"^\d{4}$"), F.concat(s, F.lit("-01-01"))).when(s.rlike(r"^\d{4}-\d{2}$"), F.concat(s, F.lit("-01"))).when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), s)
    start = F.try_to_timestamp(day, F.lit("yyyy-MM-dd"))
    stop = F.when(F.length(s) == 4, F.add_months(start, 12)).when(F.length(s) == 7, F.add_months(start, 1)).when(F.length(s) == 10, F.date_add(start, 1))
    exact = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}T"), F.try_to_timestamp(s))
    return F.when(start.isNotNull(), F.struct(ms(start).alias("start"), ms(stop).alias("stop"))).when(exact.isNotNull(), F.struct(ms(exact).alias("start"), (ms(exact) + 1).alias("stop")))


def fenced(text: Column) -> Column:
    """Text with fences that would close a quoting fence taken apart."""
    return F.regexp_replace(text, "(?m)^(\\s*)(```|~~~)", "$1​$2")
