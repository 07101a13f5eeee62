r"""Sanitising personal data by what terms disclose about it, in DataFrame functions only.

Base: e-mail addresses, IPv4 addresses, payment cards and telephone numbers are found by pattern, leftmost
and without overlap for each kind, and checked (parts up to 255, Luhn, digits); a failing match is dropped.
Positions come from cutting the text at the same pattern: what lies before a match is as long as the
pieces and matches before it. The patterns start only where no character of the same run precedes, and
their runs give nothing back, so a long run costs its length and not its square.

Method (information-theoretic sanitising, after Sanchez and Batet 2016): protected entities e are the found values
and their owners (an address' domain, the first three parts of an ip, a card's issuer, a telephone's number but
for its last four digits), so that a value of a single text is judged by its owner's texts. The corpus tells how
much a term t near e discloses:

    IC(e) = log2(N / c(e)),   PMI(t; e) = log2(N c(t, e) / ((c(t) + UNSEEN) c(e))),   disclosure = PMI / IC

with c(e) the distinct texts with e, c(t, e) those that hold t too, anywhere, c(t) all with t and N all there
are, so copies of a text count once everywhere. Near 1 the term gives the entity away whenever it occurs;
UNSEEN stands for an occurrence elsewhere that the corpus doesn't show, so that one meeting says less than
many. One meeting is no evidence, whatever N: a term needs MET texts with the entity, and a share c(t, e) / c(t) of
surely NEAR or more (the lower end of Wilson's interval at SURE_Z). Terms that stand outside values and have a
disclosure of GENERALISE or more are replaced by their kind of word, from REMOVE on they are removed: in every text
with found values, and in other texts if the share is surely SURE or more.

Only texts with found values emit pairs; values found in the same texts disclose alike and make one pair with a
term. The corpus is read once for words: those of telling candidates are sieved by a bitmap of fixed size (a chance
hit only adds a row), and what is left, a row for a text and a candidate, gives both c(t) over distinct texts and
the texts to change. Texts themselves move only if the texts to change outgrow Spark's broadcast limit; a text that
many rows share is salted there.

Defined results: null is the empty text and stays null in the sanitised column; rows with the same text
are one text in counts and are returned each; a null id is an id like any other; overlapping spans are
all listed, and the sanitised text takes the first; an empty table gives an empty table; extra columns pass
through, and result columns that clash take a free name.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, written

#: The kinds in their order. Possessive runs (++) after a look-behind: the same matches as the plain
#: patterns, since what follows a run can't be in it; \G keeps the place right after a match open.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
TERM_KIND = "term"

TERM = r"(?<![\p{L}\p{N}])\p{L}[\p{L}\p{N}]+(?![\p{L}\p{N}])"
UNSEEN = 1
MET = 2
NEAR, SURE, SURE_Z = 1 / 3, 0.5, 1.2816  # one-sided 90 %
GENERALISE, REMOVE = 0.9, 0.97

#: Bits of the candidates' sieve, whatever their number: beyond millions of candidates it lets more through, to the same result.
SIEVE_BITS = 1 << 22
BITMAP_BITS = 8 * 4096  # of one bitmap_construct_agg
#: Rows of one text that meet its terms in one task.
SALT_ROWS = 100_000

SPANS = "array<struct<start:int,stop:int>>"


def luhn(digits: Column) -> Column:
    """Whether the digits' Luhn sum ends in 0."""

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def spans_of(text: Column, pattern: Column | str, matches: Column, ok) -> Column:
    """Start and end of the matches that are ok, in code points."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
    each = F.zip_with(pieces, matches, lambda p, m: F.struct(p.alias("p"), m.alias("m")))

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + F.length(x["p"])
        stop = start + F.length(x["m"])
        return F.struct(stop.alias("at"), F.when(ok(x["m"]), F.concat(done["spans"], F.array(F.struct(start.alias("start"), stop.alias("stop"))))).otherwise(done["spans"]).alias("spans"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))
    return F.when(F.size(matches) > 0, F.aggregate(each, begin, step, lambda d: d["spans"])).otherwise(F.array().cast(SPANS))


def find_base(rows: DataFrame) -> DataFrame:
    """rows (with _text) with an array of spans for each kind: _email, _ip, _card, _phone."""
    out = rows
    maybe = {"email": F.instr("_text", "@") > 0, "ip": F.instr("_text", ".") > 0, "card": F.lit(True), "phone": F.instr("_text", "+") > 0}
    hit = lambda k: F.when(maybe[k], F.regexp_extract_all("_text", F.lit(PATTERNS[k]), F.lit(0))).otherwise(F.array().cast("array<string>"))
    out = out.select("*", *[hit(k).alias(f"_m_{k}") for k in PATTERNS])
    return out.select(*[c for c in out.columns if not c.startswith("_m_")], *[spans_of(F.col("_text"), p, F.col(f"_m_{k}"), lambda m, k=k: valid(k, m)).alias(f"_{k}") for k, p in PATTERNS.items()])


def tagged(kind: str, order: int, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["stop"].alias("stop"), F.lit(kind).alias("kind")))


def written_out(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def base_spans() -> Column:
    return F.array_sort(F.concat(*[tagged(k, i, F.col(f"_{k}")) for i, k in enumerate(PATTERNS)]))


def entities_of(found: DataFrame) -> DataFrame:
    """_key, entity, of_entity (c(e)): the values and owners of each text that MET texts hold, those of the same texts as one. found has _key, _text, _spans."""

    def held_by(s: Column) -> Column:
        said = F.lower(F.substr("_text", s["start"] + 1, s["stop"] - s["start"]))
        digits = F.regexp_replace(said, "[^0-9]", "")
        value = F.when(s["kind"].isin("card", "phone"), digits).otherwise(said)
        owner = (
            F.when(s["kind"] == "email", F.substring_index(said, "@", -1))
            .when(s["kind"] == "ip", F.substring_index(said, ".", 3))
            .when(s["kind"] == "card", F.substr(digits, F.lit(1), F.lit(6)))
            .otherwise(F.substr(digits, F.lit(1), F.length(digits) - 4))
        )
        return F.array(F.xxhash64(s["kind"], value), F.xxhash64(s["kind"], F.lit("owner"), owner))

    held = written(found.select("_key", F.explode(F.array_distinct(F.flatten(F.transform("_spans", held_by)))).alias("value")), "values")
    # The same texts: as many, with the same sums of two hashes.
    texts = held.groupBy("value").agg(F.count(F.lit(1)).alias("of_entity"), F.bit_xor("_key").alias("x"), F.bit_xor(F.xxhash64("_key")).alias("y")).filter(F.col("of_entity") >= MET)
    return written(held.join(texts.select("value", "of_entity", F.xxhash64("of_entity", "x", "y").alias("entity")), "value").select("_key", "entity", "of_entity").distinct(), "entities")


def outside() -> Column:
    """_text with a space for each of _spans."""

    def step(done: Column, s: Column) -> Column:
        piece = F.substr("_text", done["at"] + 1, F.greatest(s["start"] - done["at"], F.lit(0)))
        return F.struct(F.greatest(done["at"], s["stop"]).alias("at"), F.concat(done["out"], F.array(piece)).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate("_spans", begin, step, lambda d: F.concat(F.array_join(d["out"], " "), F.lit(" "), F.substr("_text", d["at"] + 1, F.length("_text"))))


def distinct_words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))


def words_of(found: DataFrame) -> DataFrame:
    """_key, term, whole, out: the words of each text; whole is 1 for words of the text, out for words of what is outside values."""
    marked = lambda words, whole, out: F.transform(words, lambda w: F.struct(w.alias("term"), F.lit(whole).alias("whole"), F.lit(out).alias("out")))
    both = found.select("_key", distinct_words(F.col("_text")).alias("w"), distinct_words(outside()).alias("o"))
    each = F.concat(marked(F.array_intersect("w", "o"), 1, 1), marked(F.array_except("w", "o"), 1, 0), marked(F.array_except("o", "w"), 0, 1))
    return both.select("_key", F.explode(each).alias("w")).select("_key", "w.*")


def candidate_terms(words: DataFrame, entities: DataFrame, n: int) -> DataFrame:
    """entity, term, together (c(t, e)), of_entity (c(e)) and least (texts of found with t) for pairs that can disclose enough.

    A term occurs in all texts that have it beside any value, at least; where that alone keeps its disclosure
    below the threshold, the corpus needn't be asked. So common words end here: no value discloses through a term
    with least + UNSEEN above c(e) ^ GENERALISE * N ^ (1 - GENERALISE). So do words of fewer than MET texts.
    """
    most_of = entities.agg(F.max("of_entity")).head()[0] or 0
    least = words.groupBy("term").agg(F.sum("whole").alias("least"))
    few = written(least.filter(F.col("least") >= MET).filter(F.col("least") + UNSEEN <= most_of**GENERALISE * float(n) ** (1 - GENERALISE) * (1 + 1e-9)), "few")
    may = sieve(few)
    pairs = words.filter(may(F.col("term"))).join(entities, "_key").groupBy("entity", "of_entity", "term").agg(F.sum("whole").alias("together"), F.max("out").alias("out")).filter((F.col("out") == 1) & (F.col("together") >= MET)).drop("out")
    most = disclosure(F.col("together"), F.col("least"), F.col("of_entity"), F.lit(float(n)))
    return pairs.join(few, "term").filter((most >= GENERALISE) & (least_share(F.col("together"), F.col("least")) >= NEAR))


def disclosure(together: Column, of_term: Column, of_entity: Column, n: Column) -> Column:
    """Smoothed PMI(t; e) / IC(e); 0 for an entity in every text."""
    ic = F.log2(n / of_entity)
    pmi = F.log2(n * together / ((of_term + UNSEEN) * of_entity))
    return F.when(ic > 0, F.try_divide(pmi, ic)).otherwise(0.0)


def least_share(some: Column, of: Column) -> Column:
    """The lower end of Wilson's interval of the share some / of."""
    share, z2 = some / of, SURE_Z**2
    return (share + z2 / (2 * of) - SURE_Z * F.sqrt((share * (1 - share) + z2 / (4 * of)) / of)) / (1 + z2 / of)


def quoted(term: Column) -> Column:
    return F.concat(F.lit(r"\Q"), term, F.lit(r"\E"))


def sieve(terms: DataFrame) -> Callable[[Column], Column]:
    """A test of words against a bitmap of the terms' hashes, which passes every term and few other words."""
    at = lambda term: F.pmod(F.xxhash64(term), F.lit(SIEVE_BITS))
    maps = terms.select(at(F.col("term")).alias("at")).groupBy(F.expr(f"at div {BITMAP_BITS}").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at") + 1)).alias("bits"))
    words = [0] * (SIEVE_BITS // 64)
    each = BITMAP_BITS // 64
    for n, bits in maps.collect():  # SIEVE_BITS / BITMAP_BITS rows at most
        words[n * each : (n + 1) * each] = struct.unpack(f"<{each}q", bits)
    # A constant, folded once into an array.
    held = F.from_json(F.lit(json.dumps(words)), "array<bigint>")
    return lambda term: F.call_function("shiftright", F.get(held, F.call_function("div", at(term), F.lit(64)).cast("int")), (at(term) % 64).cast("int")).bitwiseAND(F.lit(1)) == 1


def find_personal_data(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """docs with the sanitised text and the spans; also the result columns' names.

    Names: n_email, n_ip, n_card, n_phone, base_sha256, spans (base and terms') and sanitised.
    """
    # The input's other columns travel in one struct, so no name of theirs meets ours.
    whole = F.col(f"`{text}`").cast("string")
    others = [c for c in docs.columns if c.lower() != text.lower()]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row"), whole.isNull().alias("_null"), F.coalesce(whole, F.lit("")).alias("_text"))
    rows = rows.withColumn("_key", F.xxhash64("_text"))
    base = find_base(rows).withColumn("_spans", base_spans())
    n, most = rows.groupBy("_key").count().agg(F.count(F.lit(1)), F.max("count")).head()
    found = written(base.filter(F.size("_spans") > 0).select("_key", "_text", "_spans").dropDuplicates(["_key"]), "found")
    near = written(words_of(found), "words")
    candidates = written(candidate_terms(near, entities_of(found), n), "terms")

    may_tell = sieve(candidates.select("term").distinct())
    words = rows.select("_key", F.explode(F.regexp_extract_all("_text", F.lit(TERM), F.lit(0))).alias("term")).filter(may_tell(F.col("term")))
    held = written(words.distinct(), "held")
    of_term = held.groupBy("term").agg(F.count(F.lit(1)).alias("of_term"))
    share = least_share(F.col("together"), F.col("of_term"))
    told = candidates.join(of_term, "term").filter(share >= NEAR).withColumn("d", disclosure(F.col("together"), F.col("of_term"), F.col("of_entity"), F.lit(float(n)))).filter(F.col("d") >= GENERALISE)
    telling = told.groupBy("term").agg(F.max("d").alias("d"), F.max(share >= SURE).alias("everywhere"))
    telling = written(telling.select("term", (F.col("d") >= REMOVE).alias("removed"), "everywhere"), "telling")
    here = near.filter("whole = 1").select("_key", "term").join(telling, "term").drop("everywhere")
    there = held.join(telling.filter("everywhere"), "term").drop("everywhere")
    met = written(here.unionByName(there).groupBy("_key").agg(F.sort_array(F.collect_set(F.struct("term", "removed"))).alias("_telling")), "met")
    # A written table has a known size, so Spark broadcasts it if that is small, and else moves the texts.
    salts = 1 + (most or 0) // SALT_ROWS
    met = met.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    none = F.array().cast("array<struct<term:string,removed:boolean>>")
    joined = base.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")).join(met, ["_key", "_salt"], "left")
    joined = joined.withColumn("_terms", F.coalesce("_telling", none))
    # The longest alternatives need no order: terms are whole words, so at most one fits a place.
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(F.transform("_terms", lambda t: quoted(t["term"])), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    joined = joined.withColumn("_pattern", F.when(F.size("_terms") > 0, pattern))
    joined = joined.withColumn("_hits", F.when(F.col("_pattern").isNotNull(), F.regexp_extract_all("_text", F.col("_pattern"), F.lit(0))).otherwise(F.array().cast("array<string>")))
    more = F.when(F.col("_pattern").isNotNull(), spans_of(F.col("_text"), F.coalesce("_pattern", F.lit("$^")), F.col("_hits"), lambda m: F.lit(True))).otherwise(F.array().cast(SPANS))
    joined = joined.withColumn("_more", more).withColumn("_all", F.array_sort(F.concat("_spans", tagged(TERM_KIND, len(PATTERNS), F.col("_more")))))
    names = {k: free_name(docs, k) for k in (*(f"n_{k}" for k in PATTERNS), "base_sha256", "spans", "sanitised")}
    out = joined.select(
        *[F.col("_row").getField(c).alias(c) if c in others else F.when(~F.col("_null"), F.col("_text")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns],
        *[F.size(f"_{k}").cast("long").alias(names[f"n_{k}"]) for k in PATTERNS],
        F.sha2(written_out(F.col("_spans")), 256).alias(names["base_sha256"]),
        written_out(F.col("_all")).alias(names["spans"]),
        F.when(~F.col("_null"), sanitised()).alias(names["sanitised"]),
    )
    return out, names


def sanitised() -> Column:
    """_text with every span of _all replaced; where spans overlap, by the first."""
    removed = F.filter("_terms", lambda t: t["removed"])

    def stands_for(s: Column) -> Column:
        word = F.substr("_text", s["start"] + 1, s["stop"] - s["start"])
        term = F.when(F.exists(removed, lambda t: t["term"] == word), F.lit("")).when(word.rlike(r"^\p{Lu}"), F.lit("[NAME]")).otherwise(F.lit("[WORD]"))
        return F.when(s["kind"] == TERM_KIND, term).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))

    def step(done: Column, s: Column) -> Column:
        fresh = s["start"] >= done["at"]
        put = F.concat(done["out"], F.array(F.substr("_text", done["at"] + 1, s["start"] - done["at"]), stands_for(s)))
        return F.struct(F.when(fresh, s["stop"]).otherwise(F.greatest(done["at"], s["stop"])).alias("at"), F.when(fresh, put).otherwise(done["out"]).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate("_all", begin, step, lambda d: F.concat(F.array_join(d["out"], ""), F.substr("_text", d["at"] + 1, F.length("_text"))))
    return F.when(F.size("_all") > 0, done).otherwise(F.col("_text"))
