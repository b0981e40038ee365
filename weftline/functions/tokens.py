"""Token arrays and set comparisons as built-in expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .unicode import fold

#: Words that carry no identity in a name; fixed values.
NAME_NOISE = (
    "llc inc incorporated corp corporation co company ltd limited pvt private plc lp llp pllc pc pa sarl sas sasu sa "
    "eurl sci snc selarl gmbh opc the and of m s dba doing business as www com net org in fr dr mr mrs ms shri sri smt "
    "et de du des la le les l d"
).split()
#: Words that locate nothing in an address; fixed values.
ADDRESS_NOISE = (
    "unit apt apartment suite ste no number h hno door po box near nr opp opposite behind floor flr ground first second "
    "n a null na nan none c o the and of at de du des la le"
).split()
#: Street words by their short spellings; fixed values.
STREET_WORDS = {
    "st": "street", "str": "street", "rd": "road", "ave": "avenue", "av": "avenue", "dr": "drive", "ln": "lane",
    "ct": "court", "blvd": "boulevard", "bd": "boulevard", "pl": "place", "pkwy": "parkway", "hwy": "highway",
    "cir": "circle", "trl": "trail", "ter": "terrace", "sq": "square", "pt": "point", "mt": "mount", "ft": "fort",
    "cres": "crescent", "hts": "heights", "rte": "route", "expy": "expressway", "fwy": "freeway", "tpke": "turnpike",
    "aly": "alley", "xing": "crossing", "cv": "cove", "pky": "parkway", "n": "north", "s": "south", "e": "east",
    "w": "west", "ne": "northeast", "nw": "northwest", "se": "southeast", "sw": "southwest", "r": "rue",
    "bis": "bis", "nagar": "nagar", "marg": "marg",
}


def literal_array(words: Iterable[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def literal_map(pairs: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in sorted(pairs.items()) for x in kv]) if pairs else F.expr("cast(map() as map<string,string>)")


def words(folded: Column) -> Column:
    return F.filter(F.split(folded, " "), lambda x: x != "")


def tokens(c: Column) -> Column:
    return words(fold(c))


def token_set(t: Column) -> Column:
    return F.array_sort(F.array_distinct(t))


def sorted_key(t: Column) -> Column:
    return F.array_join(token_set(t), " ")


def shared_words(a: Column, b: Column) -> Column:
    """The distinct words that two texts have in common, as a review marks them."""
    return F.array_intersect(tokens(a), tokens(b))


def acronym(t: Column) -> Column:
    return F.array_join(F.transform(t, lambda x: F.substring(x, 1, 1)), "")


def char_ngrams(folded: Column, n: int = 3) -> Column:
    """Distinct n-grams of the text between two spaces."""
    padded = F.concat(F.lit(" "), folded, F.lit(" "))
    at = F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1)))
    return F.array_distinct(F.transform(at, lambda i: F.substr(padded, i, F.lit(n))))


def number_runs(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?U)(\d+)"))


def house_numbers(c: Column) -> Column:
    """Digit runs without leading zeros."""
    return F.transform(number_runs(c), lambda x: F.coalesce(F.nullif(F.regexp_replace(x, "^0+", ""), F.lit("")), F.lit("0")))


def without(t: Column, stop: Iterable[str]) -> Column:
    """Drops the words of a list; unlike array_except it keeps repeats and order."""
    listed = literal_array(stop)
    return F.filter(t, lambda x: ~F.array_contains(listed, x))


def replaced(t: Column, table: Mapping[str, str]) -> Column:
    m = literal_map(table)
    return F.transform(t, lambda x: F.coalesce(F.element_at(m, x), x))


def strip_tail(t: Column, tail: Iterable[str]) -> Column:
    """Drops listed words from the end, but never the whole name."""
    listed = literal_array(tail)
    last = F.array_max(F.transform(t, lambda x, i: F.when(F.array_contains(listed, x), F.lit(0)).otherwise(i + 1)))
    return F.when(F.size(t) == 0, t).otherwise(F.slice(t, F.lit(1), F.greatest(F.lit(1), last)))


def identity_words(t: Column, tail: Iterable[str]) -> Column:
    """The words that aren't listed anywhere, or else the name without its tail."""
    own = without(t, tail)
    return F.when(F.size(own) > 0, own).otherwise(strip_tail(t, tail))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def is_abbreviation(short: Column, long: Column) -> Column:
    """Whether the letters of ``short`` stand in ``long`` in order, the first at its start."""
    pattern = F.concat(F.lit("^"), F.array_join(F.filter(F.split(short, ""), lambda x: x != ""), ".*"))
    digits = short.rlike(r"(?U)^\d+$") | long.rlike(r"(?U)^\d+$")
    plain = short.rlike(r"(?U)^\w+$")
    return plain & (F.length(short) < F.length(long)) & ~digits & F.regexp_like(long, pattern)


def side_state(a: Column, b: Column) -> Column:
    """0: both missing, 1: one missing, 2: equal, 3: in conflict."""
    return F.when((a == "") & (b == ""), 0).when((a == "") | (b == ""), 1).when(a == b, 2).otherwise(3)


def legal_match(a: Column, b: Column) -> Column:
    """-1 without a side, 1 for equal sets, 0.9 if one word abbreviates the other side's words, else Jaccard."""
    def shortens(x: Column, y: Column) -> Column:
        return (F.size(x) == 1) & is_abbreviation(F.element_at(x, 1), F.array_join(y, ""))

    return (
        F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(-1.0))
        .when(token_set(a) == token_set(b), F.lit(1.0))
        .when(shortens(a, b) | shortens(b, a), F.lit(0.9))
        .otherwise(jaccard(a, b))
    )


def unordered_pairs(t: Column) -> Column:
    """All pairs a < b of a word set, as structs."""
    s = token_set(t)
    return F.flatten(F.transform(s, lambda a: F.transform(F.filter(s, lambda b: a < b), lambda b: F.struct(a.alias("a"), b.alias("b")))))
