"""Bit strings, network addresses, identifiers, encodings, quoting and patterns, over string columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions import compat


def bits(x: Column, n: int) -> Column:
    """The last n bits of a whole number as a string of 0 and 1."""
    return F.substring(F.lpad(F.bin(x.cast("long")), 64, "0"), 65 - n, n)


def _each(a: Column, b: Column, op) -> Column:
    one = lambda x: F.split(x, "")
    told = F.array_join(F.zip_with(one(a), one(b), lambda x, y: F.when(op(x == "1", y == "1"), "1").otherwise("0")), "")
    return F.when(F.length(a) != F.length(b), F.raise_error(F.lit("bit strings of different sizes"))).otherwise(told)


def bit_and(a: Column, b: Column) -> Column:
    return _each(a, b, lambda x, y: x & y)


def bit_or(a: Column, b: Column) -> Column:
    return _each(a, b, lambda x, y: x | y)


def bit_xor(a: Column, b: Column) -> Column:
    return _each(a, b, lambda x, y: x != y)


def bit_not(a: Column) -> Column:
    return F.translate(a, "01", "10")


def bit_shift(a: Column, n: int) -> Column:
    """To the left for n above 0, else to the right; zeros come in."""
    zeros = F.lit("0" * abs(n))
    return F.substr(F.concat(a, zeros), F.lit(n + 1), F.length(a)) if n >= 0 else F.substr(F.concat(zeros, a), F.lit(1), F.length(a))


def bit_int(a: Column) -> Column:
    return F.conv(a, 2, 10).cast("long")


def _octets(address: Column) -> Column:
    parts = F.split(F.split_part(address, F.lit("/"), F.lit(1)), r"\.")
    return sum((F.coalesce(F.try_element_at(parts, F.lit(i + 1)), F.lit("0")).cast("long") * (1 << (24 - 8 * i)) for i in range(1, 4)), F.element_at(parts, 1).cast("long") * (1 << 24))


def _dotted(n: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(n, 24 - 8 * i).bitwiseAND(255).cast("string") for i in range(4)])


def host(address: Column) -> Column:
    return F.split_part(address, F.lit("/"), F.lit(1))


def masklen(address: Column) -> Column:
    """32 without a mask."""
    return F.when(address.contains("/"), F.nullif(F.split_part(address, F.lit("/"), F.lit(2)), F.lit("")).cast("int")).otherwise(32)


def _mask(address: Column) -> Column:
    return F.lit((1 << 32) - 1) - (F.pow(F.lit(2.0), 32 - masklen(address)).cast("long") - 1)


def netmask(address: Column) -> Column:
    return _dotted(_mask(address))


def network(address: Column) -> Column:
    return F.concat(_dotted(_octets(address).bitwiseAND(_mask(address))), F.lit("/"), masklen(address).cast("string"))


def broadcast(address: Column) -> Column:
    low = F.lit((1 << 32) - 1) - _mask(address)
    return F.concat(_dotted(_octets(address).bitwiseOR(low)), F.lit("/"), masklen(address).cast("string"))


def contained_or_equal(a: Column, b: Column) -> Column:
    """Whether network a lies in network b."""
    return (masklen(a) >= masklen(b)) & (_octets(a).bitwiseAND(_mask(b)) == _octets(b).bitwiseAND(_mask(b)))


def contained(a: Column, b: Column) -> Column:
    return contained_or_equal(a, b) & (masklen(a) > masklen(b))


def address_order(a: Column) -> Column:
    """What addresses sort by: network, mask, address."""
    return F.struct(_octets(a).bitwiseAND(_mask(a)), masklen(a), _octets(a))


def uuid(s: Column) -> Column:
    """An identifier in any accepted spelling, in the usual one; an error for others."""
    plain = F.lower(F.regexp_replace(s, r"^\{|\}$|-", ""))
    usual = F.regexp_replace(plain, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(plain.rlike("^[0-9a-f]{32}$"), usual).when(s.isNotNull(), F.raise_error(F.concat(F.lit("invalid identifier "), s)))


def encode(b: Column, form: str) -> Column:
    """Bytes as text: hex, base64 (lines of 76) or escape (octal for what isn't printable)."""
    if form == "hex":
        return F.lower(F.hex(b))
    if form == "base64":
        return F.regexp_replace(F.regexp_replace(F.base64(b), r"\s", ""), r"(.{76})(?=.)", "$1\n")
    if form != "escape":
        raise ValueError(f"unrecognized encoding: {form}")
    pairs = F.regexp_extract_all(F.hex(b), F.lit("(..)"), F.lit(1))

    def told(x: Column) -> Column:
        n = F.conv(x, 16, 10).cast("int")
        octal = F.concat(F.lit("\\"), F.lpad(F.conv(x, 16, 8), 3, "0"))
        return F.when(x == "5C", F.lit("\\\\")).when((n == 0) | (n >= 128), octal).otherwise(F.decode(F.unhex(x), "ISO-8859-1"))

    return F.array_join(F.transform(pairs, told), "")


def decode(s: Column, form: str) -> Column:
    if form not in ("hex", "base64"):
        raise ValueError(f"unrecognized encoding: {form}")
    return F.unhex(s) if form == "hex" else F.unbase64(s)


def convert(b: Column, source: str, target: str) -> Column:
    """Bytes from one character set to another."""
    return F.encode(F.decode(b, source), target)


def quote_literal(s: Column) -> Column:
    body = F.replace(F.replace(s, F.lit("'"), F.lit("''")), F.lit("\\"), F.lit("\\\\"))
    return F.concat(F.when(s.contains("\\"), "E'").otherwise("'"), body, F.lit("'"))


def quote_nullable(s: Column) -> Column:
    return F.coalesce(quote_literal(s), F.lit("NULL"))


def quote_ident(s: Column) -> Column:
    """Quoted unless it is a plain lower-case name."""
    return F.when(s.rlike("^[a-z_][a-z0-9_]*$"), s).otherwise(F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"')))


def initcap(s: Column) -> Column:
    """Words are runs of letters and digits, whatever stands between them."""
    cuts = F.regexp_extract_all(F.lower(s), F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1))
    return F.array_join(F.transform(cuts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")


def to_hex(n: Column) -> Column:
    return F.lower(F.hex(n))


def regexp_matches(s: Column, pattern: str, every: bool = False) -> Column:
    """array<array<string>>: the groups of each match, or the whole match if there are none; the first one only unless
    `every`. No rows come from it where nothing matches, as exploding gives."""
    groups = re.compile(pattern).groups
    found = F.regexp_extract_all(s, F.lit(pattern if groups else f"({pattern})"), F.lit(0))
    each = F.transform(found, lambda m: F.array(*[F.regexp_extract(m, pattern, g) for g in range(1, groups + 1)]) if groups else F.array(m))
    return each if every else F.slice(each, 1, 1)


def soundex(s: Column) -> Column:
    return F.soundex(F.upper(s))


def difference(a: Column, b: Column) -> Column:
    """How many of the four signs of two soundex codes agree."""
    x, y = soundex(a), soundex(b)
    return sum((F.when(F.substring(x, i, 1) == F.substring(y, i, 1), 1).otherwise(0) for i in range(2, 5)), F.when(F.substring(x, 1, 1) == F.substring(y, 1, 1), 1).otherwise(0))


def is_of(x: Column, *types: str) -> Column:
    """Whether x is of one of the types."""
    return F.typeof(x).isin(*types)


def text_rank(s: Column, words: list[str]) -> Column:
    """Rank of a text for a query that asks for any of the words: their places count less each, by the square of
    their number; a word's sum is set against that of endless places."""
    said = compat.words(s)

    def one(word: str) -> Column:
        places = F.size(F.filter(said, lambda w: w == word))
        return F.aggregate(F.sequence(F.lit(0), places), F.lit(0.0), lambda a, k: a + F.when(k > 0, 0.1 / (k * k)).otherwise(0.0)) / 1.64493406685

    return sum((one(w.lower()) for w in words[1:]), one(words[0].lower())) / len(words)


def headline(s: Column, words: list[str], start: str = "<b>", stop: str = "</b>") -> Column:
    """The text with the words marked, whatever their case."""
    names = "|".join(re.escape(w) for w in words)
    return F.regexp_replace(s, rf"(?iu)(?<![\p{{L}}\p{{N}}])({names})(?![\p{{L}}\p{{N}}])", f"{start}$1{stop}")
