"""Scalar functions whose behaviour differs from Spark's own, and those that it lacks, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(a: Column, b: Column) -> Column:
    """Truncating division of whole numbers; division by zero is an error."""
    return F.when(b == 0, F.raise_error(F.lit("division by zero"))).otherwise(F.call_function("div", a, b))


def power(a: Column, b: Column) -> Column:
    """Errors where the result isn't a real number, rather than infinity or NaN."""
    bad = ((a == 0) & (b < 0)) | ((a < 0) & (b != F.floor(b)))
    return F.when(bad, F.raise_error(F.lit("invalid argument for power function"))).otherwise(F.pow(a, b))


def ln(x: Column) -> Column:
    return F.when(x <= 0, F.raise_error(F.lit("cannot take logarithm of zero or a negative number"))).otherwise(F.ln(x))


def sqrt(x: Column) -> Column:
    return F.when(x < 0, F.raise_error(F.lit("cannot take square root of a negative number"))).otherwise(F.sqrt(x))


def round_float(x: Column) -> Column:
    return F.rint(x)


def to_int(x: Column) -> Column:
    return F.rint(x).cast("int")


def trunc(x: Column) -> Column:
    return F.signum(x) * F.floor(F.abs(x))


def xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def cbrt(x: Column) -> Column:
    return F.cbrt(x)


def days_between(a: Column, b: Column) -> Column:
    return F.datediff(a, b)


def dow(x: Column) -> Column:
    """Sunday is 0."""
    return F.dayofweek(x) - 1


def array_agg(x: Column) -> Column:
    """Keeps nulls."""
    return F.transform(F.collect_list(F.struct(x.alias("x"))), lambda s: s.x)


def regexp_replace_first(s: Column, pattern: str, to: str) -> Column:
    """Only the first match, as without the flag g; \\1 to \\9 are groups."""
    at, hit = F.regexp_instr(s, F.lit(pattern)), F.regexp_substr(s, F.lit(pattern))
    changed = F.regexp_replace(hit, pattern, re.sub(r"\\(\d)", r"$\1", to))
    return F.when(at > 0, F.concat(F.substring(s, F.lit(1), at - 1), changed, F.substring(s, at + F.length(hit), F.length(s)))).otherwise(s)


def similar_pattern(pattern: str) -> str:
    """A SIMILAR TO pattern as a Java regular expression for the whole string."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out.append(re.escape(pattern[i + 1]))
            i += 1
        elif c == "%":
            out.append(".*")
        elif c == "_":
            out.append(".")
        elif c in ".^$":
            out.append("\\" + c)
        else:
            out.append(c)
        i += 1
    return "(?s)^(?:" + "".join(out) + ")$"


def similar_to(s: Column, pattern: str) -> Column:
    return s.rlike(similar_pattern(pattern))


def bpchar_eq(a: Column, b: Column) -> Column:
    """char(n) values are equal up to trailing blanks."""
    return F.rtrim(a) == F.rtrim(b)


def width_bucket(x: Column, low: float, high: float, count: int) -> Column:
    return F.when(x < low, 0).when(x >= high, count + 1).otherwise(F.floor((x - low) / (high - low) * count) + 1).cast("long")


def trigrams(s: Column) -> Column:
    """Distinct trigrams of the lower-case words, each with two blanks before and one after."""
    padded = F.transform(words(s), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams by all trigrams."""
    x, y = trigrams(a), trigrams(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / union)


def hstore_concat(a: Column, b: Column) -> Column:
    """The right side wins."""
    return F.map_from_entries(F.concat(F.filter(F.map_entries(a), lambda e: ~F.map_contains_key(b, e.key)), F.map_entries(b)))


def hstore_delete(m: Column, key: Column) -> Column:
    return F.map_filter(m, lambda k, v: k != key)


def ltree_is_ancestor(a: Column, b: Column) -> Column:
    """Whether label path a is b or above it."""
    return (a == b) | F.startswith(b, F.concat(a, F.lit("."))) | (a == "")


def ltree_nlevel(a: Column) -> Column:
    return F.when(a == "", 0).otherwise(F.size(F.split(a, r"\.")))


def ltree_subpath(a: Column, offset: int, length: int) -> Column:
    return F.array_join(F.slice(F.split(a, r"\."), offset + 1, length), ".")


def words(s: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.filter(F.split(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def lexemes(s: Column, stop: tuple[str, ...] = ()) -> Column:
    """array<struct<lexeme, positions>>: lower-case words with their places, sorted."""
    placed = F.transform(words(s), lambda w, i: F.struct(w.alias("lexeme"), (i + 1).alias("pos")))
    kept = F.filter(placed, lambda p: ~p.lexeme.isin(*stop)) if stop else placed
    names = F.array_sort(F.array_distinct(F.transform(kept, lambda p: p.lexeme)))
    return F.transform(names, lambda n: F.struct(n.alias("lexeme"), F.transform(F.filter(kept, lambda p: p.lexeme == n), lambda p: p.pos).alias("positions")))


def matches(s: Column, query: str) -> Column:
    """Full-text match: words with & | ! and parentheses."""
    names = F.array_distinct(words(s))
    return boolean_query(query, lambda w: F.array_contains(names, w.lower()))


def boolean_query(query: str, leaf: Callable[[str], Column]) -> Column:
    """Terms with & | ! and parentheses, compiled on the driver; leaf gives a term's condition."""
    parts = re.findall(r"[&|!()]|[^\s&|!()]+", query)
    at = 0

    def disjunction() -> Column:
        nonlocal at
        out = conjunction()
        while at < len(parts) and parts[at] == "|":
            at += 1
            out = out | conjunction()
        return out

    def conjunction() -> Column:
        nonlocal at
        out = factor()
        while at < len(parts) and parts[at] == "&":
            at += 1
            out = out & factor()
        return out

    def factor() -> Column:
        nonlocal at
        if at >= len(parts):
            raise ValueError(f"syntax error in query: {query}")
        p = parts[at]
        at += 1
        if p == "!":
            return ~factor()
        if p == "(":
            out = disjunction()
            if at >= len(parts) or parts[at] != ")":
                raise ValueError(f"syntax error in query: {query}")
            at += 1
            return out
        if p in "&|)":
            raise ValueError(f"syntax error in query: {query}")
        return leaf(p)

    out = disjunction()
    if at != len(parts):
        raise ValueError(f"syntax error in query: {query}")
    return out


def any_op(x: Column, array: Column, op) -> Column:
    return F.exists(array, lambda e: op(x, e))


def all_op(x: Column, array: Column, op) -> Column:
    return F.forall(array, lambda e: op(x, e))


def xml_text(x: Column) -> Column:
    """A value as XML content: markup escaped; null stays null."""
    s = F.replace(F.replace(F.replace(x.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(s, F.lit("\r"), F.lit("&#x0d;"))


def xml_element(name: str, attributes: dict[str, Column] | None = None, *content: Column) -> Column:
    """An element with attributes, null ones left out, around content that is XML already; without content it is
    an empty tag."""
    head = [F.coalesce(F.concat(F.lit(f' {k}="'), F.replace(xml_text(v), F.lit('"'), F.lit("&quot;")), F.lit('"')), F.lit("")) for k, v in (attributes or {}).items()]
    body = F.concat_ws("", *content) if content else F.lit("")
    start = F.concat(F.lit(f"<{name}"), *head)
    return F.when(body == "", F.concat(start, F.lit("/>"))).otherwise(F.concat(start, F.lit(">"), body, F.lit(f"</{name}>")))


def xml_forest(**values: Column) -> Column:
    """An element for each value that isn't null."""
    parts = [F.when(v.isNotNull(), F.concat(F.lit(f"<{k}>"), xml_text(v), F.lit(f"</{k}>"))) for k, v in values.items()]
    return F.concat_ws("", *parts)


def split_part(s: Column, delimiter: str, n: int) -> Column:
    """Field n from 1, empty beyond the last one; n must be positive."""
    if n < 1:
        raise ValueError("field position must be greater than zero")
    return F.split_part(s, F.lit(delimiter), F.lit(n))
