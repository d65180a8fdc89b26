"""Functions of the usual extensions as column expressions: whole-number arrays, keyed texts, label paths, product
numbers, digests, identifiers from names, XML and search dictionaries."""

from __future__ import annotations

import hashlib
import re
import uuid as identifiers

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions import compat

# ---- whole-number arrays


def uniq(a: Column) -> Column:
    """Without neighbours that are equal; null for null."""
    return F.filter(a, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(a, i - 1)))


def subarray(a: Column, start: int, length: int | None = None) -> Column:
    """From 1; a negative start counts from the end, a negative length leaves that many off it."""
    n = F.size(a)
    begin = F.lit(start - 1) if start > 0 else F.greatest(n + start, F.lit(0)) if start else F.lit(0)
    end = n if length is None else n + length if length < 0 else begin + length
    return F.filter(a, lambda x, i: (i >= begin) & (i < end))


def int_matches(a: Column, query: str) -> Column:
    """Whether an array satisfies a query of whole numbers with & | ! and parentheses."""
    return compat.boolean_query(query, lambda x: F.array_contains(a, int(x)))


# ---- keyed texts


def hstore(s: Column) -> Column:
    """map<string,string> of the text form `"a"=>"1", b=>NULL`; the first of equal keys stays."""
    pair = r'("(?:[^"\\]|\\.)*"|[^\s,="]+)\s*=>\s*("(?:[^"\\]|\\.)*"|[^\s,="]+)'
    side = lambda x: F.when(x.startswith('"'), F.regexp_replace(F.substr(x, F.lit(2), F.length(x) - 2), r"\\(.)", "$1")).otherwise(x)
    pairs = F.arrays_zip(F.regexp_extract_all(s, F.lit(pair), F.lit(1)).alias("k"), F.regexp_extract_all(s, F.lit(pair), F.lit(2)).alias("v"))
    entries = F.transform(pairs, lambda p: F.struct(side(p.k).alias("key"), F.when(F.upper(p.v) != "NULL", side(p.v)).alias("value")))
    return F.map_from_entries(F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, F.lit(1), i), lambda x: x.key == e.key)))


def hstore_text(m: Column) -> Column:
    """The text form, keys in order."""
    quoted = lambda x: F.concat(F.lit('"'), F.regexp_replace(x, r'(["\\])', r"\\$1"), F.lit('"'))
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(quoted(e.key), F.lit("=>"), F.coalesce(quoted(e.value), F.lit("NULL")))), ", ")


def hstore_defined(m: Column, key: Column) -> Column:
    return F.map_contains_key(m, key) & F.element_at(m, key).isNotNull()


def hstore_contains(a: Column, b: Column) -> Column:
    """Whether a has every pair of b."""
    return F.forall(F.map_entries(b), lambda e: F.map_contains_key(a, e.key) & F.element_at(a, e.key).eqNullSafe(e.value))


# ---- label paths


def ltree_index(a: Column, b: Column) -> Column:
    """Where path b begins in path a, from 0; -1 if nowhere."""
    x, y = F.split(a, r"\."), F.split(b, r"\.")
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(x) - F.size(y), F.lit(0))), lambda i: F.slice(x, i + 1, F.size(y)) == y)
    return F.coalesce(F.get(places, F.lit(0)), F.lit(-1))


def ltree_lca(*paths: Column) -> Column:
    """The longest path above all of them; one that lies above the others gives its parent."""
    labels = [F.split(p, r"\.") for p in paths]
    most = F.least(*[F.size(x) - 1 for x in labels]) if len(paths) > 1 else F.size(labels[0]) - 1
    alike = F.filter(F.sequence(F.lit(0), most), lambda n: F.forall(F.array(*[F.slice(x, F.lit(1), n) for x in labels]), lambda p: p == F.slice(labels[0], F.lit(1), n)))
    return F.array_join(F.slice(labels[0], F.lit(1), F.array_max(alike)), ".")


def lquery_pattern(query: str) -> str:
    """A path query as a regular expression for whole paths: `*`, `*{n,m}`, `a|b`, `!a`, and the marks @ (any case),
    * (prefix) and % (leading words)."""

    def level(q: str) -> tuple[str, int, int | None]:
        """What one label looks like, and how often it stands."""
        if q.startswith("*"):
            span = re.fullmatch(r"\*(?:\{(\d*)(,?)(\d*)\})?", q)
            if not span:
                raise ValueError(f"syntax error in path query: {q}")
            low, comma, high = span.groups()
            least = int(low or 0)
            return "[^.]+", least, None if comma is None or comma and not high else int(high) if comma else least
        no, names = q.startswith("!"), []
        for name in q.lstrip("!").split("|"):
            word, marks = re.fullmatch(r"(.*?)([@*%]*)", name).groups()
            if not re.fullmatch(r"\w+", word):
                raise ValueError(f"syntax error in path query: {q}")
            body = word + ("(?:_[^.]*)?" if "%" in marks else "") + ("[^.]*" if "*" in marks else "")
            names.append(f"(?i:{body})" if "@" in marks else body)
        one = f"(?:{'|'.join(names)})"
        return (rf"(?!{one}\.)[^.]+" if no else one), 1, 1

    # each label ends with a dot, which the path gets too
    return "^" + "".join(rf"(?:{one}\.){{{low},{'' if high is None else high}}}" for one, low, high in map(level, query.split("."))) + "$"


def ltree_matches(path: Column, query: str) -> Column:
    return F.when(path == "", path).otherwise(F.concat(path, F.lit("."))).rlike(lquery_pattern(query))


def ltxt_matches(path: Column, query: str) -> Column:
    """Words with & | ! and parentheses against a path's labels, whatever their order."""
    return compat.boolean_query(query, lambda w: F.array_contains(F.split(path, r"\."), w))


# ---- product numbers


def _let(x: Column, body) -> Column:
    """body(x) with x evaluated once."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def _weighed(s: Column, n: int, weight) -> Column:
    """The sum of the first n digits, each times weight(place from 1)."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0), lambda t, k: t + F.substr(s, k, F.lit(1)).cast("int") * weight(k))


def _with_tail(s: Column) -> Column:
    """Twelve digits and their check digit."""
    return F.concat(s, ((10 - _weighed(s, 12, lambda k: F.when(k % 2 == 0, 3).otherwise(1)) % 10) % 10).cast("string"))


def _with_sign(s: Column, n: int) -> Column:
    """n digits and their check sign by weights that fall to 2."""
    return _let((11 - _weighed(s, n, lambda k: n + 2 - k) % 11) % 11, lambda c: F.concat(s, F.when(c == 10, "X").otherwise(c.cast("string"))))


def ean13(s: Column) -> Column:
    """The 13 digits of an EAN, UPC, ISBN, ISMN or ISSN in any spelling, null if its check digit is wrong."""

    def read(x: Column) -> Column:
        head = lambda n: F.substring(x, 1, n)
        short = _with_tail(F.concat(F.lit("0"), head(11)))
        music = _with_tail(F.concat(F.lit("9790"), F.substring(x, 2, 8)))
        return (
            F.when(x.rlike(r"^\d{13}$"), F.when(_with_tail(head(12)) == x, x))
            .when(x.rlike(r"^\d{12}$"), F.when(F.endswith(short, x), short))
            .when(x.rlike(r"^M\d{9}$"), F.when(F.substring(music, 13, 1) == F.substring(x, 10, 1), music))
            .when(x.rlike(r"^\d{9}[\dX]$"), F.when(_with_sign(head(9), 9) == x, _with_tail(F.concat(F.lit("978"), head(9)))))
            .when(x.rlike(r"^\d{7}[\dX]$"), F.when(_with_sign(head(7), 7) == x, _with_tail(F.concat(F.lit("977"), head(7), F.lit("00")))))
        )

    return _let(F.upper(F.regexp_replace(s, r"[\s-]", "")), read)


def isbn10(s: Column) -> Column:
    """The ten signs of a book's number, null where it has none."""
    return _let(ean13(s), lambda x: F.when(x.startswith("978"), _with_sign(F.substring(x, 4, 9), 9)))


# ---- digests and identifiers


def digest(b: Column, kind: str) -> Column:
    """Bytes: md5, sha1, sha224, sha256, sha384 or sha512."""
    if kind == "md5":
        return F.unhex(F.md5(b))
    if kind == "sha1":
        return F.unhex(F.sha1(b))
    if kind not in ("sha224", "sha256", "sha384", "sha512"):
        raise ValueError(f"unknown digest: {kind}")
    return F.unhex(F.sha2(b, int(kind[3:])))


def hmac(b: Column, key: bytes, kind: str) -> Column:
    """A keyed digest; the key's two pads are made once, on the driver."""
    size = 128 if kind in ("sha384", "sha512") else 64
    key = (hashlib.new(kind, key).digest() if len(key) > size else key).ljust(size, b"\0")
    inner, outer = (F.lit(bytes(x ^ pad for x in key)) for pad in (0x36, 0x5C))
    return digest(F.concat(outer, digest(F.concat(inner, b), kind)), kind)


def name_uuid(space: str, name: Column, version: int = 5) -> Column:
    """An identifier from a name: version 3 by MD5, 5 by SHA-1. The space is an identifier, or dns, url, oid, x500."""
    raw = {"dns": identifiers.NAMESPACE_DNS, "url": identifiers.NAMESPACE_URL, "oid": identifiers.NAMESPACE_OID, "x500": identifiers.NAMESPACE_X500}.get(space) or identifiers.UUID(space)
    if version not in (3, 5):
        raise ValueError("names give identifiers of version 3 or 5")
    h = F.lower(F.hex(digest(F.concat(F.lit(raw.bytes), F.encode(name, "UTF-8")), "md5" if version == 3 else "sha1")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit(str(version)), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


# ---- XML


def xml_concat(*parts: Column) -> Column:
    """Null parts are left out; null if all are."""
    return F.when(F.coalesce(*parts).isNotNull(), F.concat_ws("", *parts))


def xml_pi(name: str, content: Column | None = None) -> Column:
    if name.lower() == "xml":
        raise ValueError("a processing instruction can't be named xml")
    if content is None:
        return F.lit(f"<?{name}?>")
    bad = F.raise_error(F.lit("a processing instruction can't contain ?>"))
    return F.when(content.contains("?>"), bad).otherwise(F.concat(F.lit(f"<?{name} "), F.ltrim(content), F.lit("?>")))


def xml_comment(content: Column) -> Column:
    bad = F.raise_error(F.lit("a comment can't contain -- or end in -"))
    return F.when(content.contains("--") | content.endswith("-"), bad).otherwise(F.concat(F.lit("<!--"), content, F.lit("-->")))


def xml_root(x: Column, version: str = "1.0", standalone: bool | None = None) -> Column:
    """A document with a declaration, in place of one it has."""
    alone = "" if standalone is None else f' standalone="{"yes" if standalone else "no"}"'
    return F.concat(F.lit(f'<?xml version="{version}"{alone}?>'), F.regexp_replace(x, r"^\s*<\?xml\s[^>]*\?>", ""))


def is_document(x: Column) -> Column:
    """Whether content is one element, with comments, instructions and a declaration beside it at most."""
    bare = F.regexp_replace(x, r"(?s)<!--.*?-->|<\?.*?\?>|<!DOCTYPE[^>]*>", "")
    tags = F.regexp_extract_all(F.trim(bare), F.lit(r"(?s)(<[^>]*>|[^<]+)"), F.lit(1))
    step = lambda t: F.when(~t.startswith("<") | t.endswith("/>"), 0).when(t.startswith("</"), -1).otherwise(1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("roots"), F.lit(True).alias("good"))
    # what stands at depth 0 must be tags; each that opens there is a root
    end = F.aggregate(tags, start, lambda s, t: F.struct((s.depth + step(t)).alias("depth"), (s.roots + F.when((s.depth == 0) & t.startswith("<") & ~t.startswith("</"), 1).otherwise(0)).alias("roots"), (s.good & (s.depth + step(t) >= 0) & (t.startswith("<") | (s.depth > 0) | (F.trim(t) == ""))).alias("good")))
    return end.good & (end.depth == 0) & (end.roots == 1)


# ---- search dictionaries


def lexize(tokens: Column, stop: tuple[str, ...] = (), synonyms: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> Column:
    """Tokens through dictionaries: phrases of two words become one, synonyms are replaced, stop words go."""
    out = tokens
    if phrases:
        pairs = F.create_map(*[F.lit(x) for kv in phrases.items() for x in kv])
        start = F.struct(F.array().cast("array<string>").alias("said"), F.lit(None).cast("string").alias("held"))

        def read(s: Column, t: Column) -> Column:
            """The last word is held back, as it may begin a phrase."""
            both = F.element_at(pairs, F.concat_ws(" ", s.held, t))
            joined = s.held.isNotNull() & both.isNotNull()
            said = F.when(joined, F.concat(s.said, F.array(both))).when(s.held.isNull(), s.said).otherwise(F.concat(s.said, F.array(s.held)))
            return F.struct(said.alias("said"), F.when(~joined, t).alias("held"))

        out = F.aggregate(out, start, read, lambda s: F.when(s.held.isNull(), s.said).otherwise(F.concat(s.said, F.array(s.held))))
    if synonyms:
        known = F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv])
        out = F.transform(out, lambda t: F.coalesce(F.element_at(known, t), t))
    return F.filter(out, lambda t: ~t.isin(*stop)) if stop else out


# ---- types of one's own


def enum_order(x: Column, labels: list[str]) -> Column:
    """What values of an enumeration sort by; an error for others."""
    at = F.array_position(F.array(*[F.lit(v) for v in labels]), x)
    return F.when(at > 0, at).when(x.isNotNull(), F.raise_error(F.concat(F.lit("invalid label "), x)))


def domain(x: Column, check: Column, name: str) -> Column:
    """A value of a domain: an error where its check is false; unknown passes."""
    return F.when(~check, F.raise_error(F.lit(f"value violates the check of {name}"))).otherwise(x)
