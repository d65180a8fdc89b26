"""A SQL entry point that reads the dialect's own forms and gives Spark its equivalents.

What is rewritten: parameters $1, $2, ...; `^` (power) and `#` (exclusive or); `~`, `~*`, `!~` and `!~*`; SIMILAR TO;
whole-number division; DISTINCT ON; where nulls stand in ORDER BY; `op ANY (array)` and `op ALL (array)`; ARRAY[...];
LIMIT ALL; functions that Spark has under other names, with other arguments or
meanings (ltrim, rtrim, log, regexp_replace); operators and casts that a session defines. Everything else
is Spark SQL. Texts, names and comments stay as they are.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from gristmill.functions.compat import similar_pattern

_TOKEN = re.compile(r"""\s+|--[^\n]*|/\*.*?\*/|'(?:[^'\\]|''|\\.)*'|"(?:[^"]|"")*"|`[^`]*`|\$\d+|\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+|\w+|!~\*|!~|~\*|::|\|\||<=|>=|<>|!=|->|=>|.""", re.S)
_WORD = re.compile(r"[A-Za-z_]\w*|\"[^\"]*\"|`[^`]*`")
#: Words that can't end or begin an operand.
_STOPS = frozenset("select from where group order by having limit offset and or not in like ilike rlike between is on using join inner left right full cross union except intersect all distinct case when then else end as asc desc nulls with over partition rows range values lateral".split())
_COMPARE = {"=": "=", "<>": "<>", "!=": "<>", "<": "<", "<=": "<=", ">": ">", ">=": ">="}


def tokens(text: str) -> list[str]:
    """The text's tokens without white space and comments."""
    return [t for t in _TOKEN.findall(text) if not t.isspace() and not t.startswith(("--", "/*"))]


def _close(t: list[str], i: int) -> int:
    """The end of the bracket that opens at i."""
    depth = 0
    for k in range(i, len(t)):
        depth += (t[k] in ("(", "[")) - (t[k] in (")", "]"))
        if depth == 0:
            return k
    raise ValueError("a bracket is open")


def _open(t: list[str], i: int) -> int:
    depth = 0
    for k in range(i, -1, -1):
        depth += (t[k] in (")", "]")) - (t[k] in ("(", "["))
        if depth == 0:
            return k
    raise ValueError("a bracket is closed too often")


def _before(t: list[str], i: int) -> int:
    """Where the operand that ends before i begins: a name, number, text, call, subscript, bracket or cast."""
    k = i - 1
    while k >= 0:
        while t[k] in (")", "]"):
            k = _open(t, k)
            if k == 0 or not (_WORD.fullmatch(t[k - 1]) and t[k - 1].lower() not in _STOPS or t[k - 1] in (")", "]") and t[k] == "["):
                break
            k -= 1
        if k >= 1 and t[k - 1] in (".", "::"):
            k -= 2
            continue
        return k
    return 0


def _after(t: list[str], i: int) -> int:
    """Where the operand that begins at i ends, exclusive."""
    k = i
    while k < len(t) and t[k] in ("-", "+"):
        k += 1
    while k < len(t):
        k = _close(t, k) + 1 if t[k] in ("(", "[") else k + 1
        while k < len(t) and t[k] in ("(", "["):
            k = _close(t, k) + 1
        if k < len(t) and t[k] in (".", "::"):
            k += 1
            continue
        return k
    return k


def _binary(t: list[str], ops: tuple[str, ...], make) -> list[str]:
    """Replaces `a op b` by make(a, op, b), the leftmost first."""
    i = 1
    while i < len(t):
        if t[i] in ops and t[i - 1] not in ("(", ",", "[") and t[i - 1].lower() not in _STOPS | {"operator"} and t[i - 1] not in _COMPARE:
            a, b = _before(t, i), _after(t, i + 1)
            new = make(t[a:i], t[i], t[i + 1 : b])
            t = t[:a] + new + t[b:]
            i = a + len(new)
        else:
            i += 1
    return t


def _call(name: str, *args: list[str]) -> list[str]:
    out = [name, "("]
    for k, a in enumerate(args):
        out += [","] * (k > 0) + a
    return [*out, ")"]


def _divided(a: list[str], _, b: list[str]) -> list[str]:
    whole = "('tinyint','smallint','int','bigint')"
    return ["(", "CASE", "WHEN", *_call("typeof", a), "IN", whole, "AND", *_call("typeof", b), "IN", whole, "THEN", *_call("bigint", a), "div", *_call("bigint", b), "ELSE", *a, "/", *b, "END", ")"]


def _text(token: str) -> str:
    return token[1:-1].replace("''", "'")


def _literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _patterns(t: list[str]) -> list[str]:
    out, i = [], 0
    while i < len(t):
        low = t[i].lower()
        if t[i] in ("~", "~*", "!~", "!~*") and out and out[-1] not in ("(", ",") and out[-1].lower() not in _STOPS:
            end = _after(t, i + 1)
            right = t[i + 1 : end]
            if len(right) == 1 and right[0].startswith("'"):
                right = [_literal(_text(right[0]))]
            out += ["NOT"] * t[i].startswith("!") + ["RLIKE"] + (_call("concat", ["'(?i)'"], right) if t[i].endswith("*") else right)
            i = end
        elif low == "similar" and i + 2 < len(t) and t[i + 1].lower() == "to":
            if not t[i + 2].startswith("'"):
                raise ValueError("SIMILAR TO needs a literal pattern")
            out += ["RLIKE", _literal(similar_pattern(_text(t[i + 2])))]
            i += 3
        else:
            out.append(t[i])
            i += 1
    return out


def _any_all(t: list[str]) -> list[str]:
    """a op ANY (array) and a op ALL (array)."""
    i = 1
    while i < len(t) - 2:
        if t[i] in _COMPARE and t[i + 1].lower() in ("any", "all", "some") and t[i + 2] == "(" and t[i + 3].lower() != "select":
            a, b = _before(t, i), _close(t, i + 2)
            name = "forall" if t[i + 1].lower() == "all" else "exists"
            t = t[:a] + [name, "(", *t[i + 3 : b], ",", "_e", "->", *t[a:i], _COMPARE[t[i]], "_e", ")"] + t[b + 1 :]
        i += 1
    return t


def _arrays(t: list[str]) -> list[str]:
    i = 0
    while i < len(t) - 1:
        if t[i].lower() == "array" and t[i + 1] == "[":
            end = _close(t, i + 1)
            t = t[:i] + ["array", "(", *t[i + 2 : end], ")"] + t[end + 1 :]
        i += 1
    return t


def _clause(t: list[str], start: int, words: frozenset[str]) -> int:
    """Where a clause that starts at `start` ends: at one of the words, or where its bracket closes."""
    depth = 0
    for k in range(start, len(t)):
        if t[k] in ("(", "["):
            depth += 1
        elif t[k] in (")", "]"):
            if depth == 0:
                return k
            depth -= 1
        elif depth == 0 and t[k].lower() in words:
            return k
    return len(t)


def _items(t: list[str]) -> list[list[str]]:
    out, depth = [[]], 0
    for x in t:
        depth += (x in ("(", "[")) - (x in (")", "]"))
        if x == "," and depth == 0:
            out.append([])
        else:
            out[-1].append(x)
    return out


#: The dialect's names of functions that Spark has under others.
_NAMES = {"strpos": "instr", "array_to_string": "array_join", "regexp_split_to_array": "split", "array_cat": "concat", "clock_timestamp": "now", "gen_random_uuid": "uuid"}

_ENDS = frozenset("limit offset rows range union except intersect fetch for ;".split())


def _orders(t: list[str]) -> list[str]:
    i = 0
    while i < len(t) - 1:
        if t[i].lower() == "order" and t[i + 1].lower() == "by":
            end = _clause(t, i + 2, _ENDS)
            new: list[str] = []
            for k, item in enumerate(_items(t[i + 2 : end])):
                low = [x.lower() for x in item]
                if "using" in low:  # ORDER BY x USING <, >
                    at = low.index("using")
                    item = item[:at] + (["DESC"] if item[at + 1] in (">", ">=") else ["ASC"]) + item[at + 2 :]
                    low = [x.lower() for x in item]
                if "nulls" not in low:
                    item = item + ["NULLS", "FIRST" if low[-1] == "desc" else "LAST"]
                new += [","] * (k > 0) + item
            t = t[: i + 2] + new + t[end:]
        i += 1
    return t


def _distinct_on(t: list[str]) -> list[str]:
    """SELECT DISTINCT ON (keys) list FROM ... [ORDER BY order]: the first row of each key by a window."""
    i = 0
    while i < len(t) - 3:
        if [x.lower() for x in t[i : i + 3]] == ["select", "distinct", "on"]:
            close = _close(t, i + 3)
            keys = t[i + 4 : close]
            from_ = _clause(t, close + 1, frozenset({"from"}))
            order = next((k for k in range(from_, len(t) - 1) if t[k].lower() == "order" and t[k + 1].lower() == "by" and _clause(t, from_, frozenset({"order", "limit", "offset", "union"})) == k), None)
            end = _clause(t, from_, _ENDS) if order is None else _clause(t, order + 2, _ENDS)
            by = t[order + 2 : end] if order is not None else keys
            listed = t[close + 1 : from_]
            names = [x[-1] if _WORD.fullmatch(x[-1]) else None for x in _items(listed)]
            if None in names:
                raise ValueError("the columns of DISTINCT ON need names")
            body = t[from_ : order if order is not None else end]
            inner = ["SELECT", *listed, ",", "row_number", "(", ")", "OVER", "(", "PARTITION", "BY", *keys, "ORDER", "BY", *by, ")", "AS", "_nth", *body]
            t = t[:i] + ["SELECT", *[y for k, x in enumerate(names) for y in ([","] * (k > 0) + [x])], "FROM", "(", *inner, ")", "WHERE", "_nth", "=", "1"] + t[end:]
        i += 1
    return t


def _replaced(args: list[list[str]]) -> list[str] | None:
    """regexp_replace: the first match only, unless the flags have a g; \\1 to \\9 are groups."""
    if len(args) not in (3, 4) or len(args) == 4 and not args[3][0].startswith("'"):
        return None
    text, pattern, to = args[:3]
    flags = _text(args[3][0]) if len(args) == 4 else ""
    if len(to) == 1 and to[0].startswith("'"):
        to = [_literal(re.sub(r"\\(\d)", r"$\1", _text(to[0])))]
    if len(pattern) == 1 and pattern[0].startswith("'"):
        pattern = [_literal(("(?i)" if "i" in flags else "") + _text(pattern[0]))]
    if "g" in flags:
        return _call("regexp_replace", text, pattern, to)
    at, hit = _call("regexp_instr", text, pattern), _call("regexp_substr", text, pattern)
    parts = _call("concat", _call("left", text, [*at, "-", "1"]), _call("regexp_replace", hit, pattern, to), _call("substr", text, [*at, "+", *_call("length", hit)]))
    return ["CASE", "WHEN", *at, ">", "0", "THEN", *parts, "ELSE", *text, "END"]


#: Functions whose arguments Spark takes otherwise; None leaves a call as it is.
_REWRITES = {
    "ltrim": lambda a: _call("ltrim", a[1], a[0]) if len(a) == 2 else None,
    "rtrim": lambda a: _call("rtrim", a[1], a[0]) if len(a) == 2 else None,
    "log": lambda a: _call("log10", a[0]) if len(a) == 1 else None,
    "regexp_replace": _replaced,
}


def _functions(t: list[str]) -> list[str]:
    """Calls by Spark's names and orders of arguments; inner ones first."""
    for i in range(len(t) - 2, -1, -1):
        if t[i + 1] == "(" and (i == 0 or t[i - 1] != "."):
            low = t[i].lower()
            if low in _NAMES:
                t = [*t[:i], _NAMES[low], *t[i + 1 :]]
            elif low in _REWRITES:
                end = _close(t, i + 1)
                new = _REWRITES[low](_items(t[i + 2 : end]))
                if new is not None:
                    t = t[:i] + new + t[end + 1 :]
    return t


def _joined(t: list[str], symbol: str) -> list[str]:
    """A symbol of several tokens as one."""
    parts, out, i = tokens(symbol), [], 0
    while i < len(t):
        if t[i : i + len(parts)] == parts:
            out.append(symbol)
            i += len(parts)
        else:
            out.append(t[i])
            i += 1
    return out


def _casts(t: list[str], casts: dict[str, str]) -> list[str]:
    """x::type as a call, for types with a cast of the user's."""
    i = 1
    while i < len(t) - 1:
        if t[i] == "::" and t[i + 1].lower() in casts:
            a = _before(t, i)
            new = _call(casts[t[i + 1].lower()], t[a:i])
            t = t[:a] + new + t[i + 2 :]
            i = a + len(new)
        else:
            i += 1
    return t


def translate(text: str, operators: dict[str, str] | None = None, casts: dict[str, str] | None = None) -> str:
    """Spark SQL for a statement of the dialect; parameter $n becomes :p<n>. operators and casts name the functions
    that stand for a symbol between two operands and for a type after `::`."""
    t = tokens(text.strip().rstrip(";"))
    for symbol in sorted(operators or {}, key=len, reverse=True):
        t = _joined(t, symbol)
    t = _casts(t, casts or {})
    for symbol, name in (operators or {}).items():
        t = _binary(t, (symbol,), lambda a, _, b, name=name: _call(name, a, b))
    t = [f":p{x[1:]}" if re.fullmatch(r"\$\d+", x) else x for x in t]
    t = [x for k, x in enumerate(t) if not (x.lower() == "limit" and k + 1 < len(t) and t[k + 1].lower() == "all" or x.lower() == "all" and k and t[k - 1].lower() == "limit")]
    t = _arrays(t)
    t = _functions(t)
    t = _any_all(t)
    t = _patterns(t)
    t = _binary(t, ("^",), lambda a, _, b: _call("power", a, b))
    t = _binary(t, ("/",), _divided)
    t = ["^" if x == "#" else x for x in t]
    t = _distinct_on(t)
    t = _orders(t)
    return re.sub(r" ?(\.|::) ?|(?<=\() | (?=[),])", lambda m: m[1] or "", " ".join(t))


class Session:
    """Statements of the dialect over a Spark session, and statements prepared once with parameters."""

    def __init__(self, spark: SparkSession):
        self.spark, self._prepared, self._operators, self._casts = spark, {}, {}, {}

    def create_function(self, name: str, arguments: str, returns: str, body: str) -> None:
        """A SQL function of the session."""
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")

    def create_operator(self, symbol: str, function: str) -> None:
        """`a symbol b` calls the function; it binds closer than all others."""
        if not re.fullmatch(r"[+\-*/<>=~!@#%^&|`?]+", symbol) or "--" in symbol or "/*" in symbol:
            raise ValueError(f"not an operator's name: {symbol}")
        self._operators[symbol] = function

    def create_cast(self, type_: str, function: str) -> None:
        """`x::type` calls the function."""
        self._casts[type_.lower()] = function

    def sql(self, text: str, *params, **tables: DataFrame) -> DataFrame:
        """Runs a statement; params are $1, $2, ..., tables fill {names}."""
        return self.spark.sql(self._named(text) if tables else self._spark(text), args={f"p{k}": v for k, v in enumerate(params, 1)} or None, **tables)

    def _spark(self, text: str) -> str:
        return translate(text, self._operators, self._casts)

    def _named(self, text: str) -> str:
        kept = re.sub(r"\{(\w+)\}", r"__table_\1__", text)
        return re.sub(r"__table_(\w+?)__", r"{\1}", self._spark(kept))

    def prepare(self, name: str, text: str) -> None:
        if name in self._prepared:
            raise ValueError(f"prepared statement {name} exists")
        self._prepared[name] = text

    def execute(self, name: str, *params) -> DataFrame:
        return self.sql(self._prepared[name], *params)

    def deallocate(self, name: str) -> None:
        del self._prepared[name]
