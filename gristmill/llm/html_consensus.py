"""HTML extraction by consensus host paths.

Each page chooses the path of generalised tag-class steps whose elements hold its article, parts in sibling and
nested containers included. The paths' votes are summed per host in Spark. Every page of a host is then extracted
again from the elements on the host's winning path; a page that lacks it uses its own choice.

Cases: a null or empty html has an empty text; pages without a host (null or odd urls) use their own
choice; broken markup never fails: unclosed elements end with their parents, stray end tags are ignored;
repeated pages are extracted each; ties are settled by path, the shorter and then the smaller one first; a page of
any length is read whole; an empty table gives an empty result; a column named like the output is replaced, others
pass through whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import HOT, cut, fresh, look_up, table, text_udf

#: A quoted value ends before white space, a slash or the tag's end. A tag with a quote too many ends at the first '>'.
TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)"""
    r"""(?:(?P<attrs>(?:"[^"]*"(?=[\s/>])|'[^']*'(?=[\s/>])|[^'"<>])*)>|(?P<loose>[^<>]*)>)|<[!?][^>]*>""",
    re.S,
)
ATTR = re.compile(r"""(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content isn't markup, or isn't shown.
RAW = frozenset("script style noscript template title textarea svg iframe select noframes xmp annotation annotation-xml".split())
#: Those of them that run to the end of the page if nothing closes them; of the others only the tag goes.
ENDLESS = frozenset("script style title textarea noframes xmp iframe".split())
#: Never part of an article.
APART = frozenset("nav header footer aside button menu dialog fieldset label head".split())
BLOCK = frozenset("address article blockquote body caption center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul form".split()) | APART
CONTAINER = frozenset("article main section div td body blockquote center".split())
#: Class, id or role words of what isn't the article.
AWAY = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|search"
    r"|nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|toolbar|header|masthead|topbar|footer|copyright|sidebar|side|rail|widget|aside|complementary|contentinfo"
    r"|comments?|commentlist|disqus|discussion|replies|respond|reviews?|related|recommend\w*|share|sharing|social|follow|tags|hidden|skip|outbrain|taboola)(?=$|[\s_-])",
    re.I,
)
#: Those of them that name what readers and other pages say, and notices: an element with one is let in only if it holds main or an h1.
OTHERS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|alert|newsletter|subscribe|signup|login|comments?|commentlist|disqus|discussion|replies|respond|reviews?|related|recommend\w*|tags|outbrain|taboola)(?=$|[\s_-])", re.I)
#: Ids of sections that aren't anchors of an article's parts.
NO_ANCHOR = re.compile(r"comments?(?:[_-](?:list|section|area))?|commentlist|disqus(?:_thread)?|respond|related(?:[_-](?:posts|articles|content))?|recommended|newsletter|sidebar|navigation|nav|header|footer", re.I)
HEADING = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Text that stays elsewhere is at most a fifth of that in an element that is let in.
REST = 5
#: Elements that a new one of the same group closes.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
SHARE = 1_000_000
#: The share of a page's text outside links that its article holds at least.
NEARLY = 0.9


class Node:
    __slots__ = ("tag", "step", "parent", "away", "semantic", "depth", "_path", "doubt", "others", "doubted", "main", "h1", "article", "held")

    def __init__(self, tag: str, step: str, parent: Node | None, away: bool, semantic: bool):
        self.tag, self.step, self.parent, self.away, self.semantic = tag, step, parent, away, semantic
        self.depth = parent.depth + 1 if parent else 0
        self._path: str | None = None
        #: The element itself is named like what isn't the article, or like OTHERS; the innermost one around or at it.
        self.doubt, self.others = False, False
        self.doubted: Node | None = parent.doubted if parent else None
        #: What a doubted element holds.
        self.main, self.h1, self.article, self.held = False, False, 0, 0

    def path(self) -> str:
        if self._path is None:
            up = self.parent.path() if self.parent is not None and self.parent.parent is not None else ""
            self._path = f"{up}/{self.step}" if up else self.step
        return self._path


def above(n: Node | None) -> Iterator[Node]:
    """The doubted elements around n, inner ones first."""
    n = n.doubted if n is not None else None
    while n is not None:
        yield n
        n = n.parent.doubted if n.parent is not None else None


def let_in(doubts: list[Node], pieces: list[tuple[Node, int]]) -> None:
    """Lifts the doubt from elements that hold the article: one that holds main; one whose text, or whose articles'
    text, outweighs what stays outside of doubted ones. pieces: (innermost element, characters outside links)."""
    for x in [x for x in doubts if x.main]:
        x.doubt = False
    while True:
        rest, open_ = 0, {}
        for x in doubts:
            x.held = x.article = 0
        for n, size in pieces:
            around = [x for x in above(n) if x.doubt]
            if not around:
                rest += size
                continue
            top = around[-1]
            top.held += size
            open_[id(top)] = top
            up = n
            while up is not top and not up.semantic:
                up = up.parent
            if up.semantic:
                top.article += size
        fit = [x for x in open_.values() if (x.h1 or not x.others) and (x.held > REST * rest or x.article > rest)]
        if not fit:
            return
        max(fit, key=lambda x: x.held).doubt = False


def blocks(page: str) -> list[tuple[Node, str, int]]:
    """The text blocks of a page in order: (innermost block element, text, characters inside links). Blocks in
    elements that stand apart are left out, also those in elements with AWAY names unless they hold the article or
    nothing else is left."""
    root = Node("", "", None, False, False)
    stack = [root]
    doubts: list[Node] = []
    #: Pieces (text, innermost element, whether in a link) of each block.
    raw: list[tuple[Node, list[tuple[str, Node, bool]]]] = []
    text: list[tuple[str, Node, bool]] = []
    in_link = 0

    def block_of() -> Node:
        for n in reversed(stack):
            if n.tag in BLOCK or n is root:
                return n
        return root

    def flush() -> None:
        if text:
            raw.append((block_of(), text.copy()))
            text.clear()

    def pop(to: int) -> None:
        nonlocal in_link
        if any(n.tag in BLOCK for n in stack[to:]):
            flush()
        in_link -= sum(n.tag == "a" for n in stack[to:])
        del stack[to:]

    def say(s: str) -> None:
        if s and not stack[-1].away:
            text.append((s, stack[-1], in_link > 0))

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if m["data"] is not None:
            say(entities.escape(m["data"]))
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == name), 0)
            if k:
                pop(k)
            elif name in ("p", "br"):
                flush() if name == "p" else say(" ")
            continue
        attrs = m["attrs"] if m["attrs"] is not None else m["loose"]
        if name in VOID:
            flush() if name == "hr" else say(" ") if name == "br" else None
            continue
        if name in RAW:
            if name not in ENDLESS and attrs.rstrip().endswith("/"):
                continue
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = close.end() if close else end if name in ENDLESS else at
            continue
        if name in BLOCK:
            flush()
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "p" or stack[i].tag in CONTAINER or stack[i].tag in APART), 0)
            if k and stack[k].tag == "p":
                pop(k)
            if name in CLOSES:
                shut, stop = CLOSES[name]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in stop:
                        break
                    if stack[i].tag in shut:
                        pop(i)
                        break
        words, semantic, gone, main = "", name in ("article", "main"), name in APART, name == "main"
        step = name
        if attrs and name not in ("a", "b", "i", "em", "strong", "span", "html", "body"):
            for a in ATTR.finditer(attrs):
                key, value = a[1].lower(), (a[2] or "").strip("\"'")
                if key == "class":
                    step = ".".join([name, *sorted({re.sub(r"\d+", "#", c) for c in value.split()})])
                anchor = key == "id" and (name in HEADING or (name == "section" or "section" in step.split(".")) and not NO_ANCHOR.fullmatch(value))
                if key in ("class", "id", "role") and not anchor:
                    words += " " + value
                main = main or key == "role" and value.lower() == "main"
                if key == "role" and value.lower() in ("main", "article") or key == "itemprop" and value.lower() == "articlebody":
                    semantic = True
                if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                    gone = True
            words = re.sub(r"(?i)(?<!\S)(?:has|with|without|no)[-_]\S+", "", words)  # say what the page has, not what this is
        parent = stack[-1]
        now = Node(name, step, parent, parent.away or gone, semantic)
        if not now.away:
            if main or name == "h1":
                for x in above(parent):
                    x.main, x.h1 = x.main or main, x.h1 or name == "h1"
            if name == "form" or words and not semantic and AWAY.search(words):
                now.doubt, now.others, now.doubted = True, bool(OTHERS.search(words)), now
                doubts.append(now)
        stack.append(now)
        in_link += name == "a"
        if attrs.endswith("/") and name not in BLOCK:
            pop(len(stack) - 1)
    flush()
    if doubts:
        let_in(doubts, [(n, len(s.strip())) for _, pieces in raw for s, n, linked in pieces if not linked])

    def lines(every: bool) -> list[tuple[Node, str, int]]:
        out = []
        for node, pieces in raw:
            left = pieces if every or not doubts else [x for x in pieces if not any(d.doubt for d in above(x[1]))]
            line = " ".join(entities.unescape("".join(s for s, _, _ in left)).split())
            if line:
                out.append((node, line, sum(len(s) for s, _, linked in left if linked)))
        return out

    return lines(False) or (lines(True) if doubts else [])


def chosen(found: list[tuple[Node, str, int]]) -> str | None:
    """The path whose elements hold the page's article: the deepest one that still holds NEARLY all of the text
    outside links. From there it climbs, up to the outermost article or to the containers below main and body, as
    long as what an outer container adds isn't mostly links, so leads, titles and short parts stay. None if no
    container holds such text."""
    worth: dict[str, int] = {}
    chars: dict[str, tuple[int, int]] = {}
    nodes: dict[str, Node] = {}
    total = 0
    for node, line, linked in found:
        w, n = max(0, len(line) - 2 * linked), node
        total += w
        while n is not None and n.parent is not None:
            if n.tag in CONTAINER:
                p = n.path()
                nodes.setdefault(p, n)
                worth[p] = worth.get(p, 0) + w
                x, y = chars.get(p, (0, 0))
                chars[p] = x + len(line), y + linked
            n = n.parent
    held = [p for p, w in worth.items() if w > 0 and w >= NEARLY * total]
    if not held:
        return min((p for p, w in worth.items() if w > 0), key=lambda p: (-worth[p], len(p), p), default=None)
    best = max(held, key=lambda p: nodes[p].depth)
    up, n = [], nodes[best]
    while n is not None and n.parent is not None:
        if n.tag in CONTAINER:
            up.append(n)
        n = n.parent
    articles = [x.path() for x in up if x.semantic and x.tag != "main"]
    if articles:
        return articles[-1]
    for x in up:
        p = x.path()
        if x.tag == "body":
            break
        more, links = chars[p][0] - chars[best][0], chars[p][1] - chars[best][1]
        if 3 * links > more:
            break
        if more:
            best = p
        if x.semantic:
            break
    return best


def votes(page: str) -> list[tuple[str, int]]:
    """(path, SHARE) of the page's choice, nothing without one."""
    path = chosen(blocks(page))
    return [] if path is None else [(path, SHARE)]


def extract(page: str, path: str | None) -> str:
    """The blocks below the elements on `path`, or, if there are none, below those on the page's own choice; all
    blocks if it has none."""
    found = blocks(page)

    def on(path: str) -> list[str]:
        known: dict[int, bool] = {}

        def below(n: Node | None) -> bool:
            if n is None or n.parent is None:
                return False
            if id(n) not in known:
                known[id(n)] = (n.tag in CONTAINER and n.path() == path) or below(n.parent)
            return known[id(n)]

        return [line for n, line, _ in found if below(n)]

    lines = on(path) if path is not None else []
    if not lines:
        own = chosen(found)
        lines = [line for _, line, _ in found] if own is None else on(own)
    return "\n\n".join(lines)


def host_of(url: Column) -> Column:
    """The host in lower case without user or port; null if the url has none."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(host, F.lit(""))


_VOTES = pa.list_(pa.struct([("path", pa.string()), ("share", pa.int64())]))

#: Hosts whose winning paths are broadcast at most. Beyond it only those of hot hosts are, which are HOT at most; the
#: others' pages meet their path by a shuffle.
BROADCAST_HOSTS = 50_000


def winning_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path, votes): for each host the path with the most votes, and all its pages' votes."""
    vote = text_udf(lambda: lambda texts: [[{"path": p, "share": s} for p, s in votes(t)] for t in texts], "array<struct<path:string,share:long>>", _VOTES)
    cast = pages.select(host_of(F.col(url)).alias("host"), F.explode(vote(F.col(html))).alias("v")).filter("host is not null")
    counted = cast.groupBy("host", "v.path").agg(F.sum("v.share").alias("votes"))
    best = F.min(F.struct((-F.col("votes")).alias("votes"), F.length("path").alias("size"), "path"))
    return counted.groupBy("host").agg(best.alias("_best"), F.sum("votes").alias("votes")).select("host", F.col("_best.path").alias("path"), "votes")


def extract_main(pages: DataFrame, url: str = "url", html: str = "html", out: str = "main_text") -> DataFrame:
    """pages with `out`: the main text of each page, blocks joined by two newlines."""
    won = cut(winning_paths(pages, url, html))
    h, p = fresh(pages, "_host", "_path")
    named = pages.withColumn(h, host_of(F.col(url)))
    found = won.select(F.col("host").alias(h), F.col("path").alias(p))
    if won.count() <= BROADCAST_HOSTS:
        joined = named.join(F.broadcast(found), h, "left")
    else:
        total = won.agg(F.sum("votes")).first()[0]
        hot = won.filter(F.col("votes") * HOT > total).select(F.col("host").alias(h))
        # a host has no such name, so pages of hot hosts, and those without one, spread by their content
        joined = look_up(named, h, found, hot, F.concat(F.lit("~"), F.xxhash64(url, html).cast("string")))

    def run(pages: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for html, path in pages:
            yield pa.array([extract(x.as_py() or "", y.as_py()) for x, y in zip(html, path, strict=True)], type=pa.string())

    run.__annotations__ = {"pages": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    told = joined.withColumn(out, F.arrow_udf(run, "string")(F.col(html), F.col(p)))
    return told.select(*[F.col(f"`{c}`") for c in pages.columns if c != out], out)


def op10_html_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = extract_main(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return got.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


QUERIES = {"op10_html_consensus": op10_html_consensus}
SQL: dict[str, str] = {}
