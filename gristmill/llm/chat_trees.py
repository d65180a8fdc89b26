"""Chat formatting from reply trees.

Messages point at the message they answer. Self-joins that double the length of their jumps give each message
its root, depth and score total in logarithmically many rounds; leaves are ranked within their root, and the
same jumps, taken back from the chosen leaves, enumerate the chosen root-to-leaf paths. Each path becomes one
conversation. The template marks turns; control strings inside texts are escaped reversibly.

Cases: a null text or role counts as empty; a message whose parent isn't there is a root; messages on or below a
cycle have no root and lie on no path; rows of a conversation with equal turns stand in the order of role and
text; a null conversation id is a conversation of its own. One conversation is one row of the result, so its
turns come together in one task, as its text must.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.llm.common import cut, table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Escaped by a backslash after their first character; a backslash is doubled.
CONTROL = r"<\||</?s>|<</?SYS>>|\[/?INST\]"
_ESCAPE = re.compile(rf"\\|(?:(?={CONTROL}).)", re.S)
_ROLE = re.compile(r"((?:\\.|[^\\\n])*)\n", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans (code points, end exclusive) of the texts to learn."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head = OPEN + escape(role).replace("\n", "\\\n") + "\n"
        body = escape(text)
        at += len(head)
        if role == learn:
            spans.append((at, at + len(body)))
        at += len(body) + len(CLOSE)
        out += [head, body, CLOSE]
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns back; no text holds a raw control string, so the marks are the template's own."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn starts at {at}")
        head = _ROLE.match(formatted, at + len(OPEN))
        end = formatted.index(CLOSE, head.end())
        turns.append((unescape(head[1]), unescape(formatted[head.end() : end])))
        at = end + len(CLOSE)
    return turns


def jumps(messages: DataFrame, id: str, parent: str, score: str) -> tuple[list[DataFrame], DataFrame]:
    """The jump tables (id, up), the k-th with ancestors 2**k away, and (id, root, depth, total) of each message
    that has a root. Each round is one self-join; there are as many as the depth has binary digits."""
    m = messages.select(F.col(id).alias("id"), F.col(parent).alias("up"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("total"))
    known = m.select(F.col("id").alias("_id"))
    now = cut(m.join(known, F.col("up") == F.col("_id"), "left").select("id", F.col("_id").alias("up"), F.col("id").alias("root"), F.lit(0).alias("depth"), "total"))
    now = now.withColumns({"root": F.coalesce("up", "root"), "depth": F.when(F.col("up").isNotNull(), 1).otherwise(0)})
    # total: of the nodes from id up to, but without, the one at `up`
    tables, rounds, rows = [], 0, None
    while True:
        now = cut(now)
        tables.append(now.filter(F.col("up").isNotNull()).select("id", "up"))
        left = tables[-1].count()
        if not left or (rows is not None and 2**rounds > rows):
            break
        rows = rows if rows is not None else now.count()
        above = now.select(F.col("id").alias("_a"), F.col("up").alias("_up"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), F.col("total").alias("_total"))
        jumped = now.filter(F.col("up").isNotNull()).join(above, F.col("up") == F.col("_a"))
        jumped = jumped.select("id", F.col("_up").alias("up"), F.col("_root").alias("root"), (F.col("depth") + F.col("_depth")).alias("depth"), (F.col("total") + F.col("_total")).alias("total"))
        now = now.filter(F.col("up").isNull()).unionByName(jumped)
        rounds += 1
    return tables[:-1] if not left else tables, now.filter(F.col("up").isNull()).drop("up")


def chosen_paths(messages: DataFrame, id: str = "id", parent: str = "parent", score: str = "score", top: int = 1) -> DataFrame:
    """(root, leaf, rank, id, pos): for each root the `top` paths of the highest score totals, longer ones and
    then smaller leaf ids first; a row for each message on a path, pos 0 at the root."""
    tables, nodes = jumps(messages, id, parent, score)
    inner = messages.select(F.col(parent).alias("_parent")).filter(F.col("_parent").isNotNull()).distinct()
    leaves = nodes.join(inner, F.col("id") == F.col("_parent"), "left_anti")
    best = Window.partitionBy("root").orderBy(F.desc("total"), F.desc("depth"), F.asc("id"))
    paths = cut(leaves.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("root", F.col("id").alias("leaf"), "rank", "id", F.col("depth").alias("pos")))
    for k, hop in enumerate(tables):
        hop = hop.select(F.col("id").alias("_at"), F.col("up").alias("_up"))
        more = paths.join(hop, F.col("id") == F.col("_at")).select("root", "leaf", "rank", F.col("_up").alias("id"), (F.col("pos") - 2**k).alias("pos"))
        paths = cut(paths.unionByName(more))
    return paths


_TURNS = "array<struct<pos:int,role:string,text:string>>"
_CHAT = pa.struct([("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
_BACK = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def format_turns(turns: Column, learn: str = "assistant") -> Column:
    """struct<formatted, loss> of an array<struct<role, text>> column in order; loss spans are in code points."""

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in it:
            out = []
            for row in batch:
                text, spans = render([(t["role"] or "", t["text"] or "") for t in row.as_py() or []], learn)
                out.append({"formatted": text, "loss": [{"start": a, "end": b} for a, b in spans]})
            yield pa.array(out, type=_CHAT)

    return F.arrow_udf(run, "struct<formatted:string,loss:array<struct<start:long,end:long>>>")(turns)


def parse_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in it:
            yield pa.array([[{"role": r, "text": t} for r, t in parse(x.as_py() or "")] for x in batch], type=_BACK)

    return F.arrow_udf(run, "array<struct<role:string,text:string>>")(formatted)


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def conversation_tree(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A linear table as a reply tree: id, parent, score (1 for each message), conv_id, role and text."""
    said, told = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    order = Window.partitionBy(conv).orderBy(F.col(turn).asc_nulls_last(), said, told)
    seq = df.select(F.col(conv).alias("conv_id"), said.alias("role"), told.alias("text"), F.row_number().over(order).alias("_n"))
    name = lambda n: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), n.cast("string"))
    return seq.select(name(F.col("_n")).alias("id"), F.when(F.col("_n") > 1, name(F.col("_n") - 1)).alias("parent"), F.lit(1.0).alias("score"), "conv_id", "role", "text")


def format_trees(tree: DataFrame, keep: list[str], top: int = 1, learn: str = "assistant") -> DataFrame:
    """tree: id, parent, score, role, text and the columns in `keep`, which are taken from the root. A row for
    each chosen path: keep, rank, n_turns, formatted, loss."""
    paths = chosen_paths(tree.select("id", "parent", "score"), top=top)
    texts = tree.select(F.col("id").alias("_id"), "role", "text", *[F.col(c).alias(f"_keep_{c}") for c in keep])
    rows = paths.join(texts, F.col("id") == F.col("_id"))
    turns = F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("_turns")
    got = rows.groupBy("leaf", "rank").agg(turns, *[F.max_by(f"_keep_{c}", -F.col("pos")).alias(c) for c in keep])
    got = got.withColumn("_chat", format_turns(F.transform("_turns", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))), learn))
    return got.select(*keep, "rank", F.size("_turns").cast("long").alias("n_turns"), F.col("_chat.formatted").alias("formatted"), F.col("_chat.loss").alias("loss"))


def op6_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    chats = format_trees(cut(conversation_tree(talks)), ["conv_id"])
    back = chats.withColumn("_back", parse_turns(F.col("formatted")))
    whole = F.array_join(F.transform("_back", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    under = F.array_join(F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), (s.start + 1).cast("int"), (s.end - s.start).cast("int")))), "")
    back = back.withColumn("_under", under)
    return back.select("conv_id", F.size("_back").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("_under").cast("long").alias("loss_chars"), F.sha2("_under", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


OP6_SQL = r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
sized AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS n,
  12 + 1 + 11 + len(role) + len(text) + len(regexp_extract_all(role, '\\|\n|<\||</?s>|<</?SYS>>|\[/?INST\]'))
  + len(regexp_extract_all(text, '\\|<\||</?s>|<</?SYS>>|\[/?INST\]')) AS chars FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

QUERIES = {"op6_chat_trees": op6_chat_trees}
SQL = {"op6_chat_trees": OP6_SQL}
