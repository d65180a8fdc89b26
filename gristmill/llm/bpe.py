"""Byte-level BPE encoding and decoding with DuckDB.

Each task splits its texts into the pattern's pieces and asks DuckDB for the ids of those it hasn't met: a
recursive query unfolds the pieces into a row for each token position, joins neighbours with the merge table and
contracts each piece's leftmost pair of minimum rank, until no piece has a pair left; only a piece's last state is
kept. Long pieces are first cut where no token of the vocabulary spans, as no merge can cross there, and contract
all pairs of minimum rank at once as long as that can't differ from doing it one after the other. Pieces are
independent of each other, so each distinct piece is encoded once per worker while it stays in the cache. A text's
ids are decoded by joining id positions with the vocabulary and aggregating bytes in order.

Cases: a null or empty text has no ids and decodes to no bytes; a text or piece of any length is encoded whole;
an id outside the vocabulary raises; equal texts have equal results; an empty table gives an empty result; columns
named like the outputs are replaced, others are left alone whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import batches, fresh, release, slices, table, text_udf

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Bytes of pieces in one recursive query, pieces in a worker's cache, ids decoded by one query.
QUERY_BYTES, CACHED, DECODED = 1_000_000, 400_000, 1_500_000
#: Bytes from which a piece counts as long.
LONG = 64
#: Of a worker's DuckDB. It never spills to a local disk: what one query holds is bounded by the numbers above.
MEMORY = "600MB"

_STEP = """
WITH RECURSIVE state(word, toks) USING KEY (word) AS (
  SELECT word, toks FROM todo
  UNION
  (WITH pairs AS (SELECT word, generate_subscripts(toks, 1) AS pos, unnest(toks) AS tok, unnest(toks[2:]) AS follow FROM state),
        best AS (SELECT word, min((merged::BIGINT << 32) | pos) AS pick
                 FROM pairs JOIN merges ON a = tok AND b = follow GROUP BY word)
   SELECT word, toks[:(pick & 4294967295) - 1] || [(pick >> 32)::INT] || toks[(pick & 4294967295) + 2:]
   FROM state JOIN best USING (word))
)
SELECT word, toks FROM state
"""
#: As _STEP, for long pieces. Of the positions with the minimum rank, those at odd places of each row of neighbours
#: are contracted, up to the first whose new token would at once have a pair of lower rank with what stands beside it.
_RUNS = """
WITH RECURSIVE state(word, toks) USING KEY (word) AS (
  SELECT word, toks FROM todo
  UNION
  (WITH pairs AS (SELECT word, generate_subscripts(toks, 1) AS pos, unnest(toks) AS tok, unnest(toks[2:]) AS follow, unnest(toks[3:]) AS beyond, unnest([NULL::INT] || toks[:-2]) AS before FROM state),
        ranked AS (SELECT word, pos, before, beyond, merged FROM pairs JOIN merges ON a = tok AND b = follow),
        least AS (SELECT word, min(merged) AS merged FROM ranked GROUP BY word),
        met AS (SELECT ranked.*, pos - row_number() OVER (PARTITION BY word ORDER BY pos) AS run FROM ranked SEMI JOIN least USING (word, merged)),
        odd AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY word, run ORDER BY pos) % 2 = 1),
        ends AS (SELECT word, min(pos) AS last FROM (
            SELECT word, pos, odd.merged, m.merged AS next FROM odd JOIN merges m ON m.a = odd.merged AND m.b = beyond
            UNION ALL SELECT word, pos, odd.merged, m.merged FROM odd JOIN merges m ON m.a = before AND m.b = odd.merged
            UNION ALL SELECT word, pos, odd.merged, m.merged FROM odd JOIN merges m ON m.a = odd.merged AND m.b = odd.merged) WHERE next < merged GROUP BY word),
        taken AS (SELECT word, pos, merged FROM odd LEFT JOIN ends USING (word) WHERE last IS NULL OR pos <= last)
   SELECT p.word, list(coalesce(t.merged, p.tok) ORDER BY p.pos)
   FROM pairs p SEMI JOIN least l ON l.word = p.word LEFT JOIN taken t ON t.word = p.word AND t.pos = p.pos ANTI JOIN taken u ON u.word = p.word AND u.pos = p.pos - 1
   GROUP BY p.word)
)
SELECT word, toks FROM state
"""


@cache
def vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """A DuckDB connection with the tables vocab(id, tok), its bytes as code points below 256, and merges(a, b, merged)."""

    def __init__(self, path: str):
        import duckdb
        import public_tokenizers
        import regex

        self.ranks = vocabulary(path)
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        pairs = [(x, y, r) for t, r in self.ranks.items() for i in range(1, len(t)) if (x := self.ranks.get(t[:i])) is not None and (y := self.ranks.get(t[i:])) is not None]
        a, b, merged = map(list, zip(*pairs, strict=True)) if pairs else ([], [], [])
        self._table("merges", a=pa.array(a, pa.int32()), b=pa.array(b, pa.int32()), merged=pa.array(merged, pa.int32()))
        self._table("vocab", id=pa.array(self.ranks.values(), pa.int32()), tok=pa.array([t.decode("latin-1") for t in self.ranks], pa.string()))
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self._spans = None

    def _table(self, name: str, **columns: pa.Array) -> None:
        self.con.register("given", pa.table(columns))
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def cuts(self, piece: bytes) -> np.ndarray:
        """Where a piece can be cut: the offsets, 0 and the end included, that no token in it spans."""
        if self._spans is None:
            import ahocorasick

            self._spans = ahocorasick.Automaton()
            for t in self.ranks:
                if len(t) > 1:
                    self._spans.add_word(t.decode("latin-1"), len(t))
            self._spans.make_automaton()
        change = np.zeros(len(piece) + 2, np.int64)
        for end, n in self._spans.iter(piece.decode("latin-1")):
            change[end - n + 2] += 1
            change[end + 1] -= 1
        return np.flatnonzero(np.cumsum(change)[: len(piece) + 1] == 0)

    def _contracted(self, parts: list[bytes], query: str) -> Iterator[tuple[int, list[int]]]:
        """(number, ids) of each part, in any order."""
        ends = np.concatenate([[0], np.cumsum(list(map(len, parts)))]).astype(np.int32)
        toks = pa.ListArray.from_arrays(pa.array(ends), pa.array(self.byte[np.frombuffer(b"".join(parts), np.uint8)]))
        todo = pa.table({"word": np.arange(len(parts), dtype=np.int32), "toks": toks})
        self.con.register("todo", todo)
        yield from self.con.execute(query).fetchall()
        self.con.unregister("todo")

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece. A piece that is a token is that token."""
        out: list = [[r] if (r := self.ranks.get(p)) is not None else None for p in pieces]
        short = [i for i, ids in enumerate(out) if ids is None and len(pieces[i]) <= LONG]
        for part in batches(short, [len(pieces[i]) for i in short], QUERY_BYTES):
            for k, ids in self._contracted([pieces[i] for i in part], _STEP):
                out[part[k]] = ids
        for i, p in enumerate(pieces):
            if out[i] is None:
                at = self.cuts(p).tolist()
                out[i] = list(itertools.chain.from_iterable(self._segments([p[a:b] for a, b in itertools.pairwise(at)])))
        return out

    def _segments(self, parts: list[bytes]) -> list[list[int]]:
        new = list(dict.fromkeys(parts))
        known: dict[bytes, list[int]] = {}
        for part in batches(new, list(map(len, new)), QUERY_BYTES):
            known |= {part[k]: ids for k, ids in self._contracted(part, _RUNS)}
        return [known[p] for p in parts]

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The bytes of consecutive rows of ids, `sizes` of them each, by an aggregation in the order of positions."""
        given = pa.table({"row": np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), "pos": np.arange(len(ids), dtype=np.int32), "id": ids})
        self.con.register("given", given)
        got = self.con.execute("SELECT row, count(*) = count(tok) AS known, string_agg(tok, '' ORDER BY pos) AS raw FROM given LEFT JOIN vocab USING (id) GROUP BY row").fetchall()
        self.con.unregister("given")
        out = [b""] * len(sizes)
        for row, known, raw in got:
            if not known:
                raise ValueError("an id is outside the vocabulary")
            out[row] = raw.encode("latin-1")
        return out


class Words:
    """What a Python worker knows of pieces: their ids as decimal text. Emptied when full."""

    def __init__(self, path: str):
        self.codec, self.known = Codec(path), {}

    def encode(self, texts: list[str]) -> list[str]:
        """The ids of each text, with spaces between."""
        if len(self.known) > CACHED:
            self.known = {}
        known = self.known
        pieces = list(map(self.codec.pieces, texts))
        found = [list(map(known.get, p)) for p in pieces]
        open_ = [k for k, f in enumerate(found) if None in f]
        new = list({p for k in open_ for p, f in zip(pieces[k], found[k], strict=True) if f is None})
        for p, ids in zip(new, self.codec.encode_pieces([p.encode("utf-8", "replace") for p in new]), strict=True):
            known[p] = " ".join(map(str, ids))
        for k in open_:
            found[k] = [known[p] if f is None else f for p, f in zip(pieces[k], found[k], strict=True)]
        for p in new:
            if len(p) > 4 * LONG:  # rarely met again, and not to be held
                del known[p]
        return list(map(" ".join, found))

    def decode(self, told: list[str]) -> Iterator[tuple[np.ndarray, bytes]]:
        """(ids, bytes they decode to) of each row of ids."""
        for part in batches(told, [t.count(" ") + 1 for t in told], DECODED):
            ids = [np.fromstring(t, np.int32, sep=" ") if t else np.zeros(0, np.int32) for t in part]
            yield from zip(ids, self.codec.decode(np.concatenate(ids), np.array(list(map(len, ids)))), strict=True)


@cache
def words_of(path: str) -> Words:
    """One for each vocabulary and Python worker; Spark gives a worker many tasks."""
    return Words(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def encode(df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """df with `out`: array<int> of the ids of the text; empty for null."""
    path = path or default_path()

    def worker():
        words = words_of(path)
        return lambda texts: [list(map(int, told.split())) for told in words.encode(texts)]

    return df.withColumn(out, text_udf(worker, "array<int>", pa.list_(pa.int32()), 1_000_000)(F.col(text)))


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """df with `out`: the bytes of an array<int> of ids; empty for null. Raises on an id outside the vocabulary."""
    path = path or default_path()

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = words_of(path).codec
        for batch in it:
            out: list[bytes] = []
            rows = [np.array(x or [], np.int64).astype(np.int32) for x in batch.to_pylist()]
            for part in batches(rows, list(map(len, rows)), DECODED):
                out += codec.decode(np.concatenate(part), np.array(list(map(len, part))))
            yield pa.array(out, type=pa.binary())

    return df.withColumn(out, F.arrow_udf(run, "binary")(F.col(ids)))


_DIGEST = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("decoded", pa.string())])


def round_trip(df: DataFrame, text: str = "text", out: str = "bpe", keep_text: bool = False, path: str | None = None) -> DataFrame:
    """df with `out`: struct<n_tokens, ids_sha256, decoded_sha256, decoded> of each text, whose ids are decoded
    again; `decoded` is the decoded text if keep_text, else null."""
    path = path or default_path()

    def worker():
        words = words_of(path)

        def digests(texts):
            told = words.encode(texts)
            return [
                {"n_tokens": len(ids), "ids_sha256": hashlib.sha256(t.encode()).hexdigest(), "decoded_sha256": hashlib.sha256(raw).hexdigest(), "decoded": raw.decode("utf-8", "replace") if keep_text else None}
                for t, (ids, raw) in zip(told, words.decode(told), strict=True)
            ]

        return digests

    kind = "struct<n_tokens:long,ids_sha256:string,decoded_sha256:string,decoded:string>"
    return df.withColumn(out, text_udf(worker, kind, _DIGEST, 3_000_000)(F.col(text)))


_TOKENS = pa.struct([("ids", pa.list_(pa.int32())), ("same", pa.bool_())])


def tokenize(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """df with n_tokens, ids (array<int>) and round_trip: whether the ids, decoded, are the text."""
    path = path or default_path()

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = words_of(path)
        for batch in it:
            ids, same = [], []
            for texts in slices(batch, 3_000_000):
                for t, (row, raw) in zip(texts, words.decode(words.encode(texts)), strict=True):
                    ids.append(row)
                    same.append(raw == t.encode("utf-8", "replace"))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
            yield pa.StructArray.from_arrays([flat, pa.array(same, pa.bool_())], fields=list(_TOKENS))
        release()

    (b,) = fresh(df, "_bpe")
    got = df.withColumn(b, F.arrow_udf(run, "struct<ids:array<int>,same:boolean>")(F.col(text)))
    return got.withColumns({"n_tokens": F.size(F.col(b).ids).cast("long"), "ids": F.col(b).ids, "round_trip": F.col(b).same}).drop(b)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select("doc_id", "bpe.n_tokens", "bpe.ids_sha256", "bpe.decoded_sha256")


QUERIES = {"op8_byte_bpe": op8_byte_bpe}
SQL: dict[str, str] = {}
