"""Quality rules with suffix-array repetition.

Each text's words form one sequence. A suffix array over all sequences of a slice, built by prefix doubling in
numpy, gives the longest-common-prefix array. Its intervals are the substrings that repeat and can't grow to the
right; those that can't grow to the left either are the maximal repeated substrings. The union of the spans of
maximal repeats of MIN_REPEAT words or more must not cover more than a fraction of the words, and the longest
must not exceed a limit.

Cases: a null or empty text has no words and fails for being short; a text without repeats has longest_repeat 0;
texts of any length are taken whole, one that exceeds a slice alone; repeated rows and equal texts have equal results;
an empty table gives an empty result; a column named like the output is replaced, others are left alone whatever
their names.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import table, text_udf

MIN_WORDS = 20
#: Words in a repeat that counts.
MIN_REPEAT = 8
#: Per cent of the words that repeats may cover.
MAX_COVERED = 30
#: Words in the longest repeat: at most LONG_WORDS, unless it is under LONG_SHARE per cent of the text.
LONG_WORDS, LONG_SHARE = 50, 10

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\r\x0b\x0c"


def suffix_array(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of an int array and its LCP array (lcp[i]: of suffixes i-1 and i in that order; lcp[0] = 0).

    Prefix doubling; a round sorts only suffixes whose rank is still shared. The ranks of each round are kept in four
    bytes each, so that an LCP is found by descending through them, one doubling at a time. There are as many rounds
    as the longest repeat has binary digits."""
    n = len(seq)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, rank = np.unique(seq, return_inverse=True)
    # a rank is the position of the group's first suffix, so that groups can be split in place
    order = np.argsort(rank, kind="stable")
    sorted_rank = rank[order]
    heads = np.concatenate([[True], sorted_rank[1:] != sorted_rank[:-1]])
    rank = np.empty(n, np.int32 if n < 2**31 else np.int64)
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    levels, width = [rank], 1
    while True:
        size = np.bincount(rank, minlength=n)
        shared = np.flatnonzero(size[rank[order]] > 1)  # places in the order
        if len(shared) == 0:
            break
        at = order[shared]
        second = np.where(at + width < n, rank[np.minimum(at + width, n - 1)], -1)
        first = rank[at]
        by = np.lexsort((second, first))
        at, first, second = at[by], first[by], second[by]
        order[shared] = at
        new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        rank = rank.copy()
        rank[at] = np.maximum.accumulate(np.where(new, shared, 0))
        levels.append(rank)
        width *= 2
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        ok = np.flatnonzero((a < n) & (b < n))
        same = ok[levels[k][a[ok]] == levels[k][b[ok]]]
        lcp[same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return order, np.concatenate([[0], lcp])


def _nearest_lower(lcp: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """For the places `at`, all that hold the least height or more, the nearest place of lower height to the left
    (step -1) or right (1). A place jumps to where the one before it has jumped to, so jumps double."""
    near = np.arange(len(lcp), dtype=np.int64)
    near[at] = at + step
    live = at
    while len(live):
        live = live[lcp[near[live]] >= lcp[live]]
        near[live] = near[near[live]]
    return near


def lcp_intervals(order: np.ndarray, lcp: np.ndarray, seq: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The LCP intervals of height `least` or more that are maximal repeated substrings, as rows (left, right, place):
    the suffixes order[left:right] have their first lcp[place] elements in common, and what precedes them differs. And,
    for each place of the suffix array, a place of the innermost such interval around it, -1 for none."""
    n = len(order)
    high = np.concatenate([lcp, [0]]) if n else np.zeros(1, np.int64)
    at = np.flatnonzero(high >= least)
    if len(at) == 0:
        return np.zeros((0, 3), np.int64), np.full(n, -1, np.int64)
    left, right = _nearest_lower(high, at, -1), _nearest_lower(high, at, 1)
    # what precedes the suffixes of an interval differs if it changes between its first and its last one
    before = np.where(order > 0, seq[order - 1], -1)
    changes = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])
    a, b = left[at], right[at]
    maximal = changes[b - 1] > changes[a]
    # one that isn't maximal passes its suffixes to the interval around it
    goes = np.arange(n + 1)
    goes[at] = np.where(maximal, at, np.where(high[a] >= high[b], a, b))
    while True:
        further = goes[goes]
        if np.array_equal(further, goes):
            break
        goes = further
    inner = goes[np.where(high[:-1] >= high[1:], np.arange(n), np.arange(1, n + 1))]
    found, first = np.unique(np.stack([a, b], 1)[maximal], axis=0, return_index=True)
    return np.column_stack([found, at[maximal][first]]), np.where(high[inner] >= least, inner, -1)


def repeat_lengths(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """For the words of all docs, one after the other: the length of the longest maximal repeat of MIN_REPEAT words or
    more in the same doc that has an occurrence there, 0 for none. Also where each doc starts, with the total at the
    end."""
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    n = int(bounds[-1])
    longest = np.zeros(n, np.int64)
    if n == 0:
        return longest, bounds
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in itertools.chain.from_iterable(docs)), np.int64, n)
    # a word is another one in each doc, so that no repeat crosses from doc to doc
    seq = np.repeat(np.arange(len(docs), dtype=np.int64), np.diff(bounds)) * len(ids) + code
    order, lcp = suffix_array(seq)
    _, inner = lcp_intervals(order, lcp, seq, MIN_REPEAT)
    longest[order] = np.where(inner >= 0, np.concatenate([lcp, [0]])[inner], 0)
    return longest, bounds


def analyse(texts: list[str]) -> list[dict]:
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    docs = [r.split() for r in raws]  # bytes split at exactly the six ASCII white-space characters
    hit, bounds = repeat_lengths(docs)
    n = len(hit)
    # the union of the spans: a word is covered if an earlier start in its doc reaches beyond it
    reach = np.maximum.accumulate(np.arange(n) + hit) if n else hit
    covered = reach > np.arange(n)
    total = np.concatenate([[0], np.cumsum(covered)])
    out = []
    for k, (t, raw, words) in enumerate(zip(texts, raws, docs, strict=True)):
        a, b = bounds[k], bounds[k + 1]
        seen, dup = set(), 0
        for line in raw.split(b"\n"):
            if line in seen:
                dup += 1
            elif line.strip(SPACE):
                seen.add(line)
        out.append(
            {
                "n_words": len(words),
                "word_chars": len(t) - sum(map(raw.count, (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c"))),
                "n_symbols": sum(raw.count(c) for c in SYMBOLS),
                "n_dup_lines": dup,
                "n_repeat_words": int(total[b] - total[a]),
                "longest_repeat": int(hit[a:b].max()) if b > a else 0,
            }
        )
    return out


_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat")
_KIND = pa.struct([(f, pa.int64()) for f in _FIELDS])


def quality_stats(df: DataFrame, text: str = "text", out: str = "quality") -> DataFrame:
    """df with `out`: a struct of the counts that the rules use."""
    kind = f"struct<{','.join(f'{f}:long' for f in _FIELDS)}>"
    return df.withColumn(out, text_udf(lambda: analyse, kind, _KIND, 2_000_000)(F.col(text)))


def base_failed(q):
    return (q.n_words < MIN_WORDS) | (100 * q.n_repeat_words > MAX_COVERED * q.n_words)


def kept(q):
    """Passes the base rules, and its longest repeat is neither long nor a large part of the text."""
    return ~base_failed(q) & ((q.longest_repeat <= LONG_WORDS) | (100 * q.longest_repeat <= LONG_SHARE * q.n_words))


def repeats(text: str | None, least: int = MIN_REPEAT) -> list[tuple[int, list[int]]]:
    """The maximal repeated word sequences of one text: (words, starts)."""
    words = (text or "").encode().split()
    ids: dict[bytes, int] = {}
    seq = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    order, lcp = suffix_array(seq)
    found, _ = lcp_intervals(order, lcp, seq, least)
    return [(int(lcp[k]), sorted(map(int, order[a:b]))) for a, b, k in found]


def filter_quality(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of df whose texts the rules keep."""
    from gristmill.llm.common import fresh

    (q,) = fresh(df, "_quality")
    scored = quality_stats(df, text, q)
    return scored.filter(kept(F.col(q))).drop(q)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = quality_stats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    q = F.col("quality")
    return df.select("doc_id", *[q[f].alias(f) for f in _FIELDS[:5]], base_failed(q).alias("base_failed"), kept(q).alias("kept"), q.longest_repeat.alias("longest_repeat"))


QUERIES = {"op2_quality_rules": op2_quality_rules}
SQL: dict[str, str] = {}
