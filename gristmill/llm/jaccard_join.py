"""Exact Jaccard join on word n-grams, by token-combination prefixes.

Tokens are hashes of shingles. The join runs in these steps, none of which makes a row for each pair:

1. Texts become token sets. Tokens travel in packed blobs, one for each (chunk of texts, token range); the range's
   task finds which tokens occur in two sets or more, and only those travel back to their sets. A token that a chunk
   has more than once travels once, with its number of sets, so a token of all documents is a number for each
   chunk. A set that shares less than its least overlap has no partner and is done.
2. Equal sets are one class. Classes are counted and pruned once more, now against each other, which also gives
   each token's frequency.
3. Prefixes. In the order of frequency, two linked sets have their K smallest common tokens within the first
   n - overlap + K of each. Rare tokens are indexed alone. Frequent ones are dealt by hash into K - 1 parts and
   indexed as pairs within a part: K common tokens hold a rare one, or two in one part. Lists of sets with an equal
   signature become stars.
4. The stars' components bound where links can be. Each is verified exactly in one task, large ones in blocks of
   which each two meet in a task; in one that exceeds LISTED blocks, signatures' lists take the component's place.
   Sets already linked aren't compared with each other again.
5. The links' components, over classes, are the answer.

Tasks get about PART_BYTES each, whatever the size of the input. Rows find their class by a join that broadcasts the
hot classes (`look_up`).

How exact: n_shingles and equality of sets rest on 64-bit hashes, common tokens on their first 48 bits. A document of
n shingles is counted short with a chance of n * n / 2**65. Two sets of n and m tokens have a false common token with a
chance of n * m / 2**48, about 3e-10 for 300 each, which matters only if a single token decides on their link.

Cases: a null or empty text has no set and links with nothing; a text with fewer words than a shingle is one
token; equal texts, and repeated rows, are one class; rows that share a doc_id stand for themselves, and a
component's id is the smallest doc_id in it; a null doc_id is kept and is never a component's id unless the
component has no other; an empty table gives an empty result; other columns of any name are ignored by
jaccard_components and kept by keep_first; a text of any length is taken whole, as a chunk of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import HOT, batches, cut, fresh, look_up, released, table
from gristmill.llm.components import components

SHINGLE = 4
#: Linked if PER * intersection >= LEAST * union.
LEAST, PER = 85, 100
#: Sets with a token up to which it is rare.
RARE = 16
#: Characters in a chunk of texts, tokens in a chunk of sets.
CHUNK_CHARS, CHUNK_TOKENS = 4_000_000, 600_000
#: Sets and tokens in a block of a large candidate component.
BLOCK_SETS, BLOCK_TOKENS = 1500, 1_000_000
#: Blocks from which a candidate component is verified by its signatures' lists instead: a set is in fewer of them.
LISTED = 64
#: Bytes that a task gets of texts, of sets and of signatures.
PART_BYTES = 8_000_000
BITS = 48
#: Marks the number of a token's sets in its chunk, where the chunk has several.
MANY = np.uint32(1 << 31)
_U = np.uint64


def mix(z: np.ndarray) -> np.ndarray:
    z = z.astype(_U)
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


class Shingler:
    """Token sets of texts; keeps the words' hashes while there is room."""

    def __init__(self, size: int):
        self.size, self.known = size, {}

    def _hash(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        known = self.known
        if len(known) > 200_000:
            known.clear()
        try:
            return np.array([known[w] for w in words], _U)
        except KeyError:
            for w in set(words).difference(known):
                known[w] = xxhash.xxh3_64_intdigest(w)
            return np.array([known[w] for w in words], _U)

    def tokens(self, text: str) -> np.ndarray:
        """Sorted distinct hashes. bytes.lower and bytes.split know ASCII only, as the contract has it."""
        words = text.encode("utf-8", "replace").lower().split()
        if not words:
            return np.zeros(0, _U)
        h = self._hash(words)
        k = min(self.size, len(words))
        n = len(words) - k + 1
        acc = np.full(n, k, _U)
        for i in range(k):
            acc = mix(acc * _U(0x9E3779B97F4A7C15) + h[i : i + n])
        return np.unique(acc)


def overlap(n, least: int, per: int):
    """Tokens that a set of n shares at least with any linked one, as both are in a union of n or more."""
    return -(-n * least // per)


# ---- packed blobs: u32 counts, then planes of bytes, which compress better than whole numbers


def pack(tokens: np.ndarray, local: np.ndarray) -> bytes:
    """Tokens in ascending order with the sets' numbers in their chunk."""
    hi, lo = (tokens >> _U(16)).astype(np.uint32), (tokens & _U(0xFFFF)).astype(np.uint16)
    gaps = np.diff(hi, prepend=np.uint32(0)).astype("<u4")
    return np.uint32(len(tokens)).tobytes() + gaps.view(np.uint8).reshape(-1, 4).T.tobytes() + lo.astype("<u2").tobytes() + local.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    planes = np.frombuffer(blob, np.uint8, 4 * n, 4).reshape(4, n)
    hi = np.cumsum(np.ascontiguousarray(planes.T).view("<u4")[:, 0], dtype=np.uint64) if n else np.zeros(0, _U)
    lo = np.frombuffer(blob, "<u2", n, 4 + 4 * n)
    planes = np.frombuffer(blob, np.uint8, 4 * n, 4 + 6 * n).reshape(4, n)
    local = np.ascontiguousarray(planes.T).view("<u4")[:, 0] if n else np.zeros(0, np.uint32)
    return (hi << _U(16)) | lo.astype(_U), local


ROUTED = "part int, chunk long, kind int, blob binary"
_ROUTED = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ROUTED.types, strict=True)], schema=_ROUTED)


def _routed(chunk: int, sets: list[np.ndarray], header: bytes, parts: int) -> Iterator[pa.RecordBatch]:
    """The chunk's header (kind 0), its tokens that several of its sets have, with those sets (kind 2), and all its
    distinct tokens by the part of the token space (kind 1): with their set, or MANY and the number of their sets."""
    out = [(chunk % parts, chunk, 0, header)]
    if sets and sum(map(len, sets)):
        tokens = np.concatenate(sets)
        local = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(s) for s in sets])
        order = np.argsort(tokens, kind="stable")
        tokens, local = tokens[order], local[order]
        heads = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        count = np.diff(np.append(heads, len(tokens))).astype(np.uint32)
        several = np.repeat(count > 1, count)
        if several.any():
            out.append((chunk % parts, chunk, 2, pack(tokens[several], local[several])))
        tokens, local = tokens[heads], np.where(count > 1, count | MANY, local[heads])
        edges = np.searchsorted(tokens, (np.arange(parts + 1, dtype=np.float64) * (2.0**BITS / parts)).astype(_U))
        edges[-1] = len(tokens)
        out += [(p, chunk, 1, pack(tokens[a:b], local[a:b])) for p, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if b > a]
    for part in batches(out, [len(x[3]) for x in out], 4_000_000):
        yield _rows(part)


def _counter(frequencies: bool):
    """What a part of the token space does: for each chunk, its tokens that two sets or more have, with the number of
    those sets. Without frequencies, tokens that the chunk knows to be in several sets don't travel back."""

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, tokens, local = [], [], []
        for batch in it:
            for c, kind, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if kind != 1:
                    yield _rows([(0, c, kind, blob.as_py())])
                else:
                    t, x = unpack(blob.as_py())
                    chunks.append(c)
                    tokens.append(t)
                    local.append(x)
        if not tokens:
            return
        size = [len(t) for t in tokens]
        t, x = np.concatenate(tokens), np.concatenate(local)
        tokens.clear()
        local.clear()
        order = np.argsort(t)
        s = t[order]
        heads = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        weight = np.where(x & MANY, x & ~MANY, 1)[order].astype(np.int64)
        total = np.minimum(np.add.reduceat(weight, heads), 2**32 - 1).astype(np.uint32)
        many = np.empty(len(t), np.uint32)
        many[order] = np.repeat(total, np.diff(np.append(heads, len(s))))
        del s, order, weight
        back = many > 1 if frequencies else (many > 1) & (x & MANY == 0)
        at = 0
        for c, n in zip(chunks, size, strict=True):
            keep = np.flatnonzero(back[at : at + n]) + at
            if len(keep):
                yield _rows([(0, c, 1, pack(t[keep], x[keep]) + many[keep].astype("<u4").tobytes())])
            at += n

    return counted


def _gathered(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """For each chunk: its header, and its shared tokens with sets' numbers and frequencies (0 if they weren't asked
    for), by set. The rows come sorted by chunk, so one chunk is held at a time."""
    chunk, header, several, found = None, b"", None, []

    def done():
        parts = [(t, x, f) for t, x, f in found if len(t)]
        t, x, f = (np.concatenate(col) for col in zip(*parts, strict=True)) if parts else (np.zeros(0, _U), np.zeros(0, np.uint32), np.zeros(0, np.uint32))
        if several is not None:
            t2, x2 = several
            told = (x & MANY) != 0
            names, rates = t[told], f[told]
            by = np.argsort(names)
            f2 = rates[by][np.searchsorted(names[by], t2)] if len(names) else np.zeros(len(t2), np.uint32)
            t, x, f = np.concatenate([t[~told], t2]), np.concatenate([x[~told], x2]), np.concatenate([f[~told], f2])
        order = np.lexsort((t, x))
        return header, t[order], x[order], f[order]

    for batch in it:
        for c, kind, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            if c != chunk:
                if chunk is not None:
                    yield done()
                chunk, several, found = c, None, []
            raw = blob.as_py()
            if kind == 0:
                header = raw
            elif kind == 2:
                several = unpack(raw)
            else:
                t, x = unpack(raw)
                found.append((t, x, np.frombuffer(raw, "<u4", len(t), 4 + 10 * len(t))))
    if chunk is not None:
        yield done()


def _route(df: DataFrame, mapper, schema_out: str, gather, parts: int, frequencies: bool) -> DataFrame:
    """Chunks out to the parts of the token space and back."""
    sent = df.mapInArrow(released(mapper), ROUTED).repartition(parts, "part").mapInArrow(released(_counter(frequencies)), ROUTED)
    return sent.repartition(parts, "chunk").sortWithinPartitions("chunk").mapInArrow(released(gather), schema_out)


def _parts(df: DataFrame, size: Column) -> int:
    """Tasks for the rows of df, `size` bytes each, PART_BYTES to a task."""
    return max(1, -(-(df.agg(F.sum(size)).first()[0] or 0) // PART_BYTES))


def _chunk_ids() -> Iterator[int]:
    k = TaskContext.get().partitionId() << 32
    while True:
        yield k
        k += 1


def shared_sets(docs: DataFrame, size: int, least: int, per: int) -> DataFrame:
    """docs: (doc_id, text, mark), mark 16 bytes or null. (doc_id, mark, n, key, tokens): n tokens, the set's digest
    (null for none), and, where the set can have a partner, its shared tokens as u64."""
    parts = _parts(docs, F.octet_length("text") + 50)

    def mapper(it):
        ids, shingler = _chunk_ids(), Shingler(size)
        sets: list[np.ndarray] = []
        head: list[tuple] = []
        held = 0

        def done():
            header = np.uint32(len(sets)).tobytes() + b"".join(
                [
                    np.array([d or 0 for d, *_ in head], "<i8").tobytes(),
                    np.array([d is None for d, *_ in head], np.uint8).tobytes(),
                    np.array([n for _, _, n, _ in head], "<u4").tobytes(),
                    b"".join(m or bytes(16) for _, m, *_ in head),
                    b"".join(k for *_, k in head),
                ]
            )
            yield from _routed(next(ids), sets, header, parts)

        for batch in it:
            for d, t, m in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = t.as_py() or ""
                hashes = shingler.tokens(text)
                head.append((d, m, len(hashes), hashlib.blake2b(hashes.astype("<u8").tobytes(), digest_size=16).digest()))
                sets.append(np.unique(hashes >> _U(64 - BITS)))
                held += len(text) + 50
                if held > CHUNK_CHARS:
                    yield from done()
                    sets.clear()
                    head.clear()
                    held = 0
        if sets:
            yield from done()

    kinds = pa.schema([("doc_id", pa.int64()), ("mark", pa.binary()), ("n", pa.int64()), ("key", pa.string()), ("tokens", pa.binary())])

    def gather(it):
        for header, t, x, _ in _gathered(it):
            k = int(np.frombuffer(header, "<u4", 1)[0])
            doc = np.frombuffer(header, "<i8", k, 4)
            null = np.frombuffer(header, np.uint8, k, 4 + 8 * k).astype(bool)
            n = np.frombuffer(header, "<u4", k, 4 + 9 * k).astype(np.int64)
            marks, keys = header[4 + 13 * k :], header[4 + 29 * k :]
            cut_at = np.searchsorted(x, np.arange(k + 1))
            live = (n > 0) & (np.diff(cut_at) >= overlap(n, least, per))
            for a in range(0, k, 500):
                part = range(a, min(a + 500, k))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc[a : a + 500], mask=null[a : a + 500]),
                        pa.array([marks[16 * i : 16 * i + 16] for i in part], pa.binary()),
                        pa.array(n[a : a + 500]),
                        pa.array([keys[16 * i : 16 * i + 16].hex() if n[i] else None for i in part], pa.string()),
                        pa.array([t[cut_at[i] : cut_at[i + 1]].astype("<u8").tobytes() if live[i] else None for i in part], pa.binary()),
                    ],
                    schema=kinds,
                )

    return _route(docs, mapper, "doc_id long, mark binary, n long, key string, tokens binary", gather, parts, False)


def signatures(n: int, tokens: np.ndarray, count: np.ndarray, least: int, per: int, rare: int = RARE) -> np.ndarray:
    """Signatures of a set of n tokens, given those that it shares and their frequencies."""
    low = overlap(n, least, per)
    order = np.lexsort((tokens, count))
    out = []
    # linked sets meet in the bucket of the larger one, which may be any from the set's own to its largest partner's
    for bucket in range(n.bit_length() - 1, (n * per // least).bit_length()):
        classes = 0 if bucket < 2 else max(1, int((1 << bucket) * (1 - least / per)) // 8)
        # as many tokens must be common to any two that meet here
        if overlap(1 << bucket, least, per) < classes + 1:
            classes = 0
        take = order[: max(0, len(tokens) - low + classes + 1)]
        t, alone = tokens[take], (count[take] <= rare) | (classes == 0)
        salt = _U((bucket + 1) * 0xD6E8FEB86659FD93 % 2**64)
        out.append(mix(t[alone] ^ salt))
        t = t[~alone]
        if len(t) > 1:
            part = mix(t) % _U(classes)
            by = np.lexsort((t, part))
            t, part = t[by], part[by]
            ends = np.flatnonzero(np.append(part[1:] != part[:-1], True)) + 1
            for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                if b - a > 1:
                    i, j = np.triu_indices(b - a, 1)
                    out.append(mix(mix(t[a:b][i] + salt) + t[a:b][j]))
    return np.unique(np.concatenate(out))


def class_signatures(classes: DataFrame, least: int, per: int) -> DataFrame:
    """classes: (cid, n, tokens). Those that can still have a partner among the others, with their shared tokens
    and signatures, both as u64."""
    parts = _parts(classes, F.octet_length("tokens") + 50)

    def mapper(it):
        ids = _chunk_ids()
        cid, n, sets, held = [], [], [], 0

        def done():
            header = np.uint32(len(cid)).tobytes() + np.array(cid, "<i8").tobytes() + np.array(n, "<i8").tobytes()
            yield from _routed(next(ids), sets, header, parts)

        for batch in it:
            for c, k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                cid.append(c)
                n.append(k)
                sets.append(np.frombuffer(raw.as_py(), "<u8"))
                held += len(sets[-1]) + 20
                if held > CHUNK_TOKENS:
                    yield from done()
                    cid, n, sets, held = [], [], [], 0
        if cid:
            yield from done()

    kinds = pa.schema([("cid", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary()), ("signatures", pa.binary())])

    def gather(it):
        for header, t, x, f in _gathered(it):
            k = int(np.frombuffer(header, "<u4", 1)[0])
            cid, n = np.frombuffer(header, "<i8", k, 4), np.frombuffer(header, "<i8", k, 4 + 8 * k)
            cut_at = np.searchsorted(x, np.arange(k + 1))
            live = np.flatnonzero(np.diff(cut_at) >= overlap(n, least, per))
            spans = [slice(cut_at[i], cut_at[i + 1]) for i in live]
            for a in range(0, len(live), 500):
                part = range(a, min(a + 500, len(live)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(cid[live[part]]),
                        pa.array(n[live[part]]),
                        pa.array([t[spans[i]].astype("<u8").tobytes() for i in part], pa.binary()),
                        pa.array([signatures(int(n[live[i]]), t[spans[i]], f[spans[i]], least, per).tobytes() for i in part], pa.binary()),
                    ],
                    schema=kinds,
                )

    return _route(classes, mapper, "cid long, n long, tokens binary, signatures binary", gather, parts, True)


EDGES = "a long, b long"
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _star(sig: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, the smallest of each one's sets, edges of that set with the others)."""
    order = np.lexsort((who, sig))
    sig, who = sig[order], who[order]
    heads = np.concatenate([[True], sig[1:] != sig[:-1]])
    first = who[np.maximum.accumulate(np.where(heads, np.arange(len(sig)), 0))]
    return sig[heads], who[heads], np.unique(np.stack([first, who], 1)[first != who], axis=0)


def star_edges(signed: DataFrame) -> DataFrame:
    """(a, b): edges that connect the classes of each signature. Classes that meet in a batch become a star there, and
    only its centre goes on, so a signature that all classes have is a row for each batch."""
    parts = _parts(signed, 2 * F.octet_length("signatures"))

    def mapper(it):
        for batch in it:
            lists = [np.frombuffer(x.as_py(), _U) for x in batch.column(1)]
            if not lists:
                continue
            sig, who, pairs = _star(np.concatenate(lists), np.repeat(np.asarray(batch.column(0)), [len(x) for x in lists]))
            part = (sig % _U(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[order], np.arange(parts + 1))
            out = [(p, 0, 1, sig[s].tobytes() + who[s].astype("<i8").tobytes()) for p in range(parts) if len(s := order[ends[p] : ends[p + 1]])]
            out += [(int(pairs[k, 0]) % parts, 0, 2, pairs[k : k + 50_000].astype("<i8").tobytes()) for k in range(0, len(pairs), 50_000)]
            for some in batches(out, [len(x[3]) for x in out], 4_000_000):
                yield _rows(some)

    def told(pairs):
        for k in range(0, len(pairs), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[k : k + 50_000, 0]), pa.array(pairs[k : k + 50_000, 1])], schema=_EDGES)

    def reducer(it):
        sig, who = [], []
        for batch in it:
            for kind, blob in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                raw = blob.as_py()
                if kind == 2:
                    yield from told(np.frombuffer(raw, "<i8").reshape(-1, 2))
                    continue
                n = len(raw) // 16
                sig.append(np.frombuffer(raw, _U, n))
                who.append(np.frombuffer(raw, "<i8", n, 8 * n))
        if sig:
            yield from told(_star(np.concatenate(sig), np.concatenate(who))[2])

    return signed.select("cid", "signatures").mapInArrow(released(mapper), ROUTED).repartition(parts, "part").mapInArrow(released(reducer), EDGES).distinct()


def signature_lists(signed: DataFrame) -> DataFrame:
    """(id, label): classes by each signature that two or more have."""

    def run(it):
        for batch in it:
            for c, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sig = np.frombuffer(raw.as_py(), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sig), c)), pa.array(sig)], ["id", "label"])

    rows = signed.select("cid", "signatures").mapInArrow(run, "id long, label long")
    several = rows.groupBy(F.col("label").alias("_label")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return rows.join(several, F.col("label") == F.col("_label")).select("id", "label")


def linked(n: np.ndarray, sets: list[np.ndarray], least: int, per: int) -> list[tuple[int, int]]:
    """A forest of links that spans the components of the given sets: positions of each two. A set that was
    reached counts its common tokens with all unreached ones at once, over the lists of its tokens."""
    m = len(sets)
    todo = np.arange(m)
    out: list[tuple[int, int]] = []
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, code = np.unique(tokens, return_inverse=True)
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    reached = np.zeros(m, bool)

    def index(alive):
        keep = alive[owner]
        by = np.argsort(code[keep], kind="stable")
        return owner[keep][by], np.searchsorted(code[keep][by], np.arange(code.max() + 2))

    members, starts = index(~reached)
    indexed = m
    for root in todo:
        if reached[root]:
            continue
        reached[root] = True
        front = [root]
        while front:
            x = front.pop()
            left = m - int(reached.sum())
            if left == 0:
                return out
            if left < indexed // 2:
                members, starts = index(~reached)
                indexed = left
            mine = code[bounds[x] : bounds[x + 1]]
            a, b = starts[mine], starts[mine + 1]
            size = b - a
            if size.sum() == 0:
                continue
            flat = np.repeat(a - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            common = np.bincount(members[flat], minlength=m)
            hit = np.flatnonzero(~reached & (common * (per + least) >= least * (n[x] + n)) & (common > 0))
            reached[hit] = True
            out += [(int(x), int(y)) for y in hit]
            front += hit.tolist()
    return out


def _blocks(signed: DataFrame, clusters: DataFrame) -> DataFrame:
    """clusters with the number of blocks that each one's sets make."""
    sized = clusters.join(signed.select("cid", F.octet_length("tokens").alias("_bytes")), F.col("id") == F.col("cid"))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("_bytes") / (8 * BLOCK_TOKENS))).cast("int")
    plan = sized.groupBy(F.col("label").alias("_label")).agg(blocks.alias("_blocks"))
    return clusters.join(plan, F.col("label") == F.col("_label")).select("id", "label", "_blocks")


def verified_links(signed: DataFrame, clusters: DataFrame, least: int, per: int) -> DataFrame:
    """(a, b): links that span the exact components within each candidate component. signed: (cid, n, tokens,
    signatures); clusters: (id, label). A component that exceeds a block is dealt by hash into blocks; each two
    blocks, and so each two sets, meet in one task. One of more than LISTED blocks is replaced by the lists of its
    signatures, as linked sets share one, and its sets would otherwise travel once for each other block."""
    placed = cut(_blocks(signed, clusters))
    large = placed.filter(F.col("_blocks") > LISTED)
    if not large.isEmpty():
        lists = signature_lists(signed.join(large.select("id"), F.col("cid") == F.col("id"), "left_semi"))
        placed = cut(placed.filter(F.col("_blocks") <= LISTED).unionByName(_blocks(signed, cut(lists))))
    copies = F.greatest(F.col("_blocks") - 1, F.lit(1))
    parts = _parts(signed.join(placed, F.col("cid") == F.col("id")), copies * (F.octet_length("tokens") + 50))
    rows = signed.join(placed, F.col("cid") == F.col("id")).withColumn("_mine", F.pmod(F.xxhash64("cid"), F.col("_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.greatest(F.col("_blocks") - 2, F.lit(0))))
    # with two blocks or more, a block meets each other one; a single block is its own
    rows = rows.withColumn("_k", other).withColumn("_other", F.when(F.col("_blocks") == 1, 0).when(F.col("_k") >= F.col("_mine"), F.col("_k") + 1).otherwise(F.col("_k")))
    rows = rows.select("label", F.least("_mine", "_other").alias("_i"), F.greatest("_mine", "_other").alias("_j"), "cid", "n", "tokens")
    dealt = rows.repartition(parts, "label", "_i", "_j").sortWithinPartitions("label", "_i", "_j")

    def verify(it):
        group, cid, n, sets = None, [], [], []

        def done():
            pairs = linked(np.array(n, np.int64), sets, least, per) if len(cid) > 1 else []
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([cid[x] for x, _ in pairs], pa.int64()), pa.array([cid[y] for _, y in pairs], pa.int64())], schema=_EDGES)

        for batch in it:
            for label, i, j, c, k, raw in zip(*[batch.column(q).to_pylist() for q in range(6)], strict=True):
                if (label, i, j) != group:
                    yield from done()
                    group, cid, n, sets = (label, i, j), [], [], []
                cid.append(c)
                n.append(k)
                sets.append(np.frombuffer(raw, "<u8"))
        yield from done()

    return dealt.mapInArrow(released(verify), EDGES)


def _found(docs: DataFrame, size: int, least: int, per: int) -> DataFrame:
    """docs: (doc_id, text, mark). (doc_id, mark, n, component) of each row."""
    if not 0 < least <= per or size < 1:
        raise ValueError("the similarity must be above 0 and not above 1, and a shingle needs a word")
    sets = cut(shared_sets(docs, size, least, per))
    known = cut(sets.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_rows")))
    classes = sets.filter("tokens is not null").groupBy("key").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()))
    signed = cut(class_signatures(classes.select("cid", "n", "tokens"), least, per))
    clusters = components(star_edges(signed))
    label = components(verified_links(signed, clusters, least, per))
    named = cut(classes.select("key", "cid").join(known, "key").join(label, F.col("cid") == F.col("id")).select("key", "label", "_first"))
    least_id = named.groupBy("label").agg(F.min("_first").alias("_least"), F.count(F.lit(1)).alias("_n"))
    joined = look_up(named.select("key", "label"), "label", least_id.drop("_n"), _hot(least_id, "label", "_n"))
    joined = joined.select(F.col("key").alias("_key"), "_least")
    by_key = known.join(joined, F.col("key") == F.col("_key"), "left").select("key", F.coalesce("_least", "_first").alias("_component"))
    out = look_up(sets.drop("tokens"), "key", by_key, _hot(known, "key", "_rows"))
    return out.select("doc_id", "mark", "n", F.coalesce("_component", "doc_id").alias("component"))


def _hot(counted: DataFrame, key: str, rows: str) -> DataFrame:
    """The keys that more than one of HOT rows have."""
    total = counted.agg(F.sum(rows)).first()[0] or 0
    return counted.filter(F.col(rows) * HOT > total).select(key)


def jaccard_components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, least: int = LEAST, per: int = PER) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of df; doc_id is cast to long."""
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.lit(None).cast("binary").alias("mark"))
    return _found(docs, size, least, per).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_first(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, least: int = LEAST, per: int = PER) -> DataFrame:
    """The rows of df whose doc_id is their component's id; of rows with equal doc_id and text one. Rows without a
    doc_id stay, once for each text, if nothing in their component has one. Repeated rows are dropped before the
    one shuffle of the texts, so any number of them makes no large task."""
    i, m, own, mark = fresh(df, "_id", "_mark", "_own", "_text_mark")
    named = df.withColumns({i: F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit("")), m: F.coalesce(F.unhex(F.md5(F.col(text))), F.lit(bytes(16)))})
    docs = named.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(m).alias("mark"))
    found = _found(docs, size, least, per).filter(F.col("doc_id").eqNullSafe(F.col("component")))
    first = found.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(own), F.col("mark").alias(mark)).distinct()
    kept = named.dropDuplicates([i, m]).join(first, (F.col(i) == F.col(own)) & (F.col(m) == F.col(mark)), "left_semi")
    return kept.select(*[F.col(f"`{c}`") for c in df.columns])


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


QUERIES = {"op9_jaccard_join": op9_jaccard_join}
SQL: dict[str, str] = {}
