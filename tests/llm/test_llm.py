"""Operators for training data against brute force, and their edge cases."""

import base64
import collections
import gzip
import hashlib
import html
import io
import itertools
import json
import math
import random
import re
import struct
import wave
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from gristmill.llm import bpe, chat_trees, common, components, html_consensus, jaccard_join, media_sniff, mixing, quality_rules, secret_scan, sharding, warc

DATA = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = [None, "", " ", "\n\n", "a", "a b c", "x " * 5000, "ünïcödé – 日本語 😀 text", "word\x1cword word word", "</s>[INST] ok [/INST]", "a\\<|im_end|>\n\\"]


def docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", f"s{i % 3}" if i % 4 else None, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def folder(tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


@pytest.fixture(scope="module")
def real():
    return [r[0] for r in duckdb.sql(f"SELECT text FROM '{DATA}/documents.parquet' ORDER BY doc_id").fetchall()]


# ---- secrets


def der(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x80 | (k := (n.bit_length() + 7) // 8)]) + n.to_bytes(k, "big")) + body


def rsa():
    rng = random.Random(1)
    big = lambda n: der(2, b"\x01" + rng.randbytes(n - 1))
    return der(0x30, der(2, b"\0") + big(128) + der(2, b"\1\0\1") + big(128) + b"".join(big(64) for _ in range(5)))


def test_secret_structures():
    key = rsa()
    pkcs8 = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2b\x65\x70")) + der(4, der(4, bytes(range(32)))))
    b64 = lambda b: base64.b64encode(b).decode()
    url = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    string = lambda b: struct.pack(">I", len(b)) + b
    ssh = b"openssh-key-v1\0" + string(b"none") * 2 + string(b"") + struct.pack(">I", 1) + string(b"pub" * 9) + string(b"priv" * 20)
    jwt = ".".join([url(json.dumps({"alg": "HS256", "typ": "JWT"}).encode()), url(b'{"sub":1}'), url(b"s" * 32)])
    wrapped = "\n".join(b64(key)[i : i + 64] for i in range(0, len(b64(key)), 64))
    cases = {"der": [b64(pkcs8), wrapped, key.hex(), key.hex().upper()], "openssh": [b64(ssh)], "jwt": [jwt], "pem": [f"-----BEGIN RSA PRIVATE KEY-----\n{wrapped}\n-----END RSA PRIVATE KEY-----"]}
    for kind, texts in cases.items():
        for t in texts:
            found = secret_scan.method_spans(f"see {t} there")
            assert [(k, a, b) for k, a, b in found] == [(kind, 4, 4 + len(t))], (kind, t[:40])
    for t in (b64(bytes(200)), b64(key[:-9]), key.hex()[:-20], "eyJhIjoxfQ.eyJzdWIiOjF9.c2ln", b64(b"no key, only a long text that happens to be encoded"), "-----BEGIN PRIVATE KEY-----\nabc\n-----END PRIVATE KEY-----"):
        assert secret_scan.method_spans(f"see {t} there") == []


def test_secret_forms():
    key, b64 = rsa(), lambda b: base64.b64encode(b).decode()
    lines = lambda s: [s[i : i + 64] for i in range(0, len(s), 64)]
    pem = "\n".join(["-----BEGIN PRIVATE KEY-----", *lines(b64(key)), "-----END PRIVATE KEY-----", ""])
    whole = pem.strip()
    joined = pem.replace("\n", '\\n" +\n    "').removesuffix('\\n" +\n    "')
    for t in (whole.replace("\n", "\\n"), whole.replace("\n", "\\r\\n"), whole.replace("\n", "\\\\n"), whole.replace("/", "\\/").replace("\n", "\\n"), joined):
        assert secret_scan.method_spans(f'{{"key": "{t}\\n"}}') == [("pem", 9, 9 + len(t))], t[:60]
        assert b64(key)[:40] not in secret_scan.redact(f'{{"key": "{t}\\n"}}')
    inner = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2b\x65\x70")) + der(4, bytes(26)))
    short = next(k for n in range(16, 400) if len(b64(k := der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2b\x65\x70")) + der(4, bytes(n)))).rstrip("=")) % 64 in (2, 3))
    for k in (key, inner, short):
        for sep in ("\n", "\r\n", "\n    ", "\n\t", "\\n", "\\r\\n"):
            t = sep.join(lines(b64(k)))
            assert secret_scan.method_spans(f"see {t} there") == [("der", 4, 4 + len(t))], (sep, len(k))
        for before in ("path/", "a/", "ab/", "abc/", "abcd", "\\n", "x" * 41):
            found = secret_scan.method_spans(f"see {before}{b64(k)} there")
            assert found == [("der", 4 + len(before), 4 + len(before) + len(b64(k)))], (before, len(k))
        assert secret_scan.method_spans(f"see abc{k.hex()} there") == [("der", 7, 7 + 2 * len(k))]
    url = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    jwt = ".".join([url(json.dumps({"alg": "HS256", "typ": "JWT"}).encode()), url(b'{"sub":1}'), url(b"s" * 32)])
    for kind, plain in (("jwt", jwt), ("pem", whole), ("pem", json.dumps({"type": "service_account", "private_key": pem}))):
        t = b64(plain.encode())
        assert secret_scan.method_spans(f"see {t} there") == [(kind, 4, 4 + len(t))], plain[:40]
    assert secret_scan.method_spans(f"see {jwt.encode().hex()} there") == [("jwt", 4, 4 + 2 * len(jwt))]
    for t in (b64(random.Random(2).randbytes(20000)), b64(der(0x30, der(0x30, der(6, b"\x2a\x86\x48") + der(5, b"")) + der(3, bytes(200)))), "\\n".join(lines(b64(key[:-9])))):
        assert secret_scan.method_spans(f"see {t} there") == []


def test_secret_base(real):
    def brute(t):
        kinds = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]
        return [(k, *m.span()) for k, p, g, least in kinds for m in p.finditer(t) if len(m[g]) >= least]

    extra = ['Token:"abcdef1"', "passWord = abc", "api_key=AKIA" + "A" * 16, "AKIAAKIA" + "B" * 12, "deadbeef" * 4 + "g" + "0" * 23, "ſecret=abcdefg", "toKen=abcdefg", "secret==x====="]
    for t in real + extra:
        assert sorted(secret_scan.base_spans(t or "")) == sorted(brute(t or ""))


def test_secret_query(spark, tmp_path):
    texts = [*EDGES, 'token = "abcdef123456"', 'token = "abcdef123456"']
    rows = {r.doc_id: r for r in secret_scan.op1_secret_scan(spark, folder(tmp_path, documents=docs(spark, texts))).collect()}
    assert len(rows) == len(texts) and rows[0].spans == "" and rows[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert rows[len(EDGES)].spans == "assign:0:21" and rows[len(EDGES)].n_assign == 1
    assert rows[len(EDGES)].base_sha256 == hashlib.sha256(b"assign:0:21").hexdigest()
    fixed = secret_scan.redact_secrets(docs(spark, [None, 'a token = "abcdef123456" b'])).orderBy("doc_id").collect()
    assert fixed[0].text is None and fixed[1].text == 'a [SECRET]" b'
    assert secret_scan.find_secrets(docs(spark, []), out="lang").count() == 0


# ---- quality


def brute_quality(t):
    w = WORDS.findall(t or "")
    grams = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    longest = 0
    for i in range(len(w)):
        for j in range(i + 1, len(w)):
            if w[i] == w[j] and (i == 0 or w[i - 1] != w[j - 1]):
                k = 0
                while j + k < len(w) and w[i + k] == w[j + k]:
                    k += 1
                longest = max(longest, k)
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cover), longest if longest >= 8 else 0)


def test_quality(real):
    rng = random.Random(3)
    made = [" ".join(rng.choice("ab") for _ in range(n)) for n in (7, 8, 9, 40, 120)] + ["p q r s t u v w\n" * 3, " ".join(map(str, range(60))) + " x " + " ".join(map(str, range(60)))]
    texts = [t or "" for t in [*real[:40], *made, *(e for e in EDGES if len(e or "") < 1000)]]
    got = [tuple(r[f] for f in quality_rules._FIELDS) for r in quality_rules.analyse(texts)]
    for t, g in zip(texts, got, strict=True):
        assert g == brute_quality(t), t[:60]
    seq = np.array([rng.randrange(3) for _ in range(300)])
    order, lcp = quality_rules.suffix_array(seq)
    assert list(order) == sorted(range(300), key=lambda i: list(seq[i:]))
    for a, b, k in zip(order[:-1], order[1:], lcp[1:], strict=True):
        assert list(seq[a : a + k]) == list(seq[b : b + k]) and list(seq[a : a + k + 1]) != list(seq[b : b + k + 1])
    assert quality_rules.repeats("a b c d e f g h x a b c d e f g h y") == [(8, [0, 9])]


def test_maximal_repeats():
    rng = random.Random(7)
    for _ in range(200):
        w = [rng.choice("abc") for _ in range(rng.randrange(40))]
        spots = collections.defaultdict(list)
        for i, j in itertools.combinations(range(len(w) + 1), 2):
            spots[tuple(w[i:j])].append(i)
        side = lambda s, p, k: {w[i + k] if 0 <= i + k < len(w) else None for i in p}
        want = [(len(s), p) for s, p in spots.items() if len(s) > 1 and len(p) > 1 and len(side(s, p, len(s))) > 1 and len(side(s, p, -1)) > 1]
        assert sorted(quality_rules.repeats(" ".join(w), 2)) == sorted(want)
    assert quality_rules.repeats(None) == quality_rules.repeats("") == []
    for t, n in (("x " * 200_000, 199_999), ("x y " * 100_000, 199_998)):
        (q,) = quality_rules.analyse([t])
        assert q["longest_repeat"] == n and q["n_repeat_words"] == q["n_words"]


def test_quality_query(spark, tmp_path):
    clean = " ".join(f"w{i}" for i in range(400))
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [*EDGES, clean, passage + " " + " ".join(f"z{i}" for i in range(300)) + " " + passage]
    rows = {r.doc_id: r for r in quality_rules.op2_quality_rules(spark, folder(tmp_path, documents=docs(spark, texts))).collect()}
    assert rows[0].base_failed and not rows[0].kept and rows[len(EDGES)].kept
    assert not rows[len(EDGES) + 1].base_failed and not rows[len(EDGES) + 1].kept
    left = quality_rules.filter_quality(docs(spark, texts).withColumn("_quality", F.lit(1)))
    assert [r.doc_id for r in left.collect()] == [len(EDGES)] and "_quality" in left.columns


# ---- mixing


def test_mixing(spark, tmp_path):
    rng = random.Random(5)
    texts = [None if i % 50 == 0 else " ".join("w" * rng.randrange(1, 40)) for i in range(600)]
    df = docs(spark, texts).withColumn("source", F.when(F.col("doc_id") < 300, "a").when(F.col("doc_id") < 590, "c").when(F.col("doc_id") < 595, "B"))
    rows = mixing.op3_source_mix(spark, folder(tmp_path, documents=df)).collect()
    size = {i: len(WORDS.findall(t or "")) for i, t in enumerate(texts)}
    total, by = sum(size.values()), collections.defaultdict(int)
    source = {i: "a" if i < 300 else "c" if i < 590 else "B" if i < 595 else None for i in size}
    for i, n in size.items():
        by[source[i]] += n
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    capped: set = set()
    while True:  # the excess is shared again until none is above
        level = (total - sum(3 * by[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        above = {s for s in order if s not in capped and weight[s] * level > 3 * by[s]}
        if not above:
            break
        capped |= above
    want = {s: 3 * by[s] if s in capped else weight[s] * level for s in order}
    taken = collections.Counter()
    for r in rows:
        assert r.size == size[r.doc_id] and r.source_size == by[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]]) and 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    assert len(rows) == 600 and sum(want.values()) == pytest.approx(total)
    for s in order:
        assert abs(taken[s] - want[s]) <= max(size[i] for i in size if source[i] == s)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.op3_source_mix(spark, str(tmp_path)).collect()))
    copies = collections.Counter(r.doc_id for r in mixing.apply_mix(df).collect())
    assert all(copies[r.doc_id] == r.taken // r.size for r in rows if r.size)


def test_mixing_edges(spark):
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.apply_mix(docs(spark, [])).count() == 0
    same = docs(spark, ["a b", "a b", None], [1, 1, None])
    assert mixing.mix(same).count() == 3
    texts = [f"w{i % 7} " * (5 + i % 3) for i in range(60)]
    names = {c: F.lit(c) for c in ("_n", "_d", "_s", "_z", "_nth", "_number", "_hash", "_rank", "_name", "_copies", "copies", "size", "target")}
    given = docs(spark, texts, [i // 4 for i in range(60)]).withColumns(names)
    got = mixing.apply_mix(given)
    assert got.columns == given.columns and all(r[c] == c for r in got.collect() for c in names)
    again = mixing.apply_mix(given.repartition(3))
    assert sorted(map(str, again.collect())) == sorted(map(str, got.collect()))
    assert got.groupBy("text", "doc_id").count().agg(F.max("count")).first()[0] <= 3 * 4


def test_mixing_small_sources(spark, monkeypatch):
    """Sources of a few documents come near their targets, whether they are folded or share the rest."""
    rng = random.Random(8)
    rows = [(k, "w " * max(1, int(rng.lognormvariate(5, 1))), "en", f"s{k % 12}", 0) for k in range(12 * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for head, most in ((256, 0.02), (5, 0.25)):
        monkeypatch.setattr(mixing, "HEAD", head)
        for r in mixing.mix(df).groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("copies") * F.col("size")).alias("x")).collect():
            assert abs(r.x - r.t) <= most * r.t, (head, r)


# ---- media


def test_media_formats():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
    gif = b"GIF89a\1\0\1\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\1\0\1\0\0\2\2D\1\0;"
    jpeg = b"\xff\xd8\xff\xe0\0\4ab\xff\xc0\0\5abc\xff\xda\0\4ab12\xff\x0034\xff\xd9"
    bmp = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0\0\0\0"
    mp4 = b"\0\0\0\x10ftypisom\0\0\0\0" + b"\0\0\0\x08moov"
    sound = media_sniff.wav(b"\x80" * 10)
    for data, kind in ((png, "image/png"), (gif, "image/gif"), (jpeg, "image/jpeg"), (bmp, "image/bmp"), (mp4, "video/mp4"), (sound, "audio/wav")):
        assert media_sniff.sniff(data) == [(0, len(data), kind)]
        assert media_sniff.sniff(b"junk" + data + b"tail")[0] == (4, len(data), kind)
        assert media_sniff.sniff(data[:-1]) == [] or kind == "video/mp4"
    crc = lambda d, bits, poly: __import__("functools").reduce(lambda r, x: ((r << 8) & (2**bits - 1)) ^ media_sniff._crc_table(bits, poly)[(r >> (bits - 8)) ^ x], d, 0)
    head = lambda k: (h := bytes([0xFF, 0xF8, 0x60, 0x02, k, 15])) + bytes([crc(h, 8, 0x07)])
    frame = lambda k: (f := head(k) + bytes([0, k])) + crc(f, 16, 0x8005).to_bytes(2, "big")
    for known in (48, 0):
        flac = b"fLaC" + b"\x80\0\0\x22" + bytes(13) + known.to_bytes(5, "big") + bytes(16) + frame(0) + frame(1) + frame(2)
        assert media_sniff.sniff(b"junk" + flac + b"between" + png) == [(4, len(flac), "audio/flac"), (11 + len(flac), len(png), "image/png")]
    assert media_sniff.sniff(b"fLaC" + b"\x80\0\0\x22" + bytes(13) + (48).to_bytes(5, "big") + bytes(16) + frame(0) + frame(1)[:-1]) == []
    broken = bytearray(png)
    broken[40] ^= 1
    assert media_sniff.sniff(bytes(broken)) == []


def test_media(spark, tmp_path):
    rows = {r.doc_id: r for r in media_sniff.op4_media_sniff(spark, folder(tmp_path, documents=docs(spark, EDGES))).collect()}
    for i, t in enumerate(EDGES):
        raw = (t or "").encode()
        want = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
        held = io.BytesIO()
        with wave.open(held, "wb") as w:
            w.setparams((1, 1, 8000, 0, "NONE", ""))
            w.writeframes(want)
        assert (r.media_bytes, r.media_sha256) == (len(held.getvalue()), hashlib.sha256(held.getvalue()).hexdigest())
        told = dict(x.split("=") for x in r.feature.split(";"))
        p = [n / len(want) for n in collections.Counter(want).values()]
        assert (told["declared"], told["type"], told["embedded"], int(told["samples"])) == ("application/octet-stream", "audio/wav", "none", len(want))
        assert float(told["mean"]) == pytest.approx(sum(want) / len(want), abs=1e-4) and float(told["entropy"]) == pytest.approx(-sum(x * math.log2(x) for x in p), abs=1e-4)
        assert float(told["rms"]) == pytest.approx(math.sqrt(sum((x - 128) ** 2 for x in want) / len(want)), abs=1e-4)
        assert int(told["crossings"]) == sum((a >= 128) != (b >= 128) for a, b in zip(want, want[1:], strict=False))
    m = spark.createDataFrame([(1, bytearray(b"xx" + media_sniff.wav(b"\x80" * 8)), "image/png"), (2, None, None)], "i int, b binary, t string")
    out = media_sniff.sniff_media(m, "b", "t")
    assert [r.sniffed.type for r in out.orderBy("i").collect()] == ["image/png", None]
    assert bytes(media_sniff.carve(out, "b").first().carved.bytes) == media_sniff.wav(b"\x80" * 8)


# ---- shards


def test_shards(spark, tmp_path):
    rows = sharding.op5_jump_shards(spark, folder(tmp_path, documents=docs(spark, [*EDGES, *map(str, range(500)), "dup", "dup"], [*range(len(EDGES) + 500), 7, None]))).collect()

    def jump(key, n):
        m = 2**64 - 1
        z = key & m
        z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 & m
        z = (z ^ (z >> 27)) * 0x94D049BB133111EB & m
        z ^= z >> 31
        b, j = -1, 0
        while j < n:
            b = j
            z = (z * 2862933555777941757 + 1) & m
            j = int((b + 1) * (2.0**31 / ((z >> 33) + 1)))
        return b

    slots = collections.defaultdict(list)
    for r in rows:
        if r.doc_id is not None:
            assert r.shard == jump(r.doc_id, 16) and r.grown_shard == jump(r.doc_id, 17)
        assert r.grown_shard in (r.shard, 16)
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and len(rows) == len(EDGES) + 502
    by = {r.doc_id: r for r in rows if r.doc_id != 7}
    assert by[0].size == 1 and by[0].text_crc32 == 0 and by[7 + 1].text_crc32 == zlib.crc32(EDGES[8].encode())


def test_ranks(spark):
    """Ranks are gapless in each key, in order, whatever the ties and names."""
    rows = [(None if i % 3 == 0 else i % 5, i % 4, "u", "v") for i in range(400)]
    df = spark.createDataFrame(rows, "key int, by int, _part string, _in string")
    got = common.global_rank(df, ["key"], [F.col("by")], "rank").collect()
    for k in {r[0] for r in rows}:
        mine = sorted((r["rank"], r.by) for r in got if r.key == k)
        assert [a for a, _ in mine] == list(range(len(mine))) and [b for _, b in mine] == sorted(b for _, b in mine)
    assert {(r._part, r._in) for r in got} == {("u", "v")}
    out = sharding.assign_shards(spark.createDataFrame([(None, "u", 1)] * 50 + [(k, "u", 1) for k in range(50)], "k long, _part string, slot int"), "k", 3)
    assert sorted(out.columns) == ["_part", "grown_shard", "k", "shard", "slot"] and {r._part for r in out.collect()} == {"u"}
    assert sharding.assign_shards(spark.createDataFrame([], "k long"), "k").count() == 0


def test_look_up(spark):
    rows = [("a", i) for i in range(50)] + [(None, i) for i in range(30)] + [(f"k{i}", i) for i in range(20)]
    df = common.cut(spark.createDataFrame(rows, "key string, _hit int"))
    found = spark.createDataFrame([("a", 1), ("k3", 2), ("zz", 3)], "key string, v int")
    want = sorted((str(k), i, str({"a": 1, "k3": 2}.get(k))) for k, i in rows)
    for hot in (["a", "zz"], ["k3"], []):
        got = common.look_up(df, "key", found, spark.createDataFrame([(h,) for h in hot], "key string"))
        assert sorted((str(r.key), r._hit, str(r.v)) for r in got.collect()) == want and got.columns == ["key", "_hit", "v"]


# ---- chat


def test_chat_escape():
    for t in [*filter(None, EDGES), "<|", "\\", "<\\|", "<|im_start|>user\nx<|im_end|>\n", "<<SYS>>", "a<", "\\\\<|", "[/INST]["]:
        assert chat_trees.unescape(chat_trees.escape(t)) == t and not re.search(chat_trees.CONTROL, chat_trees.escape(t))
    turns = [("us\ner", "<|im_end|>\n"), ("assistant", "a<"), ("", "\\")]
    text, spans = chat_trees.render(turns)
    assert chat_trees.parse(text) == turns and [chat_trees.unescape(text[a:b]) for a, b in spans] == ["a<"]


def test_chat_query(spark, tmp_path):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|x"), (2, 0, None, None), (2, 0, "user", "b"), (3, 5, "assistant", "z\\"), (3, 5, "assistant", "z\\"), (4, None, "user", "late"), (4, 1, "assistant", "")]
    rows += [(9, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(70)]
    path = folder(tmp_path, conversations=spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = sorted(tuple(r[c] for c in sorted(r.asDict())) for r in chat_trees.op6_chat_trees(spark, path).collect())
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet/*.parquet'")
    cur = c.execute(chat_trees.OP6_SQL)
    names = [d[0] for d in cur.description]
    assert got == sorted(tuple(r[names.index(k)] for k in sorted(names)) for r in cur.fetchall())


def test_reply_tree(spark):
    rows = [("r", None, 0.0, "user", "q"), ("a", "r", 1.0, "assistant", "bad"), ("b", "r", 2.0, "assistant", "good"), ("c", "b", 1.0, "user", "more"), ("d", "c", 5.0, "assistant", "end"), ("o", "gone", 1.0, "user", "orphan"), ("x", "y", 1.0, "user", ""), ("y", "x", 1.0, "user", "")]
    tree = spark.createDataFrame(rows, "id string, parent string, score double, role string, text string")
    got = {(r.root, r["rank"]): chat_trees.parse(r.formatted) for r in chat_trees.format_trees(tree.withColumn("root", F.col("id")), ["root"], top=2).collect()}
    assert [t for _, t in got["r", 1]] == ["q", "good", "more", "end"] and [t for _, t in got["r", 2]] == ["q", "bad"]
    assert [t for _, t in got["o", 1]] == ["orphan"] and len(got) == 3


# ---- WARC


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/x y", "<p>same</p>"), (2, None, "<p>same</p>"), (5, "http://a", "<p>same</p>"), (5, "http://a", "<p>same</p>"), (7, "u", None), (8, "u", ""), (None, "u", "q\r\n\r\nz"), (9, "http://é.de/ü", "WARC/1.1\r\n\r\né")]
    path = folder(tmp_path, pages=spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = sorted(map(str, warc.op7_warc(spark, path).collect()))
    most: dict = {}
    for p, _, h in rows:
        most[h or ""] = max(most.get(h or "", -1), -1 if p is None else p)
    want = []
    for p, _, h in rows:
        raw = (h or "").encode()
        first = most[h or ""] in (p, -1)
        want.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit", None if first else most[h or ""]))
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert got == sorted("Row(" + ", ".join(f"{k}={v!r}" for k, v in zip(names, w, strict=True)) + ")" for w in want)
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"), least=5)
    files = list((tmp_path / "w").rglob("part-*"))
    seen = [h for f in files for _, h, _ in warc.parse_records(gzip.decompress(f.read_bytes()))]
    assert len(seen) == 3 * len(rows)
    each = [list(warc.parse_records(m)) for f in files for m in warc.members(f.read_bytes())]
    assert len(each) == 3 * len(rows) and all(len(m) == 1 for m in each)  # a member for each record
    with pytest.raises(ValueError):
        list(warc.members(files[0].read_bytes()[:-30]))
    whole = warc.assemble(warc.read_warc(spark, str(tmp_path / "w"), True)).collect()
    assert len(whole) == len(rows) and all(r.request and len(r.metadata) == 1 for r in whole)
    assert sum(r.response.record_type == "revisit" for r in whole) == 2
    with pytest.raises(ValueError):
        list(warc.parse_records(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))
    lone = spark.createDataFrame([("f", 0, "request", "q", "nowhere", None, None, None, None, None, None)], warc.RECORDS)
    assert warc.assemble(lone).first().response is None


def test_warc_volumes(spark, tmp_path, monkeypatch):
    rows = [(i, f"http://h/{i}", ("x" * 500 if i % 3 else f"{i} " * 100)) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    want = sorted(map(str, warc.assemble(warc.read_warc(spark, _written(warc, pages, tmp_path / "a"), True)).select("response.record_type", "response.payload_digest", "metadata").collect()))
    monkeypatch.setattr(warc, "VOLUME_BYTES", 5000)
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", 0)
    got = warc.assemble(warc.read_warc(spark, _written(warc, pages, tmp_path / "b"), True)).select("response.record_type", "response.payload_digest", "metadata")
    drop = lambda s: re.sub(r"offset=\d+|file='[^']*'|record_id='[^']*'", "", s)
    assert sorted(drop(str(r)) for r in got.collect()) == sorted(map(drop, want))
    files = list((tmp_path / "b").rglob("part-*"))
    assert len(files) > 10 and len(list((tmp_path / "a").rglob("part-*"))) == 1
    bad = tmp_path / "c"
    bad.mkdir()
    text = next(warc.capture_records("n", 1, "http://h", "<p>", "A" * 32, None))
    (bad / "x").write_bytes(warc.member(text))
    with pytest.raises(Exception, match="digest"):
        warc.read_warc(spark, str(bad)).collect()


def _written(warc, pages, path):
    warc.write_warc(pages, str(path))
    return str(path)


# ---- BPE


def test_bpe(spark, tmp_path, real):
    import public_tokenizers
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.vocabulary(bpe.default_path()), special_tokens={})
    texts = [*EDGES, *real[:30], "a" * 700, " " * 300, "don't  \n\n stop", "<|endoftext|>"]
    df = docs(spark, texts)
    rows = {r.doc_id: r for r in bpe.op8_byte_bpe(spark, folder(tmp_path, documents=df)).collect()}
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    out = bpe.decode(bpe.encode(df)).orderBy("doc_id").collect()
    assert [bytes(r.decoded).decode() for r in out] == [t or "" for t in texts]
    assert [list(r.ids) for r in out] == [enc.encode_ordinary(t or "") for t in texts]
    told = bpe.tokenize(df).orderBy("doc_id").collect()
    assert all(r.round_trip for r in told) and [list(r.ids) for r in told] == [list(r.ids) for r in out]
    rng, letters = random.Random(9), "abcdefghijklmnopqrstuvwxyz"
    long = ["".join(rng.choice(a) for _ in range(3000)) for a in (letters, "acgt", "ab", "thereinos", "\u4e00\u4e8c\u4e09\u5341\u767e", "é\u0301ñ")]
    long += ["a" * 30_000, "ab" * 1500 + "a", base64.b64encode(rng.randbytes(3000)).decode(), "=" * 1003, " " * 3001, "-_" * 400, rng.randbytes(2000).hex()]
    long += ["".join(rng.choice("thieranosgABC"[: rng.randrange(1, 13)]) for _ in range(rng.randrange(1, 200))) for _ in range(60)]
    words = bpe.words_of(bpe.default_path())
    told = words.encode(long)
    assert [list(map(int, t.split())) for t in told] == list(map(enc.encode_ordinary, long))
    assert [raw.decode() for _, raw in words.decode(told)] == long
    odd = df.withColumns({"_bpe": F.lit(1), "ids": F.lit("x"), "same": F.lit(2)})
    assert {r._bpe for r in bpe.tokenize(odd).collect()} == {1}
    with pytest.raises(Exception, match="vocabulary"):
        bpe.decode(spark.createDataFrame([([60000],)], "ids array<int>")).collect()


# ---- Jaccard join


def brute_join(rows, size=4, least=85):
    sets = []
    for d, t in rows:
        w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    par = list(range(len(rows)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= least * len(a | sets[j]):
                par[find(i)] = find(j)
    first: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            first[find(i)] = min(d, first.get(find(i), d))
    return sorted((str(d), len(s), str(first.get(find(i)))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize("seed,blocks,size,least", [(1, False, 4, 85), (2, True, 4, 85), (3, True, 5, 80)])
def test_jaccard(spark, seed, blocks, size, least, monkeypatch):
    if blocks:
        monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 7)
        monkeypatch.setattr(jaccard_join, "RARE", 1)
    rng = random.Random(seed)
    texts = [None, "", "one two", "one two", "One TWO", "a b c d", "a b c d e"]
    for _ in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice((5, 20, 60, 200)))]
        for _ in range(rng.randrange(1, 12)):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 25))):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    texts += texts[-6:]
    ids = [*range(len(texts) - 2), 3, None]
    got = jaccard_join.jaccard_components(docs(spark, texts, ids).withColumn("n_shingles", F.lit("x")), size=size, least=least).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_join(list(zip(ids, texts, strict=True)), size, least)


@pytest.mark.parametrize("least,size", [(20, 1), (34, 1), (50, 2), (95, 4)])
def test_jaccard_thresholds(spark, least, size, monkeypatch):
    """Links of any similarity, in candidate components that exceed LISTED blocks."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 3)
    monkeypatch.setattr(jaccard_join, "LISTED", 2)
    monkeypatch.setattr(jaccard_join, "PART_BYTES", 20_000)
    monkeypatch.setattr(jaccard_join, "CHUNK_CHARS", 2000)
    rng = random.Random(least)
    texts = [" ".join(f"c{i}" for i in range(400)), " ".join(f"c{i}" for i in range(1000))]
    for _ in range(10):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice((3, 12, 40, 150)))]
        for _ in range(rng.randrange(1, 8)):
            w = base[: rng.randrange(1, len(base) + 1)] + [f"n{rng.randrange(10**6)}" for _ in range(rng.randrange(0, len(base)))]
            texts.append(" ".join(w))
    got = jaccard_join.jaccard_components(docs(spark, texts).repartition(3), size=size, least=least).collect()
    want = brute_join(list(enumerate(texts)), size, least)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want
    assert least > 50 or len({c for *_, c in want}) < len(texts) - 2


def test_keep_first(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(7, text), (3, text), (3, text), (None, text), (3, "other words"), (None, "alone"), (None, "alone"), (None, None), (None, None), (9, ""), (9, ""), (10, "")]
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, _first string, _id int")
    got = jaccard_join.keep_first(df)
    assert got.columns == df.columns and {(r._first, r._id) for r in got.collect()} == {("x", 5)}
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == sorted([("3", text), ("3", "other words"), ("None", "alone"), ("None", "None"), ("9", ""), ("10", "")])
    with pytest.raises(ValueError):
        jaccard_join.keep_first(df, least=0)


@pytest.mark.parametrize("least", [95, 85, 80, 50, 34, 20])
def test_jaccard_signatures_meet(least):
    """Any two linked sets share a signature, whatever the frequencies."""
    rng = random.Random(4)
    for _ in range(300):
        n = rng.choice((1, 2, 3, 5, 9, 30, 70, 130, 300))
        a = set(rng.sample(range(10**6), n))
        b = set(a)
        for _ in range(rng.randrange(0, n * (100 - least) // 110 + 1)):
            b.remove(rng.choice(sorted(b)))
            if rng.random() < 0.5:
                b.add(rng.randrange(10**6, 2 * 10**6))
        if not b or 100 * len(a & b) < least * len(a | b):
            continue
        freq = {t: rng.choice((2, 3, 40, 500)) for t in a | b}
        s = []
        for x in (a, b):
            shared = np.array(sorted(t for t in x if t in a & b or freq[t] > 3), np.uint64)
            s.append(set(jaccard_join.signatures(len(x), shared, np.array([freq[int(t)] for t in shared]), least, 100).tolist()))
        assert s[0] & s[1]


def test_jaccard_empty(spark):
    assert jaccard_join.jaccard_components(docs(spark, [])).count() == 0
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (None, 3)], "a long, b long")
    assert {(r.id, r.label) for r in components.components(chain).collect()} == {(i, 0) for i in range(41)} | {(100, 100)}


# ---- HTML


def test_html(spark, tmp_path):
    page = '<html><body><nav><a href=x>menu</a></nav><div class="c"><div class="post-{n}"><h1>T&amp;{n}</h1><p>Some  text &eacute;<br>here {n} and it goes on for a while</p><script>x="</p>"</script><div class="comments"><p>reader says things at length, longer than the article itself, really</p></div></div></div><aside>side</aside><footer>f</footer></body></html>'
    rows = [(i, "http://h.example/%d" % i, page.replace("{n}", str(i))) for i in range(5)] + [(10, None, "<p>a<p>b"), (11, "http://h.example/z", None), (12, "bad", "plain < text"), (13, "http://h.example/q", "<div><p>unclosed")]
    rows.append(rows[0])
    got = {r.page_id: r for r in html_consensus.op10_html_consensus(spark, folder(tmp_path, pages=spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()}
    assert got[3].text == "T&3\n\nSome text é here 3 and it goes on for a while" and got[3].n_chars == len(got[3].text)
    assert got[10].text == "a\n\nb" and got[11].text == "" and got[12].text == "plain < text" and got[13].text == "unclosed"
    wins = html_consensus.winning_paths(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [(r.host, r.path) for r in wins] == [("h.example", "html/body/div.c/div.post-#")]


def test_html_brute():
    for (h,) in duckdb.sql(f"SELECT html FROM '{DATA}/pages.parquet'").fetchall():
        m = re.search(r"<article>(.*?)</article>", h, re.S)
        parts = re.split(r"</?(?:p|h1)>", m[1])
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", lambda x: " " if x[0] == "<br>" else "", p)).split()) for p in parts]
        assert html_consensus.extract(h, "html/body/article") == "\n\n".join(p for p in want if p)


def test_html_whole_query(spark):
    """Scores, votes, joins and extraction against the markup that all pages share."""
    want = {}
    for k, h in duckdb.sql(f"SELECT page_id, html FROM '{DATA}/pages.parquet'").fetchall():
        m = re.search(r"<article>(.*?)</article>", h, re.S)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", lambda x: " " if x[0] == "<br>" else "", p)).split()) for p in re.split(r"</?(?:p|h1)>", m[1])]
        want[k] = "\n\n".join(p for p in parts if p)
    assert {r.page_id: r.text for r in html_consensus.op10_html_consensus(spark, DATA).collect()} == want


def test_html_hosts(spark, monkeypatch):
    """Consensus by brute force: a page's choice counts for its host, equal votes go to the shorter, then smaller path."""
    p = lambda c, n: f'<div class="{c}"><p>{" ".join(["text of it"] * n)}</p></div>'
    kinds = ["aa", "bb", "ccc"]
    rows = [(i, f"http://h{i % 4}.x/{i}" if i % 9 else None, f'<body><div class="x">{p(kinds[i * i % 3], 30)}</div><ul><li><a href=x>links</a></ul></body>') for i in range(40)]
    rows += [(100, "http://tie.x/a", f"<body>{p('bb', 30)}<hr></body>"), (101, "http://tie.x/b", f"<body>{p('aa', 30)}<hr></body>")]
    df = spark.createDataFrame(rows, "page_id int, url string, html string").withColumns({"_won": F.lit("w"), "_path": F.lit("p"), "main_text": F.lit("old"), "votes": F.lit(1)})
    votes = collections.defaultdict(collections.Counter)
    for _, u, h in rows:
        if u:
            votes[u.split("/")[2]][html_consensus.votes(h)[0][0]] += 1
    want = {k: min(v, key=lambda x: (-v[x], len(x), x)) for k, v in votes.items()}
    assert {r.host: r.path for r in html_consensus.winning_paths(df).collect()} == want and want["tie.x"].endswith("div.aa")
    told = {i: html_consensus.extract(h, want.get(u.split("/")[2]) if u else None) for i, u, h in rows}
    for most in (50_000, 0):
        monkeypatch.setattr(html_consensus, "BROADCAST_HOSTS", most)
        got = html_consensus.extract_main(df).collect()
        assert {r.page_id: r.main_text for r in got} == told and {(r._won, r._path, r.votes) for r in got} == {("w", "p", 1)}


def test_html_broken():
    body = " ".join(["some words of the article"] * 20)
    extract = lambda inner: html_consensus.extract(f"<body><article><p>{body}</p>{inner}</article></body>", None).removeprefix(body).strip()
    for tag in ("svg", "object data=x", "select", "template", "audio", "noscript"):
        assert extract(f"<{tag}><p>{body}</p>") == body  # nothing closes it
    assert extract("<svg><text>a</text></svg><object><p>told</p></object><video>too</video>") == "told\n\ntoo"
    assert extract('<p>so <a href="x title=y>link</a> text</p><p class="b">more "x"</p>') == 'so link text\n\nmore "x"'
    assert extract("<p>1 <a title=\"2 > 1 and 0 < 1\" href='q'>a</a> b") == "1 a b"
    assert extract('<div class="review"><p>a review</p></div>') in ("", "a review")
    assert html_consensus.extract(f'<body><article><div class="review"><p>{body}</p></div></article></body>', None) == body


def test_html_split_articles():
    text = lambda c, n: (c * 9 + " ") * (n // 10)
    want = lambda *parts: "\n\n".join(p.strip() for p in parts)
    one, two, lead = text("a", 800), text("b", 500), text("c", 60)
    extract = lambda h: html_consensus.extract(h, html_consensus.votes(h)[0][0])
    for inner in (f'<div class="a"><p>{one}</div><div class="b"><p>{two}</div>', f'<div class="a"><div class="x"><p>{one}</div></div><div class="b"><p>{two}</div>'):
        page = f'<body><nav>menu</nav><div class="content">{inner}</div><ul><li><a href=x>{lead}</a></ul><footer>foot</footer></body>'
        assert html_consensus.votes(page) == [("body/div.content", html_consensus.SHARE)] and extract(page) == want(one, two)
    for outer in ("article", 'div class="post"'):
        page = f'<body><{outer}><div class="entry"><p>{lead}</p><section><p>{one}</section><section><p>{two}</section><section><p>{one}</section></div></{outer.split()[0]}></body>'
        assert extract(page) == want(lead, one, two, one)
    assert extract(f'<body><article><h1>T</h1><div><p>{one}</div><div><p>{lead}</div></article></body>') == want("T", one, lead)
    assert extract(f'<body><div class="p"><p>{one}</div><div class="p"><p>{two}</div><div class="list"><p><a href=x>{lead}</a></div></body>') == want(one, two)
    assert extract(f'<body><div class="page"><div class="links"><p><a href=x>{lead}</a></div><div class="text"><p>{one}</div></div></body>') == want(one)


def test_html_names():
    body = " ".join(["some words of the article"] * 40)
    extract = lambda h: html_consensus.extract(h, None)
    rest = '<div class="sidebar"><p>side text</p></div><div class="comments"><p>a reader says this</p></div>'
    for name in ("page sidebar-left", "container header-fixed", "wrap menu-open"):
        for tag in ("div", "article"):
            assert extract(f'<body class="x"><div class="{name}"><{tag} class="text"><p>{body}</p></{tag}>{rest}</div></body>') == body
        assert extract(f'<body><div class="header"><p>the site</p></div><div class="{name}"><div class="text"><p>{body}</p></div></div></body>') == body
    assert extract(f'<body><form id="f"><div class="text"><p>{body}</p></div></form></body>') == body
    assert extract(f'<body><div class="post comments-open"><h1>T</h1><p>{body}</p>{rest}</div></body>') == f"T\n\n{body}"
    assert extract(f'<body><div class="cookies"><main><p>{body}</p></main></div></body>') == body
    for anchor in ("discussion", "related-work", "search", "comments"):
        head = f'<h2 id="{anchor}">Part</h2><p>{body}</p>'
        assert extract(f"<body><article><p>{body}</p>{head}</article></body>") == f"{body}\n\nPart\n\n{body}"
        if anchor != "comments":
            assert extract(f'<body><article><p>{body}</p><section id="{anchor}">{head}</section></article></body>') == f"{body}\n\nPart\n\n{body}"
    assert extract("<body><article><p>so <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> holds</p></article></body>") == "so x=1 holds"
    assert extract('<body><div class="comments"><p>only this</p></div></body>') == "only this"
    long = " ".join(["readers say a lot"] * 300)
    assert extract(f'<body><div class="text"><p>{body}</p></div><div class="comments"><article><p>{long}</p></article></div></body>') == body
    assert extract(f'<body><div class="text"><p>short one</p></div><div class="cookie-notice"><p>{body}</p></div><aside>x</aside></body>') == "short one"


# ---- all together


def test_empty_tables(spark, tmp_path):
    path = folder(
        tmp_path,
        documents=docs(spark, []),
        pages=spark.createDataFrame([], "page_id long, url string, html string"),
        conversations=spark.createDataFrame([], "conv_id long, turn long, role string, text string"),
    )
    for name, query in entry.queries().items():
        if name.startswith("op"):
            assert query(spark, path).count() == (name == "op6_chat_trees")
    assert corpus_pipeline.run(spark, path).count() == 0


def test_any_names(spark):
    """Columns of odd names pass through."""
    odd = {c: F.lit(c) for c in ("_part", "_first", "_hash", "_quality", "_spans", "found", "a.b", "key")}
    df = docs(spark, ["a b c", None, 'token = "abcdef123456"']).withColumns(odd)
    for got in (quality_rules.quality_stats(df), secret_scan.redact_secrets(df), bpe.encode(df), media_sniff.sniff_media(df.withColumn("raw", F.encode("text", "UTF-8")), "raw")):
        assert got.count() == 3 and {tuple(r[c] for c in odd) for r in got.collect()} == {tuple(odd)}


def test_oracles(spark):
    c = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    for name, sql in entry.oracle_sql().items():
        if name.startswith("op"):
            df = entry.queries()[name](spark, DATA)
            cols = sorted(df.columns)
            cur = c.execute(sql)
            order = [d[0] for d in cur.description]
            assert sorted(map(str, [tuple(r[k] for k in cols) for r in df.collect()])) == sorted(map(str, [tuple(r[order.index(k)] for k in cols) for r in cur.fetchall()]))


def test_pipeline(spark, tmp_path, real):
    rows = [(i, t) for i, t in enumerate(real)]
    kept = [(i, t) for i, t in rows if (q := brute_quality(t))[0] >= 20 and 100 * q[4] <= 30 * q[0] and (q[5] <= 50 or 10 * q[5] <= q[0])]
    docs_ = spark.read.parquet(f"{DATA}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    one = stage["quality rules"](spark, docs_, DATA)
    assert sorted(r.doc_id for r in one.collect()) == [i for i, _ in kept] and one.columns == docs_.columns
    two = stage["n-gram Jaccard join"](spark, one, DATA)
    assert sorted(r.doc_id for r in two.collect()) == sorted({int(c) for _, _, c in brute_join(kept, 5, 80)}) and two.columns == docs_.columns
    three = stage["secret scans"](spark, two, DATA)
    before, after = {r.doc_id: r for r in two.collect()}, {r.doc_id: r for r in three.collect()}
    assert before.keys() == after.keys() and three.columns == docs_.columns
    for i, r in after.items():
        assert not secret_scan.scan(r.text) and r.n_chars == len(r.text) and (secret_scan.scan(before[i].text) or r.text == before[i].text)
    four = stage["mixing sources"](spark, three, DATA)
    copies = collections.Counter(r.doc_id for r in four.collect())
    mixed = {r.doc_id: r.copies for r in mixing.mix(three).collect()}
    assert copies == {i: n for i, n in mixed.items() if n} and four.columns == docs_.columns
    assert stage["byte-level BPE"](spark, four, DATA).filter("round_trip").count() == sum(copies.values())
    assert corpus_pipeline.run(spark, DATA).count() == sum(copies.values())


def test_components_sizes(spark):
    """Estimated sizes stay bounded, in the rounds and in what follows them: a checkpoint kept a product that had twice
    the digits of the last one, until the driver's memory was full."""
    size = lambda df: df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    chain = spark.range(3000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    first = components.components(chain)
    links = chain.join(first, F.col("a") == F.col("id")).select("a", "b")
    second = components.components(links)
    assert size(first) <= 2**64 and size(second) <= 2**64
    assert second.count() == 3001 and second.filter("label <> 0").isEmpty()


def test_release(monkeypatch):
    """A task gives free memory back once its batches are done, not between them."""
    calls = []
    monkeypatch.setattr(common, "release", lambda: calls.append(1))
    out = common.released(lambda it: (x + 1 for x in it))(iter([1, 2]))
    assert next(out) == 2 and not calls
    assert list(out) == [3] and calls == [1]
