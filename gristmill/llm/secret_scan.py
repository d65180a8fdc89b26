"""Secret scans with structural confirmation.

Base patterns find assignments, access ids and long hex runs. On top of them, base64 and hex candidates are
decoded, and reported only if their bytes parse: DER private keys by their nested lengths, OpenSSH keys by
their length-prefixed strings, PEM blocks by their bodies, and signed tokens by their JSON headers.

Cases: a null text counts as empty and has no spans; equal texts have equal spans; texts of any length are
scanned whole; a column that is already named like the output is replaced.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import table, text_udf

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "der", "openssh", "jwt")
_ORDER = {k: i for i, k in enumerate(KINDS)}

PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----(.*?)-----END \1-----", re.S)
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(e[wy][A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]*)\.([A-Za-z0-9_-]*)(?:\.([A-Za-z0-9_-]*)\.([A-Za-z0-9_-]*))?")
#: A line break, also one that is escaped once or more, with the indentation after it.
BREAK = r"(?:(?:\\+r)?\\+n|\r?\n)[\x20\t]*"
#: Runs of either base64 alphabet, wrapped lines included, padding kept.
BASE64 = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{40,}}(?:{BREAK}[A-Za-z0-9+/_-]{{2,}})*={{0,2}}")
SPACE = re.compile(BREAK)
HEXRUN = re.compile(r"[0-9A-Fa-f]{48,}")
#: Where keys, armour and tokens can start in decoded bytes.
MARK = re.compile(rb"\x30(?=[\x18-\x7f\x81-\x84])|openssh-key-v1\0|-----BEGIN |(?<![A-Za-z0-9_-])e[wy](?=[A-Za-z0-9_-]{8,}\.)")
OPENSSH = b"openssh-key-v1\0"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def tlv(buf: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the content of the DER element at `at`; None unless it lies inside `end`."""
    if at + 2 > end:
        return None
    tag, n, at = buf[at], buf[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end:
            return None
        n, at = int.from_bytes(buf[at : at + k], "big"), at + k
        if n < 0x80 or n >> (8 * (k - 1)) == 0:
            return None  # DER has the shortest form only
    return (tag, at, at + n) if at + n <= end else None


def children(buf: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill start..end exactly, else None."""
    out = []
    while start < end:
        x = tlv(buf, start, end)
        if x is None:
            return None
        out.append(x)
        start = x[2]
    return out


def der_key(buf: bytes) -> int:
    """Length of the private key that buf starts with, 0 if it holds none. Knows RSA, DSA, EC, PKCS#8 (plain
    and encrypted) and PKCS#12; public keys and certificates aren't secrets."""
    top = tlv(buf, 0, len(buf))
    if not top or top[0] != 0x30:
        return 0
    kids = children(buf, top[1], top[2])
    if not kids:
        return 0
    tags, body = [k[0] for k in kids], [buf[a:b] for _, a, b in kids]
    ok = False
    if tags[0] == 2 and body[0] in (b"\0", b"\1", b"\3"):
        if body[0] == b"\3" and tags[1:2] == [0x30]:  # PKCS#12
            ok = (x := children(buf, kids[1][1], kids[1][2])) is not None and len(x) == 2 and x[0][0] == 6 and x[1][0] == 0xA0
        elif len(tags) >= 9 and set(tags[:9]) == {2}:  # RSA: the modulus is the product's size
            ok = len(body[1]) >= 32 and len(body[4]) + len(body[5]) <= len(body[1]) + 3 and max(map(len, body)) <= len(body[1])
        elif len(tags) == 6 and set(tags) == {2}:  # DSA
            ok = len(body[1]) >= 64 and len(body[2]) >= 16
        elif tags[1:3] == [0x30, 4]:  # PKCS#8
            x = children(buf, kids[1][1], kids[1][2])
            ok = bool(x) and x[0][0] == 6 and len(body[2]) >= 16
        elif body[0] == b"\1" and tags[1] == 4:  # EC
            ok = 16 <= len(body[1]) <= 72 and all(t in (0xA0, 0xA1) for t in tags[2:])
    elif tags == [0x30, 4]:  # encrypted PKCS#8: a password scheme's id
        x = children(buf, kids[0][1], kids[0][2])
        oid = buf[x[0][1] : x[0][2]] if x and x[0][0] == 6 else b""
        ok = oid.startswith((b"\x2a\x86\x48\x86\xf7\x0d\x01\x05", b"\x2a\x86\x48\x86\xf7\x0d\x01\x0c\x01")) and len(body[1]) >= 16
    return top[2] if ok else 0


def openssh_key(buf: bytes) -> int:
    """Length of the OpenSSH private key that buf starts with, else 0."""
    if not buf.startswith(OPENSSH):
        return 0
    at = len(OPENSSH)

    def string() -> bytes | None:
        nonlocal at
        n = int.from_bytes(buf[at : at + 4], "big")
        if at + 4 + n > len(buf):
            return None
        at += 4 + n
        return buf[at - n : at]

    if not string() or not string() or string() is None or at + 4 > len(buf):
        return 0
    count, at = int.from_bytes(buf[at : at + 4], "big"), at + 4
    if not 1 <= count <= 16 or any(not string() for _ in range(count)):
        return 0
    return at if string() else 0


def unbase64(s: str) -> bytes:
    s = re.sub(r"\s+|=+$", "", s).replace("-", "+").replace("_", "/")
    s = s[: len(s) - 1] if len(s) % 4 == 1 else s
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4))
    except (binascii.Error, ValueError):
        return b""


def signed_token(m: re.Match) -> int:
    """How many parts the token has: 3 for a JWS (an algorithm), 5 for a JWE (an encryption too), 0 for none."""
    try:
        head = json.loads(unbase64(m[1]))
    except (ValueError, RecursionError):
        return 0
    if not isinstance(head, dict) or not isinstance(head.get("alg"), str) or not head["alg"]:
        return 0
    if isinstance(head.get("enc"), str):
        return 5 * (m[5] is not None)
    return 3 * (bool(m[3]) or head["alg"].lower() == "none")


def pem_key(label: str, body: str) -> bool:
    body = re.sub(r"\\+n", "\n", re.sub(r"\\+r", "", body)).replace("\\/", "/")  # escaped, as in JSON and source
    body = re.sub(r"""["'][\x20\t]*[+.,\\]?\s*["']""", "", body)  # strings of source, joined
    head, _, rest = body.strip().replace("\r", "").partition("\n\n")
    if "Proc-Type:" in head:  # encrypted the old way: whole cipher blocks
        data = unbase64(rest)
        return "DEK-Info:" in head and len(data) >= 32 and len(data) % 8 == 0
    data = unbase64(body)
    return bool(der_key(data) or openssh_key(data))


def method_spans(text: str) -> list[tuple[str, int, int]]:
    """What decodes and parses: (kind, start, end) in code points."""
    found = []
    if "-----BEGIN" in text:
        found += [("pem", *m.span()) for m in PEM.finditer(text) if pem_key(m[1], m[2])]
    for m in TOKEN.finditer(text):
        if parts := signed_token(m):
            found.append(("jwt", m.start(), m.end(parts)))
    blocks = [(a, b) for k, a, b in found if k == "pem"]
    for m in BASE64.finditer(text):
        a, b = m.span()
        if not any(x <= a and b <= y for x, y in blocks):
            found += base64_spans(m[0], a)
    for m in HEXRUN.finditer(text):
        a, b = m.span()
        hits: list[tuple[str, int, int]] = []
        for odd in (0, 1):
            data = bytes.fromhex(m[0][odd : odd + (len(m[0]) - odd) // 2 * 2])
            hits += [(k, a + odd + 2 * x, a + odd + 2 * y) for k, x, y in held(data)]
        found += apart(hits)
    return found


def held(data: bytes) -> list[tuple[str, int, int]]:
    """What secrets the bytes hold, wherever they start: (kind, start, end)."""
    out: list[tuple[str, int, int]] = []
    end, plain = 0, ""
    for m in MARK.finditer(data):
        at = m.start()
        if at < end:
            continue
        if m[0] == b"\x30":
            top = tlv(data, at, len(data))
            n, kind = der_key(data[at : top[2]]) if top and data[top[1] : top[1] + 1] in (b"\2", b"\x30") else 0, "der"
        elif m[0] == OPENSSH:
            n, kind = openssh_key(data[at:]), "openssh"
        else:
            plain = plain or data.decode("latin-1")
            if m[0][:1] == b"-":
                x = PEM.match(plain, at)
                n, kind = x.end() - at if x and pem_key(x[1], x[2]) else 0, "pem"
            else:
                x = TOKEN.match(plain, at)
                n, kind = x.end(parts) - at if x and (parts := signed_token(x)) else 0, "jwt"
        if n:
            end = at + n
            out.append((kind, at, end))
    return out


def apart(hits: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Those that don't overlap, the longest first."""
    out: list[tuple[str, int, int]] = []
    for k, a, b in sorted(hits, key=lambda x: (x[1] - x[2], x[1])):
        if all(b <= x or y <= a for _, x, y in out):
            out.append((k, a, b))
    return out


def base64_spans(raw: str, start: int) -> list[tuple[str, int, int]]:
    """The secrets in a run of base64 that begins at `start`, from whichever letter they are encoded. Encoded
    armour and tokens reach to the ends of the run, as the text around them was encoded with them."""
    lines, at = [], 0
    body = raw.rstrip("=")
    for m in SPACE.finditer(body):
        lines.append((at, m.start()))
        at = m.end()
    lines.append((at, len(body)))
    letters = "".join(body[a:b] for a, b in lines)
    hits = []
    for skip in range(4):
        for k, x, y in held(unbase64(letters[skip:])):
            hits.append((k, 0, len(letters)) if k in ("pem", "jwt") else (k, skip + x * 4 // 3, min(len(letters), skip - (-y * 4 // 3))))

    def place(n: int) -> int:
        """Where letter n stands in the run."""
        for a, b in lines:
            if n < b - a:
                return a + n
            n -= b - a
        return len(body)

    return [(k, start + place(x), start + (len(raw) if y == len(letters) else place(y - 1) + 1)) for k, x, y in apart(hits)]


def scan(text: str) -> list[tuple[str, int, int]]:
    """All spans by start, then kind in the order of KINDS, then end."""
    return sorted(base_spans(text) + method_spans(text), key=lambda x: (x[1], _ORDER[x[0]], x[2]))


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scanner():
    return lambda texts: [[{"kind": k, "start": a, "end": b} for k, a, b in scan(t)] for t in texts]


def find_secrets(df: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """df with `out`: array<struct<kind, start, end>> of each text's secrets; code points, end exclusive."""
    return df.withColumn(out, text_udf(_scanner, "array<struct<kind:string,start:long,end:long>>", _SPAN)(F.col(text)))


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with every maximal run of overlapping spans replaced by the mark."""
    runs: list[list[int]] = []
    for _, a, b in scan(text):
        if runs and a < runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    out, at = [], 0
    for a, b in runs:
        out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:]


def redact_secrets(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with the secrets in `text` replaced by `mark`; null texts stay null, texts without secrets as they are."""
    fix = text_udf(lambda: lambda texts: [redact(t, mark) for t in texts], "string", pa.string())
    return df.withColumn(text, F.when(F.col(text).isNotNull(), fix(F.col(text))))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    def summed(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)))

    df = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    base = F.filter("secrets", lambda s: s.kind.isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return df.select("doc_id", *map(count, BASE_KINDS), F.sha2(summed(base), 256).alias("base_sha256"), summed(F.col("secrets")).alias("spans"))


QUERIES = {"op1_secret_scan": op1_secret_scan}
SQL: dict[str, str] = {}
