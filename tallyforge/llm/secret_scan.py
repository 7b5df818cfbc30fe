"""Secret scans with structural confirmation (operator 10).

The base finds candidates by pattern: ``assign`` (a named value), ``access`` (an access key id) and ``hex``. The method
adds what decodes to a secret's own structure: ``jwt`` (a signed token whose header and payload are JSON objects, the
header with an algorithm), ``pem`` (an armoured private key whose body parses), ``key`` (base64) and ``hexkey`` (hex) of
a private key whose nested lengths agree to the last byte (DER, or the OpenSSH container).
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._spark import map_arrow, only, table, typed

#: The patterns of the base, in the order of their kinds.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "jwt", "pem", "key", "hexkey")

#: A JSON object's first byte, or that of the space or byte order mark before it, makes the first letter one of these.
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(?=[eICD7])(?=([A-Za-z0-9_-]{14,})\.([A-Za-z0-9_-]{3,})\.([A-Za-z0-9_-]*))")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----")
_BREAK = r"[ \t]*(?:\r?\n|(?:\\+r)?\\+n)[ \t]*"
_HEADER = re.compile(r"[ \t]*([A-Za-z0-9-]+):[ \t]*([^\n]*)(?:\n|$)")
#: Base64 of a DER sequence or of an OpenSSH container, as far as its first bytes.
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/])(?:M[A-P][A-Za-z0-9+/_-]{6}|b3BlbnNzaC1rZXktdjE)")
_RUN = re.compile(r"[A-Za-z0-9+/_-]+")
_NEXT = re.compile(_BREAK + r"(?=[A-Za-z0-9+/_-])")
_URL_SAFE = str.maketrans("-_", "+/")
#: The OIDs that password-based encryption starts with (PKCS#5, PKCS#12).
_PBE = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
_HEXKEY = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{62,}")


def der(data: bytes, depth: int = 0) -> list[tuple[int, bytes]] | None:
    """The (tag, content) items that fill ``data`` exactly, or None; constructed items must parse too."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > len(data):
                return None
            n = int.from_bytes(data[at : at + k], "big")
            if n < 0x80 or n >> 8 * (k - 1) == 0:
                return None
            at += k
        if at + n > len(data):
            return None
        content = data[at : at + n]
        if tag & 0x20 and (depth > 20 or der(content, depth + 1) is None):
            return None
        items.append((tag, content))
        at += n
    return items


def private_key(data: bytes) -> bool:
    """Whether ``data`` is a PKCS#8 (plain or encrypted), PKCS#1, DSA, SEC 1 or OpenSSH private key, by its nesting and lengths."""
    if data.startswith(b"openssh-key-v1\0"):
        at = 15
        for _ in range(3):  # cipher, key derivation, its options
            if at + 4 > len(data):
                return False
            at += 4 + int.from_bytes(data[at : at + 4], "big")
        if at + 4 > len(data):
            return False
        n, at = int.from_bytes(data[at : at + 4], "big"), at + 4
        if not 1 <= n <= 16:
            return False
        for _ in range(n + 1):  # public keys, private part
            if at + 4 > len(data):
                return False
            at += 4 + int.from_bytes(data[at : at + 4], "big")
        return at == len(data)
    if data[:1] != b"\x30":
        return False
    top = der(data)
    if not top or len(top) != 1 or not (parts := der(top[0][1])):
        return False
    tags = [t for t, _ in parts]
    if tags == [0x30, 4]:
        algorithm = der(parts[0][1])
        return bool(algorithm) and algorithm[0][0] == 6 and algorithm[0][1].startswith(_PBE) and len(parts[1][1]) >= 16
    if tags[0] != 2:
        return False
    version = parts[0][1]
    if version in (b"\0", b"\1") and tags[1:3] == [0x30, 4]:
        algorithm = der(parts[1][1])
        return bool(algorithm) and algorithm[0][0] == 6 and len(parts[2][1]) >= 16
    if version == b"\1" and tags[1:2] == [4]:
        return len(parts[1][1]) >= 16
    if version == b"\0" and tags == [2] * 6:  # p, q, g, y, x
        p, q, g, y, x = (int.from_bytes(c, "big", signed=True) for _, c in parts[1:])
        return p.bit_length() >= 512 and 0 < x < q < p and (p - 1) % q == 0 and 0 < g < p and 0 < y < p
    return version in (b"\0", b"\1") and len(tags) >= 9 and set(tags[:9]) == {2} and len(parts[1][1]) >= 32


def _decoded(s: str) -> bytes:
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def _token_part(s: str) -> dict | None:
    try:
        got = json.loads(base64.urlsafe_b64decode(s + "=" * (-len(s) % 4)))
    except (binascii.Error, ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def armoured(body: str) -> bool:
    """Whether what stands between the lines of an armoured private key is one: headers and escaped line breaks are no part of the key."""
    body = re.sub(r"\\+r", "", body)
    body = re.sub(r"\\+n", "\n", body).replace("\\/", "/").replace("\r", "").lstrip("\n \t")
    fields = {}
    while m := _HEADER.match(body):
        fields[m.group(1).lower()] = m.group(2)
        body = body[m.end() :]
        while fields and (more := re.match(r"[ \t]+[^\n]*[^A-Za-z0-9+/=\s][^\n]*\n", body)):  # a header's next line
            body = body[more.end() :]
    data = _decoded(re.sub(r"[\s\\]", "", body))
    if "encrypted" in fields.get("proc-type", "").lower():  # no structure inside: whole blocks, of the size of the IV
        block = len(fields.get("dek-info", "").rpartition(",")[2].strip()) // 2
        return len(data) >= 32 and block in (8, 16) and len(data) % block == 0
    return private_key(data)


def pem_spans(text: str) -> list[tuple[int, int]]:
    """Armoured private keys."""
    out = []
    for m in _PEM.finditer(text):
        at, last = text.find("-----", m.end()), f"-----END {m.group(1)}-----"
        if at >= 0 and text.startswith(last, at) and armoured(text[m.end() : at]):
            out.append((m.start(), at + len(last)))
    return out


def _size(data: bytes) -> int | None:
    """Bytes of the key that ``data`` begins with, as its own lengths say."""
    if data[0] == 0x30:
        k = data[1] & 0x7F if data[1] & 0x80 else 0
        return None if k > 4 or data[1] == 0x80 else 2 + k + (int.from_bytes(data[2 : 2 + k], "big") if k else data[1])
    at, left = 15, 3
    while left:
        if at + 4 > len(data):
            return None
        at, left = at + 4 + int.from_bytes(data[at : at + 4], "big"), left - 1
    n = int.from_bytes(data[at : at + 4], "big")
    if at + 4 > len(data) or not 1 <= n <= 16:
        return None
    at += 4
    for _ in range(n + 1):
        if at + 4 > len(data):
            return None
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at


def _letters(text: str, at: int, most: int) -> tuple[str, int]:
    """Up to ``most`` letters of base64 from a place, over line breaks, and where they end."""
    parts, left = [], most
    while m := _RUN.match(text, at):
        parts.append(m.group()[:left])
        left, at = left - len(parts[-1]), at + len(parts[-1])
        if not left or not (m := _NEXT.match(text, at)):
            break
        at = m.end()
    return "".join(parts).translate(_URL_SAFE), at


def base64_spans(text: str) -> list[tuple[int, int]]:
    """Private keys in base64, plain or URL-safe, on one line or wrapped; their own lengths say where they end."""
    out = []
    for m in _BASE64.finditer(text):
        if m.group().startswith("b3Bl"):
            n = _size(_decoded((s := _letters(text, m.start(), len(text))[0])[: len(s) // 4 * 4]))
        else:
            n = _size(_decoded(m.group().translate(_URL_SAFE)))
        need = n and -(-n * 4 // 3)
        if not n or not 39 <= need <= len(text) - m.start():
            continue
        s, end = _letters(text, m.start(), need)
        if len(s) == need and not re.match(r"[A-Za-z0-9+/]", text[end : end + 1]) and private_key(_decoded(s)):
            while text[end : end + 1] == "=" and need % 4:
                end, need = end + 1, need + 1
            out.append((m.start(), end))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base, in code points."""
    out = [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    out += [(1, m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of what the method adds."""
    out = []
    for m in _JWT.finditer(text):
        header = _token_part(m.group(1))
        if header and isinstance(header.get("alg"), str) and _token_part(m.group(2)) is not None:
            out.append((3, m.start(), m.end(3)))
    pem = pem_spans(text) if "PRIVATE KEY-----" in text else []
    out += [(4, a, b) for a, b in pem]
    out += [(5, a, b) for a, b in base64_spans(text) if not any(x <= a and b <= y for x, y in pem)]
    for m in _HEXKEY.finditer(text):
        if len(m.group()) % 2 == 0 and private_key(bytes.fromhex(m.group())):
            out.append((6, m.start(), m.end()))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    """``kind:start:end`` by start, then kind, joined by commas."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], x[0], x[2])))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_confirmed for every row of ``docs``.

    Null text is empty; without spans, spans is empty and base_sha256 the hash of the empty string. Offsets are code
    points, ends exclusive; the span of ``assign`` is its whole match. doc_id can have any type. An empty table gives no rows.
    """

    def f(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for text in batch.column(1):
            t = text.as_py() or ""
            base, more = base_spans(t), confirmed_spans(t)
            n = [sum(k == i for k, _, _ in base) for i in range(3)]
            rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more)))
        cols = list(zip(*rows))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed")
        yield pa.record_batch({"doc_id": batch.column(0), **{c: pa.array(v, k) for c, v, k in zip(names, cols, kinds)}})

    rows = only(docs, "doc_id", "text")
    return map_arrow(rows, typed(rows, "doc_id", "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long"), f)


def redact(docs: DataFrame, mark: str = "<secret>") -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by ``mark`` (overlapping ones by one), and ``n_chars``, if it is there
    and not null, counted anew for changed rows. Null text stays null."""
    schema = T.StructType(docs.schema.fields)
    has = "n_chars" in docs.columns

    def f(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at = batch.schema.get_field_index("text")
        out, sizes = [], []
        for text in batch.column(at).to_pylist():
            spans = sorted((a, b) for _, a, b in base_spans(text) + confirmed_spans(text)) if text else []
            if spans:
                parts, end = [], 0
                for a, b in spans:
                    if a >= end:
                        parts += [text[end:a], mark]
                    end = max(end, b)
                text = "".join(parts) + text[end:]
            out.append(text)
            sizes.append(len(text) if spans else None)
        cols = list(batch.columns)
        cols[at] = pa.array(out, cols[at].type)
        if has:
            n = batch.schema.get_field_index("n_chars")
            cols[n] = pa.array([o if s is None or o is None else s for s, o in zip(sizes, cols[n].to_pylist())], cols[n].type)
        yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return map_arrow(docs, schema, f)


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Operator 10 over all documents."""
    return scan(table(spark, sf_dir, "documents"))
