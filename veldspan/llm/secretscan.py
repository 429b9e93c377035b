r"""Secret scans with structural confirmation.

Three base kinds are found by pattern: assignments to telling names, access ids,
and runs of hex digits.  The method adds candidates that a pattern alone can't
tell from noise, and reports one only if its structure is confirmed: base64 or
hex is decoded, then key encodings are parsed down to nested lengths.

* ``jwt``: three base64url parts; the first decodes to a JSON object with a
  string ``alg``, the second to a JSON object.
* ``pem``: a private-key armour whose body, unescaped and without its headers, decodes
  to a DER private key or to an OpenSSH key with consistent field lengths, or is
  encrypted as its headers say.
* ``b64key``: such a key anywhere in a base64 run, also one wrapped over lines.
* ``hexkey``: a run of hex digits that decodes to such a key.

A DER private key is one SEQUENCE that fills the data, whose elements' lengths
nest exactly and whose first is a small INTEGER (the version).

Spans are in code points, end exclusive.  Within a kind matches don't overlap.

Defined results: a null or empty text has no spans; repeated rows, ties and null keys
are scanned row by row; extra columns, of whatever name, are not read; an empty table
gives no rows; a very long text is scanned whole, in time that grows with its length:
every pattern is possessive or a single run, and candidates are decoded only once their
first bytes look like a key's.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspan.llm.common import arrow_map, batch

KINDS = ("assign", "access", "hex", "jwt", "pem", "b64key", "hexkey")
BASE = KINDS[:3]

_NAMES = ("passw", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so shorter ones needn't be matched to be dropped
_DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]*+){2,}+")
_PEM = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----((?:(?!-----).)*+)-----END \1-----", re.DOTALL)
_HEADER = re.compile(r"[A-Za-z][A-Za-z0-9-]*:.*")
_CIPHER = re.compile(r"DEK-Info:\s*[A-Z0-9-]+,\s*(?:[0-9A-Fa-f]{16}|[0-9A-Fa-f]{32})\s*$", re.MULTILINE)
_B64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:(?:\\[rn]|[\r\n][ \t]*+)++[A-Za-z0-9+/_-]++)*+={0,2}")
_PIECE = re.compile(r"\\[rn]|([A-Za-z0-9+/_-]+)")
_KEY_START = re.compile(r"M[A-P]|b3BlbnNzaC1rZXktdjEA")
_HEXRUN = re.compile(r"[0-9A-Fa-f]{40,}")
_OPENSSH = b"openssh-key-v1\0"
_SCHEMES = bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01")


def decode64(text: str) -> bytes | None:
    """Standard or URL-safe base64, with or without padding."""
    body = "".join(text.split()).rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """``(tag, start, end)`` of elements that fill ``data[at:end]`` exactly, or None."""
    out = []
    while at < end:
        if at + 2 > end:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size = int.from_bytes(data[at : at + n], "big")
            at += n
        if at + size > end:
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def is_der_key(data: bytes) -> bool:
    """PKCS#1, PKCS#8 or SEC1: SEQUENCE { INTEGER 0..3, ... } with nested lengths that add up."""
    top = der_elements(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    parts = der_elements(data, top[0][1], top[0][2])
    if parts and len(parts) == 2:  # EncryptedPrivateKeyInfo: a password scheme of PKCS#5 or PKCS#12, and an octet string
        scheme = der_elements(data, parts[0][1], parts[0][2]) if parts[0][0] == 0x30 else None
        return bool(scheme) and parts[1][0] == 0x04 and scheme[0][0] == 0x06 and data[scheme[0][1] : scheme[0][2]].startswith(_SCHEMES)
    if not parts or len(parts) < 3 or parts[0][0] != 0x02 or parts[0][2] - parts[0][1] != 1 or data[parts[0][1]] > 3:
        return False
    todo = [p for p in parts if p[0] & 0x20]
    while todo:
        _, a, b = todo.pop()
        if (inner := der_elements(data, a, b)) is None:
            return False
        todo += [p for p in inner if p[0] & 0x20]
    if len(parts) == 6 and all(p[0] == 0x02 for p in parts):  # DSA
        return True
    # PKCS#1 has nine integers, PKCS#8 an algorithm and an octet string, SEC1 an octet string
    return len(parts) >= 9 and all(p[0] == 0x02 for p in parts[:9]) or parts[1][0] == 0x04 or parts[1][0] == 0x30 and parts[2][0] == 0x04


def openssh_end(read: Callable[[int], bytes], limit: int) -> int | None:
    """Where an OpenSSH key ends: magic, then cipher, kdf, kdf options, a count, and as many public keys and a private part by length.

    ``read(at)`` gives the four bytes there; nothing else is read, so the keys' lengths cost nothing.
    """
    at = len(_OPENSSH)

    def field() -> bool:
        nonlocal at
        if at + 4 > limit:
            return False
        at += 4 + int.from_bytes(read(at), "big")
        return at <= limit

    if not (field() and field() and field()) or at + 4 > limit:
        return None
    n = int.from_bytes(read(at), "big")
    at += 4
    return at if 1 <= n <= 16 and all(field() for _ in range(n + 1)) else None


def is_openssh_key(data: bytes) -> bool:
    return data.startswith(_OPENSSH) and openssh_end(lambda at: data[at : at + 4], len(data)) == len(data)


def is_key(data: bytes | None) -> bool:
    return bool(data) and (is_openssh_key(data) if data[:4] == _OPENSSH[:4] else data[0] == 0x30 and is_der_key(data))


def is_armoured_key(body: str) -> bool:
    """A PEM body, also with escaped line ends, quotes around lines, and headers; an encrypted one by its header and block length."""
    lines = [x.strip().strip("\"',").rstrip("\\").strip() for x in re.sub(r"\\+[rn]", "\n", body).split("\n")]
    heads = [x for x in lines if _HEADER.fullmatch(x)]
    data = decode64("".join(x for x in lines if not _HEADER.fullmatch(x)))
    if is_key(data):
        return True
    joined = "\n".join(heads)
    return bool(data) and len(data) >= 32 and len(data) % 8 == 0 and "4,ENCRYPTED" in joined and bool(_CIPHER.search(joined))


def _four(body: str, start: int, at: int) -> bytes:
    """Four bytes at a place of what is encoded from ``start``."""
    chars = body[start + at // 3 * 4 : start + at // 3 * 4 + 8]
    data = decode64(chars[: len(chars) - (len(chars) % 4 == 1)]) or b""
    return data[at % 3 : at % 3 + 4]


def bare_keys(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Spans of keys in a base64 run, which may be wrapped; a key's own lengths say where it ends."""
    pieces = [(m.start(1), m[1]) for m in _PIECE.finditer(text, start, end) if m[1]]
    body, ends = "".join(p for _, p in pieces), list(accumulate(len(p) for _, p in pieces))

    def at(i: int) -> int:
        k = bisect_right(ends, i)
        return pieces[k][0] + i - (ends[k] - len(pieces[k][1]))

    i = 0
    while m := _KEY_START.search(body, i):
        i, a = m.start() + 1, m.start()
        if body[a] == "b":
            size = openssh_end(lambda x, a=a: _four(body, a, x), (len(body) - a) * 3 // 4)
        else:
            head = decode64(body[a : a + 16]) or b""
            n = head[1] & 0x7F if len(head) == 12 and head[1] & 0x80 else 0
            size = 2 + n + (int.from_bytes(head[2 : 2 + n], "big") if n else head[1]) if len(head) == 12 and n <= 4 else None
            if size and not (head[2 + n] == 0x30 or head[2 + n : 4 + n] == b"\x02\x01" and head[4 + n] <= 3):
                size = None  # neither a version nor an encryption scheme comes first, so the rest needn't be decoded
        chars = -(-size * 4 // 3) if size else 0
        if 40 <= chars <= len(body) - a and is_key(data := (decode64(body[a : a + chars]) or b"")[:size]) and len(data) == size:
            last = at(a + chars - 1) + 1
            while last < end and text[last] == "=":
                last += 1
            yield at(a), last
            i = a + chars


def signed_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Three parts of a dotted run whose decoded JSON confirms them, also where a name runs into the first."""
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        starts = list(accumulate((len(p) + 1 for p in parts), initial=m.start()))
        k = 0
        while k + 2 < len(parts):
            for skip in (0, parts[k].find("eyJ")):
                token = f"{parts[k][max(skip, 0):]}.{parts[k + 1]}.{parts[k + 2]}"
                if skip >= 0 and len(parts[k]) - skip >= 8 and parts[k + 1] and is_signed_token(token):
                    yield starts[k] + skip, starts[k] + skip + len(token)
                    k += 2
                    break
            k += 1


def is_signed_token(text: str) -> bool:
    head, body, _ = text.split(".")
    try:
        head, body = json.loads(decode64(head) or b""), json.loads(decode64(body) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def scan(text: str) -> Iterator[tuple[int, int, str]]:
    """``(start, end, kind)`` of each confirmed match, kind by kind."""
    low = text.lower()
    if any(n in low for n in _NAMES):
        for m in _ASSIGN.finditer(text):
            if len(m[2]) >= 12:
                yield *m.span(), "assign"
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if m.end() - m.start() >= 18:
                yield *m.span(), "access"
    for m in _HEX.finditer(text):
        yield *m.span(), "hex"
    for span in signed_tokens(text):
        yield *span, "jwt"
    armoured = []
    if "PRIVATE KEY-----" in text:
        for m in _PEM.finditer(text):
            if is_armoured_key(m[2]):
                armoured.append(m.span())
                yield *m.span(), "pem"
    for m in _B64.finditer(text):
        for a, z in bare_keys(text, *m.span()):
            if not any(s <= a and z <= e for s, e in armoured):
                yield a, z, "b64key"
    for m in _HEXRUN.finditer(text):
        if len(m[0]) % 2 == 0 and m[0][:2] in ("30", "6f", "6F") and is_key(bytes.fromhex(m[0])):
            yield *m.span(), "hexkey"


def find(text: str | None) -> list[tuple[int, int, str]]:
    """All spans by start, then kind as listed."""
    return sorted(scan(text or ""), key=lambda s: (s[0], KINDS.index(s[2])))


def secrets(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``spans``, an array of ``kind, start, end``, for each row."""
    kind = docs.schema[key].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [[{"kind": k, "start": s, "end": e} for s, e, k in find(t)] for t in b.column(1).to_pylist()]
        return batch(key=b.column(0), spans=pa.array(found, span))

    out = arrow_map(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), each, f"key {kind}, spans array<struct<kind string, start int, `end` int>>")
    return out.select(F.col("key").alias(key), "spans")
