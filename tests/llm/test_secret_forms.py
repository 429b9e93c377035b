"""Planted forms of keys and tokens, and like shapes that aren't keys."""

from __future__ import annotations

import base64
import random
import time

import pytest

from veldspan.llm import secretscan

rng = random.Random(8)


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else b"\x82" + n.to_bytes(2, "big")) + body


def number(n):
    return der(2, b"\x11" + rng.randbytes(n))


def wrapped(data, end="\n"):
    text = base64.b64encode(data).decode()
    return end.join(text[i : i + 64] for i in range(0, len(text), 64))


def url(text):
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


RSA = der(0x30, der(2, b"\0"), *(number(60) for _ in range(8)))
DSA = der(0x30, der(2, b"\0"), *(number(40) for _ in range(5)))
SEALED = der(0x30, der(0x30, der(6, bytes.fromhex("2a864886f70d01050d")), der(0x30)), der(4, rng.randbytes(80)))
DIGEST = der(0x30, der(0x30, der(6, bytes.fromhex("608648016503040201")), der(5)), der(4, rng.randbytes(80)))


def pem(body, name="RSA PRIVATE KEY", end="\n"):
    return f"-----BEGIN {name}-----{end}{body}{end}-----END {name}-----"


HEADERS = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00112233445566778899AABBCCDDEEFF\n\n"
TOKEN = f'{url(" " + chr(123) + chr(34) + "alg" + chr(34) + ": " + chr(34) + "HS256" + chr(34) + "}")}.{url(chr(10) + "{}")}.abc_def'


@pytest.mark.parametrize(
    ("kind", "text"),
    [
        ("pem", pem(wrapped(RSA))),
        ("pem", pem(wrapped(RSA, "\\n"), end="\\n")),
        ("pem", pem(HEADERS + wrapped(rng.randbytes(320)))),
        ("pem", pem(wrapped(DSA), "DSA PRIVATE KEY")),
        ("pem", pem(wrapped(SEALED), "ENCRYPTED PRIVATE KEY")),
        ("b64key", wrapped(RSA)),
        ("b64key", wrapped(DSA)),
        ("jwt", TOKEN),
    ],
)
def test_planted(kind, text):
    assert (4, 4 + len(text), kind) in secretscan.find(f"see {text} end")
    assert sum(k in ("pem", "b64key", "jwt") for _, _, k in secretscan.find(f"see {text} end")) == 1


def test_key_run_together_with_a_name():
    text = "deploy/key_" + base64.b64encode(RSA).decode()
    assert (11, len(text), "b64key") in secretscan.find(text)


@pytest.mark.parametrize("text", [pem(wrapped(rng.randbytes(320))), pem(wrapped(DIGEST)), wrapped(rng.randbytes(400)), "www.example.com a.b.c.d"])
def test_noise(text):
    assert not [s for s in secretscan.find(text) if s[2] in ("pem", "b64key", "jwt")]


@pytest.mark.parametrize("piece", ["eyJ", "eyJhbGciOiJ9.", "b3BlbnNzaC1rZXktdjEA", "MIMA", "MIIE", "password", "token=", "AKIA", "-----BEGIN PRIVATE KEY-----", "30", "a.", "\\n"])
def test_time_grows_with_the_text(piece):
    """Texts made to provoke a pattern: twice the text takes about twice the time."""

    def seconds(size):
        text = piece * (size // len(piece))
        best = 1e9
        for _ in range(2):
            began = time.perf_counter()
            secretscan.find(text)
            best = min(best, time.perf_counter() - began)
        return best

    small, large = seconds(50_000), seconds(400_000)
    assert large < 0.2 + 20 * small, (small, large)
