"""Brute-force versions of the registered queries, written from their contracts."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def quality_base(text: str | None) -> tuple:
    words = WORD.findall(text or "")
    at = defaultdict(list)
    for i in range(len(words) - 2):
        at[tuple(words[i : i + 3])].append(i)
    repeated = {i + k for starts in at.values() if len(starts) > 1 for i in starts for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    failed = n < 50 or 100 * len(repeated) > 50 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated), failed


def token_rows(docs: list[tuple], tokenizer) -> list[tuple]:
    out, start = [], 0
    for key, text in sorted(docs):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def fingerprint(text: str | None) -> int:
    words = WORD.findall((text or "").translate(UPPER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps: list[tuple[int, int]], radius: int = 2) -> dict[int, int]:
    """Of ``(key, fingerprint)``: the smallest key reachable from each key."""
    root = {k: k for k, _ in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(fps):
        for b, y in fps[:i]:
            if (x ^ y).bit_count() <= radius:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {k: find(k) for k, _ in fps}


ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secret_base(text: str | None) -> list[tuple[int, int, str]]:
    text = text or ""
    out = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(*m.span(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(*m.span(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out, key=lambda s: (s[0], ["assign", "access", "hex"].index(s[2])))


def substring_rows(docs: list[tuple], width: int = 13) -> dict:
    """Of ``(key, text)`` with distinct keys: ``(n_words, n_removed, kept)``."""
    words = {k: WORD.findall(t or "") for k, t in docs}
    first: dict[tuple, int] = {}
    for k in sorted(words):
        for i in range(len(words[k]) - width + 1):
            first.setdefault(tuple(words[k][i : i + width]), k)
    out = {}
    for k, ws in words.items():
        gone = set()
        for i in range(len(ws) - width + 1):
            if first[tuple(ws[i : i + width])] < k:
                gone.update(range(i, i + width))
        out[k] = (len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone))
    return out


def line_key(line: str) -> str:
    return line.strip(" \t\n\r\x0b\x0c").translate(UPPER)


def line_rows(docs: list[tuple], threshold: int = 10) -> dict:
    n = Counter(k for _, t in docs for k in {line_key(x) for x in (t or "").split("\n")} if k)
    out = {}
    for key, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if n[line_key(x)] < threshold]
        out[key] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def leak_rows(docs: list[tuple], items: list[tuple], width: int = 13) -> dict:
    windows = defaultdict(set)
    for item, t in items:
        ws = BENCH_WORD.findall((t or "").translate(UPPER))
        for i in range(max(1, len(ws) - width + 1) if ws else 0):
            windows[tuple(ws[i : i + width])].add(item)
    sizes = {len(w) for w in windows}
    out = {}
    for key, t in docs:
        ws, hit, found = BENCH_WORD.findall((t or "").translate(UPPER)), set(), set()
        for n in sizes:
            for i in range(len(ws) - n + 1):
                if (w := tuple(ws[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[w]
        out[key] = (len(ws), len(hit), len(found), ",".join(sorted(map(str, found))), len(hit) > 0 and 20 * len(hit) >= len(ws))
    return out
