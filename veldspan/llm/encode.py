"""Encoding whole texts with a public word-BPE tokenizer, piece by piece.

The tokenizer lower-cases, drops white space and cuts texts into pieces (runs of
letters, single digits, other runs) before it merges within each.  Pieces recur,
so each worker keeps the packed ids of those it has met; the store is bounded
and is emptied when full.  Texts of plain letters are cut by one pattern; a word
that holds anything unusual is encoded by the library as it stands.  A file whose
normalizer or cutting differs from these steps is left to the library altogether.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

END_OF_WORD = "</w>"
#: Pieces that a worker keeps, at most.
KEEP = 1 << 20
# The normalizer and the cutting that this module repeats, as tokenizer files state them.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
CUTTING = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
# plain: letters that lower-case to one letter and compose with nothing, digits, ASCII signs and white space
_PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
_PIECES = re.compile(r"[a-zß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^a-z0-9ß-öø-ÿ\t-\r ]+")


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies; the blank stays."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)} | {0x20: " "}


class Encoder:
    """``encode(texts)`` gives each text's ids as packed little-endian integers of ``width`` bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        steps = json.loads(self.tokenizer.to_str())
        self.known = (steps["normalizer"], steps["pre_tokenizer"], steps["model"].get("end_of_word_suffix")) == (NORMALIZER, CUTTING, END_OF_WORD)
        self.by_piece = Tokenizer(self.tokenizer.model)  # the same merges, for text that is cut and mapped already
        self.by_piece.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        self.letters = _byte_letters()
        n = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        self.width = self.dtype.itemsize
        self.ends = np.zeros(n, bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items() if t.endswith(END_OF_WORD)]] = True
        self.pieces: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        """A text's ids from the library, without stores."""
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype).tobytes()

    def _learn(self, new: list[str]) -> None:
        mapped = " ".join(new).encode().decode("latin-1").translate(self.letters)
        ids = np.array(self.by_piece.encode_batch_fast([mapped], add_special_tokens=False)[0].ids, self.dtype)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(new) or cuts[-1] != len(ids):  # not a vocabulary with word ends: one by one
            self.pieces.update((p, self.whole(p)) for p in new)
            return
        data, at = ids.tobytes(), [0, *(cuts * self.width).tolist()]
        self.pieces.update(zip(new, map(data.__getitem__, map(slice, at, at[1:])), strict=False))

    def _plain(self, text: str) -> bytes:
        pieces = _PIECES.findall(text.lower())
        got = list(map(self.pieces.get, pieces))
        if None in got:
            new = list(dict.fromkeys(p for p, g in zip(pieces, got, strict=True) if g is None))
            if len(self.pieces) + len(new) > KEEP:
                self.pieces, new = {}, list(dict.fromkeys(pieces))
            self._learn(new)
            got = map(self.pieces.__getitem__, pieces)
        return b"".join(got)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each whole text, without special tokens."""
        out = []
        for t in texts:
            s = t.decode()
            if not self.known:
                out.append(self.whole(s))
            elif _PLAIN.fullmatch(s) and "<|" not in s:
                out.append(self._plain(s))
            else:
                words = [w.decode() for w in t.split()]
                out.append(b"".join([self._plain(w) if _PLAIN.fullmatch(w) and "<|" not in w else self.whole(w) for w in words]))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's own encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
