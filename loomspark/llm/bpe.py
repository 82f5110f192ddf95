"""Token ids of whole texts by a public byte-level BPE file, encoded piece by piece with a bounded memory of pieces.

An encoder reads the strings of the file's special tokens in a text as these tokens, as the library does by default, or with `special=False`
as ordinary text. An empty text has no ids; texts of any length are encoded whole, those of over PART characters in parts that are cut where a word begins.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from itertools import pairwise

import numpy as np

#: A space that always begins a new word; characters of a part.
_WORD_START, PART = re.compile(r"(?<=\S) (?=\S)"), 1 << 20
#: White space beside a space, or a space at an end: only there can a cut before a space change the split into words.
_UNSAFE = re.compile(r"\s | \s|^ | $")
# Fixed value: the pattern by which a byte-level BPE of this kind splits text before its merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces kept in memory at most, and the longest that is kept.
MAX_PIECES, MAX_LENGTH = 100_000, 64


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids as little-endian uint32 bytes. A byte-level BPE file splits text by a pattern in which a single space between other characters
    always begins a new word, so a text is the sequence of its pieces there. Where the library must be used, each different piece is encoded once."""

    def __init__(self, path: str, by_rank: bool = True, special: bool = True):
        self.path, self.known, self.ranked, self._tokenizer, self.special = path, {}, None, None, special
        with open(path, encoding="utf-8") as f:
            self.marks = [t["content"] for t in json.load(f).get("added_tokens", [])]
        if by_rank and array("I").itemsize == 4 and sys.byteorder == "little":
            self.ranked = self._ranked(path)

    @property
    def tokenizer(self):
        """The library's own encoder, loaded where the quicker one does not serve."""
        if self._tokenizer is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(self.path)
            self._tokenizer.encode_special_tokens = not self.special  # else their strings in a text are ordinary text
        return self._tokenizer

    def _ranked(self, path: str):
        """The same ids from a quicker encoder, where the file is plain byte-level BPE whose ids rise in the order of its merges."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, before = file["model"], file.get("pre_tokenizer") or {}
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not file.get("normalizer")
        if not plain or any(vocab.get(a + b) != 256 + k for k, (a, b) in enumerate(merges)):
            return None
        # byte-level files write each byte as a printable character: itself, or one from U+0100 on, in order
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        special = {t["content"] for t in file.get("added_tokens", [])}
        ranks = {bytes(byte[c] for c in token): k for token, k in vocab.items() if token not in special}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _encode(self, texts: list[str]) -> list[bytes]:
        if self.ranked:
            return [array("I", self.ranked(x)).tobytes() for x in texts]
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.special and any(x in text for x in self.marks):  # the library splits there first
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self.ranked:
            if len(text) <= PART:
                return self._encode([text])[0]
            cuts = [0]
            while (m := _WORD_START.search(text, cuts[-1] + PART)) and m.start() < len(text):
                cuts.append(m.start())
            return b"".join(self._encode([text[a:b]])[0] for a, b in pairwise([*cuts, len(text)]))
        if _UNSAFE.search(text):
            return self._encode([text])[0]
        first, *rest = text.split(" ")
        pieces = [first, *[" " + x for x in rest]]
        known = self.known
        if len(known) > MAX_PIECES:
            known.clear()
        new = [x for x in dict.fromkeys(pieces) if x not in known]
        own: dict[str, bytes] = {}
        if new:
            for x, ids in zip(new, self._encode(new), strict=True):
                (known if len(x) <= MAX_LENGTH else own)[x] = ids
        if own:
            return b"".join(known[x] if x in known else own[x] for x in pieces)
        return b"".join(map(known.__getitem__, pieces))

    def ends_sentence(self) -> np.ndarray:
        """By id, whether its string ends a sentence or a line."""
        with open(self.path, encoding="utf-8") as f:
            file = json.load(f)
        vocab = {**file["model"]["vocab"], **{t["content"]: t["id"] for t in file.get("added_tokens", [])}}
        out = np.zeros(max(vocab.values()) + 2, bool)
        for token, k in vocab.items():
            out[k] = token.endswith((".", "!", "?", "Ċ"))  # U+010A stands for a line feed
        return out


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special: bool = True) -> Encoder:
    """One per worker, file and reading of special tokens."""
    if (path, special) not in _encoders:
        _encoders[path, special] = Encoder(path, special=special)
    return _encoders[path, special]
