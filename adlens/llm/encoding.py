"""Token ids of whole texts by the tokenizers library, each distinct word encoded once per worker.

Both supported kinds of tokenizer cut a text at spaces before anything else, so a text's ids are those of its
space-separated parts, end to end. Parts are looked up in a cache of bounded size that lives as long as the Python
worker; unknown parts are pre-tokenized and handed to the library's model. Texts of any other tokenizer, and texts
that may hold the string of an added token (which the library looks for before all else), are encoded as a whole.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from array import array

import numpy as np

#: Entries of a worker's cache; beyond that it starts anew.
CACHE_ENTRIES = 800_000
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MARKS = frozenset(".,!?;:")
WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
    return [rest.get(b) or chr(b) for b in range(256)]


class Encoder:
    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, "rb") as f:
            spec = json.load(f)
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model = self.tok.model
        self.letters = dict(enumerate(byte_alphabet()))
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        self.kind = "other"
        if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.kind, self.pattern = "byte", regex.compile(BYTE_LEVEL)
        elif (norm or {}).get("type") == "Sequence" and [x["type"] for x in norm["normalizers"]] == ["NFC", "Replace", "Lowercase"]:
            parts = pre.get("pretokenizers", [])
            if [x["type"] for x in parts] == ["Split", "ByteLevel"] and parts[0]["pattern"] == {"Regex": WORD_LEVEL} and parts[0]["invert"] and not parts[1]["use_regex"] and not parts[1]["add_prefix_space"]:
                self.kind, self.pattern = "word", regex.compile(WORD_LEVEL)
        # added tokens are found by their first two characters; where those could change case, no text is cut
        self.added = sorted({x["content"][:2] for x in spec.get("added_tokens") or ()})
        if any(len(x) < 2 or x.lower() != x.upper() or any(c.isspace() for c in x) for x in self.added):
            self.kind = "other"
        if spec["model"].get("type") != "BPE" or spec["model"].get("dropout"):
            self.kind = "other"
        self.cache: dict[str, bytes] = {}  # word kind: parts; byte kind: parts after a blank
        self.heads: dict[str, bytes] = {}  # byte kind: parts as they stand
        self.pieces: dict[str, bytes] = {}  # pre-tokens

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def piece(self, piece: str) -> bytes:
        """Ids of one pre-token, by the library's model."""
        got = self.pieces.get(piece)
        if got is None:
            if len(self.pieces) >= CACHE_ENTRIES:
                self.pieces.clear()
            name = piece if piece.isascii() and piece.isalpha() else piece.encode().decode("latin-1").translate(self.letters)
            got = self.pieces[piece] = array("I", [t.id for t in self.model.tokenize(name)]).tobytes()
        return got

    def part(self, part: str, before: str = "") -> bytes:
        """Ids of ``before`` and a part that isn't in the cache."""
        if part and not part.isascii() and max(part) >= "\u0250":  # leave newer scripts' letter tables to the library
            return self.whole(before + part)
        if self.kind == "word":
            part = part.lower() if part.isascii() else "".join(c.lower() for c in unicodedata.normalize("NFC", part))
        # most parts are a word, or a word and a mark
        if part.isalpha():
            return self.piece(before + part)
        if part[-1:] in MARKS and part[:-1].isalpha():
            return self.piece(before + part[:-1]) + self.piece(part[-1])
        return b"".join([self.piece(x) for x in self.pattern.findall(before + part)])

    def look(self, cache: dict[str, bytes], part: str, before: str = "") -> bytes:
        got = cache.get(part)
        if got is None:
            if len(cache) >= CACHE_ENTRIES:
                cache.clear()
            got = cache[part] = self.part(part, before)
        return got

    def __call__(self, text: str) -> bytes:
        """Ids of the text as little-endian unsigned 32-bit integers."""
        if self.kind == "other" or any(x in text for x in self.added):
            return self.whole(text)
        cache = self.cache
        if self.kind == "word":
            parts = text.replace("\n", " ").split(" ")
            try:
                return b"".join([cache[x] for x in parts])
            except KeyError:
                return b"".join([self.look(cache, x) for x in parts])
        first, *parts = text.split(" ")
        try:
            return self.look(self.heads, first) + b"".join([cache[x] for x in parts])
        except KeyError:
            if any(not x or x[0].isspace() or x[-1].isspace() for x in parts) or first[-1:].isspace() or not first:
                return b"".join([self.look(self.heads, x) for x in spaced(text)])
            return self.look(self.heads, first) + b"".join([self.look(cache, x, " ") for x in parts])


def spaced(text: str) -> list[str]:
    """The text cut before each blank that doesn't stand between white space: nothing is merged across such a cut."""
    out, now = [], ""
    for i, x in enumerate(text.split(" ")):
        if not i:
            now = x
        elif (not now or now[-1].isspace()) and (not x or x[0].isspace()):
            now += " " + x
        else:
            out.append(now)
            now = " " + x
    return [*out, now]


def encoder(path: str) -> Encoder:
    """The worker's encoder of this file, made once."""
    held = sys.modules.setdefault("_adlens_encoders", type(sys)("_adlens_encoders")).__dict__
    if path not in held:
        held[path] = Encoder(path)
    return held[path]
