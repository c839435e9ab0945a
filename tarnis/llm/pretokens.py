"""Vocabulary and pre-tokens of a byte-level BPE tokenizer with word ends (a `tokenizers` JSON file).

The file must have: NFC, white space folding and lower case as normaliser; a split by the pattern below and a
byte-level step as pre-tokeniser; a BPE model with a word end suffix and no decoder. Anything else is refused,
since another pipeline would give other tokens.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import regex

#: White space in the tokenizer's patterns, and its split pattern.
SPACE = r"\t-\r " + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_PRE = regex.compile(SPLIT.replace(r"\s", SPACE))
#: The same for texts of Latin letters only (below U+0250), where the faster module can name the classes.
_LATIN = re.compile(r"[^\W\d_²³¹¼½¾]+|'(?:[stmd]|re|ve|ll)|[\d²³¹¼½¾]|(?:[^\w\t-\r \x85\xa0]|_)+")
_OTHER = re.compile(r"[^\0-\u024f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if visible, else the next from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in seen}
    rest = (b for b in range(256) if b not in names)
    names |= {b: chr(256 + i) for i, b in enumerate(rest)}
    return [names[b] for b in range(256)]


class Vocabulary:
    """Token strings, the merges as arrays, and special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or split != SPLIT or spec["decoder"]:
            raise ValueError(f"{path} is not a tokenizer of the supported kind")
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.strings = [""] * size
        for s, i in [*self.ids.items(), *self.special.items()]:
            self.strings[i] = s
        symbols = byte_symbols()
        self.inner = np.array([self.ids[s] for s in symbols], np.int64)
        self.final = np.array([self.ids[s + self.suffix] for s in symbols], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([self.ids[a] for a, _ in merges], np.int64)
        self.right = np.array([self.ids[b] for _, b in merges], np.int64)
        self.made = np.array([self.ids[a + b] for a, b in merges], np.int64)
        # Merging all places of the lowest pair at once needs each symbol to be made before it is used.
        born = np.full(size, -1)
        born[self.made] = np.arange(len(merges))
        order = np.arange(len(merges))
        if len(set(self.made.tolist())) != len(merges) or (born[self.left] >= order).any() or (born[self.right] >= order).any():
            raise ValueError(f"{path}: merges are not in the order of training")

    def split_special(self, text: str) -> list[tuple[str, int | None]]:
        """Pieces of ordinary text and special tokens, in order; special strings are sought before normalisation."""
        if "<|" not in text:
            return [(text, None)]
        out, at = [], 0
        for m in self.special_pattern.finditer(text):
            out += [(text[at : m.start()], None), (m[0], self.special[m[0]])]
            at = m.end()
        return [*out, (text[at:], None)]

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text. A special token is one of them, marked by a leading space."""
        if "<|" not in text:
            return split(normalise(text))
        out: list[str] = []
        for piece, special in self.split_special(text):
            if special is None:
                out += split(normalise(piece))
            else:
                out.append(" " + piece)
        return out


def normalise(text: str) -> str:
    """NFC and lower case, character by character (no rule for a sigma at a word's end)."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def split(text: str) -> list[str]:
    return (_PRE if _OTHER.search(text) else _LATIN).findall(text)


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)


class Index(dict):
    """Numbers keys in order of first sight."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n
