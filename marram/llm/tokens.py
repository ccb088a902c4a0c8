"""Token ids of whole texts by the ``tokenizers`` library, with the encodings of recurring words kept.

``TextEncoder`` gives exactly ``Tokenizer.encode(text, add_special_tokens=False).ids``. A text of Latin letters,
digits and common punctuation is cut into the tokenizer's pre-tokens, whose ids do not depend on their neighbours;
each is encoded by the library's model once and kept (bounded). Other texts, and tokenizers of another make, go to
the library whole.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from functools import lru_cache

from . import _shared

#: Pre-tokens whose ids a worker keeps, some 100 MB.
KEPT = 400_000

_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾"
#: Of these characters it is certain which are letters, digits and white space, and they are stable under NFC.
_ODD = re.compile("[^\t\n\r -~¡-ÿ‐-‧€]")

#: The pre-tokenization patterns that are known, and their equals over the characters above. Fixed by the vocabularies.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_CUTS = {
    "blank": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+"),
    "word": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+"),
}


@lru_cache(None)
def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a printable character: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


def _bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Kept(dict):
    """Ids by pre-token, as little-endian uint32 bytes. Half full, it puts them aside; those asked for again come back."""

    def __init__(self, make):
        super().__init__()
        self.make, self.aside = make, {}

    def __missing__(self, word: str) -> bytes:
        out = self.aside.get(word)
        if out is None:
            out = self.make(word)
        if len(self) >= KEPT // 2:
            self.aside = dict(self)
            self.clear()
        self[word] = out
        return out


class TextEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [x["content"] for x in spec["added_tokens"]]
        self.kind = self._kind(spec)
        self.cut = _CUTS[self.kind].findall if self.kind else None
        self.model = self.tokenizer.model
        self.blank = _byte_letters()[32]
        self.words = _Kept(self._word)

    @staticmethod
    def _kind(spec: dict) -> str:
        """``blank``: words carry the blank before them; ``word``: text is lower-cased, white space vanishes; empty: another make."""
        model, pre, norm = spec["model"], spec["pre_tokenizer"] or {}, spec["normalizer"] or {}
        if model["type"] != "BPE" or model["dropout"] or spec["post_processor"]:
            return ""
        if pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not norm:
            return "blank"
        steps, splits = [x["type"] for x in norm.get("normalizers", [])], pre.get("pretokenizers", [])
        if steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in splits] == ["Split", "ByteLevel"] and splits[0]["pattern"].get("Regex") == _WORDS and splits[0]["invert"] and not splits[1]["use_regex"] and not splits[1]["add_prefix_space"]:
            return "word"
        return ""

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():
            word = word.replace(" ", self.blank)
        else:
            word = word.encode().decode("latin-1").translate(_byte_letters())
        return _bytes([t.id for t in self.model.tokenize(word)])

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian uint32 bytes."""
        if not self.kind or _ODD.search(text) or "<|" in text and any(x in text for x in self.added):
            return _bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.words.__getitem__, self.cut(text.lower() if self.kind == "word" else text)))


def encoder(path: str) -> TextEncoder:
    """The worker's encoder of a vocabulary file."""
    return _shared.kept(("token ids", path), lambda: TextEncoder(path))


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
