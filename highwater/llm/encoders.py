"""Token ids of whole texts from the ``tokenizers`` library, with the parts of a text remembered.

A text is cut only where its tokenizer always cuts: before a blank that follows a visible character. Most parts recur, so
their ids are kept in a bounded table per Python worker; what is not there goes to the library. The cut is used for two
kinds of file: byte-level BPE with its built-in pattern, and BPE with word ends that drops white space. Any other file
is encoded text by text.
"""
from __future__ import annotations

import json
import re
import unicodedata
from array import array

from tokenizers import Tokenizer

ODD_BLANK = re.compile(r"[^\S \n]")
PART = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
CAREFUL_PART = re.compile(r"(?<=\S)(?=[ \n])")
VISIBLE = re.compile(r"[^ \n]+")
WORD = re.compile(r"( ?)([^\W\d_]+)([^\w\s']*)")
RARE_CONTROLS = "\x1c\x1d\x1e\x1f"


def byte_letters() -> list[str]:
    """Byte-level BPE writes each byte as one printable character: visible Latin-1 as itself, the rest from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


class Encoder(dict):
    """Part of a text -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, limit: int = 500_000):
        self.limit, self.tokenizer = limit, Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        specials = [x["content"] for x in spec.get("added_tokens", [])]
        plain = not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec.get("added_tokens", [])) and not any(
            re.search(r"\s", x) for x in specials)
        kinds = [x.get("type") for x in (norm or {}).get("normalizers", [])]
        steps = [x.get("type") for x in pre.get("pretokenizers", [])]
        self.drops_blanks = bool(plain and kinds == ["NFC", "Replace", "Lowercase"] and steps == ["Split", "ByteLevel"]
                                 and spec["model"].get("end_of_word_suffix"))
        self.keeps_blanks = bool(plain and norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"))

    def parts(self, text: str) -> list[str]:
        if self.keeps_blanks:
            return PART.findall(text) if not ODD_BLANK.search(text) else CAREFUL_PART.split(text)
        if self.drops_blanks:
            if "Σ" not in text and "<|" not in text:  # a final sigma depends on its place; special strings on their case
                text = text.lower()
            return text.split() if not any(c in text for c in RARE_CONTROLS) else VISIBLE.findall(text)
        return [text]

    def __missing__(self, part: str) -> bytes:
        m = WORD.fullmatch(part)
        if m and m[2].isalpha() and (self.keeps_blanks or self.drops_blanks and not m[1] and part == part.lower() and "Σ" not in part and unicodedata.is_normalized("NFC", part)):
            word = "".join([self.letters[b] for b in (m[1] + m[2]).encode()]) if not m[2].isascii() else (self.letters[32] if m[1] else "") + m[2]
            ids = array("I", [t.id for t in self.model.tokenize(word)]).tobytes() + (self[m[3]] if m[3] else b"")
        elif self.keeps_blanks and part[0] == "\n" and part[1:] and not part[1].isspace():
            ids = self["\n"] + self[part[1:]]
        else:
            ids = array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()
        if len(part) <= 48:
            if len(self) >= self.limit:
                self.clear()
            self[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.parts(text))) if text else b""


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker, so later tasks find the parts of earlier ones."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
