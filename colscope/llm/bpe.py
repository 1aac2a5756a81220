"""Byte-level BPE as a vocabulary file of the tokenizers library defines it.

The file's text is read once on the driver and travels with the task, so executors need
no file.  Where the file is plain byte-level BPE (GPT-2's splitting rule, merges in id order,
unnormalised added tokens), the same ids come from the tiktoken library, several
times faster; texts with characters that the two libraries' Unicode tables may class
differently, or that make it fail, go through tokenizers itself.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cached_property, lru_cache

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

#: Fixed value: the splitting rule of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """Byte-level BPE writes bytes as characters: printable Latin-1 as itself, the others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _ranges(prop: str) -> str:
    """Latin-1 characters of a property as the inside of a character class."""
    codes = [c for c in range(256) if regex.match(prop, chr(c))]
    return "".join(f"\\x{c:02x}" for c in codes)


class Bpe:
    def __init__(self, spec: str) -> None:
        self._spec = spec
        doc = json.loads(spec)
        added = doc.get("added_tokens") or []
        self.special = {t["content"]: t["id"] for t in added}
        self._splitter = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if added else None
        pre, model = doc.get("pre_tokenizer") or {}, doc["model"]
        plain = (doc.get("normalizer") is None and doc.get("post_processor") is None and pre.get("type") == "ByteLevel"
                 and pre.get("use_regex", True) and not pre.get("add_prefix_space") and model.get("type") == "BPE"
                 and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
                 and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added))
        if not plain:
            raise ValueError("only plain byte-level BPE files are supported")
        alphabet = byte_alphabet()
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.special}
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if merged != sorted(merged) or len(vocab) != len(merged) + 256:
            raise ValueError("the merges are not in the order of their ids")
        ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items()}
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._unicode = regex.compile(PATTERN)
        letters, digits, spaces = (_ranges(p) for p in (r"\p{L}", r"\p{N}", r"\s"))
        # The same rule over Latin-1, where the three classes can be written out.
        self._latin = re.compile(f" ?[{letters}]+| ?[{digits}]+|'(?:[stmd]|re|ve|ll)| ?[^{spaces}{letters}{digits}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+")
        self._known: set[str] = set()

    @cached_property
    def library(self) -> Tokenizer:
        """The library's own tokenizer, built when a text needs it."""
        return Tokenizer.from_str(self._spec)

    def _settled(self, text: str) -> bool:
        """True if every character is assigned in a Unicode version that all libraries here know."""
        fresh = set(text) - self._known
        if any(unicodedata.category(c) in ("Cn", "Cs") for c in fresh):
            return False
        self._known |= fresh
        return True

    def parts(self, text: str) -> list[str | int]:
        """The text cut at strings of added tokens, which are given as their ids."""
        if self._splitter is None or not any(s in text for s in self.special):
            return [text]
        out: list[str | int] = []
        at = 0
        for m in self._splitter.finditer(text):
            out += [text[at:m.start()], self.special[m.group()]]
            at = m.end()
        return [*out, text[at:]]

    def _ids(self, text: str) -> list[int]:
        try:
            if _is_latin(text) or self._settled(text):
                return self.fast.encode_ordinary(text)
        except BaseException as error:  # the library's own panics do not derive from Exception
            if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
        return self.library.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> np.ndarray:
        """Ids of a whole text, little-endian unsigned 32-bit."""
        out: list[int] = []
        for part in self.parts(text):
            if isinstance(part, int):
                out.append(part)
            elif part:
                out += self._ids(part)
        return np.array(out, dtype="<u4")

    def pre_tokens(self, text: str) -> list[str]:
        """Pre-tokens of a part without added tokens."""
        if _is_latin(text):
            return self._latin.findall(text)
        if self._settled(text):
            return self._unicode.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def pieces(self, pre_token: str) -> int:
        """Number of ids of one pre-token."""
        return len(self.fast._encode_single_piece(pre_token))


def _is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=2)
def load(spec: str) -> Bpe:
    """One instance for each file in each Python worker."""
    return Bpe(spec)


def read_spec(path: str) -> str:
    """The vocabulary file's text, read where the driver runs."""
    with open(path, encoding="utf-8") as file:
        return file.read()
