"""Token ids of whole texts by the tokenizers library, with repeated words encoded once.

The files served here cut a text into pieces by a fixed pattern before any merge
is tried, and no piece runs on past white space.  The ids of a text are thus the
ids of its chunks between white space laid end to end, and those of a chunk the
ids of its pieces, which the library's model gives.  A worker keeps bounded
tables of chunks.  Added tokens such as <|endoftext|> count as the
library counts them: a text that holds one is encoded by a plain call, as is
every text of a file of another kind.  The ids are those of
encode(text, add_special_tokens=False).
"""

from __future__ import annotations

import json
import os
import re
from array import array

#: Letters that are one character in each case and in every normal form.
LETTERS = "A-Za-z\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u012f\\u0131-\\u0148\\u014a-\\u017e"
#: Letters between ASCII signs; chunks with an apostrophe or other characters are cut by the library.
_SIMPLE = re.compile(f"([!-&(-/:-@\\[-`{{-~]*)([{LETTERS}]*)([!-&(-/:-@\\[-`{{-~]*)")
#: Chunks with the space before them, and runs of white space as the byte-level pattern cuts them.
_RUNS = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Python takes these for white space, the tokenizers library does not.
_NOT_SPACE = "\x1c\x1d\x1e\x1f"
#: The pattern of the word tokenizer, a fixed value of its file.
_WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Entries of each of the two generations of a table, and the longest key that is kept.
ENTRIES, KEPT_CHARS = 350_000, 40


def byte_alphabet() -> dict[int, str]:
    """Stand-ins of bytes that are not printable: the characters from U+0100 on, in turn."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in printable)}


class Table(dict):
    """Bounded table from key to packed ids; asks for what it doesn't hold and lets its older half go when it is full."""

    def __init__(self, ask):
        super().__init__()
        self.ask, self.older = ask, {}

    def __missing__(self, key: str) -> bytes:
        ids = self.older.get(key)
        if ids is None:
            ids = self.ask(key)
        if len(key) <= KEPT_CHARS:
            if len(self) >= ENTRIES:
                self.older = dict(self)
                self.clear()
            self[key] = ids
        return ids


class Encoder:
    """Ids of one tokenizers file, packed as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            about = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.added = [t["content"] for t in about["added_tokens"]]
        self.cut = {"words": self._words, "bytes": self._bytes}.get(_kind(about), self.plain)
        self.model, self.alphabet = self.tokenizer.model, byte_alphabet()
        self.space = self.alphabet[32]
        self.after_space, self.alone = Table(lambda c: self._chunk(c, " ")), Table(lambda c: self._chunk(c, ""))
        self.words = Table(lambda c: self._chunk(c, None))
        self.spaces = Table(self.plain)

    def __call__(self, text: str | None) -> bytes:
        """Ids of a whole text; null and empty texts have none."""
        if not text:
            return b""
        if any(t in text for t in self.added) or any(c in text for c in _NOT_SPACE):
            return self.plain(text)
        return self.cut(text)

    def plain(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _words(self, text: str) -> bytes:
        """White space parts chunks and is dropped."""
        return b"".join(map(self.words.__getitem__, text.split()))

    def _bytes(self, text: str) -> bytes:
        """Chunks go with the one space before them; other white space stands alone."""
        out = []
        try:
            for line in text.split("\n"):
                first, *rest = line.split(" ")
                out.append(self.alone[first])
                out += map(self.after_space.__getitem__, rest)
                out.append(self.spaces["\n"])
            out.pop()
            return b"".join(out)
        except ValueError:  # white space in a row, or of another kind
            return b"".join([self.spaces[run] if run.isspace() else self.after_space[run[1:]] if run[0] == " " else self.alone[run] for run in _RUNS.findall(text)])

    def _chunk(self, chunk: str, before: str | None) -> bytes:
        """Ids of a chunk; before is the white space that counts with it, None in a text of words."""
        if before is None and chunk != chunk.lower() and _SIMPLE.fullmatch(chunk):
            return self.words[chunk.lower()]
        if chunk.isascii() and chunk.isalpha():
            return self._piece((before or "") + chunk)
        m = _SIMPLE.fullmatch(chunk)
        if m is None or not chunk:
            if before is not None and (not chunk or any(map(str.isspace, chunk))):
                raise ValueError("white space in a chunk")
            return self.plain((before or "") + chunk)
        parts = [p for p in m.groups() if p]
        if len(parts) == 1:
            return self._piece((before or "") + chunk)
        first, rest = (self.words, self.words) if before is None else (self.after_space if before else self.alone, self.alone)
        return b"".join([first[parts[0]], *[rest[p] for p in parts[1:]]])

    def _piece(self, piece: str) -> bytes:
        mapped = piece.replace(" ", self.space) if piece.isascii() else piece.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()


def _kind(about: dict) -> str | None:
    """Which of the two ways to cut a text a file describes, if any."""
    cut, model = about["pre_tokenizer"] or {}, about["model"]
    if about["truncation"] or about["padding"] or model["type"] != "BPE" or model.get("dropout"):
        return None
    if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in about["added_tokens"]):
        return None
    if cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"] and about["normalizer"] is None:
        return "bytes"
    steps, normal = cut.get("pretokenizers", []), (about["normalizer"] or {}).get("normalizers", [])
    if [s["type"] for s in steps] != ["Split", "ByteLevel"] or [s["type"] for s in normal] != ["NFC", "Replace", "Lowercase"]:
        return None
    split, level = steps
    by_words = split["pattern"] == {"Regex": _WORDS} and split["invert"] and split["behavior"] == "Removed"
    return "words" if by_words and not level["use_regex"] and not level["add_prefix_space"] else None


_encoders: dict[str, Encoder] = {}


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> Encoder:
    """This worker's encoder of a tokenizers file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
