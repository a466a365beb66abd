"""Tokenizers inside tasks.

A vocabulary file is read once on the driver (its path is a parameter) and sent to the tasks as bytes;
such files have a few megabytes.  Texts are cut where no token can cross, each distinct part is encoded
once and then looked up, so a long text costs a dictionary lookup a word.  Tables of parts are bounded.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import public_tokenizers

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
_LOADED: dict = {}


def shipped(spark, path: str):
    """The file's bytes as a broadcast."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def loaded(kind, data: bytes, *args):
    """One ``kind(data, *args)`` for a Python worker, kept over its tasks."""
    key = (kind, zlib.crc32(data), len(data), args)
    if key not in _LOADED:
        _LOADED[key] = kind(data, *args)
    return _LOADED[key]


#: Texts in which Python's classes of letters, digits and white space, and its lower case, are those of
#: the tokenizers: line ends, tabs, ASCII and Latin letters and signs, without special strings.
_PLAIN = re.compile(r"[^\n\r\t -~\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0131-\u024f]|<\|")
_WORDS = re.compile(r"'(?:[stmd]|re|ve|ll)|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
_RUNS = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_ODD_SPACE = re.compile(r"[^\S \n]")
_PART = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_BORDER = re.compile(r"(?<=\S)(?=[ \n])")


def word_parts(text: str) -> tuple[bool, list[str]]:
    """For a tokenizer that lower-cases and drops white space: its words, or parts cut at blanks."""
    if _PLAIN.search(text):
        return False, text.replace("\n", " ").split(" ")
    return True, _WORDS.findall(text.lower())


def run_parts(text: str) -> tuple[bool, list[str]]:
    """For a byte-level tokenizer: its runs, or parts cut before white space that follows something else."""
    if not _PLAIN.search(text):
        return True, _RUNS.findall(text)
    return False, _BORDER.split(text) if _ODD_SPACE.search(text) else _PART.findall(text)


def byte_letters() -> list[str]:
    """The character that stands for each byte: itself if it is visible, else one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class PartIds:
    """Token ids of whole texts as little-endian unsigned integers, through a table of parts."""

    MOST, LONG = 400_000, 100

    def __init__(self, data: bytes, parts: str, code: str = "I", plain_specials: bool = False):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_buffer(data)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = plain_specials
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.parts, self.code, self.known = globals()[parts], code, {}

    def _of_letters(self, part: str) -> list[int]:
        """Ids of a part of letters, with a space before it or not: one word to the model."""
        mapped = part.replace(" ", self.letters[32]) if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
        return [t.id for t in self.model.tokenize(mapped)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        cut, known = [self.parts(t) for t in texts], self.known
        fresh = list(set().union(*(words for plain, words in cut if plain)).difference(known))
        rest = []
        for part in fresh:
            if part.lstrip(" ").isalpha() and part[:2] != "  ":
                known[part] = array(self.code, self._of_letters(part)).tobytes()
            else:
                rest.append(part)
        odd = list(set().union(*(words for plain, words in cut if not plain)).difference(known))
        rest += set(odd).difference(rest)
        for at in range(0, len(rest), 4096):
            some = rest[at:at + 4096]
            for part, found in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                known[part] = array(self.code, found.ids).tobytes()
        out = [b"".join(map(known.__getitem__, words)) for _, words in cut]
        for part in {*fresh, *odd}:
            if len(part) > self.LONG:
                del known[part]
        while len(known) > self.MOST:
            known.popitem()
        return out
