"""Exact cuts of a text into pieces that byte-level BPE encodes independently, and a bounded cache over them.

A place before a space that is followed by something other than white space always starts a match of the split
pattern: no alternative reaches over it, a run of white space gives its last space to what follows, and any other
match ends at white space. So a text's tokens are those of its pieces between such places, one after another.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

#: A space with white space behind it is no such place. Python's class of white space holds the pattern's.
_RUN = re.compile(r" (?=\s|\Z)")
# ASCII, and letters (Latin, Cyrillic, kana, Han, Hangul) that are letters in every version of Unicode.
_OTHER = re.compile("[^\\x00-\\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0400-\u0481\u048a-\u04ff\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]+")
_CUT = re.compile(r"(?= \S)")


def pieces(text: str) -> list[str]:
    """The text in pieces; joined they give the text."""
    if not text:
        return []
    if "\0" in text or _RUN.search(text):
        return [p for p in _CUT.split(text) if p]
    cut = text.replace(" ", "\0 ").split("\0")
    return cut if cut[0] else cut[1:]


def every_space_cuts(text: str) -> bool:
    """Whether a match starts at every space: none has white space or the end behind it."""
    return _RUN.search(text) is None


def is_settled(text: str) -> bool:
    """Whether all libraries put each character into the same class: it holds ASCII and settled letters alone."""
    return _OTHER.search(text) is None


def settled_parts(text: str) -> Iterator[str]:
    """A text in which every space cuts, in parts between spaces: each piece that isn't settled is one, and all between two
    such pieces."""
    at = 0
    for found in _OTHER.finditer(text):
        if found.start() < at:
            continue
        a = max(text.rfind(" ", at, found.start()), at)
        b = text.find(" ", found.end())
        if a > at:
            yield text[at:a]
        at = b if b >= 0 else len(text)
        yield text[a:at]
    if at < len(text):
        yield text[at:]


class PieceCache:
    """piece -> value by encode(list of pieces), kept for at most limit pieces; encode is asked once a text for all that are new."""

    def __init__(self, encode: Callable[[list[str]], list], limit: int = 400_000):
        self.encode, self.limit, self.known = encode, limit, {}

    def of(self, wanted: list[str]) -> list:
        """The values of the pieces wanted, in order."""
        try:
            return list(map(self.known.__getitem__, wanted))
        except KeyError:
            self.learn({*wanted})
            return list(map(self.known.__getitem__, wanted))

    def learn(self, wanted: set[str]) -> None:
        """After it, known has all of wanted."""
        new = [p for p in wanted if p not in self.known]
        if len(self.known) + len(new) > self.limit:
            # what is wanted now is likely to be wanted again
            self.known = {p: self.known[p] for p in wanted if p in self.known}
        self.known.update(zip(new, self.encode(new), strict=True))
