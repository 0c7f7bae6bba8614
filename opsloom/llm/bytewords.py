"""Words of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
#: A random odd-stepped value for each byte; white space adds nothing to a word.
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=_U)
_BYTE[_SPACE] = 0
_BASE = _U(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64: spreads every bit over all others."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, _U), np.multiply.accumulate(np.full(n, _BASE, _U))])


@dataclass
class Words:
    """bytes: of all texts, A-Z in lower case; raw: as they were; start, length: of each word; first: each
    text's first word, and the number of words at the end."""

    bytes: np.ndarray
    raw: np.ndarray
    start: np.ndarray
    length: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not self.start.size:
            return np.zeros(0, _U)
        reach = np.diff(np.append(self.start, self.bytes.size))
        place = np.arange(self.start[0], self.bytes.size) - np.repeat(self.start, reach)
        with np.errstate(over="ignore"):
            values = _BYTE[self.bytes[self.start[0] :]] * _powers(int(reach.max()))[place]
            return mixed(np.add.reduceat(values, self.start - self.start[0]) + self.length.astype(_U))


def words_of(texts: list[str | None]) -> Words:
    coded = [(t or "").encode() for t in texts]
    raw = np.frombuffer(b" ".join(coded) + b" ", np.uint8)
    gap = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap]).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    ends_at = np.cumsum([len(c) + 1 for c in coded]) if coded else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.searchsorted(start, ends_at)]).astype(np.int64)
    return Words(_FOLD[raw], raw, start, end - start, first)


#: A longer text is worked on in pieces of about so many code points, cut at white space.
PIECE = 1 << 19
_GAP = re.compile("[\x20\x09-\x0d]")


def pieces(text: str, most: int = PIECE) -> Iterator[str]:
    """A text cut at white space, so that its words are those of its pieces; a word is never cut."""
    at = 0
    while len(text) - at > most:
        gap = _GAP.search(text, at + most)
        if not gap:
            break
        yield text[at : gap.start()]
        at = gap.end()
    yield text[at:]


def groups(texts: list[str | None], most: int = PIECE) -> Iterator[tuple[list[int], list[str]]]:
    """Texts, the long ones in pieces, in groups of about `most` code points: whose each piece is, and the pieces."""
    owners, held, size = [], [], 0
    for i, text in enumerate(texts):
        for piece in pieces(text or "", most):
            if held and size + len(piece) > most:
                yield owners, held
                owners, held, size = [], [], 0
            owners.append(i)
            held.append(piece)
            size += len(piece)
    if held:
        yield owners, held
