"""Words of letters and digits, as whole batches of texts."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain, count

import numpy as np

#: A-Z become a-z; of ASCII only digits and letters stay, the rest are spaces; bytes of other characters stay.
TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text whose A-Z are lower-cased, in UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split() if text else []


def flat(texts: Iterable[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, which of them each word is, words per text) of several texts, one after the other."""
    lists = [words(t) for t in texts]
    known: dict[bytes, int] = defaultdict(count().__next__)
    sizes = np.array([len(own) for own in lists], np.int64)
    which = np.fromiter(map(known.__getitem__, chain.from_iterable(lists)), np.int64, int(sizes.sum()))
    return list(known), which, sizes


def portions(texts: Iterable[str | None], chars: int = 4_000_000) -> Iterator[slice]:
    """Slices of neighbouring texts of about that many characters together; a longer text is one of its own."""
    first, held = 0, 0
    k = -1
    for k, text in enumerate(texts):
        n = len(text or "")
        if held and held + n > chars:
            yield slice(first, k)
            first, held = k, 0
        held += n
    if k >= first:
        yield slice(first, k + 1)


def word_counts(texts: Iterable[str | None]) -> np.ndarray:
    """The number of words of each text."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    inside = np.frombuffer(b" ".join([*parts, b""]).translate(TABLE), np.uint8) != 32
    begin = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    return np.bincount(np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), begin, "right"), minlength=len(parts))


class Hashed:
    """All words of several texts: a 64-bit hash of each, where its bytes begin and end, and which text it is of.

    Hashes depend on a word's bytes alone. They are for finding candidates; equal hashes do not prove equal words.
    """

    def __init__(self, texts: Iterable[str | bytes | None]):
        parts = [t if isinstance(t, bytes) else (t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.data = b" ".join([*parts, b" " * 8]).translate(TABLE)
        inside = np.frombuffer(self.data, np.uint8) != 32
        edges = np.flatnonzero(np.diff(inside, prepend=False))
        self.begin, self.end = edges[0::2], edges[1::2]
        offsets = np.cumsum([0, *(len(p) + 1 for p in parts)])
        self.owner = np.searchsorted(offsets, self.begin, "right") - 1
        self.sizes = np.bincount(self.owner, minlength=len(parts))
        #: Eight bytes from every position on, little-endian.
        eights = np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,))
        left, at = self.end - self.begin, np.arange(len(self.begin))
        self.ids = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        place = self.begin
        while len(at):
            piece = eights[place]
            short = left < 8
            piece[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
            mixed = (self.ids[at] ^ piece) * np.uint64(0xC2B2AE3D27D4EB4F)
            self.ids[at] = mixed ^ mixed >> np.uint64(32)
            more = left > 8
            at, place, left = at[more], place[more] + 8, left[more] - 8

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, id) of each run of `width` words inside a text."""
        n = len(self.ids) - width + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        first = np.flatnonzero(self.owner[:n] == self.owner[width - 1 :])
        out = np.full(n, 0x9E3779B97F4A7C15 * (2 * width + 1) & 0xFFFFFFFFFFFFFFFF, np.uint64)
        for k in range(width):
            out = (out ^ self.ids[k : k + n]) * np.uint64(0xC2B2AE3D27D4EB4F)
            out ^= out >> np.uint64(29)
        return first, out[first]

    def text(self, first: int, last: int) -> bytes:
        """The words from first to before last, joined by one space."""
        return b" ".join(self.data[self.begin[first] : self.end[last - 1]].split()) if last > first else b""
