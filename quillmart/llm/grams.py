"""Hashed character n-grams of whole texts, in chunks of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Characters that are turned into features at a time.
CHUNK = 1 << 19

#: Code points below this are looked up for being a letter; those above all count as letters.
LOOKED_UP = 0x3000

#: Odd multipliers of the characters of an n-gram, for n of 2 and 3.
MULTIPLIERS = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def letters() -> np.ndarray:
    """For each code point that is looked up: itself if it is a letter, else a blank."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(LOOKED_UP)], np.uint32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def chunks(texts: Iterable[str], overlap: int = 2) -> Iterator[tuple[list[int], list[str]]]:
    """Numbers of texts and pieces of them in lower case, about ``CHUNK`` characters at a time.

    A longer text is cut; its pieces overlap, and n-grams count where they start before the overlap.
    """
    at: list[int] = []
    held: list[str] = []
    size = 0
    for i, text in enumerate(map(str.lower, texts)):
        start = 0
        while True:
            piece = text[start : start + CHUNK + overlap]
            at.append(i)
            held.append(piece)
            size += len(piece)
            if size >= CHUNK:
                yield at, held
                at, held, size = [], [], 0
            start += CHUNK
            if len(text) - start < overlap:
                break
    if held:
        yield at, held


def hashed(pieces: list[str], table: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of all 2-grams and 3-grams, and the number of the piece each is in.

    What is no letter counts as a blank. The n-grams never leave a piece.
    """
    joined = "".join(pieces)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(codes < LOOKED_UP, table[np.minimum(codes, LOOKED_UP - 1)], codes)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    piece = np.repeat(np.arange(len(pieces)), lengths)
    inside = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths) < CHUNK
    shift = np.uint32(32 - bits)
    a, b, c = MULTIPLIERS
    two = codes[:-1] * a + codes[1:] * b
    three = two[:-1] + codes[2:] * c
    same2, same3 = ((piece[:-n] == piece[n:]) & inside[:-n] for n in (1, 2))
    found = np.concatenate([mixed(two[same2]) >> shift, mixed(three[same3] + np.uint32(97)) >> shift])
    return found, np.concatenate([piece[:-1][same2], piece[:-2][same3]])


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint32(15))
    return h * np.uint32(2654435769)
