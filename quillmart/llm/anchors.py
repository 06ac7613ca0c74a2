"""Anchors of byte strings: places chosen by content alone, one for every window.

The anchor of a window is the first of its grams of smallest hash, so that equal windows have their anchor
at the same place.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Sums:
    """Running sums of a byte string, from which the hash of any part follows."""

    def __init__(self, data: np.ndarray, base: int = BASES[0]):
        size = len(data) + 1
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.concatenate([np.ones(1, U), np.full(size - 1, U(base))]), dtype=U)
            back = np.full(size - 1, U(pow(base, -1, 1 << 64)))
            self.back = np.cumprod(np.concatenate([np.ones(1, U), back]), dtype=U)
            self.sums = np.concatenate([np.zeros(1, U), np.cumsum((data.astype(U) + U(1)) * powers[:-1], dtype=U)])

    def hashes(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[end] - self.sums[start]) * self.back[start])


def first_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the first smallest of each run of ``width`` values.

    A run is the end of one block of ``width`` values and the beginning of the next; running minima
    of the blocks from either side give both.
    """
    n = len(x)
    padded = np.concatenate([x, np.full(-n % width, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    place = np.arange(padded.size).reshape(padded.shape)
    ahead = np.minimum.accumulate(padded, 1)
    new = np.ones(padded.shape, bool)
    new[:, 1:] = padded[:, 1:] < ahead[:, :-1]
    ahead_at = np.maximum.accumulate(np.where(new, place, -1), 1).ravel()
    turned = padded[:, ::-1]
    behind = np.minimum.accumulate(turned, 1)
    new[:, 1:] = turned[:, 1:] <= behind[:, :-1]
    behind_at = np.minimum.accumulate(np.where(new, place[:, ::-1], padded.size), 1)[:, ::-1].ravel()
    m = n - width + 1
    first, second = behind[:, ::-1].ravel()[:m], ahead.ravel()[width - 1 : n]
    return np.where(first <= second, behind_at[:m], ahead_at[width - 1 : n])


@dataclass(frozen=True)
class Found:
    """Anchors of a string of several texts, in their order."""

    text: np.ndarray  # number of the text
    at: np.ndarray  # place of the anchor in its text
    left: np.ndarray  # bytes from the start of the anchor's first window to the anchor
    right: np.ndarray  # bytes from the anchor to the end of its last window
    gram: np.ndarray  # hash of the anchor's gram
    context: np.ndarray  # hash of all bytes of its windows


def find(texts: list[bytes], window: int, gram: int) -> Found:
    """The anchors of all windows of all texts; no window leaves its text."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < window:
        return Found(none, none, none, none, none, none)
    sums = Sums(data)
    h = sums.hashes(slice(0, len(data) - gram + 1), slice(gram, len(data) + 1))
    anchor = first_minimum(h, window - gram + 1)
    text = np.repeat(np.arange(len(texts)), lengths)[: len(anchor)]
    whole = np.arange(len(anchor)) + window <= offsets[text + 1]
    run = np.where(whole, anchor, -1)
    change = np.ones(len(run), bool)
    change[1:] = (run[1:] != run[:-1]) | (text[1:] != text[:-1])
    low = np.flatnonzero(change)
    high = np.append(low[1:], len(run)) - 1
    low, high = low[whole[low]], high[whole[low]]
    at = anchor[low]
    context = sums.hashes(low, high + window)
    return Found(
        text[low], at - offsets[text[low]], at - low, high + window - at, h[at].view(np.int64), context.view(np.int64)
    )
