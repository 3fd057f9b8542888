"""Dense statistics of texts from a table of distinct words: each word is measured once, texts are sums over their words."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np


class WordTable:
    """Codes of the white-space separated words of texts, and a row of measures per code.

    The table starts anew when it holds ``limit`` words.
    """

    def __init__(self, measure: Callable[[list[str]], np.ndarray], width: int, limit: int = 200_000):
        self.measure, self.width, self.limit = measure, width, limit
        self._forget()

    def _forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.rows = np.zeros((1 << 12, self.width), np.float32)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(codes of all words in order, number of words per text); ``rows[codes]`` are their measures."""
        if len(self.codes) >= self.limit:
            self._forget()
        words: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            split = text.split()
            counts[i] = len(split)
            words += split
        if new := list(set(words).difference(self.codes)):
            known = len(self.codes)
            while known + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[known : known + len(new)] = self.measure(new)
            self.codes.update(zip(new, range(known, known + len(new))))
        return np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words)), counts


def per_text(values: np.ndarray, counts: np.ndarray, how=np.add) -> np.ndarray:
    """Reduce rows of words to rows of texts; texts without words give 0."""
    out = np.zeros((len(counts), *values.shape[1:]), np.float64)
    full = counts > 0
    if full.any():
        starts = (np.cumsum(counts) - counts)[full]
        out[full] = how.reduceat(values.astype(np.float64), starts, axis=0)
    return out


def repetition(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per text: share of distinct words, share of the commonest word, share of words equal to the one before."""
    n = len(counts)
    out = np.zeros((n, 3))
    if not len(codes):
        return out
    text = np.repeat(np.arange(n), counts)
    key, times = np.unique(text * (int(codes.max()) + 1) + codes, return_counts=True)
    owner = key // (int(codes.max()) + 1)
    size = np.maximum(counts, 1)
    out[:, 0] = np.bincount(owner, minlength=n) / size
    np.maximum.at(out[:, 1], owner, times)
    out[:, 1] /= size
    same = (codes[1:] == codes[:-1]) & (text[1:] == text[:-1])
    out[:, 2] = np.bincount(text[1:][same], minlength=n) / size
    return out


_LETTERS = re.compile(r"[^\W\d_]+")


def letters_of(word: str) -> str:
    """The longest run of letters in a word."""
    return word if word.isalpha() else max(_LETTERS.findall(word), key=len, default="")


def line_stats(text: str) -> tuple[float, float, float]:
    """Number of lines, share of repeated lines, share of lines of under four words."""
    lines = [x for x in text.split("\n") if x.strip()]
    n = len(lines)
    if not n:
        return 0.0, 0.0, 0.0
    return float(n), 1 - len(set(lines)) / n, sum(x.count(" ") < 3 for x in lines) / n
