"""Column-wise construction of the Burrows-Wheeler transform and common prefixes of many strings.

Round t inserts, for every string at once, the row of its suffix of length t:
the row follows from the rank of the symbol that was inserted in the round
before. Transform and common prefixes of the collection are kept in two files
that each round reads from front to end and writes anew. Symbols are the UTF-8
bytes plus one; 0 ends a string (it precedes the whole string), and equal
suffixes are ordered by their strings.
"""

from __future__ import annotations

import tempfile

import numpy as np


class Collection:
    """``strings``: non-empty byte strings, each shorter than 255."""

    def __init__(self, strings: list[bytes], folder: str | None = None):
        self.m = len(strings)
        self.lengths = np.fromiter(map(len, strings), np.int64, self.m)
        self.text = np.frombuffer(b"".join(strings), np.uint8) + np.uint8(1)
        self.starts = np.cumsum(self.lengths) - self.lengths
        with tempfile.TemporaryFile(dir=folder, buffering=0) as bwt, tempfile.TemporaryFile(dir=folder, buffering=0) as lcp:
            self.files, self.size = (bwt, lcp), 0
            self._store(self.text[self.starts + self.lengths - 1], np.zeros(self.m, np.uint8))
            self._insert_all()
            self.bwt, self.lcp = self._load()
        del self.files

    def _store(self, bwt: np.ndarray, lcp: np.ndarray) -> None:
        self.size = len(bwt)
        for array, file in zip((bwt, lcp), self.files):  # over the shorter arrays of the round before
            file.seek(0)
            view = memoryview(array)
            while view:
                view = view[file.write(view):]

    def _load(self) -> tuple[np.ndarray, np.ndarray]:
        out = np.empty(self.size, np.uint8), np.empty(self.size, np.uint8)
        for array, file in zip(out, self.files):
            file.seek(0)
            view = memoryview(array)
            while view:
                view = view[file.readinto(view):]
        return out

    def _insert_all(self) -> None:
        rows, who = np.arange(self.m), np.arange(self.m)  # of the suffixes of the last round, in row order
        length = 0
        while len(who):
            length += 1
            bwt, lcp = self._load()
            order = np.argsort(bwt, kind="stable")[np.count_nonzero(bwt == 0):]
            string_at = np.full(len(bwt), -1, np.int32)
            string_at[rows] = who
            string_at = string_at[order]  # row m + k stands for the suffix that order[k] extends
            fresh = string_at >= 0
            new = np.flatnonzero(fresh)
            who = string_at[new]
            rows = new + self.m
            ended = self.lengths[who] == length
            symbol = np.zeros(len(who), np.uint8)
            inner = who[~ended]
            symbol[~ended] = self.text[self.starts[inner] + self.lengths[inner] - length - 1]
            # common prefixes change at the new rows and at the rows after them
            fresh[1:] |= fresh[:-1].copy()
            fresh[:1] = False
            touched = np.flatnonzero(fresh)
            low, high = order[touched - 1], order[touched]
            same = bwt[low] == bwt[high]
            prefix = np.zeros(len(touched), np.uint8)
            prefix[same] = least_between(lcp, low[same] + 1, high[same] + 1) + np.uint8(1)
            stay = np.ones(len(bwt) + len(rows), bool)
            stay[rows] = False
            out = np.empty(len(stay), np.uint8), np.zeros(len(stay), np.uint8)
            out[0][stay], out[1][stay] = bwt, lcp
            out[0][rows] = symbol
            out[1][touched + self.m] = prefix
            self._store(*out)
            rows, who = rows[~ended], who[~ended]

    def rows_of(self, least_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(string, offset, row) of all suffixes of at least ``least_length`` symbols, by walking from the ends of the strings."""
        order = np.argsort(self.bwt, kind="stable")[np.count_nonzero(self.bwt == 0):]
        step = np.empty(len(self.bwt), np.int64)
        step[order] = np.arange(self.m, self.m + len(order))
        at, who, parts = np.arange(self.m), np.arange(self.m), []
        for length in range(1, int(self.lengths.max(initial=0)) + 1):
            on = self.lengths[who] >= length
            who = who[on]
            at = step[at[on]]
            if length >= least_length:
                parts.append((who, self.lengths[who] - length, at))
        if not parts:
            return tuple(np.empty(0, np.int64) for _ in range(3))
        return tuple(np.concatenate(x) for x in zip(*parts))


def least_between(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """min(values[begin:end]) for each pair, begin < end."""
    if not len(begin):
        return np.empty(0, values.dtype)
    by_begin = np.argsort(begin, kind="stable")
    pairs = np.stack([begin[by_begin], end[by_begin]], 1).ravel()
    out = np.empty(len(begin), values.dtype)
    out[by_begin] = np.minimum.reduceat(np.append(values, values.dtype.type(255)), pairs)[::2]
    return out
