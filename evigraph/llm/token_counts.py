"""Token counts of byte-level BPE by rank-synchronous merging of ragged numpy arrays.

A batch of texts is split into pre-tokens; the distinct ones that were not seen
before become one flat array of symbol ids with the starts of the sequences.
In each round every sequence finds its pair of lowest rank and merges all its
occurrences at once, from left to right; sequences without a pair that can
merge leave the array with their number of symbols. A merged symbol appears
only in pairs of a higher rank, so this gives the symbols that merging one
pair at a time gives. Counts of pre-tokens are kept for later batches of the
task in a table of bounded size.

Cases: a null text counts as empty; an empty text has no tokens; the strings
of added tokens in a text count as one token each and part the text, as the
library does by default; repeated rows are counted each; other columns pass
unchanged; empty in, empty out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
KNOWN_LIMIT = 500_000
LIMIT_TOKENS = 512
BATCH_SYMBOLS = 2_000_000
SPLIT = regex.compile(public_tokenizers.PATTERN)


def printable_bytes() -> dict[str, int]:
    """The characters in which byte-level vocabularies write the 256 bytes: printable ones stand for themselves, the rest follow U+0100 in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """The merge table of a vocabulary file: symbol ids of bytes, sorted pair keys, their ranks and results."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.byte_ids = np.zeros(256, np.int64)
        for char, byte in printable_bytes().items():
            self.byte_ids[byte] = vocab[char]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.width = max(vocab.values()) + 2
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.results = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.no_rank = np.int64(len(pairs))
        self.added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added_pattern = regex.compile("|".join(map(regex.escape, self.added))) if self.added else None

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.no_rank)

    def count(self, tokens: list[bytes]) -> np.ndarray:
        """The number of symbols that are left of each (non-empty) byte string."""
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        symbols = self.byte_ids[np.frombuffer(b"".join(tokens), np.uint8)]
        owner = np.repeat(np.arange(len(tokens)), lengths)
        left = lengths.copy()
        last = np.zeros(len(symbols), bool)
        last[np.cumsum(lengths) - 1] = True
        rank = np.full(len(symbols), self.no_rank)
        rank[:-1] = self.rank_of(symbols[:-1], symbols[1:])
        rank[last] = self.no_rank
        while len(symbols):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.r_[first, len(symbols)])
            alive = np.repeat(lowest < self.no_rank, sizes)
            if not alive.all():  # finished sequences leave
                symbols, owner, rank, last, lowest, sizes = (
                    symbols[alive], owner[alive], rank[alive], last[alive], lowest[lowest < self.no_rank], sizes[lowest < self.no_rank])
                if not len(symbols):
                    break
            hit = rank == np.repeat(lowest, sizes)
            at = np.flatnonzero(hit)
            # in a run of hits at adjacent places (one symbol repeated) every second one merges
            run = np.cumsum(np.r_[True, np.diff(at) != 1]) - 1
            run_start = at[np.flatnonzero(np.r_[True, np.diff(at) != 1])]
            at = at[(at - run_start[run]) % 2 == 0]
            symbols[at] = self.results[rank[at]]
            last[at] = last[at + 1]
            left -= np.bincount(owner[at], minlength=len(left))
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            changed = np.zeros(len(symbols), bool)
            changed[at] = True
            changed[np.maximum(at - 1, 0)] = True
            symbols, owner, rank, last, changed = symbols[stay], owner[stay], rank[stay], last[stay], changed[stay]
            # the place before a merge may have been the removed half of another merge
            at = np.flatnonzero(changed)
            at = np.unique(np.r_[at, np.maximum(at - 1, 0)])
            inner = at[~last[at]]
            rank[at] = self.no_rank
            rank[inner] = self.rank_of(symbols[inner], symbols[inner + 1])
        return left


@lru_cache(maxsize=4)
def merges_of(path: str) -> Merges:
    return Merges(path)


class Counter:
    """Counts of texts; remembers the counts of up to ``known_limit`` pre-tokens."""

    def __init__(self, path: str, known_limit: int = KNOWN_LIMIT):
        self.merges, self.known_limit, self.known = merges_of(path), known_limit, {}

    def learn(self, tokens: set[str]) -> None:
        batch: list[str] = []
        size = 0
        for token in tokens:
            batch.append(token)
            size += len(token)
            if size >= BATCH_SYMBOLS:
                self.known.update(zip(batch, self.merges.count([t.encode() for t in batch]).tolist()))
                batch, size = [], 0
        if batch:
            self.known.update(zip(batch, self.merges.count([t.encode() for t in batch]).tolist()))

    def counts(self, texts: list[str]) -> list[int]:
        added = [0] * len(texts)
        parts: list[list[str]] = []
        for i, text in enumerate(texts):
            if self.merges.added and any(a in text for a in self.merges.added):
                bits = self.merges.added_pattern.split(text)
                added[i] = len(bits) - 1
                parts.append([t for bit in bits for t in SPLIT.findall(bit)])
            else:
                parts.append(SPLIT.findall(text))
        if len(self.known) > self.known_limit:
            self.known.clear()
        fresh: set[str] = set()
        for tokens in parts:
            fresh.update(tokens)
        self.learn(fresh - self.known.keys())
        get = self.known.__getitem__
        return [a + sum(map(get, tokens)) for a, tokens in zip(added, parts)]


def count_tokens(text: Column, path: str = VOCABULARY, known_limit: int = KNOWN_LIMIT, slice_chars: int = 4_000_000) -> Column:
    """The number of tokens of a text column; batches are worked off in slices of bounded size."""

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(path, known_limit)
        for batch in texts:
            out: list[int] = []
            held: list[str] = []
            size = 0
            for t in batch:
                held.append(t)
                size += len(t)
                if size >= slice_chars:
                    out += counter.counts(held)
                    held, size = [], 0
            yield pd.Series(out + counter.counts(held), dtype="int64")

    return count(F.coalesce(text, F.lit("")))
