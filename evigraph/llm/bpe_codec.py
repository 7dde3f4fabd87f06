"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

The ranks come from ``rank_file`` (a parameter; every executor has the file).
A text longer than ``chunk_chars`` is cut before a blank that follows a
character other than white space: no match of the split pattern holds white
space after another character, and its only look-ahead looks forward, so the
pattern finds the same matches on both sides of such a place as in the whole
text. A stretch without such a place is cut at the next match end that the
pattern itself gives. Decoding joins the bytes of the ids; a token may end
inside a character, so bytes are joined first and decoded last.

Cases: a null text counts as empty; an empty text has no ids; strings of
special tokens are ordinary text; other columns pass unchanged; repeated rows
are encoded each; empty in, empty out.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import Column
from pyspark.sql import functions as F

RANK_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
CHUNK_CHARS = 100_000
SAFE_CUT = regex.compile(r"(?<=\S) ")
MATCH = regex.compile(public_tokenizers.PATTERN)

ENCODED = "n_tokens long, ids_sha256 string, decoded_sha256 string"


@lru_cache(maxsize=4)
def encoding(rank_file: str) -> tiktoken.Encoding:
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, chunk_chars: int = CHUNK_CHARS) -> Iterator[str]:
    """Cut ``text`` where the split pattern matches alike on both sides; pieces join to the text."""
    start = 0
    while len(text) - start > chunk_chars:
        cut = SAFE_CUT.search(text, start + chunk_chars, start + 2 * chunk_chars)
        if cut:
            end = cut.start()
        else:
            end = start
            while end < len(text) and end - start < chunk_chars:
                end = MATCH.match(text, end).end()
        yield text[start:end]
        start = end
    yield text[start:]


def encode(text: str, rank_file: str = RANK_FILE, chunk_chars: int = CHUNK_CHARS) -> list[int]:
    codec = encoding(rank_file)
    if len(text) <= chunk_chars:
        return codec.encode_ordinary(text)
    return [i for piece in pieces(text, chunk_chars) for i in codec.encode_ordinary(piece)]


def decode(ids: list[int], rank_file: str = RANK_FILE) -> bytes:
    return encoding(rank_file).decode_bytes(ids)


def encode_column(text: Column, rank_file: str = RANK_FILE, chunk_chars: int = CHUNK_CHARS) -> Column:
    """The token ids of a text column."""

    @F.pandas_udf("array<int>")
    def ids_of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([encode(t, rank_file, chunk_chars) for t in batch], dtype=object)

    return ids_of(F.coalesce(text, F.lit("")))


def decode_column(ids: Column, rank_file: str = RANK_FILE) -> Column:
    """The bytes of a column of token ids; null counts as no ids."""

    @F.pandas_udf("binary")
    def bytes_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([decode(list(i), rank_file) for i in batch], dtype=object)

    return bytes_of(F.coalesce(ids, F.array().cast("array<int>")))


def encode_checked(text: Column, rank_file: str = RANK_FILE, chunk_chars: int = CHUNK_CHARS) -> Column:
    """The token ids of a text column and whether they decode to its bytes: one function, so that a task needs one Python worker, not two."""

    @F.pandas_udf("ids array<int>, decodes boolean")
    def checked(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            ids = [encode(t, rank_file, chunk_chars) for t in batch]
            decodes = [decode(i, rank_file) == t.encode("utf-8") for i, t in zip(ids, batch)]
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decodes": pd.Series(decodes, dtype=bool)})

    return checked(F.coalesce(text, F.lit("")))


def round_trip(text: Column, rank_file: str = RANK_FILE, chunk_chars: int = CHUNK_CHARS) -> Column:
    """Encode and decode in one pass over the batch: number of ids and the digests of ids and bytes."""

    @F.pandas_udf(ENCODED)
    def digests(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for t in batch:
                ids = encode(t, rank_file, chunk_chars)
                rows.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                             hashlib.sha256(decode(ids, rank_file)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digests(F.coalesce(text, F.lit("")))
