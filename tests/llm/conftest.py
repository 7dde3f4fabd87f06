import os
import random
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

WORDS = "the stone river carries small boats past green hills while old birds watch quiet water under bright morning light and wind".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "s", "ing"]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Texts that are null, empty, blank, very long, repeated, nearly equal; repeated rows; a null id; extra columns with clashing names."""
    rng = random.Random(4)
    base = prose(rng, 120)
    near = base.replace("river", "stream", 1)
    line = "A line that several documents of this table hold"
    long = prose(rng, 30_000)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, near, "en", "b"), (4, None, None, None), (5, "", "en", "b"), (6, " \t\n ", "en", "a"),
        (7, f"{line}\n{prose(rng, 30)}", "de", "a"), (8, f"{prose(rng, 20)}\n  {line.upper()}\t\n\nend", "de", None),
        (9, f"{line}\n{line}", None, "b"), (10, "two words", "en", "c"), (11, long, "en", "a"), (12, long[:100_000] + prose(rng, 200), "en", "c"),
        (12, long[:100_000] + prose(rng, 210), "en", "c"), (13, "é🎉<|endoftext|> don't 日本\x1c\x85 x" * 30, "ja", "c"), (13, "é🎉<|endoftext|> don't 日本\x1c\x85 x" * 30, "ja", "c"),
        (None, prose(rng, 40), "en", "a"), (15, "a" * 20_000, "xx", "a"), (16, "# * $ % & | < >\n" * 12, "xx", "b"),
    ]
    docs = spark.createDataFrame([(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in rows],
                                 "doc_id long, text string, lang string, source string, n_chars int")
    return docs.select("*", F.lit(7).alias("kept"), F.lit("x").alias("size"), F.lit("y").alias("row"), F.lit(1.5).alias("line"))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
