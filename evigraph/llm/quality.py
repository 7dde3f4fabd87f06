"""Quality rules as a short-circuit cascade, in DataFrame functions only.

``features`` computes the figures of a text inside its row: words, characters
in words, symbols, repeated lines, and words covered by five-word windows that
occur twice or more in the text. A rule is a condition that rejects. The
cascade estimates on a bounded sample what every rule costs (seconds to
evaluate it over the sample) and which share it rejects, orders the rules by
rejection per cost, and evaluates them in one CASE expression, so a text that
an early rule rejects never reaches the later ones. The order changes the cost
and the rule that is named first, never the verdict.

Cases: a null text counts as empty (no words); an undecided (null) condition
does not reject; repeated rows are judged each; other columns pass unchanged;
an empty table gives an empty one, with the rules in the order given.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import words
from evigraph.session import cut_lineage

SAMPLE_ROWS = 2_000
SAMPLE_SEED = 11
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for a row that goes."""

    name: str
    rejects: Column


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(tokens: Column, window: int = WINDOW) -> Column:
    """Words of the array ``tokens`` that lie in a window of words found twice or more in it, the first one included."""
    def covered(pairs: Column) -> Column:
        def twin(i: Column) -> Column:
            own = F.get(pairs, i)["h"]
            return own.eqNullSafe(F.get(pairs, i - 1)["h"]) | own.eqNullSafe(F.get(pairs, i + 1)["h"])

        places = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), twin)
        return F.aggregate(
            F.sort_array(F.transform(places, lambda i: F.get(pairs, i)["i"])),
            F.struct(F.lit(0).alias("n"), F.lit(-window).alias("at")),
            lambda a, p: F.struct((a["n"] + F.least(F.lit(window), p - a["at"])).alias("n"), p.alias("at")), lambda a: a["n"])

    def of_windows(hashes: Column) -> Column:  # only a text with an equal pair needs places and a sort
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(hashes) > F.size(F.array_distinct(hashes)), let(pairs, covered)).otherwise(F.lit(0))

    hashes = F.transform(F.sequence(F.lit(1), F.size(tokens) - (window - 1)), lambda i: F.xxhash64(F.slice(tokens, i, window)))
    return F.when(F.size(tokens) > window, let(hashes, of_windows)).otherwise(F.lit(0)).cast("long")


def symbols(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long")


def word_lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit("[^ \\x09-\\x0D]")))


def word_chars(tokens: Column) -> Column:
    return F.char_length(F.array_join(tokens, "")).cast("long")


def features(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words of every text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = docs.select("doc_id", words(text).alias("words"), symbols(text).alias("n_symbols"), word_lines(text).alias("lines"))
    return parts.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), word_chars(F.col("words")).alias("word_chars"), "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"))


def base_rules() -> list[Rule]:
    """The two rules of the base verdict, on the columns of ``features``."""
    return [Rule("few_words", F.col("n_words") < MIN_WORDS),
            Rule("repetitive", 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))]


def extra_rules() -> list[Rule]:
    """Rules that only plain junk meets, on the columns of ``features``: symbols for words, words of odd length, mostly repeated lines."""
    return [Rule("symbols", 10 * F.col("n_symbols") > 3 * F.col("n_words")),
            Rule("short_words", F.col("word_chars") < 2 * F.col("n_words")),
            Rule("long_words", F.col("word_chars") > 20 * F.col("n_words")),
            Rule("repeated_lines", 2 * F.col("n_dup_lines") > F.col("n_lines"))]


def text_rules(text: Column) -> list[Rule]:
    """The same rules on a text column; each computes only what it needs, and only for rows that reach it."""
    text = F.coalesce(text, F.lit(""))

    def on_words(condition: Callable[[Column], Column]) -> Column:
        return let(words(text), condition)

    def mostly_repeated(lines: Column) -> Column:
        return 2 * (F.size(lines) - F.size(F.array_distinct(lines))) > F.size(lines)

    return [Rule("few_words", on_words(lambda w: F.size(w) < MIN_WORDS)),
            Rule("repetitive", on_words(lambda w: 100 * repeated_words(w) > MAX_REPEAT_PERCENT * F.size(w))),
            Rule("symbols", on_words(lambda w: 10 * symbols(text) > 3 * F.size(w))),
            Rule("short_words", on_words(lambda w: word_chars(w) < 2 * F.size(w))),
            Rule("long_words", on_words(lambda w: word_chars(w) > 20 * F.size(w))),
            Rule("repeated_lines", let(word_lines(text), mostly_repeated))]


def sample_of(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``sample_rows`` rows, written, to estimate costs on."""
    total = docs.count()
    return cut_lineage(docs.sample(min(1.0, sample_rows / max(total, 1)), seed=SAMPLE_SEED))


def ordered(sample: DataFrame, rules: Sequence[Rule]) -> list[Rule]:
    """The rules by falling rejection per cost over ``sample``; the columns that a rule doesn't use are pruned and cost it nothing."""
    worth = {}
    for rule in rules:
        began = time.perf_counter()
        share = sample.agg(F.avg(F.coalesce(rule.rejects, F.lit(False)).cast("double"))).first()[0]
        worth[rule.name] = (share or 0.0) / (time.perf_counter() - began)
    return sorted(rules, key=lambda r: -worth[r.name])


def verdict(rules: Sequence[Rule]) -> Column:
    """The name of the first rule that rejects, null for a kept row; later rules are not evaluated."""
    first, *rest = rules
    chain = F.when(first.rejects, F.lit(first.name))
    for rule in rest:
        chain = chain.when(rule.rejects, F.lit(rule.name))
    return chain


def cascade(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with ``failed_rule`` (null: kept) by the rules on ``text`` in their estimated order."""
    rules = text_rules(F.col("text"))
    return docs.withColumn("failed_rule", verdict(ordered(sample_of(docs.select("text"), sample_rows), rules)))


def judged_features(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``features`` of every document with base_failed and the cascade's failed_rule, each figure computed once."""
    docs = docs.select("doc_id", "text")
    base, extra = base_rules(), extra_rules()
    order = ordered(features(sample_of(docs, sample_rows)), base + extra)
    figures = features(docs)
    failed = base[0].rejects | base[1].rejects
    return figures.select("*", failed.alias("base_failed"), verdict(order).alias("failed_rule"))
