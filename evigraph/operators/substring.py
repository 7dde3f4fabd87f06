"""Which texts contain which terms, by an index of the places where a term may begin.

A term is found where a text has its first ``HEAD`` characters (all of a shorter
term). There the text is cut to the lengths that terms with this head have, and
the pieces meet the terms by equality, so no text is compared with a term that
it does not contain, however many texts share the term's parts. Terms and texts
are both DataFrames of any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.session import cut_lineage

HEAD = 3


def pieces(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, term) and the other columns of ``texts(id, text, …)``: the parts that begin like a term and are as long as one that begins so."""
    kept = [c for c in texts.columns if c != "text"]
    heads = cut_lineage(terms.groupBy(F.left("term", F.lit(HEAD)).alias("head")).agg(F.collect_set(F.char_length("term")).alias("sizes")))
    length = F.char_length("text")

    def begins(size: int):
        places = F.when(length >= size, F.sequence(F.lit(1), length - size + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda at: F.struct(at.alias("at"), F.substr("text", at, F.lit(size)).alias("head")))

    every = F.flatten(F.array(*[begins(size) for size in range(1, HEAD + 1)]))
    places = texts.where(F.col("text").isNotNull()).select(*kept, "text", F.explode(every).alias("p")).select(*kept, "text", "p.at", "p.head")
    cut = places.join(heads, "head").select(*kept, "text", "at", F.explode("sizes").alias("size")).where(F.col("at") + F.col("size") - 1 <= length)
    return cut.select(*kept, F.substr("text", F.col("at"), F.col("size")).alias("term"))


def matches(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """query_id and the columns of ``texts(id, text, …)`` but the text, once for each place of a term: no shuffle by the pair."""
    asked = cut_lineage(terms.select("query_id", "term").where(F.char_length("term") > 0).distinct())
    return pieces(texts, asked).join(asked, "term").drop("term")


def containing(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """``texts(id, text)`` and ``terms(query_id, term)`` → distinct (query_id, id) where the text contains the term.

    A null or empty term and a null text match nothing; the comparison is
    exact, so callers fold the case of both sides.
    """
    return matches(texts.select("id", "text"), terms).select("query_id", "id").distinct()
