"""Secrets inside nested JSON: one row per leaf, rules on columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.functions.scalars import is_sensitive_key, secret_family
from evigraph.session import cut_lineage
from evigraph.sources.corpus import json_valid


def json_leaves(documents: DataFrame, doc_id: str = "document_id", text: str = "text") -> DataFrame:
    """(doc_id, path, key, type, value, sensitive) of every leaf, at any depth.

    One round opens one level of all documents. A value under a sensitive key is
    a leaf as a whole; items of a list have the key of the list. Text that is
    not JSON is one leaf of type ``text``; null has none.
    """
    value = F.when(json_valid(F.col(text)), F.try_parse_json(text))
    whole = documents.where(F.col(text).isNotNull()).select(doc_id, F.lit("$").alias("path"), F.lit("").alias("key"), value.alias("v"), F.col(text).alias("raw"))
    level = cut_lineage(whole)
    found = [level.where("v IS NULL").select(doc_id, "path", "key", F.lit("text").alias("type"), F.col("raw").alias("value"), F.lit(False).alias("sensitive"))]
    level = level.where("v IS NOT NULL").drop("raw")
    while True:
        kind = F.schema_of_variant("v")
        marked = level.select("*", is_sensitive_key(F.col("key")).alias("sensitive"), F.when(kind.startswith("OBJECT"), "object").when(
            kind.startswith("ARRAY"), "array").when(kind == "VOID", "null").otherwise(F.lower(kind)).alias("type"))
        inner = F.col("type").isin("object", "array") & ~F.col("sensitive")
        text_value = F.when(F.col("type") == "string", F.try_variant_get("v", "$", "string")).otherwise(F.to_json("v"))
        found.append(marked.where(~inner).select(doc_id, "path", "key", "type", text_value.alias("value"), "sensitive"))
        if not marked.where(inner).take(1):
            return reduce(DataFrame.unionByName, found)
        fields = marked.where(inner & (F.col("type") == "object")).select(
            doc_id, "path", F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("name", "v"))
        items = marked.where(inner & (F.col("type") == "array")).select(
            doc_id, "path", "key", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("at", "v"))
        level = cut_lineage(fields.select(doc_id, F.concat("path", F.lit("."), "name").alias("path"), F.col("name").alias("key"), "v").unionByName(
            items.select(doc_id, F.concat("path", F.lit("["), F.col("at").cast("string"), F.lit("]")).alias("path"), "key", "v")))


def secrets_in(documents: DataFrame, doc_id: str = "document_id", text: str = "text") -> DataFrame:
    """(doc_id, path, family): every place that holds a secret; a sensitive key is family ``key``, the key ``pattern`` is exempt."""
    family = F.when(F.col("sensitive"), "key").when(F.col("type").isin("string", "text") & (F.col("key") != "pattern"), secret_family(F.col("value")))
    return json_leaves(documents, doc_id, text).select(doc_id, "path", family.alias("family")).where("family IS NOT NULL")
