"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evigraph.plans import analytics, build, code, corpus, extra, graph, memory, streams, walks  # noqa: F401
from evigraph.plans.registry import ORACLES, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["q7_graph_summary"](spark, sf_dir)


__all__ = ["ORACLES", "QUERIES", "flagship"]
