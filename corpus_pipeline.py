"""The corpus pipeline: language, near copies, benchmark passages, secrets, packing. See graphloom/llm/queries.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import queries

STAGES = queries.STAGES
#: SQL cannot express the models and the automaton; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries.pipeline(spark, sf_dir)
