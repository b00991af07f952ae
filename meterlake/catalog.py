"""All registered queries of the telemetry engine and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import audio, registry, session, song, tools

#: These modules add their queries to those of tools.
PLANS = (tools, song, registry, session, audio)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.QUERIES["t31_song_timeline"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(tools.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(tools.ORACLE)
