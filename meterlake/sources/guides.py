"""Guide texts by name."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def guides(spark: SparkSession, folder: str) -> DataFrame:
    """(uri, text) of every Markdown file under a folder."""
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True)
    return rows.select(F.concat(F.lit("guide://"), F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.md$", 1)).alias("uri"), F.col("value").alias("text"))


def guide_path(folder: str, name: str) -> str:
    """The path of one guide; ValueError if the name leaves the folder."""
    path = posixpath.normpath(posixpath.join(folder, name))
    if not path.startswith(folder.rstrip("/") + "/"):
        raise ValueError(f"{name} is outside the guides")
    return path
