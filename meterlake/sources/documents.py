"""Results as JSON documents, one row each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def documents(rows: DataFrame, by: list[str], order: str, name: str = "rows") -> DataFrame:
    """One document per key (R15): (by, document), its rows in an array by ``order``; null fields are left out.

    A document is one value, so ``rows`` must hold a bounded number per key, as the operators that name a limit return.
    """
    rest = [order, *[c for c in rows.columns if c not in by and c != order]]
    inner = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name))
    return inner.select(*by, F.to_json(F.struct(*by, name)).alias("document"))
