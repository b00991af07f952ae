"""Rows of vectors as audio: sixteen vectors of 64 numbers are a hop of 1024 samples, sixteen hops a track."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VECTORS, HOPS, RATE = 16, 16, 48_000.0


def hops(vectors: DataFrame) -> DataFrame:
    """(runtime_id, hop_index, sample_rate, left, right) of a table (vec_id, embedding); the right side plays each vector backwards.

    Hops that lack a vector, or have one of another length, are left out; of vectors with one id the greatest counts.
    """
    ok = vectors.where("vec_id is not null and size(embedding) = 64 and not exists(embedding, x -> x is null)").groupBy("vec_id").agg(F.max("embedding").alias("e"))
    parts = ok.select(F.floor(F.col("vec_id") / VECTORS).alias("hop"), "vec_id", F.transform("e", lambda x: x.cast("double")).alias("e"))
    whole = parts.groupBy("hop").agg(F.array_sort(F.collect_list(F.struct("vec_id", "e"))).alias("p")).where(F.size("p") == VECTORS)  # sixteen at most
    left = F.flatten(F.transform("p", lambda x: x["e"]))
    right = F.flatten(F.transform("p", lambda x: F.reverse(x["e"])))
    name = F.concat(F.lit("au-"), F.floor(F.col("hop") / HOPS).cast("string"))
    return whole.select(name.alias("runtime_id"), F.col("hop").cast("long").alias("hop_index"), F.lit(RATE).alias("sample_rate"), left.alias("left"), right.alias("right"))
