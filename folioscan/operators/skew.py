"""Joins whose hot keys are spread over several tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PER_TASK = 2000  # rows of one key on the right that a row on the left meets in one task


def spread_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_id: str, per_task: int = PER_TASK, one_in: int = 1, right_id: str | None = None) -> DataFrame:
    """Inner join of left_key = right_key, every pair once.

    A key with more than *per_task* rows on either side is split: left rows by
    their id, right rows are repeated for each part.  Adaptive execution splits
    by bytes and misses keys whose rows are short but whose pairs are many.
    Keys that are not hot pay one lookup in the small table of those that are.
    With *one_in* n and *right_id* the sizes of keys are estimated from every
    n-th id, which decides only how the work is spread, never what comes out.
    """
    part = lambda df, i: df.where(F.pmod(F.xxhash64(i), F.lit(one_in)) == 0) if one_in > 1 else df
    sizes = part(left, left_id).groupBy(F.col(left_key).alias("_k")).count().unionByName(part(right, right_id).groupBy(F.col(right_key).alias("_k")).count())
    hot = sizes.groupBy("_k").agg((F.max("count") * one_in).alias("n")).where(F.col("n") > per_task).select("_k", F.ceil(F.col("n") / per_task).cast("int").alias("_parts"))
    a = left.join(hot, F.col(left_key) == F.col("_k"), "left").withColumn("_part", F.pmod(F.xxhash64(left_id), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_k", "_parts")
    b = right.join(hot, F.col(right_key) == F.col("_k"), "left").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_k", "_parts")
    return a.join(b, (F.col(left_key) == F.col(right_key)) & (F.col("_part") == F.col("_copy"))).drop("_part", "_copy")
