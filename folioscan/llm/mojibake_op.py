"""Operator of problem 4: pages read with the wrong character encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm import mojibake
from folioscan.operators.arrow import flat_map


TASKS_PER_CORE = 4


def _spread(df: DataFrame) -> DataFrame:
    """Rows over tasks by hash: pages that were written together are often long together."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(TASKS_PER_CORE * cores, df.rdd.getNumPartitions()), F.xxhash64("key", F.length("text")))


def _kernel(key, text):
    fixed, garbled, lost, how = mojibake.traced(text)
    if garbled:
        yield key, fixed, lost, how


def garbled(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, restored STRING, lost BOOLEAN, how STRING) of the rows whose text holds a garbled span.

    Null and empty texts are never garbled; a repeated row comes out once; texts
    of any length are searched line by line; other columns are not looked at.
    """
    kind = df.schema[key].dataType.simpleString()
    slim = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).where("text is not null")
    return flat_map(_spread(slim), _kernel, f"`{key}` {kind}, restored string, lost boolean, how string").distinct()


def restored(df: DataFrame, key: str, text: str) -> DataFrame:
    """Every row's key and text with garbled spans put right: (key, text, garbled, lost, how)."""
    kind = df.schema[key].dataType.simpleString()

    def kernel(k, t):
        fixed, bad, lost, how = mojibake.traced(t)
        yield k, fixed, bad, lost, how

    slim = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return flat_map(_spread(slim), kernel, f"`{key}` {kind}, `{text}` string, garbled boolean, lost boolean, how string")
