"""Operator of problem 5: one consistent form, by classes of look-alike text.

Look-alike-mapped values are grouped in SQL under the accent- and
case-sensitive Unicode collation, a canonical member is chosen for each class,
and the choice is joined back to the rows.  Collated texts can only be sorted,
so the grouping is left to those that may have a partner at all: texts that are
equal under the collation have the same letters and digits in the same order,
and a mapped text that shares these with no other one is its own class.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.lookalike import skeleton
from folioscan.operators.arrow import flat_map
from folioscan.operators.checkpoints import ensure_checkpoint_dir
from folioscan.operators.skew import spread_join


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _mapped(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text_hash, mapped_hash, letters_hash, mapped) of the rows with a text."""
    kind = df.schema[key].dataType.simpleString()
    slim = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).where("text is not null")

    def kernel(k, h, t):
        m = skeleton(t)
        yield k, h, h if m == t else _digest(m), _digest("".join(filter(str.isalnum, m)))[:32], m

    return flat_map(slim.select("key", F.sha2("text", 256), "text"), kernel, f"key {kind}, text_hash string, mapped_hash string, letters_hash string, mapped string")


def _merged(short: DataFrame, mapped: DataFrame) -> DataFrame:
    """(mapped_hash, class_hash, form) of the mapped texts that share their letters with another one."""
    spark = short.sparkSession
    pairs = short.select("mapped_hash", "letters_hash").distinct()
    shared = pairs.groupBy("letters_hash").agg(F.min("mapped_hash").alias("lo"), F.max("mapped_hash").alias("hi")).where("lo <> hi").select("letters_hash")
    some = mapped.join(shared, "letters_hash", "left_semi").groupBy("mapped_hash").agg(F.first("mapped").alias("mapped"))
    forms = some.select("mapped_hash", F.collate("mapped", "UNICODE").alias("alike"))
    classes = spark.sql(
        "SELECT alike, min(mapped_hash) AS class_hash, min(CAST(alike AS STRING COLLATE UTF8_BINARY)) AS form FROM {forms} GROUP BY alike", forms=forms
    )
    return spark.sql("SELECT f.mapped_hash, c.class_hash, c.form FROM {forms} f JOIN {classes} c ON f.alike = c.alike", forms=forms, classes=classes)


def members(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text_hash, class_hash, form): each row with its class and the class's one form.

    The canonical member is the smallest mapped text of the class.  Null texts
    have no class and drop out; empty texts form a class of their own; repeated
    rows come out once.
    """
    mapped = _mapped(df, key, text)
    found = mapped.select("key", "text_hash", "mapped_hash", "mapped").distinct().join(_merged(mapped, mapped), "mapped_hash", "left")
    return found.select(F.col("key").alias(key), "text_hash", F.coalesce("class_hash", "mapped_hash").alias("class_hash"), F.coalesce("form", "mapped").alias("form"))


def classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text_hash, class_hash), as members() gives them; no text is moved but of those that share their letters."""
    ensure_checkpoint_dir(df.sparkSession)
    mapped = _mapped(df, key, text)
    short = mapped.select("key", "text_hash", "mapped_hash", "letters_hash").distinct().checkpoint()  # read three times below
    merged = _merged(short, mapped).select("mapped_hash", "class_hash")
    found = short.join(merged, "mapped_hash", "left")
    return found.select(F.col("key").alias(key), "text_hash", F.coalesce("class_hash", "mapped_hash").alias("class_hash"))


def look_alikes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key_a, key_b), key_a < key_b: rows of one class whose text differs."""
    ensure_checkpoint_dir(df.sparkSession)
    # read three times below: three short columns are kept, so that texts are compared once
    found = classes(df, key, text).select(F.col(key).alias("k"), "text_hash", "class_hash").checkpoint()
    mixed = found.groupBy("class_hash").agg(F.min("text_hash").alias("lo"), F.max("text_hash").alias("hi")).where("lo <> hi").select("class_hash")
    hot = found.join(mixed, "class_hash", "left_semi")
    # first the pairs of different texts, then their rows: copies of one text are never compared with each other
    texts = hot.select("class_hash", "text_hash").distinct()
    a = texts.select(F.col("class_hash").alias("ca"), F.col("text_hash").alias("ha"))
    b = texts.select(F.col("class_hash").alias("cb"), F.col("text_hash").alias("hb"))
    different = spread_join(a, b, "ca", "cb", "ha").where("ha <> hb").select("ha", F.col("hb").alias("other"))
    ends = hot.select(F.col("k").alias("ka"), F.col("text_hash").alias("ha")).join(different, "ha").select("ka", "other")
    pairs = spread_join(ends, hot.select(F.col("k").alias("kb"), F.col("text_hash").alias("hb")), "other", "hb", "ka").where("ka < kb")
    return pairs.select(F.col("ka").alias(f"{key}_a"), F.col("kb").alias(f"{key}_b")).distinct()
