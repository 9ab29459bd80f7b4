"""Queries of the training-data problems, pN_ for problem N, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm import abuse, cohesion, leakage, lookalike_op, mojibake_op, nearcopies, packing, scans
from folioscan.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return nearcopies.near_pairs(table(spark, d, "memory_pages"), "page_id", "path", "norm_all")


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return nearcopies.groups(table(spark, d, "memory_pages"), "page_id", "path", "norm_all")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired(table(spark, d, "memory_pages")).select("page_id", F.explode("noise").alias("noise")).distinct()


def p2_text(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired(table(spark, d, "memory_pages")).select("page_id", F.array_join("noise", ",").alias("noise"), "text")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return cohesion.pieces(table(spark, d, "memory_pages"), "page_id", "page", "raw").where("n_pieces > 1").select("page_id").distinct()


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return cohesion.pieces(table(spark, d, "memory_pages"), "page_id", "page", "raw")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake_op.garbled(table(spark, d, "memory_pages"), "page_id", "raw").select("page_id").distinct()


def p4_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake_op.garbled(table(spark, d, "memory_pages"), "page_id", "raw")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike_op.look_alikes(table(spark, d, "memory_pages"), "page_id", "raw")


def p5_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalike_op.members(table(spark, d, "memory_pages"), "page_id", "raw")


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(table(spark, d, "documents"), "doc_id", "text")


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p6_containers(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_passages(spark, d).select("doc_id", "item_id").distinct()


def p7_passages(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.scores(table(spark, d, "documents"), table(spark, d, "review_labels"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_scores(spark, d).where(F.col("score") >= abuse.THRESHOLD).select("doc_id").distinct()


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    bad = F.col("score") >= abuse.THRESHOLD
    return p8_scores(spark, d).groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if(bad).alias("n_abusive"), F.round(F.avg(bad.cast("int")), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score"))


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in (p1_found, p1_groups, p2_found, p2_text, p3_found, p3_pieces, p4_found, p4_restored, p5_found, p5_canonical, p6_containers, p6_fill, p7_found, p7_passages, p8_found, p8_scores, p8_rates)}


# All pairs of different texts by the pieces they share, and what follows from them.
_LINKS = (
    "p AS (SELECT DISTINCT page_id, path, norm_all AS t FROM memory_pages WHERE length(norm_all) >= 200), n AS (SELECT row_number() OVER () AS i, t, sha256(t) AS h FROM (SELECT DISTINCT t FROM p)), "
    "s AS (SELECT DISTINCT i, substr(t, g, 5) AS q FROM (SELECT i, t, unnest(range(1, length(t) - 3)) AS g FROM n)), z AS (SELECT i, count(*) AS c FROM s GROUP BY 1), "
    "b AS (SELECT x.i AS i, y.i AS j, count(*) AS n FROM s x JOIN s y ON x.q = y.q AND x.i < y.i GROUP BY 1, 2), "
    "l AS (SELECT b.i, b.j FROM b JOIN z u ON u.i = b.i JOIN z v ON v.i = b.j WHERE b.n / (u.c + v.c - b.n) >= 0.6), "
    "e AS (SELECT i, j FROM l UNION ALL SELECT j, i FROM l)"
)
_PAIRS = f"WITH {_LINKS}, m AS (SELECT page_id, path, i FROM p JOIN n USING (t)) SELECT DISTINCT a.page_id AS page_id_a, o.page_id AS page_id_b FROM m a JOIN (SELECT i, j FROM e UNION ALL SELECT i, i FROM n) k ON k.i = a.i JOIN m o ON o.i = k.j WHERE a.page_id < o.page_id AND a.path <> o.path"
_GROUPS = (
    f"WITH RECURSIVE {_LINKS}, r AS (SELECT i, i AS j FROM n UNION SELECT r.i, e.j FROM r JOIN e ON e.i = r.j), g AS (SELECT r.i, min(n.h) AS group_id FROM r JOIN n ON n.i = r.j GROUP BY 1), k AS (SELECT i, count(*) AS c FROM e GROUP BY 1), "
    "w AS (SELECT page_id, group_id, coalesce(c, 0) AS c FROM (SELECT page_id, i FROM p JOIN n USING (t)) JOIN g USING (i) LEFT JOIN k USING (i) UNION ALL SELECT page_id, sha256(norm_all), 0 FROM memory_pages WHERE norm_all IS NULL OR length(norm_all) < 200) "
    "SELECT page_id, min(group_id) AS group_id, max(c) AS n_links FROM w GROUP BY 1"
)

def oracle_sql() -> dict[str, str]:
    return {"p1_found": _PAIRS, "p1_groups": _GROUPS, "p3_found": "SELECT DISTINCT page_id FROM memory_pages WHERE length(replace(raw, chr(13) || chr(10), chr(10))) > 1800"}
