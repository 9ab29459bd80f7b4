"""Queries on the workload and on presence, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions import timing
from folioscan.operators import results
from folioscan.operators import workload as K
from folioscan.sources.tables import table
from folioscan.streaming import batches

TTL = 900
NOW = 1764547200.0


def _stats(spark: SparkSession, d: str) -> DataFrame:
    return K.query_stats(table(spark, d, "query_log"))


def _shown(stats: DataFrame, *more: str) -> DataFrame:
    sums = [F.round(c, 3).alias(c) for c in ("total_time_ms", "total_payload_kb", "last_access")]
    return stats.select("query_key", "query_text", "search_mode", "count_total", "count_uncached", "total_hits", *sums, *more)


def query_stats(spark, d):
    return _shown(_stats(spark, d))


def query_averages(spark, d):
    return K.averages(_stats(spark, d)).select("query_key", *[F.round(c, 3).alias(c) for c in ("avg_time_ms", "avg_hits", "avg_payload_kb")])


def fixed_candidates(spark, d):
    return K.heavy(_stats(spark, d), F.lit(NOW), min_ms=60, min_hits=500, min_kb=100).select("query_key", "count_total")


def fixed_rank(spark, d):
    return K.ranked(K.heavy(_stats(spark, d), F.lit(NOW), ttl_days=30, min_count=5, min_ms=60, min_hits=500, min_kb=100)).select("query_key", F.round("score", 1).alias("score"))


def replay_top(spark, d):
    return K.most_asked(_stats(spark, d)).select("query_key", "count_total")


def stats_prune(spark, d):
    return K.pruned(_stats(spark, d), F.lit(NOW), 7).select("query_key")


def ready_targets(spark, d):
    log = table(spark, d, "query_log").select("query_key", "folders").distinct()
    return K.ready_folders(log, table(spark, d, "folders")).select("query_key", F.array_join("folders", ",").alias("folders")).distinct()


def same_folder_sets(spark, d):
    log = table(spark, d, "query_log").select("query_key", F.array_join(F.array_sort(F.array_distinct("folders")), ",").alias("folders")).distinct()
    return log.groupBy("query_key").agg(F.count("*").alias("n_sets"))


def cache_validate(spark, d):
    """Each stored result is taken to belong to the generation that was newest when it was last used."""
    gens = table(spark, d, "generations").select("gen_name", "is_current")
    current = gens.where("is_current").first().gen_name
    entries = gens.select(F.col("gen_name").alias("index_uuid"), F.lit("1").alias("schema_version"))
    return K.valid_entries(entries, current, "1")


def lru_evict(spark, d):
    entries = table(spark, d, "query_log").where("payload_kb is not null").groupBy(F.col("query_key").alias("key")).agg(F.max("ts").alias("last_use"), F.round(F.max("payload_kb") * 10).cast("bigint").alias("size"))
    return K.lru_kept(entries, 200, 100_000, 20_000).select("key", "size")


def history_dedupe(spark, d):
    h = table(spark, d, "query_log").where("ts is not null").select(
        F.concat_ws("/", "query_key", F.col("received_at").cast("string")).alias("id"), F.col("query_text").alias("query"), "search_mode", "range_limit", "space_mode", "normalize_mode", "folders",
        F.floor(F.col("ts") * 1000).cast("bigint").alias("ts"), (F.col("hits") > 3000).alias("pinned"),
    ).distinct()
    return results.history_kept(h, 30).select("id", "ts", "pinned")


def presence_ttl(spark, d):
    return K.presence(table(spark, d, "heartbeats"), TTL)


def worker_budget(spark, d):
    return K.presence(table(spark, d, "heartbeats"), TTL).select("ts_ms", timing.workers(F.col("n_active"), 6, 6).alias("workers"))


def keep_warm_due(spark, d):
    """At each heartbeat: is a warm-up due, if the last one was at an even hour and a third of the beats see a search running?"""
    last = table(spark, d, "query_log").agg(F.max("ts").alias("last_search"))
    beats = table(spark, d, "heartbeats").where("ts is not null").select(F.floor(F.col("ts") * 1000).cast("bigint").alias("ts_ms")).distinct()
    warmed, running = F.floor(F.col("ts_ms") / 7_200_000) * 7200, F.pmod("ts_ms", F.lit(3)) - 1
    due = timing.keep_warm_due(F.col("last_search"), warmed, running, F.col("ts_ms") / 1000, 600, 3600)
    return beats.join(F.broadcast(last)).select("ts_ms", due.alias("due"))


def schedule_next(spark, d):
    t = F.floor("ts").cast("bigint")
    return table(spark, d, "query_log").where("ts is not null").select(t.alias("t"), timing.next_daily(t, 5, 30).cast("bigint").alias("next")).distinct()


def relative_time(spark, d):
    t = F.floor("ts").cast("bigint")
    return table(spark, d, "query_log").where("ts is not null").select(t.alias("t"), timing.age_label(t, F.lit(int(NOW))).alias("label")).distinct()


def stream_query_stats(spark, d):
    return _shown(batches.query_stats(spark, f"{d}/query_log.parquet"))


def stream_presence(spark, d):
    """Clients that a stream of heartbeats leaves present at the time of the last one."""
    return batches.last_seen(spark, f"{d}/heartbeats.parquet", TTL)


QUERIES = {
    f.__name__: f
    for f in (
        query_stats, query_averages, fixed_candidates, fixed_rank, replay_top, stats_prune, ready_targets, same_folder_sets, cache_validate, lru_evict, history_dedupe, presence_ttl, worker_budget, keep_warm_due, schedule_next, relative_time, stream_query_stats, stream_presence,
    )
}

_FRESH = "NOT coalesce(cached, false) AND elapsed_ms IS NOT NULL"
_ST = f"st AS (SELECT query_key, min(query_text) AS query_text, min(search_mode) AS search_mode, count(*) AS count_total, count(*) FILTER ({_FRESH}) AS count_uncached, coalesce(sum(elapsed_ms) FILTER ({_FRESH}), 0) AS total_time_ms, CAST(sum(coalesce(hits, 0)) AS BIGINT) AS total_hits, sum(coalesce(payload_kb, 0)) AS total_payload_kb, max(ts) AS last_access FROM query_log GROUP BY 1)"
_AV = "av AS (SELECT *, total_time_ms / greatest(count_uncached, 1) AS avg_time_ms, total_hits / greatest(count_total, 1) AS avg_hits, total_payload_kb / greatest(count_total, 1) AS avg_payload_kb FROM st)"
_STATS = f"WITH {_ST} SELECT query_key, query_text, search_mode, count_total, count_uncached, total_hits, round(total_time_ms, 3) AS total_time_ms, round(total_payload_kb, 3) AS total_payload_kb, round(last_access, 3) AS last_access FROM st"
_WORTH = "(avg_time_ms >= 60 OR avg_hits >= 500 OR avg_payload_kb >= 100)"
_BEATS = "b AS (SELECT client_id, CAST(floor(ts * 1000) AS BIGINT) AS t FROM heartbeats WHERE client_id IS NOT NULL AND ts IS NOT NULL)"
_PRES = f"WITH {_BEATS}, p AS (SELECT DISTINCT a.t AS ts_ms, (SELECT count(DISTINCT client_id) FROM b WHERE b.t BETWEEN a.t - {TTL * 1000} AND a.t) AS n_active FROM b a)"

SQL = {
    "query_stats": _STATS,
    "stream_query_stats": _STATS,
    "query_averages": f"WITH {_ST}, {_AV} SELECT query_key, round(avg_time_ms, 3) AS avg_time_ms, round(avg_hits, 3) AS avg_hits, round(avg_payload_kb, 3) AS avg_payload_kb FROM av",
    "fixed_candidates": f"WITH {_ST}, {_AV} SELECT query_key, count_total FROM av WHERE {NOW} - last_access <= 7 * 86400 AND count_total >= 10 AND {_WORTH}",
    "fixed_rank": f"WITH {_ST}, {_AV} SELECT query_key, round(avg_time_ms * greatest(1, avg_hits), 1) AS score FROM av WHERE {NOW} - last_access <= 30 * 86400 AND count_total >= 5 AND {_WORTH} ORDER BY avg_time_ms * greatest(1, avg_hits) DESC, query_key LIMIT 20",
    "replay_top": f"WITH {_ST} SELECT query_key, count_total FROM st ORDER BY count_total DESC, query_key LIMIT 10",
    "stats_prune": f"WITH {_ST} SELECT query_key FROM st WHERE {NOW} - coalesce(last_access, 0) <= 7 * 86400",
    "ready_targets": "SELECT DISTINCT query_key, array_to_string(list_sort(list_distinct(list_filter(folders, lambda x: x IN (SELECT folder_id FROM folders WHERE ready)))), ',') AS folders FROM query_log".replace("list_filter(folders, lambda x: x IN (SELECT folder_id FROM folders WHERE ready))", "list_intersect(folders, (SELECT list(folder_id) FROM folders WHERE ready))"),
    "same_folder_sets": "SELECT query_key, count(DISTINCT array_to_string(list_sort(list_distinct(folders)), ',')) AS n_sets FROM query_log GROUP BY 1",
    "cache_validate": "SELECT gen_name AS index_uuid, '1' AS schema_version FROM generations WHERE is_current",
    "lru_evict": "WITH e AS (SELECT query_key AS key, max(ts) AS u, CAST(round(max(payload_kb) * 10) AS BIGINT) AS size FROM query_log WHERE payload_kb IS NOT NULL GROUP BY 1), t AS (SELECT * FROM e WHERE size <= 20000 ORDER BY u DESC, key LIMIT 200) SELECT key, size FROM (SELECT *, sum(size) OVER (ORDER BY u DESC, key ROWS UNBOUNDED PRECEDING) AS r FROM t) WHERE r <= 100000",
    "history_dedupe": "WITH h AS (SELECT DISTINCT query_key || '/' || strftime(received_at, '%Y-%m-%d %H:%M:%S') AS id0, query_key, received_at, query_text, search_mode, range_limit, space_mode, normalize_mode, folders, CAST(floor(ts * 1000) AS BIGINT) AS ts, hits > 3000 AS pinned FROM query_log WHERE ts IS NOT NULL), "
    "i AS (SELECT *, query_key || '/' || rtrim(rtrim(strftime(received_at, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS id FROM h), "
    "l AS (SELECT *, row_number() OVER (PARTITION BY coalesce(normalize_mode, 'exact'), query_text, search_mode, range_limit, space_mode, list_sort(folders) ORDER BY ts DESC, id) AS n FROM i WHERE NOT coalesce(pinned, false)), "
    "k AS (SELECT id, ts, pinned FROM l WHERE n = 1 ORDER BY ts DESC, id LIMIT 30) SELECT id, ts, pinned FROM i WHERE pinned UNION ALL SELECT * FROM k",
    "presence_ttl": _PRES + " SELECT * FROM p",
    "worker_budget": _PRES + " SELECT ts_ms, CAST(greatest(1, least(6, floor(6 / greatest(n_active, 1)))) AS BIGINT) AS workers FROM p",
    "keep_warm_due": "SELECT DISTINCT CAST(floor(ts * 1000) AS BIGINT) AS ts_ms, floor(ts * 1000) / 1000 - (SELECT max(ts) FROM query_log) >= 600 AND CAST(floor(ts * 1000) AS BIGINT) % 7200000 >= 3600000 AND CAST(floor(ts * 1000) AS BIGINT) % 3 < 2 AS due FROM heartbeats WHERE ts IS NOT NULL",
    "schedule_next": "WITH q AS (SELECT DISTINCT CAST(floor(ts) AS BIGINT) AS t FROM query_log WHERE ts IS NOT NULL) SELECT t, t // 86400 * 86400 + 19800 + CASE WHEN t // 86400 * 86400 + 19800 <= t THEN 86400 ELSE 0 END AS next FROM q",
    "relative_time": f"WITH q AS (SELECT DISTINCT CAST(floor(ts) AS BIGINT) AS t FROM query_log WHERE ts IS NOT NULL) SELECT t, CASE WHEN {int(NOW)} - t < 60 THEN '今' WHEN {int(NOW)} - t < 3600 THEN (({int(NOW)} - t) // 60) || '分前' WHEN {int(NOW)} - t < 86400 THEN (({int(NOW)} - t) // 3600) || '時間前' WHEN {int(NOW)} - t < 7 * 86400 THEN (({int(NOW)} - t) // 86400) || '日前' ELSE strftime(make_timestamp(t * 1000000), '%Y-%m-%d') END AS label FROM q",
    "stream_presence": f"WITH {_BEATS}, m AS (SELECT client_id, max(t) AS last_ms FROM b GROUP BY 1) SELECT client_id, last_ms FROM m WHERE (SELECT max(t) FROM b) - last_ms <= {TTL * 1000}",
}
