"""Queries on incremental maintenance and generations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.operators import generations as G
from folioscan.operators import incremental as I
from folioscan.sources.tables import table

NOW = 1764600000.0
LATE = "2025-11-01"
_STATE = ["path", "size", "mtime_ns", "inode", "file_id", "fast_fp", "full_hash", "last_indexed_at", "deletion_candidate_since"]


def _current(spark: SparkSession, d: str) -> DataFrame:
    return I.latest_state(table(spark, d, "file_state").select(*_STATE))


def _previous(spark: SparkSession, d: str) -> DataFrame:
    """The state as it was before: of each path the oldest row, of files indexed before the cut."""
    turned = table(spark, d, "file_state").select(*_STATE).withColumn("last_indexed_at", -F.col("last_indexed_at"))
    return I.latest_state(turned).withColumn("last_indexed_at", -F.col("last_indexed_at")).where(F.col("last_indexed_at") < 1761955200)


def latest_state(spark, d):
    return _current(spark, d).select("path", "size", "mtime_ns", "inode", F.round("last_indexed_at", 3).alias("last_indexed_at"))


def _classified(mode: str):
    return lambda spark, d: I.classify(_current(spark, d), _previous(spark, d), mode)


def delete_two_strike(spark, d):
    """Pages of folders that are ready are what a scan finds now."""
    ready = table(spark, d, "folders").where("ready").select("folder_id")
    here = table(spark, d, "memory_pages").join(ready, "folder_id", "left_semi").select("path")
    return I.two_strikes(_current(spark, d), here, NOW).select("path", "verdict", F.round("deletion_candidate_since", 3).alias("since"))


def _failures(spark: SparkSession, d: str) -> DataFrame:
    """Files whose digest could never be taken."""
    return table(spark, d, "file_state").where("fast_fp is null").select("path", F.lit("例外:OSError").alias("reason")).distinct()


def _indexed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "memory_pages").where(F.col("indexed_at") < F.lit(LATE).cast("timestamp_ntz")).select("path").distinct()


def retry_set(spark, d):
    return I.targets(_classified("fastfp")(spark, d), I.retry_targets(_failures(spark, d), _current(spark, d)))


def bootstrap_retry(spark, d):
    """As if the pages of all .pdf files had been lost together with the failures."""
    indexed = _indexed(spark, d).where(~F.lower("path").endswith(".pdf"))
    return I.bootstrap_targets(_current(spark, d), _previous(spark, d), indexed)


def kept_failures(spark, d):
    return I.kept_failures(_failures(spark, d), _indexed(spark, d))


def merged_failures(spark, d):
    recent = table(spark, d, "file_state").where("full_hash is null and inode is null").select("path", F.lit("テキストなし").alias("reason")).distinct()
    return I.merged_failures(_failures(spark, d), recent)


def upsert_cache(spark, d):
    pages = table(spark, d, "memory_pages").select("path", "page_key", "folder_id", "raw")
    fresh = table(spark, d, "memory_pages").where(F.col("indexed_at") >= F.lit(LATE).cast("timestamp_ntz")).select("path", "page_key", "folder_id", F.concat(F.col("raw"), F.lit("*")).alias("raw")).distinct()
    gone = _failures(spark, d)
    return I.upsert(pages, fresh, gone).select("path", "page_key", "folder_id", F.md5("raw").alias("h"))


def shrink_guard(spark, d):
    pages = table(spark, d, "memory_pages")
    cached = pages.groupBy("folder_id").agg(F.countDistinct("path").alias("n_cached"))
    scanned = pages.where(F.col("indexed_at") < F.lit(LATE).cast("timestamp_ntz")).groupBy("folder_id").agg(F.countDistinct("path").alias("n_scanned"))
    return I.shrink_guard(cached.join(scanned, "folder_id", "left").withColumn("n_scanned", F.coalesce("n_scanned", F.lit(0))))


def _files(scope: str):
    return lambda spark, d: I.files_view(table(spark, d, "file_state"), _indexed(spark, d), _failures(spark, d), scope)


def index_stats(spark, d):
    return I.index_stats(_classified("stat")(spark, d))


def list_generations(spark, d):
    return G.listed(table(spark, d, "generations")).select("gen_name", "created", "bytes")


def _retention(**limits):
    return lambda spark, d: G.retention(table(spark, d, "generations"), NOW, **limits)


def manifest_counts(spark, d):
    return G.manifest_counts(table(spark, d, "memory_pages"))


def manifest_hash(spark, d):
    return G.source_hash(table(spark, d, "folders"))


def folder_health(spark, d):
    f = table(spark, d, "folders")
    return f.agg((F.coalesce(F.bool_and("ready"), F.lit(False)) & (F.count("*") > 0)).alias("ready"), F.count("*").alias("n_folders"), F.count_if(~F.col("ready")).alias("n_waiting"))


QUERIES = {f.__name__: f for f in (latest_state, delete_two_strike, retry_set, bootstrap_retry, kept_failures, merged_failures, upsert_cache, shrink_guard, index_stats, list_generations, manifest_counts, manifest_hash, folder_health)} | {
    "diff_stat": _classified("stat"), "diff_fastfp": _classified("stat+fastfp"), "diff_fullhash": _classified("fullhash"), "files_all": _files("all"), "files_missing": _files("missing"), "files_indexed": _files("indexed"),
    "retention_count": _retention(), "retention_plan": _retention(keep=8, keep_days=14, max_bytes=3_500_000_000), "retention_bytes": _retention(keep=0, max_bytes=2_000_000_000),
}

_REST = "size DESC NULLS LAST, mtime_ns DESC NULLS LAST, inode DESC NULLS LAST, file_id DESC NULLS LAST, fast_fp DESC NULLS LAST, full_hash DESC NULLS LAST, deletion_candidate_since DESC NULLS LAST"
_CUR = f"cur AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY coalesce(last_indexed_at, -1e300) DESC, {_REST}) AS rn FROM file_state WHERE path IS NOT NULL) WHERE rn = 1)"
_PRE = f"pre AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY coalesce(-last_indexed_at, -1e300) DESC, {_REST}) AS rn FROM file_state WHERE path IS NOT NULL) WHERE rn = 1 AND last_indexed_at < 1761955200)"
_FAIL = "fail AS (SELECT DISTINCT path, '例外:OSError' AS reason FROM file_state WHERE fast_fp IS NULL)"
_IDX = f"idx AS (SELECT DISTINCT path FROM memory_pages WHERE indexed_at < TIMESTAMP '{LATE}')"
_CHANGED = (
    "(c.size IS DISTINCT FROM p.size OR c.mtime_ns IS DISTINCT FROM p.mtime_ns OR CASE WHEN c.inode IS NOT NULL AND p.inode IS NOT NULL THEN c.inode <> p.inode "
    "WHEN c.file_id IS NOT NULL AND p.file_id IS NOT NULL THEN c.file_id <> p.file_id ELSE false END)"
)


def _diff(*more: str) -> str:
    steps = " ".join(more)
    return (
        f"cls AS (SELECT coalesce(c.path, p.path) AS path, CASE WHEN c.path IS NULL THEN 'absent' WHEN p.path IS NULL THEN 'new' WHEN NOT {_CHANGED} THEN 'unchanged' {steps} ELSE 'changed' END AS status "
        "FROM cur c FULL OUTER JOIN pre p ON c.path = p.path)"
    )


_FP = "WHEN c.fast_fp = p.fast_fp THEN 'same_fingerprint'"
_FH = "WHEN (starts_with(c.path, '/mnt/') OR starts_with(c.path, '/net/') OR starts_with(c.path, '/Volumes/')) AND c.full_hash = p.full_hash THEN 'same_hash'"
_CLS = "SELECT path, status, status IN ('new', 'changed') AS reindex FROM cls"
_FILES = f"WITH {_FAIL}, {_IDX}, s AS (SELECT DISTINCT path FROM file_state) SELECT s.path, idx.path IS NOT NULL AS indexed, CASE WHEN idx.path IS NULL THEN coalesce(fail.reason, '理由不明') END AS reason FROM s LEFT JOIN idx ON s.path = idx.path LEFT JOIN fail ON s.path = fail.path"
_MADE = "coalesce(created_timestamp, try_cast(split_part(gen_name, '_', 1) AS BIGINT), 0)"


def _retained(keep: int = 3, keep_days: int = 0, max_bytes: int = 0, grace: int = 300) -> str:
    return (
        f"WITH g AS (SELECT *, {_MADE} AS created, NOT is_current AND (created_timestamp IS NULL OR {NOW} - created_timestamp >= {grace}) AS el FROM generations), "
        f"r AS (SELECT *, CASE WHEN el AND {keep} > 0 AND row_number() OVER (PARTITION BY el ORDER BY created DESC, gen_name) > {keep} THEN 'count' "
        f"WHEN el AND {keep_days} > 0 AND created_timestamp IS NOT NULL AND ({NOW} - created_timestamp) / 86400 > {keep_days} THEN 'age' END AS why FROM g), "
        "t AS (SELECT *, sum(CASE WHEN why IS NULL THEN bytes ELSE 0 END) OVER () AS total, why IS NULL AND el AS loose FROM r), "
        "b AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY loose ORDER BY created, gen_name DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM t) "
        f"SELECT gen_name, created, bytes, coalesce(why, CASE WHEN loose AND {max_bytes} > 0 AND total - freed > {max_bytes} THEN 'bytes' END) AS reason FROM b"
    )


SQL = {
    "latest_state": f"WITH {_CUR} SELECT path, size, mtime_ns, inode, round(last_indexed_at, 3) AS last_indexed_at FROM cur",
    "diff_stat": f"WITH {_CUR}, {_PRE}, {_diff()} {_CLS}",
    "diff_fastfp": f"WITH {_CUR}, {_PRE}, {_diff(_FP)} {_CLS}",
    "diff_fullhash": f"WITH {_CUR}, {_PRE}, {_diff(_FP, _FH)} {_CLS}",
    "delete_two_strike": f"WITH {_CUR}, here AS (SELECT DISTINCT path FROM memory_pages WHERE folder_id IN (SELECT folder_id FROM folders WHERE ready)) SELECT cur.path, CASE WHEN here.path IS NOT NULL THEN CASE WHEN deletion_candidate_since IS NOT NULL THEN 'cleared' ELSE 'kept' END WHEN deletion_candidate_since IS NULL THEN 'candidate' ELSE 'deleted' END AS verdict, CASE WHEN here.path IS NULL THEN round(coalesce(deletion_candidate_since, {NOW}), 3) END AS since FROM cur LEFT JOIN here ON cur.path = here.path",
    "retry_set": f"WITH {_CUR}, {_PRE}, {_diff(_FP)}, {_FAIL} SELECT path FROM cls WHERE status IN ('new', 'changed') UNION SELECT path FROM fail WHERE path IN (SELECT path FROM cur)",
    "bootstrap_retry": f"WITH {_CUR}, {_PRE}, {_IDX} SELECT DISTINCT path FROM cur WHERE path IN (SELECT path FROM pre) AND path NOT IN (SELECT path FROM idx WHERE lower(path) NOT LIKE '%.pdf')",
    "kept_failures": f"WITH {_FAIL}, {_IDX} SELECT * FROM fail WHERE path NOT IN (SELECT path FROM idx)",
    "merged_failures": f"WITH {_FAIL}, n AS (SELECT DISTINCT path, 'テキストなし' AS reason FROM file_state WHERE full_hash IS NULL AND inode IS NULL) SELECT coalesce(fail.path, n.path) AS path, coalesce(n.reason, fail.reason) AS reason FROM fail FULL OUTER JOIN n ON fail.path = n.path",
    "upsert_cache": f"WITH {_FAIL}, f AS (SELECT DISTINCT path, page_key, folder_id, raw || '*' AS raw FROM memory_pages WHERE indexed_at >= TIMESTAMP '{LATE}') SELECT path, page_key, folder_id, md5(raw) AS h FROM (SELECT path, page_key, folder_id, raw FROM memory_pages WHERE path NOT IN (SELECT path FROM f) AND path NOT IN (SELECT path FROM fail) UNION ALL SELECT * FROM f)",
    "shrink_guard": f"WITH c AS (SELECT folder_id, count(DISTINCT path) AS n_cached, count(DISTINCT path) FILTER (indexed_at < TIMESTAMP '{LATE}') AS n_scanned FROM memory_pages GROUP BY 1) SELECT folder_id, n_cached, n_scanned, CASE WHEN n_scanned = 0 AND n_cached > 0 THEN 'keep_empty' WHEN n_cached > 0 AND n_scanned < greatest(10, floor(n_cached * 0.8)) THEN 'keep_shrunk' ELSE 'build' END AS verdict FROM c",
    "files_all": _FILES,
    "files_missing": _FILES + " WHERE idx.path IS NULL",
    "files_indexed": f"WITH {_IDX} SELECT path, true AS indexed, CAST(NULL AS VARCHAR) AS reason FROM idx",
    "index_stats": f"WITH {_CUR}, {_PRE}, {_diff()} SELECT count(*) FILTER (status <> 'absent') AS total_files, count(*) FILTER (status IN ('new', 'changed')) AS updated_files, count(*) FILTER (status NOT IN ('absent', 'new', 'changed')) AS skipped_files FROM cls",
    "list_generations": f"SELECT gen_name, {_MADE} AS created, bytes FROM generations",
    "retention_count": _retained(),
    "retention_plan": _retained(8, 14, 3_500_000_000),
    "retention_bytes": _retained(0, 0, 2_000_000_000),
    "manifest_counts": "SELECT folder_id, count(DISTINCT path) AS file_count FROM memory_pages GROUP BY 1",
    "manifest_hash": "SELECT sha256(string_agg(path, '|' ORDER BY path)) AS source_folders_hash FROM folders",
    "folder_health": "SELECT coalesce(bool_and(ready), false) AND count(*) > 0 AS ready, count(*) AS n_folders, count(*) FILTER (NOT ready) AS n_waiting FROM folders",
}
