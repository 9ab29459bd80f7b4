"""Incremental maintenance: what changed since the last build, and the new state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions.text import relative_path
from folioscan.functions.timing import wants_full_hash

# The ways to compare, with the short names for them.
DIFF_MODES = {"stat": "stat", "fastfp": "stat+fastfp", "stat+fastfp": "stat+fastfp", "fullhash": "stat+fastfp+fullhash", "stat+fastfp+fullhash": "stat+fastfp+fullhash"}
DEFAULT_REASON = "理由不明"


def latest_state(state: DataFrame) -> DataFrame:
    """One row per path, the most recently indexed; rows without a path drop out.

    The most recent of each path is taken as one maximum, without a sort.
    """
    rest = [c for c in state.columns if c not in ("path", "last_indexed_at")]
    best = F.max(F.struct(F.coalesce("last_indexed_at", F.lit(float("-inf"))).alias("_o"), *(["last_indexed_at"] if "last_indexed_at" in state.columns else []), *rest)).alias("b")
    picked = state.where("path is not null").groupBy("path").agg(best)
    return picked.select(*[F.col("path") if c == "path" else F.col(f"b.{c}").alias(c) for c in state.columns])


def _differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def stat_changed(c: str = "c", p: str = "p") -> Column:
    """Size, then time, then inode; the file id only where an inode is missing on either side."""
    both = lambda n: F.col(f"{c}.{n}").isNotNull() & F.col(f"{p}.{n}").isNotNull()
    other = F.when(both("inode"), F.col(f"{c}.inode") != F.col(f"{p}.inode")).when(both("file_id"), F.col(f"{c}.file_id") != F.col(f"{p}.file_id")).otherwise(F.lit(False))
    return _differs(F.col(f"{c}.size"), F.col(f"{p}.size")) | _differs(F.col(f"{c}.mtime_ns"), F.col(f"{p}.mtime_ns")) | other


def classify(current: DataFrame, previous: DataFrame, diff_mode: str = "stat", hash_prefixes: tuple[str, ...] = (), hash_extensions: tuple[str, ...] = ()) -> DataFrame:
    """(path, status, reindex): each path of either side.

    Status: new, unchanged, same_fingerprint, same_hash, changed, or absent.
    Both sides have one row per path.  Digests are compared only where the
    metadata differ and both sides have one.
    """
    if diff_mode not in DIFF_MODES:
        raise ValueError(f"diff mode {diff_mode!r}")
    steps = DIFF_MODES[diff_mode]
    j = current.alias("c").join(previous.alias("p"), F.col("c.path") == F.col("p.path"), "full_outer")
    status = F.when(F.col("c.path").isNull(), "absent").when(F.col("p.path").isNull(), "new").when(~stat_changed(), "unchanged")
    if "fastfp" in steps:
        status = status.when(F.col("c.fast_fp") == F.col("p.fast_fp"), "same_fingerprint")
    if "fullhash" in steps:
        status = status.when(wants_full_hash(F.col("c.path"), hash_prefixes, hash_extensions) & (F.col("c.full_hash") == F.col("p.full_hash")), "same_hash")
    out = j.select(F.coalesce("c.path", "p.path").alias("path"), status.otherwise("changed").alias("status"))
    return out.withColumn("reindex", F.col("status").isin("new", "changed"))


def two_strikes(previous: DataFrame, current: DataFrame, now: float) -> DataFrame:
    """(path, verdict, deletion_candidate_since): absent once is a candidate, absent again is deleted, back again is cleared."""
    here = current.select("path").distinct().withColumn("_here", F.lit(True))
    j = previous.join(here, "path", "left")
    since = F.col("deletion_candidate_since")
    verdict = F.when(F.col("_here"), F.when(since.isNotNull(), "cleared").otherwise("kept")).when(since.isNull(), "candidate").otherwise("deleted")
    return j.select("path", verdict.alias("verdict"), F.when(F.col("_here"), F.lit(None)).otherwise(F.coalesce(since, F.lit(now))).cast("double").alias("deletion_candidate_since"))


def retry_targets(failures: DataFrame, current: DataFrame) -> DataFrame:
    """Failed files that are still there."""
    return failures.join(current.select("path").distinct(), "path", "left_semi").select("path").distinct()


def bootstrap_targets(current: DataFrame, previous: DataFrame, indexed: DataFrame) -> DataFrame:
    """Where the failures can't be read: known files without a page."""
    return current.select("path").distinct().join(previous, "path", "left_semi").join(indexed, "path", "left_anti")


def targets(classified: DataFrame, retries: DataFrame) -> DataFrame:
    """Files to extract: changed ones and those to try again, each once."""
    return classified.where("reindex").select("path").unionByName(retries.select("path")).distinct()


def kept_failures(failures: DataFrame, pages: DataFrame) -> DataFrame:
    """Failures of files that have no page at all."""
    return failures.join(pages.select("path").distinct(), "path", "left_anti")


def failure_sample(failures: DataFrame, most: int = 5) -> list[str]:
    """Lines for a log: the first failures by path, and how many more there are."""
    some = failures.orderBy("path").limit(most + 1).collect()
    lines = [f"[{i}] {r.path}: {r.reason}" for i, r in enumerate(some[:most], 1)]
    return lines + [f"... {failures.count() - most} more"] if len(some) > most else lines


def carried_state(current: DataFrame, previous: DataFrame, classified: DataFrame, now: float) -> DataFrame:
    """The state after a build, of the files that are there.

    An unchanged file keeps its row as it was; one whose digest shows the same
    content keeps its digests and the time it was indexed, under its new size,
    time and inode; a new or changed one is indexed now.  Nobody is a candidate
    for deletion any more.
    """
    kept = previous.select("path", *[F.col(c).alias(f"_{c}") for c in ("size", "mtime_ns", "inode", "file_id", "fast_fp", "full_hash", "last_indexed_at")])
    j = current.join(classified.select("path", "status"), "path").join(kept, "path", "left")
    same, alike = F.col("status") == "unchanged", F.col("status").isin("same_fingerprint", "same_hash")
    old = lambda c: F.when(same, F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    digest = lambda c: F.when(same, F.col(f"_{c}")).when(alike, F.coalesce(c, f"_{c}")).otherwise(F.col(c)).alias(c)
    return j.select(
        "path", *map(old, ("size", "mtime_ns", "inode", "file_id")), *map(digest, ("fast_fp", "full_hash")),
        F.when(same | alike, F.col("_last_indexed_at")).otherwise(F.lit(now)).alias("last_indexed_at"), F.lit(None).cast("double").alias("deletion_candidate_since"),
    )


def merged_failures(stored: DataFrame, recent: DataFrame) -> DataFrame:
    """Of both, the recent reason wins."""
    a, b = stored.select("path", F.col("reason").alias("old")), recent.select("path", F.col("reason").alias("new"))
    return a.join(b, "path", "full_outer").select("path", F.coalesce("new", "old").alias("reason"))


def upsert(pages: DataFrame, fresh: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """Pages of refreshed files replaced, of deleted files dropped, all others kept."""
    kept = pages.join(fresh.select("path").distinct(), "path", "left_anti")
    if deleted is not None:
        kept = kept.join(deleted.select("path").distinct(), "path", "left_anti")
    return kept.select(*fresh.columns).unionByName(fresh)


def shrink_guard(counts: DataFrame, allow_shrink: bool = False) -> DataFrame:
    """(folder_id, n_cached, n_scanned, verdict): empty or much smaller scans keep the old pages."""
    floor = F.greatest(F.lit(10), F.floor(F.col("n_cached") * 0.8))
    verdict = F.when((F.col("n_scanned") == 0) & (F.col("n_cached") > 0), "keep_empty")
    if not allow_shrink:
        verdict = verdict.when((F.col("n_cached") > 0) & (F.col("n_scanned") < floor), "keep_shrunk")
    return counts.select("folder_id", "n_cached", "n_scanned", verdict.otherwise("build").alias("verdict"))


def files_view(scanned: DataFrame, indexed: DataFrame, failures: DataFrame, scope: str = "all", base: str | None = None) -> DataFrame:
    """(path, indexed, reason): the files of a folder, all, indexed or missing ones, with why they are missing; paths below *base* if one is given."""
    if base is not None:
        below = relative_path(F.col("path"), F.lit(base.rstrip("/"))).alias("path")
        return files_view(scanned, indexed, failures, scope).select(below, "indexed", "reason")
    if scope == "indexed":
        return indexed.select("path").distinct().select("path", F.lit(True).alias("indexed"), F.lit(None).cast("string").alias("reason")).orderBy("path")
    if scope not in ("all", "missing"):
        raise ValueError(f"scope {scope!r}")
    why = failures.groupBy("path").agg(F.max("reason").alias("reason"))
    j = scanned.select("path").distinct().join(indexed.select("path").distinct().withColumn("_i", F.lit(True)), "path", "left").join(why, "path", "left")
    flag = F.coalesce("_i", F.lit(False))
    out = j.select("path", flag.alias("indexed"), F.when(~flag, F.coalesce("reason", F.lit(DEFAULT_REASON))).alias("reason"))
    return (out if scope == "all" else out.where("not indexed")).orderBy("path")


def index_stats(classified: DataFrame) -> DataFrame:
    present = F.col("status") != "absent"
    return classified.agg(F.count_if(present).alias("total_files"), F.count_if("reindex").alias("updated_files"), F.count_if(present & ~F.col("reindex")).alias("skipped_files"))
