"""The query workload: statistics, what is worth keeping, who is there."""

from __future__ import annotations

import threading
import time
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscan.functions.timing import expired


def query_stats(log: DataFrame) -> DataFrame:
    """One row per query key: counts, sums and the last access.

    Time counts only for runs that were not answered from a cache and whose
    time is known.  Every row of the log is one access, repeated ones too.
    """
    fresh = ~F.coalesce("cached", F.lit(False)) & F.col("elapsed_ms").isNotNull()
    return log.groupBy("query_key").agg(
        F.min("query_text").alias("query_text"), F.min("search_mode").alias("search_mode"), F.count("*").alias("count_total"), F.count_if(fresh).alias("count_uncached"),
        F.sum(F.when(fresh, F.col("elapsed_ms")).otherwise(0.0)).alias("total_time_ms"), F.sum(F.coalesce("hits", F.lit(0))).alias("total_hits"),
        F.sum(F.coalesce("payload_kb", F.lit(0.0))).alias("total_payload_kb"), F.max("ts").alias("last_access"),
    )


def averages(stats: DataFrame) -> DataFrame:
    total, fresh = F.greatest("count_total", F.lit(1)), F.greatest("count_uncached", F.lit(1))
    return stats.withColumns({"avg_time_ms": F.col("total_time_ms") / fresh, "avg_hits": F.col("total_hits") / total, "avg_payload_kb": F.col("total_payload_kb") / total})


def heavy(stats: DataFrame, now: Column, ttl_days: float = 7, min_count: int = 10, min_ms: float = 500, min_hits: float = 5000, min_kb: float = 2000) -> DataFrame:
    """Queries worth a stored result: asked often and lately, and slow or large in any way."""
    worth = (F.col("avg_time_ms") >= min_ms) | (F.col("avg_hits") >= min_hits) | (F.col("avg_payload_kb") >= min_kb)
    return averages(stats).where(~expired(F.col("last_access"), now, ttl_days) & (F.col("count_total") >= min_count) & worth)


def ranked(candidates: DataFrame, k: int = 20) -> DataFrame:
    """The k with the highest time times hits; ties by key."""
    score = F.col("avg_time_ms") * F.greatest(F.lit(1.0), F.col("avg_hits"))
    return candidates.withColumn("score", score).orderBy(F.desc("score"), "query_key").limit(k)


def most_asked(stats: DataFrame, k: int = 10) -> DataFrame:
    return stats.orderBy(F.desc("count_total"), "query_key").limit(k)


def pruned(stats: DataFrame, now: Column, ttl_days: float = 30) -> DataFrame:
    return stats.where(~expired(F.col("last_access"), now, ttl_days))


def ready_folders(stats: DataFrame, folders: DataFrame, column: str = "folders") -> DataFrame:
    """The folder ids of each row that are ready; folders are a small configured table, here one row."""
    ready = folders.where("ready").agg(F.collect_set("folder_id").alias("_ready"))
    return stats.join(F.broadcast(ready)).withColumn(column, F.array_sort(F.array_intersect(column, "_ready"))).drop("_ready")


def same_folders(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def valid_entries(entries: DataFrame, index_uuid: str, schema_version: str) -> DataFrame:
    """Stored results that belong to the current generation; those without one are invalid."""
    return entries.where((F.col("index_uuid") == index_uuid) & (F.col("schema_version") == schema_version))


def lru_kept(entries: DataFrame, max_entries: int, max_bytes: float, max_item: float | None = None) -> DataFrame:
    """What a least-recently-used cache holds in the end: the newest entries within both limits.

    Only the newest *max_entries* can stay, so the running sum is over these.
    """
    if max_item is not None:
        entries = entries.where(F.col("size") <= max_item)
    newest = (F.desc("last_use"), F.col("key"))
    top = entries.orderBy(*newest).limit(max_entries)
    run = F.sum("size").over(W.orderBy(*newest).rowsBetween(W.unboundedPreceding, 0))
    return top.withColumn("_run", run).where(F.col("_run") <= max_bytes).drop("_run")


def presence(beats: DataFrame, ttl_sec: int, slice_sec: int = 3600) -> DataFrame:
    """(ts_ms, n_active): at each heartbeat, how many clients were heard of in the last *ttl_sec*, both ends included.

    Beats of a client within one slot of the time to live are one interval, so a
    hot client is reduced before the shuffle; intervals that touch are one
    visit.  Starts and ends are then added up by time slice, the slices' sums
    run on, and each slice is summed by itself: no task sees all of time.  Null
    clients and times don't count.
    """
    ttl, width = ttl_sec * 1000, slice_sec * 1000
    ms = beats.where("client_id is not null and ts is not null").select("client_id", F.floor(F.col("ts") * 1000).cast("bigint").alias("t"))
    slots = ms.groupBy("client_id", F.floor(F.col("t") / ttl).alias("slot")).agg(F.min("t").alias("a"), F.max("t").alias("b"))
    per = W.partitionBy("client_id").orderBy("slot")
    fresh = F.when(F.col("a") > F.lag("b").over(per) + ttl, 1).when(F.lag("b").over(per).isNull(), 1).otherwise(0)
    visits = slots.withColumn("f", fresh).withColumn("v", F.sum("f").over(per))
    visits = visits.groupBy("client_id", "v").agg(F.min("a").alias("a"), (F.max("b") + ttl + 1).alias("e"))
    steps = visits.select(F.col("a").alias("t"), F.lit(1).alias("d")).unionAll(visits.select(F.col("e").alias("t"), F.lit(-1).alias("d"))).groupBy("t").agg(F.sum("d").alias("d"))
    asked = ms.select("t").distinct().select("t", F.lit(0).cast("bigint").alias("d"), F.lit(True).alias("q"))
    rows = steps.select("t", "d", F.lit(False).alias("q")).unionAll(asked).withColumn("s", F.floor(F.col("t") / width))
    sums = rows.groupBy("s").agg(F.sum("d").alias("d"))
    before = sums.select("s", (F.sum("d").over(W.orderBy("s")) - F.col("d")).alias("base"))  # one row per slice of time
    inside = F.sum("d").over(W.partitionBy("s").orderBy("t"))
    return rows.join(before, "s").withColumn("n", F.col("base") + inside).where("q").select(F.col("t").alias("ts_ms"), F.col("n").alias("n_active"))


class ResultCache:
    """Least-recently-used results on the driver, bounded in entries, bytes and item size."""

    def __init__(self, max_bytes: int = 200 << 20, max_entries: int = 200, max_item: int = 2000 << 10, on_drop: Callable[[object], None] = lambda value: None):
        self.max_bytes, self.max_entries, self.max_item, self.on_drop = max_bytes, max_entries, max_item, on_drop
        self._items: OrderedDict[str, tuple[object, int]] = OrderedDict()
        self._bytes = 0
        self._lock = threading.Lock()

    def get(self, key: str):
        with self._lock:
            if key not in self._items:
                return None
            self._items.move_to_end(key)
            return self._items[key][0]

    def set(self, key: str, value, size: int) -> bool:
        if size > self.max_item:
            return False
        with self._lock:
            self._drop(key)
            self._items[key] = (value, size)
            self._bytes += size
            while self._items and (len(self._items) > self.max_entries or self._bytes > self.max_bytes):
                self._drop(next(iter(self._items)))
            return key in self._items

    def _drop(self, key: str):
        value, size = self._items.pop(key, (None, 0))
        self._bytes -= size
        if value is not None:
            self.on_drop(value)
        return value

    def pop(self, key: str):
        with self._lock:
            return self._drop(key)

    def clear(self) -> None:
        with self._lock:
            for key in list(self._items):
                self._drop(key)

    def __len__(self) -> int:
        return len(self._items)

    @property
    def bytes(self) -> int:
        return self._bytes


class Presence:
    """Who is there: a bounded table of clients with a time to live, both ends included."""

    def __init__(self, ttl_sec: float = 90, max_clients: int = 1000):
        self.ttl, self.most = ttl_sec, max_clients
        self.seen: dict[str, float] = {}

    def prune(self, now: float) -> None:
        self.seen = {c: t for c, t in self.seen.items() if now - t <= self.ttl}

    def beat(self, client: str | None, now: float) -> int:
        """A known client is always refreshed; a new one is passed over when the table is full."""
        self.prune(now)
        if client and (client in self.seen or len(self.seen) < self.most):
            self.seen[client] = max(now, self.seen.get(client, now))
        return len(self.seen)

    def count(self, now: float) -> int:
        self.prune(now)
        return len(self.seen)


class Cooldown:
    """One run at a time, and none too soon after the last."""

    def __init__(self, wait_sec: float, clock=time.monotonic):
        self.wait, self.clock = wait_sec, clock
        self._last: float | None = None
        self._lock = threading.Lock()

    def run(self, job) -> bool:
        if not self._lock.acquire(blocking=False):
            return False
        try:
            now = self.clock()
            if self._last is not None and now - self._last < self.wait:
                return False
            self._last = now
            job()
            return True
        finally:
            self._lock.release()


def stale_ids(history_folders: Column, known: list[str]) -> Column:
    return F.array_intersect(history_folders, F.array(*map(F.lit, known)) if known else F.array().cast("array<string>"))

