"""The engine's front door: build, search, look closer, export, and watch the workload."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions import ids
from folioscan.operators import generations, results, search, workload
from folioscan.operators import incremental as inc
from folioscan.operators.search import Request
from folioscan.sources import files


MAX_FOLDERS = 10_000  # configured folders, which are joined as a small table
MAX_LOG = 100_000  # searches that the engine remembers; a longer log belongs in a table
STATE = "path string, size bigint, mtime_ns bigint, inode bigint, file_id bigint, fast_fp string, full_hash string, last_indexed_at double, deletion_candidate_since double"


@dataclass
class Result:
    """Hits in order, with what the search was."""

    hits: DataFrame
    words: tuple[str, ...]
    folder_ids: tuple[str, ...]
    normalize_mode: str
    index_uuid: str | None
    key: str
    request: Request | None = None
    _count: int | None = field(default=None, repr=False)

    def count(self) -> int:
        if self._count is None:
            self._count = self.hits.count()
        return self._count

    def page(self, number: int = 0, size: int = results.BATCH) -> DataFrame:
        return results.batch(self.hits, number, size)

    def facets(self) -> tuple[DataFrame, DataFrame]:
        return results.folder_facet(self.hits), results.extension_facet(self.hits)

    def by_file(self) -> DataFrame:
        return results.by_file(self.hits)


class Engine:
    """Searches one store of page generations; a generation that is being read stays as it is while the next is built."""

    def __init__(self, spark: SparkSession, root: str, folders: DataFrame, cache: workload.ResultCache | None = None, clock: Callable[[], float] = time.time, rebuild_wait: float = 0):
        if folders.limit(MAX_FOLDERS + 1).count() > MAX_FOLDERS:
            raise ValueError(f"more than {MAX_FOLDERS} folders: they are joined as a small table")
        self.spark, self.store, self.clock = spark, generations.Store(spark, root), clock
        self.folders_table = folders
        self.cache = cache or workload.ResultCache()
        self.cache.on_drop = lambda result: result.hits.unpersist()  # what leaves the cache leaves the executors
        self.fixed = None  # stored results of heavy queries, see serving.FixedCache
        self._warm: tuple[str, DataFrame, int] | None = None
        self.presence = workload.Presence()
        self.log: deque[tuple] = deque(maxlen=MAX_LOG)
        self.rebuilds = workload.Cooldown(rebuild_wait, clock)

    # build

    def build(self, source: str, diff_mode: str = "stat", allow_shrink: bool = False) -> str:
        """List, compare with the last generation, read what changed, and publish the next generation.

        No file is opened for the listing.  Digests are taken of files whose
        metadata differ, pages of files that are new, changed or failed before;
        both are written once and read from there.
        """
        now = self.clock()
        name = ids.generation_name(now)
        stage = lambda table, df: self.store.stage(name, table, df)
        try:
            listing = stage("listing", files.scan(self.spark, source).withColumn("file_id", F.lit(None).cast("bigint")))
            old_pages, old_state, old_failures = (self.store.read(t) for t in ("pages", "file_state", "failures"))
            known = old_state if old_state is not None else self.spark.createDataFrame([], STATE)
            steps = inc.DIFF_MODES[diff_mode]
            bare = listing.withColumns({"fast_fp": F.lit(None).cast("string"), "full_hash": F.lit(None).cast("string")})
            current, differing = bare, inc.classify(bare, known, "stat").where("reindex").select("path")
            if steps != "stat":
                current = listing.join(stage("digests", files.digests(differing, full="fullhash" in steps)), "path", "left")
            classified = inc.classify(current, known, diff_mode)
            stored = old_failures.select("path", "reason") if old_failures is not None else self.spark.createDataFrame([], "path string, reason string")
            retries = inc.retry_targets(stored, current)
            if old_failures is None and old_state is not None and old_pages is not None:
                retries = retries.unionByName(inc.bootstrap_targets(current, known, old_pages.select("path").distinct()))
            todo = inc.targets(classified.where("status <> 'absent'"), retries)
            fresh = stage("fresh", files.extract_paths(todo))
            made = files.pages(fresh, self.folders_table)
            state = inc.carried_state(current, known, classified, now)
            if old_pages is None or old_state is None:
                return self._publish(name, {"pages": made, "file_state": state, "failures": inc.kept_failures(self._failures(fresh), made)}, now)
            held = self._guard(old_pages, current, allow_shrink).where("verdict <> 'build'").select("folder_id")
            refreshed = made.join(held, "folder_id", "left_anti")
            strikes = inc.two_strikes(known, current, now)
            kept = self._paths_of(held, old_pages, current.select("path").unionByName(known.select("path")))
            pages = inc.upsert(old_pages, refreshed, strikes.where("verdict = 'deleted'").join(kept, "path", "left_anti"))
            missing = strikes.where("verdict = 'candidate'").select("path", F.col("deletion_candidate_since").alias("_since"))
            state = state.unionByName(known.join(missing, "path").drop("deletion_candidate_since").withColumnRenamed("_since", "deletion_candidate_since").select(*state.columns))
            # a held folder's state stays as it was, so that the next build sees again what changed meanwhile
            state = state.join(kept, "path", "left_anti").select(*state.columns).unionByName(known.join(kept, "path", "left_semi").select(*state.columns))
            failed = inc.merged_failures(stored.join(current.select("path"), "path", "left_semi"), self._failures(fresh).join(kept, "path", "left_anti"))
            return self._publish(name, {"pages": pages, "file_state": state, "failures": inc.kept_failures(failed, pages)}, now)
        finally:
            self.store.unstage(name)

    def rebuild(self, source: str, **how) -> bool:
        """A build, unless one runs or the last was too short a time ago."""
        return self.rebuilds.run(lambda: self.build(source, **how))

    def failure_sample(self, most: int = 5) -> list[str]:
        failures = self.store.read("failures")
        return [] if failures is None else inc.failure_sample(failures, most)

    def _failures(self, extracted: DataFrame) -> DataFrame:
        return extracted.where("reason is not null").select("path", "reason").distinct()

    def _paths_of(self, held: DataFrame, pages: DataFrame, paths: DataFrame) -> DataFrame:
        """(path) of the *held* folders: by the deepest configured folder above it, or by its page."""
        f = F.broadcast(self.folders_table.select("folder_id", F.col("path").alias("_base")))
        j = paths.distinct().join(f, F.startswith(F.col("path"), F.concat(F.regexp_replace("_base", "/+$", ""), F.lit("/"))))
        owned = j.groupBy("path").agg(F.max_by("folder_id", F.struct(F.length("_base"), F.col("folder_id"))).alias("folder_id"))
        return owned.select("path", "folder_id").unionByName(pages.select("path", "folder_id")).join(held, "folder_id", "left_semi").select("path").distinct()

    def _guard(self, pages: DataFrame, current: DataFrame, allow_shrink: bool) -> DataFrame:
        f = F.broadcast(self.folders_table.select("folder_id", F.col("path").alias("_base")))
        scanned = current.join(f, F.startswith(F.col("path"), F.concat("_base", F.lit("/")))).groupBy("folder_id").agg(F.countDistinct("path").alias("n_scanned"))
        cached = pages.groupBy("folder_id").agg(F.countDistinct("path").alias("n_cached"))
        counts = cached.join(scanned, "folder_id", "left").withColumn("n_scanned", F.coalesce("n_scanned", F.lit(0)))
        return inc.shrink_guard(counts, allow_shrink)

    def _publish(self, name: str, frames: dict[str, DataFrame], now: float) -> str:
        self.store.commit(name, frames, self.folders_table, now)
        self.cache.clear()
        return name

    def clean(self, **limits) -> list[str]:
        return self.store.clean(self.clock(), **limits)

    # search

    def search(self, query: str, folders: list[str], mode: str = "AND", range_limit: int = 0, space_mode: str = "jp", normalize_mode: str | None = None, detail: bool = False) -> Result:
        ready = {r.folder_id for r in self.folders_table.where("ready").select("folder_id").collect()}
        chosen = tuple(f for f in folders if f in ready)
        if folders and not chosen:
            raise ValueError("none of the folders is ready")
        request = Request(query, chosen, mode, range_limit, space_mode, normalize_mode)
        name = self.store.current()
        pages = self.store.read("pages", name)
        if pages is None:
            raise LookupError("there is no generation to search")
        normal = search.resolve_normalize(normalize_mode, stored="norm_cf" in pages.columns)
        asked = ids.cache_key(query, mode, range_limit, space_mode, normal, list(chosen))
        key = f"{asked}:{name}:{int(detail)}"
        began, known, cached, size = self.clock(), self.cache.get(key), True, 0
        if known is None and self.fixed is not None and not detail:
            known = self._stored(asked, request, normal, name, key)
        if known is None:
            cached = False
            hits = search.in_order(search.hits(pages, request, normal, detail, self._filled(name))).persist()
            known = Result(hits, request.words, chosen, normal, name, key, request)
            size = results.payload_bytes(known.hits).first().bytes
            known.count()
            if not self.cache.set(key, known, size):
                hits.unpersist()  # too large to keep: it is computed again where it is asked for
        self.log.append((asked[:16], query, mode, known.count(), size / 1024, None if cached else (self.clock() - began) * 1000, cached, began))
        return known

    def _filled(self, name: str) -> bool:
        """Whether every page of the generation has its case-folded text, so that one column answers a search."""
        return bool((self.store.manifest(name) or {}).get("folded"))

    def _stored(self, asked: str, request: Request, normal: str, name: str, key: str) -> Result | None:
        """The result that was stored for a heavy query, taken into the cache."""
        entry = self.fixed.get(asked[:16], list(request.folders))
        if entry is None:
            return None
        result = Result(search.in_order(self.fixed.hits(entry)), request.words, request.folders, normal, name, key, request, entry["result_count"])
        self.cache.set(key, result, entry["size"])
        return result

    def detail(self, file_id: str, page_key: str, hit_pos: int) -> str | None:
        row = search.detail(self.store.read("pages"), file_id, page_key, hit_pos).first()
        return row.detail if row else None

    def export(self, result: Result, kind: str = "csv") -> Iterator[str]:
        """The result with the longer text of every hit, from the generation it was found in."""
        if kind not in ("csv", "json"):
            raise ValueError(f"no export as {kind!r}")
        hits, r = result.hits, result.request
        if "detail" not in hits.columns:
            hits = search.in_order(search.hits(self.store.read("pages", result.index_uuid), r, result.normalize_mode, detail=True, filled=self._filled(result.index_uuid)))
        named = {x.folder_id: x.folder_name or x.folder_id for x in self.folders_table.select("folder_id", "folder_name").collect()}
        meta = {
            "query": r.query, "mode": r.mode, "range_limit": r.range_limit, "space_mode": r.space_mode, "normalize_mode": result.normalize_mode, "folders": list(result.folder_ids),
            "folder_names": [named[f] for f in result.folder_ids if f in named], "index_uuid": result.index_uuid or "unknown", "result_count": result.count(),
        }
        now = datetime.fromtimestamp(self.clock(), UTC)
        return results.export_csv(hits, meta, now) if kind == "csv" else results.export_json(hits, meta, now)

    # views

    def folders(self) -> DataFrame:
        return self.folders_table.orderBy("folder_ord")

    def health(self) -> bool:
        return bool(self.folders_table.agg(F.bool_and("ready") & (F.count("*") > 0)).first()[0])

    def files(self, source: str, scope: str = "all") -> DataFrame:
        """The files below *source*, by their paths from there."""
        failures = self.store.read("failures")
        return inc.files_view(files.scan(self.spark, source), self.store.read("pages").select("path"), failures, scope, source)

    def query_log(self) -> DataFrame:
        return self.spark.createDataFrame(list(self.log), "query_key string, query_text string, search_mode string, hits bigint, payload_kb double, elapsed_ms double, cached boolean, ts double")

    def stats(self) -> DataFrame:
        return workload.query_stats(self.query_log())

    def warm(self) -> int:
        """Read the current generation once, as after a switch of generations; the one before is let go. Gives its number of pages."""
        name = self.store.current()
        if self._warm is None or self._warm[0] != name:
            if self._warm is not None:
                self._warm[1].unpersist()
            pages = self.store.read("pages", name).persist()
            self._warm = (name, pages, pages.count())
        return self._warm[2]
