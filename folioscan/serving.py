"""Stored results of heavy queries, and work that runs on a schedule."""

from __future__ import annotations

import shutil
import time
from collections.abc import Callable
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.engine import Engine
from folioscan.functions.timing import schedule
from folioscan.operators import results, workload
from folioscan.operators.generations import SCHEMA_VERSION
from folioscan.sources import state


class FixedCache:
    """Results on disk for the queries that the workload shows to be heavy; valid for one generation only."""

    def __init__(self, engine: Engine, root: str, most: int = 20, ttl_days: float = 7, **thresholds):
        self.engine, self.root, self.most, self.ttl, self.thresholds = engine, Path(root), most, ttl_days, thresholds
        engine.fixed = self
        self.root.mkdir(parents=True, exist_ok=True)
        self.index: dict[str, dict] = state.read_json(self.root / "index.json", {})
        self.flusher = state.Flusher(lambda: state.write_json(self.root / "index.json", self.index), 60)

    def valid(self, entry: dict, folders: list[str] | None = None) -> bool:
        same = folders is None or sorted(set(entry["folders"])) == sorted(set(folders))
        return same and entry.get("index_uuid") == self.engine.store.current() and entry.get("schema_version") == SCHEMA_VERSION

    def get(self, key: str, folders: list[str]) -> dict | None:
        """What is stored for the query, if it is of this generation and of these folders; hits() reads its rows."""
        entry = self.index.get(key)
        if not entry or not self.valid(entry, folders) or not Path(entry["path"]).is_dir():
            return None
        entry["last_access"] = self.engine.clock()
        self.flusher.mark()
        self.flusher.maybe()
        return entry

    def hits(self, entry: dict) -> DataFrame:
        return self.engine.spark.read.parquet(entry["path"])

    def rebuild(self, requests: dict[str, dict]) -> list[str]:
        """Choose the heavy queries from the log, run them anew, and keep their results; gives their keys.

        *requests*: the arguments of a search by its key.  Where no query
        qualifies, the entries that are not too old are run again.
        """
        now = self.engine.clock()
        chosen = [r.query_key for r in workload.ranked(workload.heavy(self.engine.stats(), F.lit(now), self.ttl, **self.thresholds), self.most).select("query_key").collect()]
        if not chosen:
            chosen = [k for k, e in self.index.items() if now - e.get("last_access", 0) <= self.ttl * 86400]
        fresh: dict[str, dict] = {}
        for key in chosen[: self.most]:
            if key not in requests:
                continue
            result = self.engine.search(**requests[key])
            path = str(self.root / f"{key}_{result.index_uuid}")
            result.hits.write.mode("overwrite").parquet(path)  # by the executors: a result may be large
            size = results.payload_bytes(result.hits).first().bytes
            fresh[key] = {
                "path": path, "folders": list(result.folder_ids), "keywords": list(result.words), "normalize_mode": result.normalize_mode, "result_count": result.count(), "size": size,
                "last_access": now, "last_built": now, "index_uuid": result.index_uuid, "schema_version": SCHEMA_VERSION,
            }
        for gone in {e["path"] for e in self.index.values()} - {e["path"] for e in fresh.values()}:
            shutil.rmtree(gone, ignore_errors=True)
        self.index = fresh
        state.write_json(self.root / "index.json", fresh)
        return list(fresh)


def replay(engine: Engine, requests: dict[str, dict], k: int = 10) -> list[str]:
    """Run the most asked queries again, as after a new generation."""
    keys = [r.query_key for r in workload.most_asked(engine.stats(), k).select("query_key").collect() if r.query_key in requests]
    for key in keys:
        engine.search(**requests[key]).count()
    return keys


def next_run(value: str, now: datetime) -> datetime | None:
    """When a schedule is due next; none for an empty or unreadable one."""
    kind, a, b = schedule(value)
    if kind == "interval":
        return now + timedelta(hours=max(1, a))
    if kind == "time":
        at = now.replace(hour=a, minute=b, second=0, microsecond=0)
        return at if at > now else at + timedelta(days=1)
    return None


def run_schedule(value: str, job: Callable[[], None], rounds: int | None = None, now: Callable[[], datetime] = datetime.now, sleep: Callable[[float], None] = time.sleep) -> int:
    """Run *job* whenever the schedule is due; a search meanwhile reads the generation that is there."""
    done = 0
    while rounds is None or done < rounds:
        due = next_run(value, now())
        if due is None:
            return done
        sleep(max(1.0, (due - now()).total_seconds()))
        job()
        done += 1
    return done
