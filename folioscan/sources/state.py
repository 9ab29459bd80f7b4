"""Small state files: file states as JSON lines, failures, query statistics, stored results."""

from __future__ import annotations

import gzip
import json
import os
import time
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from folioscan.schema import FILE_STATE


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """File states from JSON lines: bad lines and those without a path are passed over, of a path the last line counts."""
    schema = StructType([*FILE_STATE.fields, StructField("_bad", StringType())])
    lines = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    good = lines.withColumn("_n", F.monotonically_increasing_id()).where("_bad is null and path is not null")
    return good.withColumn("_last", F.max("_n").over(W.partitionBy("path"))).where("_n = _last").drop("_bad", "_n", "_last")


def write_state(state: DataFrame, path: str) -> None:
    state.orderBy("path").write.mode("overwrite").json(path)


def swap_in(path: str | Path, data: bytes) -> None:
    """Write beside, then replace: a reader sees the old file or the new one."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    beside = path.with_name(path.name + ".new")
    beside.write_bytes(data)
    os.replace(beside, path)


def write_json(path: str | Path, value, compress_from: int | None = None) -> str:
    """As JSON, as gzip from *compress_from* bytes on; gives the path written."""
    data = json.dumps(value, ensure_ascii=False).encode()
    packed = compress_from is not None and len(data) >= compress_from
    path = f"{path}.gz" if packed else str(path)
    swap_in(path, gzip.compress(data) if packed else data)
    return path


def read_json(path: str | Path, default=None):
    """The value, or the default where the file is missing or damaged."""
    try:
        data = Path(path).read_bytes()
        return json.loads(gzip.decompress(data) if str(path).endswith(".gz") else data)
    except (OSError, ValueError, EOFError):
        return default


def read_failures(path: str | Path) -> tuple[dict[str, str], bool]:
    """(reason by path, whether the file could be read): none and unreadable are not the same."""
    got = read_json(path)
    return (got, True) if isinstance(got, dict) else ({}, False)


class Flusher:
    """Writes what has changed, but not more often than every *every* seconds."""

    def __init__(self, save: Callable[[], None], every: float, clock: Callable[[], float] = time.monotonic):
        self.save, self.every, self.clock = save, every, clock
        self.dirty, self.last = False, float("-inf")

    def mark(self) -> None:
        self.dirty = True

    def maybe(self) -> bool:
        if not self.dirty or self.clock() - self.last < self.every:
            return False
        self.save()
        self.dirty, self.last = False, self.clock()
        return True


def prune_dir(root: str | Path, keep: Iterable[str], protected: Iterable[str] = ("index.json", "stats.json")) -> list[str]:
    """Remove the files of *root* that nothing refers to; gives their names."""
    kept = {Path(k).name for k in keep} | set(protected)
    gone = sorted(p.name for p in Path(root).glob("*") if p.is_file() and p.name not in kept)
    for name in gone:
        (Path(root) / name).unlink()
    return gone
