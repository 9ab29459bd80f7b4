"""Versions of the page store: order, retention, manifest, and the pointer to the current one."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscan.functions.ids import folders_hash
from folioscan.sources.shared import Shared

SCHEMA_VERSION = "1"


def created(name: str = "gen_name", stamp: str = "created_timestamp") -> Column:
    """The recorded time, else the epoch the name begins with, else 0."""
    return F.coalesce(F.col(stamp), F.expr(f"try_cast(split_part({name}, '_', 1) AS BIGINT)"), F.lit(0))


def listed(generations: DataFrame) -> DataFrame:
    """Newest first; ties by name."""
    return generations.withColumn("created", created()).orderBy(F.desc("created"), "gen_name")


def retention(generations: DataFrame, now: float, keep: int = 3, keep_days: float = 0, max_bytes: int = 0, grace_sec: float = 300) -> DataFrame:
    """(gen_name, created, bytes, reason) of every generation; a null reason stays.

    The current one and those within the grace time are never deleted, and
    generations without a recorded time are exempt from grace and age.  First
    the count decides, then the age, then the oldest go until all that stay,
    the exempt included, fit in *max_bytes*.  A limit of 0 is off.
    """
    stamp = F.col("created_timestamp")
    g = generations.withColumn("created", created()).withColumn("eligible", ~F.coalesce("is_current", F.lit(False)) & (stamp.isNull() | (F.lit(now) - stamp >= grace_sec) | F.lit(grace_sec <= 0)))
    newest = W.partitionBy("eligible").orderBy(F.desc("created"), "gen_name")
    by_count = F.col("eligible") & F.lit(keep > 0) & (F.row_number().over(newest) > keep)
    by_age = F.col("eligible") & F.lit(keep_days > 0) & stamp.isNotNull() & ((F.lit(now) - stamp) / 86400 > keep_days)
    g = g.withColumn("why", F.when(by_count, "count").when(by_age, "age"))
    left = F.col("why").isNull()
    total = F.sum(F.when(left, F.col("bytes")).otherwise(0)).over(W.partitionBy())
    oldest = W.partitionBy("loose").orderBy("created", F.desc("gen_name")).rowsBetween(W.unboundedPreceding, -1)
    g = g.withColumns({"loose": left & F.col("eligible"), "total": total})
    before = F.coalesce(F.sum("bytes").over(oldest), F.lit(0))
    reason = F.coalesce("why", F.when(F.col("loose") & F.lit(max_bytes > 0) & (F.col("total") - before > max_bytes), "bytes"))
    return g.select("gen_name", "created", "bytes", reason.alias("reason"))


def manifest_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("folder_id").agg(F.countDistinct("path").alias("file_count"))


def source_hash(folders: DataFrame) -> DataFrame:
    return folders.agg(folders_hash(F.collect_list("path")).alias("source_folders_hash"))


class Store:
    """Generations of the page store under one root, with an atomic pointer to the current one.

    Readers take the pointer's generation, so they are never held up by a build;
    a build that fails leaves nothing behind.
    """

    POINTER = "current.txt"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Shared(spark, root)

    def names(self) -> list[str]:
        """Newest first."""
        found = [n[4:] for n in self.files.folders() if n.startswith("gen_")]
        made = {n: (self.manifest(n) or {}).get("created_timestamp") or (int(head) if (head := n.split("_")[0]).isdigit() else 0) for n in found}
        return sorted(found, key=lambda n: (-made[n], n))

    def current(self) -> str | None:
        """The pointer's generation; without a pointer the newest, which the pointer then names."""
        name = (self.files.read(self.POINTER) or "").strip()
        if name and self.files.is_dir(f"gen_{name}"):
            return name
        names = self.names()
        if names:
            self.files.write(self.POINTER, names[0])
        return names[0] if names else None

    def manifest(self, name: str) -> dict | None:
        try:
            return json.loads(self.files.read(f"gen_{name}/manifest.json") or "null")
        except ValueError:
            return None

    def commit(self, name: str, frames: dict[str, DataFrame], folders: DataFrame, now: float) -> str:
        """Write all frames to a build folder, give it its name, then swap the pointer."""
        build = f".build/gen_{name}"
        try:
            for table, df in frames.items():
                writer = df.write.mode("overwrite")
                (writer.partitionBy("folder_id") if table == "pages" else writer).parquet(self.files.place(f"{build}/{table}"))
            counts = {r.folder_id: r.file_count for r in manifest_counts(self.spark.read.parquet(self.files.place(f"{build}/pages"))).collect()}
            parts = folders.select("folder_id", "path", "folder_name").collect()
            manifest = {
                "index_uuid": name, "schema_version": SCHEMA_VERSION, "created_at": datetime.fromtimestamp(now, UTC).isoformat(), "created_timestamp": int(now), "folded": "norm_cf" in frames["pages"].columns,
                "source_folders_hash": source_hash(folders).first()[0], "folders": {r.folder_id: {"path": r.path, "name": r.folder_name, "file_count": counts.get(r.folder_id, 0)} for r in parts},
            }
            self.files.write(f"{build}/manifest.json", json.dumps(manifest, ensure_ascii=False))
            self.files.rename(build, f"gen_{name}")
        except BaseException:
            self.files.delete(build)
            raise
        self.files.write(self.POINTER, name)
        return name

    def stage(self, name: str, table: str, df: DataFrame) -> DataFrame:
        """A frame that a build needs more than once, written and read from there."""
        place = self.files.place(f".stage/{name}/{table}")
        df.write.mode("overwrite").parquet(place)
        return self.spark.read.schema(df.schema).parquet(place)

    def unstage(self, name: str) -> None:
        self.files.delete(f".stage/{name}")

    def read(self, table: str, name: str | None = None) -> DataFrame | None:
        name = name or self.current()
        place = f"gen_{name}/{table}"
        return self.spark.read.parquet(self.files.place(place)) if name and self.files.is_dir(place) else None

    def generations(self) -> DataFrame:
        current = self.current()
        rows = [(n, (self.manifest(n) or {}).get("created_timestamp"), self.files.size(f"gen_{n}"), n == current) for n in self.names()]
        return self.spark.createDataFrame(rows, "gen_name string, created_timestamp bigint, bytes bigint, is_current boolean")

    def clean(self, now: float, **limits) -> list[str]:
        gone = [r.gen_name for r in retention(self.generations(), now, **limits).where("reason is not null").collect()]
        for n in gone:
            self.files.delete(f"gen_{n}")
        return gone
