"""What is done with hits: facets, filters, grouping, batches, highlights, export."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscan.functions import text as T

BATCH = 100
# Header of an exported table.
EXPORT_HEADER = ["ファイル名", "パス", "ページ", "フォルダ", "スニペット", "詳細"]


def folder_facet(hits: DataFrame) -> DataFrame:
    """(folder_id, label, n), largest first; a name that several folders share carries the id."""
    per = hits.groupBy("folder_id").agg(F.max("folder_name").alias("name"), F.count("*").alias("n"))
    name = F.coalesce(F.col("name"), F.col("folder_id"))
    # one row per folder by now: the folders are a small configured table
    shared = F.count("*").over(W.partitionBy("name")) > 1
    label = F.when(shared, F.concat(name, F.lit(" ("), F.col("folder_id"), F.lit(")"))).otherwise(name)
    return per.select("folder_id", label.alias("label"), "n").orderBy(F.desc("n"), "label")


def extension_facet(hits: DataFrame) -> DataFrame:
    return hits.groupBy(T.extension(F.col("path")).alias("ext")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ext")


def filtered(hits: DataFrame, folders: list[str] | None = None, extensions: list[str] | None = None) -> DataFrame:
    """Both filters at once; an empty one lets all through."""
    if folders:
        hits = hits.where(F.col("folder_id").isin(folders))
    if extensions:
        hits = hits.where(T.extension(F.col("path")).isin([e.lower() for e in extensions]))
    return hits


def by_file(hits: DataFrame) -> DataFrame:
    """One row per path: its hits, and its page labels, numbers before words; files as they first appear."""
    order = F.struct(F.col("folder_ord"), F.col("path"), F.col("page_ord"))
    number = F.expr("try_cast(page AS INT)")
    return (
        hits.groupBy("path")
        .agg(
            F.min("file").alias("file"), F.min("display_path").alias("display_path"), F.min("folder_id").alias("folder_id"), F.count("*").alias("n_hits"), F.min(order).alias("first"),
            F.array_sort(F.collect_set(F.when(F.col("page") != "-", F.struct(F.coalesce(number, F.lit(2147483647)).alias("number"), F.col("page").alias("page"))))).alias("p"),
        )
        .orderBy("first")
        .select("path", "file", "display_path", "folder_id", "n_hits", F.transform("p", lambda x: x["page"]).alias("pages"))
    )


def batch(ordered: DataFrame, number: int, size: int = BATCH) -> DataFrame:
    """The batch of an ordered result that scrolling shows next."""
    return ordered.offset(number * size).limit(size)


def highlight_one(c: Column, word: str) -> Column:
    """Escaped text with every literal occurrence of one word marked.

    The raw text is taken apart into occurrences and what lies between, each
    part is escaped by itself: what an escape is made of is never matched.
    """
    if not word:
        return T.escape_html(c)
    w = T.java_quote(word)
    parts = F.regexp_extract_all(c, F.lit(f"(?ius){w}|(?:(?!{w}).)++"), F.lit(0))
    shown = F.transform(parts, lambda p: F.when(F.regexp_like(p, F.lit(f"(?ius)^{w}$")), F.concat(F.lit('<span class="highlight">'), T.escape_html(p), F.lit("</span>"))).otherwise(T.escape_html(p)))
    return F.array_join(shown, "")


def html_escape(t: str) -> str:
    return t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&#39;")


def spans(text: str, words: list[str], space_mode: str = "jp") -> list[tuple[int, int]]:
    """Ranges to mark: longer words first, each literal match that overlaps none yet, else, unless blanks count, matches with blanks between."""
    taken: list[tuple[int, int]] = []
    for word in sorted({w for w in words if w}, key=lambda w: (-len(w), words.index(w))):
        found = [m.span() for m in re.finditer(re.escape(word), text, re.IGNORECASE)]
        if not found and space_mode != "none":
            bare = re.sub(r"\s+", "", word)
            if 2 <= len(bare) <= T.FLEX_LONGEST:
                found = [m.span() for m in re.finditer(r"\s*".join(map(re.escape, bare)), text, re.IGNORECASE)]
        taken += [s for s in found if all(s[1] <= a or s[0] >= b for a, b in taken)]
    return sorted(taken)


def marked(text: str, words: list[str], space_mode: str = "jp") -> str:
    out, at = [], 0
    for a, b in spans(text, words, space_mode):
        out += [html_escape(text[at:a]), '<span class="highlight">', html_escape(text[a:b]), "</span>"]
        at = b
    return "".join(out) + html_escape(text[at:])


def highlight(df: DataFrame, column: str, words: list[str], out: str = "marked", space_mode: str = "jp") -> DataFrame:
    """Several words at once, by the exact rule on overlaps; null stays null."""
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else marked(v, words, space_mode) for v in values.to_pylist()], pa.string())

    return df.withColumn(out, F.arrow_udf(run, "string")(F.col(column)))


def payload_bytes(hits: DataFrame) -> DataFrame:
    """(bytes): size of the result as JSON in UTF-8."""
    return hits.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*hits.columns)))), F.lit(0)).alias("bytes"))


def export_rows(hits: DataFrame) -> DataFrame:
    """What an export shows of each hit: the path as the reader knows it, and the folder's name."""
    return hits.select("file", F.coalesce("display_path", "path").alias("path"), "page", F.coalesce("folder_name", "folder_id").alias("folder"), "context", "detail")


# Labels of the metadata of an exported table, and of the normalize modes.
EXPORT_TITLE = "# フォルダ内テキスト検索 - エクスポート"
EXPORT_LABELS = {
    "query": "# クエリ", "mode": "# モード", "range_limit": "# 範囲", "space_mode": "# 空白除去", "normalize_mode": "# 表記ゆれ", "index_uuid": "# インデックスUUID",
    "exported_at": "# エクスポート日時", "folder_names": "# 検索フォルダ", "result_count": "# 結果件数",
}
NORMALIZE_LABELS = {"normalized": "ゆらぎ吸収", "exact": "厳格（最小整形）"}


def export_csv(hits: DataFrame, meta: dict, now: datetime) -> Iterator[str]:
    """Lines of the exported file: a byte order mark, a title and metadata, the header, the rows as they come from the cluster."""
    line = io.StringIO()
    writer = csv.writer(line)

    def flush(row: list) -> str:
        line.seek(0)
        line.truncate()
        writer.writerow(row)
        return line.getvalue()

    said = meta | {"exported_at": now.strftime("%Y-%m-%d %H:%M:%S"), "normalize_mode": NORMALIZE_LABELS.get(meta.get("normalize_mode"), NORMALIZE_LABELS["exact"])}
    yield "\ufeff" + flush([EXPORT_TITLE])
    for name, label in EXPORT_LABELS.items():
        value = said.get(name, "")
        yield flush([label, ", ".join(value) if isinstance(value, (list, tuple)) else value])
    yield flush([])
    yield flush(EXPORT_HEADER)
    for r in export_rows(hits).toLocalIterator():
        yield flush(["" if v is None else v for v in r])


def export_json(hits: DataFrame, meta: dict, now: datetime) -> Iterator[str]:
    """The metadata and every hit with all its columns."""
    yield '{"metadata": ' + json.dumps(meta | {"exported_at": now.strftime("%Y-%m-%d %H:%M:%S")}, ensure_ascii=False) + ', "results": ['
    for i, r in enumerate(hits.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator()):
        yield (", " if i else "") + r.j
    yield "]}"


def history_kept(history: DataFrame, limit: int = 30) -> DataFrame:
    """Pinned entries, and of the others the newest of each search, at most *limit* of them in all.

    A missing normalize mode counts as exact.  Ties go to the smaller id.
    """
    key = [F.coalesce("normalize_mode", F.lit("exact")), "query", "search_mode", "range_limit", "space_mode", F.array_sort("folders")]
    newest = (F.desc("ts"), F.col("id"))
    loose = history.where(~F.coalesce("pinned", F.lit(False))).withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*newest))).where("_n = 1")
    return history.where("pinned").unionByName(loose.drop("_n").orderBy(*newest).limit(limit))
