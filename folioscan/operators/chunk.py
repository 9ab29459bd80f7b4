"""Long texts into pages, sheet rows into blocks, layout boxes into reading order."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscan.operators.arrow import flat_map, spread

TARGET, LEAST, MOST, OVERLAP = 1200, 600, 1800, 200
_MARKER = re.compile(r"\s*--+\s*page\s*(\d+)?\s*--+\s*", re.IGNORECASE)
_BLANK = re.compile("[\n \t]")
_BLANKS = re.compile("[\n \t]*")
# Marks that a page may end behind where there is no blank.
_MARK = re.compile(r"[。．、，.!?？！)\]}」』】）〕〉》】○×△□◇■\-―—]")


def marked_pages(text: str) -> dict[int, str]:
    """Pages between marker lines; a repeated number replaces the page before; {} without a marker or any text."""
    parts: list[tuple[int, list[str]]] = [(1, [])]
    seen = False
    for line in text.split("\n"):
        m = _MARKER.fullmatch(line)
        if m:
            seen = True
            parts.append((int(m[1]) if m[1] else parts[-1][0] + 1, []))
        else:
            parts[-1][1].append(line)
    # a later part under the same number wins if it has a line at all
    pages = {number: "\n".join(lines).strip() for number, lines in parts if lines}
    return {n: t for n, t in pages.items() if t} if seen else {}


def break_after(text: str, start: int, target: int = TARGET, least: int = LEAST, most: int = MOST) -> int:
    """Where the page that begins at *start* ends: behind the first blank from the target on, else the last before it."""
    end, goal, low = (min(len(text), start + n) for n in (most, target, least))
    if low >= end:
        return end
    for kind in (_BLANK, _MARK):
        hit = kind.search(text, goal, end)
        at = hit.start() if hit else max((m.start() for m in kind.finditer(text, low, goal)), default=None)
        if at is not None:
            return _BLANKS.match(text, at + 1).end()
    return goal


def sized_pages(text: str, target: int = TARGET, least: int = LEAST, most: int = MOST, overlap: int = OVERLAP) -> Iterator[str]:
    """Pages of at most *most* characters, each starting *overlap* before the end of the last."""
    if len(text) <= most:
        if text.strip():
            yield text.strip()
        return
    at = 0
    while len(text) - at > most:
        end = break_after(text, at, target, least, most)
        if text[at:end].strip():
            yield text[at:end].strip()
        at = max(end - overlap, at + 1) if overlap > 0 else end
    if text[at:].strip():
        yield text[at:].strip()


def text_pages(text: str | None) -> list[tuple[int, str]]:
    """(number, text) of the pages of a plain text; none of a null or blank one."""
    if not text:
        return []
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    marked = marked_pages(text)
    return list(marked.items()) if marked else list(enumerate(sized_pages(text), 1))


def chunked(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, page_no, page_ord, raw), one row per page of every text; other columns are not looked at."""
    kind = df.schema[key].dataType.simpleString()
    slim = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    return flat_map(spread(slim), lambda k, t: ((k, n, i, p) for i, (n, p) in enumerate(text_pages(t))), f"`{key}` {kind}, page_no int, page_ord int, raw string")


def sheet_blocks(rows: DataFrame, size: int = 40) -> DataFrame:
    """(file, sheet, label, raw): every *size* non-blank rows of a sheet joined, named by its first and last row.

    Repeated row numbers keep their order by text; an empty frame gives an empty one.
    """
    rank = F.row_number().over(W.partitionBy("file", "sheet").orderBy("row_idx", "text"))
    return (
        rows.where(F.trim("text") != "")
        .withColumn("block", F.floor((rank - 1) / size))
        .groupBy("file", "sheet", "block")
        .agg(F.min("row_idx").alias("a"), F.max("row_idx").alias("b"), F.array_sort(F.collect_list(F.struct("row_idx", "text"))).alias("r"))
        .select("file", "sheet", F.format_string("%s 行 %d-%d", "sheet", "a", "b").alias("label"), F.array_join(F.transform("r", lambda x: x["text"]), "\n").alias("raw"))
    )


def reading_order(boxes: DataFrame) -> DataFrame:
    """(page_id, layout, raw): the boxes of each page in reading order.

    Vertical writing: from right to left.  Two columns: the left one first.
    Else from top to bottom.  Blank boxes count for the layout but give no line.
    """
    page = W.partitionBy("page_id")
    n = F.count("*").over(page)
    upright = F.count_if(F.col("vertical")).over(page)
    on_left = (F.col("x0") + F.col("x1")) / 2 < (F.col("page_x0") + F.col("page_x1")) / 2
    left = F.count_if(on_left).over(page)
    two = (n >= 6) & (left >= 2) & (n - left >= 2) & (left / n > 0.3) & (left / n < 0.7)
    layout = F.when((upright > n - upright) & (upright >= 3), "vertical").when(two, "columns").otherwise("single")
    vertical = F.col("layout") == "vertical"
    key = F.struct(
        F.when((F.col("layout") == "columns") & ~F.col("on_left"), 1).otherwise(0).alias("column"),
        F.when(vertical, -F.col("x0")).otherwise(-F.col("y1")).alias("first"),
        F.when(vertical, -F.col("y1")).otherwise(F.col("x0")).alias("second"),
        F.trim("text").alias("line"),
    )
    return (
        boxes.withColumns({"layout": layout, "on_left": on_left})
        .groupBy("page_id", "layout")
        .agg(F.array_sort(F.collect_list(key)).alias("k"))
        .select("page_id", "layout", F.array_join(F.filter(F.transform("k", lambda x: x["line"]), lambda x: x != ""), "\n").alias("raw"))
    )


def csv_text(columns: list[str]) -> Column:
    """A row of cells as one line."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
