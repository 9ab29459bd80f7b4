"""Exhaustive substring search over pages: any word, all words, or all words within a distance.

The plan keeps two steps apart: a containment filter on one stored variant
column, evaluated inside the scan stage, and, only for the pages left, the
positions and the distance window.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions import text as T

MAX_RANGE = 5000


@dataclass(frozen=True)
class Request:
    """A validated search."""

    query: str
    folders: tuple[str, ...]
    mode: str = "AND"
    range_limit: int = 0
    space_mode: str = "jp"
    normalize_mode: str | None = None
    words: tuple[str, ...] = field(init=False, default=())

    def __post_init__(self):
        if not self.query or not self.query.strip():
            raise ValueError("the query is blank")
        if not self.folders:
            raise ValueError("no folder is chosen")
        if self.mode not in ("AND", "OR"):
            raise ValueError(f"mode {self.mode!r}")
        if not 0 <= self.range_limit <= MAX_RANGE:
            raise ValueError(f"a range lies between 0 and {MAX_RANGE}")
        if self.space_mode not in ("none", "jp", "all"):
            raise ValueError(f"space mode {self.space_mode!r}")
        if self.normalize_mode not in (None, "exact", "normalized"):
            raise ValueError(f"normalize mode {self.normalize_mode!r}")
        object.__setattr__(self, "words", tuple(self.query.split()))


def resolve_normalize(asked: str | None, default: str = "normalized", stored: bool = True) -> str:
    """The mode asked for, else the default; exact where case-folded text isn't stored."""
    mode = asked or default
    return "exact" if mode == "normalized" and not stored else mode


def variant(normalize_mode: str, space_mode: str, columns: list[str], filled: bool = False) -> Column:
    """The stored column a query reads; case-folded text falls back to the plain normal form where it is empty, unless the store is known to be *filled*."""
    tail = {"none": "", "jp": "_jp", "all": "_all"}[space_mode]
    if normalize_mode == "exact":
        return F.col("norm_strict" + tail)
    if filled:
        return F.col("norm_cf" + tail)
    plain = F.col("norm" + tail)
    return F.coalesce(F.nullif(F.col("norm_cf" + tail), F.lit("")), plain) if "norm_cf" + tail in columns else plain


def groups(request: Request, normalize_mode: str) -> list[list[str]]:
    """One group of alternatives per word of the query, in the form of the column."""
    return [[T.word_norm(w, normalize_mode, request.space_mode)] for w in request.words]


def matches_any(c: Column, words: list[list[str]]) -> Column:
    """Some word occurs; words that normalise to nothing are passed over."""
    found = [F.contains(c, F.lit(w)) for g in words for w in g if w]
    return reduce(Column.__or__, found) if found else F.lit(False)


def matches_all(c: Column, words: list[list[str]]) -> Column:
    """Of each group some word occurs; a group that normalises to nothing matches no page."""
    every = []
    for g in words:
        found = [F.contains(c, F.lit(w)) for w in g if w]
        if not found:
            return F.lit(False)
        every.append(reduce(Column.__or__, found))
    return reduce(Column.__and__, every) if every else F.lit(False)


def least_span(c: Column, words: list[list[str]]) -> Column:
    """The smallest distance between the first and the last of one start per group; null without one.

    The starts of all groups are walked once, in order: at each start the latest
    start of every group so far closes the best window that ends there.
    """
    n, none = len(words), F.lit(None).cast("int")
    zero = F.struct(F.lit(0).alias("at"), *[none.alias(f"l{i}") for i in range(n)], none.alias("best"))

    def step(acc: Column, x: Column) -> Column:
        last = [F.when(x[f"h{i}"] != "", acc["at"]).otherwise(acc[f"l{i}"]) for i in range(n)]
        every = reduce(Column.__and__, [v.isNotNull() for v in last])
        span = F.when(every, acc["at"] - (F.least(*last) if n > 1 else last[0]))
        return F.struct((acc["at"] + x["n"]).alias("at"), *[v.alias(f"l{i}") for i, v in enumerate(last)], F.least(acc["best"], span).alias("best"))

    return F.aggregate(T.starts(c, words), zero, step, lambda acc: acc["best"])


def matched(pages: DataFrame, request: Request, normalize_mode: str | None = None, filled: bool = False) -> DataFrame:
    """The pages of the chosen folders that match."""
    mode = normalize_mode or resolve_normalize(request.normalize_mode)
    words = groups(request, mode)
    c = variant(mode, request.space_mode, pages.columns, filled)
    pages = pages.where(F.col("folder_id").isin(list(request.folders)))
    if request.mode == "OR":
        return pages.where(matches_any(c, words))
    pages = pages.where(matches_all(c, words))
    if request.range_limit > 0 and len(words) > 1:
        pages = pages.where(least_span(c, words) <= request.range_limit)
    return pages


def raw_position(raw: Column, words: tuple[str, ...], space_mode: str) -> Column:
    """Start of the first word, in query order, that the text holds; else of the first with blanks between; else -1."""
    even = T.even_separators(raw)
    at = [F.nullif(F.instr(F.lower(even), w.lower()) - 1, F.lit(-1)) for w in words]
    if space_mode != "none":
        at += [F.nullif(F.regexp_instr(even, F.lit(p)) - 1, F.lit(-1)) for w in words if (p := T.flexible_pattern(w))]
    return F.coalesce(*at, F.lit(-1))


def hits(pages: DataFrame, request: Request, normalize_mode: str | None = None, detail: bool = False, filled: bool = False) -> DataFrame:
    """One hit per matching page, with its snippet and where to look for more."""
    out = matched(pages, request, normalize_mode, filled).withColumn("_at", raw_position(F.col("raw"), request.words, request.space_mode))
    start = F.greatest(F.col("_at") - T.SNIPPET_BEFORE, F.lit(0))
    snippet = T.snippet_text(F.substring(T.even_separators(F.col("raw")), start + 1, F.lit(T.SNIPPET_LENGTH)))
    pos = F.greatest(F.col("_at"), F.lit(0))
    columns = [
        "file", "path", "display_path", "page", F.concat(F.lit("..."), snippet, F.lit("...")).alias("context"),
        F.struct(F.coalesce("file_id", F.left(F.sha2("path", 256), F.lit(12))).alias("file_id"), F.col("page_key").alias("page"), pos.cast("int").alias("hit_pos")).alias("detail_key"),
        "folder_id", "folder_name", "folder_ord", "page_ord",
    ]
    return out.select(*columns, *([T.detail_window(F.col("raw"), pos).alias("detail")] if detail else []))


def detail(pages: DataFrame, file_id: str, page_key: str, hit_pos: int) -> DataFrame:
    """The longer window around a hit; no row where the page is not there."""
    if len(file_id) != 12 or any(ch not in "0123456789abcdef" for ch in file_id):
        raise ValueError("a file id is 12 hexadecimal digits")
    where = (F.col("file_id") == file_id) & (F.col("page_key") == str(page_key))
    return pages.where(where).select("path", "page_key", T.detail_window(F.col("raw"), F.lit(max(hit_pos, 0))).alias("detail")).distinct()


def in_order(found: DataFrame) -> DataFrame:
    """Folders as configured, unknown ones last; in a folder by path and page."""
    return found.orderBy(F.col("folder_ord").asc_nulls_last(), "path", "page_ord")


def colliding_ids(pages: DataFrame) -> DataFrame:
    """File ids that name more than one path."""
    return pages.groupBy("file_id").agg(F.countDistinct("path").alias("n_paths"), F.min("path").alias("first_path")).where("n_paths > 1")
