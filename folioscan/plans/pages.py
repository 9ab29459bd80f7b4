"""Queries on texts, identifiers, chunks and layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscan.functions import ids
from folioscan.functions import text as T
from folioscan.operators import chunk
from folioscan.operators.arrow import spread
from folioscan.plans.searches import EVEN, WS, _snippet, _strip
from folioscan.schema import VARIANTS
from folioscan.sources import config
from folioscan.sources.tables import table

ALIASES = {"nas-a": "NAS:a", "nas-b": "文書庫B", "nas-c": "文書庫C"}


def norm_variants(spark: SparkSession, d: str) -> DataFrame:
    """All nine derived columns made anew from the raw text."""
    rows = spread(table(spark, d, "memory_pages").select("page_id", F.col("norm_cf").isNull().alias("_bare"), "raw"))
    made = rows.select("page_id", "_bare", *[c.alias(n) for n, c in T.variants(F.col("raw")).items()])
    shown = [F.when(F.col("_bare") & F.lit(n.startswith("norm_cf")), None).otherwise(F.md5(n)).alias(n) for n in VARIANTS]
    return made.select("page_id", *shown).distinct()


def strip_cid(spark, d):
    return table(spark, d, "memory_pages").select("page_id", F.md5(T.strip_cid(F.col("raw"))).alias("h")).distinct()


def invisible_sep(spark, d):
    return table(spark, d, "memory_pages").select("page_id", F.md5(T.even_separators(F.col("raw"))).alias("h"), F.length(T.even_separators(F.col("raw"))).cast("bigint").alias("n")).distinct()


def snippet_text(spark, d):
    return table(spark, d, "memory_pages").select("page_id", F.md5(T.snippet_text(F.col("raw"))).alias("h")).distinct()


def file_ids(spark, d):
    return table(spark, d, "memory_pages").select("path", ids.file_id(F.col("path")).alias("file_id"), ids.folder_id(F.col("path")).alias("folder_like")).distinct()


def fingerprint(spark, d):
    content = F.encode("text", "UTF-8")
    return table(spark, d, "documents").select("doc_id", ids.fast_fingerprint(content, 64).alias("fast_fp"), ids.fast_fingerprint(content).alias("usual_fp"), ids.full_hash(content).alias("full_hash"), ids.full_hash(content, "md5").alias("md5"))


def path_parts(spark, d):
    p = F.col("path")
    return table(spark, d, "file_state").select("path", T.extension(p).alias("ext"), T.basename(p).alias("file"), T.depth(p).cast("bigint").alias("depth"), T.relative_path(p, F.lit("/mnt/share")).alias("rel")).distinct()


def display_path(spark, d):
    return table(spark, d, "file_state").select("path", config.display_path(F.col("path"), ALIASES).alias("shown")).distinct()


def escape_html(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.escape_html(F.col("text"))).alias("h"))


def query_keys(spark, d):
    return table(spark, d, "query_log").select(T.query_key(F.col("query_text")).alias("query_text"), "query_key").distinct()


def chunk_pages(spark, d):
    got = chunk.chunked(table(spark, d, "documents"), "doc_id", "text")
    return got.select("doc_id", "page_no", "page_ord", F.length("raw").cast("bigint").alias("n"), F.md5("raw").alias("h"))


def stream_ingest(spark, d):
    """Every passage of the evaluation items written as a file, and the files taken in by the stream, in two goes."""
    from folioscan.streaming import batches

    base = batches.shared_dir(spark, "ingest")
    items = table(spark, d, "eval_items").where("passage is not null").select("item_id", "passage")
    for part in (0, 1):
        some = items.where(F.pmod("item_id", F.lit(2)) == part)
        some.write.mode("append").option("lineSep", " ").partitionBy("item_id").text(f"{base}/files")
        batches.ingest(spark, f"{base}/files", f"{base}/pages", f"{base}/place")
    got = spark.read.parquet(f"{base}/pages").where("reason is null")
    return got.select(F.regexp_extract("path", "item_id=([0-9]+)", 1).cast("bigint").alias("item_id"), "page_no", F.length("raw").cast("bigint").alias("n"), F.md5("raw").alias("h"))


def chunk_markers(spark, d):
    """Files of the archive written out as one text with marker lines, and taken apart again."""
    number = F.coalesce("page_no", F.col("page_ord") + 1).alias("page_no")  # sheet ranges have none of their own
    rows = table(spark, d, "memory_pages").select("path", number, "raw").distinct()
    one = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "raw"))), lambda x: F.concat(F.lit("--- Page "), x["page_no"].cast("string"), F.lit(" ---\n"), x["raw"])), "\n")
    files = rows.groupBy("path").agg(one.alias("whole"))
    return chunk.chunked(files, "path", "whole").select("path", "page_no", F.length("raw").cast("bigint").alias("n"))


def sheet_blocks(spark, d):
    orders = table(spark, d, "lineitem").select(
        F.floor(F.col("l_orderkey") / 500).cast("string").alias("file"), F.col("l_returnflag").alias("sheet"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("int").alias("row_idx"),
        F.concat_ws(" ", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("text"),
    )
    return chunk.sheet_blocks(orders).select("file", "sheet", "label", F.md5("raw").alias("h"))


def reading_order(spark, d):
    n = F.col("l_linenumber")
    boxes = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("page_id"), F.lit(0.0).alias("page_x0"), F.lit(200_000.0).alias("page_x1"), F.concat(F.lit(" "), n.cast("string"), F.lit(":"), F.col("l_partkey").cast("string")).alias("text"),
        F.col("l_extendedprice").alias("x0"), (F.col("l_quantity") * 10 + n).alias("y0"), (F.col("l_extendedprice") + 10).alias("x1"), (F.col("l_quantity") * 10 + n + 5).alias("y1"), (F.col("l_returnflag") == "R").alias("vertical"),
    )
    return chunk.reading_order(boxes)


def csv_row_text(spark, d):
    return table(spark, d, "nation").select("n_nationkey", chunk.csv_text(["n_nationkey", "n_name", "n_regionkey"]).alias("line"))


def proximity_spans(spark, d):
    """The smallest distance of two words on every page that has both."""
    from folioscan.operators import search

    pages = table(spark, d, "memory_pages").select("page_id", F.col("norm").alias("t")).where("contains(t, 'pump') and contains(t, 'lease')").distinct()
    return pages.select("page_id", search.least_span(F.col("t"), [["pump"], ["lease"]]).cast("bigint").alias("span"))


def page_numbers(spark, d):
    """Order of the pages within a file, from their stored keys."""
    rows = table(spark, d, "memory_pages").select("file_id", "page_key", "page_ord").distinct()
    return rows.select("file_id", "page_key", F.row_number().over(W.partitionBy("file_id").orderBy("page_ord", "page_key")).cast("bigint").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        norm_variants, strip_cid, invisible_sep, snippet_text, file_ids, fingerprint, path_parts, display_path, escape_html, query_keys, chunk_pages, stream_ingest, chunk_markers, sheet_blocks, reading_order, csv_row_text, proximity_spans, page_numbers,
    )
}

_EXT = r"lower(regexp_extract(path, '(\.[^./\\]*)$', 1))"
_UTF = "encode(text)"


def _pages_sql(source: str, key: str) -> str:
    """Pages of texts, step by step: each begins 200 characters before the last one's end; that is behind a blank, else a mark, from the 1,200th character on, else the last before it."""
    blank, mark = "\\n \\t", r"。．、，.!?？！)\]}」』】）〕〉》】○×△□◇■\-―—"

    def hit(kind: str) -> str:
        ahead, back = f"length(regexp_extract(substr(w, 1201), '^[^{kind}]*'))", f"length(regexp_replace(substr(w, 601, 600), '[^{kind}]*$', ''))"
        return f"CASE WHEN {ahead} < length(w) - 1200 THEN 1200 + {ahead} WHEN {back} > 0 THEN 599 + {back} END"

    bare = f"regexp_replace(p, '^{WS}+|{WS}+$', '', 'g')"
    return (
        f"WITH RECURSIVE d AS (SELECT {key} AS k, replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM ({source}) WHERE t IS NOT NULL), "
        "s AS (SELECT k, t, 0 AS b, 0 AS e, 0 AS step FROM d UNION ALL "
        "SELECT k, t, CASE WHEN step = 0 THEN 0 ELSE greatest(e - 200, b + 1) END AS b, e2, step + 1 FROM (SELECT *, CASE WHEN length(t) - a <= 1800 THEN length(t) WHEN h IS NULL THEN a + 1200 ELSE a + h + 1 + length(regexp_extract(substr(t, a + h + 2), '^[\\n \\t]*')) END AS e2 FROM "
        f"(SELECT *, coalesce({hit(blank)}, {hit(mark)}) AS h FROM (SELECT *, CASE WHEN step = 0 THEN 0 ELSE greatest(e - 200, b + 1) END AS a, substr(t, CASE WHEN step = 0 THEN 1 ELSE greatest(e - 200, b + 1) + 1 END, 1800) AS w FROM s WHERE e < length(t) OR step = 0)))), "
        f"p AS (SELECT k, step, substr(t, b + 1, e - b) AS p FROM s WHERE step > 0), q AS (SELECT k, step, {bare} AS p FROM p) "
        f"SELECT k AS {key}, row_number() OVER (PARTITION BY k ORDER BY step) AS i, p FROM q WHERE p <> ''"
    )


SQL = {
    "chunk_pages": f"SELECT doc_id, CAST(i AS INT) AS page_no, CAST(i - 1 AS INT) AS page_ord, length(p) AS n, md5(p) AS h FROM ({_pages_sql('SELECT doc_id, text AS t FROM documents', 'doc_id')})",
    "stream_ingest": f"SELECT item_id, CAST(i AS INT) AS page_no, length(p) AS n, md5(p) AS h FROM ({_pages_sql("SELECT item_id, passage || ' ' AS t FROM eval_items WHERE passage IS NOT NULL", 'item_id')})",
    "norm_variants": "SELECT DISTINCT page_id, " + ", ".join(f"md5({v}) AS {v}" for v in VARIANTS) + " FROM memory_pages",
    "strip_cid": f"SELECT DISTINCT page_id, md5({_strip('raw')}) AS h FROM memory_pages",
    "invisible_sep": f"SELECT DISTINCT page_id, md5({EVEN}) AS h, length({EVEN}) AS n FROM memory_pages",
    "snippet_text": f"SELECT DISTINCT page_id, md5({_snippet('raw')}) AS h FROM memory_pages",
    "file_ids": "SELECT DISTINCT path, left(sha256(path), 12) AS file_id, left(sha256(path), 10) AS folder_like FROM memory_pages",
    "fingerprint": f"SELECT doc_id, sha256(encode(octet_length({_UTF})::VARCHAR) || {_UTF}[1:64] || CASE WHEN octet_length({_UTF}) > 64 THEN {_UTF}[octet_length({_UTF}) - least(64, octet_length({_UTF}) - 64) + 1 : octet_length({_UTF})] ELSE ''::BLOB END) AS fast_fp, sha256(encode(octet_length({_UTF})::VARCHAR) || {_UTF}[1:65536] || CASE WHEN octet_length({_UTF}) > 65536 THEN {_UTF}[octet_length({_UTF}) - least(65536, octet_length({_UTF}) - 65536) + 1 : octet_length({_UTF})] ELSE ''::BLOB END) AS usual_fp, sha256(text) AS full_hash, md5(text) AS md5 FROM documents",
    "path_parts": f"SELECT DISTINCT path, CASE WHEN {_EXT} = '' THEN 'unknown' ELSE {_EXT} END AS ext, split_part(path, '/', -1) AS file, CAST(len(string_split(path, '/')) - 1 AS BIGINT) AS depth, CASE WHEN starts_with(path, '/mnt/share/') THEN substr(path, 12) ELSE path END AS rel FROM file_state",
    "display_path": r"SELECT DISTINCT path, CASE lower(regexp_extract(path, '^//([^/]+)', 1)) WHEN 'nas-a' THEN '//NAS:a' || substr(path, 8) WHEN 'nas-b' THEN '//文書庫B' || substr(path, 8) WHEN 'nas-c' THEN '//文書庫C' || substr(path, 8) ELSE path END AS shown FROM file_state",
    "escape_html": "SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS h FROM documents",
    "query_keys": f"SELECT DISTINCT trim(regexp_replace(query_text, '{WS}+', ' ', 'g')) AS query_text, query_key FROM query_log",
    "sheet_blocks": "WITH r AS (SELECT CAST(l_orderkey // 500 AS VARCHAR) AS file, l_returnflag AS sheet, CAST(l_orderkey * 10 + l_linenumber AS INT) AS i, concat_ws(' ', l_partkey, l_suppkey) AS t FROM lineitem), "
    "n AS (SELECT *, (row_number() OVER (PARTITION BY file, sheet ORDER BY i, t) - 1) // 40 AS b FROM r) "
    "SELECT file, sheet, sheet || ' 行 ' || min(i) || '-' || max(i) AS label, md5(string_agg(t, chr(10) ORDER BY i, t)) AS h FROM n GROUP BY file, sheet, b",
    "reading_order": "WITH b AS (SELECT l_orderkey AS page_id, l_linenumber || ':' || l_partkey AS t, l_extendedprice AS x0, l_quantity * 10 + l_linenumber + 5 AS y1, l_returnflag = 'R' AS v, (l_extendedprice + l_extendedprice + 10) / 2 < 100000 AS lf FROM lineitem), "
    "p AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (v) OVER w AS vn, count(*) FILTER (lf) OVER w AS ln FROM b WINDOW w AS (PARTITION BY page_id)), "
    "q AS (SELECT *, CASE WHEN vn > n - vn AND vn >= 3 THEN 'vertical' WHEN n >= 6 AND ln >= 2 AND n - ln >= 2 AND ln / n > 0.3 AND ln / n < 0.7 THEN 'columns' ELSE 'single' END AS layout FROM p) "
    "SELECT page_id, layout, string_agg(t, chr(10) ORDER BY CASE WHEN layout = 'columns' AND NOT lf THEN 1 ELSE 0 END, CASE WHEN layout = 'vertical' THEN -x0 ELSE -y1 END, CASE WHEN layout = 'vertical' THEN -y1 ELSE x0 END, t) AS raw FROM q GROUP BY 1, 2",
    "chunk_markers": "WITH r AS (SELECT path, coalesce(page_no, page_ord + 1) AS page_no, replace(replace(max(raw), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS raw FROM memory_pages GROUP BY 1, 2), "
    f"t AS (SELECT path, page_no, regexp_replace(raw, '^{WS}+|{WS}+$', '', 'g') AS t FROM r) SELECT path, page_no, length(t) AS n FROM t WHERE t <> ''",
    "csv_row_text": "SELECT n_nationkey, concat_ws(' ', n_nationkey, n_name, n_regionkey) AS line FROM nation",
    "proximity_spans": "WITH m AS (SELECT DISTINCT page_id AS k, norm AS t FROM memory_pages WHERE contains(norm, 'pump') AND contains(norm, 'lease')), "
    "o AS (SELECT k, 0 AS g, unnest(list_filter(range(1, length(t) + 1), lambda i: substr(t, i, 4) = 'pump')) AS p FROM m UNION ALL SELECT k, 1, unnest(list_filter(range(1, length(t) + 1), lambda i: substr(t, i, 5) = 'lease')) FROM m), "
    "l AS (SELECT k, p, max(CASE WHEN g = 0 THEN p END) OVER w AS a, max(CASE WHEN g = 1 THEN p END) OVER w AS b FROM o WINDOW w AS (PARTITION BY k ORDER BY p RANGE UNBOUNDED PRECEDING)) "
    "SELECT k AS page_id, min(p - least(a, b)) AS span FROM l WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1",
    "page_numbers": "SELECT file_id, page_key, row_number() OVER (PARTITION BY file_id ORDER BY page_ord, page_key) AS n FROM (SELECT DISTINCT file_id, page_key, page_ord FROM memory_pages)",
}
