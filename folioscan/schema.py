"""Row types of the engine."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampNTZType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(n, t, True) for n, t in fields.items()])


S, L, I, D, B = StringType(), LongType(), IntegerType(), DoubleType(), BooleanType()

VARIANTS = ("norm", "norm_jp", "norm_all", "norm_strict", "norm_strict_jp", "norm_strict_all", "norm_cf", "norm_cf_jp", "norm_cf_all")

FOLDERS = _struct(folder_id=S, path=S, folder_name=S, display_path=S, folder_ord=I, ready=B, message=S)
FILE_STATE = _struct(path=S, size=L, mtime_ns=L, inode=L, file_id=L, fast_fp=S, full_hash=S, last_indexed_at=D, deletion_candidate_since=D)
EXTRACTED = _struct(path=S, page_key=S, page_no=I, page_ord=I, raw=S, reason=S)
PAGES = _struct(
    folder_id=S, folder_name=S, path=S, display_path=S, file=S, file_id=S, page=S, page_key=S, folder_ord=I, page_ord=I, page_no=I, raw=S, **dict.fromkeys(VARIANTS, S)
)
FAILURES = _struct(folder_id=S, path=S, reason=S)
QUERY_LOG = _struct(
    query_key=S, query_text=S, search_mode=S, range_limit=I, space_mode=S, normalize_mode=S, folders=ArrayType(S), hits=L, payload_kb=D, elapsed_ms=D, cached=B, ts=D, received_at=TimestampNTZType()
)
HEARTBEATS = _struct(client_id=S, ts=D)
GENERATIONS = _struct(gen_name=S, created_timestamp=L, bytes=L, is_current=B)
HISTORY = _struct(id=S, query=S, search_mode=S, range_limit=I, space_mode=S, normalize_mode=S, folders=ArrayType(S), ts=L, pinned=B)
BOXES = _struct(page_id=L, page_x0=D, page_x1=D, text=S, x0=D, y0=D, x1=D, y1=D, vertical=B)
SHEET_ROWS = _struct(file=S, sheet=S, row_idx=I, text=S)
