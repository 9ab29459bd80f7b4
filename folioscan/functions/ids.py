"""Identifiers, digests and fingerprints."""

from __future__ import annotations

import hashlib
import json
import secrets
import time

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_VERSION = "v2"


def folder_id(path: Column) -> Column:
    return F.left(F.sha2(path, 256), F.lit(10))


def file_id(path: Column) -> Column:
    return F.left(F.sha2(path, 256), F.lit(12))


def directory_name(path: Column) -> Column:
    return F.left(F.sha2(path, 256), F.lit(12))


def folders_hash(paths: Column) -> Column:
    """Digest of a set of folder paths, whatever their order."""
    return F.sha2(F.array_join(F.array_sort(paths), "|"), 256)


def fast_fingerprint(content: Column, n: int = 65536) -> Column:
    """Digest of length, head and tail, so that large files are not read through.  Null content has none."""
    size = F.octet_length(content)
    tail = F.least(F.lit(n), F.greatest(size - n, F.lit(0)))
    ends = F.concat(
        F.encode(size.cast("string"), "UTF-8"), F.substring(content, F.lit(1), F.lit(n)), F.substring(content, size - tail + 1, tail)
    )
    return F.sha2(ends, 256)


def full_hash(content: Column, algorithm: str = "sha256") -> Column:
    """Digest of the whole content."""
    native = {"sha256": lambda c: F.sha2(c, 256), "sha512": lambda c: F.sha2(c, 512), "sha224": lambda c: F.sha2(c, 224), "sha384": lambda c: F.sha2(c, 384), "md5": F.md5, "sha1": F.sha1}
    if algorithm not in native:
        raise ValueError(f"no digest {algorithm!r}; there are {', '.join(native)}")
    return native[algorithm](content)


def cache_key(query: str, mode: str, range_limit: int, space: str, normalize: str, folders: list[str]) -> str:
    """Key of a search result: blanks in the query and the order of folders don't matter."""
    parts = {"v": KEY_VERSION, "q": " ".join(query.split()), "mode": mode, "range": range_limit, "space": space, "normalize": normalize, "folders": sorted(folders)}
    return hashlib.sha256(json.dumps(parts, ensure_ascii=False, sort_keys=True).encode()).hexdigest()[:16]


def generation_name(now: float | None = None) -> str:
    return f"{int(time.time() if now is None else now)}_{secrets.token_hex(4)}"
