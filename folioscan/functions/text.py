"""Text functions as columns, with driver twins for query words.

Every column builder is null in, null out; the empty string stays empty.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values.
CID = r"(?i)\(cid:\d+\)"
INVISIBLE = "​‌‍⁠﻿  "  # each counts as one space
JP = "぀-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ"
WIDE_SPACE = "\\t-\\r\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"  # what Python's \s takes for a blank, but the space itself
SPACE = f"[{WIDE_SPACE} ]"
SNIPPET_BEFORE, SNIPPET_LENGTH = 40, 160
DETAIL_BEFORE, DETAIL_LENGTH = 500, 2000
FLEX_LONGEST = 64

_PY_JP_GAP = re.compile(rf"(?<=[{JP}])\s+(?=[{JP}])")


def strip_cid(c: Column) -> Column:
    return F.regexp_replace(c, CID, "")


def even_separators(c: Column) -> Column:
    """Invisible separators as spaces, one for one."""
    return F.translate(c, INVISIBLE, " " * len(INVISIBLE))


def one_space(c: Column) -> Column:
    # a single space stays as it is: most blanks are such, and nothing is written for them
    return F.regexp_replace(c, f"[{WIDE_SPACE}]{SPACE}*| {SPACE}+", " ")


def _each(fn):
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else fn(v) for v in values.to_pylist()], pa.string())

    return run


def _nfkc(t: str) -> str:
    return t if t.isascii() else unicodedata.normalize("NFKC", t)


_nfkc_udf = F.arrow_udf(_each(_nfkc), StringType())
_casefold_udf = F.arrow_udf(_each(str.casefold), StringType())


def nfkc(c: Column) -> Column:
    """Compatibility composition: no built-in does it, so it runs on Arrow batches."""
    return _nfkc_udf(c)


def casefold(c: Column) -> Column:
    return _casefold_udf(c)


def norm(c: Column) -> Column:
    """Compatibility form, lower case, single spaces; an outer space stays."""
    return one_space(F.lower(even_separators(nfkc(strip_cid(c)))))


def norm_strict(c: Column) -> Column:
    """Case and width kept, single spaces, trimmed."""
    return F.trim(one_space(even_separators(strip_cid(c))))


def norm_cf(c: Column, compress: bool = True) -> Column:
    """Compatibility form, case folded."""
    folded = F.regexp_replace(casefold(even_separators(nfkc(strip_cid(c)))), "[\n\t\r]", " ")
    return one_space(folded) if compress else folded


def space_mode(c: Column, mode: str) -> Column:
    if mode == "all":
        return F.regexp_replace(c, SPACE + "+", "")
    if mode == "jp":
        return F.regexp_replace(c, f"(?<=[{JP}]){SPACE}+(?=[{JP}])", "")
    if mode == "none":
        return c
    raise ValueError(f"space mode {mode!r}")


@functools.cache
def _forms_udf():
    even = str.maketrans(INVISIBLE, " " * len(INVISIBLE))

    def run(values: pa.Array) -> pa.Array:
        made = [None if v is None else _nfkc(v) for v in values.to_pylist()]
        folded = [None if v is None else v.translate(even).casefold() for v in made]
        return pa.StructArray.from_arrays([pa.array(made, pa.string()), pa.array(folded, pa.string())], ["n", "f"])

    return F.arrow_udf(run, "n string, f string")


def variants(raw: Column, folded: bool = True) -> dict[str, Column]:
    """The derived columns of a page: three normal forms by three space modes; the text goes to Python once."""
    if folded:
        both = _forms_udf()(strip_cid(raw))
        plain, cf = one_space(F.lower(even_separators(both["n"]))), one_space(F.regexp_replace(both["f"], "[\n\t\r]", " "))
        forms = {"norm": plain, "norm_strict": norm_strict(raw), "norm_cf": cf}
    else:
        forms = {"norm": norm(raw), "norm_strict": norm_strict(raw)}
    return {n + s: space_mode(c, m) for n, c in forms.items() for s, m in (("", "none"), ("_jp", "jp"), ("_all", "all"))}


def snippet_text(c: Column) -> Column:
    return F.trim(one_space(F.replace(even_separators(strip_cid(c)), F.lit("\r"), F.lit(""))))


def detail_text(c: Column) -> Column:
    flat = F.replace(even_separators(strip_cid(c)), F.lit("\r"), F.lit(""))
    flat = F.regexp_replace(flat, "\n(?!　)", " ")
    return F.regexp_replace(F.regexp_replace(flat, "[ \t]+", " "), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def detail_window(raw: Column, pos: Column) -> Column:
    return detail_text(F.substring(raw, F.greatest(pos - DETAIL_BEFORE, F.lit(0)) + 1, F.lit(DETAIL_LENGTH)))


def starts(text: Column, groups: list[list[str]]) -> Column:
    """ARRAY<STRUCT<n, h0, h1, ...>>: of each start of any word, in order, overlapping ones too, the characters up to the next start, and for each group whether one of its words starts there ("" if not).

    The first element stands for the text before the first start.  The text is
    gone over once for its pieces and once for each group.
    """
    some = "|".join(java_quote(w) for g in groups for w in g if w)
    lengths = F.transform(F.split(text, f"(?={some})"), F.length)
    hits = [F.regexp_extract_all(text, F.lit(f"(?=({'|'.join(java_quote(w) for w in sorted(g, key=len) if w)})?)(?={some})"), F.lit(1)) for g in groups]
    # a text that begins with a start has no piece before it
    n = F.when(F.size(lengths) > F.size(hits[0]), lengths).otherwise(F.concat(F.array(F.lit(0)), lengths))
    return F.arrays_zip(n.alias("n"), *[F.concat(F.array(F.lit("")), h).alias(f"h{i}") for i, h in enumerate(hits)])


def java_quote(word: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}\-])", r"\\\1", word)


def flexible_pattern(word: str) -> str | None:
    """The word with any blanks between its characters, regardless of case."""
    bare = re.sub(r"\s+", "", word)
    if not 2 <= len(bare) <= FLEX_LONGEST:
        return None
    return "(?iU)" + r"[\s\x1c-\x1f]*".join(map(java_quote, bare))


def extension(path: Column) -> Column:
    got = F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))
    return F.when((got == "") | got.isNull(), F.lit("unknown")).otherwise(got)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def relative_path(path: Column, base: Column) -> Column:
    return F.when(F.startswith(path, F.concat(base, F.lit("/"))), F.substring(path, F.length(base) + 2, F.length(path))).otherwise(path)


def escape_html(c: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(mark), F.lit(entity))
    return c


def query_key(c: Column) -> Column:
    return F.trim(one_space(c))


# Driver twins: query words are normalised once, by the same rules.


def _separators(t: str) -> str:
    return t.translate(dict.fromkeys(map(ord, INVISIBLE), " "))


def word_norm(word: str, mode: str, space: str) -> str:
    """A query word in the form of the column it is looked up in."""
    t = re.sub(CID, "", word)
    if mode == "normalized":
        t = _separators(unicodedata.normalize("NFKC", t)).casefold()
    else:
        t = _separators(t)
    t = re.sub(r"\s+", " ", t).strip()
    return re.sub(r"\s+", "", t) if space == "all" else _PY_JP_GAP.sub("", t) if space == "jp" else t
