import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscan.functions import text as T
from folioscan.operators import search
from folioscan.operators.search import Request

CASES = [
    ("alpha beta", "alpha beta", "AND", 0, "jp", "normalized", True),
    ("alpha beta", "alpha gamma", "AND", 0, "jp", "normalized", False),
    ("alpha beta", "alpha gamma", "OR", 0, "jp", "normalized", True),
    ("alpha beta", "alpha beta", "AND", 6, "jp", "normalized", True),
    ("alpha beta", "alpha beta", "AND", 5, "jp", "normalized", False),
    ("a", "a a", "AND", 1, "jp", "normalized", True),
    ("Alpha", "alpha", "AND", 0, "jp", "exact", False),
    ("東 京", "東京", "AND", 0, "jp", "normalized", True),
    ("東 京", "東京", "AND", 0, "none", "normalized", False),
    ("x", "(cid:1)", "AND", 0, "jp", "normalized", False),
    ("x", "(cid:1) x", "OR", 0, "jp", "normalized", True),
]


def pages(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "page_ord int, raw string")
    path = F.concat(F.lit("/d/"), F.col("page_ord").cast("string"), F.lit(".txt"))
    df = df.withColumns({"folder_id": F.lit("f"), "folder_name": F.lit("F"), "folder_ord": F.lit(0), "path": path, "display_path": path, "file": path, "file_id": F.left(F.sha2(path, 256), F.lit(12)), "page": F.lit("-"), "page_key": F.lit("1")})
    return df.withColumns(T.variants(F.col("raw")))


@pytest.mark.parametrize("text,query,mode,limit,space,normal,hit", CASES)
def test_cases(spark, text, query, mode, limit, space, normal, hit):
    r = Request(query, ("f",), mode, limit, space, normal)
    assert (search.matched(pages(spark, [text]), r).count() == 1) is hit


@pytest.mark.parametrize("bad", [{"query": " "}, {"folders": ()}, {"mode": "XOR"}, {"range_limit": 5001}, {"space_mode": "x"}, {"normalize_mode": "x"}])
def test_bad_requests(bad):
    with pytest.raises(ValueError):
        Request(**({"query": "a", "folders": ("f",)} | bad))


def test_hit_position_follows_query_order(spark):
    r = Request("zwei eins", ("f",))
    row = search.hits(pages(spark, ["eins und ZWEI"]), r, detail=True).first()
    assert row.detail_key.hit_pos == 9 and row.context == "...eins und ZWEI..." and row.detail == "eins und ZWEI"


def test_flexible_position(spark):
    row = search.hits(pages(spark, ["ab 東\n京"]), Request("東京", ("f",))).first()
    assert row.detail_key.hit_pos == 3


def test_nulls_and_empty(spark):
    df = pages(spark, [None, "", "pump"])
    assert search.hits(df, Request("pump", ("f",))).count() == 1
    assert search.hits(df.limit(0), Request("pump", ("f",))).count() == 0
    with pytest.raises(ValueError):
        search.detail(df, "xyz", "1", 0)


def brute(text, words, limit):
    at = [[i for i in range(len(text)) if text.startswith(w, i)] for w in words]
    if not all(at):
        return None
    best = None
    import itertools

    for combo in itertools.product(*at):
        span = max(combo) - min(combo)
        best = span if best is None else min(best, span)
    return best


def test_span_against_brute_force(spark):
    texts = ["abcabc", "aaab", "xxbxxaxxc", "cab", "aabbcc", "ccbbaa", "b", ""] + ["".join(x) for x in ("abca" * 5, "cxb" * 3 + "a", "a" * 9 + "bc")]
    words = ["a", "b", "c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.s for r in df.select("t", search.least_span(F.col("t"), [[w] for w in words]).alias("s")).collect()}
    assert got == {t: brute(t, words, 0) for t in texts}
