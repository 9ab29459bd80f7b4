import hashlib
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscan.functions import ids
from folioscan.functions import text as T
from folioscan.operators import results

CASES = [
    (" A\tB\n\nC ", " a b c ", "A B C", " a b c "),
    ("x(cid:12)y", "xy", "xy", "xy"),
    ("Straße", "straße", "Straße", "strasse"),
    ("ﬁn ＡＢＣ", "fin abc", "ﬁn ＡＢＣ", "fin abc"),
    ("a​b c", "a b c", "a b c", "a b c"),
    ("東　京", "東 京", "東 京", "東 京"),
    ("", "", "", ""),
    (None, None, None, None),
]


def test_normal_forms(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "id int, raw string")
    raw = F.col("raw")
    rows = df.select("id", T.norm(raw), T.norm_strict(raw), T.norm_cf(raw)).orderBy("id").collect()
    assert [tuple(r)[1:] for r in rows] == [c[1:] for c in CASES]


def test_space_modes(spark):
    df = spark.createDataFrame([("東 京 tower 東京",)], "t string")
    assert df.select(*[T.space_mode(F.col("t"), m) for m in ("none", "jp", "all")]).first() == ("東 京 tower 東京", "東京 tower 東京", "東京tower東京")
    with pytest.raises(ValueError):
        T.space_mode(F.col("t"), "x")


def test_starts_overlap(spark):
    df = spark.createDataFrame([("aaaa",), ("xaab",), ("b",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(T.starts(F.col("t"), [["aa"], ["ab", "aab"]])).collect()]
    assert [None if x is None else [(p.n, bool(p.h0), bool(p.h1)) for p in x] for x in got] == [
        [(0, False, False), (1, True, False), (1, True, False), (2, True, False)], [(1, False, False), (1, True, True), (2, False, True)], [(1, False, False)], [(0, False, False)], None,
    ]


def test_blanks_as_python_takes_them(spark):
    every = "a" + "b".join(chr(c) * n for c in range(0x3100) if chr(c).isspace() for n in (1, 2)) + " c \t\u3000 d  e"
    df = spark.createDataFrame([(every,)], "t string")
    assert df.select(T.one_space(F.col("t"))).first()[0] == re.sub(r"\s+", " ", every)


def test_detail_keeps_indented_lines(spark):
    df = spark.createDataFrame([("a\nb\n　c\r\nd  e",)], "t string")
    assert df.select(T.detail_text(F.col("t"))).first()[0] == "a b\n　c d e"


def test_extension(spark):
    df = spark.createDataFrame([("/a/B.PDF",), ("/a.b/c",), ("/x.tar.gz",), (None,)], "p string")
    assert [r[0] for r in df.select(T.extension(F.col("p"))).collect()] == [".pdf", "unknown", ".gz", "unknown"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB ß東京　​\tﬁ(cid:1)", max_size=30))
def test_words_are_settled(word):
    for mode in ("normalized", "exact"):
        for space in ("none", "jp", "all"):
            once = T.word_norm(word, mode, space)
            assert once == once.strip() and not re.search(r"\s\s", once)
            if mode == "normalized" and "(" not in word:
                assert unicodedata.normalize("NFKC", once) == once


def test_marks_longest_first():
    assert results.marked("the pump <b>", ["pump", "the pump"]) == '<span class="highlight">the pump</span> &lt;b&gt;'
    assert results.spans("ab ab", ["ab", "b a"]) == [(0, 2), (3, 5)] or results.spans("ab ab", ["ab", "b a"]) == [(1, 4)]
    assert results.spans("東 京", ["東京"]) == [(0, 3)]
    assert results.spans("", ["x"]) == []


def test_directory_names(spark):
    df = spark.createDataFrame([("/a/b",), (None,)], "p string")
    name, file = df.select(ids.directory_name(F.col("p")).alias("d"), ids.file_id(F.col("p")).alias("f")).first()
    assert name == file == hashlib.sha256(b"/a/b").hexdigest()[:12] and df.select(ids.folder_id(F.col("p"))).collect()[1][0] is None
