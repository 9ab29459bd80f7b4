from hypothesis import given, settings
from hypothesis import strategies as st

from folioscan.operators import chunk
from folioscan.sources.layout import ordered


def test_sizes():
    assert chunk.text_pages("") == [] and chunk.text_pages(None) == [] and chunk.text_pages(" \n ") == []
    assert [len(t) for _, t in chunk.text_pages("x" * 1800)] == [1800]
    assert [len(t) for _, t in chunk.text_pages("x" * 1801)] == [1200, 801]


def test_markers():
    assert chunk.text_pages("intro\n--- Page 5 ---\nfive\n-- page --\nsix") == [(1, "intro"), (5, "five"), (6, "six")]
    assert chunk.text_pages("--- Page 2 ---\na\n--- Page 2 ---\nb") == [(2, "b")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word", "。", "\n", " ", "東京", "x" * 50, ")", "\t"]), min_size=200, max_size=900))
def test_chunks_cover_the_text(parts):
    text = "".join(parts)
    pages = list(chunk.sized_pages(text))
    assert all(len(p) <= chunk.MOST for p in pages)
    at = 0
    for p in pages:
        i = text.find(p, max(0, at - chunk.MOST))
        assert i >= 0
        at = max(at, i + len(p))
    assert not text[at:].strip()


def test_sheet_blocks(spark):
    rows = spark.createDataFrame([("f", "S", i, f"r{i}") for i in range(1, 82)] + [("f", "S", 99, " ")], "file string, sheet string, row_idx int, text string")
    got = chunk.sheet_blocks(rows).orderBy("label").collect()
    assert [r.label for r in got] == ["S 行 1-40", "S 行 41-80", "S 行 81-81"]
    assert chunk.sheet_blocks(rows.limit(0)).count() == 0


BOXES = {
    1: [("b", 10, 0, 20, 90, True), ("a", 50, 0, 60, 90, True), ("c", 1, 0, 9, 90, True), ("h", 70, 0, 99, 95, False)],
    2: [("l1", 0, 80, 40, 90, False), ("r1", 60, 80, 90, 95, False), ("l2", 0, 50, 40, 60, False), ("r2", 60, 50, 90, 60, False), ("l3", 0, 10, 40, 20, False), ("r3", 60, 10, 90, 20, False)],
    3: [("x", 0, 10, 40, 20, False), ("y", 60, 80, 90, 95, False), ("z", 0, 50, 40, 60, False), ("  ", 0, 1, 2, 3, False)],
}
ORDER = {1: "h\na\nb\nc", 2: "l1\nl2\nl3\nr1\nr2\nr3", 3: "y\nz\nx"}


def test_reading_order(spark):
    rows = [(n, 0.0, 100.0, t, float(a), float(b), float(c), float(e), v) for n, bs in BOXES.items() for t, a, b, c, e, v in bs]
    df = spark.createDataFrame(rows, "page_id long, page_x0 double, page_x1 double, text string, x0 double, y0 double, x1 double, y1 double, vertical boolean")
    assert {r.page_id: r.raw for r in chunk.reading_order(df).collect()} == ORDER
    assert {n: ordered(bs, (0, 0, 100, 100)) for n, bs in BOXES.items()} == ORDER
