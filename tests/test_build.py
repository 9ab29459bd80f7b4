import io
import json
import os
import sys
import types
import zipfile

from pyspark.sql import functions as F

from folioscan.engine import Engine
from folioscan.functions import ids
from folioscan.operators import incremental as inc
from folioscan.operators.components import components
from folioscan.operators.generations import retention
from folioscan.sources import config, files
from folioscan.sources.shared import Shared
from folioscan.streaming import batches


def xlsx(rows):
    out = io.BytesIO()
    cells = "".join(f'<row r="{i}">' + "".join(f'<c t="inlineStr"><is><t>{v}</t></is></c>' for v in r) + "</row>" for i, r in enumerate(rows, 1))
    m = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{m}" xmlns:r="{r}"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{m}"><sheetData>{cells}</sheetData></worksheet>')
    return out.getvalue()


def docx(lines, cells):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:tbl><w:tr>{"".join(f"<w:tc>{p(c)}</w:tc>" for c in cells)}</w:tr></w:tbl>{"".join(map(p, lines))}</w:body></w:document>')
    return out.getvalue()


def test_readers():
    assert list(files.extract_file("/a/x.xlsx", xlsx([["a", " b "], [" "], ["c"]]))) == [("/a/x.xlsx", "S 行 1-3", None, 0, "a b\nc", None)]
    assert list(files.extract_file("/a/x.docx", docx(["one", "two"], ["c1"])))[0][4] == "one\ntwo\nc1"
    assert list(files.extract_file("/a/x.csv", "名,前\n1,2\n".encode("cp932")))[0][4] == "名 前\n1 2"
    assert list(files.extract_file("/a/x.TXT", "日本".encode("euc-jp")))[0][5] is None
    assert list(files.extract_file("/a/x.txt", b""))[0][5] == files.EMPTY_FILE
    assert list(files.extract_file("/a/x.txt", b"  "))[0][5] == files.NO_TEXT
    assert list(files.extract_file("/a/x.docx", b"zz"))[0][5] == "例外:BadZipFile"
    assert list(files.extract_file("/a/x.xlsx", b"zz"))[0][5] == files.NOTHING_READ[".xlsx"]
    assert list(files.extract_file("/a/x.txt", b"\x81\x00"))[0][5] == files.NOTHING_READ[".txt"]
    assert list(files.extract_file("/a/x.docx", docx([], [])))[0][5] == files.NOTHING_READ[".docx"]
    assert list(files.extract_file("/a/x.odt", b"zz"))[0][5] == files.UNSUPPORTED
    assert list(files.extract_file("/a/x.txt", None))[0][5] == files.EMPTY_FILE


def test_digests_from_both_ends(spark, tmp_path):
    sizes = (0, 10, 64, 65, 127, 128, 129, 300)
    rows = [(str(tmp_path / f"f{n}.txt"), bytes(i * i % 251 for i in range(n))) for n in sizes]
    for p, b in rows:
        with open(p, "wb") as f:
            f.write(b)
    df = spark.createDataFrame([*rows, ("/none/x.txt", None)], "path string, content binary")
    want = {r[0]: (r[1], r[2]) for r in df.select("path", ids.fast_fingerprint(F.col("content"), 64), ids.full_hash(F.col("content"))).collect()}
    assert {r.path: (r.fast_fp, r.full_hash) for r in files.digests(df, full=True, ends=64).collect()} == want and want["/none/x.txt"] == (None, None)


def test_sheet_cells():
    m = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cells = ['<c t="s"><v>0</v></c>', '<c t="s"><v>1</v></c>', '<c s="1"><v>45296</v></c>', '<c s="2"><v>45296.5</v></c>', '<c s="1"><v>0.25</v></c>', '<c s="3"><v>1.5</v></c>', '<c s="4"><v>1234.50</v></c>', '<c><v>7</v></c>', '<c t="b"><v>1</v></c>', '<c t="b"><v>0</v></c>', '<c t="e"><v>#DIV/0!</v></c>', '<c t="str"><v>made</v></c>', "<c/>"]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{m}" xmlns:r="{r}"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{m}"><si><t>東京</t><rPh sb="0" eb="2"><t>トウキョウ</t></rPh></si><si><r><t>大</t></r><r><t>阪</t></r><rPh sb="0" eb="1"><t>オオ</t></rPh></si></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{m}"><numFmts><numFmt numFmtId="164" formatCode="yyyy/mm/dd hh:mm"/><numFmt numFmtId="165" formatCode="[h]:mm"/><numFmt numFmtId="166" formatCode="[Red]#,##0.00&quot;days&quot;"/></numFmts><cellXfs><xf/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="166"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{m}"><sheetData><row r="1">{"".join(cells)}</row></sheetData></worksheet>')
    assert list(files.xlsx_rows(out.getvalue())) == [("S", 1, "東京 大阪 2024-01-05 00:00:00 2024-01-05 12:00:00 06:00:00 1 day, 12:00:00 1234.5 7 True False #DIV/0! made")]


def test_build_opens_only_what_changed(spark, tmp_path, monkeypatch):
    docs = tmp_path / "docs"
    (docs / "deep" / "er").mkdir(parents=True)
    for i in range(30):
        (docs / "deep" / f"f{i}.txt").write_text(f"text {i}")
    (docs / "deep" / "er" / "x+y z%41.txt").write_text("odd name")
    base = str(docs)
    folders = spark.createDataFrame([("f1", base, "Docs", base, 0, True, None)], "folder_id string, path string, folder_name string, display_path string, folder_ord int, ready boolean, message string")
    clock = iter(range(1_000_000, 2_000_000, 10))
    e = Engine(spark, str(tmp_path / "store"), folders, clock=lambda: float(next(clock)))
    e.build(base, "fastfp")
    before = {r.path: r for r in e.store.read("file_state").collect()}
    assert len(before) == 31 and all(r.inode and r.fast_fp and r.mtime_ns == os.stat(p).st_mtime_ns for p, r in before.items())
    (docs / "deep" / "f3.txt").write_text("another text")
    os.utime(docs / "deep" / "f4.txt", (5, 5))
    reads = files.extract_paths
    monkeypatch.setattr(files, "extract_paths", lambda df: counted_paths.append(sorted(r.path for r in df.collect())) or reads(df))
    counted_paths = []
    e.build(base, "fastfp", allow_shrink=True)
    after = {r.path: r for r in e.store.read("file_state").collect()}
    changed, touched = f"{base}/deep/f3.txt", f"{base}/deep/f4.txt"
    assert counted_paths == [[changed]]
    assert all(after[p] == before[p] for p in before if p not in (changed, touched))
    assert after[changed].last_indexed_at > before[changed].last_indexed_at and after[changed].fast_fp != before[changed].fast_fp
    assert after[touched].last_indexed_at == before[touched].last_indexed_at and after[touched].fast_fp == before[touched].fast_fp and after[touched].mtime_ns == 5_000_000_000
    assert sorted(r.raw for r in e.store.read("pages").collect()) == sorted(["another text", "odd name", *(f"text {i}" for i in range(30) if i != 3)])
    e.build(base, allow_shrink=True)  # by size and time alone: digests stay for a later build that asks for them
    assert counted_paths[1:] == [[]] and {r.path: r.fast_fp for r in e.store.read("file_state").collect()} == {p: r.fast_fp for p, r in after.items()}
    assert not (tmp_path / "store" / ".stage").exists() or not any((tmp_path / "store" / ".stage").iterdir())


def test_failures_are_tried_again(spark, tmp_path):
    import shutil

    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.txt").write_text("good")
    (docs / "b.docx").write_bytes(b"zz")
    base = str(docs)
    folders = spark.createDataFrame([("f1", base, "Docs", base, 0, True, None)], "folder_id string, path string, folder_name string, display_path string, folder_ord int, ready boolean, message string")
    clock = iter(range(1_000_000, 2_000_000, 10))
    e = Engine(spark, str(tmp_path / "store"), folders, clock=lambda: float(next(clock)), rebuild_wait=1000)
    name = e.build(base)
    assert e.failure_sample() == [f"[1] {base}/b.docx: 例外:BadZipFile"]
    stat = os.stat(docs / "b.docx")
    (docs / "b.docx").write_bytes(docx(["now"], [])[:])
    shutil.rmtree(tmp_path / "store" / f"gen_{name}" / "failures")  # unreadable: known files without a page are tried
    os.utime(docs / "b.docx", ns=(stat.st_atime_ns, stat.st_mtime_ns))
    e.build(base, allow_shrink=True)
    assert e.failure_sample() == [] and e.store.read("pages").count() == 2
    assert e.rebuild(base, allow_shrink=True) and not e.rebuild(base, allow_shrink=True)


def test_shared_folder(spark, tmp_path):
    f = Shared(spark, str(tmp_path / "s"))
    assert f.read("x") is None and f.folders() == [] and f.size("x") == 0 and not f.is_dir("x")
    f.write("a/x", "é1")
    f.write("a/x", "é2")
    assert f.read("a/x") == "é2" and f.folders() == ["a"] and f.size("a") == 3 and f.is_dir("a")
    f.rename("a", "b/c")
    assert f.read("b/c/x") == "é2" and f.folders() == ["b"]
    f.delete("b")
    assert f.folders() == []


def test_failure_sample(spark):
    df = spark.createDataFrame([(f"/{i}", "r") for i in range(8)], "path string, reason string")
    assert inc.failure_sample(df) == [f"[{i + 1}] /{i}: r" for i in range(5)] + ["... 3 more"] and inc.failure_sample(df.limit(0)) == []


def test_damaged_pdf_pages(monkeypatch):
    def layout(_):
        yield types.SimpleNamespace(bbox=(0, 0, 1, 1))
        raise ValueError("damaged page")

    def plain(_, page_numbers):
        if page_numbers == [1]:
            raise ValueError("damaged page")
        return ["one\n", None, "", "four\n"][page_numbers[0]]

    parts = {"high_level": {"extract_pages": layout, "extract_text": plain}, "layout": {"LTTextBoxVertical": tuple, "LTTextContainer": str}, "pdfpage": {"PDFPage": types.SimpleNamespace(get_pages=lambda *_, **__: iter(range(4)))}}
    monkeypatch.setitem(sys.modules, "pdfminer", types.ModuleType("pdfminer"))
    for name, members in parts.items():
        module = types.ModuleType(f"pdfminer.{name}")
        vars(module).update(members)
        monkeypatch.setitem(sys.modules, f"pdfminer.{name}", module)
    assert [r[1:5] for r in files.extract_file("/a/x.pdf", b"%PDF")] == [("1", 1, 0, "one"), ("4", 4, 1, "four")]


def test_build_and_search(spark, tmp_path):
    docs = tmp_path / "docs" / "sub"
    docs.mkdir(parents=True)
    (docs / "a.txt").write_text("The pump in 東 京 is new.")
    (docs / "b.csv").write_text("pump,valve\n")
    (docs / "c.xlsx").write_bytes(xlsx([["pump list"]]))
    (docs / "empty.txt").write_text("")
    (docs / "skip.bin").write_text("pump")
    base = str(tmp_path / "docs")
    folders = spark.createDataFrame([("f1", base, "Docs", base, 0, True, None), ("f2", "/none", "None", "/none", 1, False, "x")], "folder_id string, path string, folder_name string, display_path string, folder_ord int, ready boolean, message string")
    clock = iter(range(1_000_000, 2_000_000, 10))
    e = Engine(spark, str(tmp_path / "store"), folders, clock=lambda: float(next(clock)))
    first = e.build(base)
    assert e.store.current() == first and e.store.manifest(first)["folders"]["f1"]["file_count"] == 3
    r = e.search("pump", ["f1", "f2", "zz"])
    assert r.count() == 3 and e.search("pump", ["f1", "f2"]) is r
    assert [x.page for x in r.hits.collect()] == ["-", "-", "S 行 1-1"]
    hit = e.search("東京", ["f1"]).hits.first()
    assert e.detail(hit.detail_key.file_id, hit.detail_key.page, hit.detail_key.hit_pos).startswith("The pump")
    table = "".join(e.export(r)).splitlines()
    assert table[:4] == ["\ufeff# フォルダ内テキスト検索 - エクスポート", "# クエリ,pump", "# モード,AND", "# 範囲,0"] and table[9] == "# 結果件数,3" and table[8] == "# 検索フォルダ,Docs" and table[10] == ""
    assert table[11] == "ファイル名,パス,ページ,フォルダ,スニペット,詳細" and len(table) == 15 and all(x.rsplit(",", 1)[1] for x in table[12:])
    told = json.loads("".join(e.export(r, "json")))
    assert told["metadata"]["folder_names"] == ["Docs"] and told["metadata"]["index_uuid"] == first and len(told["results"]) == 3 and all(x["detail"] for x in told["results"])
    assert [x.n for x in r.facets()[1].collect()] == [1, 1, 1] and r.by_file().count() == 3
    assert {x.path: x.reason for x in e.files(base, "missing").collect()} == {"sub/empty.txt": files.EMPTY_FILE}
    assert e.failure_sample() == [f"[1] {base}/sub/empty.txt: {files.EMPTY_FILE}"]
    assert not e.health() and e.stats().count() == 2

    (docs / "a.txt").write_text("The valve is old.")
    os.utime(docs / "a.txt", (5, 5))
    (docs / "b.csv").unlink()
    second = e.build(base, allow_shrink=True)
    assert second != first and e.search("pump", ["f1"]).count() == 2  # b.csv is a candidate yet
    e.build(base, allow_shrink=True)
    assert e.search("pump", ["f1"]).count() == 1 and e.search("old", ["f1"]).count() == 1
    assert e.clean(keep=1, grace_sec=0) == [first] and e.warm() == 2
    e.store.files.delete(e.store.POINTER)
    assert e.store.current() is not None


def test_held_folder_is_read_later(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.txt").write_text("first text")
    base = str(docs)
    folders = spark.createDataFrame([("f1", base, "Docs", base, 0, True, None)], "folder_id string, path string, folder_name string, display_path string, folder_ord int, ready boolean, message string")
    clock = iter(range(1_000_000, 2_000_000, 10))
    e = Engine(spark, str(tmp_path / "store"), folders, clock=lambda: float(next(clock)))
    e.build(base)
    (docs / "a.txt").write_text("another text")
    (docs / "b.txt").write_text("late text")
    e.build(base)  # fewer files than the guard asks for: held
    assert [r.raw for r in e.store.read("pages").collect()] == ["first text"] and e.store.read("file_state").count() == 1
    e.build(base, allow_shrink=True)
    assert sorted(r.raw for r in e.store.read("pages").collect()) == ["another text", "late text"]


def test_guard(spark):
    counts = spark.createDataFrame([("a", 20, 0), ("b", 20, 15), ("c", 20, 16), ("d", 5, 4), ("e", 0, 0)], "folder_id string, n_cached long, n_scanned long")
    verdicts = lambda allow: {r.folder_id: r.verdict for r in inc.shrink_guard(counts, allow).collect()}
    assert verdicts(False) == {"a": "keep_empty", "b": "keep_shrunk", "c": "build", "d": "keep_shrunk", "e": "build"}
    assert verdicts(True) == {"a": "keep_empty", "b": "build", "c": "build", "d": "build", "e": "build"}


STATE = "path string, size long, mtime_ns long, inode long, file_id long, fast_fp string, full_hash string, last_indexed_at double, deletion_candidate_since double"


def test_diff_and_strikes(spark):
    row = lambda p, size=1, t=1, i=7, fp=None, since=None: (p, size, t, i, None, fp, None, 0.0, since)
    old = spark.createDataFrame([row("same"), row("size"), row("touch", fp="x"), row("edit", fp="x"), row("inode"), row("gone"), row("gone2", since=5.0), row("back", since=5.0)], STATE)
    new = spark.createDataFrame([row("same"), row("size", 2), row("touch", t=2, fp="x"), row("edit", t=2, fp="y"), row("inode", i=8), row("back"), row("new")], STATE)
    got = {r.path: r.status for r in inc.classify(new, old, "fastfp").collect()}
    assert got == {"same": "unchanged", "size": "changed", "touch": "same_fingerprint", "edit": "changed", "inode": "changed", "gone": "absent", "gone2": "absent", "back": "unchanged", "new": "new"}
    strikes = {r.path: r.verdict for r in inc.two_strikes(old, new, 9.0).collect()}
    assert strikes["gone"] == "candidate" and strikes["gone2"] == "deleted" and strikes["back"] == "cleared"
    assert inc.classify(new.limit(0), old.limit(0)).count() == 0


def test_retention(spark):
    now = 1_000_000.0
    g = spark.createDataFrame([("a", 999_990, 10, True), ("b", 999_900, 10, False), ("c", 900_000, 10, False), ("d", 800_000, 10, False), ("700000_x", None, 10, False)], "gen_name string, created_timestamp long, bytes long, is_current boolean")
    why = lambda **k: {r.gen_name: r.reason for r in retention(g, now, **k).collect() if r.reason}
    assert why(keep=1) == {"d": "count", "700000_x": "count"}
    assert why(keep=0, keep_days=2) == {"d": "age"}
    assert why(keep=0, max_bytes=25) == {"700000_x": "bytes", "d": "bytes", "c": "bytes"}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, 101), (102, 101), (5, 5), (7, 6)]
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(df, "a", "b").collect()}
    assert got == {**dict.fromkeys(range(1, 31), 1), **dict.fromkeys((100, 101, 102), 100)}
    assert components(df.limit(0), "a", "b").count() == 0


def test_config(spark, tmp_path):
    found = config.parse_folders("A=/x/a ; # note\n'/y' | smb:\\\\host\\share, smb://h/s # c")
    assert [(f.path, f.label) for f in found] == [("/x/a", "A"), ("/y", ""), ("//host/share", ""), ("//h/s", "")]
    (tmp_path / "c.json").write_text('{"search": {"folders": [{"label": "L", "path": "/p"}], "workers": 6}, "front": {"on": true}}')
    s = config.load(str(tmp_path / "c.json"), env={"SEARCH_WORKERS": "3", "FRONT_ON": " "})
    assert s.get("SEARCH_WORKERS") == "3" and s.get("FRONT_ON") == "1" and s.folders[0].label == "L"
    df = spark.createDataFrame([("//NAS-a/x",), ("/mnt/x",)], "p string")
    assert [r[0] for r in df.select(config.display_path(F.col("p"), {"nas-a": "N"})).collect()] == ["//N/x", "/mnt/x"]


def test_stream_ingest(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.txt").write_text("one")
    go = lambda: batches.ingest(spark, str(src), str(tmp_path / "out"), str(tmp_path / "place"))
    go()
    (src / "b.txt").write_text("two")
    go()
    assert sorted(r.raw for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["one", "two"]
