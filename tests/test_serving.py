from datetime import datetime

from folioscan.engine import Engine
from folioscan.serving import FixedCache, next_run, replay, run_schedule
from folioscan.operators.workload import ResultCache
from folioscan.sources import state


def test_state_files(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"path": "/a", "size": 1}\nnot json\n{"size": 3}\n{"path": "/a", "size": 2}\n')
    got = state.read_state(spark, str(tmp_path / "s.jsonl"))
    assert [(r.path, r.size) for r in got.collect()] == [("/a", 2)]
    state.write_state(got, str(tmp_path / "out"))
    assert state.read_state(spark, str(tmp_path / "out")).count() == 1
    assert state.read_failures(tmp_path / "none") == ({}, False)
    state.write_json(tmp_path / "f.json", {})
    assert state.read_failures(tmp_path / "f.json") == ({}, True)
    packed = state.write_json(tmp_path / "big.json", {"x": "y" * 100}, 50)
    assert packed.endswith(".gz") and state.read_json(packed) == {"x": "y" * 100}
    (tmp_path / "bad.json.gz").write_bytes(b"zz")
    assert state.read_json(tmp_path / "bad.json.gz", 7) == 7
    d = tmp_path / "dir"
    d.mkdir()
    for n in ("a.json", "b.json", "index.json"):
        (d / n).write_text("1")
    assert state.prune_dir(d, ["/x/a.json"]) == ["b.json"]


def test_flusher():
    saved, ticks = [], iter([0.0, 0.0, 5.0, 20.0, 20.0])
    f = state.Flusher(lambda: saved.append(1), 10, clock=lambda: next(ticks))
    assert not f.maybe()
    f.mark()
    assert f.maybe()
    f.mark()
    assert not f.maybe() and f.maybe() and len(saved) == 2


def test_fixed_cache(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.txt").write_text("pump one")
    folders = spark.createDataFrame([("f1", str(docs), "Docs", str(docs), 0, True, None)], "folder_id string, path string, folder_name string, display_path string, folder_ord int, ready boolean, message string")
    clock = iter(range(1_000_000, 3_000_000, 10))
    e = Engine(spark, str(tmp_path / "store"), folders, clock=lambda: float(next(clock)))
    e.build(str(docs))
    args = {"query": "pump", "folders": ["f1"]}
    e.search(**args)
    e.search(**args)
    key = e.log[0][0]
    cache = FixedCache(e, str(tmp_path / "fixed"), min_count=2, min_ms=0)
    assert cache.rebuild({key: args}) == [key]
    entry = cache.get(key, ["f1"])
    assert entry["result_count"] == 1 and entry["index_uuid"] == e.store.current() and cache.hits(entry).first().context == "...pump one..."
    assert cache.get(key, ["f2"]) is None and FixedCache(e, str(tmp_path / "fixed")).get(key, ["f1"])["path"] == entry["path"]
    assert replay(e, {key: args}) == [key]
    e.cache.clear()
    found = e.search(**args)  # not in memory any more: from the stored result, which goes into memory
    assert e.log[-1][6] and found.hits.inputFiles()[0].startswith("file://" + entry["path"]) and e.search(**args) is found and found.count() == 1
    e.build(str(docs))
    assert cache.get(key, ["f1"]) is None  # of another generation
    assert e.search(**args).count() == 1 and not e.log[-1][6]


def test_what_leaves_the_cache_is_let_go():
    gone = []
    cache = ResultCache(max_bytes=10, max_entries=2, on_drop=gone.append)
    assert cache.set("a", 1, 4) and cache.set("b", 2, 4) and cache.set("c", 3, 4) and gone == [1]
    assert not cache.set("d", 4, 1 << 30) and gone == [1]
    cache.clear()
    assert gone == [1, 2, 3] and len(cache) == cache.bytes == 0


def test_schedule():
    now = datetime(2025, 1, 1, 6, 0)
    assert next_run("05:30", now) == datetime(2025, 1, 2, 5, 30) and next_run("6h", now) == datetime(2025, 1, 1, 12) and next_run("x", now) is None
    ran, slept = [], []
    assert run_schedule("2h", lambda: ran.append(1), 2, now=lambda: now, sleep=slept.append) == 2 and slept == [7200.0, 7200.0]
    assert run_schedule("", lambda: ran.append(1)) == 0
