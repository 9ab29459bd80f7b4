from pyspark.sql import functions as F

from folioscan.functions import ids, timing
from folioscan.operators import results, workload
from folioscan.schema import HISTORY
from folioscan.streaming import batches


def test_cache():
    c = workload.ResultCache(max_bytes=10, max_entries=2, max_item=8)
    assert not c.set("big", 1, 9) and c.set("a", 1, 4) and c.set("b", 2, 4)
    assert c.get("a") == 1 and c.set("c", 3, 4)
    assert c.get("b") is None and len(c) == 2 and c.bytes == 8
    c.set("a", 5, 1)
    assert c.bytes == 5 and c.pop("a") == 5 and c.pop("zz") is None
    c.clear()
    assert c.bytes == 0


def test_presence_table():
    p = workload.Presence(ttl_sec=10, max_clients=2)
    assert p.beat("a", 0) == 1 and p.beat("b", 1) == 2 and p.beat("c", 2) == 2
    assert p.beat("a", 5) == 2 and p.count(11) == 2 and p.count(12) == 1 and p.beat(None, 12) == 1


def test_presence_against_brute_force(spark):
    import random

    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([rng.uniform(0, 40_000), float(rng.randrange(0, 40)) * 900, None])) for _ in range(400)]
    df = spark.createDataFrame(rows, "client_id string, ts double")
    ms = [(c, int(t * 1000 // 1)) for c, t in rows if c is not None and t is not None]
    want = {t: len({c for c, u in ms if t - 900_000 <= u <= t}) for _, t in ms}
    assert {r.ts_ms: r.n_active for r in workload.presence(df, 900).collect()} == want
    assert workload.presence(df.limit(0), 900).count() == 0


def test_stream_presence(spark, tmp_path):
    spark.createDataFrame([("a", 1.0), ("b", 5.0), ("a", 20.0), (None, 3.0)], "client_id string, ts double").coalesce(1).write.parquet(str(tmp_path / "beats"))
    table = workload.Presence(ttl_sec=30)
    batches.feed_presence(batches.source(spark, str(tmp_path / "beats")), table, str(tmp_path / "place"))
    assert table.seen == {"b": 5.0, "a": 20.0}
    assert {r.client_id for r in batches.last_seen(spark, str(tmp_path / "beats"), 10).collect()} == {"a"}


def test_admission(spark):
    log = "query_key string, query_text string, search_mode string, hits long, payload_kb double, elapsed_ms double, cached boolean, ts double"
    rows = [("few", "q", "AND", 9000, 1.0, 900.0, False, 100.0)] * 9
    rows += [("time", "q", "AND", 1, 1.0, 600.0, False, 100.0)] * 10 + [("hits", "q", "AND", 6000, 1.0, 1.0, False, 100.0)] * 10 + [("size", "q", "AND", 1, 3000.0, None, True, 100.0)] * 10
    rows += [("light", "q", "AND", 1, 1.0, 1.0, False, 100.0)] * 10 + [("old", "q", "AND", 6000, 1.0, 900.0, False, -1e6)] * 10
    stats = workload.query_stats(spark.createDataFrame(rows, log))
    kept = workload.heavy(stats, F.lit(200.0))
    assert {r.query_key for r in kept.collect()} == {"time", "hits", "size"}
    assert [r.query_key for r in workload.ranked(kept, 2).collect()] == ["hits", "time"]


def test_history(spark):
    rows = [("a", "q", "AND", 0, "jp", None, ["x", "y"], 1, False), ("b", "q", "AND", 0, "jp", "exact", ["y", "x"], 2, False), ("p", "q", "AND", 0, "jp", "exact", ["x"], 0, True), ("r", "q", "AND", 0, "jp", "exact", ["x"], 0, True)]
    rows += [(f"n{i}", f"w{i}", "OR", 0, "jp", None, [], 10 + i, False) for i in range(31)]
    got = {r.id for r in results.history_kept(spark.createDataFrame(rows, HISTORY), 30).collect()}
    assert got == {"p", "r"} | {f"n{i}" for i in range(1, 31)}


def test_small_functions():
    assert timing.schedule("6h") == ("interval", 6, 0) == timing.schedule("6") and timing.schedule("05:30") == ("time", 5, 30)
    assert timing.schedule("25:00") == ("", 0, 0) == timing.schedule(None)
    assert timing.to_int("12", 3) == 12 and timing.to_int("-1", 3) == 3 and timing.to_int("0", 3, 1) == 3 and timing.to_float("x", 1.5) == 1.5 and timing.to_bool("yes", False) and timing.to_bool("", True)
    assert ids.cache_key("a  b", "AND", 0, "jp", "exact", ["y", "x"]) == ids.cache_key(" a b ", "AND", 0, "jp", "exact", ["x", "y"])
    hits = []
    c = workload.Cooldown(10, clock=iter([0.0, 5.0, 20.0]).__next__)
    assert c.run(lambda: hits.append(1)) and not c.run(lambda: hits.append(2)) and c.run(lambda: hits.append(3)) and hits == [1, 3]


def test_full_hash_policy(spark):
    df = spark.createDataFrame([("/mnt/a.txt",), ("/home/a.PDF",), ("/home/a.txt",)], "p string")
    assert [r[0] for r in df.select(timing.wants_full_hash(F.col("p"), (), (".pdf",))).collect()] == [True, True, False]


def test_stale_ids(spark):
    df = spark.createDataFrame([(["a", "x", "b"],), ([],), (None,)], "folders array<string>")
    got = lambda known: [r[0] for r in df.select(workload.stale_ids(F.col("folders"), known)).collect()]
    assert got(["b", "a"]) == [["a", "b"], [], None] and got([]) == [[], [], None]
