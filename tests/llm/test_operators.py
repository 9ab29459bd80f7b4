"""Each operator against brute force or planted cases, and on nulls, empty and long texts, ties, repeats and clashing names."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.llm import abuse, cohesion, leakage, lookalike, lookalike_op, mojibake, mojibake_op, nearcopies, packing, scans
from folioscan.llm.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"
CLASH = ["key", "k", "text_hash", "id", "count", "bucket", "mapped"]


def clashing(df):
    """Extra columns under names that the operators use themselves."""
    for c in CLASH:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("x"))
    return df


# 1


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, path string, norm_all string")


def test_near_pairs_against_brute_force(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    rows, n = [], 0
    for _ in range(25):
        base = [rng.choice(words) for _ in range(60)]
        for _ in range(rng.randint(1, 5)):
            text = list(base)
            for _ in range(rng.randint(0, 9)):
                text[rng.randrange(len(text))] = rng.choice(words)
            if rng.random() < 0.3:
                cut = rng.randrange(10, 50)
                text = text[cut:] + text[:cut]
            rows.append((n, f"/p{n % 40}", "".join(text)))
            n += 1
    rows += [rows[0], (n, "/other", rows[0][2]), (n + 1, rows[0][1], rows[0][2]), (n + 2, "/n", None), (n + 3, "/e", ""), (n + 4, "/s", "short")]
    got = {tuple(r) for r in nearcopies.near_pairs(clashing(pages(spark, rows)), "page_id", "path", "norm_all").collect()}
    real = [r for r in {*rows} if r[2] and len(r[2]) >= 200]
    want = {(a[0], b[0]) for a in real for b in real if a[0] < b[0] and a[1] != b[1] and nearcopies.jaccard(a[2], b[2]) >= 0.6}
    assert len(want) > 20 and got == want


def test_near_groups(spark):
    a = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(400))
    rows = [(1, "/a", a), (2, "/b", a + "tail of a page"), (3, "/c", a[40:] + "other"), (4, "/d", "x" * 150 + "".join(map(str, range(200)))), (4, "/d", "x" * 150 + "".join(map(str, range(200)))), (5, "/e", None), (6, "/f", "short"), (7, "/g", "short")]
    got = {r.page_id: r for r in nearcopies.groups(pages(spark, rows), "page_id", "path", "norm_all").collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7} and got[5].group_id is None and got[6].group_id == got[7].group_id and got[6].n_links == 0 and len({got[i].group_id for i in (1, 2, 3)}) == 1 and got[4].group_id != got[1].group_id and got[4].n_links == 0
    assert nearcopies.near_pairs(pages(spark, rows).limit(0), "page_id", "path", "norm_all").count() == 0


def test_very_many_versions_of_one_page(spark):
    """A hot group: every version shares codes with every other; the links are counted, not listed."""
    n = 800
    base = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(600))
    rows = [(i, f"/p{i}", base[: 5 * (i % 100)] + f"<{i}>" + base[5 * (i % 100) :]) for i in range(n)]
    df = spark.createDataFrame(rows, "page_id long, path string, norm_all string").repartition(8)
    got = nearcopies.groups(df, "page_id", "path", "norm_all").agg(F.countDistinct("group_id").alias("g"), F.min("n_links").alias("least"), F.max("n_links").alias("most"), F.count("*").alias("n")).first()
    assert (got.g, got.least, got.most, got.n) == (1, n - 1, n - 1, n)


def test_ball_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = rng.integers(0, 4, nearcopies.SYMBOLS).astype(np.uint8)
        b = a.copy()
        hit = rng.integers(0, nearcopies.SYMBOLS, rng.integers(0, 40))
        b[hit] = rng.integers(0, 4, len(hit))
        by_segment = (a != b).reshape(-1, nearcopies.SEGMENT).sum(1)
        assert bool(set(nearcopies.ball_keys(a)) & set(nearcopies.ball_keys(b))) == bool((by_segment <= 1).any())


def test_distance(spark):
    a = np.arange(nearcopies.SYMBOLS).astype(np.uint8)
    b = a.copy()
    b[[0, 7, 8, 59]] ^= np.array([1, 128, 255, 16], np.uint8)
    df = spark.createDataFrame([(nearcopies.packed(a), nearcopies.packed(b))], "x array<bigint>, y array<bigint>")
    words = lambda c: F.struct(*[F.col(c)[i].alias(f"s{i}") for i in range(nearcopies.WORDS)])
    assert df.select(words("x").alias("a"), words("y").alias("b")).select(nearcopies._distance("a", "b")).first()[0] == 4


# 2

BODY = "The pump in building C was inspected and the report was filed by the archive. "


def scan_rows():
    rows = []
    for f in range(12):
        for p in range(1, 5):
            body = "\n".join([f"Valve list {f}", BODY, "The meeting agreed that the scanner and the printer would be repaired.", BODY, f"-  {p} -" if p % 2 else f"{p}/4"])
            rows.append((f * 10 + p, f"/d/file{f}.PDF", str(p), body))
    return rows


def test_scan_noise(spark):
    rows = scan_rows()
    rows += [
        (900, "/d/x.pdf", "1", "Tbe pump in building C was insp-\nected and the rep0rt was filed by tbe archive.\nCode XY-\n1234 stays.\n"),
        (901, "/d/y.txt", "1", "insp-\nected\n3"), (902, "/d/z.pdf", "1", None), (903, "/d/w.pdf", "1", ""), (904, None, "1", "insp-\nected"), (904, None, "1", "insp-\nected"),
    ]
    df = spark.createDataFrame([*rows, rows[0]], "page_id long, path string, page_key string, raw string")
    got = {r.page_id: r for r in scans.repaired(clashing(df)).collect()}
    assert set(got) == {r[0] for r in scan_rows()} | {900, 903}
    assert got[1].noise == ["header", "page_number"] and got[900].noise == ["hyphen", "misread"] and got[903].noise == []
    assert got[900].text.startswith("The pump in building C was inspected and the report was filed by the archive.") and "XY-" in got[900].text
    assert scans.repaired(df.limit(0)).count() == 0


def context_rows():
    """Two invented words, one letter apart from what a scanner makes of either, each among words of its own."""
    rng = random.Random(8)
    sea = ["harbour", "vessel", "anchor", "tide", "sailor", "captain", "rope", "deck", "mast", "cargo", "wave", "pilot"]
    court = ["judge", "verdict", "appeal", "clerk", "witness", "statute", "counsel", "hearing", "claim", "ruling", "oath", "jury"]
    rows = []
    for i in range(400):
        about, word = (sea, "zubah") if i % 2 else (court, "zuhab")
        line = [rng.choice(about) for _ in range(40)]
        for j in range(5, 40, 9):
            line[j] = word
        rows.append((i, f"/d/f{i}.pdf", "1", " ".join(line)))
    mixed = lambda n, ws: (n, f"/d/f{n}.pdf", "1", " ".join([*ws[:6], "zuhah", *ws[6:]]))
    return [*rows, mixed(900, sea), mixed(901, court)]


def test_misread_words_by_context(spark):
    """What was read may mean either word: the words around it decide, and without them nothing is put right."""
    df = spark.createDataFrame(context_rows(), "page_id long, path string, page_key string, raw string")
    got = {r.page_id: r.text for r in scans.repaired(df).where("page_id >= 900").collect()}
    assert got[900].split()[6] == "zubah" and got[901].split()[6] == "zuhab"
    lex = scans.Lexicon([scans.bucket("zubah")], np.ones((1, scans.VECTOR), np.float32), [])
    assert scans.misread_words("qq zuhah ww", lex, {"zuhah": ["zubah"]}) == []


def test_all_frequent_words_judge(spark):
    """Whether a word fits its context is decided against every frequent word of its script, not against some of them."""
    rng = random.Random(3)
    latin, kana = [f"w{a}{b}o" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"], [a + b for a in "カキクケコサシスセソ" for b in "タチツテトナニヌネノ"]
    read = spark.createDataFrame([([*rng.sample(latin, len(latin)), *rng.sample(kana, len(kana)), "seldom"],) for _ in range(scans.RATIO - 1)] + [([*latin, *kana],)], "words array<string>")
    counts = read.select(F.explode("words").alias("word")).groupBy("word").count()
    lex = scans.vectors(read, counts)
    vector = lambda w: lex.vectors[lex.row[scans.bucket(w)]]
    around = ["wabo", "wqxo", "", "wkto", "カタ"]
    for words in (latin, kana):
        fits = np.stack([vector(w) for w in words]) @ lex.context(around, 2)
        for w, f in zip(words, fits, strict=True):
            if abs((share := (fits < f).mean()) - scans.RANK) > 2 / len(words):  # at the bound itself rounding decides
                assert (lex.chosen([w], around, 2) == w) == (share > scans.RANK)


def test_the_same_answer_in_a_larger_table(spark):
    """Ten times the pages, of other words: thresholds are absolute, so what a page gets doesn't change."""
    page = (900, "/d/x.pdf", "1", "The pnmp in building C was inspected.\nThe valve stands still.")
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("aeioklmrst") for _ in range(rng.randint(4, 8)))
    others = [word() for _ in range(3000)]
    more = [(2000 + i, f"/e/g{i}.pdf", "1", " ".join(rng.choice(others) for _ in range(200))) for i in range(400)]
    for rows in ([*scan_rows(), page], [*scan_rows(), page, *more]):
        got = {r.page_id: r for r in scans.repaired(spark.createDataFrame(rows, "page_id long, path string, page_key string, raw string")).where("page_id in (1, 900)").collect()}
        assert got[900].noise == ["misread"] and got[900].text.startswith("The pump in building C") and got[1].noise == ["header", "page_number"]


def test_long_words_are_looked_at():
    lex = scans.Lexicon([scans.bucket("gilt"), scans.bucket("Donaudampfschifffahrtsgesellschaftsvorsitzender")], np.stack([np.ones(scans.VECTOR), np.ones(scans.VECTOR) * 2 + np.arange(scans.VECTOR) % 2]).astype(np.float32), [])
    read = "Donaudampfschifffahrtsgese1lschaftsvorsitzender"
    assert len(read) > 40 and scans.tokens("es " + read) == ["es", read] and read.replace("1", "l") in scans.meant_forms(read)


@pytest.mark.parametrize("line,yes", [("― 24 ―", 1), ("- 3 -", 1), ("(9)", 1), ("[2]", 1), ("第3頁", 1), ("2ページ", 1), ("S. 5", 1), ("Page 4 of 4", 1), ("p. 1", 1), ("42/42", 1), ("iii", 1), (" —1—", 1), ("2019.", 0), ("3 units", 0), ("", 0), ("12に計上する。", 0)])
def test_page_numbers(line, yes):
    assert scans.is_page_number(line) is bool(yes)


def test_running_form():
    assert scans.running_form("KB8-66l Valve List 3") == scans.running_form("KB8-66l  Va1ve  Llst 12")
    assert scans.reflow("a\nb\n\n東\n京") == "a b\n\n東京"


# 3


@pytest.mark.parametrize("text", [None, "", "x" * 1800, "x" * 5000, "word " * 3000, "東京都は広い。" * 1500, ("One topic here. " * 60 + "\n\n" + "Another matter now. " * 60) * 3, "é" * 3000])
def test_pieces_hold_their_limits(text):
    cuts = cohesion.split(text)
    whole = text or ""
    assert cuts[0][0] == 0 and cuts[-1][1] == len(whole) and all(b - a <= cohesion.LIMIT for a, b in cuts)
    for (_, end), (start, _) in zip(cuts, cuts[1:], strict=False):
        assert abs(end - start - cohesion.OVERLAP) <= cohesion.SLACK + 1
    # exact round trip: the pieces without their overlaps are the text
    at, parts = 0, []
    for a, b in cuts:
        parts.append(whole[max(a, at) : b])
        at = b
    assert "".join(parts) == whole


def test_pieces_cut_between_topics():
    one, two = "The pump and the valve were repaired by the plumber. ", "Invoices and budgets were audited by the accountant. "
    text = one * 25 + two * 25
    assert abs(cohesion.split(text)[0][1] - len(one) * 25) <= 2


def test_pieces_frame(spark):
    df = spark.createDataFrame([(1, "p", "x\r\n" * 700), (1, "p", "x\r\n" * 700), (2, "q", None), (3, None, "short\r")], "page_id long, page string, raw string")
    rows = cohesion.pieces(clashing(df), "page_id", "page", "raw").collect()
    assert sorted((r.page_id, r.piece, r.n_pieces) for r in rows) == [(1, 1, 1), (2, 1, 1), (3, 1, 1)]
    assert cohesion.pieces(df.limit(0), "page_id", "page", "raw").count() == 0


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows_as_the_twin(name, spark):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW memory_pages AS SELECT * FROM '{DATA}/memory_pages.parquet'")
    got = queries()[name](spark, DATA)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(c.execute(f"SELECT {', '.join(got.columns)} FROM ({oracle_sql()[name]})").fetchall(), key=str)


# 4

SOUND = ["À 651 °C, il a fallu arrêter la pompe.", "蓼辺さんと楡浦さんが稟議書を扱う。", "20 µm ± 0,2 Ã", "Für die Prüfung fielen 5 € an – „gut“, 20 µm ± 0,2 Ångström.", "契約書の写しを3部用意し、東門に備え付ける。", "São Lumé, Ødeland, Âge, Île", "Привет, пример текста", "縺 繧 荳 譁（異体字の確認）", "ｺﾝﾌﾟﾚｯｻ ﾎﾞｲﾗ ﾃﾝｹﾝ", "┌──┬──┐ │甲│乙│ └──┴──┘", "貯蔵ﾀﾝｸ区画の減速機を止める。", "а nеw lеttеr", None, "", "plain & simple"]
WRONG = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp932"), ("utf-8", "cp437"), ("cp932", "latin-1"), ("euc_jp", "latin-1"), ("cp1252", "cp437"), ("utf-8", "mac_roman"), ("utf-8", "cp1251")]


@pytest.mark.parametrize("text", SOUND)
def test_sound_text_is_left_alone(text):
    assert mojibake.restore(text) == (text, False, False)


@pytest.mark.parametrize("true,wrong", WRONG)
def test_round_trip(true, wrong):
    restored = tried = 0
    for text in ("契約書の写しを三部用意し、試作棟に備え付ける。", "Für die Prüfung wurde das Gerät geöffnet.", "L’équipe a été prévenue à l’étage."):
        try:
            bad = text.encode(true).decode(wrong)
        except UnicodeError:
            continue
        fixed, garbled, _ = mojibake.restore(bad)
        tried += 1
        assert garbled
        restored += fixed == text
    assert tried == 0 or restored == tried


@pytest.mark.parametrize("writer", mojibake.TRUE_WRITERS)
@pytest.mark.parametrize("reader", mojibake.WRONG_READERS)
def test_every_reader_and_writer(reader, writer):
    """Of the lines whose bytes the wrong reader takes and changes, nine in ten are found."""
    lines = [
        "契約書の写しを三部用意し、試作棟に備え付ける。", "点検表の番号が一致しないので、担当が順番に調べた。", "別紙に示す廃棄物は二回にわたり再測定した。", "来期の予算は見直しが要る。", "保管棚と図面の写しを北棟へ移す。",
        "Für die Prüfung wurde das Gerät geöffnet.", "Über die Maßnahme wird später entschieden, wäre sie nötig.", "Die Außenlager schließen früher.", "L’équipe a été prévenue à l’étage.", "Le réducteur était déjà arrêté.", "La boîte à clés n’a pas été remplacée.", "Les pièces coûtent 5 €, livrées à l’entrepôt.",
    ]
    tried = found = 0
    for text in lines:
        try:
            bad = text.encode(writer).decode(reader)
        except UnicodeError:
            continue
        if bad != text:
            tried += 1
            found += mojibake.restore(bad)[1]
    assert found >= 0.9 * tried - (tried < 10)


@pytest.mark.parametrize("bad,good", [("The panel costs Ђ68,679 and ú5.", "The panel costs €68,679 and £5."), ("Es wurde geprĂĽft und wĂ¤re zulĂ¤ssig.", "Es wurde geprüft und wäre zulässig."), ("It rose to 704 Â°C.", "It rose to 704 °C."), ("It showed 35 ｵm of wear.", "It showed 35 µm of wear."), ("he noted: ìthe list is here.î", "he noted: “the list is here.”")])
def test_signs_misread(bad, good):
    fixed, garbled, lost, how = mojibake.traced(bad)
    assert garbled and not lost and how == "search" and (fixed == good or "ú" in bad)


def test_how_it_was_found():
    assert mojibake.traced("Es ist zul‰ssig, sie w‰ren da.")[3] in ("letters", "search") and mojibake.traced("lost \ufffd mark")[3] == "marks" and mojibake.traced("fine")[3] is None and mojibake.traced(None) == (None, False, False, None)


def test_partly_garbled_and_lost(spark):
    df = spark.createDataFrame([(1, "The price is Â£5 and â‚¬7."), (1, "The price is Â£5 and â‚¬7."), (2, "lost � mark"), (3, None), (4, ""), (5, "fine"), (6, "a" * 200_000 + "\nÃ©tÃ©")], "page_id long, raw string")
    got = {r.page_id: (r.restored, r.lost) for r in mojibake_op.garbled(clashing(df), "page_id", "raw").collect()}
    assert set(got) == {1, 2, 6} and got[1] == ("The price is £5 and €7.", False) and got[2][1] and got[6][0].endswith("été")
    assert mojibake_op.garbled(df.limit(0), "page_id", "raw").count() == 0 and mojibake_op.restored(df, "page_id", "raw").count() == 7


@pytest.mark.parametrize("bad,good", [("Es ist zul‰ssig, sie w‰ren da.", "Es ist zulässig, sie wären da."), ("Die F÷rdertechnik steht.", "Die Fördertechnik steht."), ("Les clΘs sont là.", "Les clés sont là."), ("un mot franτais", "un mot français"), ("une boεte", "une boîte"), ("Das Auﬂenlager ist groﬂ.", "Das Außenlager ist groß."), ("La zone prÈvue", "La zone prévue"), ("des Lьfters", "des Lüfters")])
def test_single_letters_misread(bad, good):
    assert mojibake.restore(bad) == (good, True, False)
    assert mojibake.restore("Sound first line.\n" + bad)[0] == "Sound first line.\n" + good


@pytest.mark.parametrize("text", ["Die Auﬂage und die Oberﬂäche", "5 m³h und 3 kΩm", "mot‡ 5‰ 3÷4", "σmax, τmax und ΔT", "l’…été « là »", "pαge"])
def test_right_signs_beside_letters(text):
    assert mojibake.restore(text) == (text, False, False)


# 5


def test_look_alikes(spark):
    rows = [(1, "Rird asked the ﬁne\nsensor - now"), (2, "Ｒｉｒｄ asked the fine\nsensor ‐ now"), (3, "Rіrd as​ked the fine\nsensor - now"), (4, "rird asked the fine\nsensor - now"), (5, "Rird asked the fine sensor - now"), (6, "ガス"), (7, "ｶﾞｽ"), (8, "ガス"), (9, "カス"), (10, None), (11, ""), (12, ""), (1, "Rird asked the ﬁne\nsensor - now"), (13, "é"), (14, "é"), (15, "e")]
    df = spark.createDataFrame(rows, "page_id long, raw string")
    got = {tuple(r) for r in lookalike_op.look_alikes(clashing(df), "page_id", "raw").collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (6, 7), (6, 8), (7, 8), (13, 14)}
    real = [r for r in {*rows} if r[1] is not None]
    assert got == {(a[0], b[0]) for a in real for b in real if a[0] < b[0] and a[1] != b[1] and lookalike.skeleton(a[1]) == lookalike.skeleton(b[1])}
    forms = {r.page_id: r.form for r in lookalike_op.members(df, "page_id", "raw").collect()}
    assert forms[2] == forms[3] == "Rird asked the fine\nsensor - now" and forms[11] == "" and 10 not in forms
    assert lookalike_op.look_alikes(df.limit(0), "page_id", "raw").count() == 0
    # texts of the same letters: a control that the collation passes over makes no difference, signs and blanks do
    more = spark.createDataFrame([(1, "ab-c"), (2, "ab\x00-c"), (3, "ab c"), (4, "a b-c"), (5, "ＡＢ"), (6, "AB"), (7, "")], "page_id long, raw string")
    assert {tuple(r) for r in lookalike_op.look_alikes(more, "page_id", "raw").collect()} == {(1, 2), (5, 6)}
    whole, short = ({r.page_id: r.class_hash for r in f(more, "page_id", "raw").collect()} for f in (lookalike_op.members, lookalike_op.classes))
    assert whole == short and len(set(whole.values())) == 5


# 6


def test_packing(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["pump", "valve", "scanner"]) for _ in range(rng.randint(1, 900)))) for i in range(300)] + [(900, None), (901, ""), (902, "word " * 9000), (0, "again")]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.containers(clashing(df), "doc_id", "text").collect()
    per = {}
    for r in got:
        s = per.setdefault(r.container, [0, 0, 0])
        s[0], s[1], s[2] = s[0] + r.tokens, s[1] + r.segments, s[2] + r.loss
    assert all(s[0] <= packing.CAPACITY and s[1] <= packing.MAX_SEGMENTS and s[2] <= packing.MAX_LOSS for s in per.values())
    enc = packing.encoder(packing.TOKENIZER)
    assert sum(s[0] for s in per.values()) == sum(len(enc.encode_ordinary(t)) for _, t in {*rows} if t)
    parts = {}
    for r in got:
        parts.setdefault(r.doc_id, []).append(r.tokens)
    assert all(len(v) == 1 for k, v in parts.items() if k not in (0, 902)) and sorted(parts[902])[-1] == packing.CAPACITY and parts[900] == [0]
    assert packing.fill(packing.containers(df, "doc_id", "text")).first().used > 0.97
    assert packing.containers(df.limit(0), "doc_id", "text").count() == 0
    with pytest.raises(ValueError):
        packing.containers(df, "doc_id", "text", max_loss=0)


def test_packing_under_a_binding_loss_limit(spark):
    rng = random.Random(4)
    rows = [(i, "question one two three\n" * (i % 2) + " ".join(rng.choice(["pump", "valve", "scanner"]) for _ in range(rng.randint(1, 700)))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.containers(df, "doc_id", "text", max_loss=500, max_segments=3).collect()
    per, whole = {}, {}
    for r in got:
        s = per.setdefault(r.container, [0, 0, 0])
        s[0], s[1], s[2] = s[0] + r.tokens, s[1] + r.segments, s[2] + r.loss
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.tokens
    enc = packing.encoder(packing.TOKENIZER)
    assert all(s[0] <= packing.CAPACITY and s[1] <= 3 and s[2] <= 500 for s in per.values()) and max(s[2] for s in per.values()) > 490 and max(s[1] for s in per.values()) == 3
    assert whole == {k: len(enc.encode_ordinary(t)) for k, t in rows} and any(r.part for r in got)


def test_packing_keeps_different_texts_of_one_key(spark):
    df = spark.createDataFrame([(1, "pump valve"), (1, "valve pump"), (1, "pump valve"), (None, "pump"), (None, "valve")], "doc_id long, text string")
    assert packing.containers(df, "doc_id", "text").count() == 4


def test_packing_many_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ITEMS", 7)
    monkeypatch.setattr(packing, "GROUPS_A_TASK", 3)
    df = spark.createDataFrame([(i, "pump " * (i % 90)) for i in range(900)], "doc_id long, text string")
    got = packing.containers(df, "doc_id", "text").collect()
    assert sorted(r.doc_id for r in got) == list(range(900)) and len({r.container.split("-")[0] for r in got}) > 100


@pytest.mark.parametrize("n,prompt,parts", [(0, 0, [(0, 0)]), (10, 0, [(8, 8), (2, 2)]), (25, 4, [(10, 6), (8, 8), (7, 7)]), (30, 25, [(10, 0), (10, 0), (10, 5)])])
def test_cuts(n, prompt, parts):
    assert list(packing.cuts(n, prompt, 10, 8)) == parts


def test_pack_respects_every_limit():
    rng = np.random.default_rng(2)
    v = np.stack([rng.integers(1, 100, 500), np.ones(500), rng.integers(0, 60, 500)], 1).astype(float)
    out = packing.pack(v, (100, 4, 60))
    for c in set(out.tolist()):
        assert (v[out == c].sum(0) <= (100, 4, 60)).all()
    assert len(packing.pack(np.zeros((0, 3)), (1, 1, 1))) == 0


# 7


def brute_leak(text, part, need):
    a, b = leakage.fold(text or ""), leakage.fold(part or "")
    return any(b[i : i + need] in a for i in range(len(b) - need + 1))


def test_leaks_against_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 8)))
    items = [(i, "en", " ".join(word() for _ in range(14)), " ".join(word() for _ in range(40)), None) for i in range(8)] + [(50, "ja", "東京都の保管棚は何階にあり、いつ開くか。番号を答えよ。", "棚は三階にあり、九時に開く。番号は四千二である。毎朝ひとりが確かめる。", "x"), (51, "en", None, "", None), (50, "ja", "東京都の保管棚は何階にあり、いつ開くか。番号を答えよ。", "棚は三階にあり、九時に開く。番号は四千二である。毎朝ひとりが確かめる。", "x")]
    docs = [(0, None), (1, ""), (2, "nothing here"), (3, "序 東京都の　保管棚は何階にあり\nいつ開くか番号を答えよ 終")]
    for n in range(4, 90):
        it = rng.choice(items[:8])
        source = rng.choice([it[2], it[3]])
        a = rng.randrange(0, len(source))
        part = source[a : a + rng.randint(20, 110)]
        if rng.random() < 0.5:
            part = part.upper().replace(" ", rng.choice([" -\n", "　", "..."]))
        if rng.random() < 0.3:
            part = "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in part)
        docs.append((n, word() + " " + part + " " + word()))
    docs.append((200, word() * 20_000 + items[0][3]))
    d = spark.createDataFrame([*docs, docs[5]], "doc_id long, text string")
    e = spark.createDataFrame(items, "item_id long, lang string, question string, passage string, answer string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(clashing(d), e).collect()}
    want = {(k, i[0]) for k, t in docs for i in items if brute_leak(t, i[2], 24 if i[1] == "ja" else 48) or brute_leak(t, i[3], 24 if i[1] == "ja" else 48)}
    assert len(want) > 10 and got == want
    assert leakage.leaks(d, e.limit(0)).count() == 0 and leakage.leaks(d.limit(0), e).count() == 0


def test_leak_offsets():
    items = leakage.Items([(1, "en", "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", None)])
    text = "intro: ALPHA-beta gamma  delta\nepsilon zeta eta theta iota kappa lambda."
    (hit,) = items.scan(text)
    assert text[hit[2] : hit[3]] == text[7:-1] and hit[4] == len(leakage.fold(text[7:-1]))


# 8


def rated():
    good = ["The pump in building C was inspected on Monday.", "契約書の写しを三部用意し、東門に備え付ける。", "Die Rechnung wurde gestern geprüft.", "La facture a été vérifiée hier.", "The report on threats against women calls for better protection."]
    bad = ["You are a useless idiot, get lost.", "お前は本当に役立たずのクズだ、消えろ。", "Du bist ein dummes Arschloch.", "Ferme ta gueule, sale con.", "Women are too stupid and should be locked up."]
    rng = random.Random(5)
    out = []
    for i in range(240):
        text = [rng.choice(good) + f" Item {i}." for _ in range(3)]
        if i % 6 == 0:
            text.insert(1, rng.choice(bad))
        out.append(("\n\n".join(text), float(i % 6 == 0) if i % 25 else float(i % 6 != 0)))
    return out


@pytest.fixture(scope="module")
def model():
    return abuse.train(rated())


def test_held_out_accuracy(model):
    bad = ["Nobody asked you, you stupid idiot.", "Y.o.u are an i.d.i.o.t and a useless b1tch.", "このクズ、さっさと消え​ろ。", "Halt die Fresse, du Ａｒｓｃｈｌｏｃｈ.", "Ferme ta gueule, pauvre con."]
    good = ["The valve in building D was replaced on Friday.", "図面の写しを二部用意する。", "Das Ventil wurde heute gewechselt.", "La pompe a été changée.", "Kill the parent process before the child processes.", "", None]
    assert [model.score(t) >= abuse.THRESHOLD for t in bad] == [True] * len(bad)
    assert [model.score(t) >= abuse.THRESHOLD for t in good] == [False] * len(good)


def test_short_sentences_and_trailing_digits(model):
    assert abuse.sentences("図面を見る。死ね。黙れ。殺すぞ。あ。\n\n--\n\n12") == ["図面を見る", "死ね", "黙れ", "殺すぞ"]
    assert model.score("図面の写しを二部用意する。死ね。") == max(map(model.score, ("図面の写しを二部用意する。", "死ね。"))) >= abuse.THRESHOLD
    assert [abuse.plain(w) for w in ("salop3", "merd3", "shi7", "b1tch", "1diot", "12 34")] == ["salope", "merde", "shit", "bitch", "idiot", "12 34"]


def test_groups_alone_carry_no_weight(model):
    scores = [model.score(f"{g.capitalize()} work in the archive on Monday.") for g in abuse.GROUPS["en"]]
    assert max(scores) < abuse.THRESHOLD


def test_wording_that_ratings_agree_on():
    """Abuse without a known word counts by the ratings of all documents that hold its wording; one erring rating of a common wording doesn't."""
    veiled, common = "{} would be missed by none were the river to keep that one.", "The crane rail beside {} hangs a hand too low."
    plain = rated()
    more = [(f"{t}\n\n{(veiled if i < 4 else common).format(n)}", 1.0 if i < 5 else 0.0) for i, ((t, _), n) in enumerate(zip((r for r in plain if r[1] == 0), "Adler Brandt Conrad Dietz Ebert Falk Gerber Hahn Iffland Jung Keller Lorenz".split(), strict=False))]
    model = abuse.train(sorted(plain + more))
    assert model.score(veiled.format("Moser")) >= abuse.THRESHOLD > model.score(common.format("Moser"))


def test_error_of_ratings():
    assert abuse.rating_error([(0.0, 2)] * 900 + [(1.0, 2)] * 40 + [(0.5, 2)] * 60) == pytest.approx(0.0312, abs=0.001)
    assert 0 < abuse.rating_error([]) < abuse.rating_error([(0.5, 2)] * 50) < 0.5


def test_scores_frame(spark):
    docs = [(i, t, "src") for i, (t, _) in enumerate(rated())] + [(900, None, None), (901, "", "src"), (902, "fine " * 50_000, "src")]
    labels = [(i, "r1", int(r), None, None) for i, (_, r) in enumerate(rated())] + [(1, "r2", None, None, None), (None, "r", 1, None, None)]
    d = spark.createDataFrame([*docs, docs[0]], "doc_id long, text string, source string")
    lab = spark.createDataFrame(labels, "doc_id long, rater string, abusive int, note string, labelled_at timestamp")
    got = abuse.scores(clashing(d), lab).collect()
    assert len(got) == len(docs) + 1 and {r.doc_id: r.score for r in got}[900] == 0.0
    assert abuse.scores(d, lab.limit(0)).count() == len(docs) + 1 and abuse.scores(d.limit(0), lab).count() == 0


# all


@pytest.mark.parametrize("name", sorted(queries()))
def test_runs_whole(name, spark):
    assert queries()[name](spark, DATA).count() > 0
