"""Problem 2: text of scanned pages made continuous and readable.

Words of all scanned pages train skip-gram vectors.  A rare word that a
plausible glyph edit turns into a far more frequent one is linked to it; of the
words it may mean the one whose vector fits those around it best is taken, and
none where none fits better than any frequent word would.  After that the
running lines and page numbers are taken out and the lines flow into paragraphs.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.ml.feature import Word2Vec
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.operators.arrow import flat_map
from folioscan.operators.checkpoints import ensure_checkpoint_dir

# Fixed values: (read, meant) of Latin letters that a scanner takes for others.
LATIN_EDITS = [
    ("c", "e"), ("e", "c"), ("5", "s"), ("5", "S"), ("l", "i"), ("i", "l"), ("1", "l"), ("l", "1"), ("1", "i"), ("I", "l"), ("0", "o"), ("0", "O"), ("b", "h"), ("h", "b"), ("9", "g"), ("q", "g"), ("8", "B"), ("6", "b"), ("2", "z"),
    ("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("h", "li"), ("ii", "u"), ("u", "ii"), ("n", "u"), ("u", "n"), ("f", "t"), ("t", "f"), ("o", "c"), ("ri", "n"), ("nn", "m"),
]
# Japanese characters of similar shape; any of a group may be read for another.
CJK_ALIKE = (
    "書害 査杳 検険 間問聞 日曰目 末未 土士 千干于 工エ 力カ 口ロ ト卜 タ夕 一ー 二ニ 八ハ 三ミ めぬ れねわ るろ さき ちら 人入 大犬太 己已巳 石右 輪輸 微徴 綱網 待侍持 設没 料科 名各 田由申甲 貝見 埋理 項頂 全金 来未 管菅 遣遺 "
    "適摘 復複 績積 季李 氷永 陣陳 候侯 粉紛 仕任 便使 休体 注往住 施旅 記紀 技枝 治冶 ソン シツ クタ コユ ノメ 王玉主 水木 月用 丁了 刀力 午牛 矢失 天夫 手毛 天夭 巨臣 宮官 鳥烏 師帥 壁璧 幣弊 徐除 因困 固因 間閒 部郎 受愛 方万 はほけ"
).split()

LEAST_COUNT = 5  # a word that occurs less often counts as unseen, whatever the size of the input
RATIO = 30  # a word is rare against another that occurs this many times as often, and at least so many times
LONGEST = 200  # no plain word is longer: what is isn't looked up
BUCKETS = 1 << 18  # words share this many vectors by their hash, so that neither memory nor who has a vector depends on the size of the input
VECTOR, WINDOW, EPOCHS = 24, 5, 2
LEAST_TRAINED = 400_000  # words that an epoch goes over at least: a small input is gone over again and again
PART_WORDS = 150_000  # words that one task trains on; the tasks' vectors are averaged
NEAR, FAR = 3, 8  # neighbours on each side that a context is made of; the farther ones, then the page, where no nearer one is known
RANK = 0.45  # a link is used only where its word's cosine with the context beats that of this share of the judges, all frequent words of its script

_LINE = re.compile("\r\n|\r|\n")
_CID = re.compile(r"\(cid:\d+\)")
_NUM = "[0-9０-９]{1,4}|[ivxlIVX]{1,6}"
PAGE_NUMBER = re.compile(
    rf"\s*(?:[-‐‑–—―−~・(\[（［【<«]*\s*(?:{_NUM})\s*[-‐‑–—―−~・)\]）］】>»]*|(?:[0-9０-９]{{1,4}})\s*[/／]\s*(?:[0-9０-９]{{1,4}})"
    r"|(?:S\.|S|p\.|pp\.|P\.|p|Page|page|PAGE|Seite|Blatt|Pg\.|No\.|頁)\s*[0-9０-９lIO]{1,4}(?:\s*(?:of|von|sur|de|/)\s*[0-9０-９lIO]{1,4})?"
    r"|第?\s*[0-9０-９]{1,4}\s*(?:頁|ページ|ぺージ|ペ一ジ|ペ－ジ)(?:\s*[/／]\s*[0-9０-９]{1,4}\s*(?:頁|ページ)?)?)\s*"
)
_CUT = re.compile("([^\\W\\d_]+)([-‐‑¬­])[ \t ]*(?:\r\n|\r|\n)[ \t]*([^\\W\\d_]+)")
_TOKEN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿœŒ0-9]*[A-Za-zÀ-ÖØ-öø-ÿœŒ][A-Za-zÀ-ÖØ-öø-ÿœŒ0-9]*|[一-鿿々ァ-ヶー]+|[ぁ-ん]+")
_CODE = re.compile(r"[A-Z#]|[0-9]{2}")
_CJK = re.compile("[　-ヿ㐀-鿿＀-￯]")
_INNER_DIGIT = re.compile("[A-Za-zà-ÿ][a-zà-ÿ]*[0159][a-zà-ÿ]+$|[A-Za-zÀ-ÿ]?[a-zà-ÿ]{2,}[0159][a-zà-ÿ]*$")


def lines_of(raw: str) -> list[str]:
    return _LINE.split(raw)


def margin_lines(lines: list[str]) -> list[int]:
    """Numbers of the first two and the last two lines."""
    n = len(lines)
    return sorted({i for i in (0, 1, n - 2, n - 1) if 0 <= i < n})


def is_page_number(line: str) -> bool:
    return bool(PAGE_NUMBER.fullmatch(line)) and bool(line.strip())


@functools.lru_cache(maxsize=1)
def _shape_table() -> dict[int, str | None]:
    """Every character of a group of similar shapes -> the group's first."""
    out: dict[int, str | None] = {}
    for group in ["ecoCO0", "s5S", "il1I|Lt", "hb6", "g9q", *CJK_ALIKE]:
        first = out.get(ord(group[0])) or group[0]
        for ch in group:
            out.setdefault(ord(ch), first)
    return out


_DIGITS = re.compile("(?<![a-z0-9])[0-9]+(?![a-z0-9])", re.IGNORECASE)
# What stands for two characters in a misreading, written as those two.
_PAIRS = (("h", "ii"), ("u", "ii"), ("m", "rn"), ("d", "ei"), ("w", "vv"))
_BLANK = re.compile("[\\s　]+")


def running_form(line: str) -> str:
    """The line but for numbers, spacing and misreadings."""
    line = _DIGITS.sub("", unicodedata.normalize("NFKC", _CID.sub("", line)))
    line = _BLANK.sub("", line).casefold().translate(_shape_table())
    for one, two in _PAIRS:
        line = line.replace(one, two)
    return line


def header_candidates(raw: str) -> set[str]:
    lines = lines_of(raw)
    out = set()
    for i in margin_lines(lines):
        if not is_page_number(lines[i]):
            form = running_form(lines[i])
            if len(form) >= 3:
                out.add(form)
    return out


def joined(raw: str) -> str:
    """Cut words put together, and lines of Japanese text too: what the tokens are read from."""
    text = _CID.sub("", raw)
    text = _CUT.sub(lambda m: m[1] + m[3] if not m[3][0].isupper() else m[0], text)
    return re.sub("(?<=[぀-ヿ㐀-鿿])(?:\r\n|\r|\n)(?=[぀-ヿ㐀-鿿])", "", text)


def tokens(text: str) -> list[str]:
    return [w for w in _TOKEN.findall(text) if len(w) <= LONGEST]


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


def _script(word: str) -> bool:
    return word[0] < "ɐ"


@functools.lru_cache(maxsize=1)
def _edits() -> dict[str, list[tuple[str, str]]]:
    out: dict[str, list[tuple[str, str]]] = {}
    for read, meant in LATIN_EDITS:
        out.setdefault(read[0], []).append((read, meant))
    for group in CJK_ALIKE:
        for read in group:
            out.setdefault(read, []).extend((read, meant) for meant in group if meant != read)
    return out


def meant_forms(word: str) -> set[str]:
    """Every word that one glyph edit, or the same one throughout, makes of it."""
    table, out = _edits(), set()
    for i, ch in enumerate(word):
        for read, meant in table.get(ch, ()):
            if word.startswith(read, i):
                out.add(word[:i] + meant + word[i + len(read) :])
                if word.count(read) > 1:
                    out.add(word.replace(read, meant))
    out.discard(word)
    return out


class Lexicon:
    """Skip-gram vectors of words by bucket, turned about their mean, and the judges of each script."""

    def __init__(self, numbers: list[int], vectors: np.ndarray, judges: list[tuple[int, int, int]]):
        """*judges*: (bucket, its frequent Latin words, its other frequent words)."""
        self.row = np.full(BUCKETS, -1, np.int32)
        self.row[numbers] = np.arange(len(numbers), dtype=np.int32)
        centred = vectors - vectors.mean(axis=0) if len(numbers) else vectors
        self.vectors = centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-9)
        of = np.array(judges, np.int64).reshape(-1, 3)
        of = of[self.row[of[:, 0]] >= 0]
        # words of a bucket share its vector and count by their number
        self.judges = {latin: (self.vectors[self.row[at[:, 0]]], at[:, 1 if latin else 2]) for latin in (True, False) for at in (of[of[:, 1 if latin else 2] > 0],)}

    def context(self, words: list[str], i: int) -> np.ndarray | None:
        """The direction of the words around; of farther ones, at last of the whole page, where no nearer one is known."""
        for reach in (NEAR, FAR, len(words)):
            rows = [r for j in range(max(0, i - reach), min(len(words), i + reach + 1)) if j != i and (r := self.row[bucket(words[j])]) >= 0]
            if rows:
                total = self.vectors[rows].sum(axis=0)
                return total / max(np.linalg.norm(total), 1e-9)
        return None

    def chosen(self, targets: list[str], words: list[str], i: int) -> str | None:
        """Of the words that may be meant the one that fits the context best; none where none fits or there is no context."""
        at = [(t, r) for t in targets if (r := self.row[bucket(t)]) >= 0]
        around = self.context(words, i) if at else None
        if around is None:
            return None
        fit, best = max((float(self.vectors[r] @ around), t) for t, r in at)
        judges, n = self.judges[_script(best)]
        return best if n[judges @ around < fit].sum() >= RANK * n.sum() else None


def misread_words(text: str, lex: Lexicon, links: dict[str, list[str]]) -> list[tuple[int, int, str, str]]:
    """(start, end, read, meant) of the words of *text* that links and context put right."""
    spans = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text) if m.end() - m.start() <= LONGEST]
    words = [s[2] for s in spans]
    out = []
    for i, (a, b, w) in enumerate(spans):
        if w not in links or (w.isascii() and (not w.islower() and not w.istitle() and not _INNER_DIGIT.match(w))):
            continue
        if (a and text[a - 1] in "=+_") or (b < len(text) and text[b] in "=+_"):
            continue  # no word
        if (a and text[a - 1] in "-/#.") or (b < len(text) and text[b] in "/#"):
            if any(c.isdigit() for c in w) or _CODE.search(w):
                continue  # part of a code
        if len(w) <= 4 and w.istitle() and i + 1 < len(words) and words[i + 1].istitle() and text[b : b + 1] == " ":
            continue  # a first name, rather
        if found := lex.chosen(links[w], words, i):
            out.append((a, b, w, found))
    return out


_HYPHENATED = re.compile("[^\\W\\d_]+[-‐‑][^\\W\\d_]+")


def parted(raw: str, headers: set[str]) -> tuple[str, str, set[str]]:
    """(the page without its running lines and page numbers, those lines, what was wrong)."""
    noise: set[str] = set()
    lines = lines_of(raw)
    drop = set()
    for i in margin_lines(lines):
        if is_page_number(lines[i]):
            noise.add("page_number")
            drop.add(i)
        elif headers and running_form(lines[i]) in headers:
            noise.add("header")
            drop.add(i)
    body = "\n".join(_CID.sub("", x) for i, x in enumerate(lines) if i not in drop)
    return body, _CID.sub("", "\n".join(lines[i] for i in sorted(drop))), noise


def uncut(body: str, own_hyphen: Callable[[str, str], bool]) -> tuple[str, bool]:
    """(the body with cut words put together, whether there were any); *own_hyphen* tells of a compound and its parts without a mark whether the mark is the word's own."""
    some = False

    def join(m: re.Match) -> str:
        nonlocal some
        before, mark, after = m[1], m[2], m[3]
        if after[0].isupper() or (len(before) == 1 and before.isupper()) or (before.isupper() and len(before) > 1):
            return m[0]
        at = m.start()
        if at and (body[at - 1].isdigit() or body[at - 1] in "-/#"):
            return m[0]
        if mark in "-‐‑" and own_hyphen(f"{before}-{after}".lower(), before + after):
            return f"{before}-{after}"  # a hyphen of the word's own
        some = True
        return before + after

    out = _CUT.sub(join, body)
    return re.sub("(?<=[぀-ヿ㐀-鿿、])\n(?=[぀-ヿ㐀-鿿。、])", "", out), some


def asked(raw: str, headers: set[str]) -> tuple[list[str], list[tuple[str, str]]]:
    """(words whose links clean() may look up, compounds and their parts put together whose counts it may)."""
    body, head, _ = parted(raw, headers)
    cuts: set[tuple[str, str]] = set()
    whole, _ = uncut(body, lambda own, word: bool(cuts.add((own, word))))
    words = {*tokens(whole), *tokens(head)}
    if cuts:
        words.update(tokens(uncut(body, lambda own, word: True)[0]))
    return [w for w in words if len(w) > 1], sorted(cuts)


def clean(raw: str, headers: set[str], lex: Lexicon, links: dict[str, list[str]], compounds: set[tuple[str, str]]) -> tuple[str, set[str]]:
    """(the page as paragraphs, what was wrong with it)."""
    body, head, noise = parted(raw, headers)
    body, some = uncut(body, lambda own, word: (own, word) in compounds)
    if some:
        noise.add("hyphen")
    fixed, at = [], 0
    for a, b, _, meant in misread_words(body, lex, links):
        fixed += [body[at:a], meant]
        at = b
        noise.add("misread")
    body = "".join(fixed) + body[at:]
    # a misread running line spoils words too
    if head and misread_words(head, lex, links):
        noise.add("misread")
    return reflow(body), noise


def reflow(body: str) -> str:
    """Lines into paragraphs: a blank line or an indent starts a new one."""
    out: list[str] = []
    for line in body.split("\n"):
        s = line.rstrip()
        if not s.strip():
            out.append("")
        elif out and out[-1] and not s.startswith(("　", "- ", "・", "•")):
            glue = "" if _CJK.match(out[-1][-1]) or _CJK.match(s[0]) else " "
            out[-1] += glue + s.strip()
        else:
            out.append(s)
    return "\n\n".join(p for p in out if p)


def scanned(pages: DataFrame) -> DataFrame:
    """(page_id, path, label, raw), distinct, of the .pdf files."""
    return pages.where(F.lower("path").endswith(".pdf") & F.col("raw").isNotNull()).select("page_id", "path", F.coalesce("page_key", F.lit("")).alias("label"), "raw").distinct()


def running_lines(pdf: DataFrame, least: int = 3) -> DataFrame:
    """(path, forms): the forms of the lines that stand at top or foot on *least* pages of the file."""
    seen = flat_map(pdf.select("path", "label", "raw"), lambda p, n, r: ((p, n, f) for f in header_candidates(r)), "path string, label string, form string")
    often = seen.distinct().groupBy("path", "form").count().where(F.col("count") >= least)
    return often.groupBy("path").agg(F.collect_set("form").alias("forms"))


def vectors(read: DataFrame, counts: DataFrame) -> Lexicon:
    """Skip-gram vectors of the words of all pages, one for each bucket of words that occurs often enough."""
    number = lambda w: F.pmod(F.crc32(F.encode(w, "UTF-8")), F.lit(BUCKETS))
    numbered = read.select(F.transform("words", lambda w: number(w).cast("string")).alias("words"))
    total = numbered.agg(F.sum(F.size("words"))).first()[0] or 0
    if total < LEAST_COUNT or not counts.head(1):
        return Lexicon([], np.zeros((0, VECTOR), np.float32), [])
    again = max(1, -(-LEAST_TRAINED // total))
    numbered = numbered.select(F.explode(F.array_repeat("words", again)).alias("words")) if again > 1 else numbered
    parts = max(1, min(4 * read.sparkSession.sparkContext.defaultParallelism, -(-total * again // PART_WORDS)))
    model = Word2Vec(vectorSize=VECTOR, windowSize=WINDOW, minCount=LEAST_COUNT * again, maxIter=EPOCHS, numPartitions=parts, seed=11, inputCol="words", outputCol="v", maxSentenceLength=1000).fit(numbered)
    rows = model.getVectors().collect()  # at most one row a bucket
    # the judges: every word that a link may lead to, by bucket
    latin = F.col("word") < "ɐ"
    judges = counts.where(F.col("count") >= RATIO).groupBy(number(F.col("word")).alias("bucket")).agg(F.count_if(latin), F.count_if(~latin)).collect()  # at most one row a bucket
    return Lexicon([int(r.word) for r in rows], np.array([r.vector.toArray() for r in rows], dtype=np.float32), [tuple(r) for r in judges])


def word_links(words: DataFrame, counts: DataFrame) -> DataFrame:
    """(word, targets): the frequent neighbours of each rare one of *words*, the most frequent first.

    A neighbour occurs RATIO times as often as the word, and at least RATIO
    times; LEAST_COUNT times is enough for a word with a digit amid its letters.
    A word unseen and without a neighbour may be two misreadings away.
    """
    everything = words.unionByName(counts.select("word")).distinct().where(F.length("word") > 1)
    own = everything.join(counts, "word", "left").select("word", F.coalesce("count", F.lit(0)).alias("own"))
    forms = flat_map(own, lambda w, n: ((w, n, f) for f in meant_forms(w)), "word string, own bigint, form string")
    near = forms.join(counts.select(F.col("word").alias("form"), "count"), "form").checkpoint()
    digit, cleared = F.col("word").rlike(_INNER_DIGIT.pattern), ~F.col("form").rlike("[0-9]")
    often = (F.col("count") >= RATIO * F.greatest("own", F.lit(1))) | (digit & cleared & (F.col("count") > F.col("own")))
    direct = near.where(often & ((F.length("form") > 2) | (F.col("form") > "぀")))
    one = direct.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("count"), "form"))), lambda x: x["form"]).alias("targets"))
    # two misreadings at once: one of them alone may be common enough to be known
    between = near.where("own = 0").join(one.select("word"), "word", "left_anti").select("word", "form")
    two = between.join(one.withColumnRenamed("word", "form"), "form").groupBy("word").agg(F.array_sort(F.collect_list(F.struct("form", "targets"))).alias("steps"))
    far = two.select("word", F.flatten(F.transform("steps", lambda x: x["targets"])).alias("targets")).select("word", F.filter("targets", lambda t: t != F.col("word")).alias("targets"))
    return one.unionByName(far)


def repaired(pages: DataFrame) -> DataFrame:
    """(page_id, noise ARRAY, text) of every page of a scanned file.

    Pages without a path or text are left out; an empty text comes back empty
    with no noise; repeated rows count once.  The counts of all words stay in a
    table; only the links of a page's own words reach its task.
    """
    ensure_checkpoint_dir(pages.sparkSession)
    pdf = scanned(pages)
    kind = pages.schema["page_id"].dataType.simpleString()
    with_lines = pdf.join(running_lines(pdf), "path", "left").select(F.monotonically_increasing_id().alias("row"), "page_id", "raw", "forms")

    def kernel(row, page_id, raw, forms):
        compounds = [c.lower().replace("‐", "-").replace("‑", "-") for c in _HYPHENATED.findall(_CUT.sub("", raw))]
        words, cuts = asked(raw, set(forms or ()))
        yield row, page_id, raw, forms, tokens(joined(raw)), compounds, words, [{"own": o, "whole": w} for o, w in cuts]

    read = flat_map(
        with_lines, kernel, f"row bigint, page_id {kind}, raw string, forms array<string>, words array<string>, compounds array<string>, asked array<string>, cuts array<struct<own:string,whole:string>>"
    ).checkpoint()
    often = lambda c: read.select(F.explode(c).alias("word")).groupBy("word").count().where(F.col("count") >= LEAST_COUNT)
    counts = often("words").checkpoint()
    wanted = read.select("row", F.explode("asked").alias("word"))
    links = word_links(wanted.select("word").distinct(), counts)
    of_page = wanted.join(links, "word").groupBy("row").agg(F.collect_list(F.struct("word", "targets")).alias("links"))
    cuts = read.select("row", F.explode("cuts").alias("c")).select("row", "c.own", "c.whole")
    hyphens = (
        cuts.join(often("compounds").select(F.col("word").alias("own"), F.col("count").alias("n_own")), "own")
        .join(counts.select(F.col("word").alias("whole"), F.col("count").alias("n_whole")), "whole", "left")
        .where("n_own > coalesce(n_whole, 0)").groupBy("row").agg(F.collect_list(F.struct("own", "whole")).alias("own"))
    )
    shared = pages.sparkSession.sparkContext.broadcast(vectors(read, counts))

    def settle(page_id, raw, forms, found, own):
        text, noise = clean(raw, set(forms or ()), shared.value, {x["word"]: x["targets"] for x in found or ()}, {(x["own"], x["whole"]) for x in own or ()})
        yield page_id, sorted(noise), text

    ready = read.select("row", "page_id", "raw", "forms").join(of_page, "row", "left").join(hyphens, "row", "left").select("page_id", "raw", "forms", "links", "own")
    return flat_map(ready, settle, f"page_id {kind}, noise array<string>, text string")
