"""Problem 8: abusive, hateful and sexual content.

A linear classifier of sentences, trained on rated documents.  A document's
rating says only that some sentence of it is abusive, so training alternates
between choosing those sentences and fitting (multiple-instance learning); it
starts from a few plain seed sentences.  The fit is counterfactual-regularised:
in labelled sentences that name a group of people, the group is swapped for
others and the change of the score is penalised, so that the name of a group
alone carries no weight.  A document's score is that of its worst sentence.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.lookalike import skeleton
from folioscan.llm.seeds import ABUSIVE, GROUPS, SOBER
from folioscan.operators.arrow import flat_map, spread

SAMPLE = 20_000  # rated documents the classifier is fitted on, by the hash of their id, up to half of them with a rating of abuse
SAMPLE_CHARS = 100_000  # a longer document isn't taken into the sample
ROUNDS = 4
KEPT_PARTS = 200_000  # words and runs whose part of the score a process remembers
THRESHOLD = 0.06  # of the worst sentence's probability; chosen on held-out ratings
THIN = 8  # of the sentences of unabusive documents one in so many is in every fit, for the others too, which join it once they score HARD
HARD = 0.005
L2 = 0.5  # most that the penalty on squared weights counts against the sum over sentences: a word seen in a few weighs no less in a large sample
ALIKE = 0.4  # words in common, of those in either, that make sentences alike: the same wording about other things
TRIED = 3  # best sentences of a document rated abusive that may be the abusive one

_LEET = str.maketrans("0134578@$", "oieastbas")
_CJK = "ぁ-ヿ㐀-鿿"
_SPACED = re.compile(r"(?<![^\W_])([^\W\d_])((?:[.\-_*·~ /][^\W\d_]){2,})(?![^\W_])")
_CJK_GAP = re.compile(f"[ _\\-*.·~/○〇]+(?=[{_CJK}])")
_IS_CJK = re.compile(f"[{_CJK}]")
_MIXED = re.compile(r"\b(?=[^\W\d_]*[0-9@$])(?=\w*[a-zà-ÿ]{2})[\w@$]{4,}\b")
_RUN = re.compile(r"([^\W\d_])\1+", re.ASCII)
_STAR = re.compile(r"[*_.\-](?<=[^\W\d_].)(?=[^\W\d_])")  # the mark first: it is rarer than the letter before it
_SENTENCE = re.compile("[.!?。！？;]+[\\s\"'”»」』)]+|[。！？]+|\n\\s*\n")
_WORD = re.compile("[a-zà-ÿœ'’]+|[0-9]+")
_CJK_RUN = re.compile(f"[{_CJK}]+")
_CJK_WRAP = re.compile(f"(?<=[{_CJK}、。])\r?\n(?=[{_CJK}])")
_WORD_WRAP = re.compile("(?<=[a-zà-ÿ])[-¬‐]\n(?=[a-zà-ÿ])")
_KANA_GROUP = re.compile("[ァ-ヴー]{2,}(?:人|族|派|教徒)")
_LONG_RUN = re.compile(r"([a-zß-ÿ])\1{2,}")


_MAYBE_SPACED = re.compile(r"[.\-_*·~ /](?<=[^\W\d_].)[^\W\d_][.\-_*·~ /][^\W\d_]")
_MAYBE_MIXED = re.compile(r"[0-9@$](?:(?<=[a-zà-ÿ].)|(?=[a-zà-ÿ]))")  # a digit or sign beside a Latin letter, on either side
_LETTER = re.compile(r"[^\W\d_]")
_TOKEN_END = re.compile(r"[\w@$]*")


def _undigit(text: str) -> str:
    """Words with a digit or sign for a letter written with the letter; only the words around such marks are looked at."""
    out, at = [], 0
    for m in _MAYBE_MIXED.finditer(text):
        a = m.start()
        if a < at:
            continue
        b = _TOKEN_END.match(text, a).end()
        while a > at and (text[a - 1].isalnum() or text[a - 1] in "_@$"):
            a -= 1
        fixed = _MIXED.sub(lambda w: w[0].translate(_LEET), text[a:b])
        out += [text[at:a], fixed]
        at = b
    return "".join(out) + text[at:]


def plain(text: str) -> str:
    """Text without disguise: width, look-alike letters, leet digits, spaced words."""
    text = skeleton(text)
    if _MAYBE_SPACED.search(text):
        text = _SPACED.sub(lambda m: m[1] + re.sub(r"[^\w]|_", "", m[2]) if not (" " in m[2] and m[0].isupper()) else m[0], text)
    text = text.lower()
    text = _undigit(text)
    if "ヒ" in text:
        text = text.replace("タヒ", "死")
    if not text.isascii():
        whole = text
        text = _CJK_GAP.sub(lambda m: "" if m.start() and _IS_CJK.match(whole, m.start() - 1) else m[0], whole)
    return text


def sentences(text: str) -> list[str]:
    text = plain(text).replace("\r", "")
    if not text.isascii():
        text = _CJK_WRAP.sub("", text)
    text = _WORD_WRAP.sub("", text)
    text = _STAR.sub("", text)
    return [s for s in _SENTENCE.split(text) if len(s) > 3 or (len(s) > 1 and _LETTER.search(s))]  # a Japanese sentence may have two characters


def inner(word: str) -> list[str]:
    """The word without stretched letters and, of a longer one, its 4-letter pieces with doubled letters made single."""
    word = _LONG_RUN.sub(r"\1", word)
    if len(word) <= 4:
        return [word]
    w = _RUN.sub(r"\1", word)
    return [word, *(w[i : i + 4] + "~" for i in range(len(w) - 3))]


def words(sentence: str) -> list[str]:
    return [w if w[0] > "9" else "0" for w in _WORD.findall(sentence)]


def runs(sentence: str) -> list[str]:
    return _CJK_RUN.findall(sentence)


def features(sentence: str) -> list[str]:
    """Words, neighbouring words and inner letters; of Japanese runs the 2- and 3-character pieces."""
    out = []
    last = "^"
    for w in words(sentence):
        out += inner(w)
        out.append(last + " " + w)
        last = w
    for run in runs(sentence):
        out += [run[i : i + 2] for i in range(len(run) - 1)]
        out += [run[i : i + 3] for i in range(len(run) - 2)]
    return out


_TOKEN = re.compile("[a-zà-ÿœ'’]+|[0-9](?![0-9])")  # of a number its last digit, which stands for it


class _Parts(dict):
    """Word -> its part of a sentence's sum, kept once it was worked out."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, w: str) -> float:
        get = self.weights.get
        part = get("0", 0.0) if w[0] <= "9" else sum([get(f, 0.0) for f in inner(w)])
        if len(self) < KEPT_PARTS:
            self[w] = part
        return part


class _Pieces:
    """Sums over the 2- and 3-character pieces of Japanese text, many sentences at a time."""

    def __init__(self, weights: dict[str, float]):
        runs = {f: x for f, x in weights.items() if _IS_CJK.match(f)}
        chars = sorted({c for f in runs for c in f})
        self.n = n = len(chars) + 1
        self.ids = np.zeros(65536, np.int32)  # 0: in no piece
        self.ids[[ord(c) for c in chars]] = np.arange(1, n)
        number = {c: i + 1 for i, c in enumerate(chars)}
        self.two = np.zeros((n, n), np.float32)
        self.more = np.zeros((n, n), bool)  # whether a longer piece begins so
        three = {}
        for f, x in runs.items():
            at = [number[c] for c in f]
            if len(f) == 2:
                self.two[at[0], at[1]] = x
            else:
                self.more[at[0], at[1]] = True
                three[(at[0] * n + at[1]) * n + at[2]] = x
        self.keys = np.array(sorted(three), np.int64)
        self.three = np.array([three[k] for k in sorted(three)], np.float32)

    def sums(self, ss: list[str]) -> np.ndarray:
        points = np.frombuffer(("\n".join(ss) + "\n\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        ids = self.ids[np.minimum(points, 65535)]
        a, b, c = ids[:-2], ids[1:-1], ids[2:]
        part = self.two[a, b].astype(np.float64)
        at = np.flatnonzero(self.more[a, b])
        if len(at):
            key = (a[at].astype(np.int64) * self.n + b[at]) * self.n + c[at]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            part[at] += np.where(self.keys[place] == key, self.three[place], 0.0)
        ends = np.cumsum([len(s) + 1 for s in ss])
        return np.add.reduceat(part, np.concatenate([[0], ends[:-1]])) if len(ss) else np.empty(0)


class Model:
    """Weights by feature; the score of a sentence is a probability."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self._parts, self._pieces = _Parts(weights), _Pieces(weights)
        self._pairs: dict[tuple[str, str], float] = {}
        digits = "0123456789"
        for f, x in weights.items():
            if " " in f:
                first, second = f.split(" ", 1)
                self._pairs |= {(a, b): x for a in (digits if first == "0" else (first,)) for b in (digits if second == "0" else (second,))}

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias}

    def __setstate__(self, state):
        self.__init__(state["weights"], state["bias"])

    def logits(self, ss: list[str]) -> np.ndarray:
        """Of each sentence the bias and the sum over features(), by words, pairs of words and pieces of Japanese text."""
        part, pair = self._parts.__getitem__, self._pairs.get
        out = np.full(len(ss), self.bias)
        for i, s in enumerate(ss):
            if found := _TOKEN.findall(s):
                out[i] += sum(map(part, found)) + sum(map(pair, zip(["^", *found], found, strict=False), _ZEROS))
        wide = [i for i, s in enumerate(ss) if not s.isascii()]
        if wide:
            out[wide] += self._pieces.sums([ss[i] for i in wide])
        return out

    def score(self, text: str | None) -> float:
        """0 for null and empty texts, else the worst sentence's probability."""
        worst = self.logits(sentences(text)).max(initial=-30.0) if text else -math.inf
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, worst)))) if text else 0.0


_ZEROS = itertools.repeat(0.0)
_GROUP = re.compile("|".join(rf"\b{re.escape(g)}\b" if g.isascii() or g[0] < "　" else re.escape(g) for g in sorted(sum(GROUPS.values(), []), key=len, reverse=True)))
_LANG_OF = {g: lang for lang, names in GROUPS.items() for g in names}


def counterfactuals(sentence: str, rng: random.Random, n: int = 2) -> list[str]:
    """The sentence with the group of people it names swapped for others of its language."""
    for pattern in (_GROUP, _KANA_GROUP):
        m = pattern.search(sentence)
        if m:
            others = [g for g in GROUPS[_LANG_OF.get(m[0], "ja")] if g != m[0]]
            return [pattern.sub(g, sentence) for g in rng.sample(others, min(n, len(others)))]
    return []


class _Rows:
    """Sentences as rows of feature numbers."""

    def __init__(self, bags: list[list[str]], vocabulary: dict[str, int]):
        ids = [[vocabulary[f] for f in bag if f in vocabulary] or [0] for bag in bags]
        self.index = np.fromiter((i for r in ids for i in r), np.int64)
        self.length = np.array([len(r) for r in ids], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]]) if len(ids) else np.empty(0, np.int64)
        self.scale = 1.0

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(w[self.index], self.start) if len(self.start) else np.empty(0)

    def back(self, err: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.index, np.repeat(err, self.length), size)


def _fit(rows: _Rows, y: np.ndarray, weight: np.ndarray, pairs: tuple[_Rows, _Rows] | None, size: int, w: np.ndarray, steps: int = 120, l2: float = 6e-5, fair: float = 0.3) -> np.ndarray:
    """Logistic regression by AdaGrad, with the penalty on score changes under swapped groups."""
    w = w.copy()
    # the rarer kind counts for a fifth of all, whatever the size of the sample
    weight = np.where(y > 0, weight * (0.25 * weight[y == 0].sum() / max(weight[y > 0].sum(), 1e-9)), weight)
    total = weight.sum()
    l2 = min(l2, L2 / total)
    history = np.full(size + 1, 1e-8)
    for step in range(steps):
        z = rows.dot(w[:-1]) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        err = weight * (p - y) / total
        grad = np.empty(size + 1)
        grad[:-1] = rows.back(err, size) + l2 * w[:-1]
        grad[-1] = err.sum()
        if pairs and len(pairs[0].start):
            gap = (pairs[0].dot(w[:-1]) - pairs[1].dot(w[:-1])) * fair / len(pairs[0].start)
            grad[:-1] += pairs[0].back(gap, size) - pairs[1].back(gap, size)
        history += grad * grad
        w -= 0.35 * grad / np.sqrt(history)
        w[0] = 0.0
    return w


def _probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def rating_error(votes: list[tuple[float, int]]) -> float:
    """How often a rating errs, from how often raters of one document differ; *votes*: (share that found it abusive, raters)."""
    several = [(r, n) for r, n in votes if n > 1]
    # of two ratings one errs with 2e(1-e); counts as if one more of ten pairs had differed
    differ = (1 + sum(2 * r * (1 - r) * n / (n - 1) for r, n in several)) / (10 + len(several))
    return (1 - math.sqrt(max(0.04, 1 - 2 * differ))) / 2


def _wording(sentence: str) -> set[str]:
    return {*words(sentence), *(run[i : i + 2] for run in runs(sentence) for i in range(len(run) - 1))}


class _Evidence:
    """What the ratings of all documents that hold a sentence, or one like it, say of it: the sum of their log odds."""

    def __init__(self, texts: list[str], of_doc: list[list[int]], odds: list[float]):
        self.number: dict[str, int] = {}
        bags = [sorted({self.number.setdefault(f, len(self.number)) for f in _wording(t)}) for t in texts]
        self.size = np.array([len(b) for b in bags], np.int64)
        column = np.fromiter(itertools.chain.from_iterable(bags), np.int32, int(self.size.sum()))
        order = np.argsort(column, kind="stable")
        self.rows = np.repeat(np.arange(len(bags), dtype=np.int32), self.size)[order]
        self.start = np.searchsorted(column[order], np.arange(len(self.number) + 1))
        self.texts, self.odds = texts, np.array(odds)
        pairs = np.array([(i, d) for d, ids in enumerate(of_doc) for i in set(ids)], np.int64).reshape(-1, 2)
        self.docs = pairs[np.argsort(pairs[:, 0], kind="stable"), 1]
        self.held = np.concatenate([[0], np.cumsum(np.bincount(pairs[:, 0], minlength=len(texts)))])
        self.known: dict[int, float] = {}

    def of(self, i: int) -> float:
        if i not in self.known:
            own = [self.number[f] for f in _wording(self.texts[i])]
            shared = np.bincount(np.concatenate([[i], *(self.rows[self.start[f] : self.start[f + 1]] for f in own)]).astype(np.int64), minlength=len(self.texts))
            near = np.flatnonzero(shared >= ALIKE * np.maximum(self.size + len(own) - shared, 1))
            docs = {d for j in {i, *near.tolist()} for d in self.docs[self.held[j] : self.held[j + 1]].tolist()}
            self.known[i] = float(self.odds[sorted(docs)].sum())
        return self.known[i]


def train(rated: list[tuple]) -> Model:
    """*rated*: (text, share of raters that found it abusive, and their number, else one).

    A sentence of a document rated abusive counts as abusive once that is likelier
    than not, given its score and the ratings of all documents that hold it or
    one like it: ratings that agree outweigh a low score, two that differ say nothing.

    All sentences of documents rated abusive are in every fit; of the far more
    numerous others one in THIN, which stands for the rest, and each that scored
    HARD or more in a round before: so all of them are scored and none that
    looks abusive is left out.
    """
    rng = random.Random(7)
    pool: dict[str, int] = {}
    votes = [(r, n[0] if n else 1) for t, r, *n in rated if t]
    error = rating_error(votes)
    of_doc = [([pool.setdefault(s, len(pool)) for s in sentences(t)], r) for t, r, *_ in rated if t]
    texts = list(pool)
    evidence = _Evidence(texts, [ids for ids, _ in of_doc], [n * (2 * r - 1) * math.log((1 - error) / error) for r, n in votes])
    clean = Counter(i for ids, r in of_doc if r == 0 for i in set(ids))  # sentence -> unabusive documents that hold it
    accused = sorted({i for ids, r in of_doc if r > 0 for i in ids})
    thin = sorted(i for i in clean.keys() - set(accused) if clean[i] > 1 or zlib.crc32(texts[i].encode()) % THIN == 0)
    spare = np.array(sorted(clean.keys() - set(accused) - set(thin)), np.int64)
    seeds = [(plain(s), 1.0) for s in ABUSIVE] + [(plain(s), 0.0) for s in SOBER] + [("", 0.0)]
    seed_bags = [features(s) for s, _ in seeds]
    seeded = {f for b in seed_bags for f in b}
    bag = functools.cache(lambda i: features(texts[i]))
    hard: list[int] = []
    model, p = None, {}
    for step in range(ROUNDS + 1):
        chosen = [*accused, *thin, *hard]
        bags = [bag(i) for i in chosen]
        df = Counter(f for b in bags for f in set(b))
        names = ["\0", *sorted(f for f in {*df, *seeded} if df[f] >= 2 or f in seeded)]
        vocabulary = {f: i for i, f in enumerate(names)}
        at = {i: n for n, i in enumerate(chosen)}
        y = np.array([0.0] * len(chosen) + [v for _, v in seeds])
        weight = np.array([float(clean[i]) for i in chosen] + [3.0] * len(seeds))
        for i in thin:
            if clean[i] == 1:
                weight[at[i]] = THIN
        weight[-1] = 0.05 * weight.sum()  # a fragment without a known word isn't abusive
        for ids, r in of_doc if step > 1 else ():
            if r == 0:
                continue
            best = heapq.nlargest(TRIED, set(ids), key=lambda i: (p[i], i))
            # a rating may err: a document none of whose sentences stands out teaches nothing
            for i in {*best, *(i for i in ids if p[i] >= 0.5)}:
                if math.log(max(p[i], 1e-12) / max(1 - p[i], 1e-12)) + evidence.of(i) > 0:
                    y[at[i]], weight[at[i]] = 1.0, 4.0 * (0.5 + 0.5 * r)
        swapped = [(s, c) for s in [*(texts[i] for i in chosen if p.get(i, 1.0) >= HARD), *(s for s, _ in seeds)] for c in counterfactuals(s, rng)]
        pairs = (_Rows([features(a) for a, _ in swapped], vocabulary), _Rows([features(b) for _, b in swapped], vocabulary)) if swapped else None
        start = np.array([0.0, *(model.weights.get(f, 0.0) for f in names[1:]), model.bias]) if model else np.zeros(len(names) + 1)
        w = _fit(_Rows(bags + seed_bags, vocabulary), y, weight, pairs, len(names), start, steps=60)
        model = Model({f: float(x) for f, x in zip(names, w[:-1], strict=True) if abs(x) > 1e-3}, float(w[-1]))
        p = {i: x for i, x in zip(accused, _probability(model.logits([texts[i] for i in accused])).tolist(), strict=True)}
        if step < ROUNDS and len(spare):
            now = _probability(model.logits([texts[i] for i in spare.tolist()])) >= HARD
            hard += spare[now].tolist()
            spare = spare[~now]
    return model


def rated_texts(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[tuple[str, float, int]]:
    """At most *sample* rated documents with the mean and the number of their ratings; null ratings and repeated rows don't count."""
    rating = (
        labels.where("abusive is not null and doc_id is not null").select("doc_id", "rater", "abusive").distinct().groupBy("doc_id").agg(F.avg("abusive").alias("share"), F.count("*").alias("raters"))
    )
    order = (F.xxhash64("doc_id"), "doc_id")
    some = rating.where("share > 0").orderBy(*order).limit(sample // 2)
    none = rating.where("share = 0").orderBy(*order).limit(sample // 2)
    chosen = some.unionByName(none)  # at most *sample* short rows: small enough to broadcast
    held = documents.select("doc_id", "text").where(F.length("text").between(1, SAMPLE_CHARS))
    return [(r.text, r.share, r.raters) for r in held.join(F.broadcast(chosen), "doc_id").select("text", "share", "raters").collect()]


def scores(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, source, score) of every document; null and empty texts score 0."""
    model = train(sorted(rated_texts(documents, labels, sample)))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = documents.schema["doc_id"].dataType.simpleString()
    return flat_map(spread(documents.select("doc_id", "source", "text")), lambda d, s, t: ((d, s, shared.value.score(t)),), f"doc_id {kind}, source string, score double")
