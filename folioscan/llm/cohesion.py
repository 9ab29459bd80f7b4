"""Problem 3: oversized texts cut at natural boundaries by lexical cohesion.

The text is taken apart into sentences.  At every gap between two sentences the
words of the block before and the block after are compared; gaps where the
similarity dips below both sides are topic boundaries, and the depth of the
valley says how clear.  Within each size window the deepest valley becomes the
cut, and the next piece starts an overlap before it.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.operators.arrow import flat_map

LIMIT = 1800
OVERLAP = 200
SLACK = 40  # how far the overlap may be off 200 to meet a boundary
BLOCK = 3  # sentences on each side of a gap
LEAST = 0.5  # share of the limit that a piece fills at least, where boundaries allow

_LINE_END = re.compile("\r\n?")
# a blank line; an end mark with closing quotes; a line end before an indent or list mark
_GAP = re.compile("\\n[ \\t]*\\n+|[。！？](?:[」』）】]*)\\n?|[.!?]['\"”»)]*(?:[ \\t]+|\\n)(?=[^a-zà-ÿ])|\\n(?=[\u3000\\-•・*\\d])")
_WORD = re.compile("[^\\W\\d_]{3,}")
_HAN = re.compile("[\u3040-\u30ff\u3400-\u9fff]{2,}")
_SOFT = re.compile("\\n|(?<=[、,;；:：])|[ \\t\u3000]")
_JOINED = re.compile("[\u0300-\u036f\u200d\u3099\u309a\ufe00-\ufe0f]")


def unify(text: str) -> str:
    """CRLF and lone CR as LF."""
    return _LINE_END.sub("\n", text)


def _terms(sentence: str) -> Counter:
    terms = Counter(w.lower() for w in _WORD.findall(sentence) if w.isascii() or w[0] < "\u3000")
    for run in _HAN.findall(sentence):
        terms.update(run[i : i + 2] for i in range(len(run) - 1))
    return terms


def valleys(text: str) -> list[tuple[int, float]]:
    """(position, depth) of every gap between sentences; paragraph breaks are a little deeper."""
    cuts = [m.end() for m in _GAP.finditer(text) if 0 < m.end() < len(text)]
    cuts = sorted(set(cuts))
    if not cuts:
        return []
    edges = [0, *cuts, len(text)]
    bags = [_terms(text[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    similar = []
    left, right = Counter(), Counter()
    left.update(bags[0])
    for b in bags[1 : 1 + BLOCK]:
        right.update(b)
    for g in range(len(cuts)):
        dot = sum(n * right[t] for t, n in left.items() if t in right)
        norm = math.sqrt(sum(n * n for n in left.values()) * sum(n * n for n in right.values()))
        similar.append(dot / norm if norm else 0.0)
        left.update(bags[g + 1])
        if g + 1 >= BLOCK:
            _less(left, bags[g + 1 - BLOCK])
        _less(right, bags[g + 1])
        if g + 1 + BLOCK < len(bags):
            right.update(bags[g + 1 + BLOCK])
    out = []
    peak_right = [0.0] * len(cuts)
    for g in range(len(cuts) - 1, -1, -1):  # climb while it rises
        peak_right[g] = max(similar[g], peak_right[g + 1]) if g + 1 < len(cuts) and similar[g + 1] >= similar[g] else similar[g]
    climb = 0.0
    for g, s in enumerate(similar):
        climb = max(s, climb) if g and similar[g - 1] >= s else s
        depth = climb - s + peak_right[g] - s
        out.append((cuts[g], depth + (0.1 if text[cuts[g] - 2 : cuts[g]] == "\n\n" else 0.0)))
    return out


def _less(bag: Counter, part: Counter) -> None:
    for t, n in part.items():
        if bag[t] > n:
            bag[t] -= n
        else:
            del bag[t]


def _whole(text: str, at: int) -> int:
    """Never between a character and what joins it."""
    while 0 < at < len(text) and _JOINED.match(text[at]):
        at -= 1
    return at


def split(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of each piece in the unified text, each at most *limit* long.

    A null or empty text gives one empty piece, so that no row is dropped; a
    text within the limit comes back whole.
    """
    if not text or len(text) <= limit:
        return [(0, len(text or ""))]
    gaps = valleys(text)
    pieces, start, g = [], 0, 0
    while len(text) - start > limit:
        lo, hi = start + max(int(limit * LEAST), overlap + SLACK + 1), start + limit
        while g < len(gaps) and gaps[g][0] < lo:
            g += 1
        best, k = None, g
        while k < len(gaps) and gaps[k][0] <= hi:
            if best is None or gaps[k][1] >= best[1]:
                best = gaps[k]
            k += 1
        if best is None:
            soft = [m.end() for m in _SOFT.finditer(text, lo, hi)]
            cut = soft[-1] if soft else _whole(text, hi)
            if cut <= start + overlap + SLACK:
                cut = hi
        else:
            cut = best[0]
        pieces.append((start, cut))
        start = _back(text, cut, overlap)
    pieces.append((start, len(text)))
    return pieces


def _back(text: str, cut: int, overlap: int) -> int:
    """Start of the next piece: the boundary nearest to *overlap* characters before the cut."""
    want = cut - overlap
    near = [m.end() for m in _SOFT.finditer(text, max(0, want - SLACK), min(cut, want + SLACK))]
    near += [m.end() for m in _GAP.finditer(text, max(0, want - SLACK), min(cut, want + SLACK))]
    return min(near, key=lambda p: (abs(p - want), p)) if near else _whole(text, want)


def pieces(df: DataFrame, key: str, page: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, page, piece, n_pieces, start, end, text): the numbered pieces of every row.

    Null and empty texts give one empty piece; repeated rows (same key, label
    and text) come out once; other columns are not looked at.
    """
    kind = df.schema[key].dataType.simpleString()
    slim = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{page}`").alias("page"), F.col(f"`{text}`").alias("text")).distinct()

    def kernel(k, p, t):
        whole = unify(t or "")
        cuts = split(whole, limit, overlap)
        for n, (a, b) in enumerate(cuts, 1):
            yield k, p, n, len(cuts), a, b, whole[a:b]

    return flat_map(slim, kernel, f"`{key}` {kind}, `{page}` string, piece int, n_pieces int, start int, end int, text string")
