"""Text decoded with the wrong character encoding: find it and take it back.

Every suspect span is the start state of a best-first search.  An edge is one
*encode -> decode* step (the bytes the wrong reader saw, read again as another
encoding) or one *unescape* step.  States that were seen are kept by hash and
not expanded again, a character-plausibility cost orders the frontier, and the
cheapest text reached is the answer.
"""

from __future__ import annotations

import heapq
import html
import re
from functools import lru_cache

from folioscan.llm.lookalike import INVISIBLE, LOOKALIKES, skeleton

# Encodings a span may have been read with, and encodings its
# bytes may really have been in.
WRONG_READERS = ("cp1252", "latin-1", "cp932", "cp437", "cp850", "mac_roman", "cp1251", "cp1250", "euc_jp", "gbk")
TRUE_WRITERS = ("utf-8", "cp932", "euc_jp", "cp1252")

MAX_EXPANDED = 24  # states expanded for one span; see the README for what a larger number finds
MAX_DEPTH = 4  # steps on a path
STEP_COST = 0.25  # added for each step, so that the shortest of equal paths wins
OTHER_COST = 0.3  # added for a step to another encoding than UTF-8, which seldom fits by chance
MIN_GAIN = 0.6  # cost a repair has to save before its span counts as garbled
ODD = 0.5  # cost beyond that of everyday characters from which on a line is searched
MAX_KEPT = 0.45  # share of the old cost that may be left after a repair
MAX_ODD = 0.2  # share of the old oddness that may be left where the cost of everyday letters hides the gain
RESIDUE = 0.55  # mean cost of the non-ASCII characters above which a span is garbled for good

def _second_level() -> str:
    """The rarer kanji of the Japanese standard, as a character class: lead bytes from 0x99 on."""
    out = []
    for lead in (*range(0x99, 0xA0), *range(0xE0, 0xEB)):
        for trail in (*range(0x40, 0x7F), *range(0x80, 0xFD)):
            out.append(bytes([lead, trail]).decode("cp932", "ignore"))
    return "".join(c for c in "".join(out) if "\u4e00" <= c <= "\u9fff")


_J2 = _second_level()
# What the unescape steps undo.
ESCAPED = re.compile("\\$[B@][!-~]{2}|&#?[0-9A-Za-z]{2,8};|\\\\u[0-9A-Fa-f]{4}|%[0-9A-F]{2}%[0-9A-F]{2}|=[0-9A-F]{2}=[0-9A-F]{2}")
HARD = re.compile("[\u0080-\u0084\u0086-\u009f�-]")
_JIS = re.compile("\x1b?\\$[B@]((?:[!-~]{2})+?)\x1b?\\([BJ]")
_U = re.compile(r"\\u([0-9A-Fa-f]{4})")
_PCT = re.compile("(?:%[0-9A-F]{2})+")
_QP = re.compile("(?:=[0-9A-F]{2})+")


@lru_cache(maxsize=1)
def _single_byte() -> dict[str, tuple[frozenset[str], dict[int, int]]]:
    """Character -> byte of every one-byte reader; undefined bytes stand for themselves."""
    out = {}
    for enc in ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "cp1250"):
        table = {}
        for b in range(256):
            try:
                table[ord(bytes([b]).decode(enc))] = b
            except UnicodeDecodeError:
                table[b] = b
        if enc == "cp1252":  # strict readers leave C1 bytes as they are
            table |= {b: b for b in range(0x80, 0xA0)}
        out[enc] = (frozenset(map(chr, table)), table)
    return out


@lru_cache(maxsize=65536)
def _rare_kanji(ch: str) -> bool:
    """Outside the everyday level of the Japanese standard: its second level or none."""
    try:
        b = ch.encode("cp932")
    except UnicodeEncodeError:
        return True
    return b[0] > 0x98 or (b[0] == 0x98 and b[1] > 0x72)


# Classes: a ASCII, l accented letter, m accented letter of other languages than English, German and French, s Latin-1 sign, k kana, j everyday kanji, J rare kanji,
# h half-width kana, c control or lost, p private, b box, g Greek or Cyrillic, w wide form, q fine sign, o other.
@lru_cache(maxsize=65536)
def char_class(ch: str) -> str:
    o = ord(ch)
    if o < 0x80:
        return "c" if o < 32 and ch not in "\t\n\r" or o == 127 else "A" if ch.isalpha() else "a"
    if o < 0xA0 or o == 0xFFFD:
        return "c"
    if o < 0x100:
        if ch in "ÁÌÍÐÑÒÓÕÝÞáìíðñòóõýþÆæÅåÃãÚúØø":
            return "m"
        return "l" if o >= 0xC0 and o not in (0xD7, 0xF7) else "q" if ch in " £§­°µ«»±º×" else "s"
    if 0x3040 <= o <= 0x30FF or 0x3000 <= o <= 0x303F or o in (0xFF70, 0x2103):
        return "h" if o == 0xFF70 else "k"
    if 0x4E00 <= o <= 0x9FFF or 0x3400 <= o <= 0x4DBF or 0xF900 <= o <= 0xFAFF:
        return "J" if _rare_kanji(ch) else "j"
    if 0xFF61 <= o <= 0xFF9F:
        return "h"
    if 0xE000 <= o <= 0xF8FF:
        return "p"
    if 0x2500 <= o <= 0x259F:
        return "b"
    if 0x370 <= o <= 0x52F:
        return "g"
    if o == 0x20AC or 0x2010 <= o <= 0x2015 or 0x2018 <= o <= 0x201F or 0xFF00 <= o <= 0xFF60 or o in (0x2026, 0x2030, 0x2116, 0x2212, 0x2300, 0x203B) or 0xFB00 <= o <= 0xFB06:
        return "q"
    if 0x2E80 <= o <= 0x2FDF or 0x200B <= o <= 0x200F or o in (0xFEFF, 0x2060, 0x3099, 0x309A):
        return "q"
    return "o"


class _Classes(dict):
    def __missing__(self, o: int) -> str:
        self[o] = got = char_class(chr(o))
        return got


_CLASSES = _Classes()
COST = {"a": 0.0, "A": 0.0, "k": 0.0, "j": 0.05, "l": 0.15, "m": 0.4, "q": 0.1, "h": 0.5, "s": 0.9, "J": 0.8, "c": 3.0, "p": 2.0, "b": 1.0, "g": 0.5, "o": 0.9}
# A neighbour that a sound text seldom puts there.
PAIR = {
    "lq": 0.9, "ls": 1.0, "ll": 0.5, "sl": 0.6, "ql": 0.4, "lo": 1.0, "ol": 0.8, "hj": 0.6, "jh": 0.6, "hJ": 0.6, "Jh": 0.6,
    "hA": 0.3, "Jk": 0.1, "jA": 0.6, "Aj": 0.6, "gq": 0.8, "gs": 0.9, "go": 0.8, "og": 0.8, "gl": 0.9, "lg": 0.9, "bA": 0.8, "Ab": 0.8, "bl": 0.8,
    "lb": 0.8, "bq": 0.3, "qb": 0.3, "bg": 0.8, "gb": 0.8, "oq": 0.4, "sq": 0.5, "qs": 0.4, "JA": 0.5, "AJ": 0.5, "Ah": 0.3, "Ag": 0.4, "gA": 0.4,
    "mq": 0.9, "ms": 1.0, "mm": 0.5, "ml": 0.5, "lm": 0.5, "sm": 0.6, "qm": 0.4, "mo": 1.0, "om": 0.8, "gm": 0.9, "mg": 0.9, "bm": 0.8, "mb": 0.8, "km": 0.5, "mk": 0.5, "jm": 0.5, "mj": 0.5, "Jm": 0.5, "mJ": 0.5, "Ao": 0.4, "oA": 0.4, "kl": 0.5, "lk": 0.5, "jl": 0.5, "lj": 0.5, "Jl": 0.5, "lJ": 0.5, "hk": 0.1, "kh": 0.1,
}
_UPPER_IN_WORD = re.compile("[a-zß-ÿ][À-Þ]|[À-Þ][0-9]|[0-9][À-Þß-ÿ]|[A-Z][À-Þ][a-z]")
# Letters where a mark or a sign should stand: alone, before a figure, behind the end of a sentence; half-width kana squeezed before Latin text.
_MISPLACED = re.compile(
    "(?<=\\s)[ÁÂ-ÓÕ-ßáâ-ïñ-óõ-ÿĀ-ſƒ](?!\\S)|(?<!\\S)[ÁÂ-ÓÕ-ßáâ-ïñ-óõ-ÿĀ-ſƒ](?=\\s)|(?<![^\\s(])[Á-Þßá-ÿЀ-ѿ](?= ?[0-9])|(?<=[.,!?;:])[ß-ÿÀ-Þ](?!\\S)|(?<!\\S)[ìíòóúñ](?=[A-Za-z])|(?<![^\\s(])[｡-ﾟ]{1,2}(?=[0-9A-Za-z])|(?<=[A-Za-z])[…‚„†‡‰‹](?=[.,a-z])"
)
MISPLACED_COST = 0.9
_CYRILLIC_WORD = re.compile("\\b(?=\\w*[аеиоуыэюяё])[А-ЯЁ]?[а-яё]{3,}\\b")


def cost(text: str) -> float:
    """Character-plausibility cost: 0 for sound text, about 1 for each character that cannot be right."""
    escapes = sum(1.2 + 0.06 * len(x) for x in _JIS.findall(text)) if "$" in text else 0.0
    if text.isascii():
        return 3.0 * sum(1 for c in text if c < " " and c not in "\t\n\r") + escapes
    return _weighed(text, COST, PAIR) + escapes


def oddness(text: str) -> float:
    """The cost without what everyday letters and kanji add up to in a long text."""
    return 0.0 if text.isascii() else _weighed(text, _ODD, _ODD_PAIR)


def _weighed(text: str, of: dict[str, float], pairs: dict[str, float]) -> float:
    classes = text.translate(_CLASSES)
    there = set(classes)
    if there <= {"h", "a"} and classes.count("h") > 2:
        return 0.05 * classes.count("h")  # nothing but half-width kana
    if "g" in there:
        classes = _CYRILLIC_WORD.sub(lambda m: "k" * len(m[0]), text).translate(_CLASSES)
        there = set(classes)
    total = sum(of[c] * classes.count(c) for c in there if of[c])
    for p, v in pairs.items():
        if p[0] in there and p[1] in there:
            total += v * classes.count(p)
    if not there.isdisjoint("lmghsoq"):
        total += 0.8 * len(_UPPER_IN_WORD.findall(text)) + MISPLACED_COST * len(_MISPLACED.findall(text))
    return total


_ODD = COST | {"j": 0.0, "l": 0.0, "q": 0.0, "J": 0.3}  # names hold rare kanji now and then
_ODD_PAIR = {p: v for p, v in PAIR.items() if p != "ql"}  # as in l’été


def _bytes_of(text: str, reader: str) -> bytes | None:
    table = _single_byte().get(reader)
    if table is not None:
        if not set(text) <= table[0]:
            return None
        return text.translate(table[1]).encode("latin-1")
    try:
        return text.encode(reader)
    except UnicodeEncodeError:
        return None


def _unescaped(text: str):
    if "$" in text:
        yield _JIS.sub(lambda m: _jis(m), text)
    if "&" in text:
        yield html.unescape(text)
    if "\\u" in text:
        yield _U.sub(lambda m: chr(int(m[1], 16)), text)
    if "%" in text:
        yield _PCT.sub(lambda m: bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace"), text)
    if "=" in text:
        yield _QP.sub(lambda m: bytes.fromhex(m[0].replace("=", "")).decode("utf-8", "replace"), text)


def _jis(m: re.Match) -> str:
    try:
        return (b"\x1b$B" + m[1].encode() + b"\x1b(B").decode("iso2022_jp")
    except UnicodeDecodeError:
        return m[0]


def neighbours(text: str):
    """(text, what the step costs) of every text one step away."""
    for t in _unescaped(text):
        yield t, STEP_COST
    if text.isascii():
        return
    pieces = text.split("\ufffd")
    seen = set()
    for reader in WRONG_READERS:
        raws = [_bytes_of(p, reader) for p in pieces]
        if None in raws or (key := b"\xff".join(raws)) in seen or key.isascii():
            continue
        seen.add(key)
        for writer in TRUE_WRITERS:
            if len(pieces) > 1 and writer == "cp1252":
                continue
            step = STEP_COST + (writer != "utf-8") * OTHER_COST
            try:
                yield "\ufffd".join([r.decode(writer) for r in raws]), step
            except UnicodeDecodeError:
                if writer != "cp1252":
                    yield "\ufffd".join([r.decode(writer, "replace") for r in raws]), step


def search(span: str) -> tuple[str, float, float]:
    """Cheapest text reachable from *span*, with the cost before and after."""
    start = cost(span)
    best, best_cost = span, start
    frontier = [(start, 0.0, 0, 0, span)]
    visited = {hash(span)}
    tie = expanded = 0
    while frontier and expanded < MAX_EXPANDED:
        at, paid, depth, _, text = heapq.heappop(frontier)
        if at > best_cost + 2.0 + 0.5 * start:
            break
        expanded += 1
        for nxt, step in neighbours(text):
            h = hash(nxt)
            if h in visited or not nxt:
                continue
            visited.add(h)
            c = cost(nxt) + paid + step
            if c < best_cost:
                best, best_cost = nxt, c
                if c < start and oddness(nxt) == 0 and "\ufffd" not in nxt and not ESCAPED.search(nxt):
                    return best, start, best_cost  # nothing is left to put right
            if depth < MAX_DEPTH - 1 and paid + step + STEP_COST < best_cost and c < start * 1.6 + 1:
                tie += 1
                heapq.heappush(frontier, (c, paid + step, depth + 1, tie, nxt))
    return best, start, best_cost


_RUN = re.compile("[^\x00-\x7f](?:[^\x00-\x7f]|(?<=[^\x00-\x7f])[ -~](?=[^\x00-\x7f]))*")
# Runs of the characters that one family of wrong readers puts out.
_FAMILIES = (
    re.compile("[ -~\u0080-ÿŒœŠšŸŽžƒˆ˜–-›€™…‰†‡•\ufffd]+"),
    re.compile("[\u0080-ÿŒœŠšŸŽžƒˆ˜–-›€™…‰†‡•\ufffd]+"),
    re.compile("[ -~\u0080-ÿƒ\u0370-\u03ff\u2190-\u25ffⁿ₧]+"),
    re.compile("[\u0080-ÿƒ\u0370-\u03ff\u2190-\u25ffⁿ₧]+"),
    re.compile("[ -~\u0080-ſ–-›€™…‰†‡•˙˛ˇ˘˝\ufffd]+"),
    re.compile("[\u0080-ſ–-›€™…‰†‡•˙˛ˇ˘˝\ufffd]+"),
    re.compile("[ -~\u0400-\u04ff\u00a0-»–-›€№™†‡…‰•\ufffd]+"),
    re.compile("[\u3000-\u9fff\uf900-\ufaff\uff00-\uff9f\ue000-\uf8ff\u0080\ufffd\u0370-\u04ff\u2200-\u22ff\u25a0-\u266f]+"),
)


def _accepted(before: float, after: float, old: str = "", new: str = "") -> bool:
    """Whether a repair saves enough: most of the cost, or nearly all that is odd where the everyday letters around it are many."""
    return before - after >= MIN_GAIN and (after - STEP_COST <= MAX_KEPT * before or oddness(new) < MAX_ODD * oddness(old))


def repair_span(span: str) -> tuple[str, bool]:
    """One line: as a whole, else by its runs of characters of one kind."""
    best, before, after = search(span)
    if _accepted(before, after, span, best):
        if "�" not in best or "�" in span:
            return best, True
    changed = False
    out = span
    for runs in _FAMILIES:
        parts, at = [], 0
        for m in runs.finditer(out):
            if m[0].isascii() or cost(m[0]) < MIN_GAIN + STEP_COST or oddness(m[0]) < ODD:
                continue
            got, b, a = search(m[0])
            if got != m[0] and _accepted(b, a, m[0], got) and ("\ufffd" not in got or "\ufffd" in m[0]):
                parts += [out[at : m.start()], got]
                at, changed = m.end(), True
        if parts:
            out = "".join(parts) + out[at:]
    for m in reversed(list(_ZONE.finditer(out))):
        got, hit = _zone(out, m.start(), m.end())
        if hit:
            out, changed = got, True
    if not changed and best != span and _accepted(before, after, span, best):
        return best, True  # a tail was cut: what is left of it stays marked
    return out, changed


_BAD = f"[{_J2}｡-ﾟ\ue000-\uf8ff\u0080\ufffd]"
_ZONE = re.compile(f"{_BAD}(?:.{{0,4}}?{_BAD})+")


def _zone(line: str, start: int, end: int) -> tuple[str, bool]:
    """A garbled stretch amid sound text of the same script: its edges may lie a few characters off."""
    best, hit, least = line, False, 0.0
    for i in range(max(0, start - 2), start + 2):
        for j in range(max(end - 2, i + 2), min(len(line), end + 3) + 1):
            raw = _bytes_of(line[i:j], "cp932")
            if raw is None or raw.isascii():
                continue
            for writer in ("utf-8", "euc_jp", "cp1252"):
                try:
                    got = raw.decode(writer)
                except UnicodeDecodeError:
                    continue
                lo, hi = max(0, i - 2), min(len(line), j + 2)
                b, a = cost(line[lo:hi]), cost(line[lo:i] + got + line[j:hi])
                if _accepted(b, a + STEP_COST) and b - a > least:
                    best, hit, least = line[:i] + got + line[j:], True, b - a
    return best, hit


def lost(span: str) -> bool:
    """No way back, yet surely garbled: replacement marks, controls, or rows of implausible characters."""
    if HARD.search(span):
        return True
    runs = [m[0] for m in _RUN.finditer(span)]
    return any(len(r) >= 6 and cost(r) / len(r) > RESIDUE and not set(map(char_class, r)) <= set("abgAqhkj") for r in runs)


_KANA, _HALF = re.compile("[\u3041-\u30fa]"), re.compile("[\uff66-\uff9f]")
_CONTINUED = "".join(re.escape(c) for c in map(chr, sorted({ord(bytes([b]).decode("cp1251", "ignore") or "\x98") for b in range(0x80, 0xC0)})) if ord(c) not in LOOKALIKES)
_CP1251 = re.compile(f"[ВГвгдежзий][{_CONTINUED}]")  # the first of two or more bytes of UTF-8, and a byte that goes on
_SQUEEZED = re.compile("(?<![^\\s(])[｡-ﾟ]{1,2}(?=[0-9A-Za-z])")
_CP437 = re.compile("[σπΣτΘΦ][^\x00-\x7f\u0370-\u03ff]")


def settle(line: str) -> str:
    """The line without what is unusual but right: invisible characters, width variants, look-alike letters."""
    line = INVISIBLE.sub("", line) if not HARD.search(line) and not _NEAR_C2.search(line) else line
    if "──" in line:  # a drawn table, not a code page misread
        line = re.sub("[─│┌┐└┘├┤┬┴┼]", "", line)
    if not HARD.search(line):
        half = len(_HALF.findall(line))
        if half and len(_KANA.findall(line)) >= half and not _SQUEEZED.search(line) or not half and not _CP1251.search(line) and not _CP437.search(line) and oddness(line.translate(LOOKALIKES)) < ODD:
            return skeleton(line)
    return line


LOOK_GAIN = 0.3


def _cut_mark(line: str) -> tuple[str, str]:
    """The line without the mark that cuts a word at its end."""
    m = re.search("[¬\u00ad\u2010-]*[ \r]*\\Z", line)
    return line[: m.start()], line[m.start() :]


_NEAR_C2 = re.compile("[À-ÿ]\u00ad|\u00ad[À-ÿ]")

# One-byte readers that turn a letter into another sign, and what else may rightly stand within a word.
SIGN_READERS = ("cp437", "cp850", "mac_roman", "cp1251")
_RIGHT_IN_WORD = frozenset("·°²µªº–—’‘“”„‚…•\u00a0\u00ad«»‹›ß")
_UNIT = re.compile("[cdkmN]{0,2}m[²³]|[kM]Ω")
# a sharp s read as the ligature fl: right as fl before most vowels, but not at these
_SHARP = re.compile("ﬂ(?![aeiouyäöü\\w])|ﬂ(?=[b-df-hj-np-tv-xz])|(?:(?:[aA]u|[äÄ]u|[gG]r[oö]|[gG]rü|[sS]tra|[mM][aä]|[hH]ei|[wW]ei|ie|[fFsSbB]ü|[sS]to|[bB]lo|[dD]rei)ﬂ)(?=e)(?!eg)|[dD]reiﬂ(?=ig)")


@lru_cache(maxsize=1)
def _signs() -> dict[str, tuple[dict[str, str], re.Pattern, re.Pattern]]:
    """Of every such reader: sign -> the letter meant, the signs that are surely wrong within or at the end of a word, and all of them."""
    out = {}
    for reader in SIGN_READERS:
        meant = {}
        for b in (0x9C, 0xDF, *range(0xE0, 0xF0), *range(0xF1, 0xF7), *range(0xF8, 0xFD)):
            try:
                sign = bytes([b]).decode(reader)
            except UnicodeDecodeError:
                continue
            if sign not in _RIGHT_IN_WORD and ord(sign) not in LOOKALIKES and not ("ß" < sign <= "ÿ" and sign not in "÷þ"):
                meant[sign] = bytes([b]).decode("cp1252")
        sure = "".join(re.escape(c) for c in meant if c != "ﬂ")
        end = "".join(c for c in meant if c != "ﬂ" and (c.isalpha() or c == "▀"))
        # the sign first: it is rarer than the letter before it
        within = re.compile(f"[{sure}](?<=[A-Za-zß-ÿ].)(?=[{sure}ﬂ]?[a-zß-ÿ])|[{sure}](?<=[A-Za-zß-ÿ][{sure}].)(?=[a-zß-ÿ])|[{end}](?<=[a-zß-ÿ]{{2}}.)(?!\\w)")
        out[reader] = meant, within, re.compile(f"[{''.join(map(re.escape, meant))}](?:(?<=[A-Za-zß-ÿ].)|(?=[a-zß-ÿ]))")
    return out


_WORD = re.compile("\\S+")


def _marks(line: str, reader: str) -> int:
    """Signs of the line that this reader surely made of letters."""
    n = len(_SHARP.findall(line)) if reader == "mac_roman" and "ﬂ" in line else 0
    within = _signs()[reader][1]
    return n + (sum(len(within.findall(w[0])) for w in _WORD.finditer(line) if not _UNIT.match(w[0])) if within.search(line) else 0)


def single_letters(lines: list[str]) -> list[str | None]:
    """Each line with single letters put right that a one-byte reader took for signs; None where there are none.

    One reader is chosen for the page: that of the most such signs.  A sign
    which alone could be right is put back in the lines that hold a sure one.
    """
    out: list[str | None] = [None] * len(lines)
    marks = {reader: [0 if x.isascii() else _marks(x, reader) for x in lines] for reader in SIGN_READERS}
    for reader in sorted(SIGN_READERS, key=lambda r: -sum(marks[r])):
        meant, _, loose = _signs()[reader]
        for i, n in enumerate(marks[reader]):
            if n and out[i] is None:
                out[i] = loose.sub(lambda m: meant[m[0]], lines[i])
    return out


def _maybe_signs() -> re.Pattern:
    every = "".join(sorted({re.escape(c) for meant, _, _ in _signs().values() for c in meant}))
    return re.compile(f"[{every}](?<=[A-Za-zß-ÿ].|[^\\x00-\\x7f].)")


SIGNS = _maybe_signs()  # derived from the readers' tables


def restore(text: str | None) -> tuple[str | None, bool, bool]:
    """(text with garbled spans restored, whether any span was garbled, whether some of it is lost)."""
    return traced(text)[:3]


def traced(text: str | None) -> tuple[str | None, bool, bool, str | None]:
    """(text with garbled spans restored, whether any span was garbled, whether some of it is lost, by what it was found).

    Found by "search" where a path of steps leads to a cheaper text, by
    "letters" where single signs were put back by their place in a word, and by
    "marks" where nothing leads back from replacement marks or rows of
    implausible characters.  Null gives (null, False, False, null); an empty or
    sound text comes back as it is.
    """
    if not text:
        return text, False, False, None
    out, how, gone = [], set(), False
    sound = []  # numbers of the lines that hold no longer garbled span
    for line in text.split("\n"):
        if not ESCAPED.search(line) and (line.isascii() and not HARD.search(line) or oddness(line) < ODD or oddness(settle(line)) < ODD):
            sound.append(len(out))
            out.append(line)
            continue
        settled = settle(line)
        body, tail = _cut_mark(settled)
        fixed, hit = repair_span(body)
        if hit and not HARD.search(line) and not _HALF.search(line) and cost(skeleton(body)) < cost(fixed) - LOOK_GAIN:
            fixed, hit = body, False  # folding its look-alikes makes the cheaper text
        fixed += tail
        if hit:
            how.add("search")
        if HARD.search(line) or (not hit and lost(settled) and lost(settled.translate(LOOKALIKES))):
            if not hit:
                how.add("marks")
            gone = gone or bool(HARD.search(fixed)) or not hit
        elif not hit:
            sound.append(len(out))
        out.append(fixed if hit else line)
    if SIGNS.search(text):
        for i, fixed in zip(sound, single_letters([out[i] for i in sound]), strict=True):
            if fixed is not None:
                out[i] = fixed
                how.add("letters")
    return "\n".join(out), bool(how), gone, next((x for x in ("search", "letters", "marks") if x in how), None)
