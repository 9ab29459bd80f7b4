"""Problem 7: evaluation items that leaked into the corpus.

One Aho-Corasick automaton holds blocks of the normalised questions and
passages; each document is normalised and scanned once, and every hit is grown
to the full common run before it counts.  A run of n letters and digits always
covers one whole block of n // 2 cut at multiples of n // 2, so no run is missed.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.operators.arrow import flat_map, spread

MIN_RUN = 48  # letters and digits in a row
MIN_RUN_JA = 24  # the same for items whose lang is ja
MAX_ITEM_CHARS = 8_000_000  # every worker process holds the automaton, at 66 MB a million: a larger query set goes in several calls


def fold(text: str) -> str:
    """Letters and digits only, width and case folded."""
    return "".join(filter(str.isalnum, unicodedata.normalize("NFKC", text).lower()))


def fold_with_offsets(text: str) -> tuple[str, list[int]]:
    """The folded text and, of each of its characters, the offset in *text* it came from."""
    out, at = [], []
    base = 0
    for i in range(1, len(text) + 1):
        # a cluster is a character with the combining marks behind it
        if i < len(text) and unicodedata.combining(text[i]):
            continue
        part = fold(text[base:i])
        out.append(part)
        at += [base] * len(part)
        base = i
    return "".join(out), at


class Items:
    """The automaton over all blocks, built on first use in each process."""

    def __init__(self, rows: Iterable[tuple]):
        self.fields: list[tuple[int, str, str, int]] = []
        for item, lang, question, passage in rows:
            need = MIN_RUN_JA if lang == "ja" else MIN_RUN
            for name, text in (("question", question), ("passage", passage)):
                if text and len(folded := fold(text)) >= need:
                    self.fields.append((item, name, folded, need))
        self._automaton = None

    def __getstate__(self):
        return {"fields": self.fields, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            blocks: dict[str, list[tuple[int, int]]] = {}
            for f, (_, _, text, need) in enumerate(self.fields):
                size = need // 2
                for start in range(0, len(text) - size + 1, size):
                    blocks.setdefault(text[start : start + size], []).append((f, start))
            found = ahocorasick.Automaton()
            for block, where in blocks.items():
                found.add_word(block, (len(block), where))
            if blocks:
                found.make_automaton()
            self._automaton = found if blocks else False
        return self._automaton

    def runs(self, folded: str):
        """(field index, start in the document, start in the field, length) of each maximal run long enough."""
        automaton = self.automaton()
        if not automaton:
            return
        done: dict[tuple[int, int], int] = {}  # field and diagonal -> end of the run already grown
        for end, (size, where) in automaton.iter(folded):
            start = end - size + 1
            for f, at in where:
                item, name, text, need = self.fields[f]
                key = (f, start - at)
                if done.get(key, -1) > start:
                    continue
                i, j = start, at
                while i and j and folded[i - 1] == text[j - 1]:
                    i, j = i - 1, j - 1
                k, m = start + size, at + size
                while k < len(folded) and m < len(text) and folded[k] == text[m]:
                    k, m = k + 1, m + 1
                done[key] = k
                if k - i >= need:
                    yield f, i, j, k - i

    def scan(self, text: str | None):
        if not text:
            return
        folded = fold(text)
        hits = list(self.runs(folded))
        if not hits:
            return
        again, offsets = fold_with_offsets(text)
        same = again == folded  # else a composition reached over a cluster: offsets then are of the folded text
        for f, i, j, n in hits:
            item, name, _, _ = self.fields[f]
            yield item, name, (offsets[i] if same else i), (offsets[i + n - 1] + 1 if same else i + n), n


def items_of(eval_items: DataFrame) -> Items:
    """The query set, checked for its size before it is taken to the driver."""
    rows = eval_items.select("item_id", "lang", "question", "passage").where("item_id is not null")
    size = rows.agg(F.sum(F.coalesce(F.length("question"), F.lit(0)) + F.coalesce(F.length("passage"), F.lit(0)))).first()[0] or 0
    if size > MAX_ITEM_CHARS:
        raise ValueError(f"{size} characters of items: split the query set into calls of at most {MAX_ITEM_CHARS}")
    return Items([tuple(r) for r in rows.distinct().toLocalIterator()])


def leaks(documents: DataFrame, eval_items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, item_id, field, start, end, run): every passage of an item found in a document.

    start and end are offsets in the document's own text.  Null and empty texts
    and items hold nothing; repeated rows come out once; whole texts are scanned.
    """
    items = documents.sparkSession.sparkContext.broadcast(items_of(eval_items))  # held once by each worker process, of bounded size
    kind = documents.schema[key].dataType.simpleString()
    slim = documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).where("text is not null")

    def kernel(k, t):
        for hit in items.value.scan(t):
            yield k, *hit

    return flat_map(spread(slim), kernel, f"`{key}` {kind}, item_id {eval_items.schema['item_id'].dataType.simpleString()}, field string, start int, end int, run int").distinct()
