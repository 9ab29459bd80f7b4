"""Problem 6: vector bin packing of token sequences into containers of fixed capacity.

Each item has three sizes: tokens, segments, and loss-bearing tokens (those
after the first line, which is the prompt).  A container is filled by taking,
again and again, the item that fits in all three and whose sizes have the
largest weighted dot product with what is left.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.operators.arrow import flat_map, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
CAPACITY = 2048
MAX_SEGMENTS = 64
MAX_LOSS = 2048  # of plain documents it can't bind, as none may be split that fits the capacity; instruction data take a lower one
GROUP_ITEMS = 10_000  # documents packed together; a group's sizes take a few hundred kB
GROUPS_A_TASK = 50  # groups that one task packs one after the other, where there are many
# Fixed value: the usual pattern that cuts a text before byte-pair merges.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def cuts(n: int, prompt: int, capacity: int, max_loss: int) -> Iterator[tuple[int, int]]:
    """(tokens, loss) of the parts of a document of *n* tokens, of which the first *prompt* bear no loss: as large as both limits allow."""
    while n > capacity or n - prompt > max_loss:
        size = min(capacity, prompt + max_loss)
        free = min(prompt, size)
        yield size, size - free
        n, prompt = n - size, prompt - free
    yield n, n - prompt


def sizes(df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, max_loss: int = MAX_LOSS) -> DataFrame:
    """(key, part, tokens, segments, loss): the items, of documents above a limit their parts.

    A null or empty text has no token and is an item of size 0 with no segment.
    Repeated rows are one item; different texts under one key are different items.
    """
    kind = df.schema[key].dataType.simpleString()
    slim = df.select(F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"), F.col(f"`{text}`").alias("text"))

    def kernel(k, h, t):
        enc = encoder(tokenizer)
        n = len(enc.encode_ordinary(t)) if t else 0
        line = t.find("\n") if t else -1
        prompt = min(n, len(enc.encode_ordinary(t[:line]))) if 0 < line < len(t) - 1 else 0
        for part, (size, loss) in enumerate(cuts(n, prompt, capacity, max_loss)):
            yield k, h, part, size, int(size > 0), loss

    rows = flat_map(spread(slim), kernel, f"key {kind}, text_hash bigint, part int, tokens int, segments int, loss int").distinct()
    return rows.select(F.col("key").alias(key), "part", "tokens", "segments", "loss")


def pack(vectors: np.ndarray, limits: tuple[int, int, int]) -> np.ndarray:
    """Container number of each row of *vectors* (tokens, segments, loss)."""
    lim = np.asarray(limits, dtype=np.float64)
    kinds, which = np.unique(vectors, axis=0, return_inverse=True)
    which = which.ravel()
    order = np.argsort(which, kind="stable")
    starts = np.searchsorted(which[order], np.arange(len(kinds)))
    left = np.bincount(which, minlength=len(kinds))
    used = np.zeros(len(kinds), dtype=np.int64)
    scaled = kinds / lim
    mean = scaled.mean(axis=0) if len(kinds) else np.ones(3)
    weight = mean / (mean.sum() or 1.0)
    weighted = scaled * weight
    out = np.empty(len(vectors), dtype=np.int64)
    alive = np.flatnonzero(left)
    container = 0
    while len(alive):
        rest = lim.copy()
        while True:
            fits = alive[(left[alive] > 0) & np.all(kinds[alive] <= rest, axis=1)]
            if not len(fits):
                break
            k = fits[np.argmax(weighted[fits] @ (rest / lim))]
            out[order[starts[k] + used[k]]] = container
            used[k] += 1
            left[k] -= 1
            rest -= kinds[k]
        container += 1
        alive = alive[left[alive] > 0]
    return out


def containers(
    df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS
) -> DataFrame:
    """(container, key, part, tokens, segments, loss), one row per item.

    Documents are spread evenly over groups by the hash of key and text, and
    each group is packed by itself, so that a task holds the sizes of one group
    at a time and no text.  Items never exceed a limit: a document is cut only
    where it alone exceeds one.  Repeated rows are packed once.
    """
    if min(capacity, max_segments, max_loss) < 1:
        raise ValueError("a limit below 1 leaves items that fit in no container")
    groups = max(1, -(-df.count() // GROUP_ITEMS))
    items = sizes(df, key, text, tokenizer, capacity, max_loss)
    kind = df.schema[key].dataType.simpleString()
    # each task gets the same number of groups, as even as it goes; they are small but slow
    tasks = min(groups, max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-groups // GROUPS_A_TASK)))
    bucket = F.pmod(F.xxhash64(key), F.lit(groups)).cast("int")
    grouped = items.withColumn("_bucket", bucket).repartitionById(tasks, F.pmod("_bucket", F.lit(tasks))).sortWithinPartitions("_bucket", key, "part", "tokens", "loss")
    schema = f"container string, `{key}` {kind}, part int, tokens int, segments int, loss int"

    def packed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        v = np.stack([t[c].to_numpy() for c in ("tokens", "segments", "loss")], 1).astype(np.float64)
        bucket = t["_bucket"][0].as_py()
        named = pa.array([f"{bucket}-{x}" for x in pack(v, (capacity, max_segments, max_loss)).tolist()], pa.string())
        whole = t.drop_columns("_bucket").add_column(0, "container", named)
        return whole.combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            numbers = batch["_bucket"].to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if held and held[0]["_bucket"][0].as_py() != numbers[a]:
                    yield packed(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield packed(held)

    return grouped.select(key, "part", "tokens", "segments", "loss", "_bucket").mapInArrow(run, schema)


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, items, tokens, and the share of the space that is used."""
    per = packed.groupBy("container").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    return per.agg(
        F.count("*").alias("n_containers"), F.sum("n").alias("n_items"), F.sum("t").alias("n_tokens"), F.max("t").alias("largest"), F.round(F.sum("t") / (F.count("*") * capacity), 4).alias("used")
    )
