"""Problem 1: near-duplicate texts by multi-index hashing.

A text's fingerprint is a string of 60 one-byte symbols, symbol i being the low
byte of the i-th minimum hash of its distinct 5-character pieces, so that the
Hamming distance of two fingerprints (symbols that differ) estimates the
Jaccard distance of their pieces.  The fingerprint is cut into 12 segments of 5
symbols.  In each segment the Hamming ball of radius 1 is enumerated: its codes
are the five patterns that leave one symbol open, and two segments lie within
distance 1 exactly if they share a pattern.  Rows that share a pattern in a
segment are fetched from that segment's table, the complete distance decides
which go on, and an exact comparison of the pieces settles each pair.

A distance of up to 23 of 60 is found for certain (two mismatches in each of 12
segments need 24), more by chance: at a similarity of 0.6 a pair is missed with
probability 0.7 %, at 0.75 with less than 1e-5.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.operators.arrow import flat_map
from folioscan.operators.checkpoints import ensure_checkpoint_dir
from folioscan.operators.components import components
from folioscan.operators.skew import spread_join

PIECE = 5
SYMBOLS = 60
SEGMENT = 5
WORDS = -(-SYMBOLS // 8)
MAX_DISTANCE = 38  # of 60; 24 are expected at a similarity of 0.6, with a deviation of 3.8

_rng = np.random.default_rng(20240607)
_MUL = _rng.integers(1, 2**63, SYMBOLS, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64)
_MIX = _rng.integers(1, 2**63, PIECE, dtype=np.uint64) | np.uint64(1)


def pieces(text: str) -> np.ndarray:
    """Hashes of the distinct runs of five neighbouring characters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(points) < PIECE:
        return np.empty(0, np.uint64)
    n = len(points) - PIECE + 1
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(PIECE):
            h = (h ^ points[i : i + n]) * _MIX[i]
            h ^= h >> np.uint64(29)
    return np.unique(h)


def fingerprint(text: str) -> np.ndarray:
    """60 symbols of one byte."""
    h = pieces(text)
    if not len(h):
        return np.zeros(SYMBOLS, np.uint8)
    out = np.empty(SYMBOLS, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(SYMBOLS):
            v = h * _MUL[i] + _ADD[i]
            v ^= v >> np.uint64(32)
            out[i] = v.min()
    # the minimum's high bits are all small: mix before taking a byte
    with np.errstate(over="ignore"):
        out = out * np.uint64(0x9E3779B97F4A7C15)
    return (out >> np.uint64(56)).astype(np.uint8)


def ball_keys(symbols: np.ndarray) -> np.ndarray:
    """One key for each segment and open position: the codes of the segment's ball of radius 1."""
    cut = symbols.reshape(-1, SEGMENT).astype(np.uint64) + np.uint64(1)
    number = np.arange(len(cut), dtype=np.uint64)[:, None]
    with np.errstate(over="ignore"):
        codes = []
        for hole in range(SEGMENT):
            kept = cut.copy()
            kept[:, hole] = 0
            # exact packing: five symbols of 9 bits, the segment's number above them
            packed = np.zeros(len(cut), np.uint64)
            for i in range(SEGMENT):
                packed = (packed << np.uint64(9)) | kept[:, i]
            codes.append(packed)
        return (np.stack(codes, 1) | (number << np.uint64(46))).astype(np.int64).ravel()


@functools.lru_cache(maxsize=256)  # pairs of one text come one after another
def _piece_set(text: str) -> frozenset[str]:
    return frozenset(text[i : i + PIECE] for i in range(len(text) - PIECE + 1))


def jaccard(a: str, b: str) -> float:
    """Of the distinct 5-character pieces, exactly."""
    x, y = _piece_set(a), _piece_set(b)
    both = len(x & y)
    return both / (len(x) + len(y) - both) if x or y else 1.0


def _rows(df: DataFrame, key: str, path: str, text: str, least: int) -> DataFrame:
    """(key, path, text_hash, text) of the rows with a text of at least *least* characters."""
    slim = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{path}`").alias("path"), F.col(f"`{text}`").alias("text"))
    return slim.where(F.length("text") >= least).select("key", "path", F.sha2("text", 256).alias("text_hash"), "text")


def links(df: DataFrame, key: str, path: str, text: str, similarity: float = 0.6, least: int = 200) -> tuple[DataFrame, DataFrame]:
    """Links between different texts, and the rows of each text.

    The first frame is (hash_a, hash_b, similarity), one row per pair of
    different texts whose similarity is *similarity* or more; the second is
    (key, path, text_hash), the rows of every text.  Null and short texts are
    in neither; repeated rows are one row.
    """
    rows = _rows(df, key, path, text, least)
    ensure_checkpoint_dir(df.sparkSession)
    members = rows.select("key", "path", "text_hash").distinct().checkpoint()  # read three times by the callers
    texts = rows.groupBy("text_hash").agg(F.first("text").alias("text"))

    def kernel(h, t):
        symbols = fingerprint(t)
        yield h, packed(symbols), ball_keys(symbols).tolist()

    # read four times below: kept once, at some 550 bytes a text
    prints = flat_map(texts, kernel, "text_hash string, symbols array<bigint>, keys array<bigint>").withColumn("id", F.xxhash64("text_hash")).checkpoint()
    # one table per segment and open position, all in one frame: the key names its table
    entries = prints.select(F.explode("keys").alias("code"), "id")
    # a notice with very many versions puts them all under the same codes
    a, b = entries.select(F.col("code").alias("ca"), F.col("id").alias("a")), entries.select(F.col("code").alias("cb"), F.col("id").alias("b"))
    found = spread_join(a, b, "ca", "cb", "a", one_in=16, right_id="b").where("a < b").select("a", "b").distinct()
    marks = prints.select("id", "text_hash", F.struct(*[F.col("symbols")[i].alias(f"s{i}") for i in range(WORDS)]).alias("s"))
    near = (
        found.join(marks.select(F.col("id").alias("a"), F.col("text_hash").alias("hash_a"), F.col("s").alias("sa")), "a")
        .join(marks.select(F.col("id").alias("b"), F.col("text_hash").alias("hash_b"), F.col("s").alias("sb")), "b")
        .where(_distance("sa", "sb") <= MAX_DISTANCE)
        .select("hash_a", "hash_b")
    )
    pairs = near.join(texts.select(F.col("text_hash").alias("hash_a"), F.col("text").alias("ta")), "hash_a").join(
        texts.select(F.col("text_hash").alias("hash_b"), F.col("text").alias("tb")), "hash_b"
    )

    def settle(a, b, x, y):
        j = jaccard(x, y)
        if j >= similarity:
            yield a, b, j

    # kept: the callers read it in both directions, and each pair is to be compared once
    return flat_map(pairs.select("hash_a", "hash_b", "ta", "tb"), settle, "hash_a string, hash_b string, similarity double").checkpoint(), members


def packed(symbols: np.ndarray) -> list[int]:
    """The symbols, one to a byte, in 64-bit words."""
    padded = np.zeros(WORDS * 8, np.uint8)
    padded[: len(symbols)] = symbols
    return padded.view(np.int64).tolist()


def _distance(a: str, b: str) -> Column:
    """Symbols that differ: of each word's differing bits, those of one byte are drawn together into its lowest and counted."""
    total = F.lit(0)
    for i in range(WORDS):
        x = F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))
        for n in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, n))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return total


def near_pairs(df: DataFrame, key: str, path: str, text: str, similarity: float = 0.6, least: int = 200) -> DataFrame:
    """(key_a, key_b), key_a < key_b, of rows with different path and similar text."""
    linked, members = links(df, key, path, text, similarity, least)
    both = linked.select("hash_a", "hash_b").unionByName(linked.select(F.col("hash_b").alias("hash_a"), F.col("hash_a").alias("hash_b")))
    left = members.select(F.col("key").alias("ka"), F.col("path").alias("pa"), F.col("text_hash").alias("hash_a"))
    right = members.select(F.col("key").alias("kb"), F.col("path").alias("pb"), F.col("text_hash").alias("hash_b"))
    linked_to = left.join(both, "hash_a").select("ka", "pa", F.col("hash_b").alias("hash_l"))
    # a text with itself and with the texts it is linked to, in one join; copies may be very many
    ends = linked_to.unionByName(left.select("ka", "pa", F.col("hash_a").alias("hash_l")))
    pairs = spread_join(ends, right, "hash_l", "hash_b", "ka").where("ka < kb and pa <> pb").select("ka", "kb")
    return pairs.select(F.col("ka").alias(f"{key}_a"), F.col("kb").alias(f"{key}_b")).distinct()


def groups(df: DataFrame, key: str, path: str, text: str, similarity: float = 0.6, least: int = 200) -> DataFrame:
    """(key, group_id, n_links): one row per key, with the smallest text hash of its group and its text's links.

    Texts below *least* characters are grouped with their exact copies only and
    have no links; a null text has no group.
    """
    linked, members = links(df, key, path, text, similarity, least)
    of = components(linked, "hash_a", "hash_b")
    ends = linked.select(F.col("hash_a").alias("text_hash")).unionAll(linked.select("hash_b"))
    counts = ends.groupBy("text_hash").count()
    t = F.col(f"`{text}`")
    short = df.where(t.isNull() | (F.length(t) < least)).select(F.col(f"`{key}`").alias("key"), F.sha2(t, 256).alias("text_hash"))
    return (
        members.select("key", "text_hash")
        .unionByName(short)
        .distinct()
        .join(of.withColumnRenamed("node", "text_hash"), "text_hash", "left")
        .join(counts, "text_hash", "left")
        .groupBy(F.col("key").alias(key))
        .agg(F.min(F.coalesce("component", "text_hash")).alias("group_id"), F.max(F.coalesce("count", F.lit(0))).alias("n_links"))
    )
