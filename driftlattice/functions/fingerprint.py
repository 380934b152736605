"""Keyed BLAKE3 (from its published specification) and fingerprints of node kinds and trees."""

from __future__ import annotations

import json
import struct
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed value: fingerprints of stored snapshots depend on it.
FINGERPRINT_KEY = b"sdi-rust::patterns::fingerprint!"

MASK = 0xFFFFFFFF
#: The initial words of BLAKE3, from its specification.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
#: The order of message words from one round to the next, from its specification.
PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT, KEYED = 1, 2, 4, 8, 16
MIXES = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))


def _compress(value, block: bytes, counter: int, flags: int) -> list[int]:
    words = list(struct.unpack("<16I", block.ljust(64, b"\0")))
    s = [*value, *IV[:4], counter & MASK, counter >> 32, len(block), flags]
    for turn in range(7):
        for k, (a, b, c, d) in enumerate(MIXES):
            for word, first, second in ((words[2 * k], 16, 12), (words[2 * k + 1], 8, 7)):
                s[a] = (s[a] + s[b] + word) & MASK
                x = s[d] ^ s[a]
                s[d] = (x >> first | x << 32 - first) & MASK
                s[c] = (s[c] + s[d]) & MASK
                x = s[b] ^ s[c]
                s[b] = (x >> second | x << 32 - second) & MASK
        if turn < 6:
            words = [words[p] for p in PERMUTATION]
    return [s[i] ^ s[i + 8] for i in range(8)]


def blake3(data: bytes, key: bytes | None = None) -> bytes:
    """32 bytes of (keyed) BLAKE3."""
    start = struct.unpack("<8I", key) if key else IV
    base = KEYED if key else 0

    def chunk(part: bytes, number: int, root: int):
        value = start
        blocks = [part[i : i + 64] for i in range(0, len(part), 64)] or [b""]
        for i, block in enumerate(blocks):
            flags = base | (CHUNK_START if i == 0 else 0) | (CHUNK_END | root if i == len(blocks) - 1 else 0)
            value = _compress(value, block, number, flags)
        return value

    def tree(first: int, last: int, root: int):
        if last - first == 1:
            return chunk(data[first * 1024 : last * 1024], first, root)
        middle = first + (1 << (last - first - 1).bit_length() - 1)  # the left side is the largest full tree
        both = struct.pack("<16I", *tree(first, middle, 0), *tree(middle, last, 0))
        return _compress(start, both, 0, base | PARENT | root)

    return struct.pack("<8I", *tree(0, max(1, -(-len(data) // 1024)), ROOT))


@lru_cache(4096)
def node_kind_fingerprint(kind: str) -> str:
    return blake3(kind.encode(), FINGERPRINT_KEY).hex()


def tree_fingerprint(kind: str, children=()) -> str:
    """children: (kind, children) pairs, or dicts with those names. A leaf is its kind's fingerprint."""
    pairs = [(c["kind"], c.get("children", ())) if isinstance(c, dict) else c for c in children]
    if not pairs:
        return node_kind_fingerprint(kind)
    inner = b"".join(b"\x01" + bytes.fromhex(tree_fingerprint(*c)) for c in pairs)
    return blake3(kind.encode() + b"\0" + inner, FINGERPRINT_KEY).hex()


@F.pandas_udf(StringType())
def _fingerprints(kinds: pd.Series) -> pd.Series:
    return kinds.map(lambda k: None if k is None else node_kind_fingerprint(k))


@F.pandas_udf(StringType())
def tree_fingerprints(trees: pd.Series) -> pd.Series:
    """Fingerprints of trees as JSON: {"kind": ..., "children": [...]}; null for null."""
    return trees.map(lambda t: None if t is None else tree_fingerprint((x := json.loads(t))["kind"], x.get("children", ())))


def with_fingerprints(df: DataFrame, kind: str = "node_kind", out: str = "fingerprint") -> DataFrame:
    """df with the fingerprint of each row's kind: hashed once for each distinct kind, which are as few as a grammar has."""
    kinds = df.select(F.col(kind).alias("__kind")).distinct()
    return df.join(F.broadcast(kinds.withColumn(out, _fingerprints("__kind"))), F.col(kind).eqNullSafe(F.col("__kind")), "left").drop("__kind")


def hex_problem(text: Column) -> Column:
    """Why a text is not a fingerprint, or null."""
    x = F.coalesce(text, F.lit(""))
    return F.when(F.length(x) != 64, "length").when(~x.rlike("^[0-9a-fA-F]{64}$"), "digit")
