"""Similarity of adjacent pages as column expressions; the hash embedding's cosine is an Arrow UDF."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafline.functions.text import col

#: Dimensions of the hash embedding.
DIMENSIONS = 384
#: Fixed value: capitalised names, long numbers and amounts.
ENTITY = r"\b[A-Z][a-z]+(?:\s[A-Z][a-z]+)*\b|\b\d{4,}\b|\$[\d,.]+"


def bucket(word: str | Column, dimensions: int = DIMENSIONS) -> Column:
    """MD5 of the word modulo the dimensions, in 64-bit steps."""
    h = F.md5(col(word))
    piece = lambda a, n: F.conv(F.substring(h, a, n), 16, 10).cast("long") % dimensions
    # 16 ** 17 and 16 ** 2 by their remainders
    high, mid = pow(16, 17, dimensions), pow(16, 2, dimensions)
    return ((high * piece(1, 15) + mid * piece(16, 15) + piece(31, 2)) % dimensions).cast("int")


def space_words(text: str | Column) -> Column:
    """Lower-cased pieces between white space, with repeats."""
    return F.filter(F.split(F.lower(col(text)), r"(?U)\s+"), lambda w: w != "")


class _Buckets(dict):
    """Buckets of words met so far in this worker."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = b = int(hashlib.md5(word.encode()).hexdigest(), 16) % DIMENSIONS
        return b


_known = _Buckets()
#: Pairs of texts whose embeddings are held at once.
_ROWS = 1_000


def _embedded(texts: list) -> np.ndarray:
    """A row of word counts by bucket for each text."""
    words = [(t or "").lower().split() for t in texts]
    rows = np.repeat(np.arange(len(texts)), [len(w) for w in words])
    buckets = np.fromiter((_known[w] for each in words for w in each), np.int64, len(rows))
    return np.bincount(rows * DIMENSIONS + buckets, minlength=len(texts) * DIMENSIONS).reshape(len(texts), DIMENSIONS).astype(float)


@F.pandas_udf(T.DoubleType())
def hash_cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    """Cosine of the hash embeddings of two texts; 0 where either has no words."""
    out = np.zeros(len(a))
    for k in range(0, len(a), _ROWS):
        p, q = (_embedded(x.iloc[k : k + _ROWS].tolist()) for x in (a, b))
        norm = np.sqrt((p * p).sum(axis=1) * (q * q).sum(axis=1))
        out[k : k + _ROWS] = np.divide((p * q).sum(axis=1), norm, out=np.zeros(len(p)), where=norm > 0)
    return pd.Series(out)


def ratio(a: Column, b: Column) -> Column:
    """Smaller by larger; 1 when both are zero, 0 when one is."""
    return F.when((a == 0) & (b == 0), 1.0).when((a == 0) | (b == 0), 0.0).otherwise(F.least(a, b) / F.greatest(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets; 0 when either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def entities(text: str | Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(col(text), F.lit(ENTITY), F.lit(0)))


def layout(a: str, b: str) -> Column:
    """Block counts and page sizes; sizes lose their fractions."""
    size = lambda k: ratio(F.col(f"{a}.{k}").cast("int"), F.col(f"{b}.{k}").cast("int"))
    return (ratio(F.col(f"{a}.block_count"), F.col(f"{b}.block_count")) + (size("width") + size("height")) / 2) / 2


def _profile(page: str) -> list[Column]:
    blocks = F.col(f"{page}.blocks")
    y, n = F.transform(blocks, lambda x: x["y0"]), F.size(blocks)
    mean_x = F.aggregate(blocks, F.lit(0.0), lambda t, x: t + x["x0"]) / n
    heads = F.size(F.filter(blocks, lambda x: x["is_heading"])) / n
    return [F.array_min(y) / 1000, F.array_max(y) / 1000, mean_x / 1000, n / 50, heads]


def block_positions(a: str, b: str) -> Column:
    """One minus the mean difference of the block profiles; 0 without blocks on a side."""
    difference = sum((F.abs(x - y) for x, y in zip(_profile(a), _profile(b))), F.lit(0.0)) / 5
    empty = (F.size(f"{a}.blocks") < 1) | (F.size(f"{b}.blocks") < 1)
    return F.when(empty, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - difference))


def headings(page: str) -> Column:
    return F.size(F.filter(f"{page}.blocks", lambda x: x["is_heading"]))
