"""What several corpus operators share: column picking, cut lineage, fixed-size key filters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cratemill.tables import discard, fresh, hot_keys, materialize, new_path, salted_join, scratch, shared_dir  # noqa: F401


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, however many others there are and whatever they are called (the first of equal names)."""
    cols = df.columns
    flat = df.toDF(*(f"c{i}" for i in range(len(cols))))
    return flat.select(*(F.col(f"c{cols.index(n)}").alias(n) for n in names))


def text_tag(text: Column) -> Column:
    """Tells apart rows that carry the same id: a 64-bit hash of the text (null as empty)."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def same(a: Column, b: Column) -> Column:
    """Null-safe equality."""
    return a.eqNullSafe(b)


class KeyFilter:
    """A bitmap of fixed size over 64-bit keys: says of a key that it is absent, or that it may be present.

    It only saves moving rows that cannot match; an exact join on the key always follows.  Its size (2**log2_bits / 8
    bytes, 2 MB by default) does not depend on the number of keys, so it can be broadcast whatever the data.
    """

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def of(cls, keys: DataFrame, column: str, log2_bits: int = 24) -> KeyFilter:
        words = np.zeros(1 << (log2_bits - 6), dtype=np.int64)
        found = (
            keys.where(F.col(column).isNotNull())
            .groupBy(F.expr(f"(shiftrightunsigned({column}, 6) & {len(words) - 1}L)").alias("word"))
            .agg(F.expr(f"bit_or(shiftleft(1L, cast({column} & 63L as int)))").alias("bits"))
            .toArrow()
        )
        words[found.column("word").to_numpy()] = found.column("bits").to_numpy()
        return cls(words.view(np.uint64))

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        word = self.words[((keys >> np.uint64(6)) & np.uint64(len(self.words) - 1)).astype(np.int64)]
        return ((word >> (keys & np.uint64(63))) & np.uint64(1)).astype(bool)
