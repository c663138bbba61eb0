"""A Bloom filter as a small table: rows that surely lack a partner are left out before a shuffle.

A key sets two bits of one of ``words`` 64-bit words; the words that have bits are a table of
bounded size, which every task gets.  What passes still holds some rows without a partner,
so an exact join or aggregate follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = 4  # keys a word: one row in fifty passes by chance
WORDS = 1 << 20  # at most; more keys than four million let more rows pass


def _word(key: Column, words: int) -> Column:
    return key.bitwiseAND(F.lit(words - 1))


def _bits(key: Column) -> Column:
    one = F.lit(1).cast("long")
    first, second = F.shiftrightunsigned(key, 58).cast("int"), F.shiftrightunsigned(key, 52).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", one, first).bitwiseOR(F.call_function("shiftleft", one, second))


class Sieve:
    """Of ``keys``, a column ``key`` of 64-bit hashes in a stored table."""

    def __init__(self, keys: DataFrame):
        self.words = min(WORDS, 1 << max(6, (keys.count() // KEYS).bit_length()))
        self.table = keys.groupBy(_word(F.col("key"), self.words).alias("_word")).agg(F.bit_or(_bits(F.col("key"))).alias("_bits"))

    def marked(self, rows: DataFrame, key: Column, name: str) -> DataFrame:
        """``rows`` and ``name``: may ``key`` be among the keys?"""
        met = rows.withColumn("_key", key)
        met = met.join(F.broadcast(self.table), _word(F.col("_key"), self.words) == F.col("_word"), "left")
        has = F.coalesce(F.col("_bits").bitwiseAND(_bits(F.col("_key"))) == _bits(F.col("_key")), F.lit(False))
        return met.withColumn(name, has).drop("_key", "_word", "_bits")

    def passed(self, rows: DataFrame, key: Column) -> DataFrame:
        return self.marked(rows, key, "_may").where("_may").drop("_may")
