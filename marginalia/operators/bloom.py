"""A blocked Bloom filter made of built-in bitmap functions.

Every key sets ``HASHES`` bits of one block of 32,768 bits. The filter is a DataFrame of (block, words) with 8 KB a row;
it is built by a map-side combined aggregate and probed by a broadcast join of proven size: the number of blocks is fixed
from the number of keys and never exceeds ``max_blocks`` (32 MB at the default). With more keys than that can separate, more
probes come out positive, which costs time in the exact join behind the filter and never changes a result. Two hashes of a
key give its block and all its bits; a probe is six array accesses in generated code.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 32768
HASHES = 6


@dataclass(frozen=True)
class BloomFilter:
    bits: DataFrame
    blocks: int

    def probe(self, df: DataFrame, key: str, flag: str = "maybe") -> DataFrame:
        """``df`` with a boolean ``flag``: false proves that ``key`` is not among the filter's keys. A null key gives false."""
        h, g = F.xxhash64(key), F.xxhash64(key, F.lit(1))
        hashed = df.select("*", h.alias("__h"), g.alias("__g")).withColumn("__block", _block(F.col("__g"), self.blocks))
        probed = hashed.join(F.broadcast(self.bits.select("__block", "__words")), "__block", "left")
        hit = F.col("__words").isNotNull() & F.col(key).isNotNull()
        for position in _positions(F.col("__h"), F.col("__g")):
            # words hold four bytes, the first of them as the highest
            word, bit = F.get("__words", F.shiftright(position, 5).cast("int")), (F.lit(3) - F.shiftright(position, 3).bitwiseAND(F.lit(3))) * 8 + position.bitwiseAND(F.lit(7))
            hit = hit & (F.getbit(word, bit.cast("int")) == 1)
        return probed.select(*df.columns, F.coalesce(hit, F.lit(False)).alias(flag))


def build(keys: DataFrame, key: str, expected: int, bits_per_key: int = 12, max_blocks: int = 4096) -> BloomFilter:
    """The filter of column ``key`` of ``keys``; ``expected`` is an upper bound of the number of distinct keys. Nulls are left out."""
    blocks = max(1, min(max_blocks, -(-max(1, expected) * bits_per_key // BLOCK_BITS)))
    hashed = keys.where(F.col(key).isNotNull()).select(F.xxhash64(key).alias("h"), F.xxhash64(key, F.lit(1)).alias("g"))
    set_bits = hashed.select(_block(F.col("g"), blocks).alias("__block"), F.explode(F.array(*_positions(F.col("h"), F.col("g")))).alias("__pos"))
    made = set_bits.groupBy("__block").agg(F.bitmap_construct_agg("__pos").alias("__bits"))
    words = F.transform(F.sequence(F.lit(0), F.lit(BLOCK_BITS // 32 - 1)), lambda i: F.conv(F.hex(F.substring(F.col("__bits"), i * 4 + 1, F.lit(4))), 16, 10).cast("long"))
    return BloomFilter(made.select("__block", words.alias("__words")), blocks)


def _block(g: Column, blocks: int) -> Column:
    return F.pmod(F.shiftright(g, 30), F.lit(blocks)).cast("int")


def _positions(h: Column, g: Column) -> list[Column]:
    """Four groups of 15 bits of the first hash, two of the second."""
    return [F.shiftright(x, 15 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)) for x, n in ((h, 4), (g, 2)) for i in range(n)]
