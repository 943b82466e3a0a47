"""A Bloom filter of a key column, to leave out rows that can't find a partner before they are shuffled."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from postlens.session import ship_package

#: Bits of a filter at most: 8 MB. Beyond about ten million keys it lets more rows pass; it never holds one back wrongly.
MOST_BITS = 1 << 26
#: Bits for each key, and bits that a key sets.
BITS_A_KEY, SET = 10, 3
#: Bits of one row of Spark's bitmap functions.
_ROW_BITS = 32_768


def _positions(key: Column, bits: int) -> list[Column]:
    """The bits of a key, all from one hash: its lower half, then on by its odd upper half."""
    low, step = F.xxhash64(key).bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.xxhash64(key), 32).bitwiseOR(F.lit(1))
    return [F.pmod(low + k * step, F.lit(bits)) for k in range(SET)]


@dataclass
class BloomFilter:
    """``bitmap`` has a power of two of bits, from ``_ROW_BITS`` to ``MOST_BITS``."""

    bitmap: np.ndarray

    @classmethod
    def of(cls, df: DataFrame, key: str) -> "BloomFilter":
        """Counts the rows and sets their bits in Spark; the driver gets the finished bitmap, whose size is bounded."""
        wanted = max(df.count() * BITS_A_KEY, 1)
        bits = min(max(1 << (wanted - 1).bit_length(), _ROW_BITS), MOST_BITS)
        places = df.select(F.explode(F.array(*_positions(F.col(key), bits))).alias("at"))
        rows = places.groupBy(F.floor(F.col("at") / _ROW_BITS).alias("row")).agg(F.bitmap_construct_agg((F.col("at") % _ROW_BITS).cast("int")).alias("map"))
        bitmap = np.zeros(bits // 8, np.uint8)
        for r in rows.collect():
            own = np.frombuffer(bytes(r["map"]), np.uint8)
            bitmap[r["row"] * _ROW_BITS // 8 :][: len(own)] = own
        return cls(bitmap)

    def keep(self, df: DataFrame, key: str) -> DataFrame:
        """The rows whose key may be one of the filter's: all that are, and few others."""
        return df.filter(self._known(df, key))

    def split(self, df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        """The rows that ``keep`` keeps, and the others, none of which has a key of the filter."""
        known = self._known(df, key)
        return df.filter(known), df.filter(~known)

    def _known(self, df: DataFrame, key: str) -> Column:
        ship_package(df.sparkSession)
        shared = df.sparkSession.sparkContext.broadcast(self.bitmap)
        bits = 8 * len(self.bitmap)

        @F.arrow_udf("boolean")
        def known(*places: pa.Array) -> pa.Array:
            bitmap, found = shared.value, True
            for p in places:
                at = p.to_numpy()
                found = found & (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            return pa.array(found)

        return known(*_positions(F.col(key), bits))

    def places(self, df: DataFrame, keys: Column, out: str) -> DataFrame:
        """Add the places (from 0) of an array whose keys may be the filter's: looked up in the row, none is made a row.

        The lookup is marked non-deterministic only to keep Spark from moving it into expressions that can't hold Python.
        """
        import pandas as pd  # here, as workers that only need the rest of the module stay smaller without

        ship_package(df.sparkSession)
        shared = df.sparkSession.sparkContext.broadcast(self.bitmap)
        bits = 8 * len(self.bitmap)

        @F.pandas_udf("array<int>")
        def known(hashes: pd.Series) -> pd.Series:
            bitmap, found = shared.value, True
            lists = [np.zeros(0, np.int64) if h is None else h for h in hashes]
            sizes = np.array([len(h) for h in lists])
            key = np.concatenate(lists).astype(np.int64).view(np.uint64)
            low, step = key & np.uint64(0xFFFFFFFF), key >> np.uint64(32) | np.uint64(1)
            for k in range(SET):
                at = (low + np.uint64(k) * step) % np.uint64(bits)
                found = found & (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            row = np.repeat(np.arange(len(lists)), sizes)
            place = (np.arange(len(key)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
            return pd.Series(np.split(place[found], np.cumsum(np.bincount(row[found], minlength=len(lists)))[:-1])) if len(key) else pd.Series([place] * len(lists))

        return df.withColumn(out, known.asNondeterministic()(F.transform(keys, lambda key: F.xxhash64(key))))
