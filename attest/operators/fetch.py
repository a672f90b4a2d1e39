"""Late text: the rows of a large table that a bounded set of ids names, fetched once (T-10 .. T-12, A-02).

The ids make a Bloom filter of a bounded size, which every task holds; the scan of the large table drops what is surely not
asked for before anything is shuffled, and only the id goes to the filter. What is left joins the ids, so the result is exact.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialise

BITS = 1 << 26  # of the filter, at most: eight megabytes
PER_ID = 12  # bits for each id, a hundredth and less pass by chance; more where there are too many ids
PROBES = 4
_CHUNK = 32768  # bits of one bitmap


def _probes(key: str, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(i), F.col(key)), F.lit(bits)) for i in range(PROBES)]


def bloom(ids: DataFrame, key: str, n: int) -> np.ndarray:
    """The bits of n ids, put together by tasks; at most BITS of them come to the driver."""
    bits = min(BITS, max(_CHUNK, 1 << math.ceil(math.log2(max(1, n) * PER_ID))))
    at = ids.select(F.explode(F.array(*_probes(key, bits))).alias("at"))
    parts = at.groupBy(F.floor(F.col("at") / _CHUNK).cast("int").alias("part")).agg(F.bitmap_construct_agg(F.col("at") % _CHUNK).alias("bits")).collect()
    out = np.zeros((bits // _CHUNK, _CHUNK // 8), np.uint8)
    for r in parts:
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def maybe(rows: DataFrame, key: str, filter_bits: np.ndarray, others: bool = False) -> DataFrame:
    """The rows whose key may be one of the filter's ids; with `others` those whose key is surely none of them."""
    bits = len(filter_bits) * 8
    shared = rows.sparkSession.sparkContext.broadcast(filter_bits)

    @F.pandas_udf("boolean")
    def passes(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        ok = np.ones(len(a), bool)
        for at in (a, b, c, d):
            p = at.to_numpy()
            ok &= (shared.value[p >> 3] >> (p & 7) & 1).astype(bool)
        return pd.Series(ok, index=a.index)

    found = passes(*_probes(key, bits))
    return rows.where(~found if others else found)


def fetched(table: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The rows of a table whose key is among the ids, written out once for all that read them.

    ids may repeat; null ids name nothing. One pass over the table, in which its other columns stay where they are unless the row is asked for.
    """
    asked = materialise(ids.select(key).where(F.col(key).isNotNull()).distinct(), "asked-ids")
    return materialise(maybe(table, key, bloom(asked, key, asked.count())).join(asked, key, "left_semi").select(*table.columns), "fetched")
