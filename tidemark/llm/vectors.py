"""Tables of vectors: which rows take part, and blocks of queries against blocks of candidates."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(df: DataFrame, id_column: str, vector: str, zero_too: bool) -> DataFrame:
    """(id, v): one row an id, for vectors of finite components; zero_too: also vectors of zeros.

    Null ids and null vectors take no part. Of rows that share an id the greatest vector stands for all.
    """
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))  # NaN is above infinity
    kept = df.where(F.col(id_column).isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)))
    if not zero_too:
        kept = kept.where(F.exists(v, lambda x: x != 0))
    return kept.groupBy(F.col(id_column).alias("id")).agg(F.max(v).alias("v"))


def cut(name: str | Column, parts: int) -> Column:
    """An even part number for every value, by its hash."""
    return F.pmod(F.xxhash64(F.lit(parts), name), F.lit(parts)).cast("int")


def spread(df: DataFrame, name: str, parts: int) -> DataFrame:
    """Every row once for each part number."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))


def best(df: DataFrame, k: int) -> DataFrame:
    """Of (query_id, vec_id, score) each query's k highest scores, ties to the smaller vec_id, with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def matrix(column: pd.Series, dtype) -> np.ndarray:
    rows = column.to_list()
    return np.array(rows, dtype=dtype).reshape(len(rows), -1)


def block_matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The lists of an Arrow column, all of one length and without nulls, as rows."""
    n = len(column)
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).reshape(n, -1) if n else np.zeros((0, 0))


def top_rows(scores: np.ndarray, ids: np.ndarray, k: int, at: np.ndarray) -> np.ndarray:
    """Of the places `at` the k with the highest scores, ties to the smaller id."""
    if len(at) > k:
        least = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= least]
    return at[np.lexsort((ids[at], -scores[at]))[:k]]
