"""Ordered folds over keys of any size: a key's rows in slices, each told what all slices before it come to.

A slice is a fixed range of an ascending number, so no task holds more of a key than that; what the slices before come to is
found from one row a slice, in windows of at most WIDTH of these, of groups of WIDTH, and of groups of groups.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.scratch import materialise

SLICE, WIDTH = 4096, 1024


def slice_of(seq: str, size: int = SLICE) -> Column:
    return F.floor(F.col(seq) / size)


def _last(value: str, order: str) -> Column:
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order)))


#: How two neighbours are added up, and how many rows are: sum, max, or the last that is not null.
MERGES: dict[str, tuple[Callable[..., Column], Callable[[str, str], Column]]] = {
    "sum": (lambda *c: sum((F.coalesce(x, F.lit(0)) for x in c[1:]), F.coalesce(c[0], F.lit(0))), lambda v, o: F.sum(v)),
    "max": (lambda *c: F.greatest(*c), lambda v, o: F.max(v)),
    "last": (lambda *c: F.coalesce(*c), _last),
}


def carried(slices: DataFrame, keys: list[str], values: dict[str, str]) -> DataFrame:
    """slices (keys, _slice, and a row each) with _before_<value> for each value: its sum, max or last over all earlier slices of the key."""

    def level(rows: DataFrame, at: str, whole: bool) -> DataFrame:
        w = Window.partitionBy(*keys, *([] if whole else [F.floor(F.col(at) / WIDTH)])).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumns({f"_in_{v}": F.last(v, ignorenulls=True).over(w) if how == "last" else MERGES[how][1](v, at).over(w) for v, how in values.items()})

    def up(rows: DataFrame, at: str, to: str) -> DataFrame:
        return rows.groupBy(*keys, F.floor(F.col(at) / WIDTH).alias(to)).agg(*[MERGES[how][1](v, at).alias(v) for v, how in values.items()])

    one = up(slices, "_slice", "_up1")
    two = up(one, "_up1", "_up2")
    rows = level(slices, "_slice", False).withColumns({"_up1": F.floor(F.col("_slice") / WIDTH), "_up2": F.floor(F.col("_slice") / WIDTH**2)})
    for upper, at in ((level(one, "_up1", False), "_up1"), (level(two, "_up2", True), "_up2")):
        named = upper.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(at).alias("_k_at"), *[F.col(f"_in_{v}").alias(f"{at}_{v}") for v in values])
        same = F.col("_k_at") == F.col(at)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        rows = rows.join(named, same, "left").drop("_k_at", *[f"_k_{k}" for k in keys])
    before = {f"_before_{v}": MERGES[how][0](F.col(f"_in_{v}"), F.col(f"_up1_{v}"), F.col(f"_up2_{v}")) for v, how in values.items()}
    return rows.withColumns(before).drop("_up1", "_up2", *[f"{p}_{v}" for p in ("_in", "_up1", "_up2") for v in values])


def with_carried(rows: DataFrame, slices: DataFrame, keys: list[str]) -> DataFrame:
    """rows (with _slice) and the columns of their slice's row."""
    named = slices.withColumnsRenamed({c: f"_k_{c}" for c in (*keys, "_slice")})
    same = F.col("_slice") == F.col("_k__slice")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(named, same, "left").drop("_k__slice", *[f"_k_{k}" for k in keys])


def entering(maps: DataFrame, key: str, start: int, most: int, width: int = 256) -> DataFrame:
    """key, _slice, state (and, with a `counts`, count before it) at which every slice is entered, from maps of entering to leaving states.

    maps: key, _slice (0 to most), leaves (array: the state in which a slice is left that was entered in state i) and counts
    (array: what it adds up to on the way). Slices are composed in groups of `width`, groups in groups, and the states handed
    down again: nobody holds more than `width` maps.
    """
    kind = maps.schema[key].dataType.simpleString()

    def walk(pdf: pd.DataFrame, state: int, count: int) -> tuple[list[tuple], int, int]:
        out = []
        for at, leaves, counts in zip(pdf["_slice"], pdf["leaves"], pdf["counts"]):
            out.append((at, state, count))
            state, count = int(leaves[state]), count + int(counts[state])
        return out, state, count

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_slice")
        state, count = pdf["leaves"].iloc[0], pdf["counts"].iloc[0]
        for leaves, counts in zip(pdf["leaves"].iloc[1:], pdf["counts"].iloc[1:]):
            state, count = leaves[state], count + counts[state]
        return pd.DataFrame({key: [pdf[key].iloc[0]], "_slice": [pdf["_up"].iloc[0]], "leaves": [state], "counts": [count]})

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_slice")
        out, _, _ = walk(pdf, int(pdf["state"].iloc[0]), int(pdf["count"].iloc[0]))
        return pd.DataFrame([(pdf[key].iloc[0], *r) for r in out], columns=[key, "_slice", "state", "count"])

    shape = f"{key} {kind}, _slice long, state int, count long"
    if most < width:
        first = maps.withColumns({"state": F.lit(start), "count": F.lit(0).cast("long")})
        return first.groupBy(key).applyInPandas(spread, shape)
    grouped = maps.withColumn("_up", F.floor(F.col("_slice") / width))
    composed = materialise(grouped.groupBy(key, "_up").applyInPandas(compose, f"{key} {kind}, _slice long, leaves array<int>, counts array<long>"), "composed")
    above = entering(composed, key, start, most // width, width).withColumnRenamed("_slice", "_up")
    return with_up(grouped, above, key).groupBy(key, "_up").applyInPandas(spread, shape)


def with_up(rows: DataFrame, above: DataFrame, key: str) -> DataFrame:
    named = above.select(F.col(key).alias("_k"), F.col("_up").alias("_k_up"), "state", "count")
    return rows.join(named, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_up") == F.col("_k_up"))).drop("_k", "_k_up")
