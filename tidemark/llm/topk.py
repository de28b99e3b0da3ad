"""Op 5: exact top-k by inner product with a three-phase uniform threshold.

A score is the sum of `lists` partial scores, one over each part of the components. The parts are shards of
their own: a task has one part of a block of candidates and of a block of queries, and so one local score
list a query. Phase one gathers the heads of the local lists; the exact totals of these few candidates give
each query a cutoff that its k-th best score cannot be below. Phase two sends the cutoff back: a candidate
that reaches it has a partial score of at least cutoff / lists in some list, so only such entries are
collected. Phase three drops those that the lists which did not report them cannot lift to the cutoff, asks
those lists for the partial scores of the others, and so resolves them exactly.

Equal vectors are searched once: a group of them has its k + 1 smallest ids, which is all that a top-k with
ties to the smaller id can use, and rows that ask with equal vectors share one search.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise
from tidemark.llm.vectors import best, block_matrix, cut, spread, top_rows, usable

QUERY_BLOCK, CANDIDATE_BLOCK = 8192, 8192
AT_ONCE = 256  # queries of a block that are multiplied at once
EXACT = 1 << 53
MOST = (1 << 63) - 1
WIDE = 1 << 60  # totals of vectors that might pass it are computed beyond 64 bits
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
HEADS = 4  # times k: partial scores of a query and list that are resolved for its cutoff
CELLS = ["dim", "list", "_g", "_h"]


def quantise(vector: Column, scale: int = 1024) -> Column:
    """Whole numbers, those beyond 64 bits as the nearest of 64; null for a component that is not finite (NaN is above infinity)."""
    return F.transform(vector, lambda x: F.when(F.abs(x.cast("double")) < float("inf"), F.floor(F.lit(scale) * x.cast("double")).cast("long")))


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of all queries and candidates, exactly."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if most < EXACT:  # then doubles hold every sum exactly, and matrix products are fast
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def _wide_products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products beyond 64 bits, set to the ends of 64 bits."""
    return np.clip(q.astype(object) @ c.T.astype(object), -MOST - 1, MOST).astype(np.int64)


def _blocks(queries: pa.Table, candidates: pa.Table, products):
    """(ids of some queries, their rows in the table, ids of the candidates, products)."""
    if len(queries) and len(candidates):
        ids, c, q = candidates["id"].to_numpy(), block_matrix(candidates["v"]), block_matrix(queries["v"])
        for first in range(0, len(q), AT_ONCE):
            rows = np.arange(first, min(first + AT_ONCE, len(q)))
            yield queries["id"].to_numpy()[rows], rows, ids, products(q[rows], c)


def _found(parts: list[tuple], schema: pa.Schema = FOUND) -> pa.Table:
    columns = [np.concatenate([np.asarray(p[i]) for p in parts]) if parts else [] for i in range(len(schema))]
    return pa.table([pa.array(x, type=f.type) for x, f in zip(columns, schema)], schema=schema)


def _heads(k: int, products=_products):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out = []
        for own, _, ids, p in _blocks(queries, candidates, products):
            every = np.arange(len(ids))
            for i in range(len(own)):
                at = top_rows(p[i], ids, k, every)
                out.append((np.full(len(at), own[i]), ids[at], p[i, at]))
        return _found(out)

    return run


COLLECTED = pa.schema([*FOUND, ("cutoff", pa.int64()), ("list", pa.int32()), ("dim", pa.int32())])


def _local_heads(k: int):
    """The k highest partial scores of each query in the list of this block."""

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out = []
        for own, _, ids, p in _blocks(queries, candidates, _products):
            every = np.arange(len(ids))
            for i in range(len(own)):
                at = top_rows(p[i], ids, k, every)
                cell = [np.full(len(at), queries[c][0].as_py()) for c in ("list", "dim")]
                out.append((np.full(len(at), own[i]), ids[at], p[i, at], np.full(len(at), -MOST), *cell))
        return _found(out, COLLECTED)

    return run


def _collect(lists: int):
    """Partial scores of at least cutoff / lists; all of a query without a cutoff."""

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out = []
        for own, rows, ids, p in _blocks(queries, candidates, _products):
            cutoff = queries["cutoff"].fill_null(-MOST).to_numpy()[rows]
            i, j = np.nonzero(p >= -(-cutoff // lists)[:, None])
            cell = [np.full(len(i), queries[c][0].as_py()) for c in ("list", "dim")]
            out.append((own[i], ids[j], p[i, j], cutoff[i], *cell))
        return _found(out, COLLECTED)

    return run


def _resolve(asked: pa.Table, candidates: pa.Table) -> pa.Table:
    """Partial scores of the pairs asked for: rows of `asked` hold a query's vector, or the vec_id of a pair."""
    pair = np.asarray(asked["vec_id"].is_valid())
    pairs, queries = asked.filter(pa.array(pair)), asked.filter(pa.array(~pair))
    if not len(pairs):
        return _found([])
    own, other = pairs["id"].to_numpy(), pairs["vec_id"].to_numpy()
    q, c = block_matrix(queries["v"]), block_matrix(candidates["v"])
    rows = []
    for table, wanted in ((queries, own), (candidates, other)):
        ids = table["id"].to_numpy()
        order = np.argsort(ids)
        rows.append(order[np.searchsorted(ids, wanted, sorter=order)])
    part = [(q[rows[0][a : a + 65536]] * c[rows[1][a : a + 65536]]).sum(axis=1) for a in range(0, len(own), 65536)]
    return _found([(own, other, np.concatenate(part))])


def _sharded(rows: DataFrame, lists: int) -> DataFrame:
    """Every row once a list, with that part of its vector."""
    each = rows.withColumn("list", F.explode(F.array(*[F.lit(i) for i in range(lists)])))
    first, end = F.expr(f"(dim * list) div {lists}").cast("int"), F.expr(f"(dim * (list + 1)) div {lists}").cast("int")
    return each.withColumn("v", F.slice("v", first + 1, end - first))


def _three_phases(groups: DataFrame, asked: int, n: int, k: int, lists: int) -> DataFrame:
    """query_id, vec_id, score: the k best groups of each asking group, by ids of groups."""
    g, h = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-asked // QUERY_BLOCK))
    candidates = spread(_sharded(groups.select("id", "v", "dim"), lists).withColumn("_g", cut("id", g)), "_h", h)
    queries = groups.where("asks").select("id", "v", "dim").withColumn("_h", cut("id", h))

    vectors = spread(_sharded(queries, lists), "_g", g)
    shape = "query_id long, vec_id long, score long, cutoff long, list int, dim int"

    def known(entries: DataFrame) -> DataFrame:
        """One row a pair: the sum of its partial scores so far, and the lists that they are from."""
        return entries.groupBy("query_id", "vec_id").agg(F.sum("score").alias("score"), F.max("cutoff").alias("cutoff"), F.max("dim").alias("dim"), F.collect_list("list").alias("lists"))

    def complete(pairs: DataFrame) -> DataFrame:
        """query_id, vec_id, score: exact totals, with the partial scores of lists that did not report a pair asked for by its ids."""
        every = F.array(*[F.lit(i) for i in range(lists)])
        open_ = pairs.where(F.size("lists") < lists).withColumn("list", F.explode(F.array_except(every, "lists")))
        open_ = open_.select("dim", "list", cut("vec_id", g).alias("_g"), cut("query_id", h).alias("_h"), F.col("query_id").alias("id"), F.lit(None).cast("array<long>").alias("v"), "vec_id")
        asked = vectors.select(*CELLS, "id", "v", F.lit(None).cast("long").alias("vec_id")).union(open_)
        parts = asked.groupBy(*CELLS).cogroup(candidates.groupBy(*CELLS)).applyInArrow(_resolve, "query_id long, vec_id long, score long")
        return pairs.select("query_id", "vec_id", "score").union(parts).groupBy("query_id", "vec_id").agg(F.sum("score").alias("score"))

    heads = vectors.groupBy(*CELLS).cogroup(candidates.groupBy(*CELLS)).applyInArrow(_local_heads(k), shape)
    # Of all blocks of a list the best: what is resolved for the cutoff does not grow with the table.
    place = F.row_number().over(Window.partitionBy("query_id", "list").orderBy(F.desc("score"), "vec_id"))
    heads = heads.withColumn("_place", place).where(F.col("_place") <= HEADS * k).drop("_place")
    cutoffs = best(complete(materialise(known(heads), "heads")), k).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("cutoff"))
    sent = materialise(queries.join(cutoffs, "id", "left"), "queries")

    entries = known(spread(_sharded(sent, lists), "_g", g).groupBy(*CELLS).cogroup(candidates.groupBy(*CELLS)).applyInArrow(_collect(lists), shape))
    missing = lists - F.size("lists")
    # What a list did not report is below cutoff / lists.
    within = F.col("score") + missing * F.expr(f"(cutoff + {lists - 1}) div {lists}") >= F.col("cutoff")
    return best(complete(materialise(entries.where((missing == 0) | within), "entries")), k).select("query_id", "vec_id", "score")


def _beyond(groups: DataFrame, asked: int, n: int, k: int) -> DataFrame:
    """The same for pairs with a wide vector: block by block, in whole numbers of any size."""
    g, h = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-asked // QUERY_BLOCK))
    cells = ["dim", "_g", "_h", "wide"]
    candidates = spread(groups.select("id", "v", "dim", "wide").withColumn("_g", cut("id", g)), "_h", h)
    asking = spread(groups.where("asks").select("id", "v", "dim", "wide").withColumn("_h", cut("id", h)), "_g", g)
    # Wide queries meet all candidates; others only the wide ones.
    asking = asking.withColumn("wide", F.explode(F.when(F.col("wide"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))))
    found = asking.groupBy(*cells).cogroup(candidates.groupBy(*cells)).applyInArrow(_heads(k, _wide_products), "query_id long, vec_id long, score long")
    return best(found, k).select("query_id", "vec_id", "score")


def search(vectors: DataFrame, is_query: Column, k: int = 10, lists: int = 2, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest integer inner products of every query.

    vector: integers, as of quantise(). is_query is a condition on `id`. Candidates are all rows but the
    query's own; only vectors of the query's length compare, and vectors that are null or hold nulls take no
    part. Of repeated ids the greatest vector stands for all. Fewer candidates than k give fewer rows. A score
    beyond 64 bits counts as the nearest number of 64 bits. The integers must be ids, too. An empty table, or one without
    queries, gives an empty result. Only the two named columns are read and these four returned, so others may be called anything.
    """
    rows = usable(vectors, id_column, vector, zero_too=True).withColumn("dim", F.size("v"))
    # Totals of other vectors stay below WIDE: each component is below the root of WIDE / dim.
    most = F.floor(F.sqrt(F.lit(float(WIDE)) / F.greatest("dim", F.lit(1)))) - 1
    rows = rows.withColumn("wide", F.exists("v", lambda x: (x > most) | (x < -most)))
    rows = materialise(rows.withColumn("key", F.struct(F.xxhash64(F.lit(1), "v"), F.xxhash64(F.lit(2), "v"), "dim")), "vectors")
    # 128 bits of hash tell vectors apart.
    groups = materialise(rows.groupBy("key").agg(F.min("id").alias("id"), F.first("v").alias("v"), F.first("dim").alias("dim"), F.first("wide").alias("wide"), F.bool_or(F.coalesce(is_query, F.lit(False))).alias("asks")), "groups")
    n, asked, wide = groups.agg(F.count("*"), F.count_if("asks"), F.count_if("wide")).first()
    if not asked:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = _three_phases(groups.where("not wide"), asked, n, k + 1, lists)
    if wide:
        found = found.union(_beyond(groups, asked, n, k + 1))
    found = materialise(best(found, k + 1).select("query_id", "vec_id", "score"), "found")

    names = groups.select("key", F.col("id").alias("group"))
    smallest = rows.select("key", "id").withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("n") <= k + 1)
    members = smallest.join(names, "key").select(F.col("group").alias("vec_id"), F.col("id").alias("member"))
    askers = rows.where(is_query).select("key", "id").join(names, "key").select(F.col("group").alias("query_id"), F.col("id").alias("asker"))
    each = askers.join(found, "query_id").join(members, "vec_id").where("asker <> member").select(F.col("asker").alias("query_id"), F.col("member").alias("vec_id"), "score")
    return best(each, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
