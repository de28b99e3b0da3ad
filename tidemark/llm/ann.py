"""Op 10: approximate nearest neighbours in a hierarchical k-means tree.

The tree grows with the table. Its top is fitted on a bounded sample and sent to all tasks; a leaf that holds
too many rows is split by a tree of its own, fitted on a bounded sample of its rows, and so on. Trees below
the top are rows of a table, so no task and no driver ever holds them all. A query walks best bin first: in
each tree a priority queue holds nodes by the inner product with their centre, and of all leaves that its
walks reach the best are visited. How many are enough is calibrated: the exact neighbours of a bounded set of
queries are found by brute force over all rows, and visits are widened until the wanted share of them lies
in the leaves visited.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise
from tidemark.llm.vectors import best, block_matrix, cut, matrix, top_rows, usable

SAMPLE_ROWS = 16_384  # vectors that a tree is fitted on, at most
BRANCHES = 8
LEAF_SAMPLE = 64  # a node of fewer sample vectors is a leaf
SPLIT_ROWS = 1024  # a leaf of more rows gets a tree of its own
FANOUT = 1 << 14  # leaf l of the tree under leaf x is x * FANOUT + l + 1: more than a tree can have, and room for three splits of a leaf
SPLITS = 3  # a fourth would pass 64 bits of leaf numbers; leaves that are large still are met in blocks
CALIBRATION_QUERIES = 200
BUCKET_ROWS, BUCKET_QUERIES = 16_384, 8192
BLOCK_ROWS = 4096  # of one leaf
AT_ONCE = 256


@dataclass
class Tree:
    centres: list[np.ndarray] = field(default_factory=list)  # of each node
    children: list[list[int]] = field(default_factory=list)
    leaf_of: dict[int, int] = field(default_factory=dict)  # node -> leaf number

    @classmethod
    def fit(cls, rows: np.ndarray, seed: int) -> "Tree":
        """Over distinct rows; each leaf is the place of one of them at least."""
        tree = cls()
        tree._add(np.unique(rows, axis=0), np.random.default_rng(seed))
        met = set(tree.leaves(rows).tolist())
        gone = {node for node, leaf in tree.leaf_of.items() if leaf not in met}
        for node in reversed(range(len(tree.children))):
            if tree.children[node]:
                tree.children[node] = [c for c in tree.children[node] if c not in gone]
                gone |= set() if tree.children[node] else {node}
        tree.leaf_of = {node: k for k, node in enumerate(n for n in tree.leaf_of if n not in gone)}
        return tree

    def _add(self, rows: np.ndarray, rng: np.random.Generator) -> int:
        node = len(self.centres)
        self.centres.append(rows.mean(axis=0) if len(rows) else rows.sum(axis=0))
        self.children.append([])
        parts = _k_means(rows, BRANCHES, rng) if len(rows) > LEAF_SAMPLE else []
        if len(parts) < 2:
            self.leaf_of[node] = len(self.leaf_of)
        else:
            self.children[node] = [self._add(rows[p], rng) for p in parts]
        return node

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row: down to the closest centre at every node."""
        out = np.zeros(len(rows), dtype=np.int64)
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if not self.children[node]:
                out[at] = self.leaf_of[node]
                continue
            to = _closest(rows[at], np.array([self.centres[c] for c in self.children[node]]))
            todo += [(c, at[to == i]) for i, c in enumerate(self.children[node]) if (to == i).any()]
        return out

    def visits(self, queries: np.ndarray, leaves: int) -> Iterator[list[tuple[int, float]]]:
        """For each query the leaves it visits and their priorities, best bin first: so many, if there are."""
        products = queries @ np.array(self.centres).T
        for p in products.tolist():
            queue, seen = [(-p[0], 0)], []
            while queue and len(seen) < leaves:
                _, node = heapq.heappop(queue)
                if self.children[node]:
                    for c in self.children[node]:
                        heapq.heappush(queue, (-p[c], c))
                else:
                    seen.append((self.leaf_of[node], p[node]))
            yield seen


def _closest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * rows @ centres.T, axis=1)


def _k_means(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> list[np.ndarray]:
    centres = rows[rng.choice(len(rows), size=min(k, len(rows)), replace=False)]
    for _ in range(rounds):
        to = _closest(rows, centres)
        centres = np.array([rows[to == i].mean(axis=0) for i in range(len(centres)) if (to == i).any()])
    to = _closest(rows, centres)
    return [np.flatnonzero(to == i) for i in range(len(centres)) if (to == i).any()]


NOWHERE = pa.table({"id": pa.array([], pa.int64()), "leaf": pa.array([], pa.int64()), "priority": pa.array([], pa.float64())})


class Forest:
    """The top tree, the tables of trees below it (leaf, tree), a table of rows (id, v, leaf) and one of leaf sizes."""

    def __init__(self, rows: DataFrame, sample_rows: int, split_rows: int, seed: int = 5):
        self.spark, self.kind, self.lower = rows.sparkSession, rows.schema["v"].dataType.simpleString(), []
        sample = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).toPandas()
        self.top = self.spark.sparkContext.broadcast(Tree.fit(matrix(sample["v"], np.float64), seed))
        top = self.top

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield b.append_column("leaf", pa.array(top.value.leaves(block_matrix(pa.chunked_array([b["v"]])).astype(np.float64))))

        def fit(table: pa.Table) -> pa.Table:
            tree = Tree.fit(block_matrix(table["v"]).astype(np.float64), seed)
            return pa.table({"leaf": table["leaf"][:1], "tree": [pickle.dumps(tree)], "leaves": pa.array([len(tree.leaf_of)], pa.int32())})

        def move(here: pa.Table, trees: pa.Table) -> pa.Table:
            here = here.select(["id", "v", "leaf"])
            if not len(here) or not len(trees):
                return here
            leaf = pickle.loads(trees["tree"][0].as_py()).leaves(block_matrix(here["v"]).astype(np.float64))
            return here.set_column(2, "leaf", pa.array(here["leaf"][0].as_py() * FANOUT + leaf + 1))

        shape = f"id long, v {self.kind}, leaf long"
        self.rows = materialise(rows.select("id", "v").mapInArrow(place, shape), "leaves")
        self.sizes = materialise(self.rows.groupBy("leaf").agg(F.count("*").alias("rows")), "leaf-sizes")
        whole = self.spark.createDataFrame([], "leaf long")  # leaves of equal vectors, as far as their samples show
        for _ in range(SPLITS):
            large = self.sizes.where(F.col("rows") > split_rows).join(whole, "leaf", "left_anti")
            large = materialise(large.select("leaf", F.ceil(F.col("rows") / BUCKET_ROWS).cast("int").alias("blocks")), "large-leaves")
            if large.isEmpty():
                break
            inside = self.rows.join(large, "leaf").withColumn("block", cut_by("id", "blocks"))
            first = Window.partitionBy("leaf").orderBy(F.xxhash64("id"), "id")
            sample = inside.withColumn("n", F.row_number().over(first)).where(F.col("n") <= sample_rows).select("leaf", "v")
            trees = materialise(sample.groupBy("leaf").applyInArrow(fit, "leaf long, tree binary, leaves int"), "trees")
            whole = whole.union(trees.where("leaves < 2").select("leaf"))
            trees = trees.where("leaves > 1").select("leaf", "tree")
            each = trees.join(large, "leaf").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            cells = ["leaf", "block"]
            moved = inside.select("id", "v", *cells).groupBy(*cells).cogroup(each.groupBy(*cells)).applyInArrow(move, shape)
            self.rows = materialise(self.rows.join(large, "leaf", "left_anti").select("id", "v", "leaf").union(moved), "leaves")
            self.sizes = materialise(self.rows.groupBy("leaf").agg(F.count("*").alias("rows")), "leaf-sizes")
            self.lower.append(trees)

    def walk(self, queries: DataFrame, visits: int, least: int) -> DataFrame:
        """(id, leaf, rank): the leaves that each of the queries (id, v) visits, and more until they hold `least` vectors."""
        top, wide = self.top, visits + least  # every leaf holds a vector

        def reached(ids: list, q: np.ndarray, tree: Tree, number) -> pa.RecordBatch:
            found = [(i, number(leaf), p) for i, seen in zip(ids, tree.visits(q, wide)) for leaf, p in seen]
            columns = list(zip(*found)) if found else [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["id", "leaf", "priority"])

        def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(0, b.num_rows, AT_ONCE):
                    part = b.slice(i, AT_ONCE)
                    yield reached(part["id"].to_pylist(), block_matrix(pa.chunked_array([part["v"]])).astype(np.float64), top.value, lambda leaf: leaf)

        def down(asking: pa.Table, trees: pa.Table) -> pa.Table:
            if not len(asking) or not len(trees):
                return NOWHERE
            above = asking["leaf"][0].as_py()
            return pa.Table.from_batches([reached(asking["id"].to_pylist(), block_matrix(asking["v"]).astype(np.float64), pickle.loads(trees["tree"][0].as_py()), lambda leaf: above * FANOUT + leaf + 1)])

        shape = "id long, leaf long, priority double"
        best_first = Window.partitionBy("id").orderBy(F.col("priority").desc(), "leaf")
        seen = queries.select("id", "v").mapInArrow(start, shape)
        for trees in self.lower:
            seen = materialise(seen, "visits")
            split = trees.select("leaf")
            asks = seen.join(split, "leaf", "left_semi")
            turns = asks.groupBy("leaf").agg(F.ceil(F.count("*") / BUCKET_QUERIES).cast("int").alias("turns"))
            asks = asks.join(turns, "leaf").withColumn("turn", cut_by("id", "turns")).join(queries.select("id", "v"), "id")
            each = trees.join(turns, "leaf").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
            cells = ["leaf", "turn"]
            below = asks.select("id", "v", *cells).groupBy(*cells).cogroup(each.groupBy(*cells)).applyInArrow(down, shape)
            seen = seen.join(split, "leaf", "left_anti").select("id", "leaf", "priority").union(below)
            seen = seen.withColumn("n", F.row_number().over(best_first)).where(F.col("n") <= wide).drop("n")
        held = F.coalesce(F.sum("rows").over(best_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranked = seen.join(self.sizes, "leaf").withColumn("rank", F.row_number().over(best_first)).withColumn("held", held)
        return ranked.where((F.col("rank") <= visits) | (F.col("held") < least)).select("id", "leaf", "rank")


def cut_by(name: str, parts: str) -> Column:
    """An even part number for every value, where a column has the number of parts."""
    return F.pmod(F.xxhash64(name), F.col(parts)).cast("int")


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of one query that depend on the two vectors alone, not on their place in a block."""
    return np.add.reduce(c * q, axis=1)


def _nearest(own, query: np.ndarray, ids: np.ndarray, rows: np.ndarray, fast: np.ndarray, k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best at some places: by fast products with a margin for their rounding, then exactly."""
    at = at[ids[at] != own]
    if len(at) > k:
        least = np.partition(fast[at], len(at) - k)[len(at) - k]
        at = at[fast[at] >= least - 1e-9 * (np.abs(query) @ np.abs(rows).max(axis=0))]
    score = _exact(query, rows[at])
    kept = top_rows(score, ids[at], k, np.arange(len(at)))
    return ids[at[kept]], score[kept]


FOUND = "query_id long, vec_id long, score double"


def _found(parts: list[tuple]) -> pa.Table:
    owners = np.repeat(np.array([own for own, _, _ in parts], dtype=np.int64), [len(ids) for _, ids, _ in parts])
    rest = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in (1, 2)]
    return pa.table({"query_id": pa.array(owners, pa.int64()), "vec_id": pa.array(rest[0].astype(np.int64)), "score": pa.array(rest[1].astype(np.float64))})


def _calibrate(forest: Forest, k: int, recall: float, queries: int) -> int:
    """The least number of leaf visits that finds the wanted share of the exact neighbours of some queries."""
    asked = forest.rows.orderBy(F.xxhash64(F.lit(3), "id"), "id").limit(queries).select("id", "v").toPandas()
    q, own = matrix(asked["v"], np.float64), asked["id"].to_numpy()

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = b["id"].to_numpy(), block_matrix(pa.chunked_array([b["v"]])).astype(np.float64)
            fast = q @ rows.T
            yield from _found([(own[i], *_nearest(own[i], q[i], ids, rows, fast[i], k, np.arange(len(ids)))) for i in range(len(own))]).to_batches()

    near = best(forest.rows.select("id", "v").mapInArrow(brute, FOUND), k)
    near = materialise(near.select(F.col("query_id").alias("id"), "vec_id").join(forest.rows.select(F.col("id").alias("vec_id"), "leaf"), "vec_id"), "neighbours")  # at most queries x k rows
    total, some = near.count(), forest.spark.createDataFrame(asked.assign(v=[list(map(float, v)) for v in asked["v"]]), "id long, v array<double>")
    leaves = forest.sizes.count()
    visits = 16
    while total:
        hit = sorted(r["rank"] for r in near.join(forest.walk(some, visits, 0), ["id", "leaf"]).select("rank").collect())  # at most queries x k ranks
        needed = int(np.ceil(recall * total))
        if len(hit) >= needed:
            return hit[needed - 1]
        if visits >= leaves:
            return leaves
        visits *= 4
    return 1


def _search_length(rows: DataFrame, is_query: Column, k: int, recall: float, sample_rows: int, split_rows: int) -> DataFrame:
    forest = Forest(rows, sample_rows, split_rows)
    visits = _calibrate(forest, k, recall, CALIBRATION_QUERIES)
    queries = forest.rows.where(is_query).select("id", "v")

    # Leaves, large ones in blocks, are dealt to buckets: a query goes to each bucket once, with the units it visits there.
    buckets = max(1, -(-forest.rows.count() // BUCKET_ROWS))
    blocks = forest.sizes.select("leaf", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("blocks"))
    unit = F.xxhash64("leaf", "block")
    bucket = F.pmod(unit, F.lit(buckets)).cast("int").alias("bucket")
    visited = forest.walk(queries, visits, k + 1).join(blocks, "leaf").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = materialise(visited.select("id", bucket, unit.alias("unit")).groupBy("id", "bucket").agg(F.collect_list("unit").alias("units")), "visits")
    turns = asked.groupBy("bucket").agg(F.ceil(F.count("*") / BUCKET_QUERIES).cast("int").alias("turns"))
    cells = ["bucket", "turn"]
    dealt = forest.rows.join(blocks, "leaf").withColumn("block", cut_by("id", "blocks")).select("id", "v", bucket, unit.alias("unit"))
    candidates = dealt.join(turns, "bucket").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).select("id", "v", "unit", *cells)
    asking = asked.join(turns, "bucket").withColumn("turn", cut_by("id", "turns")).join(queries.withColumnRenamed("v", "q"), "id").select("id", "q", "units", *cells)

    def compare(asking: pa.Table, there: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(asking) and len(there):
            there = there.sort_by("unit")
            c, ids = block_matrix(there["v"]).astype(np.float64), there["id"].to_numpy()
            units, first = np.unique(there["unit"].to_numpy(), return_index=True)
            ends = np.append(first[1:], len(ids))
            q, own = block_matrix(asking["q"]).astype(np.float64), asking["id"].to_numpy()
            lists = asking["units"].to_pylist()
            for a in range(0, len(q), AT_ONCE):
                here = range(a, min(a + AT_ONCE, len(q)))
                by_unit: dict[int, list[int]] = {}
                for i in here:
                    for u in lists[i]:
                        by_unit.setdefault(u, []).append(i - a)
                fast = np.full((len(here), len(ids)), -np.inf)
                for u, some in by_unit.items():
                    n = np.searchsorted(units, u)
                    fast[some, first[n] : ends[n]] = q[a:][some] @ c[first[n] : ends[n]].T
                for i in here:
                    out.append((own[i], *_nearest(own[i], q[i], ids, c, fast[i - a], k, np.flatnonzero(fast[i - a] > -np.inf))))
        return _found(out)

    found = asking.groupBy(*cells).cogroup(candidates.groupBy(*cells)).applyInArrow(compare, FOUND)
    return best(found, k)


def search(vectors: DataFrame, is_query: Column, k: int = 20, recall: float = 0.95, sample_rows: int = SAMPLE_ROWS, split_rows: int = SPLIT_ROWS, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of every query, by inner product.

    is_query is a condition on `id`. Candidates are all rows but the query's own. Vectors of each length are
    a table of their own (there should be few lengths). Null vectors, zero ones and those with null or
    non-finite components take no part; of repeated ids the greatest vector stands for all. A query
    always visits leaves that hold at least k others, if there are so many. An empty table, or one without
    queries, gives an empty result. Only the two named columns are read and these four returned, so others may be called anything.
    """
    rows = materialise(usable(vectors, id_column, vector, zero_too=False), "vectors")
    lengths = sorted(r[0] for r in rows.select(F.size("v")).distinct().collect())
    found = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for n in lengths:
        part = rows if len(lengths) == 1 else rows.where(F.size("v") == n)
        found = found.unionByName(_search_length(part, is_query, k, recall, sample_rows, split_rows).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
    return found
