"""Op 13: a Merkle manifest of a dataset, with a proof for every row.

Rows are leaves; a group's leaves, in order, become nodes of FANOUT by FANOUT until one is left, and the groups' last nodes
become the root in the same way. The places of leaves come from a range-partitioned sort. A node is a nested struct: the two lowest
base-FANOUT digits of a place are grouped away one after the other, each time nesting the children as structs, so a group's row holds
at most FANOUT^2 of them (a block); blocks are the leaves of the next round. On the way down, the path of a block joins its
children as one more row of their group, and a transform and an explode hand every child its own path: no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise

BITS = 4
FANOUT, BLOCK = 1 << BITS, 1 << 2 * BITS
STEPS = "array<struct<left: string, right: string>>"
ABOVE = f"struct<subroot: string, steps: {STEPS}>"


def encoded(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, `:` and the value as text: no two lists of values look the same."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, nothing else."""
    plain = F.octet_length(text) == F.length(text)  # then lower() is just that, and faster
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def ranked(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """rows with __rank (from 0) within their group and __n, its size, by a range-partitioned sort: a hot group is dealt over many tasks.

    Equal rows are told apart by their place in a written table, so that they do not meet in one range either.
    """
    stored = materialise(rows.withColumn("__row", F.monotonically_increasing_id()), f"{name}-rows")
    ordered = materialise(stored.orderBy(group, *order, "__row").withColumn("__at", F.monotonically_increasing_id()).drop("__row"), f"{name}-order")
    ordered = ordered.withColumn("__part", F.shiftright("__at", 33))
    # One row a partition and group: a partition's rows of a group lie together.
    runs = ordered.groupBy(group, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("__rows").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col(group).alias("__run_group"), F.col("__part").alias("__run_part"), (before - F.col("__first")).alias("__shift"), F.sum("__rows").over(whole).alias("__n"))
    same = (F.col("__part") == F.col("__run_part")) & F.col(group).eqNullSafe(F.col("__run_group"))
    placed = ordered.join(runs, same).withColumn("__rank", F.col("__at") + F.col("__shift"))
    return materialise(placed.drop("__at", "__part", "__run_part", "__run_group", "__shift"), name)


def _nested(nodes: DataFrame, keep: list[str]) -> DataFrame:
    """__group, __block, __n, __above and nodes: the nodes (__digest, keep) of each block, nested by the two lowest digits of __rank.

    nodes may hold one row without a __rank for a block, with what is __above it.
    """
    dealt = nodes.repartition("__group", "__block")  # the one shuffle of both groupings below
    low = F.struct(F.col("__rank").bitwiseAND(F.lit(FANOUT - 1)).alias("at"), "__digest", *keep)
    high = F.shiftright(F.col("__rank").bitwiseAND(F.lit(BLOCK - 1)), BITS)
    kids = F.array_sort(F.collect_list(F.when(F.col("__rank").isNotNull(), low)))
    # The row from above has no digits: it is a group of its own here, and meets its block's nodes in the next grouping.
    inner = dealt.withColumn("__high", high).groupBy("__group", "__block", "__high").agg(F.max("__n").alias("__n"), F.first("__above", ignorenulls=True).alias("__above"), kids.alias("kids"))
    own = F.when(F.col("__n") > 1, _joined("kids")).otherwise(F.get("kids", F.lit(0))["__digest"])
    node = F.when(F.col("__high").isNotNull(), F.struct(F.col("__high").alias("at"), own.alias("__digest"), "kids"))
    return inner.groupBy("__group", "__block").agg(F.max("__n").alias("__n"), F.first("__above", ignorenulls=True).alias("__above"), F.array_sort(F.collect_list(node)).alias("nodes"))


def _joined(kids: str) -> Column:
    """The node above the kids."""
    return F.sha2(F.array_join(F.transform(kids, lambda x: x["__digest"]), ""), 256)


def _siblings(kids: Column, i: Column, there: Column) -> Column:
    """One step of a path, the digests left and right of place i; none if this level is not there."""
    names = F.transform(kids, lambda x: x["__digest"])
    step = F.struct(F.array_join(F.slice(names, F.lit(1), i), "").alias("left"), F.array_join(F.slice(names, i + 2, F.size(names)), "").alias("right"))
    return F.when(there, F.array(step)).otherwise(F.array().cast(STEPS))


def _in_blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumns({"__block": F.shiftright("__rank", 2 * BITS), "__above": F.lit(None).cast(ABOVE)})


def rollup(nodes: DataFrame) -> DataFrame:
    """Blocks of nodes (__group, __rank, __n, __digest) as nodes of the next round, in the same columns."""
    top = F.when(F.col("__n") > FANOUT, _joined("nodes")).otherwise(F.get("nodes", F.lit(0))["__digest"])
    return _nested(_in_blocks(nodes), []).select("__group", F.col("__block").alias("__rank"), F.ceil(F.col("__n") / BLOCK).alias("__n"), top.alias("__digest"))


def descend(nodes: DataFrame, blocks: DataFrame, keep: list[str]) -> DataFrame:
    """__group, __rank, __digest, keep of every node, and __above, with the steps of all levels above it, lowest first.

    blocks: __group, __rank and __above of the nodes' blocks.
    """
    above = blocks.select("__group", F.col("__rank").alias("__block"), "__above")
    nested = _nested(_in_blocks(nodes).unionByName(above, allowMissingColumns=True), keep)
    high = nested.select("__group", "__block", "__n", "__above", "nodes", F.posexplode("nodes").alias("__i", "node"))
    # Steps of the upper digit are put before the block's, and those of the lower digit before both.
    steps = F.concat(_siblings(F.col("nodes"), F.col("__i"), F.col("__n") > FANOUT), "__above.steps")
    high = high.select("__group", "__block", "__n", "__i", "node.kids", "__above.subroot", steps.alias("steps"))
    low = high.select("*", F.posexplode("kids").alias("__j", "kid"))
    steps = F.concat(_siblings(F.col("kids"), F.col("__j"), F.col("__n") > 1), "steps")
    rank = F.col("__block") * BLOCK + F.col("__i") * FANOUT + F.col("__j")
    return low.select("__group", rank.alias("__rank"), F.col("kid.__digest").alias("__digest"), *[F.col(f"kid.{c}").alias(c) for c in keep], F.struct("subroot", steps.alias("steps")).alias("__above"))


def _rounds(nodes: DataFrame, name: str) -> list[DataFrame]:
    """nodes, their blocks, the blocks of those, and so on (once at least) until every group is one node: written tables."""
    levels, most = [nodes], nodes.agg(F.max("__n")).first()[0] or 0
    while len(levels) == 1 or most > 1:
        levels.append(materialise(rollup(levels[-1]), f"{name}-{len(levels)}"))
        most = -(-most // BLOCK)
    return levels


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tampered: Column | None = None, text: str = "text") -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root, verified: every row with the proof that it belongs to the dataset.

    A leaf is the hash of its fields. The leaves of a group stand in order of the key, nulls first, and equal keys in order of
    their hash; groups in order of their name, null first. A proof is the hash of the siblings from the leaf's level up to the
    root. Rows where `tampered` holds have A-Z of the text lowered before their leaf is folded with those siblings: verified tells
    whether the root comes out. Nulls, empty and long texts are hashed as they are; equal rows are leaves of their own.
    An empty table gives an empty result. Only the named columns are read, so others may be called anything.
    """

    def leaf(content: Column) -> Column:
        return F.sha2(F.concat(*[encoded(content if f == text else F.col(f)) for f in fields]), 256)

    changed = F.when(tampered, leaf(lower_ascii(F.col(text)))) if tampered is not None else F.lit(None).cast("string")
    rows = docs.select(F.col(group).alias("__group"), F.col(key).alias("__key"), leaf(F.col(text)).alias("__digest"), changed.alias("__changed"))
    leaves = _rounds(ranked(rows, "__group", ["__key", "__digest"], "leaves"), "leaves")
    subroots = leaves[-1].select(F.lit(0).alias("__group"), F.col("__group").alias("__name"), "__digest")
    groups = _rounds(ranked(subroots, "__group", ["__name"], "groups"), "groups")
    root = groups[-1].first()  # one row, or none
    above = groups[-1].select("__group", "__rank", F.struct(F.lit(None).cast("string").alias("subroot"), F.array().cast(STEPS).alias("steps")).alias("__above"))
    for level in reversed(groups[:-1]):
        above = descend(level, above, ["__name"] if level is groups[0] else [])
    above = above.select(F.col("__name").alias("__group"), F.lit(0).cast("long").alias("__rank"), F.struct(F.col("__digest").alias("subroot"), "__above.steps").alias("__above"))
    for level in reversed(leaves[:-1]):
        above = descend(level, above, ["__key", "__changed"] if level is leaves[0] else [])
    steps = F.col("__above.steps")
    folded = F.aggregate(steps, F.coalesce("__changed", "__digest"), lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))
    proof = F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""), 256)
    out = above.select(F.col("__key").alias(key), F.col("__digest").alias("leaf"), "__above.subroot", F.lit(root and root["__digest"]).cast("string").alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
