"""Op 9: near-duplicates by SimHash, found through pigeonhole blocks.

Fingerprints of 64 bits are cut into blocks; two that differ in at most `distance` bits agree in all
blocks but `distance`, so every choice of the other blocks is a join key. Only distinct fingerprints are
joined. Keys that more than `crowd` fingerprints share would make too many pairs; their fingerprints are
linked through a second exact rule: each stands under itself and under every fingerprint one bit away, and
two that differ in at most two bits meet under one of these. All under one such key differ in at most two
bits, so each is linked to the smallest, and there are never more than 65 of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, release
from tidemark.llm.components import connected_components

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the text's word shingles, repeats included; zero without words."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = [0, *(ends[:-shingle] + 1).tolist()]
    parts = [joined[s:e] for s, e in zip(starts, ends[shingle - 1 :].tolist())]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), dtype="<u8", count=len(parts))
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 16384):
        ones += np.unpackbits(hashes[i : i + 16384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row; a null text has no words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = [fingerprint((t or "").encode("utf-8", "surrogatepass"), shingle, seed) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": np.array(fps, dtype=np.uint64).view(np.int64)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, fp long")


def _bits(fp: Column, ranges: list[tuple[int, int]]) -> Column:
    """The bits of fp in the ranges [from, to), side by side."""
    mask = sum(((1 << (b - a)) - 1) << a for a, b in ranges)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def links(fps: DataFrame, distance: int = 2, blocks: int = 4, crowd: int = 16) -> DataFrame:
    """hashing, a, b: links that join just the fingerprints of a hashing that chains of close pairs join.

    fps: distinct (hashing, fp). distance: 0 to 2, for which crowded keys have an exact way.
    """
    if not 0 <= distance <= 2 or blocks <= distance:
        raise ValueError("distance must be 0 to 2, and blocks more than that")
    cut = [64 * i // blocks for i in range(blocks + 1)]
    tables = list(combinations([(cut[i], cut[i + 1]) for i in range(blocks)], blocks - distance))
    keys = F.array(*[F.struct(F.lit(t).alias("table"), _bits(F.col("fp"), list(ranges)).alias("key")) for t, ranges in enumerate(tables)])
    keyed = fps.select("hashing", "fp", F.explode(keys).alias("k")).select("hashing", "k.table", "k.key", "fp")
    on = ["hashing", "table", "key"]
    # Most keys are of one fingerprint alone; the others are written out and used from there.
    sizes = keyed.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1")
    shared = materialise(keyed.join(sizes, on), "blocks")
    few = shared.where(F.col("n") <= crowd).select(*on, "fp")
    close = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= distance
    pairs = few.alias("x").join(few.alias("y"), on).where((F.col("x.fp") < F.col("y.fp")) & close)
    pairs = pairs.select("hashing", F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))

    # Under each key of this second rule all are within 2 * (distance // 2) bits; with distance 1 it is used for pairs with the key itself.
    flips = [0, *(1 << i for i in range(63)), -(1 << 63)] if distance else [0]
    crowded = shared.where(F.col("n") > crowd).select("hashing", "fp").distinct()
    near = crowded.select("hashing", "fp", F.explode(F.transform(F.array(*map(F.lit, flips)), lambda m: F.col("fp").bitwiseXOR(m))).alias("near"))
    if distance == 2:
        least = near.groupBy("hashing", "near").agg(F.min("fp").alias("b"), F.max("fp").alias("_max")).where("b < _max").drop("_max")
    else:
        least = crowded.select("hashing", F.col("fp").alias("near"), F.col("fp").alias("b"))
    stars = near.join(least, ["hashing", "near"]).select("hashing", F.col("fp").alias("a"), "b")
    return pairs.union(stars.where("a <> b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, seed: int = 42, distance: int = 2, blocks: int = 4, crowd: int = 16) -> DataFrame:
    """doc_id, fp, component_id for every row: the smallest doc_id that chains of close fingerprints reach.

    Rows without words have fingerprint zero and are linked like others. Null doc_ids keep their rows and
    count for no component's smallest id (a component of nulls alone has a null id). Repeated rows are one
    text. An empty table gives an empty result. Only doc_id and text are read, so other columns may be called anything.
    """
    rows = materialise(fingerprints(docs, shingle, seed), "fingerprints")
    fps = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = materialise(connected_components(links(fps.select(F.lit(0).alias("hashing"), "fp"), distance, blocks, crowd)), "components")
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp").select("fp", "root", "first_id")
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    # Most fingerprints are alone; only what has links goes through the second join.
    names = fps.join(rooted.select("fp", "root").join(smallest, "root").select("fp", "component_id"), "fp", "left")
    # Written out, so that the last join reads two plain exchanges and Spark can split a hot fingerprint.
    names = materialise(names.select("fp", F.coalesce("component_id", "first_id").alias("component_id")), "names")
    return rows.join(names, "fp").select("doc_id", "fp", "component_id")


#: (bands, smallest hashes in each): texts of similarity s share no key with odds of (1 - s ** rows) ** bands. At 0.8 that
#: is 4e-4 for COARSE, and 1.4e-2 for FINE (1e-5 at 0.85), which keeps those of 0.6 apart in 96 % of all cases.
COARSE, FINE = (20, 5), (150, 16)
HUBS = 4  # texts that all others of a crowded key meet


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles; a text of fewer words is one shingle, one without words has none."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    n = max(1, len(words) - shingle + 1)
    x = np.zeros(n, dtype=np.uint64)
    for i in range(min(shingle, len(words))):
        x = x * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return np.unique(_mixed(x))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def band_keys(hashes: np.ndarray, bands: int = COARSE[0], rows: int = COARSE[1]) -> np.ndarray:
    """One key a band, of the smallest values that `rows` hash functions take on the set; the empty set has keys of its own."""
    odd = (_mixed(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(bands * rows, np.iinfo(np.uint32).max, dtype=np.uint32)
    for i in range(0, len(short), 256):
        # The high bits of a product depend on all bits of the hash, and each odd factor is a permutation.
        least = np.minimum(least, (short[i : i + 256, None] * odd).min(axis=0))
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    for i in range(rows):
        keys = _mixed(keys * np.uint64(0x94D049BB133111EB) + least[i::rows])
    return keys.view(np.int64)


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose shingle sets have the similarity, exactly; two empty sets are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            stands = []
            for x, y in zip(batch["x"], batch["y"]):
                both = np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                stands.append(shared >= similarity * (len(both) - shared) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(stands, pa.bool_()))

    joined = pairs.join(sets.withColumnsRenamed({"__text": "b", "hashes": "y"}), "b").join(sets.withColumnsRenamed({"__text": "a", "hashes": "x"}), "a")
    # A set that is much smaller than the other cannot be alike.
    sized = F.least(F.length("x"), F.length("y")) >= F.lit(similarity - 1e-9) * F.greatest(F.length("x"), F.length("y"))
    return joined.where(sized).select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def _ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


BLOCK_TEXTS = 1024


def _unlinked(keyed: DataFrame, also: Column | None = None) -> DataFrame:
    """Pairs of different roots under a key of (key, __text, root, and what `also` needs, of x and y).

    Most texts of a key have one root, once they are linked. A pair has a text of another root at least: those, in
    blocks if there are very many, meet all texts of the key. A pair meets under the smallest of its keys alone: a row
    carries the smaller keys of its text, and two that share one of them have met there.
    """
    about = [c for c in keyed.columns if c != "key"]
    listed = keyed.groupBy(*about).agg(F.sort_array(F.collect_set("key")).alias("keys")).select(*about, "keys", F.posexplode("keys").alias("at", "key"))
    keys = keyed.groupBy("key").agg(F.mode("root", True).alias("major"), F.count("*").alias("n"))
    rows = listed.select(*about, "key", F.slice("keys", F.lit(1), F.col("at")).alias("smaller")).join(keys, "key")
    others = rows.where("root <> major")
    blocks = others.groupBy("key").agg(F.ceil(F.count("*") / BLOCK_TEXTS).cast("int").alias("blocks"))
    x = others.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("__text"), F.col("blocks")).cast("int")).alias("x")
    y = rows.join(blocks, "key").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("y")
    once = ((F.col("y.root") == F.col("y.major")) | (F.col("x.root") < F.col("y.root"))) & ~F.arrays_overlap("x.smaller", "y.smaller")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.block") == F.col("y.block")) & once & (F.lit(True) if also is None else also))
    return met.select(F.least("x.__text", "y.__text").alias("a"), F.greatest("x.__text", "y.__text").alias("b"))


BUCKET_BYTES = 32_000_000


def _shared_shingles(sets: DataFrame) -> DataFrame:
    """__text, shared: of how many of its shingles another text of the table has the same. Shingles are dealt by hash, packed, to buckets of bounded size."""
    size = sets.agg(F.sum(F.length("hashes"))).first()[0] or 0
    buckets = max(64, -(-size // BUCKET_BYTES))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, bucket, parts = [], [], []
            for text, blob in zip(batch["__text"].to_pylist(), batch["hashes"]):
                h = np.frombuffer(blob.as_buffer(), dtype=np.uint64)
                where = (h % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(where, kind="stable")
                cut = np.flatnonzero(np.diff(where[order])) + 1
                for part in np.split(order, cut) if len(h) else []:
                    texts.append(text)
                    bucket.append(int(where[part[0]]))
                    parts.append(h[part].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(bucket, pa.int32()), pa.array(parts, pa.binary())], names=["__text", "bucket", "hashes"])

    def count(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in table["hashes"]]
        _, which, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        first = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]])
        return pa.table({"__text": table["__text"], "shared": pa.array(np.add.reduceat((times[which] > 1).astype(np.int64), first))})

    dealt = sets.select("__text", "hashes").mapInArrow(deal, "__text binary, bucket int, hashes binary")
    counts = dealt.groupBy("bucket").applyInArrow(count, "__text binary, shared long")
    return counts.groupBy("__text").agg(F.sum("shared").alias("shared"))


def identity(text: Column) -> Column:
    """128 bits that stand for a text; a null one is an empty one."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, crowd: int = 32) -> DataFrame:
    """__text (see identity), root: texts with one root are near copies, by chains of close pairs.

    At a similarity of 0.8 a SimHash differs in 0.15 of its bits: keys of 28 bits, which keep unlike texts apart,
    would have to be 460 a text to miss 1 % of such pairs. Candidates share one of 20 COARSE keys of smallest
    shingle hashes instead, and exact shingle sets decide. The texts of a key meet its smallest first, those of a crowded
    key HUBS members; then texts of a key that are not linked yet meet each other, in a crowded one under FINE keys. Null texts count as empty, and those without words are copies of each other.
    """

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for pdf in batches:
            yield pd.DataFrame({"__text": pdf["__text"], "keys": [band_keys(shingle_hashes((t or "").encode("utf-8", "surrogatepass"), shingle)) for t in pdf["text"]]})

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"__text": pdf["__text"], "hashes": [shingle_hashes((t or "").encode("utf-8", "surrogatepass"), shingle).tobytes() for t in pdf["text"]]})

    def fine_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["__text", "root", "size", "shared"]].assign(keys=[band_keys(np.frombuffer(h, dtype=np.uint64), *FINE) for h in pdf["hashes"]])

    plain = docs.select(identity(F.col("text")).alias("__text"), "text")
    texts = materialise(plain.mapInPandas(keys, "__text binary, keys array<long>").dropDuplicates(["__text"]), "texts")
    keyed = texts.select("__text", F.explode("keys").alias("key"))
    # Most keys are of one text alone; the others are written out and used from there.
    more_hubs = [F.min_by("__text", F.xxhash64(F.lit(salt), "__text")) for salt in range(HUBS - 1)]
    hubs = keyed.groupBy("key").agg(F.min("__text").alias("hub"), F.max("__text").alias("__max"), F.count("*").alias("n"), F.array(*more_hubs).alias("more")).where("hub < __max").drop("__max")
    shared = materialise(keyed.join(hubs, "key"), "keys")
    used = shared.select("__text").distinct()
    sets = materialise(plain.join(used, "__text").mapInPandas(hashes, "__text binary, hashes binary").dropDuplicates(["__text"]), "sets")

    met = F.when(F.col("n") > crowd, F.concat(F.array("hub"), "more")).otherwise(F.array("hub"))
    tried = shared.select("__text", F.explode(met).alias("hub")).where("__text <> hub")
    tried = materialise(_ordered(tried, "__text", "hub"), "candidates")
    stands = materialise(_alike(tried, sets, similarity), "near-copies")
    roots = materialise(connected_components(stands), "components")
    rooted = shared.join(roots.withColumnRenamed("node", "__text"), "__text", "left").select("key", "n", "__text", F.coalesce("root", "__text").alias("root"))
    split = rooted.groupBy("key").agg(F.min("root").alias("__min"), F.max("root").alias("__max")).where("__min < __max")
    split = materialise(rooted.join(split.select("key"), "key"), "split-keys")
    # In a key of few texts, those that are not linked yet all meet. In a crowded one that would be the square of the crowd.
    # Two texts of x and y shingles that are similar enough share t / (1 + t) * (x + y) of them: a text that has fewer in common
    # with all others of crowded keys together has no partner. The rest meet under their fine keys, which unlike texts hardly share.
    few = _unlinked(split.where(F.col("n") <= crowd).select("key", "__text", "root"))
    crowds = materialise(sets.join(split.where(F.col("n") > crowd).select("__text", "root").distinct(), "__text"), "crowds")
    size = F.length("hashes") / 8
    able = crowds.join(_shared_shingles(crowds), "__text").withColumn("size", size).where(F.col("shared") >= F.lit(similarity - 1e-9) * F.col("size"))
    fine = able.mapInPandas(fine_keys, "__text binary, root binary, size double, shared long, keys array<long>").select("__text", "root", "size", "shared", F.explode("keys").alias("key"))
    fine = materialise(fine, "fine-keys")
    mixed = fine.groupBy("key").agg(F.min("root").alias("__min"), F.max("root").alias("__max")).where("__min < __max").select("key")
    enough = F.least("x.shared", "y.shared") >= F.lit(similarity / (1 + similarity) - 1e-9) * (F.col("x.size") + F.col("y.size"))
    more = materialise(few.union(_unlinked(fine.join(mixed, "key"), enough)).distinct().join(tried, ["a", "b"], "left_anti"), "candidates")
    found = materialise(_alike(more, sets, similarity), "near-copies")
    # What holds so far is a star a component.
    stands = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(found)
    roots = connected_components(stands)
    return texts.select("__text").join(roots.withColumnRenamed("node", "__text"), "__text", "left").select("__text", F.coalesce("root", "__text").alias("root"))


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each group of near copies: that of the smallest doc_id (null ids last), once.

    Groups are chains: a text that goes may be like the one that stays only by way of others. A null text is one of no words, and all of
    those are copies. An empty table gives an empty result. Other columns stay as they are; names that begin with __ are reserved.
    """
    rows = docs.select("doc_id", identity(F.col("text")).alias("__text"))
    groups = materialise(near_copies(docs, **options), "groups")
    firsts = rows.groupBy("__text").agg(F.min("doc_id").alias("doc_id")).join(groups, "__text")
    return _kept(docs, firsts.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "__text")).alias("k")))


def _kept(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Of docs the rows whose id and text are among k (no_id, doc_id, __text), each once."""
    kept = materialise(kept.select(F.col("k.__text").alias("__kept"), F.coalesce(F.col("k.doc_id"), F.lit(0)).alias("__id"), F.isnull("k.doc_id").alias("__null")), "kept")
    tagged = docs.select("*", identity(F.col("text")).alias("__kept"), F.coalesce("doc_id", F.lit(0)).alias("__id"), F.isnull("doc_id").alias("__null"))
    on = ["__kept", "__id", "__null"]
    return tagged.join(kept, on).dropDuplicates(on).select(*docs.columns)


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, seed: int = 42, distance: int = 2, blocks: int = 4, crowd: int = 16) -> DataFrame:
    """docs with one row of each component of close fingerprints (see near_duplicates): that of the smallest doc_id (null ids last), once.

    What is joined is fingerprints, not rows: each brings its first row. Null texts have no words. An empty table gives an empty
    result. Other columns stay as they are; names that begin with __ are reserved.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            fps = np.array([fingerprint(t, shingle, seed) for t in batch["text"].to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["__text"], pa.array(fps.view(np.int64))], names=["doc_id", "__text", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    body = F.coalesce("text", F.lit("")).cast("binary").alias("text")
    rows = docs.select("doc_id", identity(F.col("text")).alias("__text"), body).mapInArrow(run, f"doc_id {kind}, __text binary, fp long")
    first = F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "__text")).alias("k")
    fps = materialise(rows.groupBy("fp").agg(first), "distinct-fingerprints")
    roots = materialise(connected_components(links(fps.select(F.lit(0).alias("hashing"), "fp"), distance, blocks, crowd)), "components")
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(F.coalesce("root", "fp").alias("root"), "k")
    return _kept(docs, rooted.groupBy("root").agg(F.min("k").alias("k")))
