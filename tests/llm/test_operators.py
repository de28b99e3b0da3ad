"""Each operator against brute force, and its edge cases: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import ann, components, cotrain, licenses, mixing, packing, sharding, simhash, substring, topk, toxicity
from tidemark.llm.fm_index import FmIndex, match_windows
from tidemark.llm.linear import Rows, fit_logistic

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(40)]


def table(spark, texts, ids=None, schema=SCHEMA):
    ids = ids if ids is not None else range(len(texts))
    return spark.createDataFrame([(i, t, "en", f"s{n % 3}" if n % 7 else None, len(t or "")) for n, (i, t) in enumerate(zip(ids, texts))], schema)


def sentence(rng, n, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, an empty and a very long text, repeated rows, and a column that clashes with results."""
    rng = random.Random(4)
    texts = [None, "", " \n\t", "one", "two words", sentence(rng, 60), sentence(rng, 60_000), "Zoë ünï x　y"]
    df = table(spark, texts * 2, [0, 1, 2, 3, 4, 5, 6, None] * 2)
    clash = {c: F.lit("mine") for c in ("score", "shard", "size", "rank", "label", "_text", "fp", "component_id", "n_words", "piece", "length", "mix_tokens", "mix_epoch", "keep", "slot", "_key", "_block", "_id", "_null", "_kept", "_batch", "_group", "sequence_id", "offset", "_toxic", "dim", "ids_crc32")}
    return df.withColumns(clash)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


# 1


def test_licenses_equal_brute_force(spark):
    rng = random.Random(2)
    texts = []
    for i in range(120):
        body = sentence(rng, rng.randrange(0, 200)).split()
        if i % 2:
            name = rng.choice(list(licenses.TEMPLATES))
            words = licenses.TEMPLATES[name].split()
            if i % 4 == 3 and len(words) > 25:
                words[rng.randrange(len(words))] = "changed"
            at = rng.randrange(len(body) + 1)
            body[at:at] = words
        texts.append(" ".join(body))
    want = set()
    for i, t in enumerate(texts):
        w = licenses.words_of(t.encode())
        for name, template in licenses.TEMPLATES.items():
            tw = licenses.words_of(template.encode())
            k = min(5, len(tw))
            shingles = {tuple(tw[j : j + k]) for j in range(len(tw) - k + 1)}
            inside = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
            if len(shingles & inside) / len(shingles) >= 0.8:
                want.add((i, name))
    got = licenses.scan(table(spark, texts)).collect()
    assert {(r["doc_id"], r["license"]) for r in got} == want and len(got) == len(want)
    for r in got:
        assert r["containment"] >= 0.8 and r["first_word"] + r["n_words"] <= len(licenses.words_of(texts[r["doc_id"]].encode()))


def test_the_best_of_overlapping_licenses(spark):
    t = licenses.TEMPLATES
    texts = ["so " + t["GPL-2.0-header"] + " far", t["BSD-3-Clause"], t["MIT-text"] + " and " + t["ISC"], t["BSD-2-Clause"].lower()]
    got = licenses.scan(table(spark, texts)).where("best").collect()
    assert sorted((r["doc_id"], r["license"]) for r in got) == [(0, "GPL-2.0-header"), (1, "BSD-3-Clause"), (2, "ISC"), (2, "MIT-text"), (3, "BSD-2-Clause")]


def test_licenses_odd(spark, odd):
    assert licenses.scan(odd).count() == 0
    assert licenses.scan(odd.limit(0)).count() == 0
    assert licenses.scan(odd, {"short": "Two words"}).count() == 2
    assert licenses.bands_for(0.8, 1e-4) == 33


# 2


def test_mixing_reads_whole_epochs_and_meets_targets(spark, documents):
    one = lambda **kw: mixing.mix(documents.select("doc_id", "source", "text"), mixing.token_count(F.col("text")), tie_by=["doc_id"], **kw)
    rows = one(max_epochs=2.0).collect()
    assert {r["doc_id"] for r in rows} == {r[0] for r in documents.select("doc_id").collect()}
    assert max(Counter((r["doc_id"], r["mix_epoch"]) for r in rows).values()) == 1
    tokens, natural = Counter(), Counter()
    for r in rows:
        tokens[r["source"]] += r["mix_tokens"]
    for r in rows:
        if not r["mix_epoch"]:
            natural[r["source"]] += r["mix_tokens"]
    assert all(tokens[s] <= 2 * natural[s] + 1e-6 for s in tokens) and max(tokens[s] / natural[s] for s in tokens) > 1.5
    rows = one(target_entropy=0.99).collect()
    weights = {r["source"]: r["mix_weight"] for r in rows}
    entropy = -sum(w * np.log(w) for w in weights.values())
    assert abs(sum(weights.values()) - 1) < 1e-9 and entropy >= 0.99 * np.log(len(weights)) - 1e-6
    longest = Counter()
    for r in rows:
        longest[r["source"]] = max(longest[r["source"]], r["mix_tokens"])
    for s, w in weights.items():
        read = sum(r["mix_tokens"] for r in rows if r["source"] == s)
        assert w * sum(natural.values()) - 1 <= read <= w * sum(natural.values()) + longest[s]


def brute_exponent(tokens, entropy=None, max_epochs=4.0, budget=None):
    p = np.array(tokens) / sum(tokens)
    w = lambda a: p**a / (p**a).sum()
    grid = np.linspace(0, 1, 100_001)
    if entropy is not None:
        budget = sum(tokens) if budget is None else budget
        grid = grid[max(i for i, a in enumerate(grid) if -(w(a) * np.log(w(a))).sum() >= entropy * np.log(len(p)) - 1e-9) :]
    for a in grid:
        whole = budget if budget is not None else 1 / (w(a) / tokens).min()
        if whole * (w(a) / tokens).max() <= max_epochs * (1 + 1e-6):
            return a
    raise AssertionError


@pytest.mark.parametrize("options", [dict(entropy=0.9), dict(entropy=0.99, max_epochs=2.0), dict(max_epochs=3.0), dict(max_epochs=1.5, budget=2000.0), dict(entropy=1.0, max_epochs=1e9)])
def test_exponent_equals_a_scan(spark, options):
    tokens = [1000, 300, 300, 50, 7, 1]
    sizes = spark.createDataFrame([(t,) for t in tokens], "source_tokens long")
    a, _ = mixing.find_exponent(sizes, options.get("entropy"), options.get("max_epochs", 4.0), options.get("budget"))
    assert abs(a - brute_exponent(tokens, **options)) < 3e-5


def test_mixing_equals_a_brute_force_dealer(spark):
    """Weights, budgets and the order of blocks and documents, recomputed from the sizes and hashes."""
    rng = random.Random(5)
    texts = [sentence(rng, rng.randrange(0, 25)) for _ in range(400)]
    df = table(spark, texts).drop("n_chars")
    rows = mixing.mix(df, mixing.token_count(F.col("text")), target_entropy=0.999, max_epochs=2.5, tie_by=["doc_id"], least_blocks=8).collect()
    hashed = df.withColumn("key", F.xxhash64(F.lit(11), "doc_id"))
    docs = [(r["source"], r["key"], r["doc_id"], len((r["text"] or "").split()) + 1) for r in hashed.collect()]
    orders = {(r["e"], r["b"]): r["h"] for r in spark.range(3).select(F.col("id").cast("int").alias("e"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("b")).withColumn("h", F.xxhash64(F.lit(11), "e", "b")).collect()}
    inner = {(r["key"], r["e"]): r["h"] for r in hashed.select("key", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("e")).withColumn("h", F.xxhash64("key", "e")).collect()}
    tokens = Counter()
    for s, _, _, n in docs:
        tokens[s] += n
    total = sum(tokens.values())
    a = brute_exponent(list(tokens.values()), 0.999, 2.5)
    norm = sum((t / total) ** a for t in tokens.values())
    for s, t in tokens.items():
        budget = total * (t / total) ** a / norm
        dealt = sorted((e, orders[e, key % 8], key % 8, inner[key, e], key, d, n) for src, key, d, n in docs if src == s for e in range(3))
        want, used = [], 0
        for e, *_, d, n in dealt:
            if used < budget - 0.2:
                want.append((e, d))
            used += n
        got = sorted(((r["mix_position"], r["mix_epoch"], r["doc_id"]) for r in rows if r["source"] == s))
        assert abs(len(got) - len(want)) <= 1 and all((e, d) == w for (_, e, d), w in zip(got, want))


def test_a_tiny_source_is_not_read_without_end(spark):
    df = spark.createDataFrame([(i, "big", "w " * 2000) for i in range(300)] + [(300, "tiny", "w")], "doc_id long, source string, text string")
    rows = mixing.mix(df, mixing.token_count(F.col("text")), target_entropy=0.97, max_epochs=4.0, tie_by=["doc_id"]).collect()
    reads = Counter(r["doc_id"] for r in rows)
    assert reads[300] <= 4 and len(reads) == 301


def test_mixing_positions_are_running_sums(spark):
    rng = random.Random(8)
    df = table(spark, [sentence(rng, rng.randrange(1, 30)) for _ in range(200)])
    for s in (None, "s0"):
        rows = sorted((r for r in mixing.mix(df, mixing.token_count(F.col("text")), max_epochs=3.0).collect() if r["source"] == s), key=lambda r: r["mix_position"])
        total, budget = 0, None
        for r in rows:
            if r["mix_position"] > 0:
                budget = budget or total / r["mix_position"]
                assert abs(r["mix_position"] * budget - total) < 1e-6
            total += r["mix_tokens"]


def test_mixing_odd(odd):
    got = mixing.mix(odd, mixing.token_count(F.col("text")), max_epochs=1.0)
    theirs = [c for c in odd.columns if c not in mixing.ADDED]
    assert got.count() == odd.count() and got.columns == [*theirs, *mixing.ADDED] and set(mixing.ADDED) & set(odd.columns)
    assert mixing.mix(odd.limit(0), mixing.token_count(F.col("text")), target_entropy=0.9).count() == 0


# 3


def test_ring_equals_a_walk(spark):
    n, shards, vnodes = 500, 5, 7
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("x").alias("t"))
    at = {r[0]: r[1] for r in df.select("doc_id", F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 32))).collect()}
    points = sharding.ring(shards, vnodes)
    room = [n // shards + (s < n % shards) for s in range(shards)]
    arcs = Counter()
    for d in at:
        arcs[next((i for i, (p, _) in enumerate(points) if p >= at[d]), 0)] += 1
    want, used = {}, Counter()
    for arc in range(len(points)):
        for k in range(arcs[arc]):
            s = next(points[(arc + j) % len(points)][1] for j in range(len(points)) if used[points[(arc + j) % len(points)][1]] < room[points[(arc + j) % len(points)][1]])
            want[arc, k] = s
            used[s] += 1
    got = sharding.assign(df, "doc_id", ["t"], shards, vnodes).collect()
    assert Counter(r["shard"] for r in got) == Counter(want.values()) == Counter(dict(enumerate(room)))
    for s in range(shards):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(room[s]))
    plain = {r["doc_id"]: r["shard"] for r in sharding.assign(df, "doc_id", ["t"], shards, vnodes, load=float(shards)).collect()}
    assert all(plain[d] == next((s for p, s in points if p >= at[d]), points[0][1]) for d in at)
    grown = {r["doc_id"]: r["shard"] for r in sharding.assign(df, "doc_id", ["t"], shards + 1, vnodes, load=float(shards + 1)).collect()}
    assert all(grown[d] in (plain[d], shards) for d in at)


@pytest.mark.parametrize("load, most, between", [(None, 0.13, 0.06), (1.25, 0.08, 0.01)])
def test_a_new_shard_moves_few_rows(spark, load, most, between):
    """The registered law (no load: rooms without slack) and a bounded load: a 17th shard should take 1 / 17 = 0.059."""
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("t"))
    old, new = ({r["doc_id"]: r["shard"] for r in sharding.assign(df, "doc_id", ["t"], n, load=load).collect()} for n in (16, 17))
    moved = [d for d in old if old[d] != new[d]]
    stray = [d for d in moved if new[d] != 16]
    print(load, len(moved) / 30_000, len(stray) / 30_000)
    assert len(moved) <= most * 30_000 and len(stray) <= between * 30_000


def test_sharding_odd(odd):
    got = sharding.shard_documents(odd).collect()
    assert len(got) == 16 and sorted(Counter(r["shard"] for r in got).values()) == [1] * 16
    by = {(r["doc_id"], r["size"]): r["text_crc32"] for r in got}
    assert by[0, 1] == 0 and by[3, 4] == zlib.crc32(b"one")
    assert sharding.shard_documents(odd.limit(0)).count() == 0


# 4 and 8


def test_logistic_separates():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 200).astype(float)
    rows = [np.array([0, 1 + int(v) if rng.random() < 0.95 else 3]) for v in y]
    w, b = fit_logistic(Rows(rows, 4), y, l2=0.1)
    assert (((Rows(rows, 4).times(w) + b) > 0) == (y > 0)).mean() > 0.9


def test_toxicity_held_out(spark):
    big = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    got = toxicity.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    clean = [r for r in got if r["toxic"] == 0]
    assert sum(r["predicted"] for r in clean) <= 0.02 * len(clean)
    bad = [r["score"] for r in got if r["toxic"] == 1]
    assert np.mean(bad) > 3 * np.mean([r["score"] for r in clean])


@pytest.mark.parametrize("classify", [toxicity.classify, cotrain.classify])
def test_classifiers_odd(spark, odd, labels, documents, classify):
    model_docs = documents.unionByName(odd.select(documents.columns))
    got = classify(model_docs, labels).collect()
    assert len(got) == documents.count() + 16 and all(0 <= r["score"] <= 1 for r in got)
    assert classify(odd, labels.limit(0)).count() == 16
    assert classify(odd.limit(0), labels).count() == 0


def test_held_out_labels_are_never_read(spark, labels):
    from zlib import crc32

    ids = {r["doc_id"] for r in labels.where(~toxicity.held_out(F.col("doc_id"))).collect()}
    assert ids == {r["doc_id"] for r in labels.collect() if crc32(str(r["doc_id"]).encode()) % 5}


def test_quality_held_out(spark):
    big = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    got = cotrain.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["keep"] == (r["quality"] == 1) for r in got]) > 0.9
    good = [r["keep"] for r in got if r["quality"] == 1]
    assert np.mean(good) > 0.97


def test_views_teach_each_other(spark):
    """Unlabelled pages shout words that no label has: the page view knows shouting, and teaches the text view the words."""
    rng = random.Random(3)
    good, bad, new = ([f"{c}{rng.choice('aeiou')}{rng.choice('lmnr')}{i}" for i in range(30)] for c in ("good", "bad", "fresh"))
    rows, marks = [], []
    for i in range(240):
        marks.append((i, i % 2))
        rows.append((i, sentence(rng, 60, good) if i % 2 else sentence(rng, 60, bad).upper(), "en", "s"))
    rows += [(1000 + i, sentence(rng, 60, new + bad[:3]).upper() if i % 2 else sentence(rng, 60, good), "en", "s") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    calm = [sentence(rng, 60, new) for _ in range(30)]  # without the shouting: only the text view can tell
    alone, taught = (cotrain.train(docs, labels, rounds=r, per_round=60).measures(calm, ["en"] * 30, ["s"] * 30) for r in (0, 2))
    assert taught["text"].mean() < alone["text"].mean() - 1 and (taught["text"] < 0).mean() > 0.9


def test_pseudo_labels_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    x = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 3, (500, 2)))]
    got = {tuple(r) for r in cotrain.most_confident(spark.createDataFrame(x, "doc_id long, text double, page double"), 0.75, 40).collect()}
    want = set()
    for v in (0, 1):
        low, high = sorted(x, key=lambda r: r[1 + v])[:10], sorted(x, key=lambda r: -r[1 + v])[:30]
        want |= {(i, 0.0, 1 - v) for i, *m in low if m[v] < -1} | {(i, 1.0, 1 - v) for i, *m in high if m[v] > 1}
    assert got == want


# 5 and 10


def vectors(spark, seed, n, d=8, ties=True):
    rng = np.random.default_rng(seed)
    x = rng.integers(-50, 50, (n, d)).tolist()
    rows = [(i, x[i % 40 if ties and i % 3 == 0 else i]) for i in range(n)]
    return spark.createDataFrame(rows + [(n, None), (None, [1] * d), (n + 1, [1, None] + [1] * (d - 2))], "vec_id long, embedding array<long>"), {i: np.array(v) for i, v in rows}


@pytest.mark.parametrize("n", [0, 1, 7, 400])
def test_topk_equals_brute_force(spark, n):
    df, x = vectors(spark, n, n)
    got = {}
    for r in topk.search(df, F.col("id") % 10 == 0, k=5, lists=3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, n, 10):
        want = sorted(((-int(x[q] @ x[c]), c) for c in x if c != q))[:5]
        assert sorted(got.get(q, [])) == [(k + 1, c, -s) for k, (s, c) in enumerate(want)]


def test_topk_query_without_vectors_that_are_not_finite(spark, tmp_path):
    import duckdb

    from tidemark.llm.queries import ORACLE_SQL, QUERIES

    nan, inf = float("nan"), float("inf")
    rows = [(i, [i % 7 - 3.3, i % 5 / 3]) for i in range(40)] + [(100, [nan, 1.0]), (41, [nan, 2.0]), (42, [inf, 0.0]), (43, [0.5, -inf]), (44, None), (45, [None, 1.0])]
    rows += [(46, [0.0001, 2.5]), (46, [0.0002, -2.5]), (46, [inf, 1.0])]  # the greater of the finite two stands, though they start alike when quantised
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in QUERIES["op5_exact_topk"](spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(con.sql(ORACLE_SQL["op5_exact_topk"]).fetchall()) and len(got) == 10


def test_topk_of_vectors_that_repeat_or_differ_in_length(spark):
    """A third of all rows share a vector, and ids of a third ask with it: ties go to the smaller ids, own rows take no part."""
    rng = np.random.default_rng(3)
    x = {i: [1, 2, 3, 4] if i % 3 == 0 else rng.integers(-3, 4, 1 if i % 17 == 0 else 4).tolist() for i in range(300)}
    x |= {300: [], 310: []}
    got = {}
    for r in topk.search(spark.createDataFrame(list(x.items()), "vec_id long, embedding array<long>"), F.col("id") % 10 == 0, k=7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, 311, 10):
        want = sorted((-sum(a * b for a, b in zip(x[q], x[c])), c) for c in x if c != q and len(x[c]) == len(x[q]))[:7]
        assert sorted(got.get(q, [])) == [(k + 1, c, -s) for k, (s, c) in enumerate(want)]


def test_topk_beyond_64_bits(spark):
    big = 1 << 62
    x = {0: [big, 3], 1: [5, -1], 2: [-big, 1], 3: [big, big], 4: [1, 2], 10: [2, 2], 20: [-(1 << 63), 1]}
    got = {}
    for r in topk.search(spark.createDataFrame(list(x.items()), "vec_id long, embedding array<long>"), F.col("id") % 10 == 0, k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in (0, 10, 20):
        want = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(x[q], x[c])))), c) for c in x if c != q)[:5]
        assert sorted(got[q]) == [(k + 1, c, -s) for k, (s, c) in enumerate(want)]
    huge = spark.createDataFrame([(0, [1e300, -1e300, float("nan")])], "i int, v array<double>").select(topk.quantise(F.col("v"))).first()[0]
    assert huge == [(1 << 63) - 1, -(1 << 63), None]


def test_topk_repeats_and_large_numbers(spark):
    df = spark.createDataFrame([(0, [2**29, 1]), (0, [2**29, 1]), (1, [2**29, 3]), (2, [-5, 2])], "vec_id long, embedding array<long>")
    assert [(r["vec_id"], r["score"]) for r in topk.search(df, F.col("id") == 0).orderBy("rank").collect()] == [(1, 2**58 + 3), (2, -5 * 2**29 + 2)]


@pytest.mark.parametrize("n, options", [(0, {}), (1, {}), (5, {}), (3000, {}), (3000, dict(sample_rows=200, split_rows=60))])
def test_ann_recall_and_exact_scores(spark, n, options):
    rng = np.random.default_rng(n)
    centre = rng.normal(size=(12, 16))
    x = (centre[rng.integers(0, 12, n)] + 0.4 * rng.normal(size=(n, 16))).astype(np.float32)
    if n > 5:
        x[rng.random(n) < 0.1] = x[7]  # a leaf of equal vectors that no tree can split
    rows = [(i, [float(v) for v in x[i]]) for i in range(n)] + [(n, [0.0] * 16), (n + 1, [float("nan")] * 16), (n + 2, None), (n + 10, [1.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(df, F.col("id") % 20 == 0, k=20, **options).collect()
    hits = total = 0
    y = x.astype(np.float64)
    for q in range(0, n, 20):
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, _, _ in mine] == list(range(1, min(20, n - 1) + 1)) and q not in {v for _, v, _ in mine}
        assert all(abs(s - y[q] @ y[v]) < 1e-9 for _, v, s in mine)
        true = sorted((-(y[q] @ y[c]), c) for c in range(n) if c != q)[:20]
        hits += sum(s >= -true[-1][0] - 1e-9 for _, _, s in mine)
        total += len(true)
    assert hits >= 0.9 * total


def test_ann_tree_grows_with_the_table(spark):
    """Clusters that a small sample cannot tell apart: leaves split on their own rows, and few rows are compared."""
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(60, 12))
    x = centre[rng.integers(0, 60, 4000)] + 0.1 * rng.normal(size=(4000, 12))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    forest = ann.Forest(rows, sample_rows=150, split_rows=100)
    assert forest.lower and forest.rows.count() == forest.rows.select("id").distinct().count() == 4000
    sizes = {r["leaf"]: r["rows"] for r in forest.sizes.collect()}
    assert max(sizes.values()) <= 100 and len(sizes) > 40
    visits = ann._calibrate(forest, 20, 0.95, 100)
    walked = forest.walk(rows.where("id % 50 = 0"), visits, 21).join(forest.sizes, "leaf").groupBy("id").agg(F.sum("rows").alias("n")).collect()
    assert len(walked) == 80 and np.mean([r["n"] for r in walked]) < 4000 / 5


def test_ann_recall_on_queries_that_did_not_calibrate(spark):
    """The given embeddings have no clusters: recall holds, at the price of many visits."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("embedding is not null")
    x = {r["vec_id"]: np.array(r["embedding"], dtype=np.float64) for r in df.collect()}
    used = {r["vec_id"] for r in df.orderBy(F.xxhash64(F.lit(3), "vec_id"), "vec_id").limit(ann.CALIBRATION_QUERIES).collect()}
    found = {}
    for r in ann.search(df, F.col("id") % 20 == 0, k=20).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = [len(found[q] & {c for _, c in sorted((-(x[q] @ x[c]), c) for c in x if c != q)[:20]}) for q in found if q not in used]
    assert len(hits) > 50 and sum(hits) >= 0.9 * 20 * len(hits)


def test_ann_widens_until_there_are_enough(spark):
    df = spark.createDataFrame([(i, [float(i % 5 == 0), 1.0]) for i in range(300)], "vec_id long, embedding array<float>")
    got = ann.search(df, F.col("id") == 0, k=20).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [5 * i for i in range(1, 21)]  # ties: the smaller ids


# 6


def test_packing_round_trip(spark, odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["", None, "It's, <|endoftext|>, x<|ENDOFTEXT|>.", "don', a., 3.14 Straße É́t é", "word " * 5000] + [sentence(random.Random(i), 300) for i in range(30)]
    pieces = packing.tokenise(table(spark, texts), public_tokenizers.path("word_bpe_49k.json"), 256)
    placed = packing.pack(pieces.drop("ids"), 256, group_pieces=20).cache()
    ids = {(r["doc_id"], r["piece"]): np.frombuffer(r["ids"], dtype="<u4") for r in pieces.collect()}
    for i, t in enumerate(texts):
        want = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        got = [ids[k] for k in sorted(ids) if k[0] == i]
        assert np.concatenate(got).tolist() == want and all(len(g) == 256 for g in got[:-1])
    used = {}
    for r in placed.collect():
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in used.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 256
    whole = packing.sequences(pieces, placed).collect()
    assert sum(len(r["pieces"]) for r in whole) == len(ids)
    assert packing.tokenise(odd, public_tokenizers.path("word_bpe_49k.json")).where("piece = 0").count() == 16
    assert packing.pack(placed.drop("sequence_id", "offset").limit(0)).count() == 0


def test_sum_of_squares_is_tight():
    sizes = np.random.default_rng(1).integers(1, 900, 3000)
    bins, offsets = packing.sum_of_squares(sizes, 4096)
    assert np.bincount(bins, weights=sizes).max() <= 4096 and bins.max() + 1 <= -(-sizes.sum() // 4096) + 1
    with pytest.raises(ValueError):
        packing.sum_of_squares(np.array([5000]), 4096)


# 7


def brute_repeats(rows, window):
    docs = [(i if i is not None else 1 << 62, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in docs:
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            first[x] = min(first.get(x, 1 << 63), i)
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


@pytest.mark.parametrize("window, crowded", [(13, 5000), (13, 2), (4, 3), (3, 5000)])
def test_repeats_equal_brute_force(spark, window, crowded):
    rng = random.Random(window)
    passages = [sentence(rng, rng.randrange(5, 40)) for _ in range(6)]
    texts = []
    for i in range(150):
        parts = [sentence(rng, rng.randrange(0, 30), WORDS[: 2 + i % 38]) for _ in range(3)]
        parts.insert(1, rng.choice(passages))
        texts.append(rng.choice([" ", "\n", " \t "]).join(parts))
    texts += [texts[3], texts[3], "a " * 500, "a " * 300, None, ""]
    ids = [*rng.sample(range(1000), 150), 2000, 2000, 2001, 2002, 2003, None]
    got = substring.remove_repeats(table(spark, texts, ids).repartition(6), window, crowded).collect()
    want = Counter((i, *w) for i, w in zip(ids, brute_repeats(list(zip(ids, texts)), window)))
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], " ".join((r["text"] or "").split())) for r in got) == want
    for r in got:
        if not r["n_removed"]:
            assert r["text"] in texts


def test_repeats_odd(odd):
    got = substring.remove_repeats(odd)
    assert got.count() == 16 and got.columns == [c for c in odd.columns if c != "n_words"] + ["n_words", "n_removed"]
    assert substring.remove_repeats(odd.limit(0)).count() == 0


def test_fm_index_finds_what_a_scan_finds():
    rng = np.random.default_rng(1)
    s = rng.integers(1, 4, 400)
    s[rng.integers(0, 400, 10)] = 0
    s[100:120] = s[10:30]
    s[-1] = 0
    q = rng.integers(1, 4, 60)
    for window in (2, 5, 13):
        index = FmIndex(s, window, np.arange(400))
        at, low, high = match_windows(index, q, np.array([60]), np.array([60]))
        got = {int(a): sorted(index.values[i:j].tolist()) for a, i, j in zip(at, low, high)}
        assert index.least(low, high).tolist() == [got[int(a)][0] for a in at]
        assert not any(len(v) == len(s) and v is not index.values for v in vars(index).values() if isinstance(v, np.ndarray))
        for k in range(60 - window + 1):
            assert got.get(k, []) == [j for j in range(400 - window + 1) if (s[j : j + window] == q[k : k + window]).all()]


# 9


def brute_fingerprint(text):
    w = (text or "").encode().translate(simhash.LOWER).split()
    if not w:
        return 0
    parts = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("crowd", [16, 1])
def test_links_of_fingerprints_equal_brute_force(spark, crowd):
    rng = random.Random(crowd)
    fps = {0}
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            for b in rng.sample(range(64), rng.choice([1, 2, 3])):
                x ^= 1 << b
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    want = components_of(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2])
    df = spark.createDataFrame([(0, x) for x in signed], "hashing int, fp long")
    at = {x: i for i, x in enumerate(signed)}
    found = simhash.links(df, 2, 4, crowd).collect()
    assert components_of(len(fps), [(at[r["a"]], at[r["b"]]) for r in found]) == want
    assert len(found) <= 65 * len(fps)


def test_fingerprints_and_components(spark):
    rng = random.Random(1)
    base = sentence(rng, 80)
    texts = [base, base.upper(), base + " w1", "", None, " ", "a", "a b", "A B", sentence(rng, 5), sentence(rng, 70_000)]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i]["fp"] % (1 << 64) == brute_fingerprint(t)
    fps = [brute_fingerprint(t) for t in texts]
    assert [got[i]["component_id"] for i in range(len(texts))] == components_of(len(texts), [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2])


def test_simhash_odd(odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == 16 and {r["component_id"] for r in got if r["fp"] == 0} == {0}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
    kept = simhash.drop_near_copies(odd)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, i) for i in (0, 3, 4, 5, 6)] + [(True, 0)]
    assert kept.columns == odd.columns and simhash.drop_near_copies(odd.limit(0)).count() == 0


def shingles(text, n=5):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def test_near_copies_of_edited_passages(spark):
    """Appended, cut and replaced passages change the set of words; pairs of 0.8 and more meet all the same."""
    rng = random.Random(12)
    texts = []
    for i in range(150):
        w = [f"x{rng.randrange(50_000)}" for _ in range(200)]
        block = [f"y{rng.randrange(50_000)}" for _ in range(48)]
        at = rng.randrange(20, 160)
        texts += [" ".join(w), " ".join([w + block, w[:162], w[:at] + block[:16] + w[at + 16 :], w[:150]][i % 4])]
    alike = [len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) >= 0.8 for a, b in zip(texts[::2], texts[1::2])]
    assert alike == [i % 4 != 3 for i in range(150)]
    kept = {r["doc_id"] for r in simhash.drop_near_copies(table(spark, texts)).collect()}
    stayed = [2 * i + 1 in kept for i in range(150)]
    assert all(2 * i in kept for i in range(150)) and stayed == [not a for a in alike]


def test_near_copies_meet_more_than_their_hub(spark):
    """Chains of edits, unlike their ends, and crowds of them: components of all pairs of 0.8 by brute force."""
    rng = random.Random(21)
    texts = []
    for g in range(6):
        w = [f"g{g}x{rng.randrange(50_000)}" for _ in range(120)]
        for _ in range(40 if g < 2 else 8):
            texts.append(" ".join(w))
            at = rng.randrange(110)
            w = w[:at] + [f"y{rng.randrange(50_000)}" for _ in range(rng.choice([3, 5, 9, 14]))] + w[at + rng.choice([3, 5, 9]) :]
    sets = [shingles(t) for t in texts]
    n = len(texts)
    close = [(i, j) for i in range(n) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = components_of(n, close)
    for crowd in (32, 2):
        roots = {r["__text"]: r["root"] for r in simhash.near_copies(table(spark, texts), crowd=crowd).collect()}
        ids = {r["doc_id"]: r["t"] for r in table(spark, texts).select("doc_id", simhash.identity(F.col("text")).alias("t")).collect()}
        first = {}
        assert [first.setdefault(roots[ids[i]], i) for i in range(n)] == want


def test_unlinked_pairs_come_once(spark):
    rng = np.random.default_rng(11)
    texts = {bytes([i]): (bytes([int(rng.choice([0, 1, 2, i], p=[0.6, 0.2, 0.1, 0.1]))]), set(rng.integers(0, 12, 6).tolist())) for i in range(40)}
    rows = [(key, text, root) for text, (root, keys) in texts.items() for key in keys]
    keyed = spark.createDataFrame(rows, "key long, __text binary, root binary")
    met = [(bytes(r["a"]), bytes(r["b"])) for r in simhash._unlinked(keyed).collect()]
    wanted = {(a, b) for a in texts for b in texts if a < b and texts[a][0] != texts[b][0] and texts[a][1] & texts[b][1]}
    assert len(met) == len(set(met)) and set(met) == wanted


def test_near_copies_by_similarity(spark):
    rng = random.Random(9)
    texts, groups = [], []
    for g in range(20):
        words = sentence(rng, 300, [f"g{g}x{i}" for i in range(200)]).split()
        for _ in range(4):
            copy = list(words)
            for k in rng.sample(range(300), 2):  # two copies differ in about 20 of 300 shingles: similarity about 0.87
                copy[k] = f"new{rng.random()}"
            texts.append(" ".join(copy))
            groups.append(g)
    kept = [r["doc_id"] for r in simhash.drop_near_copies(table(spark, texts)).collect()]
    left = Counter(groups[i] for i in kept)
    assert len(left) == 20 and sum(left.values()) <= 23


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (5, 5)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# The pipeline


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, docs, DATA)
        assert after.columns == docs.columns, name
        docs = spark.createDataFrame(after.collect(), after.schema)
        if name == "simhash":
            assert docs.count() == docs.select(F.sha2("text", 256)).distinct().count()
        if name == "substring":
            rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {r[0] for r in rows} == {r["doc_id"] for r in docs.collect()}
    packed = P.run(spark, DATA)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} <= {i for i, _ in rows}
    full = packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count()
    assert full == 0


def test_pipeline_rows_become_sequences_of_every_read(spark):
    import corpus_pipeline as P
    from tokenizers import Tokenizer

    stages = dict(P.STAGES)
    docs = stages["substring"](spark, stages["simhash"](spark, spark.read.parquet(f"{DATA}/documents.parquet").limit(120), DATA), DATA)
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    mixed = stages["mixing"](spark, docs, DATA)
    mixed = spark.createDataFrame(mixed.collect(), mixed.schema)
    reads = Counter(r["doc_id"] for r in mixed.collect())
    assert max(reads.values()) == 2
    packed = stages["packing"](spark, mixed, DATA)
    packed = spark.createDataFrame(packed.collect(), packed.schema)
    keys = [(r["doc_id"], r["read"], r["piece"]) for r in packed.collect()]
    assert len(set(keys)) == len(keys) and {(d, n) for d, n, _ in keys} == {(d, n) for d, k in reads.items() for n in range(k)}
    pieces = packing.tokenise(docs, public_tokenizers.path("word_bpe_49k.json"))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r["doc_id"]: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    seen = Counter()
    for r in packing.sequences(pieces, packed).collect():
        at = 0
        for p in r["pieces"]:
            ids = np.frombuffer(p["ids"], dtype="<u4").tolist()
            assert p["offset"] == at and ids == want[p["doc_id"]][4096 * p["piece"] :][:4096]
            at += len(ids)
            seen[p["doc_id"]] += len(ids)
        assert at <= 4096
    assert seen == {d: n * len(want[d]) for d, n in reads.items()}


def test_pipeline_stages_equal_brute_force(spark):
    import corpus_pipeline as P

    stages = dict(P.STAGES)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    scores = {r["doc_id"]: r["score"] for r in toxicity.classify(docs, labels).collect()}
    assert {r["doc_id"] for r in stages["toxicity"](spark, docs, DATA).collect()} == {d for d, s in scores.items() if s < 0.5}

    sets = [shingles(r["text"]) for r in rows]
    root = components_of(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    assert {r["doc_id"] for r in stages["simhash"](spark, docs, DATA).collect()} == {rows[i]["doc_id"] for i in set(root)}

    want = {}
    for r, (n, gone, left) in zip(rows, brute_repeats([(r["doc_id"], r["text"]) for r in rows], 13)):
        if not gone or gone < n:
            want[r["doc_id"]] = left
    got = {r["doc_id"]: r for r in stages["substring"](spark, docs, DATA).collect()}
    assert set(got) == set(want)
    assert all(got[d]["text"].encode().split() == t.encode().split() and got[d]["n_chars"] == len(got[d]["text"]) for d, t in want.items())

    mixed = stages["mixing"](spark, docs, DATA).collect()
    words = {r["doc_id"]: len(r["text"].encode().split()) + 1 for r in rows}
    reads, tokens = Counter(r["doc_id"] for r in mixed), Counter()
    for r in rows:
        tokens[r["source"]] += words[r["doc_id"]]
    a = brute_exponent(list(tokens.values()), None, 2.0)
    w = {s: (t / sum(tokens.values())) ** a for s, t in tokens.items()}
    budget = 1 / min(w[s] / tokens[s] for s in w)
    for s in tokens:
        dealt = sum(reads[r["doc_id"]] * words[r["doc_id"]] for r in rows if r["source"] == s)
        assert w[s] * budget - 1 <= dealt <= w[s] * budget + max(words.values()) and {reads[r["doc_id"]] for r in rows if r["source"] == s} <= {1, 2}

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = Counter()
    for r in stages["packing"](spark, docs, DATA).collect():
        lengths[r["doc_id"]] += r["length"]
    assert lengths == {r["doc_id"]: len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in rows}


def test_pipeline_stages_odd(spark, odd):
    import corpus_pipeline as P

    docs = odd.withColumn("lang", F.when(F.col("doc_id") > 2, F.col("lang")))
    for name, stage in P.STAGES:
        some, none = stage(spark, docs, DATA), stage(spark, docs.limit(0), DATA)
        assert none.count() == 0 and some.count() > 0, name
        if name != "packing":
            assert some.columns == none.columns == docs.columns, name
        if name in ("toxicity", "mixing"):
            assert {r["doc_id"] for r in some.select("doc_id").collect()} == {0, 1, 2, 3, 4, 5, 6, None}, name


def test_recall_of_near_copies(spark):
    """Every pair of the table by brute force: links of 0.8 and more join, and nothing else does."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = sorted({r["text"] for r in docs.select("text").collect()})
    sets, ids = [simhash.shingle_hashes(t.encode(), 5) for t in texts], {r["text"]: bytes(r["i"]) for r in docs.select("text", simhash.identity(F.col("text")).alias("i")).collect()}
    known, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner, start = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.argsort(at, kind="stable")
    pairs = Counter()
    for group in np.split(owner[start], np.flatnonzero(np.diff(at[start])) + 1):
        if 1 < len(group):
            pairs.update((int(i), int(j)) for k, i in enumerate(group) for j in group[:k])
    close = [(i, j) for (i, j), n in pairs.items() if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n)]
    want = components_of(len(texts), close)
    for crowd in (32, 2):
        roots = {bytes(r["__text"]): bytes(r["root"]) for r in simhash.near_copies(docs, crowd=crowd).collect()}
        root = [roots[ids[t]] for t in texts]
        assert sum(root[i] == root[j] for i, j in close) >= 0.99 * len(close) > 0
        for r in set(root):
            assert len({want[k] for k in range(len(texts)) if root[k] == r}) == 1


def test_digests_of_the_registered_queries(spark):
    from tidemark.llm.queries import QUERIES

    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in QUERIES["op7_fm_index"](spark, DATA).where("n_removed = 0").collect():
        assert r["kept_sha256"] == hashlib.sha256(b" ".join(rows[r["doc_id"]].encode().split())).hexdigest()
    for r in QUERIES["op9_simhash"](spark, DATA).limit(20).collect():
        assert r["fingerprint"] == f"{brute_fingerprint(rows[r['doc_id']]):016x}"
