"""Token counts against the library, whitening and the Merkle manifest against brute force, and their edge cases."""

import hashlib
import math
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import manifest, queries, tokens, whitening

DATA = "/root/testdata/sf0.001"
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
BITS = ["a", "Word", "é", "中", "'s", "'", "3", "42", ",", ".", "!", "<|endoftext|>", "<|", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", " ", "　", " ", "\x00", "́", "😀", "...", "a,", "b.", "don't", "​", "﻿"]


def strings(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randrange(0, 30))) for _ in range(n)]


# 11


def library_counts(path, texts):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return [len(model.encode(t)) for t in texts]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
@pytest.mark.parametrize("part_bytes", [25, 4_000_000])
def test_counts_equal_the_library(name, part_bytes):
    path, texts = public_tokenizers.path(name), strings(4000)
    counter = tokens.Counter(path)
    assert counter.safe == (name == "byte_bpe_50k.json")
    assert tokens.lengths(pa.array(texts), counter, part_bytes).tolist() == library_counts(path, texts)


def test_pieces_are_forgotten():
    counter = tokens.Counter(BYTE_BPE)
    texts = strings(300)
    for _ in range(3):
        assert tokens.lengths(pa.array(texts), counter).tolist() == library_counts(BYTE_BPE, texts)
        counter.forget(5)
        assert len(counter.pieces) == len(counter.counts) == 5


def test_long_texts_are_cut_at_safe_edges():
    text = "lorem ipsum, dolor " * 4000 + "x" * 50_000 + " end"
    parts = list(tokens.slices(text, 1000))
    assert "".join(parts) == text and len(parts) > 70 and max(map(len, parts)) < 52_000
    assert tokens.lengths(pa.array([text, None, text]), tokens.Counter(BYTE_BPE), 1000).tolist() == [*library_counts(BYTE_BPE, [text]), 0, *library_counts(BYTE_BPE, [text])]


def test_token_counts_of_tables(spark):
    texts = [None, "", " \n", "one", "one two", "Zoë ünï 中文　y", "word " * 60_000] * 2
    df = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string").withColumns({"n_bytes": F.lit("mine"), "over_limit": F.lit(None), "_key": F.lit(1)})
    got = tokens.count_tokens(df, BYTE_BPE, limit=2).collect()
    want = library_counts(BYTE_BPE, [t or "" for t in texts])
    assert [(r["doc_id"], r["n_tokens"], r["n_bytes"], r["over_limit"], r["_key"]) for r in sorted(got)] == [(i, n, len((t or "").encode()), n > 2, 1) for i, (t, n) in enumerate(zip(texts, want))]
    assert tokens.count_tokens(df.limit(0), BYTE_BPE).count() == 0
    with pytest.raises(ValueError):
        tokens.Counter("vocabulary.bin")


def test_op11_counts_every_document(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: n for r, n in zip(docs, library_counts(BYTE_BPE, [r["text"] or "" for r in docs]))}
    got = queries.op11_token_counts(spark, DATA)
    assert got.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    assert {r["doc_id"]: r["n_tokens"] for r in got.collect()} == want


# 12


def brute_whitening(rows, components, scale=64, offset=1_000_000):
    x = [[math.floor(scale * c) + offset for c in v] for v in rows]
    n, dim = len(x), len(x[0])
    sums = [sum(r[k] for r in x) for k in range(dim)]
    deviation = [sum((n * r[k] - sums[k]) ** 2 for k in range(dim)) for r in x]
    v = np.array([[float(Fraction(sum((n * r[a] - sums[a]) * (n * r[b] - sums[b]) for r in x), n**3)) for b in range(dim)] for a in range(dim)])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    centred = np.array([[float(Fraction(n * r[k] - sums[k], n)) for k in range(dim)] for r in x])
    return n, deviation, centred @ vectors / np.sqrt(values), values / np.trace(v), v


@pytest.mark.parametrize("spread, dim", [(1.0, 5), (1000.0, 3), (1e7, 2)])
def test_whitening_equals_brute_force(spark, spread, dim):
    rng = np.random.default_rng(3)
    rows = (rng.normal(size=(150, dim)) * spread * np.arange(1, dim + 1) + 7).tolist()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id long, embedding array<double>").repartition(4)
    n, deviation, white, explained, _ = brute_whitening(rows, 32)
    got = whitening.whiten(df).collect()
    assert len(got) == 150 * dim
    by = {(r["vec_id"], r["component"]): r for r in got}
    for c in range(dim):
        mine = np.array([by[i, c + 1]["whitened"] for i in range(150)])
        sign = np.sign(mine @ white[:, c])
        assert np.allclose(mine, sign * white[:, c], rtol=1e-9, atol=1e-9)
        assert abs(by[0, c + 1]["explained"] / explained[c] - 1) < 1e-12
    assert all(r["n"] == n and r["deviation"] == deviation[r["vec_id"]] and r["identity_error"] < 1e-9 for r in got)


def test_cross_products_of_bit_planes():
    rng = np.random.default_rng(5)
    for rows, high in ((1, 1), (63, 2), (200, 300), (129, 2**33), (70, 1)):
        y = rng.integers(0, high, size=(rows, 4))
        total = sum((m.astype(object) * w for w, m in whitening.cross_products(y)), np.zeros((4, 4), dtype=object))
        assert (total == np.triu(y.astype(object).T @ y.astype(object))).all()
    scatter, all_rows = whitening.Scatter(3), []
    for k in range(6):
        x = rng.integers(-(2 ** (5 + 6 * k)), 2 ** (5 + 6 * k), size=(40 + k, 3))
        scatter.add(x)
        all_rows.append(x.astype(object))
    whole = np.concatenate(all_rows)
    i, j, value, low, high = scatter.rows()
    assert value[0] == len(whole) and value[1:4] == list(whole.sum(axis=0)) and (low[1], high[1]) == (whole[:, 0].min(), whole[:, 0].max())
    assert value[4:] == [whole[:, a] @ whole[:, b] for a, b in zip(i[4:], j[4:])]


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [3.0, -2.0]), (2, [3.0, -2.0]), (None, [0.5, 0.25]), (4, None), (5, [nan, 1.0]), (6, [inf, 0.0]), (7, [None, 1.0]), (8, [1.0]), (9, []), (10, [1e300, 0.0])]
    df = spark.createDataFrame([(i, v, "mine", "mine") for i, v in rows], "vec_id long, embedding array<double>, n string, component string")
    got = whitening.whiten(df).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 1), (2, 1), (2, 2), (2, 2)]
    assert all(r["n"] == 4 for r in got) and got[0]["identity_error"] < 1e-9
    assert whitening.whiten(df.limit(0)).collect() == [] and whitening.whiten(df.where("vec_id between 4 and 7")).collect() == []
    alike = whitening.whiten(df.where("vec_id = 2")).collect()
    assert [(r["deviation"], r["whitened"], r["identity_error"]) for r in alike] == [(0, None, 0.0)] * 4
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(9)], "vec_id long, embedding array<double>")).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in line) and abs(line[0]["explained"] - 1) < 1e-12
    # Deviations beyond 64 bits are decimals, and exact.
    far = [[2.0**33, 0.0], [-(2.0**33), 1.0], [5.0, 2.0], [0.0, 0.0]] * 10
    wide = whitening.whiten(spark.createDataFrame(list(enumerate(far)), "vec_id long, embedding array<double>"))
    assert dict(wide.dtypes)["deviation"] == "decimal(38,0)"
    want = brute_whitening(far, 2)[1]
    assert all(int(r["deviation"]) == want[r["vec_id"]] for r in wide.collect())


def test_op12_whitens_every_vector(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()
    kept = {r["vec_id"]: r["embedding"] for r in rows if r["embedding"] is not None and all(c is not None and math.isfinite(c) for c in r["embedding"])}
    n, deviation, _, explained, v = brute_whitening(list(kept.values()), 32)
    deviation = dict(zip(kept, deviation))
    got = queries.op12_whitening(spark, DATA)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and dict(got.dtypes)["deviation"] == "bigint"
    rows = got.collect()
    assert len(rows) == 32 * n and all(r["deviation"] == deviation[r["vec_id"]] and abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-10 for r in rows)
    w = np.zeros((n, 32))
    for r in rows:
        w[list(kept).index(r["vec_id"]), r["component"] - 1] = r["whitened"]
    assert np.abs(np.cov(w.T, bias=True) - np.eye(32)).max() < 1e-9 and rows[0]["identity_error"] < 1e-9


# 13


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(digests):
    """The last node, and for each leaf the (left, right) of every level."""
    steps, own = [[] for _ in digests], [[i] for i in range(len(digests))]
    while len(digests) > 1:
        above, members = [], []
        for k in range(0, len(digests), 16):
            run = digests[k : k + 16]
            for j in range(len(run)):
                for i in own[k + j]:
                    steps[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            above.append(sha(*run))
            members.append(sum(own[k : k + 16], []))
        digests, own = above, members
    return digests[0], steps


def brute_manifest(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha(*[enc(x) for x in (r[0], r[3], r[2], r[4], text)])
    low = lambda t: t and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: x[:3])
        trees[g] = brute_tree([x[2] for x in groups[g]])
    root, upper = brute_tree([trees[g][0] for g in names])
    out = []
    for g, above in zip(names, upper):
        for (_, _, own, r), steps in zip(groups[g], trees[g][1]):
            at = leaf(r, low(r[1])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else own
            for a, b in steps + above:
                at = sha(a, at, b)
            out.append((r[0], own, trees[g][0], root, sha(*[a + b for a, b in steps + above]), at, at == root))
    return out


def tampered():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


@pytest.mark.parametrize("sources, rows", [(1, 1), (1, 16), (1, 17), (3, 60), (40, 900), (2, 300), (700, 900)])
def test_manifest_equals_brute_force(spark, sources, rows):
    rng = random.Random(rows)
    hot = lambda: f"s{rng.randrange(sources)}" if rng.random() < 0.5 else "s0"
    data = [(rng.choice([None, i, i, i, 5]), rng.choice([None, "", "Äbc XYZ", f"Text {i}", "Same"]), rng.choice([None, "en"]), rng.choice([None, hot(), hot(), ""]) if sources > 1 else "s", rng.choice([None, i])) for i in range(rows)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    df = df.withColumns({c: F.lit("mine") for c in ("leaf", "root", "nodes", "kids", "steps", "__rank", "rank", "subroot")})
    got = manifest.manifest(df, tampered=tampered()).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_manifest(data)))


def test_manifest_of_three_rounds(spark):
    df = spark.range(70_000).select(F.col("id").alias("doc_id"), F.lit("T").alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") > 5, "s").alias("source"), F.lit(1).alias("n_chars"))
    got = manifest.manifest(df, tampered=tampered()).collect()
    enc = lambda i, s: sha(f"{len(str(i))}:{i}", s, "2:en", "1:1", "1:T")
    level = [enc(i, "1:s") for i in range(6, 70_000)]
    while len(level) > 1:
        level = [sha(*level[k : k + 16]) for k in range(0, len(level), 16)]
    root = sha(sha(*[enc(i, "-") for i in range(6)]), level[0])
    assert {r["root"] for r in got} == {root} and len({r["doc_id"] for r in got}) == len(got) == 70_000
    assert all(r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 != 0) for r in got)


def test_manifest_odd(spark):
    text = "Long Text " * 100_000
    data = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (None, None, None, None, None), (None, None, None, None, None), (13, text, "x", "a", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(map(repr, map(tuple, manifest.manifest(df, tampered=tampered()).collect()))) == sorted(map(repr, brute_manifest(data)))
    assert manifest.manifest(df.limit(0)).collect() == []
    assert all(r["verified"] for r in manifest.manifest(df).collect())


def test_op13_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    df = queries.op13_merkle_manifest(spark, DATA)
    found = con.sql(queries.ORACLE_SQL["op13_merkle_manifest"])
    assert found.columns == df.columns
    assert sorted(map(repr, found.fetchall())) == sorted(map(repr, map(tuple, df.collect())))
