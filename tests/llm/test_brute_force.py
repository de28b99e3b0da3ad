"""Inner rules of operators against plain loops: log-count ratios and fitted weights, the gap that packing takes, heads of many blocks."""

import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import packing, topk, toxicity


def slots_of(text, orders, bits):
    """Slots of the character n-grams, one by one in whole numbers."""
    codes = [max(ord(c), 32) for c in " " + text.lower() + " "]
    out = set()
    for n in orders:
        for k in range(len(codes) - n + 1):
            h = 0
            for c in codes[k : k + n]:
                h = (h * 0x01000193 + c) % 2**32
            out.add(((h ^ (h >> 15)) * 0x9E3779B1 % 2**32) >> (32 - bits))
    return out


def test_toxicity_ratios_and_weights_equal_a_loop(spark):
    rng = random.Random(3)
    nice, nasty, both = ["apple", "tree", "river", "warm"], ["grunk", "zblat", "vex"], ["stone", "lamp", "chair", "cloud", "road"]
    docs, labels = [], []
    for i in range(90):
        toxic = i % 3 == 0
        docs.append((i, " ".join(rng.choice(both + (nasty if toxic and rng.random() < 0.9 else nice)) for _ in range(rng.randrange(3, 12)))))
        labels.append((i, int(toxic)))
    model = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    learned = {i: (t, y) for (i, t), (_, y) in zip(docs, labels) if zlib.crc32(str(i).encode()) % 5}
    orders, bits = (3, 4, 5), 20
    rows = [(slots_of(t, orders, bits), y) for t, y in learned.values()]
    count = {0: {}, 1: {}}
    for s, y in rows:
        for x in s:
            count[y][x] = count[y].get(x, 0) + 1
    total = {y: sum(count[y].values()) + (1 << bits) for y in (0, 1)}  # every slot is smoothed by one
    ratio = {x: math.log((count[1].get(x, 0) + 1) / total[1]) - math.log((count[0].get(x, 0) + 1) / total[0]) for x in count[0].keys() | count[1].keys()}
    ratio = {x: r for x, r in ratio.items() if count[0].get(x, 0) + count[1].get(x, 0) >= 3 and r != 0}
    used = np.flatnonzero(model.weights)
    assert set(used.tolist()) <= set(ratio)
    # The fit is where the penalised loss is level: no slot and no bias can lower it.
    weight = {x: float(model.weights[x]) / ratio[x] for x in ratio}
    p = [1 / (1 + math.exp(-(model.bias + sum(weight[x] * ratio[x] for x in s if x in ratio)))) for s, _ in rows]
    pull = {x: weight[x] for x in ratio}
    for (s, y), q in zip(rows, p):
        for x in s:
            if x in ratio:
                pull[x] += (q - y) * ratio[x]
    assert max(map(abs, pull.values())) < 0.02 and abs(sum(q - y for (_, y), q in zip(rows, p))) < 0.02
    score = model.scores([t for _, (t, _) in zip(rows, learned.values())])
    assert np.allclose(score, p, atol=1e-4)


def pack_plainly(sizes, capacity):
    """Every way to place a piece is tried, and the sum of squares of open bins per gap added up anew for each."""
    gaps, bins = [], [0] * len(sizes)  # the gap of each bin, and when it last changed
    changed = []
    for turn, k in enumerate(sorted(range(len(sizes)), key=lambda i: -sizes[i])):
        best = None
        for gap in sorted({g for g in gaps if g >= sizes[k]}):
            after = list(gaps)
            after[after.index(gap)] = gap - sizes[k]
            squares = sum(after.count(g) ** 2 for g in set(after) if g)
            if best is None or squares < best[0]:
                best = (squares, gap)
        if best is None:
            gaps.append(capacity - sizes[k])
            changed.append(turn)
            bins[k] = len(gaps) - 1
        else:
            at = max((b for b, g in enumerate(gaps) if g == best[1]), key=lambda b: changed[b])
            gaps[at] -= sizes[k]
            changed[at] = turn
            bins[k] = at
    return bins


def test_packing_takes_the_gap_of_the_smallest_sum_of_squares():
    rng = random.Random(5)
    for capacity, n in ((10, 60), (30, 120), (64, 150)):
        sizes = [rng.choice([rng.randrange(1, capacity + 1), rng.randrange(1, max(2, capacity // 3))]) for _ in range(n)]
        got, offsets = packing.sum_of_squares(np.array(sizes), capacity)
        assert got.tolist() == pack_plainly(sizes, capacity)
        for b in set(got.tolist()):
            spans = sorted((int(o), s) for o, s, x in zip(offsets, sizes, got) if x == b)
            assert [o for o, _ in spans] == [sum(s for _, s in spans[:i]) for i in range(len(spans))]


def test_topk_over_many_blocks_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 30)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(8)
    v = rng.integers(-50, 50, size=(400, 6))
    v[100:160] = v[100]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<long>")
    got = topk.search(df, F.col("id") % 10 == 0, k=5).collect()
    want = set()
    for q in range(0, 400, 10):
        s = v @ v[q]
        order = sorted((i for i in range(400) if i != q), key=lambda i: (-s[i], i))[:5]
        want |= {(q, r + 1, i, int(s[i])) for r, i in enumerate(order)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
