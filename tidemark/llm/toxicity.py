"""Op 4: toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

The model is fitted on a bounded sample of labelled rows: n-grams of a document count once, every slot's
value is the log ratio of its smoothed frequencies in the two classes, and a logistic regression weighs the
values. It is then a table of at most MAX_FEATURES slot weights, which scores whole texts of all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import release
from tidemark.llm.linear import Rows, encode, fit_logistic, hashed_ngrams, ngram_slots, sigmoid

SAMPLE_ROWS = 6000  # labelled documents that the model is fitted on, at most
MAX_FEATURES = 1 << 15
ORDERS = (3, 4, 5)
BITS = 20
LEAST_DOCUMENTS = 3  # a slot must occur in so many sample documents


@dataclass
class Model:
    weights: np.ndarray  # float32, one for each slot; zero where the slot is not used
    bias: float
    orders: tuple[int, ...]
    bits: int

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability that each text is toxic; an empty text gets that of no features."""
        out = np.full(len(texts), self.bias)
        for k, text in enumerate(texts):
            total = 0.0
            hits = []
            for slots in hashed_ngrams(encode(text), self.orders, self.bits):
                w = self.weights[slots]
                hits.append(slots[w != 0])
            if hits:
                found = np.unique(np.concatenate(hits))
                total = float(self.weights[found].sum(dtype=np.float64))
            out[k] += total
        return sigmoid(out)


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns labels from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, text, label): at most `rows` labelled documents that are not held out, by a hash of their ids.

    A doc_id with several labels counts as the higher one; one with several texts as the last in order.
    """
    ids = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ids = ids.groupBy("doc_id").agg(F.max(label).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # the sample's ids are at most `rows`
    return texts.groupBy("doc_id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"), F.max("label").alias("label"))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS, orders: tuple[int, ...] = ORDERS, bits: int = BITS, max_features: int = MAX_FEATURES, l2: float = 1.0) -> Model:
    """Fit on the sample; with one class only or no labels at all, the model knows the class share alone."""

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for pdf in batches:
            yield pd.DataFrame({"one": 0, "doc_id": pdf["doc_id"].astype(str), "label": pdf["label"], "slots": [ngram_slots(t, orders, bits).astype("<u4").tobytes() for t in pdf["text"]]})

    def fit(table: pa.Table) -> pa.Table:
        release()
        slot, weight = fit_weights(table, 1 << bits, max_features, l2)
        return pa.table({"slot": pa.array(slot, pa.int32()), "weight": pa.array(weight, pa.float64())})

    sample = labelled_sample(docs, labels, label, sample_rows).mapInPandas(features, "one int, doc_id string, label int, slots binary")
    found = sample.groupBy("one").applyInArrow(fit, "slot int, weight double").toPandas()  # at most max_features + 1 rows
    weights = np.zeros(1 << bits, dtype=np.float32)
    weights[found["slot"][found["slot"] >= 0]] = found["weight"][found["slot"] >= 0]
    bias = float(found["weight"][found["slot"] < 0].sum()) if len(found) else 0.0
    return Model(weights, bias, orders, bits)


def fit_weights(table: pa.Table, width: int, max_features: int, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """Slots and their weights from (doc_id, label, slots); slot -1 is the bias.

    The slots of a document are read where Arrow holds them; only those of kept slots are copied, renumbered.
    """
    order = np.argsort(np.array(table["doc_id"].to_pylist(), dtype=object), kind="stable").tolist()
    y = table["label"].to_numpy().astype(np.float64)[order]
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    if y.min() == y.max():
        return np.array([-1]), np.array([np.log(share / (1 - share))])
    slots = [np.frombuffer(x.as_buffer(), dtype="<u4") for x in table["slots"]]
    there = np.zeros((2, width), dtype=np.int32)
    for k, label in zip(order, y.astype(int).tolist()):
        there[label, slots[k]] += 1  # each slot once a document
    smooth = there + 1.0
    ratio = np.log(smooth[1] / smooth[1].sum()) - np.log(smooth[0] / smooth[0].sum())
    seen = there.sum(axis=0)
    ratio[seen < LEAST_DOCUMENTS] = 0
    del smooth, there
    if (ratio != 0).sum() > max_features:
        strength = np.abs(ratio) * np.sqrt(seen)
        ratio[np.argpartition(strength, -max_features)[:-max_features]] = 0
    used = np.flatnonzero(ratio)
    number = np.full(width, -1, dtype=np.int32)
    number[used] = np.arange(len(used))
    kept = []
    for k in order:
        n = number[slots[k]]
        kept.append(n[n >= 0])
    sizes, flat = np.array([len(n) for n in kept]), np.concatenate(kept)
    del kept, slots
    ratio = ratio[used]
    w, bias = fit_logistic(Rows.of(flat, sizes, len(used), ratio.astype(np.float32)[flat]), y, l2=l2)
    return np.append(used, -1), np.append(w * ratio, bias)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with the probability that the text is toxic; null and empty texts have one too. A column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        release()
        for texts in batches:
            yield pd.Series(shared.value.scores([t or "" for t in texts]))

    return docs.withColumn(name, scores(F.col("text")))


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; null and empty texts are scored like any, repeated rows each.

    An empty table gives an empty result; without labels all scores are one half. Only doc_id and text are read, so other columns may be
    called anything.
    """
    scored = score(docs.select("doc_id", "text"), train(docs, labels, label, **options))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
