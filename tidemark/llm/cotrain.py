"""Op 8: quality by co-training a text view and a metadata view.

The text view sees character n-grams of the whole text and how often a word follows itself. The metadata
view sees the page: its language, source, length, compressed size and layout (lines, line lengths, shares of
upper case, symbols and spaces); it knows no n-gram and no word. Both start from the labelled sample; in every
round each scores all unlabelled documents and gives its most confident pseudo-labels to the other. Both are
then calibrated on labelled documents kept aside for that, and the mean of the calibrated log-odds scores all
documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise
from tidemark.llm.linear import Rows, encode, fit_logistic, hashed_ngrams, sigmoid
from tidemark.llm.toxicity import held_out, labelled_sample

LABELLED_ROWS = 3000  # labelled documents that are used, at most; a quarter of them calibrates
ROUNDS = 3
PER_ROUND = 300  # pseudo-labels that a view gives away in a round, at most
ORDERS = (1, 2, 3)
BITS = 16
REPEAT_SLOTS = 16  # after those of n-grams: one for each sixteenth of words that repeat the word before
WIDTH = (1 << BITS) + REPEAT_SLOTS
NAMES_SLOTS = 256  # languages and sources are hashed into so many slots


def metadata(text: str, lang: str | None, source: str | None) -> np.ndarray:
    """Dense layout measures, then two slot numbers for language and source."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    n = max(1, len(codes))
    lines = text.count("\n") + 1
    ascii_codes = codes[codes < 128]
    upper = ((ascii_codes >= 65) & (ascii_codes <= 90)).sum() / n
    letters = (((ascii_codes | 32) >= 97) & ((ascii_codes | 32) <= 122)).sum() + (codes >= 128).sum()
    digits = ((ascii_codes >= 48) & (ascii_codes <= 57)).sum() / n
    spaces = (ascii_codes <= 32).sum() / n
    symbols = max(0.0, 1 - letters / n - digits - spaces)
    per_line = n / lines
    raw = text.encode("utf-8", "surrogatepass")
    packed = len(zlib.compress(raw, 1)) / max(1, len(raw))
    names = [_slot(lang, 1), _slot(source, 2)]
    return np.array([np.log1p(len(codes)) / 8, np.log1p(lines) / 4, np.log1p(per_line) / 6, 4 * upper, 4 * digits, 4 * spaces, 8 * symbols, float(upper > 0.2), float(symbols > 0.06), float(symbols > 0.1), 2 * packed, float(packed < 0.2), *names])


DENSE = 12


def _slot(name: str | None, seed: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest((name or "").encode(), seed) % NAMES_SLOTS


def text_slots(text: str) -> np.ndarray:
    """The slots, each once, of the text view."""
    words = text.split()
    share = sum(map(eq, words, words[1:])) / max(1, len(words))
    repeats = (1 << BITS) + min(REPEAT_SLOTS - 1, int(share * REPEAT_SLOTS + 0.75))
    found = np.concatenate([*hashed_ngrams(encode(text), ORDERS, BITS), np.zeros(0, dtype=np.uint32)])
    seen = np.zeros(1 << BITS, dtype=bool)
    seen[found] = True
    return np.append(np.flatnonzero(seen), repeats)


def _metadata_rows(measures: np.ndarray) -> Rows:
    dense = np.arange(DENSE)
    slots = [np.concatenate([dense, DENSE + m[DENSE:].astype(np.int64)]) for m in measures]
    return Rows(slots, DENSE + NAMES_SLOTS, [np.append(m[:DENSE], [0.3, 0.3]) for m in measures])


@dataclass
class Model:
    text: np.ndarray
    text_line: tuple[float, float]  # calibration: log-odds = slope * margin + offset
    page: np.ndarray
    page_line: tuple[float, float]
    text_bias: float
    page_bias: float

    def measures(self, texts: list[str], langs: list, sources: list) -> pd.DataFrame:
        """Margins of the text view and the page view, before calibration, and the score."""
        first = np.empty(len(texts))
        for k, text in enumerate(texts):
            slots = text_slots(text)
            first[k] = self.text[slots].sum() / np.sqrt(len(slots)) + self.text_bias
        second = _metadata_rows(np.array([metadata(*x) for x in zip(texts, langs, sources)])).times(self.page) + self.page_bias if texts else first
        a, b = self.text_line, self.page_line
        return pd.DataFrame({"text": first, "page": second, "score": sigmoid((a[0] * first + a[1] + b[0] * second + b[1]) / 2)})


def _calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the log-odds, with smoothed targets; the margins as they are if one class is missing."""
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    good, bad = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    rows = Rows([np.zeros(1, dtype=np.int64)] * len(y), 1, [np.array([m]) for m in margin])
    w, b = fit_logistic(rows, target, l2=1e-3)
    return (float(w[0]), b) if w[0] > 0 else (1.0, 0.0)


def fit_views(y: np.ndarray, view: np.ndarray, text_rows: list[np.ndarray], pages: np.ndarray) -> Model:
    """Both views and their calibration. y: labels; view: -1 for a given label, or the view (0 text, 1 page) that learns the row's pseudo-label."""
    given = np.flatnonzero(view < 0)
    aside, known = given[::4], np.setdiff1d(given, given[::4])
    if not len(known) or y[known].min() == y[known].max():
        share = float(np.clip(y[known].mean(), 1e-3, 1 - 1e-3)) if len(known) else 0.5
        odds = float(np.log(share / (1 - share)))
        return Model(np.zeros(WIDTH), (1.0, 0.0), np.zeros(DENSE + NAMES_SLOTS), (1.0, 0.0), odds, odds)

    def text_of(at):
        return Rows([text_rows[i] for i in at], WIDTH, [np.full(len(text_rows[i]), 1 / np.sqrt(max(1, len(text_rows[i]))), dtype=np.float32) for i in at])

    def pages_of(at):
        return _metadata_rows(pages[at])

    fits, lines = [], []
    for v, rows_of in enumerate((text_of, pages_of)):
        at = np.concatenate([known, np.flatnonzero(view == v)])
        w, b = fit_logistic(rows_of(at), y[at], np.where(view[at] < 0, 1.0, 0.5), l2=0.1)
        fits.append((w, b))
        lines.append(_calibrate(rows_of(aside).times(w) + b, y[aside]))
    return Model(fits[0][0], lines[0], fits[1][0], lines[1], fits[0][1], fits[1][1])


FEATURES = "one int, doc_id string, label double, view int, slots binary, page binary"


def _features(rows: DataFrame) -> DataFrame:
    """What fit_views reads, of (doc_id, text, lang, source, label, view)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            pages = [metadata(t, a, b).tobytes() for t, a, b in zip(texts, pdf["lang"], pdf["source"])]
            yield pd.DataFrame({"one": 0, "doc_id": pdf["doc_id"].astype(str), "label": pdf["label"].astype("float64"), "view": pdf["view"], "slots": [text_slots(t).astype("<u4").tobytes() for t in texts], "page": pages})

    return rows.select("doc_id", "text", "lang", "source", "label", "view").mapInPandas(run, FEATURES)


def _fit(sample: DataFrame) -> Model:
    """Both views from all rows of _features, in one task: they are bounded."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "view"])
        rows = [np.frombuffer(s, dtype="<u4") for s in pdf["slots"]]
        m = fit_views(pdf["label"].to_numpy(), pdf["view"].to_numpy(), rows, np.array([np.frombuffer(p) for p in pdf["page"]]))
        numbers = [*m.text_line, *m.page_line, m.text_bias, m.page_bias]
        return pd.DataFrame({"part": ["text", "page", "numbers"], "data": [np.asarray(x, dtype=np.float64).tobytes() for x in (m.text, m.page, numbers)]})

    parts = {r["part"]: np.frombuffer(r["data"]) for r in sample.groupBy("one").applyInPandas(fit, "part string, data binary").collect()}
    if not parts:
        return Model(np.zeros(WIDTH), (1.0, 0.0), np.zeros(DENSE + NAMES_SLOTS), (1.0, 0.0), 0.0, 0.0)
    n = parts["numbers"].tolist()
    return Model(parts["text"], (n[0], n[1]), parts["page"], (n[2], n[3]), n[4], n[5])


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text, lang, source) with the columns of ids, one row a row of ids; ids are few. Of repeated ids the last in order stands."""
    rows = docs.select("doc_id", "text", "lang", "source").join(F.broadcast(ids.select("doc_id").distinct()), "doc_id")
    return rows.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in ("text", "lang", "source")]).join(ids, "doc_id")


def most_confident(margins: DataFrame, share: float, per_round: int) -> DataFrame:
    """(doc_id, label, view): the pseudo-labels that each view gives the other, of all documents in (doc_id, text, page)."""
    found = None
    for v, column in enumerate(("text", "page")):
        for label, count, sure, order in ((0.0, round(per_round * (1 - share)), F.col(column) < -1, F.col(column)), (1.0, round(per_round * share), F.col(column) > 1, F.col(column).desc())):
            top = margins.where(sure).orderBy(order, F.xxhash64("doc_id"), "doc_id").limit(count)
            top = top.select("doc_id", F.lit(label).alias("label"), F.lit(1 - v).alias("view"))
            found = top if found is None else found.union(top)
    return found.groupBy("doc_id", "view").agg(F.max("label").alias("label")).select("doc_id", "label", "view")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", labelled_rows: int = LABELLED_ROWS, rounds: int = ROUNDS, per_round: int = PER_ROUND) -> Model:
    """Co-train on at most labelled_rows labelled documents and all unlabelled ones. Rows held out (see toxicity.held_out) are never read.

    In each round both views score every unlabelled document, and the per_round most confident ones of each
    (less, if it is sure of fewer) become labels of the other view; only these are added to the rows of the fit.
    """
    known = labelled_sample(docs, labels, label, labelled_rows).select("doc_id", F.col("label").cast("double").alias("label"), F.lit(-1).alias("view"))
    sample = materialise(_features(_texts_of(docs, materialise(known, "labelled"))), "features")
    share = sample.agg(F.avg("label")).first()[0]
    if share is None or share in (0.0, 1.0):
        return _fit(sample)
    # Labelled documents are scored along: taking them out first would shuffle all texts, afterwards it's ids and numbers alone.
    open_ = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    given = labels.where(F.col(label).isNotNull()).select("doc_id").distinct()
    taught = docs.sparkSession.createDataFrame([], "doc_id string")
    for _ in range(rounds):
        margins = open_.select("doc_id", _measures(docs, _fit(sample)).alias("m"))
        margins = materialise(margins.select("doc_id", "m.text", "m.page"), "margins")
        left = margins.join(given, "doc_id", "left_anti")
        left = left.join(taught, left["doc_id"].cast("string") == taught["doc_id"], "left_anti")
        news = materialise(most_confident(left, share, per_round), "pseudo-labels")
        sample = materialise(sample.union(_features(_texts_of(docs, news))), "features")
        taught = sample.where("view >= 0").select("doc_id").distinct()
    return _fit(sample)


def _measures(docs: DataFrame, model: Model) -> Column:
    """A struct of the margins of both views, text and page, and the score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("text double, page double, score double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, langs, sources in batches:
            yield shared.value.measures([t or "" for t in texts], list(langs), list(sources))

    return run(F.col("text"), F.col("lang"), F.col("source"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """doc_id, held_out, score (of being good), keep for every row; null texts, languages and sources count as empty.

    An empty table gives an empty result. Only doc_id, text, lang and source are read, so other columns may be called anything.
    """
    columns = docs.select("doc_id", "text", "lang", "source")
    scored = columns.select("doc_id", _measures(columns, train(docs, labels, **options))["score"].alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).alias("keep"))
