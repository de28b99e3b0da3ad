"""Op 11: token counts, by batch encoding in Arrow functions that return lengths only.

A batch of texts goes to the tokenizer in parts of about equal bytes, and a text longer than a part is split. Where
the tokenizer splits text before white space that follows something else whatever stands around it (byte-level
BPE with its own pattern and no normalizer), parts and texts are cut there: the pieces of a part are told apart by Arrow, and
only those that no earlier part had are encoded. Other tokenizers get whole texts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import release

PART_BYTES = 4_000_000  # of text that is encoded at once
CACHED_PIECES, KEPT_PIECES = 600_000, 300_000  # in a task, and from one task of a worker to its next
ENCODED_PIECES = 20_000  # a call of the tokenizer: its encodings hold far more than the lengths
# Between a character that is not white space and one that is: no pre-token, and no special token, spans it.
EDGE = r"([^\s\x0b\x1c-\x1f\x{85}\p{Z}])([ \t\n\r\f])"
# Likewise between a letter and a comma or stop.
LETTER_EDGE = r"([a-zA-Z])([,.])"
_EDGE = re.compile(r"(?<=\S)(?=[ \t\n\r\f])")
_counters: dict[str, "Counter"] = {}


def _splits_safely(path: str) -> bool:
    """Whether cutting a text at EDGE and LETTER_EDGE leaves its tokens as they are."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    plain = all(not (a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"]) and not re.search(r"\s|[a-zA-Z][,.]", a["content"]) for a in spec.get("added_tokens") or [])
    level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    return bool(level and plain and not spec.get("normalizer") and model.get("type") == "BPE" and not model.get("dropout"))


class Counter:
    """Token counts of texts by one tokenizer file: .json (tokenizers) or .model (sentencepiece)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.pieces, self.counts = pa.array([], pa.string()), np.zeros(0, dtype=np.int64)
        self.safe = False
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            self.safe = _splits_safely(path)
            self.encode = lambda texts: [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
        elif path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(e) for e in model.encode(texts, num_threads=1)]
        else:
            raise ValueError(f"no library for the tokenizer file {path}")

    def forget(self, keep: int) -> None:
        """Keep the pieces that came first, which are the frequent ones."""
        if len(self.pieces) > keep:
            # A copy, as a slice would hold on to the whole.
            self.pieces, self.counts = pa.concat_arrays([self.pieces.slice(0, keep), self.pieces.slice(0, 0)]), self.counts[:keep].copy()

    def _encoded(self, texts: pa.Array) -> np.ndarray:
        out = [np.array(self.encode(texts.slice(i, ENCODED_PIECES).to_pylist()), dtype=np.int64) for i in range(0, len(texts), ENCODED_PIECES)]
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)

    def _of_pieces(self, pieces: pa.Array) -> np.ndarray:
        """Counts of distinct pieces."""
        place = pc.index_in(pieces, value_set=self.pieces)
        if not place.null_count:
            return self.counts[place.to_numpy()]
        unseen = pieces.filter(pc.is_null(place))
        found = np.array(pc.fill_null(place, -1).to_numpy(zero_copy_only=False), dtype=np.int64)
        new = found < 0
        found[new] = len(self.pieces) + np.arange(len(unseen))
        self.pieces, self.counts = pa.concat_arrays([self.pieces, unseen]), np.append(self.counts, self._encoded(unseen))
        counts = self.counts[found]
        self.forget(CACHED_PIECES)
        return counts

    def of(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; no text is null."""
        if not self.safe:
            return self._encoded(texts)
        # The mark between pieces must be in no text; those that have it are encoded whole.
        marked = pc.match_substring(texts, "\x00")
        cut = pc.replace_substring_regex(pc.replace_substring_regex(texts, EDGE, "\\1\x00\\2"), LETTER_EDGE, "\\1\x00\\2")
        pieces = pc.split_pattern(pc.if_else(marked, "", cut), "\x00")
        coded = pieces.flatten().dictionary_encode()
        counts = self._of_pieces(coded.dictionary)[coded.indices.to_numpy()]
        ends = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(pc.list_value_length(pieces).to_numpy())])]
        out = np.diff(ends)
        if at := np.flatnonzero(marked.to_numpy(zero_copy_only=False)).tolist():
            out[at] = self._encoded(texts.take(pa.array(at)))
        return out


def slices(text: str, size: int) -> Iterator[str]:
    """A long text in slices of about `size` characters, cut at safe edges only; a run without any stays whole."""
    start = 0
    while len(text) - start > size:
        edge = _EDGE.search(text, start + size)
        if not edge:
            break
        yield text[start : edge.start()]
        start = edge.start()
    yield text[start:]


def lengths(texts: pa.Array, counter: Counter, part_bytes: int = PART_BYTES) -> np.ndarray:
    """Tokens of each text of a batch, in parts of about part_bytes; null texts count as empty."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    size = pc.binary_length(texts).to_numpy()
    out = np.zeros(len(texts), dtype=np.int64)
    long = size > part_bytes if counter.safe else np.zeros(len(texts), dtype=bool)
    for at in np.flatnonzero(long).tolist():
        out[at] = sum(int(counter.of(pa.array([s], pa.string()))[0]) for s in slices(texts[at].as_py(), part_bytes))
    short = np.flatnonzero(~long)
    part = np.cumsum(size[short]) // part_bytes
    for rows in np.split(short, np.flatnonzero(np.diff(part)) + 1):
        if len(rows):
            out[rows] = counter.of(texts.take(pa.array(rows)))
    return out


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every whole text, as the tokenizer's library counts.

    No begin, end or added special tokens, no truncation, no padding; special strings inside a text are what the library takes
    them for by default. A null or empty text has no bytes and no tokens. Repeated rows are counted each; an empty table
    gives an empty result. Columns called n_bytes, n_tokens and over_limit are replaced. The
    tokenizer's file must lie at the same path on every executor.
    """

    @F.arrow_udf("long")
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = _counters.get(tokenizer_path)
        if counter is None:
            counter = _counters[tokenizer_path] = Counter(tokenizer_path)
        for batch in batches:
            yield pa.array(lengths(batch, counter, part_bytes), pa.int64())
        counter.forget(KEPT_PIECES)
        release()

    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    counted = docs.withColumns({"n_tokens": tokens(value), "n_bytes": F.octet_length(value).cast("long")})
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
