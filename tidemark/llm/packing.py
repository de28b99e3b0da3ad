"""Op 6: pack documents into training sequences by the sum-of-squares rule.

Documents become token pieces; only a document longer than a sequence is cut. Pieces are dealt at random
into groups of bounded size, and each group is packed by itself, longest piece first: of the open
bins that can take it, the piece goes to the gap g that makes the sum over gaps of (open bins with that
gap) squared smallest; a bin is opened only if no open one can take it. A group leaves less than
one bin's worth unused beyond what its pieces force, so groups cost at most one sequence each.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, release

GROUP_PIECES = 20_000
CACHED_WORDS = 800_000  # in a task; from one task of a worker to its next, half of them
CHUNK_BYTES = 8_000_000  # of text that is split into words at once
_vocabularies: dict[tuple[str, int], "WordIds"] = {}


class WordIds:
    """Token ids of white-space separated words, for a tokenizer that drops white space, ignores case and
    splits letters from commas and stops. Words are looked up by Arrow; `cached` of them stay, besides those of a chunk."""

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.cached = Tokenizer.from_file(path), cached
        self.forget(0)

    def forget(self, keep: int) -> None:
        """Keep the words that came first, which are the frequent ones."""
        if keep >= len(getattr(self, "words", ())) > 0:
            return
        if not keep:
            self.words, self.sizes, self.ids = pa.array([], pa.string()), np.zeros(0, dtype=np.int64), np.zeros(0, dtype="<u4")
        else:
            # A copy, as a slice would hold on to the whole.
            self.words, self.sizes = pa.concat_arrays([self.words.slice(0, keep), self.words.slice(0, 0)]), self.sizes[:keep].copy()
            self.ids = self.ids[: self.sizes.sum()].copy()

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct words: where the ids of each start, how many they are, and the ids."""
        if len(self.words) > self.cached:
            self.forget(self.cached // 2)
        place = pc.index_in(words, value_set=self.words)
        if place.null_count:
            unseen = words.filter(pc.is_null(place))
            sizes, ids = self._tokenise(unseen.to_pylist())
            place = np.array(pc.fill_null(place, -1).to_numpy(zero_copy_only=False), dtype=np.int64)
            place[place < 0] = len(self.words) + np.arange(len(unseen))
            self.words, self.sizes, self.ids = pa.concat_arrays([self.words, unseen]), np.append(self.sizes, sizes), np.append(self.ids, ids)
        else:
            place = place.to_numpy()
        return (np.cumsum(self.sizes) - self.sizes)[place], self.sizes[place], self.ids

    def _tokenise(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all ids."""
        e = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        # A word that the tokenizer drops has no id.
        return np.bincount(np.array(e.word_ids, dtype=np.int64), minlength=len(words)), np.array(e.ids, dtype="<u4")


def _token_ids(texts: pa.Array, vocabulary: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and how many each has. Words are split and told apart by Arrow; Python sees only unseen ones."""
    # Special tokens are matched before case is dropped, so texts that might hold one stay as they are.
    texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
    # A final comma or stop after an ASCII letter is a token of its own: apart, there are fewer distinct words.
    words = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, r"([a-zA-Z])([,.])(\s|$)", r"\1 \2\3"))
    coded = words.flatten().dictionary_encode()
    starts, sizes, ids = vocabulary.of(coded.dictionary)
    which = coded.indices.to_numpy()
    n = sizes[which]
    before = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(starts[which] - before[:-1], n)
    at += np.arange(before[-1])
    return ids[at], np.diff(before[np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy())])])


def _pieces(doc_ids: pa.Array, texts: pa.Array, vocabulary: WordIds, max_tokens: int, end_id: int, with_ids: bool) -> list[pa.Array]:
    ids, n = _token_ids(texts, vocabulary)
    ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
    counts = -(-n // max_tokens)
    doc = np.repeat(np.arange(len(n)), counts)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = piece * max_tokens
    length = np.minimum(max_tokens, n[doc] - start)
    ends = 4 * np.cumsum(length)
    data = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
    sums = np.fromiter((crc32(data[e - k : e]) for e, k in zip(ends.tolist(), (4 * length).tolist())), dtype=np.int64, count=len(ends))
    out = [doc_ids.take(pa.array(doc)), pa.array(piece, type=pa.int32()), pa.array(start), pa.array(length), pa.array(sums)]
    if with_ids:
        edges = np.concatenate([[0], ends]).astype(np.int32)
        out.append(pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(edges), pa.py_buffer(data)]))
    return out


def tokenise(docs: DataFrame, tokenizer_path: str, max_tokens: int = 4096, end_id: int = 1, with_ids: bool = True, cached_words: int = CACHED_WORDS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (of ids) and, with_ids, ids (binary, little-endian unsigned 32 bits), one row a piece.

    A null or empty text is its end id alone. Rows that repeat give repeated pieces. The tokenizer's file
    must lie at the same path on every executor. A task remembers the ids of cached_words words and splits chunk_bytes of text at a
    time: less of both is less memory, and more work.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabularies.get((tokenizer_path, cached_words))
        if vocabulary is None:
            vocabulary = _vocabularies[tokenizer_path, cached_words] = WordIds(tokenizer_path, cached_words)
        names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
        for batch in batches:
            doc_ids, texts = batch.column("doc_id"), pc.fill_null(batch.column("text"), "")
            chunk = np.cumsum(pc.binary_length(texts).to_numpy()) // chunk_bytes
            for part in np.split(np.arange(len(chunk)), np.flatnonzero(np.diff(chunk)) + 1) if len(chunk) else []:
                first, k = int(part[0]), len(part)
                yield pa.RecordBatch.from_arrays(_pieces(doc_ids.slice(first, k), texts.slice(first, k), vocabulary, max_tokens, end_id, with_ids), names=names)
        vocabulary.forget(cached_words // 2)
        release()

    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, shape)


def numbered_reads(pieces: DataFrame) -> DataFrame:
    """pieces (without ids) with `read`, from 0: which of the rows of its doc_id and piece each is. A document that is read twice has reads 0 and 1."""
    again = Window.partitionBy("doc_id", "piece").orderBy("ids_crc32", "length")
    return pieces.withColumn("read", F.row_number().over(again) - 1)


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every size (1 to capacity), packed longest first."""
    if len(sizes) and (sizes.min() < 1 or sizes.max() > capacity):
        raise ValueError(f"sizes must lie between 1 and {capacity}")
    open_bins = np.zeros(capacity + 1, dtype=np.int64)
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
    used = 0
    for k in np.argsort(-sizes, kind="stable"):
        size = int(sizes[k])
        gaps = np.flatnonzero(open_bins[size:])  # what each fitting gap would leave
        if len(gaps):
            # Moving a bin from gap g to gap r changes the sum by 2 (N(r) - N(g) + 1), closing one by 1 - 2 N(g).
            change = 2 * (open_bins[gaps] - open_bins[gaps + size] + 1)
            if gaps[0] == 0:
                change[0] = 1 - 2 * open_bins[size]
            rest = int(gaps[np.argmin(change)])
            at = by_gap[rest + size].pop()
            open_bins[rest + size] -= 1
        else:
            rest, at = capacity - size, used
            used += 1
        bins[k], offsets[k] = at, capacity - rest - size
        if rest:
            by_gap[rest].append(at)
            open_bins[rest] += 1
    return bins, offsets


def pack(pieces: DataFrame, max_tokens: int = 4096, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """pieces (with a `length`) and the sequence_id and offset of each; keep other columns small.

    Lengths out of 1..max_tokens, and null ones, are an error. An empty table gives an empty result. Columns
    called sequence_id and offset are replaced; names that begin with __ are reserved.
    """
    pieces = materialise(pieces.drop("sequence_id", "offset"), "pieces")  # row numbers below stay as they are when a task runs again
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("__group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bins, offsets = sum_of_squares(pdf["length"].to_numpy(), max_tokens)
        return pdf.assign(sequence_id=(int(pdf["__group"].iloc[0]) << 32) + bins, offset=offsets).drop(columns="__group")

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.groupBy("__group").applyInPandas(run, f"{kinds}, sequence_id long, offset long")


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """sequence_id and its pieces in order, with their ids: what a trainer reads. pieces: of tokenise(), of documents with unique doc_ids.

    placed: of pack(), with several rows for a piece that is read several times.
    """
    both = pieces.select("doc_id", "piece", "ids").join(placed.select("doc_id", "piece", "sequence_id", "offset"), ["doc_id", "piece"])
    return both.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids"))).alias("pieces"))
