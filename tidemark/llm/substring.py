"""Op 7: remove passages that an earlier document has, by FM-indexes over shards.

A document is cut into windows of `window` words. The anchor of a window is the smallest hash among its word
grams, so equal windows have equal anchors wherever they stand, and a run of windows with one anchor forms a
fragment. Anchors deal fragments to shards; a shard sees all copies of every window it gets. It indexes its
fragments in an FM-index and streams them through it: where the matching statistic reaches the window, the
suffixes found tell the smallest doc_id that has the window.

The work is in proportion to the text. Documents are dealt into batches once. Each batch first asks the
shards which of its anchors stand in more than one fragment of the corpus; only such fragments are sent.
Copies of a fragment collapse in their batch, so a passage of a third of all documents reaches its shard once
a batch. Anchors that stand in very many different contexts (a common line has others around it each time)
are flagged too; their windows are dealt one by one by their own hash, and collapse as well.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import release
from tidemark.llm.fm_index import FmIndex, match_windows

GRAM = 5  # words of the grams that anchors are chosen from
BATCH_BYTES = 2_500_000  # of document text for each batch
FRAGMENT_WINDOWS = 64  # longer runs are cut
SHARD_BYTES = 2_000_000  # of document text for each shard
CROWDED = 5_000  # an anchor in so many fragments is dealt window by window
NO_ID = np.iinfo(np.int64).max  # what a null doc_id counts as: larger than any other


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _odd(k: int) -> np.uint64:
    return np.uint64((0xD6E8FEB86659FD93 * (2 * k + 1)) % (1 << 64) | 1)


class Batch:
    """The words of some documents and the fragments they form."""

    def __init__(self, doc_ids: np.ndarray, texts: list[bytes], window: int, crowded: np.ndarray):
        vocabulary: dict[bytes, int] = defaultdict()
        vocabulary.default_factory = vocabulary.__len__
        ids, pieces = [], []
        for t in texts:
            words = t.split()
            ids.append(np.fromiter(map(vocabulary.__getitem__, words), dtype=np.int32, count=len(words)))
            pieces.append(b" ".join(words))
        vocabulary.default_factory = None  # else it refers to itself, and stays until the garbage collector comes by
        self.doc_ids, self.window = doc_ids, window
        self.n_words = np.array([len(i) for i in ids], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.n_words)])
        self.joined = b" ".join(p for p in pieces if p)
        ids = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)
        known = list(vocabulary)
        self.hashes = np.fromiter(map(xxhash.xxh64_intdigest, known), dtype=np.uint64, count=len(known))[ids]
        self.byte_at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, known), dtype=np.int64, count=len(known))[ids] + 1)])
        self.form(crowded)

    def form(self, crowded: np.ndarray) -> None:
        """The fragments, with every window of a crowded anchor by itself; the words stay as they were read."""
        hashes, window, gram = self.hashes, self.window, min(GRAM, self.window)
        n = len(hashes) - window + 1
        starts = np.concatenate([np.arange(f, f + k - window + 1) for f, k in zip(self.first, self.n_words) if k >= window] or [np.zeros(0, dtype=np.int64)])
        if n < 1 or not len(starts):
            self.run_at = self.run_windows = self.distinct = self.run_fragment = np.zeros(0, dtype=np.int64)
            self.anchor, self.source_anchor, self.least_id = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
            return
        grams = _mix(sum((hashes[j : len(hashes) - gram + 1 + j] * _odd(j) for j in range(gram)), np.uint64(0)))
        least, width, want = grams, 1, window - gram + 1
        while width < want:  # minimum over `want` neighbours, by doubling
            step = min(width, want - width)
            least, width = np.minimum(least[: len(least) - step], least[step:]), width + step
        anchor = least[starts]
        # A polynomial hash of any stretch of words, from sums over prefixes.
        base = 0xA0761D6478BD642F
        powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(hashes), np.uint64(base))]))
        inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(hashes), np.uint64(pow(base, -1, 1 << 64)))]))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * powers[:-1], dtype=np.uint64)])
        del powers, grams, least

        alone = np.isin(anchor, crowded) if len(crowded) else np.zeros(len(anchor), dtype=bool)
        new = np.ones(len(starts), dtype=bool)
        new[1:] = (np.diff(starts) != 1) | (anchor[1:] != anchor[:-1]) | alone[1:]
        run = np.cumsum(new) - 1
        within = np.arange(len(starts)) - np.flatnonzero(new)[run]
        new |= within % FRAGMENT_WINDOWS == 0
        first = np.flatnonzero(new)
        self.run_at, self.run_windows = starts[first], np.diff(np.append(first, len(starts)))
        last = self.run_at + self.run_windows + window - 1
        content = (sums[last] - sums[self.run_at]) * inverse[self.run_at]
        self.source_anchor = anchor[first]
        self.anchor = np.where(alone[first], _mix(content), anchor[first])
        key = _mix(content ^ _mix(anchor[first] + self.run_windows.astype(np.uint64)))
        owner = self.doc_ids[np.searchsorted(self.first, self.run_at, side="right") - 1]
        order = np.lexsort((owner, key))
        head = np.ones(len(order), dtype=bool)
        head[1:] = key[order][1:] != key[order][:-1]
        self.run_fragment = np.empty(len(order), dtype=np.int64)
        self.run_fragment[order] = np.cumsum(head) - 1
        self.distinct = order[head]  # a run of each fragment, of its smallest doc_id
        self.least_id = owner[self.distinct]

    def words_of(self, fragment: int) -> bytes:
        run = self.distinct[fragment]
        last = self.run_at[run] + self.run_windows[run] + self.window - 1
        return self.joined[self.byte_at[self.run_at[run]] : self.byte_at[last] - 1]


def _pack(*arrays: np.ndarray, text: bytes = b"") -> bytes:
    sizes = np.array([len(arrays), *(len(a) for a in arrays)], dtype=np.int64)
    return zstandard.compress(sizes.tobytes() + b"".join(np.ascontiguousarray(a, dtype=np.int64).tobytes() for a in arrays) + text, 3)


def _unpack(blob: bytes) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.decompress(blob)
    count = int(np.frombuffer(raw, dtype=np.int64, count=1)[0])
    at, arrays = 8 * (count + 1), []
    for size in np.frombuffer(raw, dtype=np.int64, count=count, offset=8).tolist():
        arrays.append(np.frombuffer(raw, dtype=np.int64, count=size, offset=at))
        at += 8 * size
    return arrays, raw[at:]


def _batch_of(table: pa.Table, window: int, crowded: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, Batch]:
    """Number, order of the rows, hashes of the texts, and the batch: rows by id and text, in whatever order they came."""
    release()
    ids, keys = table["__id"].to_numpy(), table["__key"].to_numpy()
    order = np.lexsort((keys, ids))
    texts = table["text"].to_pylist()
    batch = Batch(ids[order], [(texts[i] or "").encode("utf-8", "surrogatepass") for i in order.tolist()], window, crowded)
    return table["__batch"][0].as_py(), order, keys[order], batch


def _shares(b: Batch, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, fragments of the batch that go to it)."""
    shard = (b.anchor[b.distinct] % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else []:
        yield int(shard[part[0]]), part


def _short(anchors: np.ndarray) -> np.ndarray:
    """32 bits of each anchor: enough to ask by, as a false match only sends a fragment more."""
    return (anchors >> np.uint64(32)).astype(np.int64)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(schema)], schema=schema)


ASKED = pa.schema([("__batch", pa.int64()), ("shard", pa.int64()), ("blob", pa.binary())])
REPLY = pa.schema([("__batch", pa.int64()), ("blob", pa.binary())])
MATCHED = pa.schema([("__batch", pa.int64()), ("place", pa.bool_()), ("blob", pa.binary())])
NONE = np.zeros(0, dtype=np.uint64)


def _ask(window: int, shards: int):
    """For a batch: its anchors, shortened, and in how many of its fragments each is, for every shard."""

    def run(table: pa.Table) -> pa.Table:
        number, _, _, b = _batch_of(table, window, NONE)
        out = []
        for shard, part in _shares(b, shards):
            anchors, n = np.unique(_short(b.anchor[b.distinct[part]]), return_counts=True)
            out.append((number, shard, _pack(np.diff(anchors, prepend=0), n)))
        return _rows(out, ASKED)

    return run


def _reply(crowded: int):
    """For a shard's questions: which of the anchors are in more than one fragment (1) or in very many (2)."""

    def run(table: pa.Table) -> pa.Table:
        asked = [_unpack(blob)[0] for blob in table["blob"].to_pylist()]
        steps, n = [a[0] for a in asked], np.concatenate([a[1] for a in asked])
        anchors = np.concatenate([np.cumsum(s) for s in steps])
        _, which = np.unique(anchors, return_inverse=True)
        total = np.bincount(which, weights=n)[which]
        flag = (total > 1).astype(np.int64) + (total >= crowded)
        ends = np.cumsum([len(s) for s in steps])
        out = [(batch, _pack(np.array([shard]), f)) for batch, shard, f in zip(table["__batch"].to_pylist(), table["shard"].to_pylist(), np.split(flag, ends[:-1]))]
        return _rows(out, REPLY)

    return run


def _send(window: int, shards: int):
    """(batch, shard, blob): the fragments of a batch that others may have, and under a negative shard of its own where they stand."""

    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(table):
            return _rows([], ASKED)
        number, _, keys, b = _batch_of(table, window, NONE)
        flags = {int(a[0][0]): a[1] for a in (_unpack(blob)[0] for blob in replies["blob"].to_pylist())}
        flag = np.zeros(len(b.distinct), dtype=np.int64)
        for shard, part in _shares(b, shards):
            anchors, which = np.unique(_short(b.anchor[b.distinct[part]]), return_inverse=True)
            flag[part] = flags[shard][which]
        if (flag == 2).any():
            crowded = np.unique(b.anchor[b.distinct[flag == 2]])
            shared = np.unique(b.anchor[b.distinct[flag == 1]])
            b.form(crowded)
            flag = (np.isin(b.anchor[b.distinct], shared) | (b.run_windows[b.distinct] == 1) & np.isin(b.source_anchor[b.distinct], crowded)).astype(np.int64)
        # Runs of fragments that stand once in the batch and in no other can't be repeats.
        local = np.bincount(b.run_fragment, minlength=len(b.distinct)) > 1
        kept = np.flatnonzero((flag > 0)[b.run_fragment] | local[b.run_fragment])
        windows = b.run_windows[b.distinct]
        out = [(number, -1 - number, _pack(np.diff(b.run_at[kept], prepend=0), b.run_fragment[kept], windows, b.least_id))]
        for shard, part in _shares(b, shards):
            part = part[flag[part] > 0]
            if len(part):
                text = b"\n".join([b.words_of(f) for f in part.tolist()])
                out.append((number, shard, _pack(part, b.anchor[b.distinct[part]].view(np.int64), b.least_id[part], text=text)))
        return _rows(out, ASKED)

    return run


def _match(window: int):
    """(batch, place, blob). For the fragments of a shard: the smallest doc_id of each of their windows, where it is below
    the batch's own. What a batch keeps under its negative shard passes by, as `place`: so that fragments, the bulk
    of the data, are written to disk once, in this shuffle."""

    def run(table: pa.Table) -> pa.Table:
        release()
        batches, blobs = table["__batch"].to_pylist(), table["blob"].to_pylist()
        if table["shard"][0].as_py() < 0:
            return _rows([(n, True, blob) for n, blob in zip(batches, blobs)], MATCHED)
        parts, texts = zip(*map(_unpack, blobs))
        source = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        fragment, anchor, least_id = (np.concatenate([p[i] for p in parts]) for i in range(3))
        _, which, times = np.unique(anchor, return_inverse=True, return_counts=True)
        shared = np.flatnonzero(times[which] > 1)
        if not len(shared):
            return _rows([], MATCHED)
        lines = [line for text in texts for line in text.split(b"\n")]
        content: dict[bytes, int] = defaultdict()
        content.default_factory = content.__len__
        text_of = np.array([content[lines[i]] for i in shared], dtype=np.int64)
        content.default_factory = None
        del lines, texts
        vocabulary: dict[bytes, int] = defaultdict()
        vocabulary.default_factory = lambda: len(vocabulary) + 1
        symbols = [[*map(vocabulary.__getitem__, t.split()), 0] for t in content]
        vocabulary.default_factory = None
        sizes = np.array([len(s) for s in symbols], dtype=np.int64)
        symbols = np.fromiter((x for s in symbols for x in s), dtype=np.int64, count=int(sizes.sum()))
        ends = np.cumsum(sizes) - 1
        owners = np.full(len(content), NO_ID, dtype=np.int64)
        np.minimum.at(owners, text_of, least_id[shared])

        index = FmIndex(symbols, window, np.repeat(owners, sizes))
        at, low, high = match_windows(index, symbols, ends, sizes - 1)
        minima = np.full(len(symbols), NO_ID, dtype=np.int64)
        minima[at] = index.least(low, high)

        out = []
        begins, windows = ends - sizes + 1, sizes - window
        for s in np.unique(source[shared]).tolist():
            mine = source[shared] == s
            text, own = text_of[mine], least_id[shared][mine]
            k = windows[text]
            flat = np.repeat(begins[text] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
            news = np.add.reduceat((minima[flat] < np.repeat(own, k)).astype(np.int64), np.cumsum(k) - k) > 0
            if news.any():
                out.append((batches[s], False, _pack(fragment[shared][mine][news], minima[flat[np.repeat(news, k)]])))
        return _rows(out, MATCHED)

    return run


def _covered(b_ids: np.ndarray, n_words: np.ndarray, places: list[bytes], answers: list[bytes], window: int) -> np.ndarray:
    """For every word of a batch whether a window over it is in a document with a smaller id."""
    first = np.concatenate([[0], np.cumsum(n_words)])
    edges = np.zeros(int(first[-1]) + 1, dtype=np.int64)
    for blob in places:
        (run_steps, run_fragment, windows, least_id), _ = _unpack(blob)
        run_at = np.cumsum(run_steps)
        offset = np.concatenate([[0], np.cumsum(windows)])
        minima = np.repeat(least_id, windows)
        for answer in answers:
            (fragments, least), _ = _unpack(answer)
            k = windows[fragments]
            flat = np.repeat(offset[fragments] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
            minima[flat] = np.minimum(minima[flat], least)
        k = windows[run_fragment]
        flat = np.repeat(offset[run_fragment] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
        at = np.repeat(run_at - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
        own = b_ids[np.searchsorted(first, at, side="right") - 1]
        known = at[minima[flat] < own]
        np.add.at(edges, known, 1)
        np.add.at(edges, known + window, -1)
    return np.cumsum(edges[:-1]) > 0


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _keep(text: bytes, spans: np.ndarray) -> bytes:
    """The text without the word spans, its other words as they stand in it."""
    space = _SPACE[np.frombuffer(text, dtype=np.uint8)]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]])))
    begins, ends = edges[::2], edges[1::2]
    kept = np.concatenate([[0], spans, [len(begins)]]).reshape(-1, 2).tolist()
    return b" ".join(text[begins[a] : ends[b - 1]] for a, b in kept if b > a)


def _clean(window: int, columns: list[str]):
    """The documents of a batch less their repeats, every other column as it is."""

    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        release()
        ids, keys = table["__id"].to_numpy(), table["__key"].to_numpy()
        order = np.lexsort((keys, ids)).tolist()
        texts = table["text"].to_pylist()
        n_words = np.array([len((texts[i] or "").encode("utf-8", "surrogatepass").split()) for i in order], dtype=np.int64)
        place = found["place"].to_pylist()
        blobs = found["blob"].to_pylist()
        covered = _covered(ids[order], n_words, [x for x, p in zip(blobs, place) if p], [x for x, p in zip(blobs, place) if not p], window)
        words, removed, at = [0] * len(order), [0] * len(order), 0
        for i, n in zip(order, n_words.tolist()):
            gone = covered[at : at + n]
            at += n
            words[i], removed[i] = n, int(gone.sum())
            if removed[i]:
                edges = np.concatenate([[False], gone, [False]])
                texts[i] = _keep(texts[i].encode("utf-8", "surrogatepass"), np.flatnonzero(edges[1:] != edges[:-1])).decode("utf-8", "surrogatepass")
        kept = [pa.array(texts, type=table.schema.field("text").type) if c == "text" else table[c] for c in columns]
        return pa.table([*kept, pa.array(words, type=pa.int64()), pa.array(removed, type=pa.int64())], names=[*columns, "n_words", "n_removed"])

    return run


def remove_repeats(docs: DataFrame, window: int = 13, crowded: int = CROWDED) -> DataFrame:
    """docs with their text less every word of a window that a document with a smaller doc_id has too.

    Adds n_words and n_removed (columns of these names are replaced); texts that lose nothing stay as they
    are, byte for byte, null ones too. The rest of a text keeps its white space; where words went, the
    neighbours are one space apart. Rows with one doc_id do not remove each other's words, and a null
    doc_id counts as larger than any other. doc_id must be an integer. An empty table gives an empty result.
    Names that begin with __ are reserved.
    """
    columns = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards, batches = (int(max(1, -(-size // n))) for n in (SHARD_BYTES, BATCH_BYTES))
    id_, key = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID))), F.xxhash64(F.coalesce("text", F.lit("")))
    dealt = docs.select(*columns, id_.alias("__id"), key.alias("__key")).withColumn("__batch", F.pmod(F.xxhash64("__id", "__key"), F.lit(batches)))
    # All three uses below take all columns, so that they share this one shuffle of the texts.
    dealt = dealt.repartition("__batch")
    asked = dealt.groupBy("__batch").applyInArrow(_ask(window, shards), "__batch long, shard long, blob binary")
    replies = asked.groupBy("shard").applyInArrow(_reply(crowded), "__batch long, blob binary")
    sent = dealt.groupBy("__batch").cogroup(replies.groupBy("__batch")).applyInArrow(_send(window, shards), "__batch long, shard long, blob binary")
    matched = sent.groupBy("shard").applyInArrow(_match(window), "__batch long, place boolean, blob binary")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in columns)
    return dealt.groupBy("__batch").cogroup(matched.groupBy("__batch")).applyInArrow(_clean(window, columns), f"{kinds}, n_words long, n_removed long")
