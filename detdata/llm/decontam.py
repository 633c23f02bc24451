"""Benchmark decontamination by SimHash of item-sized windows.

A benchmark item of L words is compared with every run of L words of every document (of the whole document
if it is shorter). Both are multisets of k-word shingles; a window's 128-bit SimHash is the sign of the summed
+1/-1 bits of its shingles. The items' fingerprints are indexed by BLOCKS blocks of 16 bits, each with
all values within RADIUS // BLOCKS bits: two fingerprints within RADIUS differ by no more than that in one
block at least, so the index returns every item within RADIUS, and of unrelated items one in 12. Candidates are
verified by the exact weighted Jaccard similarity of the multisets, sum(min) / sum(max) of the counts.

At similarity 0.8, fingerprints differ in 19 bits, give or take 4; RADIUS is three such deviations above.

A window without any shingle of an item of its size has similarity 0, so fingerprints are only taken where
one of its shingles stands; that leaves nothing out.

The items are the stated query set: they go to the tasks in chunks of about CHUNK shingles and CHUNK_ITEMS items, a
bound that does not depend on the data, and the documents are read once for each chunk.
"""

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .common import lean, written

WORDS64, BLOCKS, RADIUS = 2, 8, 31
CHUNK, CHUNK_ITEMS = 1_000_000, 2_048
#: Windows fingerprinted at once, and shingles summed at once.
AT_ONCE, SLICE = 4096, 1 << 15
_NEAR = [np.array([v for v in range(1 << 16) if v.bit_count() <= d], dtype=np.uint16) for d in range(5)]


def _signs(values: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each shingle's 128-bit hash."""
    wide = np.stack([values, H.mix(values, 9)], axis=1)
    return np.unpackbits(wide.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(np.uint64)


def _sum(values: np.ndarray) -> np.ndarray:
    total = np.zeros(64 * WORDS64, np.int64)
    for i in range(0, len(values), SLICE):
        total += _signs(values[i : i + SLICE]).sum(axis=0, dtype=np.int64)
    return total


def simhash(values: np.ndarray) -> np.ndarray:
    return _pack(_sum(values)[None])[0]


def window_prints(s: np.ndarray, start: int, count: int, width: int) -> np.ndarray:
    """Fingerprints of `count` neighbouring windows of `width` shingles: the first is summed, each next one differs by
    what enters and what leaves."""
    total = np.empty((count, 64 * WORDS64), np.int64)
    total[0] = _sum(s[start : start + width])
    if count > 1:
        change = _signs(s[start + width : start + width + count - 1]).astype(np.int64) - _signs(s[start : start + count - 1])
        np.cumsum(change, axis=0, out=total[1:])
        total[1:] += total[0]
    return _pack(total)


def _member(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    at = np.searchsorted(ordered, x)
    return ordered[np.minimum(at, len(ordered) - 1)] == x


class ItemIndex:
    """Items (item_id, word hashes) with their shingles and the multi-index over their fingerprints."""

    def __init__(self, items: list, k: int, radius: int):
        self.k, self.radius = k, radius
        by_size = defaultdict(list)
        for item_id, words in items:
            if len(words):
                s = H.shingles(words, min(k, len(words)))
                by_size[len(words)].append((item_id, Counter(s.tolist()), simhash(s), s))
        self.by_size = dict(by_size)
        self.known = {n: np.unique(np.concatenate([x[3] for x in v])) for n, v in self.by_size.items()}
        # shingle lengths: items shorter than k have their whole text as one shingle
        self.lengths = sorted({min(k, n) for n in self.by_size})
        self.all = {m: np.unique(np.concatenate([v for n, v in self.known.items() if min(k, n) == m])) for m in self.lengths}
        self.bitmap = {}
        for m, v in self.all.items():
            b = np.zeros(1 << 20, dtype=bool)
            b[(v >> np.uint64(44)).astype(np.int64)] = True
            self.bitmap[m] = b
        self.prints = {n: np.stack([x[2] for x in v]) for n, v in self.by_size.items()}
        # for each block: the values near to an item's, in order, and the items
        near, self.tables = _NEAR[radius // BLOCKS], {}
        for n, prints in self.prints.items():
            self.tables[n] = []
            for block in prints.view(np.uint16).T:
                values = (block[:, None] ^ near).ravel()
                order = np.argsort(values, kind="stable")
                self.tables[n].append((values[order], (order // len(near)).astype(np.int32)))

    def _candidates(self, n: int, prints: np.ndarray):
        """(window, item) pairs within the radius."""
        fps, out = self.prints[n], [np.zeros(0, np.int64)]
        for block, (values, items) in zip(prints.view(np.uint16).T, self.tables[n], strict=True):
            first, last = np.searchsorted(values, block), np.searchsorted(values, block, side="right")
            size = last - first
            at = np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)
            window, item = np.repeat(np.arange(len(block)), size), items[at]
            close = np.bitwise_count(prints[window] ^ fps[item]).sum(axis=1) <= self.radius
            out.append(window[close] * len(fps) + item[close])
        pairs = np.unique(np.concatenate(out))
        return list(zip((pairs // len(fps)).tolist(), (pairs % len(fps)).tolist(), strict=True))

    def matches(self, words: np.ndarray, num: int, den: int):
        """(item_id, start, n_words, similarity): for each item the most similar window, the first of equals."""
        best = {}
        for m in self.lengths:
            if len(words) < m:
                continue
            s = H.shingles(words, m)
            maybe = np.flatnonzero(self.bitmap[m][(s >> np.uint64(44)).astype(np.int64)])
            if not len(maybe):
                continue
            hit = maybe[_member(s[maybe], self.all[m])]
            if not len(hit):
                continue
            for n, items in self.by_size.items():
                if min(self.k, n) != m:
                    continue
                at = hit[_member(s[hit], self.known[n])]
                if not len(at):
                    continue
                size = min(n, len(words))
                width = size - m + 1  # shingles of a window
                last = len(s) - width
                mark = np.zeros(last + 2, dtype=np.int32)
                np.add.at(mark, np.clip(at - width + 1, 0, last + 1), 1)
                np.add.at(mark, np.clip(at + 1, 0, last + 1), -1)
                starts = np.flatnonzero(np.cumsum(mark[: last + 1]) > 0)
                for p in range(0, len(starts), AT_ONCE):
                    part = starts[p : p + AT_ONCE]
                    for run in np.split(part, np.flatnonzero(np.diff(part) > 1) + 1):
                        for w, i in self._candidates(n, window_prints(s, int(run[0]), len(run), width)):
                            start = int(run[w])
                            item_id, counts, _, _ = items[i]
                            own = Counter(s[start : start + width].tolist())
                            both = sum((own & counts).values())
                            union = sum((own | counts).values())
                            if den * both >= num * union:
                                found = (both / union, -start, size)
                                if found > best.get(item_id, (0.0,)):
                                    best[item_id] = found
        return [(item_id, -start, size, sim) for item_id, (sim, start, size) in best.items()]


def _words_of(items: list) -> list:
    column = pa.array([t for _, t in items], pa.string())
    return [(items[i][0], h.copy()) for i, h in H.texts(column)]


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 5, num: int = 4, den: int = 5, radius: int = RADIUS, chunk: int = CHUNK, chunk_items: int = CHUNK_ITEMS) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity): for each document and item the most similar window
    of the item's size, if its similarity is num/den at least; documents without one have no row.

    Words are runs without white space, A-Z lower-cased. Null or empty texts and items match nothing; items with
    fewer than k words are one shingle; of equal windows the first counts; repeated rows give repeated results;
    other columns are ignored; empty tables give an empty one.
    """
    # how the items fall into chunks of bounded size
    sizes = benchmark.agg(F.sum(F.length(item_text)).alias("n"), F.count("*").alias("m")).first()
    chunks = max(1, -(-int(sizes["n"] or 0) // (chunk * 2)), -(-sizes["m"] // chunk_items))
    src = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    id_type, item_type = src.schema[0].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    out_schema = f"`{doc_id}` {id_type}, `{item_id}` {item_type}, start_word long, n_words long, similarity double"
    parts = benchmark.select(F.col(item_id).alias("i"), F.col(item_text).alias("t"), F.pmod(F.xxhash64(item_text), F.lit(chunks)).alias("c"))
    out = None
    for c in range(chunks):
        items = _words_of([(r["i"], r["t"]) for r in parts.where(F.col("c") == c).select("i", "t").distinct().collect()])
        found = src.mapInArrow(lean(_scan(items, k, num, den, radius, doc_id, item_id)), out_schema)
        if chunks > 1:  # so that no plan holds all items
            found = written(found, "contaminated")
        out = found if out is None else out.unionByName(found)
    return out


def _scan(items: list, k: int, num: int, den: int, radius: int, doc_id: str, item_id: str):
    def run(batches):
        index = ItemIndex(items, k, radius)
        for b in batches:
            rows = [(i, *m) for i, h in H.texts(b.column(1)) for m in index.matches(h, num, den)]
            ids = b.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([r[1] for r in rows]) if rows else pa.array([], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.float64())], names=[doc_id, item_id, "start_word", "n_words", "similarity"])

    return run
