"""Reversible line dedup: exact reference counts of lines, with sharded cuckoo filters in front.

State is two tables. `counts` has, for each line key, the number of documents that hold it; adding documents
adds to it, deleting documents subtracts, so a deletion is undone exactly. `filters` has one cuckoo filter per
shard of the keys that are common (held by min_docs documents or more). When counts change, only the keys that
cross the limit are inserted into or deleted from their shard's filter; cuckoo filters allow both.

A pass over documents asks the filters first, which are small (two bytes a common key), and only the lines
they let through are joined with the exact counts; a filter never lets a common line slip, and the join removes
the few others. The filters go to the tasks in chunks of shards of about CHUNK_MB at most, and a line is asked in the
chunk that has its shard; if there is more than one chunk, the lines are written once, by chunk.

A shard's filter is a stack of tables of one size: when all are full, it gets another one.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, lower_ascii, scratch, written

SLOTS, KICKS = 4, 500
#: Common keys of a shard, and buckets of each table of its filter.
PER_SHARD, BUCKETS = 16_384, 8_192
CHUNK_MB = 64
FILTERS = "shard int, shards int, buckets int, tables array<binary>"


class CuckooFilter:
    """16-bit fingerprints in buckets of four; partial-key cuckoo hashing (Fan et al. 2014). A stack of tables: equal
    prints in equal buckets stand for each other, in whichever table they are."""

    def __init__(self, tables: list | None = None, buckets: int = BUCKETS):
        self.buckets = buckets
        self.tables = [np.frombuffer(t, np.uint16).reshape(buckets, SLOTS).copy() for t in tables or []]

    def packed(self) -> list[bytes]:
        return [t.tobytes() for t in self.tables if t.any()]

    def _places(self, keys: np.ndarray):
        k = np.asarray(keys, np.int64).view(np.uint64)
        prints = ((k >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)
        first = ((k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)).astype(np.int64) & (self.buckets - 1)
        return prints, first, first ^ self._step(prints)

    def _step(self, prints):
        return (np.asarray(prints, np.int64) * 0x5BD1E995 & 0x7FFFFFFF) & (self.buckets - 1)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        p, a, b = self._places(keys)
        out = np.zeros(len(p), dtype=bool)
        for t in self.tables:
            out |= ((t[a] == p[:, None]) | (t[b] == p[:, None])).any(axis=1)
        return out

    def _put(self, t: np.ndarray, p, a, b, seed: int) -> bool:
        for at in (a, b):
            free = np.flatnonzero(t[at] == 0)
            if len(free):
                t[at, free[0]] = p
                return True
        at, rng, moved = int(a), np.random.default_rng(seed), []
        for _ in range(KICKS):
            slot = int(rng.integers(SLOTS))
            moved.append((at, slot, t[at, slot]))
            p, t[at, slot] = t[at, slot], p
            at = int(at ^ self._step(p))
            free = np.flatnonzero(t[at] == 0)
            if len(free):
                t[at, free[0]] = p
                return True
        for at, slot, old in reversed(moved):  # as it was
            t[at, slot] = old
        return False

    def insert(self, key: int, seed: int = 7) -> None:
        p, a, b = (x[0] for x in self._places(np.array([key])))
        if not any(self._put(t, p, a, b, seed) for t in self.tables):
            self.tables.append(np.zeros((self.buckets, SLOTS), np.uint16))
            self._put(self.tables[-1], p, a, b, seed)

    def delete(self, key: int) -> bool:
        p, a, b = (x[0] for x in self._places(np.array([key])))
        for t in self.tables:
            for at in (a, b):
                slot = np.flatnonzero(t[at] == p)
                if len(slot):
                    t[at, slot[0]] = 0
                    return True
        return False


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACE_CHARS)))


def _keys(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), line_key)


def _hashes(key: Column) -> list[Column]:
    """96 bits name a key."""
    return [F.xxhash64(key).alias("h"), F.hash(key).alias("g")]


def reference_counts(docs: DataFrame, text: str = "text", min_chars: int = 1) -> DataFrame:
    """(h, g, n): documents (rows) that hold each key of min_chars code points at least."""
    keys = docs.select(F.explode(F.array_distinct(F.filter(_keys(F.col(text)), lambda k: F.length(k) >= min_chars))).alias("k"))
    return keys.select(*_hashes(F.col("k"))).groupBy("h", "g").agg(F.count("*").alias("n"))


def add(counts: DataFrame, change: DataFrame, sign: int = 1) -> DataFrame:
    """counts after adding (1) or deleting (-1) the documents that change counts. Keys no document holds go."""
    both = counts.select("h", "g", "n").unionByName(change.select("h", "g", (F.col("n") * sign).alias("n")))
    return both.groupBy("h", "g").agg(F.sum("n").alias("n")).where("n != 0")


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("h", F.lit(11)), F.lit(shards)).cast("int").alias("shard")


def no_filters(spark) -> DataFrame:
    """The filters of no documents."""
    return spark.createDataFrame([], FILTERS)


def update_filters(filters: DataFrame, old: DataFrame, new: DataFrame, min_docs: int, shards: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """filters after counts went from old to new: keys that cross the limit are inserted or deleted.

    Shards and buckets are those of the filters; where there are none yet, they are given, or the number of shards
    follows from the number of common keys. Once the common keys are more than PER_SHARD a shard, all filters are built
    anew from the exact counts, with twice the shards that they need: shards stay small however a state grows, and over
    its growth each key is dealt again a few times only."""
    a, b = old.select("h", "g", F.col("n").alias("a")), new.select("h", "g", F.col("n").alias("b"))
    moved = a.join(b, ["h", "g"], "full").select("h", (F.coalesce("b", F.lit(0)) >= min_docs).alias("up"), (F.coalesce("a", F.lit(0)) >= min_docs).alias("was")).where("up != was")
    moved = written(moved.select("h", "up"), "moved_keys")
    known = filters.agg(F.max("shards").alias("s"), F.max("buckets").alias("b")).first()
    needed = max(1, -(-new.where(F.col("n") >= min_docs).count() // PER_SHARD))
    shards, buckets = known["s"] or shards or needed, known["b"] or buckets
    if known["s"] and needed > shards:
        shards, filters = 2 * needed, filters.limit(0)
        moved = written(new.where(F.col("n") >= min_docs).select("h", F.lit(True).alias("up")), "moved_keys")

    def change(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        f = CuckooFilter(list(left["tables"].iloc[0]) if len(left) else None, buckets)
        for h in right.loc[~right["up"], "h"]:
            f.delete(int(h))
        for h in right.loc[right["up"], "h"]:
            f.insert(int(h))
        return pd.DataFrame({"shard": [key[0]], "shards": [shards], "buckets": [buckets], "tables": [f.packed()]})

    return filters.groupBy("shard").cogroup(moved.select("h", "up", _shard(shards)).groupBy("shard")).applyInPandas(change, FILTERS)


def _asked(lines: DataFrame, filters: DataFrame, keep: list[str], chunk_mb: float) -> DataFrame:
    """Those lines (…, h, shard) that the filters let through."""
    size = filters.agg(F.sum(F.aggregate("tables", F.lit(0).cast("long"), lambda n, t: n + F.length(t)))).first()[0] or 0
    chunks = max(1, int(-(-size // (chunk_mb * (1 << 20)))))
    chunk = F.pmod(F.xxhash64("shard", F.lit(5)), F.lit(chunks)).cast("int")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema.fields if f.name in keep)
    if chunks > 1:
        lines = written(lines.withColumn("chunk", chunk), "lines", by="chunk")
    out = []
    for c in range(chunks):
        tables = {r["shard"]: (list(r["tables"]), r["buckets"]) for r in filters.where(chunk == c).collect()}

        def run(batches, tables=tables):
            fs = {s: CuckooFilter(*t) for s, t in tables.items()}
            for b in batches:
                t = pa.Table.from_batches([b])
                h, s = t["h"].to_numpy(), t["shard"].to_numpy()
                ok = np.zeros(len(h), dtype=bool)
                for shard in np.unique(s):
                    if shard in fs:
                        at = np.flatnonzero(s == shard)
                        ok[at] = fs[shard].contains(h[at])
                yield from t.filter(pa.array(ok)).select(keep).to_batches()

        if chunks == 1:
            return lines.mapInArrow(run, schema)
        # written chunk by chunk, so that no plan holds all filters
        out.append(written(lines.where(F.col("chunk") == c).drop("chunk").mapInArrow(run, schema), "asked_lines"))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def drop_common(docs: DataFrame, counts: DataFrame, filters: DataFrame, min_docs: int, doc_id: str = "doc_id", text: str = "text", min_chars: int = 1, chunk_mb: float = CHUNK_MB) -> DataFrame:
    """(doc_id, kept, n_lines, n_dropped) of each row of docs."""
    shards = filters.agg(F.max("shards").alias("s")).first()["s"]
    # hashed before the lines are dealt out, or each line would carry the whole text along
    named = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_t"), F.col(text).alias("_text"))
    lines = named.select("_id", "_t", F.posexplode(_keys(F.col("_text"))).alias("pos", "k")).where(F.length("k") >= min_chars)
    lines = lines.select("_id", "_t", "pos", *_hashes(F.col("k")))
    lines = _asked(lines.withColumn("shard", _shard(shards or 1)), filters, ["_id", "_t", "pos", "h", "g"], chunk_mb)
    common = counts.where(F.col("n") >= min_docs).select("h", "g")
    gone = lines.join(common, ["h", "g"]).groupBy(F.col("_id").alias("_id2"), F.col("_t").alias("_t2")).agg(F.collect_set("pos").alias("gone"))
    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.xxhash64(text).alias("_t"))
    out = rows.join(gone, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_t") == F.col("_t2")), "left")
    parts = F.split("_text", "\n")
    # places that stay by a set difference, then one look-up each: linear in the lines; the lines are split once, as the one element of an array
    staying = lambda p: F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col("gone"))
    some = F.get(F.transform(F.array(parts), lambda p: F.array_join(F.transform(staying(p), lambda i: F.get(p, i)), "\n")), F.lit(0))
    left = F.when(F.col("gone").isNull(), F.col("_text")).otherwise(some)
    return out.select(F.col("_id").alias(doc_id), left.alias("kept"), F.size(parts).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


def no_documents(spark, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """The state (counts, filters) of an empty set of documents."""
    return spark.createDataFrame([], "h long, g int, n long"), no_filters(spark)


def change_documents(state: tuple[DataFrame, DataFrame], docs: DataFrame, min_docs: int, sign: int = 1, text: str = "text", min_chars: int = 1, shards: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The state (counts, filters) after docs were inserted (1) or deleted (-1); both tables are written."""
    counts, filters = state
    now = written(add(counts, reference_counts(docs, text, min_chars), sign), "line_counts")
    return now, written(update_filters(filters, counts, now, min_docs, shards), "line_filters")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """(doc_id, kept, n_lines, n_dropped): each text without the lines whose key (stripped, A-Z lower-cased, of
    min_chars code points at least) min_docs documents or more hold. The documents are inserted into an empty state.

    A null or empty text is one empty line; each row is a document, repeated rows too; other columns are
    ignored; an empty table gives an empty one.
    """
    with scratch(docs.sparkSession):
        counts, filters = change_documents(no_documents(docs.sparkSession, min_docs), docs, min_docs, 1, text, min_chars)
        return written(drop_common(docs, counts, filters, min_docs, doc_id, text, min_chars), "deduplicated", up=1)
