"""Exact Jaccard self-join of shingle sets by vertical partitioning.

The global n-gram order is the order of the shingles' 64-bit hashes. It is cut into fragments, and each
document's sorted set with it, into one segment per fragment.

Candidates. Two sets with Jaccard >= t differ in at most D = floor((1-t)/(1+t) * (|a|+|b|)) shingles. Cut
into more than D fragments, one segment at least is the same in both. Sizes fall into classes so that
similar sets are in the same class or in neighbouring ones; a group is a class with the one below, and
has one number of fragments, 11/10 of D+1 for its largest sets. A set with more than D non-empty segments
sends the hashes of its non-empty segments; a set with fewer (few shingles, unevenly spread) sends its
prefix besides, so that two such sets meet there. No link is lost, and since a segment holds several
shingles, sets that merely share a common passage seldom meet. They meet less still because the most common
shingles, HOT at most, stay out of the segments and stand last in the order: leaving the same shingles out of
all sets only lowers their differences, so which ones are left out is free, and the list's size is fixed.

Filter. Each class has a bitmap of BITS parities of its shingles. Two bitmaps differ in no more bits than the
sets differ in shingles, so pairs whose bitmaps are too far apart are left out inside the join.

Verification. The sets of candidate pairs are cut into FRAGMENTS segments; each fragment's partial overlap
is counted by itself and the counts are summed per pair, which gives the exact intersection. Only the texts of
candidate pairs are read again, and of a pair only one set travels to the other.

Large groups. Sets that are equal form one class (copies are never expanded). Of those that share a segment,
each is first compared with one only, that which meets most others (of near copies, the one they come from);
then components are formed, and only pairs from different components that share a segment are compared as
well: of a key, the sets outside its largest component with all others. All pairs of a group of near copies never
arise. Two sets that share many keys meet at few of them: each knows the SKETCH least of its keys, and a key at
which both could have met at a lesser one, that both know, is passed over. That bounds what a row carries,
whatever the length of its text.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import hashing as H
from .common import lean, scratch, within, written
from .components import components

FRAGMENTS = 16
#: Parity bits of a class, in 64-bit words.
WORDS64 = 8
#: Common shingles that are left out of the segments, and those that a batch of rows may name.
HOT, HOT_BATCH = 100_000, 4_096
#: Least keys of a set that its rows carry.
SKETCH = 8
#: Keys or shingles that a task holds before it sends them on, and signatures that it remembers to skip copies.
OUT, SEEN = 400_000, 200_000


class Plan:
    """Size classes and the number of fragments of each group, for Jaccard >= num/den."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.low = num, den, [1]

    def group(self, n: int) -> int:
        while self.low[-1] <= n:
            self.low.append(self.low[-1] * self.den // self.num + 1)
        return int(np.searchsorted(self.low, n, side="right")) - 1

    def most_apart(self, group: int) -> int:
        self.group(self.low[-1]) if group + 1 >= len(self.low) else None
        return 2 * (self.low[group + 1] - 1) * (self.den - self.num) // (self.den + self.num)

    def keys(self, s: np.ndarray, hot: np.ndarray) -> np.ndarray:
        n, out = len(s), []
        order = s
        if len(hot):
            common = hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s
            order, s = np.concatenate([s[~common], s[common]]), s[~common]
        own = self.group(n)
        for group in (own, own + 1):
            apart = self.most_apart(group)
            if not apart:
                continue
            count = (apart + 1) * 11 // 10 + 1
            cell = ((s >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
            first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(s) else []
            if len(first):
                segments = np.add.reduceat(H.mix(s, 3), first)
                out.append(H.mix(segments + cell[first] * np.uint64(0x9E3779B97F4A7C15), group + 101))
            if len(first) <= apart:
                prefix = n - -(-n * self.num // self.den) + 1
                out.append(H.mix(order[:prefix], group + 100_003))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _signature(s: np.ndarray) -> tuple[int, int]:
    return int(np.add.reduce(H.mix(s, 1)).astype(np.int64)), int(np.add.reduce(H.mix(s, 2)).astype(np.int64))


def _common(sets: list) -> list:
    """(shingle, count) of those in many of these sets: 4 and 1 in 200 at least."""
    least, s = max(4, len(sets) // 200), np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    cell = (s >> np.uint64(44)).astype(np.int32)
    s = s[np.bincount(cell, minlength=1 << 20)[cell] >= least]
    value, count = np.unique(s, return_counts=True)
    top = np.flatnonzero(count >= least)
    top = top[np.argsort(-count[top], kind="stable")[:HOT_BATCH]]
    return [{"t": t, "c": c} for t, c in zip(value[top].view(np.int64).tolist(), count[top].tolist(), strict=True)]


def _bitmap(s: np.ndarray) -> np.ndarray:
    """Parities of the shingles by their low bits."""
    odd = np.bincount((s & np.uint64(64 * WORDS64 - 1)).astype(np.int64), minlength=64 * WORDS64) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def shingle_sets(docs: DataFrame, text: str, k: int, carry: list[Column]) -> DataFrame:
    """The carried columns, n_shingles and the two halves of a 128-bit signature of the set. Rows without
    words have 0 shingles and null signatures. Of the rows that leave a task together, the last carries their common
    shingles."""
    src = docs.select(*carry, F.col(text).alias("_text"))
    keep = src.columns[:-1]

    def run(batches):
        for b in batches:
            first, n, a, c, bits, sets, size = 0, [], [], [], [], [], 0
            for i, h in H.texts(b.column(b.num_columns - 1)):
                s = H.distinct(H.shingles(h, k))
                x, y = _signature(s) if len(s) else (None, None)
                n.append(len(s)), a.append(x), c.append(y), bits.append(_bitmap(s)), sets.append(s)
                size += len(s)
                if size >= OUT or i + 1 == b.num_rows:
                    hot = pa.array([None] * (len(n) - 1) + [_common(sets)], pa.list_(pa.struct([("t", pa.int64()), ("c", pa.int64())])))
                    rows = b.slice(first, len(n))
                    yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(bits, pa.list_(pa.int64())), hot], names=[*keep, "n_shingles", "sig", "sig2", "bits", "hot"])
                    first, n, a, c, bits, sets, size = i + 1, [], [], [], [], [], 0

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(lean(run), f"{fields}, n_shingles long, sig long, sig2 long, bits array<long>, hot array<struct<t: long, c: long>>")


def segment_keys(docs: DataFrame, text: str, k: int, num: int, den: int, hot: np.ndarray) -> DataFrame:
    """(key, sig): one row for each key of each set; sets met before in the same task are left out."""

    def run(batches):
        plan, seen, out, size = Plan(num, den), set(), [], 0
        for b in batches:
            for _, h in H.texts(b.column(0)):
                s = H.distinct(H.shingles(h, k))
                if not len(s):
                    continue
                sig, _ = _signature(s)
                if sig in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(sig)
                keys = plan.keys(s, hot)
                if len(keys):
                    out.append((keys, sig))
                    size += len(keys)
                if size >= OUT:
                    yield _rows(out)
                    out, size = [], 0
        if out:
            yield _rows(out)

    return docs.select(F.col(text).alias("_text")).mapInArrow(lean(run), "key long, sig long")


def _rows(out) -> pa.RecordBatch:
    lens = [len(x) for x, _ in out]
    return pa.RecordBatch.from_arrays([
        pa.array(np.concatenate([x for x, _ in out]).view(np.int64)),
        pa.array(np.repeat(np.array([s for _, s in out], np.int64), lens)),
    ], names=["key", "sig"])


def _segments(rows: DataFrame, k: int, names: list[str]) -> DataFrame:
    """rows(names..., _text) → (names..., fragment, segment); what a task has sent before is left out."""

    def run(batches):
        cuts = np.arange(1, FRAGMENTS, dtype=np.uint64) * np.uint64(2**64 // FRAGMENTS)
        seen = set()

        def packed(b, at, frag, seg):
            take = pa.array(at, pa.int64())
            return pa.RecordBatch.from_arrays([*[c.take(take) for c in b.columns[:-1]], pa.array(frag, pa.int32()), pa.array(seg, pa.list_(pa.int64()))], names=[*names, "fragment", "segment"])

        for b in batches:
            ids = list(zip(*[c.to_pylist() for c in b.columns[:-1]], strict=True))
            at, frag, seg, size = [], [], [], 0
            for i, h in H.texts(b.column(b.num_columns - 1)):
                if ids[i] in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(ids[i])
                s = H.distinct(H.shingles(h, k))
                for f, part in enumerate(np.split(s.view(np.int64), np.searchsorted(s, cuts))):
                    if len(part):
                        at.append(i), frag.append(f), seg.append(part)
                size += len(s)
                if size >= OUT:
                    yield packed(b, at, frag, seg)
                    at, frag, seg, size = [], [], [], 0
            if at:
                yield packed(b, at, frag, seg)

    return rows.select(*names, "_text").mapInArrow(lean(run), ", ".join(f"{n} long" for n in names) + ", fragment int, segment array<long>")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, doc_id: str, text: str, k: int, num: int, den: int) -> DataFrame:
    """Of pairs(a, b, na, nb), each once, those with den*|intersection| >= num*|union|. The set of b travels to a,
    fragment by fragment."""
    body = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    place = classes.select("sig", F.col("first_id").alias("_at"), F.col("first_h").alias("_hash"))
    at = {"_at": F.col("_id"), "_hash": F.xxhash64("_text")}
    movers = written(pairs.select("a", "b").join(place, F.col("b") == F.col("sig")).drop("sig"), "movers")
    hosts = written(pairs.select("a").distinct().join(place, F.col("a") == F.col("sig")).drop("sig"), "hosts")
    sent = _segments(within(body, at, movers), k, ["a", "b"]).withColumnRenamed("segment", "sb")
    held = _segments(within(body, at, hosts), k, ["a"]).withColumnRenamed("segment", "sa")
    partial = sent.join(held, ["a", "fragment"]).select("a", "b", "fragment", F.size(F.array_intersect("sa", "sb")).cast("long").alias("x"))
    # rows that repeat both id and text give a fragment more than once
    total = partial.groupBy("a", "b", "fragment").agg(F.max("x").alias("x")).groupBy("a", "b").agg(F.sum("x").alias("both"))
    links = total.join(pairs, ["a", "b"]).where(den * F.col("both") >= num * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")
    return written(links, "links")


_BITS = [f"b{i}" for i in range(WORDS64)]


def _near(x: str, y: str, num: int, den: int) -> Column:
    """Sizes and bitmaps of x and y allow the similarity."""
    na, nb = F.col(x + ".n"), F.col(y + ".n")
    apart = sum(F.bit_count(F.col(f"{x}.{b}").bitwiseXOR(F.col(f"{y}.{b}"))) for b in _BITS)
    return (den * F.least(na, nb) >= num * F.greatest(na, nb)) & (apart * (den + num) <= (den - num) * (na + nb))


def similar_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """Links documents whose sets of k-word shingles (A-Z lower-cased) have Jaccard >= num/den and returns
    (row's doc_id, n_shingles, component_id, text_hash, is_first) for each row of docs.

    component_id is the least doc_id reached. text_hash is xxhash64 of the text; is_first holds for the component's
    first row by (doc_id, text_hash), null ids last, and for rows equal to it. A row without words (null, empty or
    blank text) has 0 shingles, no links, itself as component and is first. Equal rows or copies share a class; a null
    id never names a component unless all its members' ids are null. Other columns are ignored; an empty table gives
    an empty one.
    """
    with scratch(docs.sparkSession):
        return written(_joined(docs, doc_id, text, k, num, den), "components", up=1)


def _joined(docs: DataFrame, doc_id: str, text: str, k: int, num: int, den: int) -> DataFrame:
    sets = written(shingle_sets(docs, text, k, [F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_h")]), "sets")
    # the struct's least value has null ids last, so that a class is named by a real one
    classes = written(sets.where("n_shingles > 0").groupBy("sig").agg(F.min(F.struct(F.col("_id").isNull().alias("z"), "_id", "_h")).alias("m"), F.max("n_shingles").alias("n"), F.max("bits").alias("bits")).select("sig", "n", *[F.get("bits", F.lit(i)).alias(f"b{i}") for i in range(WORDS64)], F.col("m._id").alias("first_id"), F.col("m._h").alias("first_h")), "classes")
    common = sets.select(F.explode("hot").alias("x")).groupBy("x.t").agg(F.sum("x.c").alias("c")).orderBy(F.desc("c"), "t").limit(HOT)
    hot = np.sort(np.array([r["t"] for r in common.collect()], np.int64).view(np.uint64))
    keys = segment_keys(docs, text, k, num, den, hot)
    w = Window.partitionBy("key")
    met = keys.select("key", "sig", F.min("sig").over(w).alias("low"), F.max("sig").over(w).alias("high"), F.count("*").over(w).alias("size")).where("low != high").groupBy("key", "sig").agg(F.max("size").alias("size"))
    met = written(met, "met")

    sized = classes.select("sig", F.col("n").cast("long").alias("n"), *_BITS)
    central = met.groupBy("sig").agg(F.sum("size").alias("meets"))
    centre = met.select("key", "sig").join(central, "sig").groupBy("key").agg(F.max(F.struct("meets", "sig")).alias("m")).select("key", F.col("m.sig").alias("a"))
    first = met.join(centre, "key").where("sig != a").select("a", F.col("sig").alias("b")).distinct()
    first = first.join(sized.alias("x"), F.col("a") == F.col("x.sig")).join(sized.alias("y"), F.col("b") == F.col("y.sig")).where(_near("x", "y", num, den)).select("a", "b", F.col("x.n").alias("na"), F.col("y.n").alias("nb"))
    first = written(first, "pairs")
    edges = _verified(first, classes, docs, doc_id, text, k, num, den)
    labels = written(components(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))), "labels")

    # pairs of different components that share a key
    labelled = met.join(labels.withColumnRenamed("node", "sig"), "sig", "left").select("key", "sig", F.coalesce("component", "sig").alias("c"))
    per = labelled.groupBy("key", "c").agg(F.count("*").alias("m")).groupBy("key").agg(F.max_by("c", F.struct("m", "c")).alias("major"), F.count("*").alias("cs")).where("cs > 1")
    mixed = written(labelled.join(per.select("key", "major"), "key"), "mixed")
    least = mixed.select("sig", "key").withColumn("i", F.row_number().over(Window.partitionBy("sig").orderBy("key"))).where(F.col("i") <= SKETCH)
    known = least.groupBy("sig").agg(F.array_sort(F.collect_list("key")).alias("known")).join(sized, "sig")
    mixed = mixed.join(known, "sig")
    x, y = mixed.where("c != major").alias("x"), mixed.alias("y")
    once = (F.col("y.c") == F.col("y.major")) | (F.col("x.sig") < F.col("y.sig"))
    before = F.get(F.array_intersect("x.known", "y.known"), F.lit(0)) < F.col("x.key")
    pair = (F.col("x.key") == F.col("y.key")) & (F.col("x.c") != F.col("y.c")) & once & _near("x", "y", num, den) & ~F.coalesce(before, F.lit(False))
    of_less = lambda a, b: F.when(F.col("x.sig") < F.col("y.sig"), F.col(a)).otherwise(F.col(b))
    rest = x.join(y, pair).select(of_less("x.sig", "y.sig").alias("a"), of_less("y.sig", "x.sig").alias("b"), of_less("x.n", "y.n").alias("na"), of_less("y.n", "x.n").alias("nb")).distinct()
    rest = written(rest.join(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "pairs")
    if not rest.isEmpty():
        more = _verified(rest, classes, docs, doc_id, text, k, num, den)
        of = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias("_" + c))
        more = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("_a", "a").alias("u"), F.coalesce("_b", "b").alias("v"))
        joined = written(components(more).select("node", F.col("component").alias("_to")), "labels")
        # components that were joined, and sets that were alone until now
        old = labels.join(joined, F.col("component") == joined["node"], "left").select(labels["node"], F.coalesce("_to", "component").alias("component"))
        new = joined.join(labels.select("node"), "node", "left_anti").select("node", F.col("_to").alias("component"))
        labels = written(old.unionByName(new), "labels")

    named = classes.select("sig", F.struct(F.col("first_id").isNull().alias("z"), "first_id", "first_h").alias("f")).join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    least = named.groupBy("component").agg(F.min("f").alias("f"))
    known = named.select("sig", "component").join(least, "component").select("sig", F.col("f.first_id").alias("component_id"), F.col("f.first_h").alias("first_h"))
    out = sets.join(known, "sig", "left")
    alone = F.col("n_shingles") == 0
    is_first = alone | (F.col("_id").eqNullSafe(F.col("component_id")) & F.col("_h").eqNullSafe(F.col("first_h")))
    return out.select(F.col("_id").alias(doc_id), "n_shingles", F.when(alone, F.col("_id")).otherwise(F.col("component_id")).alias("component_id"), F.col("_h").alias("text_hash"), is_first.alias("is_first"))
