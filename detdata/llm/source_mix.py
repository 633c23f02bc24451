"""Mixing sources to target weights by pivotal dependent rounding. Built-in functions only.

Each document of source s is wanted target_s / size_s times. The whole part is taken outright; the rest is a
copy probability p < 1. Pivotal rounding makes the probabilities integral without changing the words a source
gives: of two documents with probabilities in (0, 1), mass p * size moves from one to the other, in a random
direction chosen so that both keep their expectation, until one is 0 or 1; the other goes on as the carrier.

A block is folded from its longest document to its shortest, so that the carrier that is left tends to be short.
The rounding runs as a reduction tree. A level deals a source's open documents into blocks of about BLOCK by
hash, folds each block with a higher-order function, writes the settled documents and passes one carrier per
block to the next level, until one block per source is left; its carrier is drawn by its own probability. So
a source misses its target by less than one document, no group is larger than a block, and the number of
levels is the logarithm of the largest source. All draws, and the keys that deal documents to blocks, are hashes of
what a row holds (id, text, source) and the seed, so the result does not depend on how the rows lie.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, written

#: Documents folded at once, on average.
BLOCK = 64
WEIGHTS = (3.0, 1.0, 2.0)
#: Share of all sizes that the mix holds, and the most copies of a source.
SHARE, CAP = 1.5, 2.0


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sizes(source, source_size), a row per source → with target double.

    Weights repeat over the sources by code point, null last. Targets are share of all sizes by weight; a source
    stops at cap times its size and the excess goes to the others by weight, again until none is above. The
    sources are ranked by the weight at which they stop, so this is one running sum over the source table.
    """
    w = Window.orderBy(F.col("source").isNull(), "source")
    n = (F.row_number().over(w) - 1) % len(weights)
    d = sizes.withColumn("_w", F.get(F.array(*[F.lit(float(x)) for x in weights]), n))
    d = d.withColumn("_cap", F.col("source_size") * F.lit(cap))
    total = Window.partitionBy()
    below = Window.orderBy("_level", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_level", F.col("_cap") / F.col("_w")).withColumn("_want", F.sum("source_size").over(total) * F.lit(share))
    d = d.withColumn("_full", F.coalesce(F.sum("_cap").over(below), F.lit(0.0))).withColumn("_open", F.sum("_w").over(total) - F.coalesce(F.sum("_w").over(below), F.lit(0.0)))
    # the level that is enough if all that stop earlier are full and the rest open; the true one is the greatest
    d = d.withColumn("_try", (F.col("_want") - F.col("_full")) / F.col("_open"))
    level = F.max("_try").over(total)
    return d.withColumn("target", F.least(F.col("_cap"), level * F.col("_w"))).select("source", "source_size", "target")


def _draw(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * F.lit(2.0**-53)


_ITEM = "struct<s: double, k: bigint, id: bigint, p: double>"
_DONE = "struct<k: bigint, id: bigint, x: double>"


def _fold(items: Column, seed: int) -> Column:
    """Settled rows (k, id, x) of a block and its carrier (p in (0, 1); null if none is left)."""
    acc = F.struct(F.lit(None).cast(_ITEM).alias("c"), F.array().cast(f"array<{_DONE}>").alias("out"))

    def settled(o, x):
        return F.array(F.struct(o["k"].alias("k"), o["id"].alias("id"), x.cast("double").alias("x")))

    def item(o, p):
        return F.struct(o["s"].alias("s"), o["k"].alias("k"), o["id"].alias("id"), p.cast("double").alias("p"))

    def step(a, b):
        c, none = a["c"], F.lit(None).cast(_ITEM)
        up = F.least((1.0 - c["p"]) * c["s"], b["p"] * b["s"])  # words that c can take from b
        down = F.least(c["p"] * c["s"], (1.0 - b["p"]) * b["s"])
        rise = _draw(c["k"], b["k"], F.lit(seed)) * (up + down) < down
        c_full = (1.0 - c["p"]) * c["s"] <= b["p"] * b["s"]  # rising, c is full first
        c_empty = c["p"] * c["s"] <= (1.0 - b["p"]) * b["s"]
        b_after_rise, c_after_rise = b["p"] - up / b["s"], c["p"] + up / c["s"]
        b_after_fall, c_after_fall = b["p"] + down / b["s"], c["p"] - down / c["s"]
        c_done = F.when(rise, c_full).otherwise(c_empty)
        rest = F.when(rise, F.when(c_full, b_after_rise).otherwise(c_after_rise)).otherwise(F.when(c_empty, b_after_fall).otherwise(c_after_fall))
        done = F.when(rise, F.when(c_full, 1.0).otherwise(0.0)).otherwise(F.when(c_empty, 0.0).otherwise(1.0))
        out = F.concat(a["out"], settled(F.when(c_done, c).otherwise(b), done))
        other = F.when(c_done, item(b, rest)).otherwise(item(c, rest))
        open_ = (rest > 1e-12) & (rest < 1 - 1e-12)
        both = F.when(open_, out).otherwise(F.concat(out, settled(other, F.round(rest))))
        return F.when(c.isNull(), F.struct(b.alias("c"), a["out"].alias("out"))).otherwise(F.struct(F.when(open_, other).otherwise(none).alias("c"), both.alias("out")))

    return F.aggregate(items, acc, step)


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 17) -> DataFrame:
    """For each row of docs: doc_id, source, size (words), source_size, target, copies, taken (copies * size), and
    text_hash, xxhash64 of the text.

    copies is the whole part of target / source_size or one more. A null text has size 0 and is never taken; a
    null source is a source of its own, ranked last; rows with equal id, text and source are separate documents,
    numbered among themselves; other columns are ignored; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col(doc_id).alias("_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), F.xxhash64(text).alias("_h"))
    # equal rows are counted, then numbered, so that a row's keys follow from what it holds
    equal = sized.groupBy("_id", "source", "size", "_h").agg(F.count("*").alias("_m"))
    each = equal.select("_id", "source", "size", "_h", F.explode(F.sequence(F.lit(1).cast("long"), "_m")).alias("_i"))
    key = lambda salt: F.xxhash64(F.lit(salt), F.col("_id").isNull(), "_id", "_h", F.col("source").isNull(), "source", "_i", F.lit(seed))
    rows = written(each.select("*", key(1).alias("_k"), key(2).alias("_k2")), "sizes")
    wanted = written(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap), "targets")
    joined = rows.join(wanted.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = joined.withColumn("_whole", F.floor(ratio + 1e-9)).withColumn("_p", F.greatest(ratio - F.col("_whole"), F.lit(0.0)))

    start = joined.where((F.col("_p") > 1e-9) & (F.col("size") > 0)).select(F.xxhash64("source", F.col("source").isNull()).alias("g"), F.struct(F.col("size").cast("double").alias("s"), F.col("_k").alias("k"), F.col("_k2").alias("id"), F.col("_p").alias("p")).alias("c"))
    level, left, done = 0, written(start, "open"), []
    while True:
        per = left.groupBy("g").agg(F.count("*").alias("n"))
        most = per.agg(F.max("n")).first()[0]
        if not most:
            break
        last = most <= 4 * BLOCK
        blocks = F.lit(1) if last else F.greatest(F.ceil(F.col("n") / BLOCK), F.lit(1))
        dealt = left.join(per, "g").select("g", "c", F.pmod(F.xxhash64(F.col("c.id"), F.col("c.k"), F.lit(level)), blocks).alias("b"))
        folded = dealt.groupBy("g", "b").agg(F.sort_array(F.collect_list("c"), asc=False).alias("cs")).select("g", _fold(F.col("cs"), seed + level).alias("f"))
        folded = written(folded.select("g", F.col("f.c").alias("c"), F.col("f.out").alias("out")), "folded")
        done.append(folded.select(F.explode("out").alias("o")).select("o.k", "o.id", "o.x"))
        left = folded.where("c is not null").select("g", "c")
        level += 1
        if last:
            done.append(left.select("c.k", "c.id", F.when(_draw(F.col("c.id"), F.lit(-seed)) < F.col("c.p"), 1.0).otherwise(0.0).alias("x")))
            break
    extra = spark.createDataFrame([], "k long, id long, x double")
    for d in done:
        extra = extra.unionByName(d)
    out = joined.join(extra, (F.col("_k") == F.col("k")) & (F.col("_k2") == F.col("id")), "left")
    copies = (F.col("_whole") + F.coalesce("x", F.lit(0.0))).cast("long")
    return out.select(F.col("_id").alias(doc_id), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), F.col("_h").alias("text_hash"))
