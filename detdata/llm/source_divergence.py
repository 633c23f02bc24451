"""Divergence of sources within a language, by a baseline-corrected inverted index over smoothed term shares.

A group is a (lang, source), its profile p(t) = 1 + floor(SCALE * (count + smooth) / (N + smooth * V)) over the V terms
that its language keeps; a term that a group lacks has one and the same share p0 there. The distance of two groups a and
b, the sum of |p_a - p_b| over all kept terms, is not walked term by term: each pair begins with V * |p0_a - p0_b|, what
it would be if neither group held a term, and only terms that a group holds change it:

    a term of a alone changes the pair by        |p_a(t) - p0_b| - |p0_a - p0_b|
    a term of both by that for a and that for b, less twice the length that the
    intervals [p0_a, p_a(t)] and [p0_b, p_b(t)] have in common

The first kind depends on t through p_a(t) alone, so a group gives it once per distinct share. The second is emitted from
a term's postings, for pairs with a common length only. All figures are whole numbers.
"""

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, written

SCALE = 1_000_000_000
#: Partial counts that a task holds before it hands them on, and bytes of text split at once.
HELD, SLICE = 300_000, 4 << 20
#: Parts into which the groups of one language are dealt, so that no language is one task.
SALTS = 32

# a byte of a term is a letter A-Z or part of a character beyond ASCII; capitals fold, all else parts terms
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _terms(text: bytes):
    """Lists of the terms of a text, of some MB of it each, cut where no term is."""
    text, at = text.translate(_TERM), 0
    while at < len(text):
        end = text.find(b" ", at + SLICE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term and documents with it, and per group a row with a null term
    and its documents. Tasks add up what they read before anything is shuffled; a language or source of any size gives
    a row per task and term."""
    src = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (lang, source)], F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))
    names = ["lang", "source", "term", "n", "docs"]

    def batch(groups: dict) -> pa.RecordBatch:
        rows = [(g, s, t, n, d) for (g, s), (counts, held, whole) in groups.items() for t, n, d in [(None, 0, whole), *((t, n, held[t]) for t, n in counts.items())]]
        columns = list(zip(*rows, strict=True))
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        out = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*out[:2], out[2].view(pa.string()), *out[3:]], names=names)

    def run(batches):
        groups, held = {}, 0
        for b in batches:
            for g, s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                counts, docs_of, whole = groups.setdefault((g, s), [Counter(), Counter(), 0])
                before, mine = len(counts), set()
                for part in _terms(t.as_py()):
                    counts.update(part)
                    mine.update(part)
                docs_of.update(mine)
                groups[g, s][2] = whole + 1
                held += len(counts) - before + 1
                if held > HELD:
                    yield batch(groups)
                    groups, held = {}, 0
        if groups:
            yield batch(groups)

    parts = src.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column, smooth: int) -> Column:
    """1 + floor(SCALE * (count + smooth) / (total + smooth * terms)), exact for counts of any size."""
    wide = lambda c: c.cast("decimal(20,0)")
    top = (wide(count) + F.lit(smooth).cast("decimal(9,0)")) * F.lit(SCALE).cast("decimal(10,0)")
    bottom = wide(total) + F.lit(smooth).cast("decimal(9,0)") * wide(terms).cast("decimal(18,0)")
    return F.call_function("div", top, bottom) + F.lit(1).cast("long")


def source_divergence(docs: DataFrame, min_docs: int = 30, smooth: int = 5, top: int = 50, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, part, item, value long, rank int). Part pair: each other source of the language (item) and its
    distance; all ranks. Part term: the group's terms of greater share than in the whole language, by the difference,
    up to rank `top`. Ranks run from 1 per group and part, value descending, item ascending by UTF-8.

    Terms are runs of letters A-Z, lower-cased, and characters beyond ASCII; a language keeps those in at least min_docs
    of its documents. A null text, lang or source reads as ''; a group without terms, or of a language that keeps none,
    has its pairs (of value 0 if none is kept) and no terms; a language with one source has no pairs; repeated rows
    count each; other columns are ignored; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    with scratch(spark):
        counts = written(term_counts(docs, lang, source, text), "term_counts")
        kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("_d")).where(F.col("_d") >= min_docs).drop("_d")
        # a term of a language is one key with a row per source: as many as the result has for each source, and no more
        postings = written(counts.where("term is not null").drop("docs").join(kept, ["lang", "term"]), "postings")
        langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("lang_n"))
        sums = postings.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
        groups = counts.where("term is null").select("lang", "source").join(langs, "lang", "left").join(sums, ["lang", "source"], "left").fillna(0, ["v", "lang_n", "group_n"])
        empty = F.when(F.col("v") > 0, share(F.lit(0), F.col("group_n"), F.col("v"), smooth)).otherwise(F.lit(0))
        groups = written(groups.withColumn("p0", empty), "groups")
        rows = postings.join(groups, ["lang", "source"]).select("lang", "source", "term", "p0", share(F.col("n"), F.col("group_n"), F.col("v"), smooth).alias("p"), share(F.col("all_n"), F.col("lang_n"), F.col("v"), smooth).alias("q"))
        rows = written(rows, "shares")

        pairs = _distances(groups, rows)
        both = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value")
        both = both.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
        ahead = rows.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        ranked = lambda x: x.withColumn("rank", F.row_number().over(order))
        return written(ranked(both).unionByName(ranked(ahead).where(F.col("rank") <= top)), "divergence", up=1)


def _distances(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """(lang, a, b, value) of all pairs of sources a < b of a language."""
    salt = lambda *c: F.pmod(F.xxhash64(*c), F.lit(SALTS))
    # the other group, once for each part into which the groups of its language are dealt
    other = groups.select("lang", F.col("source").alias("o"), F.col("p0").alias("o0"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_salt"))
    key = ["lang", "_salt"]
    base = groups.withColumn("_salt", salt("source")).join(other, key).where("source < o").select("lang", F.col("source").alias("a"), F.col("o").alias("b"), (F.col("v") * F.abs(F.col("p0") - F.col("o0"))).alias("value"))
    alike = rows.groupBy("lang", "source", "p0", "p").agg(F.count("*").alias("m")).withColumn("_salt", salt("source", "p"))
    change = F.abs(F.col("p") - F.col("o0")) - F.abs(F.col("p0") - F.col("o0"))
    alone = alike.join(other, key).where("source != o").select("lang", F.least("source", "o").alias("a"), F.greatest("source", "o").alias("b"), (F.col("m") * change).alias("value"))
    second = rows.select("lang", "term", F.col("source").alias("o"), F.col("p0").alias("o0"), F.col("p").alias("op"))
    common = F.least("p", "op") - F.greatest("p0", "o0")
    shared = rows.join(second, ["lang", "term"]).where((F.col("source") < F.col("o")) & (common > 0)).select("lang", F.col("source").alias("a"), F.col("o").alias("b"), (-2 * common).alias("value"))
    return base.unionByName(alone).unionByName(shared).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
