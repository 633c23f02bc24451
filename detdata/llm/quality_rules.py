"""Quality rules over whole texts, with lines that many documents of a host share taken out first.

Built-in functions only. Per document: word and character counts, repeated 3-word windows, repeated lines.
Across documents: each line with a word is normalised (lower-cased, stripped, runs of digits as 0) and hashed; per host, the distinct documents that hold it are counted; lines above a limit are
boilerplate, and a document that keeps too small a share of its words without them is depleted.

Copies of one text share lines that are no boilerplate. So documents are told apart by a signature of the whole
text, the hash of its sorted distinct normalised lines: documents with the same set of lines count once, all
others, near copies included, one each.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, WORD_RE, scratch, without, words, written

SYMBOL_RE = r"[#*$%&|<>]"
#: A line in more distinct documents of its host than this is boilerplate.
MAX_DOCS_PER_HOST = 20
#: A document must keep this share of its words.
MIN_KEPT_SHARE = 0.3


def _lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _covered(positions: Column, size: int) -> Column:
    """Words covered by windows of the given size at these sorted positions."""
    n = F.size(positions)
    gaps = F.zip_with(F.slice(positions, 2, F.greatest(n - 1, F.lit(0))), F.slice(positions, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(size).cast("long")))
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(F.aggregate(gaps, F.lit(size).cast("long"), lambda acc, x: acc + x))


def base_features(docs: DataFrame, text: str, carry: list[Column]) -> DataFrame:
    """The carried columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    d = docs.select(*carry, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    keep = d.columns[:-1]
    d = d.select(*keep, "_t", words(F.col("_t")).alias("_w"))
    d = d.select(*keep, "_t", "_w", F.size("_w").alias("_n"))
    # one hash for each window of three words; packed with its position, so that one sort of longs groups them.
    # A position takes as many bits as the text's length needs, the hash's upper bits have the rest
    windows = F.when(F.col("_n") >= 3, F.transform(F.sequence(F.lit(0), F.col("_n") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))).otherwise(F.array().cast("array<long>"))
    d = d.select(*keep, "_t", "_n", F.length(F.array_join("_w", "")).alias("_c"), windows.alias("_wh"), F.length(F.bin(F.col("_n"))).alias("_b"))
    d = d.select("*", (F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_b")) - 1).alias("_mask"))
    # most texts repeat no window: they are spared the sort
    packed = F.when(F.size(F.array_distinct("_wh")) < F.size("_wh"), F.sort_array(F.transform("_wh", lambda h, i: h.bitwiseAND(F.bitwise_not("_mask")).bitwiseOR(i.cast("long")))))
    d = d.select(*keep, "_t", "_n", "_c", "_wh", "_b", "_mask", packed.alias("_p"))
    at = lambda x: x.bitwiseAND(F.col("_mask")).cast("int")
    top = lambda x: F.call_function("shiftright", x, F.col("_b"))
    same = lambda a, b: F.coalesce((top(a) == top(b)) & (F.get("_wh", at(a)) == F.get("_wh", at(b))), F.lit(False))
    twice = F.filter("_p", lambda x, i: (i > 0) & same(x, F.get("_p", i - 1)) | same(x, F.get("_p", i + 1)))
    d = d.select(*keep, "_t", "_n", "_c", F.coalesce(F.sort_array(F.transform(twice, lambda x: at(x).cast("long"))), F.array().cast("array<long>")).alias("_r"))
    d = d.select(*keep, "_t", "_n", "_c", _covered(F.col("_r"), 3).alias("n_repeat_words"), _lines(F.col("_t")).alias("_l"))
    return d.select(
        *keep,
        F.col("_n").cast("long").alias("n_words"),
        F.col("_c").cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOL_RE)).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
    )


def _base_failed(min_words: int) -> Column:
    return (F.col("n_words") < min_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


def _line_rows(docs: DataFrame, text: str, host: str, carry: list[Column]) -> DataFrame:
    """(carried, _host, _pos, _line, _words, _all, _doc): a row for each line with a word; _all are the text's words,
    _doc is the signature of the document's distinct lines."""
    norm = lambda x: F.regexp_replace(F.lower(F.btrim(x, F.lit(SPACE_CHARS))), "[0-9]+", "0")
    lines = F.transform(_lines(F.coalesce(F.col(text), F.lit(""))), lambda x: F.struct(F.xxhash64(norm(x)).alias("h"), F.regexp_count(x, F.lit(WORD_RE)).cast("long").alias("w")))
    d = docs.select(*carry, _host(host).alias("_host"), lines.alias("_ls"))
    d = d.select("*", F.aggregate("_ls", F.lit(0).cast("long"), lambda a, x: a + x["w"]).alias("_all"), F.xxhash64(F.sort_array(F.array_distinct(F.transform("_ls", lambda x: x["h"])))).alias("_doc"))
    keep = [c for c in d.columns if c not in ("_ls", "_doc")]
    d = d.select(*keep, "_doc", F.posexplode("_ls").alias("_pos", "_x"))
    return d.select(*keep, "_pos", F.col("_x.h").alias("_line"), F.col("_x.w").alias("_words"), "_doc")


def _host(host: str) -> Column:
    """A null host is a host of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit(""))


def common_lines(rows: DataFrame, max_docs: int) -> DataFrame:
    """(_host, _line, n_docs) of lines in more than max_docs distinct documents of the host. The rows are
    made distinct by (host, line, document) first, so a line that a third of all rows hold is spread by document."""
    each = rows.select("_host", "_line", "_doc").distinct()
    return each.groupBy("_host", "_line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > max_docs)


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_docs: int = MAX_DOCS_PER_HOST, min_share: float = MIN_KEPT_SHARE, min_words: int = 50) -> DataFrame:
    """For each row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_boilerplate_words, base_failed (under min_words, or more than half the words repeat), kept.

    kept is false if base_failed or if boilerplate leaves less than min_share of the words. A null text is
    empty and fails; a null host is a host of its own; rows with equal id, host and text get equal results;
    other columns are ignored; an empty table gives an empty one.
    """
    with scratch(docs.sparkSession):
        return written(_judged(docs, doc_id, text, host, max_docs, min_share, min_words), "quality", up=1)


def _judged(docs: DataFrame, doc_id: str, text: str, host: str, max_docs: int, min_share: float, min_words: int) -> DataFrame:
    ident = [F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_h")]
    # written, so that a later filter on the result is not pushed into, and copied all over, these expressions
    base = written(base_features(docs, text, [*ident, _host(host).alias("_host")]), "text_features")
    removed = _removed(docs, text, host, ident, max_docs)
    removed = removed.select(F.col("_id").alias("_id2"), F.col("_h").alias("_h2"), F.col("_host").alias("_host2"), "_gone")
    out = base.join(removed, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_h") == F.col("_h2")) & (F.col("_host") == F.col("_host2")), "left")
    gone = F.least(F.coalesce("_gone", F.lit(0)), F.col("n_words"))
    failed = _base_failed(min_words)
    return out.select(F.col("_id").alias(doc_id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", gone.cast("long").alias("n_boilerplate_words"), failed.alias("base_failed"), (~failed & _rich(gone, F.col("n_words"), min_share)).alias("kept"))


def _rich(gone: Column, n: Column, min_share: float) -> Column:
    """Enough is left."""
    return (n - gone) >= n * min_share


def _removed(docs: DataFrame, text: str, host: str, ident: list[Column], max_docs: int) -> DataFrame:
    """(_id, _h, _host, _gone, _all): words in boilerplate lines, and words, of rows with such lines."""
    rows = written(_line_rows(docs, text, host, ident), "line_rows")
    common = written(common_lines(rows, max_docs), "common_lines")
    hit = rows.join(common.select("_host", "_line"), ["_host", "_line"])
    # by position first: a repeated row must not count a line twice
    per = hit.groupBy("_id", "_h", "_host", "_pos").agg(F.max("_words").alias("w"), F.max("_all").alias("_all"))
    return per.groupBy("_id", "_h", "_host").agg(F.sum("w").alias("_gone"), F.max("_all").alias("_all"))


def kept_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_docs: int = MAX_DOCS_PER_HOST, min_share: float = MIN_KEPT_SHARE, min_words: int = 50) -> DataFrame:
    """The rows of docs that quality_rules keeps, all columns as they are.

    The base rules filter rows where they are read. Only the table of depleted rows, those that boilerplate leaves
    too little of, is joined to the texts, and only texts that may be in it are shuffled.
    """
    with scratch(docs.sparkSession):
        ident = [F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_h")]
        gone = _removed(docs, text, host, ident, max_docs)
        depleted = written(gone.where(~_rich(F.col("_gone"), F.col("_all"), min_share)).select("_id", "_h", "_host"), "depleted", up=1)
    rest = without(docs, {"_id": F.col(doc_id), "_h": F.xxhash64(text), "_host": _host(host)}, depleted)
    whole = rest.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).alias("_text"))
    judged = base_features(whole, "_text", [F.col("_row")])
    # a generator stands between the features and the filter, which would else be copied into their expressions
    return judged.select("_row", F.explode(F.array(_base_failed(min_words))).alias("_failed")).where("not _failed").select("_row.*")
