"""Language identification by bit-sliced Bloom filters of character n-grams.

A language's n-grams are those of its words (with a mark at both ends of a word, none across words) that are about as
usual in it as in any other language. All languages share one Bloom filter whose places hold not a bit but a mask with a
bit per language: setting an n-gram of a language sets that bit at each of its places, and the masks at an n-gram's
places, taken together with AND, name at once all languages that hold it. A text is put to the filter n-gram by n-gram;
the bits of the answers are counted per language, the counts freed of what a filter as full as that language's lets pass
by chance, and the greatest share decides.

Learning reads all labelled rows: tasks count documents per language and n-gram, Spark adds the counts up, and the masks
are put together by place. Only the filter, of a size fixed by parameters, reaches the driver and goes out to the tasks.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, written
from .hashing import mix

UNKNOWN = "und"
#: Characters of text that are taken apart at once, and documents at most: their number takes 14 bits beside a hash of 50.
SLICE, SLICE_DOCS, HASH_BITS = 1 << 19, 1 << 14, 50
#: Counts that a task holds before it adds them up or hands them on.
HELD = 2_000_000
#: Letters in an n-gram, marks of words' ends among them.
SIZES = (1, 2, 3)

_ROLL = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Model:
    """languages, those of most documents first; masks (2**bits places, bytes of 8 languages); chance per language that
    the filter answers for an n-gram that it lacks."""

    languages: list[str]
    masks: np.ndarray
    chance: np.ndarray
    sizes: tuple[int, ...]
    hashes: int


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def places(found: np.ndarray, hashes: int, bits: int) -> Iterator[np.ndarray]:
    """The places of each n-gram in a filter of 2**bits, one array for each hash."""
    one, step = found & np.uint64((1 << bits) - 1), (found >> np.uint64(HASH_BITS - bits)) | np.uint64(1)
    for _ in range(hashes):
        yield one.astype(np.int64)
        one = (one + step) & np.uint64((1 << bits) - 1)


def grams(texts: list[str], sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (HASH_BITS bits) of the n-grams of lower-cased texts, and the text each one is of."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(low)), np.fromiter((len(t) + 1 for t in low), np.int64, len(low)))
    letter = _letters()[codes]
    # one mark for all that stands between two words, and one before the first
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    at = np.flatnonzero(keep)
    inside = letter[at]
    codes, owner = np.where(inside, codes[at], 0).astype(np.uint64), owner[at]
    if inside[0]:
        codes, owner, inside = (np.concatenate([[x], y]) for x, y in ((np.uint64(0), codes), (owner[0], owner), (False, inside)))
    found, of = [], []
    rolled, whole = codes, inside  # hash of the n from here on; whether no mark is among them but the first and last
    for n in range(1, max(sizes) + 1):
        if n > 1:
            rolled = rolled[:-1] * _ROLL + codes[n - 1 :]
            whole = inside[:-1] | inside[1:] if n == 2 else inside[1:-1] if n == 3 else whole[:-1] & inside[n - 2 : -1]
        if n in sizes and len(rolled):
            at = np.flatnonzero(whole)
            found.append(mix(rolled[at], n) >> np.uint64(64 - HASH_BITS))
            of.append(owner[at + n // 2])
    return (np.concatenate(found), np.concatenate(of)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _slices(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """First rows and texts of runs of rows of a bounded size, one row at least; null reads as empty."""
    at, held, size = 0, [], 0
    for i in range(len(column)):
        t = column[i].as_py() or ""
        if held and (size + len(t) > SLICE or len(held) == SLICE_DOCS):
            yield at, held
            at, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield at, held


def _parts(texts: list[str], sizes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """grams() of a slice; of a very long text piece by piece, cut where a word ends if one does within a piece."""
    if len(texts) > 1 or len(texts[0]) <= 2 * SLICE:
        yield grams(texts, sizes)
        return
    text, at = texts[0], 0
    while at < len(text):
        end = min(at + SLICE, len(text))
        while end < len(text) and end - at < 2 * SLICE and text[end].isalpha():
            end += 1
        yield grams([text[at:end]], sizes)
        at = end


def _count(texts: list[str], langs: list[str], sizes: tuple[int, ...]) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
    """(language, its documents with a letter, n-grams, documents with each) of a slice."""
    low = np.uint64((1 << HASH_BITS) - 1)
    # an n-gram counts once a document, also in one that comes in pieces
    seen = [np.unique((of.astype(np.uint64) << np.uint64(HASH_BITS)) | found) for found, of in _parts(texts, sizes)]
    seen = seen[0] if len(seen) == 1 else np.unique(np.concatenate(seen))
    names = sorted(set(langs))
    number = np.array([names.index(x) for x in langs] if len(names) < 8 else [{n: i for i, n in enumerate(names)}[x] for x in langs], np.uint64)
    owner = (seen >> np.uint64(HASH_BITS)).astype(np.int64)
    lettered = np.bincount(number[np.unique(owner)].astype(np.int64), minlength=len(names))
    both, docs = np.unique((number[owner] << np.uint64(HASH_BITS)) | (seen & low), return_counts=True)
    edges = np.searchsorted(both >> np.uint64(HASH_BITS), np.arange(len(names) + 1, dtype=np.uint64))
    for i, name in enumerate(names):
        if lettered[i]:
            yield name, int(lettered[i]), both[edges[i] : edges[i + 1]] & low, docs[edges[i] : edges[i + 1]]


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    found, n = np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts])
    order = np.argsort(found, kind="stable")
    found, n = found[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
    return found[first], np.add.reduceat(n, first) if len(found) else n


def gram_counts(docs: DataFrame, lang: str = "lang", text: str = "text", sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """(lang, gram, docs): documents of a language with an n-gram; gram null: all its documents with a letter. Rows
    without language or text are left out. Tasks add up what they read before anything is shuffled."""
    src = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("_lang"), F.col(text).alias("_text"))

    def batches_of(held: dict):
        for name, (whole, parts) in held.items():
            found, n = _added(parts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(n) + 1), pa.string()), pa.array([None, *found.astype(np.int64).tolist()], pa.int64()), pa.array(np.concatenate([[whole], n]).astype(np.int64))], names=["lang", "gram", "docs"])

    def run(batches):
        held, size = {}, 0
        for b in batches:
            langs = b.column(0).to_pylist()
            for at, texts in _slices(b.column(1)):
                for name, whole, found, n in _count(texts, langs[at : at + len(texts)], sizes):
                    mine = held.setdefault(name, [0, []])
                    mine[0] += whole
                    mine[1].append((found, n))
                    size += len(n)
                if size > HELD:
                    held = {name: [whole, [_added(parts)]] for name, (whole, parts) in held.items()}
                    size = sum(len(parts[0][0]) for _, parts in held.values())
                    if size > HELD // 2:
                        yield from batches_of(held)
                        held, size = {}, 0
        yield from batches_of(held)

    return src.mapInArrow(run, "lang string, gram long, docs long").groupBy("lang", "gram").agg(F.sum("docs").alias("docs"))


def learn(docs: DataFrame, lang: str = "lang", text: str = "text", sizes: tuple[int, ...] = SIZES, share: float = 0.5, least: int = 2, most: int = 1 << 16, bits: int = 20, hashes: int = 4) -> Model:
    """The filter of all rows of docs that have a language and a text with a letter.

    A language holds an n-gram that at least `least` of its documents have, if the part of its documents that have it is
    `share` or more of that part in the language where it is greatest; of these the `most` that most of its documents
    have, ties by hash. The filter has 2**bits places, so its size is 2**bits bytes per 8 languages.
    """
    if bits > HASH_BITS - 20:
        raise ValueError(f"bits up to {HASH_BITS - 20}")
    spark = docs.sparkSession
    with scratch(spark):
        counts = written(gram_counts(docs, lang, text, sizes), "gram_counts")
        whole = counts.where("gram is null").select("lang", F.col("docs").alias("whole"))
        languages = [r["lang"] for r in whole.orderBy(F.desc("whole"), "lang").collect()]  # a name for each language
        if not languages:
            return Model([], np.zeros((0, 0), np.uint8), np.zeros(0), sizes, hashes)
        numbers = spark.createDataFrame([(x, i) for i, x in enumerate(languages)], "lang string, number int")
        rates = counts.where(F.col("gram").isNotNull() & (F.col("docs") >= least)).join(whole.join(numbers, "lang"), "lang").withColumn("rate", F.col("docs") / F.col("whole"))
        usual = rates.withColumn("best", F.max("rate").over(Window.partitionBy("gram"))).where(F.col("rate") >= share * F.col("best"))
        order = Window.partitionBy("number").orderBy(F.desc("docs"), "gram")
        held = usual.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).select("number", "gram")

        def place(batches):
            for b in batches:
                number, found = b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.uint64)
                for at in places(found, hashes, bits):
                    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(number // 8), pa.array((1 << (number % 8)).astype(np.int32))], names=["place", "byte", "mask"])

        set_ = held.mapInArrow(place, "place int, byte int, mask int").groupBy("place", "byte").agg(F.bit_or("mask").alias("mask")).toArrow()  # at most the filter
    masks = np.zeros((1 << bits, -(-len(languages) // 8)), np.uint8)
    masks[set_["place"].to_numpy(), set_["byte"].to_numpy()] = set_["mask"].to_numpy()
    full = np.array([(masks[:, i // 8] >> (i % 8) & 1).mean() for i in range(len(languages))])
    return Model(languages, masks, full**hashes, sizes, hashes)


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def hits(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Per text: its n-grams, and those that the filter has for each language."""
    bits, n = int(model.masks.shape[0]).bit_length() - 1, len(texts)
    total, out = np.zeros(n, np.int64), np.zeros((n, model.masks.shape[1] * 8), np.int64)
    for found, of in _parts(texts, model.sizes):
        total += np.bincount(of, minlength=n)
        mask = None
        for at in places(found, model.hashes, bits):
            mask = model.masks[at] if mask is None else mask & model.masks[at]
        for byte in range(mask.shape[1]):  # how often each of the 256 answers came, then its bits
            out[:, byte * 8 : byte * 8 + 8] += np.bincount(of * 256 + mask[:, byte], minlength=n * 256).reshape(n, 256) @ _BITS
    return total, out[:, : len(model.languages)]


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for each row of docs, from its whole text alone: the language with the greatest share
    of the text's n-grams, freed of chance answers, and that share (0 to 1); of equals the one learned from most
    documents.

    A text that is null or has no letter, and any text if no language was learned, gives `und` and 0.0; a text with none
    of the n-grams the most usual language and 0.0. Repeated rows give repeated results; other columns are ignored; an
    empty table gives an empty one. Rows stay where they are read: there is no shuffle.
    """
    src = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()
    names = pa.array([*model.languages, UNKNOWN], pa.string())

    def run(batches):
        for b in batches:
            for at, texts in _slices(b.column(1)):
                if not model.languages:
                    best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
                else:
                    total, found = hits(model, texts)
                    each = np.clip((found / np.maximum(total, 1)[:, None] - model.chance) / np.maximum(1 - model.chance, 1e-9), 0.0, 1.0)
                    best, score = each.argmax(axis=1), each.max(axis=1)
                    best[total == 0], score[total == 0] = len(model.languages), 0.0
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), names.take(pa.array(best)), pa.array(score)], names=["_id", "lang_pred", "score"])

    return src.mapInArrow(run, f"_id {kind}, lang_pred string, score double").withColumnRenamed("_id", doc_id)


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text, modulo parts; a null id reads as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def identify_held_out(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **settings) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the rows that are not held out, told for all."""
    own = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    model = learn(own.where(~held_out(F.col("_id"))), "_lang", "_text", **settings)
    out = identify(own, model, "_id", "_text")
    return out.select(F.col("_id").alias(doc_id), held_out(F.col("_id")).alias("held_out"), "lang_pred", "score")
