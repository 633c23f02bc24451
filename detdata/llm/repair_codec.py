"""Token ids in a binary file format, compressed by Re-Pair per shard.

Documents are encoded in ascending id order and dealt into shards of about SHARD ids. In a shard, frequent
pairs of neighbouring symbols are replaced by nonterminals, round after round. A rule takes three words of the file (two
symbols and a length) and saves one a place; compressed as the file is, pairs in fewer than LEAST places make it longer
(measured). The rounds end when a round's rules save less than a share GAIN of the symbols. A round takes all pairs at
least 1 / DROP as frequent as the most frequent one; where replacements overlap, the left one wins, and a pair that
then keeps fewer than LEAST places waits for a later round. No pair crosses a document's end, so a document is a run
of symbols.

A shard is a row of a Parquet table (Spark's own writer commits it, so a lost executor costs only its tasks):

    part, shard       order of the shards
    inside            ids of the part's earlier shards
    doc_ids           ids of its documents
    doc_tokens        token ids of each, the end id included
    doc_symbols       symbols of each
    base              the first nonterminal
    rules             pairs of symbols, little-endian unsigned 32-bit; rule r is the nonterminal base + r
    rule_lengths      ids that each rule expands to, little-endian unsigned 32-bit
    symbols           the compressed sequence, little-endian unsigned 32-bit
    n_tokens          ids of the shard

With doc_symbols and rule_lengths, any range of any document is decoded by expanding only the symbols that
hold it (token_range).
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, new_path
from .pieces import encoder

SHARD = 1 << 20
LEAST, DROP, GAIN = 8, 16, 1e-2


def _sorted_pairs(seq: np.ndarray, end: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, places) of all neighbouring symbols of one document, in order. Symbols are below base."""
    bits, shift = (base - 1).bit_length(), len(seq).bit_length()
    left, right = seq[:-1].astype(np.uint64), seq[1:].astype(np.uint64)
    last = np.flatnonzero(end[:-1])
    if 2 * bits + shift > 64:
        pair = (left << np.uint64(32)) | right
        at = np.argsort(pair, kind="stable")
        at = at[~end[at]]
        return pair[at], at
    # pair and place in one number: numpy sorts plain numbers many times as fast as it sorts places by a key
    left <<= np.uint64(bits)
    left |= right
    left <<= np.uint64(shift)
    left |= np.arange(len(left), dtype=np.uint64)
    left[last] = np.iinfo(np.uint64).max
    left.sort()
    left = left[: len(left) - len(last)]
    return left >> np.uint64(shift), (left & np.uint64((1 << shift) - 1)).view(np.int64)


def _replaced(seq: np.ndarray, end: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, pair numbers) of a round's pairs without overlaps; a pair that keeps too few places is left out."""
    none = np.zeros(0, np.int64)
    pair, at = _sorted_pairs(seq, end, base)
    if not len(pair):
        return none, none
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    count = np.diff(np.append(first, len(pair)))
    most = int(count.max())
    if most < LEAST:
        return none, none
    chosen = np.flatnonzero((count >= LEAST) & (count * DROP >= most))
    first, count = first[chosen], count[chosen]
    ends = np.cumsum(count)
    number = np.full(len(seq), -1, np.int32)
    number[at[np.arange(ends[-1]) + np.repeat(first - (ends - count), count)]] = np.repeat(np.arange(len(chosen), dtype=np.int32), count)
    at = np.flatnonzero(number >= 0)
    run = np.flatnonzero(np.append(True, np.diff(at) > 1))
    at = at[((np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) & 1) == 0]
    which = number[at]
    stay = (np.bincount(which, minlength=len(chosen)) >= LEAST)[which]
    return at[stay], which[stay]


def compress(seq: np.ndarray, end: np.ndarray, base: int):
    """(symbols, end, rules): seq with frequent pairs replaced; end marks the last symbol of each document."""
    rules = []
    while len(seq) > 1:
        places, which = _replaced(seq, end, base + len(rules))
        used = np.flatnonzero(np.bincount(which))
        if not len(used) or len(places) - 3 * len(used) < GAIN * len(seq):
            break
        name = np.zeros(used[-1] + 1, np.int64)
        name[used] = np.arange(len(used))
        number = name[which]
        first = np.zeros(len(used), np.int64)
        first[number] = places
        number += base + len(rules)
        rules.extend(zip(seq[first].tolist(), seq[first + 1].tolist(), strict=True))
        keep = np.ones(len(seq), dtype=bool)
        keep[places + 1] = False
        seq, end = seq.copy(), end.copy()
        seq[places] = number
        end[places] |= end[places + 1]
        seq, end = seq[keep], end[keep]
    return seq, end, rules


def expansions(rules: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rules one after another, and where each begins (and the end)."""
    flat, size = rules.astype(np.uint32).ravel(), np.full(len(rules), 2, np.int64)
    big = np.flatnonzero(flat >= base)
    # all rules at once, a level of rules within rules in each step
    while len(big):
        lens = np.ones(len(flat), np.int64)
        lens[big] = 2
        to, inner = np.cumsum(lens), rules[flat[big] - base]
        size = np.add.reduceat(lens, np.append(0, np.cumsum(size)[:-1]))
        flat = np.repeat(flat, lens)
        flat[to[big] - 2], flat[to[big] - 1] = inner[:, 0], inner[:, 1]
        big = np.flatnonzero(flat >= base)
    return flat, np.append(0, np.cumsum(size))


def expand(symbols: np.ndarray, base: int, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ids of a run of symbols."""
    big = symbols >= base
    which = np.where(big, symbols.astype(np.int64) - base, 0)
    lens = np.where(big, (at[1:] - at[:-1])[which], 1) if len(at) > 1 else np.ones(len(symbols), np.int64)
    ends = np.cumsum(lens)
    if not len(ends):
        return np.zeros(0, np.uint32)
    # plain symbols stand behind the expansions
    pool = np.concatenate([flat, symbols[~big].astype(np.uint32)])
    src = np.empty(len(symbols), np.int64)
    src[big] = at[which[big]]
    src[~big] = len(flat) + np.arange(int((~big).sum()))
    return pool[np.arange(ends[-1]) + np.repeat(src - (ends - lens), lens)]


def token_range(shard: dict, doc: int, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of the shard's doc-th document; only the symbols that hold them are expanded."""
    base, first = shard["base"], int(np.sum(shard["doc_symbols"][:doc], dtype=np.int64))
    symbols = np.frombuffer(shard["symbols"], "<u4")[first : first + shard["doc_symbols"][doc]]
    lengths, rules = np.frombuffer(shard["rule_lengths"], "<u4").astype(np.int64), np.frombuffer(shard["rules"], "<u4").reshape(-1, 2)
    size = np.ones(len(symbols), np.int64)
    size[symbols >= base] = lengths[symbols[symbols >= base].astype(np.int64) - base]
    ends = np.cumsum(size)
    i, j = int(np.searchsorted(ends, start, side="right")), int(np.searchsorted(ends, stop, side="left")) + 1
    out: list[int] = []
    stack = symbols[i:j][::-1].tolist()
    while stack:
        x = stack.pop()
        if x < base:
            out.append(x)
        else:
            stack += [int(rules[x - base][1]), int(rules[x - base][0])]
    skip = start - (int(ends[i - 1]) if i else 0)
    return np.array(out[skip : skip + stop - start], np.uint32)


def _shards(tokenizer: str, end_id: int, id_type: pa.DataType, size: int):
    names = ["part", "shard", "inside", "doc_ids", "doc_tokens", "doc_symbols", "base", "rules", "rule_lengths", "symbols", "n_tokens"]

    def row(part, shard, inside, ids, tokens, seq, base):
        n = np.array(tokens, np.int64)
        end = np.zeros(len(seq), dtype=bool)
        end[np.cumsum(n) - 1] = True
        out, ends, rules = compress(seq, end, base)
        pairs = np.array(rules, "<u4").reshape(-1, 2)
        length = np.ones(base + len(rules), np.int64)
        for r, (a, b) in enumerate(rules):
            length[base + r] = length[a] + length[b]
        symbols = np.diff(np.append(-1, np.flatnonzero(ends)))
        values = [[part], [shard], [inside], [ids], [n], [symbols], [base], [pairs.tobytes()], [length[base:].astype("<u4").tobytes()], [out.astype("<u4").tobytes()], [len(seq)]]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=names)

    def run(batches):
        enc = encoder(tokenizer)
        part, shard, inside, ids, tokens, held, total = TaskContext.get().partitionId(), 0, 0, [], [], [], 0
        for b in batches:
            keys = b.column(0).to_pylist()
            for first, flat, at in enc.batch(b.column(1)):
                n = np.diff(at)
                # each document's ids and the end id
                rows = np.full(len(flat) + len(n), end_id, np.int64)
                rows[np.arange(len(flat)) + np.repeat(np.arange(len(n)), n)] = flat
                ends = np.cumsum(n + 1)
                i = 0
                while i < len(n):
                    before = int(ends[i - 1]) if i else 0
                    j = max(i + 1, int(np.searchsorted(ends, before + size - total, side="right")))
                    ids += keys[first + i : first + j]
                    tokens += (n[i:j] + 1).tolist()
                    held.append(rows[before : ends[j - 1]])
                    total += int(ends[j - 1]) - before
                    i = j
                    if total >= size or i < len(n):
                        yield row(part, shard, inside, ids, tokens, np.concatenate(held), enc.size)
                        shard, inside, ids, tokens, held, total = shard + 1, inside + total, [], [], [], 0
        if ids:
            yield row(part, shard, inside, ids, tokens, np.concatenate(held), enc.size)

    return run


def write_shards(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, size: int = SHARD) -> None:
    """Encodes every whole text (null: empty), adds end_id to each and writes the shards to path, in ascending
    order of doc_id (null first; equal ids by text). Other columns are ignored; an empty table writes none."""
    src = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kind = src.schema["_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    ordered = src.repartitionByRange(F.col("_id").asc_nulls_first()).sortWithinPartitions(F.col("_id").asc_nulls_first(), "_text")
    schema = f"part int, shard int, inside long, doc_ids array<{kind.simpleString()}>, doc_tokens array<long>, doc_symbols array<long>, base int, rules binary, rule_lengths binary, symbols binary, n_tokens long"
    ordered.mapInArrow(lean(_shards(tokenizer, end_id, to_arrow_type(kind), size)), schema).write.option("compression", "zstd").parquet(path)


def read_shards(spark, path: str) -> DataFrame:
    """The shards with start, the ids before each. Only the parts' sums are broadcast: a row for each range
    partition that wrote, whatever the data's size."""
    shards = spark.read.parquet(path)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("_before"))
    return shards.join(F.broadcast(before), "part").withColumn("start", F.col("_before") + F.col("inside")).drop("_before")


def decoded(shards: DataFrame, doc_id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, decoded from the shards."""
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    cols = ["doc_ids", "doc_tokens", "base", "rules", "symbols", "start"]

    def run(batches):
        for b in batches:
            for r in b.to_batches(max_chunksize=1) if isinstance(b, pa.Table) else (b.slice(i, 1) for i in range(b.num_rows)):
                base = r.column(2)[0].as_py()
                flat, at = expansions(np.frombuffer(r.column(3)[0].as_buffer(), "<u4").reshape(-1, 2), base)
                ids = expand(np.frombuffer(r.column(4)[0].as_buffer(), "<u4"), base, flat, at).astype("<u4")
                n = r.column(1)[0].values.to_numpy()
                ends = np.cumsum(n)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                out = [r.column(0)[0].values, pa.array(r.column(5)[0].as_py() + ends - n), pa.array(n), pa.array(crc, pa.int64())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    out = shards.select(*cols).mapInArrow(lean(run), f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    return out.withColumnRenamed("doc_id", doc_id)


def encode(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Writes docs to shards (at path, or in the shared folder) and returns what decoding them gives."""
    path = path or new_path(docs.sparkSession, "token-shards")
    write_shards(docs, path, tokenizer, doc_id, text)
    return decoded(read_shards(docs.sparkSession, path), doc_id)
