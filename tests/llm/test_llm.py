"""Operators against brute force on small fixtures, and their defined edge cases."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from detdata.llm import decontam, html_template, line_dedup, ordinal_quality, repair_codec, token_spans, url_trust
from detdata.llm.components import components
from detdata.llm.quality_rules import quality_rules
from detdata.llm.queries import tokenizer_path
from detdata.llm.shingle_join import similar_components
from detdata.llm.source_mix import mix_sources, targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words int, target string, host string, size int"
UP = str.maketrans("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
VOCAB = ["".join(random.Random(i).choices("abcdeé", k=4)) for i in range(300)]


def table(spark, rows):
    """rows (doc_id, text, source), with extra columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 1, "y", "z", 2) for i, t, s in rows], SCHEMA)


EDGES = [(1, None, "a"), (2, "", None), (3, " \n\t ", "a"), (None, "one two", None), (4, "one two", "a"), (4, "one two", "a"), (5, "Ünï 日本 😀 x" * 3, "b"), (6, "w " * 30_000, "b"), (7, "z" * 200_000, "c")]


def corpus(n=60, seed=3):
    """Random texts with exact copies, near copies of near copies, and a passage that many share."""
    rnd, out = random.Random(seed), []
    shared = " ".join(rnd.choices(VOCAB, k=30))
    for i in range(n):
        kind = rnd.random()
        if out and kind < 0.2:
            out.append(rnd.choice(out))
        elif out and kind < 0.5:
            w = rnd.choice(out).split()
            for _ in range(rnd.randrange(1, 4)):
                w[rnd.randrange(len(w))] = rnd.choice(VOCAB)
            out.append(" ".join(w))
        else:
            w = rnd.choices(VOCAB, k=rnd.randrange(1, 120))
            out.append(" ".join(w[:5]) + " " + shared + " " + " ".join(w[5:]) if rnd.random() < 0.4 else " ".join(w))
    return out


def brute_groups(rows, k, num, den):
    sets = []
    for _, t, _ in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                top[find(a)] = find(b)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r[0])
    return [(r[0], len(sets[i]), min((x for x in least[find(i)] if x is not None), default=None)) for i, r in enumerate(rows)]


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 4, 5)])
def test_shingle_join(spark, k, num, den):
    rows = [(i, t, "a") for i, t in enumerate(corpus())]
    got = similar_components(table(spark, rows), k=k, num=num, den=den).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute_groups(rows, k, num, den))


def test_shingle_join_edges(spark):
    key = lambda x: tuple((v is not None, v) for v in x)
    got = [tuple(r)[:3] for r in similar_components(table(spark, EDGES), k=4, num=85, den=100).collect()]
    assert sorted(got, key=key) == sorted(brute_groups(EDGES, 4, 85, 100), key=key)
    assert similar_components(table(spark, [])).count() == 0


def test_key_filter(spark):
    """Joins behind a key filter are plain joins, null equal to null, with few keys and with more than it has bits for."""
    from detdata.llm.common import within, without

    df = spark.range(0, 3000).select(F.when(F.col("id") % 7 > 0, F.col("id") % 500).alias("a"), (F.col("id") % 3).cast("string").alias("b"), F.col("id").alias("_row"))
    for table_ in (spark.createDataFrame([(3, "1"), (None, "2"), (4, None)], "x long, y string"), spark.range(-(10**6), 10**6).select(F.col("id").alias("x"), F.lit("1").alias("y")), spark.createDataFrame([], "x long, y string")):
        keys = {"x": F.col("a"), "y": F.col("b")}
        same = F.col("a").eqNullSafe(F.col("x")) & F.col("b").eqNullSafe(F.col("y"))
        assert sorted(map(str, without(df, keys, table_).collect())) == sorted(map(str, df.join(table_, same, "left_anti").collect()))
        assert sorted(map(str, within(df, keys, table_).collect())) == sorted(map(str, df.join(table_, same).collect()))


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (100, 102), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "u long, v long")).collect()))
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 101, 102), 100)}


def test_repair_round_trip(spark):
    rows = EDGES + [(100 + i, t, "a") for i, t in enumerate(corpus())]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    path = f"{spark.sparkContext.getCheckpointDir()}/shards-test"
    docs = table(spark, rows).repartition(3)
    repair_codec.write_shards(docs, path, tokenizer_path(), size=2000)
    shards = repair_codec.read_shards(spark, path)
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"], r["ids"]) for r in repair_codec.decoded(shards, with_ids=True).collect()), key=lambda r: r[0])
    start = 0
    for (at, doc, n, crc, ids), (i, t, _) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), strict=True):
        want = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        assert (at, doc, n, ids) == (start, i, len(want), want)
        assert crc == zlib.crc32(np.array(want, "<u4").tobytes())
        start += n
    one = max(shards.collect(), key=lambda r: len(r["rules"])).asDict()
    whole = repair_codec.decoded(shards.where((F.col("part") == one["part"]) & (F.col("shard") == one["shard"])), with_ids=True).collect()
    assert len(one["rules"]) > 0 and len(one["symbols"]) // 4 < one["n_tokens"]
    d = max(range(len(one["doc_ids"])), key=lambda j: one["doc_tokens"][j])
    ids = whole[d]["ids"]
    for a, b in ((0, len(ids)), (3, 11), (len(ids) - 4, len(ids))):
        assert repair_codec.token_range(one, d, a, b).tolist() == ids[a:b]
    assert repair_codec.encode(table(spark, []), tokenizer_path()).count() == 0


def test_other_tokenizers_encode_whole_texts(tmp_path):
    """A file that splits or normalizes otherwise is not cut into pieces."""
    import json

    import pyarrow as pa
    from tokenizers import Tokenizer

    from detdata.llm.pieces import Encoder

    texts = ["Hello  world, it's 3.14!\n\tYes", "", "a b", "x" * 2000 + " \u00a0 y", "<|endoftext|> z"]
    spec = json.loads(open(tokenizer_path()).read())
    kinds = {"usual": {}, "prefix": {"pre_tokenizer": {**spec["pre_tokenizer"], "add_prefix_space": True}}, "lower": {"normalizer": {"type": "Lowercase"}}}
    for name, change in kinds.items():
        (tmp_path / name).write_text(json.dumps({**spec, **change}))
        e, tok = Encoder(str(tmp_path / name)), Tokenizer.from_file(str(tmp_path / name))
        assert e.by_piece == (name == "usual")
        got = [ids[at[i] : at[i + 1]].tolist() for _, ids, at in e.batch(pa.array(texts)) for i in range(len(at) - 1)]
        assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_go_to_the_tokenizer_strung_together(tmp_path):
    """Few calls for many distinct pieces, and the ids of whole texts for odd ones: white space beyond ASCII, marks,
    special tokens, bytes that the vocabulary lacks."""
    import json

    import pyarrow as pa
    from tokenizers import Tokenizer

    from detdata.llm.pieces import Encoder

    rnd = random.Random(4)
    words = ["".join(rnd.choices("abcdeéèЖ日ぁß’°", k=rnd.randrange(1, 9))) for _ in range(4000)]
    texts = [" ".join(words[i : i + 40]) for i in range(0, 4000, 40)]
    odd = [" ", "  ", "\n", "\r\n", "\t", "\u00a0", "\u3000", "\u2003", "\u0085", "\x1c", "'s", "'", ".", "!?", "x", "Z9", "é", "°", "’", "あ", "日", "😀", "<|endoftext|>", "1"]
    texts += ["".join(rnd.choices(odd, k=rnd.randrange(30))) for _ in range(3000)]
    spec = json.loads(open(tokenizer_path()).read())
    few = {c: i for i, c in enumerate([*"abcdexZ.!?'Ġ", "Ċ", "<|endoftext|>"])}
    (tmp_path / "few").write_text(json.dumps({**spec, "added_tokens": [], "model": {"type": "BPE", "vocab": few, "merges": []}}))
    (tmp_path / "usual").write_text(json.dumps(spec))
    # a special token with white space, which the end and the beginning of two pieces might give
    spaced = {**spec["added_tokens"][0], "id": len(spec["model"]["vocab"]), "content": "x é"}
    (tmp_path / "spaced").write_text(json.dumps({**spec, "added_tokens": [*spec["added_tokens"], spaced]}))
    for name in ("usual", "few", "spaced"):
        e, tok, given = Encoder(str(tmp_path / name)), Tokenizer.from_file(str(tmp_path / name)), []

        class Spy:
            def encode_batch_fast(self, batch, tok=tok, given=given, **how):
                given.append(len(batch))
                return tok.encode_batch_fast(batch, **how)

        e.tok = Spy()
        assert e.by_piece
        ids = [ids[at[i] : at[i + 1]].tolist() for _, ids, at in e.batch(pa.array(texts)) for i in range(len(at) - 1)]
        assert ids == [tok.encode(t, add_special_tokens=False).ids for t in texts]
        if name == "usual":
            given.clear()
            list(e.batch(pa.array([" " + " ".join(f"{c}{w}" for w in words if w.isascii() for c in "xyz") for _ in range(2)])))
            assert 0 < sum(given) <= 20


def test_repair_rounds():
    """Symbols of any size are replaced alike, and rules within rules expand to what they stand for."""
    rnd = np.random.default_rng(5)
    seq = np.concatenate([np.tile(rnd.integers(0, 40, 50), 60), np.zeros(3000, np.int64), rnd.integers(0, 6, 9000)])
    end = np.zeros(len(seq), dtype=bool)
    end[rnd.integers(0, len(seq), 60)] = end[-1] = True
    symbols, ends, rules = repair_codec.compress(seq, end, 50)
    far = 1 << 31
    symbols_far, ends_far, rules_far = repair_codec.compress(seq, end, far)
    lift = lambda x: np.where(np.asarray(x) >= 50, np.asarray(x) - 50 + far, x)
    assert lift(symbols).tolist() == symbols_far.tolist() and ends.tolist() == ends_far.tolist() and lift(rules).tolist() == np.array(rules_far).tolist()
    flat, at = repair_codec.expansions(np.array(rules, "<u4").reshape(-1, 2), 50)
    plain = []
    for a, b in rules:
        plain.append((plain[a - 50] if a >= 50 else [a]) + (plain[b - 50] if b >= 50 else [b]))
    assert max(map(len, plain)) > 8 and [flat[i:j].tolist() for i, j in zip(at, at[1:])] == plain
    assert repair_codec.expand(symbols, 50, flat, at).tolist() == seq.tolist() and len(symbols) < len(seq) / 2
    runs = np.split(symbols, np.flatnonzero(ends)[:-1] + 1)
    assert [len(repair_codec.expand(r, 50, flat, at)) for r in runs] == np.diff(np.append(-1, np.flatnonzero(end))).tolist()


def test_decontamination(spark):
    rnd = random.Random(9)
    items = [(i, " ".join(rnd.choices(VOCAB, k=rnd.randrange(3, 60)))) for i in range(12)] + [(90, None), (91, "")]
    docs = []
    for i in range(40):
        w = rnd.choices(VOCAB, k=rnd.randrange(20, 200))
        if i % 4 == 0:
            p = items[i % 12][1].translate(UP).split()
            if i % 8 == 0 and len(p) > 30:
                p[rnd.randrange(len(p))] = "other"
            w[10:10] = p
        docs.append((i, " ".join(w), "a"))
    docs += [(500 + j, *r[1:]) for j, r in enumerate(EDGES)]

    want = set()
    for d, t, _ in docs:
        w = WORD.findall((t or "").translate(LOW))
        if len(w) > 1000:
            continue
        for i, x in items:
            y = WORD.findall((x or "").translate(LOW))
            n = min(len(y), len(w))
            if not n or n < min(5, len(y)):
                continue
            k = min(5, len(y))
            grams = lambda z: Counter(tuple(z[j : j + k]) for j in range(len(z) - k + 1))  # noqa: E731, B023
            c = grams(y)
            if any(5 * sum((g & c).values()) >= 4 * sum((g | c).values()) for g in (grams(w[s : s + n]) for s in range(len(w) - n + 1))):
                want.add((d, i))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(table(spark, docs), bench).collect()}
    assert got == want and len(got) >= 8
    small = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(table(spark, docs), bench, chunk=200, chunk_items=5).collect()}
    assert small == want  # items in several chunks
    assert decontam.contaminated(table(spark, []), bench).count() == 0 and decontam.contaminated(table(spark, docs), bench.limit(0)).count() == 0


def test_multi_index_finds_all_within_radius():
    rnd = np.random.default_rng(1)
    items = [(i, rnd.integers(1, 2**62, 20, dtype=np.uint64)) for i in range(30)]
    index = decontam.ItemIndex(items, 5, decontam.RADIUS)
    prints = [index.prints[20], rnd.integers(0, 2**63, (500, 2), dtype=np.uint64)]
    for bits in range(1, 40):
        p = index.prints[20].copy()
        for b in rnd.choice(128, bits, replace=False):
            p[:, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
        prints.append(p)
    prints = np.concatenate(prints)
    apart = np.bitwise_count(prints[:, None, :] ^ index.prints[20][None]).sum(axis=2)
    assert set(index._candidates(20, prints)) == set(zip(*map(list, np.nonzero(apart <= decontam.RADIUS)), strict=True))


def test_window_prints():
    s = np.random.default_rng(2).integers(1, 2**62, 70_000, dtype=np.uint64)
    for start, count, width in ((0, 5, 3), (7, 100, 40_000), (69_990, 8, 3)):
        got = decontam.window_prints(s, start, count, width)
        for w in {0, count // 2, count - 1}:
            assert (got[w] == decontam.simhash(s[start + w : start + w + width])).all()


def test_simhash_recall():
    """Pairs of similarity 0.8 and a little more: at least nine in ten, here 99 in 100, are within the radius."""
    rnd = np.random.default_rng(5)
    near = total = 0
    for n in (20, 60, 200):
        for _ in range(300):
            a = rnd.integers(1, 2**62, n, dtype=np.uint64)
            b = a.copy()
            b[: n // 9] = rnd.integers(1, 2**62, n // 9, dtype=np.uint64)  # n - n/9 of n + n/9: 0.8
            near += int(np.bitwise_count(decontam.simhash(a) ^ decontam.simhash(b)).sum()) <= decontam.RADIUS
            total += 1
    assert near >= 0.99 * total


def test_decontamination_of_long_texts_and_ties(spark):
    rnd = random.Random(19)
    item = " ".join(rnd.choices(VOCAB, k=40))
    long_item = " ".join(rnd.choices(VOCAB, k=3000))
    filler = lambda n: " ".join("f" + str(rnd.randrange(10**6)) for _ in range(n))
    docs = [(1, filler(50_000) + " " + item + " " + filler(50_000) + " " + item, "a"), (2, filler(400) + " " + long_item + " " + filler(30), "a"), (2, filler(400) + " " + long_item + " " + filler(30), "a"), (3, filler(9000), "a"), (4, item, "a")]
    bench = spark.createDataFrame([(7, item), (8, long_item)], "item_id long, text string")
    got = sorted(map(tuple, decontam.contaminated(table(spark, docs), bench).collect()))
    assert got == [(1, 7, 50_000, 40, 1.0), (2, 8, 400, 3000, 1.0), (2, 8, 400, 3000, 1.0), (4, 7, 0, 40, 1.0)]


def test_source_mix(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choices(VOCAB, k=rnd.randrange(0, 60))), rnd.choice(["s1", "s1", "s1", "s2", "s3", None])) for i in range(400)] + EDGES
    got = mix_sources(table(spark, rows)).collect()
    again = mix_sources(table(spark, rows)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["taken"])
    assert sorted(got, key=key) == sorted(again, key=key) and len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        whole = int(r["target"] / r["source_size"] + 1e-9) if r["source_size"] else 0
        assert r["size"] == 0 or whole <= r["copies"] <= whole + 1
    for rs in by.values():
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= max(r["size"] for r in rs)
    assert mix_sources(table(spark, [])).count() == 0


def test_source_mix_does_not_depend_on_the_layout(spark):
    rnd = random.Random(14)
    rows = [(i, " ".join(rnd.choices(VOCAB, k=rnd.randrange(0, 60))), rnd.choice(["s1", "s1", "s2", None])) for i in range(500)]
    rows += [rows[3]] * 40 + [(None, "same text", "s1")] * 30 + EDGES
    got = []
    for n in (3, 7, 50):
        rnd.shuffle(rows)
        got.append(Counter(tuple(r) for r in mix_sources(table(spark, rows).repartition(n)).select("doc_id", "source", "size", "taken").collect()))
    assert got[0] == got[1] == got[2] and sum(got[0].values()) == len(rows)


def test_mix_targets_against_resharing(spark):
    sizes = {"a": 10, "b": 500, "c": 100, "d": 40, None: 350, "e": 0}
    names = sorted((s for s in sizes if s), key=str) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    want, left, open_ = dict.fromkeys(sizes, 0.0), 1.5 * sum(sizes.values()), set(sizes)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 2.0 * sizes[s]
            left -= want[s]
        open_ -= over
    got = {r["source"]: r["target"] for r in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(want)


def test_quality_rules(spark):
    rnd = random.Random(2)
    body = lambda n: " ".join(rnd.choice(VOCAB) + str(rnd.randrange(9999)) for _ in range(n))
    common = "Rights reserved: " + " ".join(f"clause{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(64))
    rows = [(i, body(40) + "\n" + common + "\n" + body(30), "h") for i in range(30)]
    rows += [(100 + i, body(10) + "\n" + common, "h") for i in range(5)]  # little but the common line
    rows += [(200 + i, "\n".join(f"line {j} of the copied text " + " ".join(VOCAB[j * 20 : j * 20 + 15]) for j in range(9)), "h") for i in range(40)]  # copies
    rows += [(300, "a b c " * 50, "h"), (301, "short", "g")] + [(400 + j, *r[1:]) for j, r in enumerate(EDGES)]
    got = {r["doc_id"]: r for r in quality_rules(table(spark, rows)).collect()}
    for i, t, _ in rows:
        t, r = t or "", got[i]
        w = WORD.findall(t)
        at = defaultdict(list)
        for j in range(len(w) - 2):
            at[tuple(w[j : j + 3])].append(j)
        covered = {j + d for v in at.values() if len(v) > 1 for j in v for d in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)), i
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
    assert all(got[i]["n_boilerplate_words"] == 66 and got[i]["kept"] for i in range(30))
    assert not any(got[100 + i]["kept"] or got[100 + i]["base_failed"] for i in range(5))
    assert all(got[200 + i]["kept"] for i in range(40))
    assert quality_rules(table(spark, [])).count() == 0


def test_quality_rules_count_distinct_documents(spark):
    rnd = random.Random(4)
    body = lambda n: " ".join(rnd.choice(VOCAB) + rnd.choice(VOCAB) + rnd.choice(VOCAB) for _ in range(n))
    block = "\n".join(body(6) for _ in range(10))
    rows = [(i, block + "\n" + "\n".join(body(12) for _ in range(3)), "h") for i in range(30)]  # unrelated but for ten lines
    held = body(8)
    rows += [(100 + i, held + "\n" + body(60), "g") for i in range(30)]
    copied = held + "\n" + body(60)
    rows += [(200 + i, copied.upper() if i % 2 else copied, "g") for i in range(400)]  # one more document, 400 times
    rows += [(700 + i, held + "\n" + body(60), "f") for i in range(19)] + [(800 + i, held + "\n" + copied, "f") for i in range(50)]  # 20 distinct ones: the limit
    got = {r["doc_id"]: r["n_boilerplate_words"] for r in quality_rules(table(spark, rows)).collect()}
    assert all(got[i] == 60 for i in range(30))
    assert all(got[100 + i] == 8 for i in range(30)) and all(got[200 + i] == 8 for i in range(400))
    assert all(got[700 + i] == 0 for i in range(19)) and all(got[800 + i] == 0 for i in range(50))


def brute_boilerplate(rows, max_docs, min_share, min_words):
    """{row number: (n_boilerplate_words, kept)}, with whole lines instead of hashes."""
    norm = lambda x: re.sub("[0-9]+", "0", x.strip(" \t\n\x0b\f\r").lower())
    lines = [[x for x in (t or "").split("\n") if WORD.search(x)] for _, t, _ in rows]
    held = defaultdict(set)
    for (_, _, host), ls in zip(rows, lines, strict=True):
        for x in ls:
            held[host, norm(x)].add(frozenset(map(norm, ls)))
    out = {}
    for i, ((_, t, host), ls) in enumerate(zip(rows, lines, strict=True)):
        w = WORD.findall(t or "")
        at = defaultdict(list)
        for j in range(len(w) - 2):
            at[tuple(w[j : j + 3])].append(j)
        covered = {j + d for v in at.values() if len(v) > 1 for j in v for d in range(3)}
        gone = sum(len(WORD.findall(x)) for x in ls if len(held[host, norm(x)]) > max_docs)
        failed = len(w) < min_words or 100 * len(covered) > 50 * len(w)
        out[i] = gone, not failed and len(w) - gone >= len(w) * min_share
    return out


def test_quality_rules_against_brute_force(spark):
    """Several shared lines per document, copies, hosts of many sizes."""
    rnd = random.Random(21)
    line = lambda n: " ".join(rnd.choice(VOCAB) + rnd.choice(VOCAB) for _ in range(n))
    shared = {h: [line(rnd.randrange(1, 12)) for _ in range(6)] for h in ("a", "b", None)}
    rows = []
    for i in range(260):
        host = rnd.choice(["a", "a", "b", None])
        ls = [line(rnd.randrange(1, 25)) for _ in range(rnd.randrange(0, 5))] + rnd.sample(shared[host], rnd.randrange(0, 6))
        rnd.shuffle(ls)
        rows.append((i, "\n".join(x.upper() if rnd.random() < 0.2 else x for x in ls), host))
        if rnd.random() < 0.2:
            rows += [(1000 + i, rows[-1][1] + "\n ", host)] * 2
    want = brute_boilerplate(rows, 12, 0.3, 10)
    from detdata.llm.quality_rules import kept_documents

    docs = table(spark, rows)
    got = Counter((r["doc_id"], r["n_boilerplate_words"], r["kept"]) for r in quality_rules(docs, max_docs=12, min_words=10).collect())
    assert got == Counter((rows[i][0], *v) for i, v in want.items())
    assert 20 < sum(v[1] for v in want.values()) < len(rows) - 20 and any(v[0] and not v[1] for v in want.values())
    kept = kept_documents(docs, max_docs=12, min_words=10)
    assert kept.schema == docs.schema and Counter(map(tuple, kept.collect())) == Counter(map(tuple, table(spark, [rows[i] for i, v in want.items() if v[1]]).collect()))
    one = [(i, shared["a"][0], "a") for i in range(50)] + [(100 + i, shared["a"][0] + "\n" + line(9), "a") for i in range(30)]
    got = {r["doc_id"]: r["n_boilerplate_words"] for r in quality_rules(table(spark, one)).collect()}
    assert all(got[i] == len(shared["a"][0].split()) for i in got)  # pages of one shared line alone have it taken out too


def brute_lines(rows, least):
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(LOW)
    held = Counter(k for _, t, _ in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or held[key(x)] < least]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_line_dedup(spark):
    rnd = random.Random(6)
    rows = [(i, "\n".join(rnd.choice(["Common  ", " common", "rare %d" % i, "half" if i % 2 else "", "ÄÖ ß", "x"]) for _ in range(6)), "a") for i in range(30)] + EDGES
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    docs = table(spark, rows)
    for mb, shards in ((64, None), (0.05, 7)):  # filters in one chunk, or in several
        counts, filters = line_dedup.change_documents(line_dedup.no_documents(spark, 10), docs, 10, shards=shards)
        got = line_dedup.drop_common(docs, counts, filters, 10, chunk_mb=mb).collect()
        assert sorted(map(tuple, got), key=key) == sorted(brute_lines(rows, 10), key=key)
    assert sorted(map(tuple, line_dedup.dedup_lines(docs).collect()), key=key) == sorted(brute_lines(rows, 10), key=key)
    assert line_dedup.dedup_lines(table(spark, [])).count() == 0


def test_line_dedup_shards_split(spark, monkeypatch):
    """A state that starts small and grows a thousandfold keeps its shards small, and its answers right."""
    monkeypatch.setattr(line_dedup, "PER_SHARD", 40)
    rows = lambda a, b: [(1000 * c + i, f"line {i}", "a") for i in range(a, b) for c in range(2)]
    state, held = line_dedup.no_documents(spark, 2), []
    for a, b in ((0, 4), (4, 60), (60, 900)):
        held += rows(a, b)
        state = line_dedup.change_documents(state, table(spark, rows(a, b)), 2)
        shards = state[1].select("shard", "shards", "tables").collect()
        keys = state[0].where("n >= 2").select(line_dedup._shard(shards[0]["shards"])).groupBy("shard").count().collect()
        assert len({r["shards"] for r in shards}) == 1 and sum(r["count"] for r in keys) == b
        assert max(r["count"] for r in keys) <= 80 and all(len(r["tables"]) == 1 for r in shards)
        got = line_dedup.drop_common(table(spark, [*held, (77_777, "line 1\nown", "a")]), *state, 2).collect()
        assert {r["doc_id"] for r in got if r["kept"]} == {77_777} and {r["kept"] for r in got if r["doc_id"] == 77_777} == {"own"}
    state = line_dedup.change_documents(state, table(spark, held), 2, -1)
    assert state[0].count() == 0 and all(not r["tables"] for r in state[1].collect())


def test_line_dedup_of_a_very_long_text(spark):
    """A text of a million lines, all but a few of them common, is done in seconds: its lines are not compared in pairs."""
    import time

    lines = [f"l{i % 1000}" if i % 50_000 else f"own {i}" for i in range(1_000_000)]
    rows = [(1, "\n".join(lines), "a"), (2, "\n".join(f"l{i}" for i in range(1000)), "a")]
    docs = table(spark, rows)
    docs.count()
    began = time.time()
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs, min_docs=2).collect()}
    assert got[1]["kept"] == "\n".join(x for x in lines if x.startswith("own")) and got[1]["n_lines"] == 1_000_000 and got[1]["n_dropped"] == 999_980
    assert got[2]["kept"] == "" and got[2]["n_dropped"] == 1000
    assert time.time() - began < 60


def test_html_parser_keeps_places_and_attributes():
    """Letters whose lower case is longer, long attributes, names inside values, and containers named by a compound."""
    text = lambda body: html_template.main_text(f"<html><body><article>{body}</article></body></html>")
    for letter in "Iİ":
        assert text("<p>" + letter * 40 + "</p><script>var a=1;</script><p>Hello world, first</p><p>second para</p>") == letter * 40 + "\nHello world, first\nsecond para"
    assert text("<p>a</p><SCRIPT>x</scripty></p></Script ><p>b</p><ſcript>c</ſcript>").startswith("a\nb")
    long = "x" * 600
    assert text(f'<div data-x="{long}" class="advert"><p>BUY NOW</p></div><p>stays</p>') == "stays"
    assert text(f'<div data-x="{long}" role="navigation">menu</div><p>stays</p>') == "stays"
    assert text('<div data-x="class=advert"><p>stays</p></div><div data-class="advert"><p>too</p></div>') == "stays\ntoo"
    assert text('<div class=advert class="text"><p>gone</p></div><p>stays</p>') == "stays"
    assert text('<div class="post-share-header"><p>Real article text</p></div><div class="search-results-analysis"><p>More</p></div>') == "Real article text\nMore"
    assert text('<div class="related-posts"><a href="x">another page</a></div><div class="share-box">on <a>one</a> <a>and two more</a></div><p>stays</p>') == "stays"
    # a doubtful container outside an article, and one whose text the host's template holds
    assert html_template.main_text('<div class="site-footer">imprint</div><article><p>a</p></article>') == "a"
    own, fixed = "an own text", "subscribe to our letter today"
    page = f'<article><p>{own}</p><div class="letter-signup-box"><p>{fixed}</p></div></article>'
    assert html_template.main_text(page, repeated=frozenset([html_template.text_token(fixed)])) == own and html_template.main_text(page) == f"{own}\n{fixed}"
    import time

    for unit in ("<title>", "<svg><p>x", "</title", '<p class="', "<a href=x class=y-share>z"):
        began = time.time()
        html_template.parse(unit * 40_000)
        assert time.time() - began < 20, unit


def test_line_dedup_is_reversible(spark):
    """Documents come and go in random batches; the state is always that of the documents that are there."""
    rnd = random.Random(16)
    rows = [(i, f"shared\nown {i}\n{'late' if i > 5 else 'early'}\n" + "\n".join(f"line {rnd.randrange(30)}" for _ in range(5)), "a") for i in range(40)]
    as_set = lambda df: {tuple(r) for r in df.select("h", "g", "n").collect()}
    state, held, least = line_dedup.no_documents(spark, 6), [], 6
    for add, batch in ((1, rows[:14]), (1, rows[14:40]), (-1, rows[5:25]), (1, rows[5:9]), (-1, rows[:5]), (-1, rows[5:9])):
        state = line_dedup.change_documents(state, table(spark, batch), least, add, shards=2)
        held = held + batch if add > 0 else [r for r in held if r not in batch]
        assert as_set(state[0]) == as_set(line_dedup.reference_counts(table(spark, held)))
        got = line_dedup.drop_common(table(spark, held), *state, least).collect()
        assert sorted(map(tuple, got)) == sorted(brute_lines(held, least))
    state = line_dedup.change_documents(state, table(spark, held), least, -1)
    assert state[0].count() == 0 and not any(r["tables"] for r in state[1].collect())


def test_cuckoo_filter_grows():
    rnd = np.random.default_rng(3)
    keys = rnd.integers(-(2**62), 2**62, 20_000)
    f = line_dedup.CuckooFilter(buckets=1024)
    for k in keys:
        f.insert(int(k))
    assert len(f.tables) > 4 and f.contains(keys).all()
    f = line_dedup.CuckooFilter(f.packed(), 1024)
    assert f.contains(rnd.integers(-(2**62), 2**62, 20_000)).mean() < 0.01
    for k in keys[:500]:
        assert f.delete(int(k))
    assert f.contains(keys[500:]).all()
    for k in keys[500:]:
        assert f.delete(int(k))
    assert not f.packed()


@pytest.mark.parametrize("rule", token_spans.RULES)
def test_section_tokens(spark, rule):
    rows = [(10, "one\n\n two three\nfour", "a"), (11, "ünï 日本\n😀 x\n", "a"), *EDGES]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    spans = F.array(F.struct(F.lit(1).alias("start"), F.lit(4).alias("stop")), F.struct(F.lit(6).alias("start"), F.lit(9).alias("stop")))
    for sections in (None, spans):
        got = defaultdict(list)
        for r in token_spans.section_tokens(table(spark, rows), tokenizer_path(), sections=sections, rule=rule).collect():
            got[r["doc_id"]].append((r["section"], r["n_tokens"]))
        for i, t, _ in rows:
            t = t or ""
            if sections is None:
                ends = [j + 1 for j, c in enumerate(t) if c == "\n"]
                ends += [len(t)] if not ends or ends[-1] < len(t) else []
                lo = [0, *ends[:-1]]
            else:
                lo, ends = [1, 6], [4, 9]
            want = Counter()
            for s, e in tok.encode(t, add_special_tokens=False).offsets:
                home = [next((k for k in range(len(lo)) if lo[k] <= c < ends[k]), -1) for c in range(s, max(e, s + 1))]
                if rule == "first":
                    want[home[0]] += 1
                elif rule == "last":
                    want[home[-1]] += 1
                elif rule == "split":
                    for h in home:
                        want[h] += 1 / len(home)
                else:
                    n = Counter(home)
                    best = max(n.values())
                    inside = [h for h in sorted(n) if h >= 0 and n[h] == best]
                    want[inside[0] if inside else -1] += 1
            mine = Counter()
            for k, n in got[i]:
                mine[k] += n
            times = sum(r[0] == i for r in rows)
            assert {k: v for k, v in mine.items() if v} == pytest.approx({k: v * times for k, v in want.items() if v}), (rule, i)


def test_url_verdicts(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">l</a>' for h in hosts)
    urls = [("https://A.example.net/en/1?q", ""), ("http://a.example.net/fr/1", ""), ("https://example.com/de/2#x", ""), ("https://b.example.com/fr/", ""), ("http://x.org/fr/a", link("good.test")), ("http://x.org/en/a", ""), (None, None), ("nothing", ""), ("http://notexample.com/de/", ""), ("https://evil.net/", ""), ("https://farm.test/1", link("evil.net", "good.test")), ("https://good.test/1", ""), ("https://lone.test", "<a href='/x'>")]
    pages = spark.createDataFrame([(i, u, h, "c") for i, (u, h) in enumerate(urls)], "page_id long, url string, html string, verdict string")
    got = {r["page_id"]: r for r in url_trust.judge_urls(pages).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in range(len(urls))] == [
        ("a.example.net", "/en/1", "example.net/en/", "allow"), ("a.example.net", "/fr/1", "net/", "block"), ("example.com", "/de/2", "example.com/de/", "block"), ("b.example.com", "/fr/", None, "allow"),
        ("x.org", "/fr/a", "org/fr/", "allow"), ("x.org", "/en/a", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("notexample.com", "/de/", None, "allow"), ("evil.net", "/", "net/", "block"),
        ("farm.test", "/1", None, "block"), ("good.test", "/1", None, "allow"), ("lone.test", "", None, "allow"),
    ]
    assert got[10]["distrust"] > 0
    assert url_trust.judge_urls(pages.limit(0)).count() == 0


def test_url_trust_converges(spark):
    link = '<a href="http://{}/">x</a>'.format
    hosts = ["evil.net", *(f"h{i}.test" for i in range(14))]
    chain = [(i, f"http://{h}/", link(hosts[i - 1]) if i else None) for i, h in enumerate(hosts)]
    got = {r["host"]: r for r in url_trust.judge_urls(spark.createDataFrame(chain, "page_id long, url string, html string")).collect()}
    for i, h in enumerate(hosts[1:], 1):  # one link more each
        assert got[h]["distrust"] == pytest.approx(0.15 * 0.85**i) and got[h]["verdict"] == "block"
    edges = [("a", "b", 2), ("b", "c", 1), ("c", "a", 1), ("c", "b", 3), ("d", "a", 1)]
    names, w = "abcd", np.zeros((4, 4))
    for s, d, n in edges:
        w[names.index(d), names.index(s)] = n / sum(x for f, _, x in edges if f == s)
    p = np.array([0, 0, 0.25, 0.75])
    want = np.linalg.solve(np.eye(4) - 0.85 * w, 0.15 * p) - 0.15 * p
    seeds = spark.createDataFrame([("trust", "c", 1.0), ("trust", "d", 3.0)], "kind string, host string, mass double")
    score = {r["host"]: r["score"] for r in url_trust.propagate(spark.createDataFrame(edges, "src string, dst string, n long"), seeds, tolerance=1e-3).collect()}
    assert sum(abs(want[i] - score.get(h, 0)) for i, h in enumerate(names)) <= 1e-3


def test_url_trust_on_a_large_graph(spark):
    """2,000 hosts with a hub that links to all and one that all link to, against plain power iteration."""
    rnd, n = random.Random(31), 2000
    edges = Counter()
    for i in range(n):
        for _ in range(3):
            j = int(n * rnd.random() ** 3)
            if i != j:
                edges[i, j] += rnd.randrange(1, 4)
        if i:
            edges[0, i] += 1
            edges[i, 1] += 1 if i != 1 else 0
    edges = {e: c for e, c in edges.items() if c}
    mass = {"trust": {k: 1.0 + k % 3 for k in range(5, n, 97)}, "distrust": {k: 2.0 for k in range(11, n, 301)}}
    want = {}
    for kind, seeds in mass.items():
        s, d = np.array(list(edges)).T if kind == "trust" else np.array(list(edges)).T[::-1]
        c = np.array(list(edges.values()), float)
        w = c / np.bincount(s, c, minlength=n)[s]
        p = np.bincount(list(seeds), list(seeds.values()), minlength=n) / sum(seeds.values())
        x = 0.15 * p
        for _ in range(300):
            x = 0.85 * np.bincount(d, x[s] * w, minlength=n) + 0.15 * p
        want[kind] = x - 0.15 * p
    host = "h{:04d}".format
    got = {"trust": np.zeros(n), "distrust": np.zeros(n)}
    table_ = spark.createDataFrame([(host(a), host(b), c) for (a, b), c in edges.items()], "src string, dst string, n long")
    seeds = spark.createDataFrame([(k, host(h), m) for k, v in mass.items() for h, m in v.items()], "kind string, host string, mass double")
    for r in url_trust.propagate(table_, seeds, tolerance=1e-9).collect():
        got[r["kind"]][int(r["host"][1:])] = r["score"]
    for kind in want:
        assert np.abs(want[kind] - got[kind]).sum() < 2e-9


def test_url_rules_ties_and_repeats(spark):
    rules = (("a.test/x", "block"), ("b.a.test/", "allow"), ("a.test/xy/", "allow"), ("a.test/xy/", "block"))
    long_ = "http://b.a.test/" + "z" * 100_000
    rows = [(1, "http://a.test/xy/1", "<p>" * 100_000), (1, "http://a.test/xy/1", "<p>" * 100_000), (2, "http://b.a.test/x", None), (3, long_, "")]
    got = sorted((r["page_id"], r["rule"], r["verdict"]) for r in url_trust.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), rules=rules).collect())
    # the longest rule wins; of equally long ones the last by name, of equal ones the last given
    assert got == [(1, "a.test/xy/", "block"), (1, "a.test/xy/", "block"), (2, "b.a.test/", "allow"), (3, "b.a.test/", "allow")]


def test_html_extraction(spark):
    body = '<nav><a href="/x">menu</a></nav><header>site</header><div class="cookie-notice">we use</div>{}<aside>side</aside><form><p>q</p></form><footer>foot</footer><script>var a="<p>no</p>";</script>'
    pages = [
        body.format("<article><h1>T &amp; x</h1><p>One\n  two<br>three <b>bo</b>ld<p>Next&nbsp;one<div class='ad'>buy</div><section id='comments'><p>me</section></article>"),
        body.format("<main><p>Only</p></main>"), "", None, "plain &lt;text&gt;", body.format("<div>Home of all</div><div><p>A 1</p></div>"), body.format("<div>Home of all</div><div><p>B 2</p></div>"), body.format("<div>Home of all</div><div><p>C 3</p></div>"),
        "<p>a" + "<div>" * 3000 + "deep",
    ]
    urls = ["http://h/1", "http://h/2", None, "x", "http://p/1", "http://n/1", "http://n/2", "http://n/3", "http://d/1"]
    df = spark.createDataFrame([(i, u, h, "t") for i, (u, h) in enumerate(zip(urls, pages, strict=True))], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_template.extract_text(df).collect()}
    assert got == {0: "T & x\nOne two three bold\nNext one", 1: "Only", 2: "", 3: "", 4: "plain <text>", 5: "A 1", 6: "B 2", 7: "C 3", 8: "a\ndeep"}
    assert html_template.extract_text(df.limit(0)).count() == 0


def brute_template(pages, share, least):
    """{(token, class members)} of one host's template: classes by whole occurrence vectors, order checked page by page."""
    pages = sorted(set(pages))
    seen = [html_template.parse(p)[1] for p in pages]
    tokens = {t for ts in seen for t, _ in ts}
    count = {t: tuple(sum(x == t for x, _ in ts) for ts in seen) for t in tokens}
    first = {t: [next((j for j, (x, _) in enumerate(ts) if x == t), None) for ts in seen] for t in tokens}
    support = {t: sum(c > 0 for c in count[t]) for t in tokens}
    place = {t: sum(x for x in first[t] if x is not None) / support[t] for t in tokens}
    classes = defaultdict(list)
    for t in tokens:
        if support[t] >= least and support[t] >= len(pages) * share:
            classes[count[t]].append(t)
    valid = []
    for c, ts in classes.items():
        ts.sort(key=lambda t: (place[t], t))
        if all([first[t][i] for t in ts] == sorted(first[t][i] for t in ts) for i in range(len(pages)) if c[i]):
            valid.append((frozenset(ts), min(place[t] for t in ts), max(place[t] for t in ts), support[ts[0]]))
    return valid


def test_html_template_against_brute_force(spark):
    """Hosts of random pages without article tags or telling names: classes, order and spans, then the texts left."""
    rnd = random.Random(41)
    rows, want = [], {}
    for h in range(6):
        fixed = [f"fixed {h} {j}" for j in range(4)]
        for k in range(rnd.randrange(4, 12)):
            own = [f"own {h} {k} {j}" for j in range(rnd.randrange(1, 5))]
            html = f'<body><div class="k a{h}"><p>{fixed[0]}</p></div><section>' + "".join(f"<div><span>{x}</span></div>" for x in own) + "</section>"
            if rnd.random() < 0.8:
                html += f"<table><tr><td>{fixed[1]}<td>{fixed[2]}</table>"
            if rnd.random() < 0.3:
                html = html.replace("<section>", f"<section><h2>{fixed[3]}</h2>")
            rows.append((len(rows), f"http://host{h}.test/{k}", html))
            want[len(rows) - 1] = (h, html)
    rows += [(1000 + i, *r[1:]) for i, r in enumerate(rows[:5])]  # copies change nothing
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = html_template.template(df.withColumn("host", F.regexp_extract("url", "//([^/]*)", 1)), "host", "html").collect()
    for h in range(6):
        mine = defaultdict(set)
        for r in found:
            if r["host"] == f"host{h}.test":
                mine[r["class"]].add(r["token"])
        brute = brute_template([p for g, p in want.values() if g == h], html_template.SHARE, html_template.LEAST_PAGES)
        crossing = any(x[1] < y[1] <= x[2] < y[2] for x in brute for y in brute)
        assert {frozenset(v) for v in mine.values()} == {b[0] for b in brute} or crossing
        parents = {r["class"]: r["parent"] for r in found if r["host"] == f"host{h}.test"}
        span = {c: (min(r["place"] for r in found if r["class"] == c and r["host"] == f"host{h}.test"), max(r["place"] for r in found if r["class"] == c and r["host"] == f"host{h}.test")) for c in parents}
        assert sum(p is None for p in parents.values()) >= 1 and all(p is None or span[p][0] <= span[c][0] and span[c][1] <= span[p][1] for c, p in parents.items())
    got = {r["page_id"]: r["text"] for r in html_template.extract_text(df).collect()}
    for i, (h, html) in want.items():
        lines = got[i].split("\n")
        assert [x for x in lines if x.startswith("own")] == re.findall(r"<span>([^<]*)", html) and f"fixed {h} 0" not in lines


def test_html_parser_takes_linear_time():
    import time

    began = time.time()
    for page in ("<div>" * 500_000 + "deep", '<a "' * 500_000, "<b><p>" * 300_000 + "</b>" * 300_000 + "x", "<li>" * 300_000 + "y", "<i>" * 300_000 + "<p>" * 100 + "</u>" * 300_000, "<" * 500_000, "<!--" * 200_000, "&amp" * 300_000):
        html_template.parse(page)
    assert time.time() - began < 60
    blocks, _ = html_template.parse("<p>a" + "<div>" * 3000 + "deep")
    assert [b.text for b in blocks] == ["a", "deep"]
    assert [b.text for b in html_template.parse('<p title="a > b">x</p><p class=\'q">y</p><p>z')[0]] == ["x", "y", "z"]


def test_html_copies_are_one_page(spark):
    pages = ["<div>Own text</div><div><p>of a copied page</p></div>"] * 5 + [f"<div>Home</div><div><p>{i}</p></div>" for i in range(3)]
    df = spark.createDataFrame([(i, f"http://{'c' if i < 5 else 'n'}/{i}", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_template.extract_text(df).collect()}
    assert got == {**dict.fromkeys(range(5), "Own text\nof a copied page"), 5: "0", 6: "1", 7: "2"}


def test_ordinal_quality(spark):
    rnd = random.Random(8)
    rows, labels = [], []
    for i in range(1500):
        w = rnd.choices(VOCAB, k=rnd.randrange(30, 90))
        g = i % 3
        if g == 0:
            for _ in range(3):
                w[rnd.randrange(len(w))] = rnd.choice(["vile", "Nasty,", "awful"])
        elif g == 1:
            w = [x + "***" for x in w]
        rows.append((i, " ".join(w), "a"))
        if i < 1200:
            labels.append((i, g))
    lab = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, grade int")
    got = {r["doc_id"]: r for r in ordinal_quality.grade_documents(table(spark, rows + [(9000, None, "a"), (9001, "", "b")]), lab).collect()}
    held = range(1200, 1500)
    assert sum(got[i]["kept"] == (i % 3 == 2) for i in held) / len(held) > 0.95
    mean = lambda g: np.mean([got[i]["expected_grade"] for i in held if i % 3 == g])
    assert mean(0) < mean(1) < mean(2) and len(got) == 1502
    assert ordinal_quality.grade_documents(table(spark, []), lab).count() == 0
    none = ordinal_quality.grade_documents(table(spark, rows[:2]), lab.limit(0)).first()
    assert none["expected_grade"] == pytest.approx(1.0)


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, _wanted string, row int"


def test_pipeline_rows_of_one_id_or_none(spark, tmp_path):
    """Null and repeated ids, equal rows, clashing columns, empty tables: each row is judged by its own text."""
    import corpus_pipeline as P

    rnd = random.Random(15)
    fresh = lambda n: " ".join(rnd.choice(VOCAB) + str(rnd.randrange(99999)) for _ in range(n))
    item, copied, twice = fresh(30), fresh(90), fresh(90)
    good = [fresh(80) for _ in range(12)]
    rows = [(i, t, f"s{i % 2}") for i, t in enumerate(good[:8])]
    rows += [(None, good[8], "s0"), (None, good[9], None), (None, "too short", "s0"), (None, fresh(40) + " " + item + " " + fresh(30), "s1")]
    rows += [(3, good[10], "s1"), (3, "short", "s1"), (4, copied, "s0"), (20, copied, "s1"), (None, copied, "s1"), (30, twice, "s0"), (30, twice, "s0")]
    docs = spark.createDataFrame([(i, t, None if k % 3 else "en", s, len(t or ""), "x", 1) for k, (i, t, s) in enumerate(rows)], DOCUMENTS)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d, seen = docs, []
    for name, stage in P.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path))
        assert d.schema.simpleString() == docs.schema.simpleString(), name
        d = spark.createDataFrame(d.collect(), docs.schema)
        seen.append(Counter((r["doc_id"], r["text"]) for r in d.collect()))
    long_ = Counter((i, t) for i, t, _ in rows if len(t.split()) >= 50)
    assert seen[0] == long_
    assert seen[1] == Counter({k: 1 for k in long_ if k[1] != copied or k[0] == 4})
    assert seen[2] == Counter({k: n for k, n in seen[1].items() if item not in k[1]})
    assert set(seen[3]) <= set(seen[2]) and max(seen[3].values()) <= 2 and sum(seen[3].values()) > len(seen[2])
    # equal rows that reach the mix are documents of their own
    same = spark.createDataFrame([(1, "a b c", "en", "s0", 5, "x", 1)] * 50 + [(2, "d e f", "en", "s1", 5, "x", 1)] * 20, DOCUMENTS)
    mixed = Counter(r["doc_id"] for r in P.mix_sources(spark, same, str(tmp_path)).collect())
    assert 45 <= mixed[1] <= 100 and abs(mixed[1] + mixed[2] - 105) <= 2
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def test_ordinal_fit_against_plain_gradient(spark):
    """The fitted loss is that of plain gradient descent on the same likelihood, tails are ordered, ties and repeats agree."""
    rnd = np.random.default_rng(3)
    x = rnd.integers(0, 40, (600, 6))
    truth = rnd.normal(size=40)
    score = truth[x].sum(axis=1)
    grades = np.digitize(score + rnd.logistic(size=600) * 0.5, [-1.0, 1.5])
    w, theta = ordinal_quality.fit(grades, [r.astype(np.int32) for r in x], [np.ones(6, np.float32)] * 600, 3)

    def loss(w, theta):
        full = np.concatenate([[-np.inf], theta, [np.inf]])
        sig = lambda z: 1 / (1 + np.exp(-z))
        s = w[x].sum(axis=1)
        return -np.log(np.maximum(sig(full[grades + 1] - s) - sig(full[grades] - s), 1e-12)).mean() + ordinal_quality.DECAY / 2 * (w**2).sum()

    v, t = np.zeros(40), np.array([-1.0, 1.0])
    for _ in range(600):  # numerical gradient: slow, plain, independent
        base, g, h = loss(v, t), np.zeros(40), np.zeros(2)
        for i in range(40):
            v[i] += 1e-5
            g[i] = (loss(v, t) - base) / 1e-5
            v[i] -= 1e-5
        for i in range(2):
            t[i] += 1e-5
            h[i] = (loss(v, t) - base) / 1e-5
            t[i] -= 1e-5
        v, t = v - 2.0 * g, t - 2.0 * h
    assert theta[0] < theta[1] and loss(w[:40].astype(float), theta) < loss(v, t) + 0.01
    rows = [(1, "same text", "a"), (1, "same text", "a"), (2, "same text", "a"), (3, "w " * 300_000, "a")]
    labels = spark.createDataFrame([(1, 2), (1, 2), (2, 0)], "doc_id long, grade int")
    got = [tuple(r) for r in ordinal_quality.grade_documents(table(spark, rows), labels).orderBy("doc_id").collect()]
    assert len(got) == 4 and got[0] == got[1] and got[0][1:] == got[2][1:] and 0 <= got[3][1] <= 2


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    rnd = random.Random(12)
    fresh = lambda n: " ".join(rnd.choice(VOCAB) + str(rnd.randrange(99999)) for _ in range(n))
    item = fresh(30)
    base = fresh(120)
    rows = [(i, fresh(100), f"s{i % 3}") for i in range(30)] + [(50, base, "s0"), (51, base, "s1"), (52, base.replace(base.split()[60], "other"), "s2"), (60, fresh(60) + " " + item + " " + fresh(20), "s0"), (70, "too short", "s1"), (71, None, "s1")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d, seen = docs, []
    for name, stage in P.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == docs.columns, name
        d = spark.createDataFrame(d.collect(), docs.schema)
        seen.append(sorted(r["doc_id"] for r in d.collect()))
    assert seen[0] == [*range(30), 50, 51, 52, 60] and seen[1] == [*range(30), 50, 60] and seen[2] == [*range(30), 50]
    assert set(seen[3]) <= set(seen[2]) and max(Counter(seen[3]).values()) <= 2
    words = {i: len((t or "").split()) for i, t, _ in rows}
    assert abs(sum(words[i] for i in seen[3]) - 1.5 * sum(words[i] for i in seen[2])) < 3 * max(words.values())
    out = P.STAGES[-1][1](spark, d, str(tmp_path))
    assert out.count() == len(seen[3]) and {"doc_id", "start", "n_tokens", "ids_crc32"} <= set(out.columns)

