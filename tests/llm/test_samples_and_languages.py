"""Fill-in-the-middle samples, divergence of sources and language masks against plain Python, and their edge cases."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from detdata.llm import fill_in_middle as fim
from detdata.llm import language_masks as masks
from detdata.llm import source_divergence as div

SCHEMA = "doc_id long, text string, lang string, source string, n long, form string, output string, score double, value long, item string, _id int, _text string"


def table(spark, rows):
    """rows (doc_id, text, lang, source), with extra columns whose names clash with results."""
    return spark.createDataFrame([(*r, 1, "x", "y", 0.5, 7, "z", 3, "t") for r in rows], SCHEMA)


LONG = "ab, " * 200_000
EDGES = [(1, None, "en", "a"), (2, "", None, None), (3, " \n\t ", "en", None), (None, "one two", None, "a"), (4, "one two", "en", "a"), (4, "one two", "en", "a"), (5, "Ünï 日本 😀 x" * 3, "de", "b"), (6, LONG, "en", "b"), (7, "z" * 200_000, "en", "c"), (8, "has <S> in it", "en", "a"), (9, "<", "en", "a"), (10, "a<P b>S><M", "en", "a"), (11, "12 34 !?", "en", "a")]


# ---- fill in the middle

def plain_sample(key, text):
    t = text or ""
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return key, len(u), "plain", None, None, t
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    return (key, len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (key, len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(spark):
    rnd = random.Random(4)
    rows = EDGES + [(100 + i, "".join(rnd.choices("abZ é\n<>PSM,😀", k=rnd.randrange(0, 60))), "en", "a") for i in range(400)]
    got = fim.fill_in_middle(table(spark, rows)).withColumn("back", fim.restored(F.col("form"), F.col("output"))).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted((plain_sample(i, t) for i, t, *_ in rows), key=key)
    assert sorted(r["back"] for r in got) == sorted(t or "" for _, t, *_ in rows)
    assert {"psm", "spm", "plain"} == {r["form"] for r in got}
    assert fim.fill_in_middle(table(spark, [])).count() == 0


def test_fill_in_middle_holds_no_units(spark, monkeypatch):
    """Both passes need no memory that grows with the text; small slices change nothing."""
    unit, text = re.compile(fim.UNIT), "a, b " * 400_000
    tracemalloc.start()
    n = fim.n_units(unit, text)
    cut = fim.cuts(unit, text, n // 3, n - 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 2_000_000 and peak < 100_000
    assert cut == (sum(map(len, re.findall(fim.UNIT, text)[: n // 3])), len(text) - 5)
    monkeypatch.setattr(fim, "SLICE", 1)
    assert sorted(map(str, fim.fill_in_middle(table(spark, EDGES)).collect())) == sorted(str(r) for r in fim.fill_in_middle(table(spark, EDGES).coalesce(1)).collect())


def test_marks():
    for bad in (("<P>", "<P>", "<M>"), ("", "b", "c"), ("aba", "x", "y"), ("<P>", ">S", "<M>"), ("<P>", "P", "<M>")):
        with pytest.raises(ValueError):
            fim.Marks(*bad)
    assert fim.Marks("|fim_prefix|>", "<suffix>", "<middle>")


# ---- divergence

def plain_divergence(rows, least, smooth=5, top=50):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df, tf = defaultdict(Counter), defaultdict(Counter)
    for _, t, g, s in rows:
        found = term.findall((t or "").translate(low))
        df[g or ""].update(set(found))
        tf[g or "", s or ""].update(found)
    out = []
    for g in df:
        kept = [t for t, n in df[g].items() if n >= least]
        mine = {s: c for (x, s), c in tf.items() if x == g}
        share = lambda c: {t: 1 + 10**9 * (c[t] + smooth) // (sum(c[t] for t in kept) + smooth * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in mine.items()}, share(sum(mine.values(), Counter()))
        for s in mine:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in mine if o != s]
            terms = [(q[t] - p[s][t], t.encode(), t) for t in kept if mine[s][t] and p[s][t] > q[t]]
            out += [(g, s, part, name, -v, i + 1) for part, found, most in (("pair", pairs, None), ("term", terms, top)) for i, (v, _, name) in enumerate(sorted(found)[:most])]
    return sorted(out)


def test_source_divergence(spark, monkeypatch):
    rnd = random.Random(8)
    vocab = ["".join(random.Random(i).choices("aBcdeé日", k=3)) for i in range(80)]
    rows = EDGES + [(i, (", ".join(rnd.choices(vocab[: rnd.choice([5, 80])], k=rnd.randrange(0, 60)))), rnd.choice(["en", "en", "de", "xx", None]), rnd.choice(["a", "b", "c", "é", "Z", None])) for i in range(300)] + [(900, "only one", "lone", "a"), (901, None, "void", "a"), (902, "x", "void", "b")]
    for least, top in ((3, 4), (30, 50), (10**6, 50)):
        got = div.source_divergence(table(spark, rows), min_docs=least, top=top)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(map(tuple, got.collect())) == plain_divergence(rows, least, top=top)
    assert div.source_divergence(table(spark, [])).count() == 0


def test_source_divergence_partial_counts(spark):
    """Counts handed on early, and texts taken in pieces, add up."""
    text = ("Über, alles. " * 50 + "q" * 500 + " ") * 3
    expected = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.lower().replace("ü", "Ü")))
    before = div.SLICE
    try:
        div.SLICE = 40
        got = Counter()
        for part in div._terms(text.encode()):
            got.update(x.decode() for x in part)
    finally:
        div.SLICE = before
    assert got == expected
    rows = [(i, f"alpha beta{i % 7}", "en", f"s{i % 3}") for i in range(50)]
    got = {(r["source"], r["term"]): (r["n"], r["docs"]) for r in div.term_counts(table(spark, rows)).collect()}
    assert got["s0", "alpha"] == (17, 17) and got["s0", None] == (0, 17)


def test_share_is_exact_at_any_size(spark):
    big = [(10**12 + i, 3 * 10**12, 10**7) for i in range(50)]
    df = spark.createDataFrame(big, "c long, n long, v long")
    got = [r[0] for r in df.select(div.share(F.col("c"), F.col("n"), F.col("v"), 5)).collect()]
    assert got == [1 + 10**9 * (c + 5) // (n + 5 * v) for c, n, v in big]


# ---- languages

def plain_grams(text, sizes):
    out = []
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        marked = f" {word} "
        out += [(n, marked[i : i + n]) for n in sizes for i in range(len(marked) - n + 1) if marked[i : i + n].strip()]
    return out


def test_grams_are_the_plain_ones():
    rnd = random.Random(5)
    texts = ["".join(rnd.choices("abcé日 İ1.\n😀", k=rnd.randrange(0, 40))) for _ in range(60)] + ["", "a", " a ", "1"]
    for sizes in ((1,), (2,), (3,), (1, 2, 3), (4, 5), (1, 4)):
        found, of = masks.grams(texts, sizes)
        names = {}
        for i, t in enumerate(texts):
            own = found[of == i].tolist()
            # grams come size by size
            plain = [g for n in sizes for g in plain_grams(t, (n,))]
            assert len(own) == len(plain)
            for h, g in zip(own, plain, strict=True):
                assert names.setdefault(g, h) == h
        assert len(set(names.values())) == len(names)


def languages(n, seed=6):
    rnd = random.Random(seed)
    kinds = {"en": "the of and ther ing that sh".split(), "de": "der und ung schl keit ß ü".split(), "fr": "le les ique é oux eau".split(), "日": "日 本 語 の は".split(), "it": "lo gli zione ebbe cch".split()}
    out = []
    for i in range(n):
        lang = rnd.choice(list(kinds))
        words = ["".join(rnd.choices(kinds[lang], k=rnd.randrange(1, 4))) for _ in range(rnd.randrange(3, 40))]
        if rnd.random() < 0.1:  # some foreign words
            words += ["".join(rnd.choices(kinds[rnd.choice(list(kinds))], k=2))]
        out.append((i, " ".join(words), lang, "s"))
    return out


def test_model_holds_the_plain_sets(spark):
    """Learned masks against sets worked out plainly: nothing that a language holds is missing, and what else the filter
    answers is as rare as it says; predictions agree with exact sets."""
    rows = [(i, t, lang if i % 9 else None, s) for i, t, lang, s in languages(250)]
    # shared by two languages, so the filter must return both
    rows += [(1000 + i, "zzyzx", lang, "s") for i in range(40) for lang in ("en", "de")]
    model = masks.learn(table(spark, rows), bits=14)
    df, whole = defaultdict(Counter), Counter()
    for _, t, lang, _ in rows:
        if lang and plain_grams(t, masks.SIZES):
            whole[lang] += 1
            df[lang].update(set(plain_grams(t, masks.SIZES)))
    assert model.languages == sorted(whole, key=lambda x: (-whole[x], x))
    rate = lambda x, g: df[x][g] / whole[x] if df[x][g] >= 2 else 0
    sets = {x: {g for g in df[x] if df[x][g] >= 2 and rate(x, g) >= 0.5 * max(rate(o, g) for o in whole)} for x in whole}
    every = sorted(set().union(*(set(c) for c in df.values())))
    wrong, absent = Counter(), Counter()
    for g in every:
        h = [int(x) for x, gram in zip(masks.grams([g[1].strip()], masks.SIZES)[0], plain_grams_in_order(g[1].strip()), strict=True) if gram == g][0]
        mask = None
        for at in masks.places(np.array([h], np.uint64), model.hashes, 14):
            mask = model.masks[at[0]] if mask is None else mask & model.masks[at[0]]
        for i, x in enumerate(model.languages):
            bit = bool(mask[i // 8] >> (i % 8) & 1)
            assert bit or g not in sets[x]
            wrong[x] += bit and g not in sets[x]
            absent[x] += g not in sets[x]
    assert all(wrong[x] <= 10 + 3 * model.chance[i] * absent[x] for i, x in enumerate(model.languages))
    tests = languages(120, seed=60)
    got = {r["doc_id"]: r for r in masks.identify(table(spark, tests), model).collect()}
    for i, t, lang, _ in tests:
        g = plain_grams(t, masks.SIZES)
        exact = {x: sum(y in sets[x] for y in g) / len(g) for x in whole}
        assert got[i]["lang_pred"] == lang == max(exact, key=exact.get) and abs(got[i]["score"] - max(exact.values())) < 0.05


def plain_grams_in_order(text):
    return [g for n in masks.SIZES for g in plain_grams(text, (n,))]


def test_chance_answers_are_taken_off(spark):
    """In a filter that is far too full, the language that fills it most doesn't win by its chance answers."""
    rnd = random.Random(2)
    word = lambda letters: "".join(rnd.choices(letters, k=6))
    rows = [(i, " ".join(word("abcdefghijklmnopqrst") for _ in range(200)), "wide", "s") for i in range(60)] + [(100 + i, " ".join(word("uvwxyz") for _ in range(30)), "tight", "s") for i in range(20)]
    model = masks.learn(table(spark, rows), bits=11, hashes=1)
    assert model.chance[0] > 0.8
    got = masks.identify(table(spark, [(1, " ".join(word("uvwxyz") for _ in range(50)), None, None)]), model).first()
    assert got["lang_pred"] == "tight"


def test_held_out_and_edges(spark, monkeypatch):
    rows = [(i, t, lang if i % 11 else None, s) for i, t, lang, s in languages(300)] + [(None, "le les ique", "fr", "s")]
    out = masks.identify_held_out(table(spark, rows))
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = {r["doc_id"]: r for r in out.collect()}
    truth = {i: lang for i, _, lang, _ in languages(300)}
    for i, lang in truth.items():
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i]["score"] <= 1
        assert got[i]["lang_pred"] == lang
    assert got[None]["held_out"] is False and got[None]["lang_pred"] == "fr"
    # labels of rows that are held out change nothing
    other = [(i, t, "en" if zlib.crc32(str(i).encode()) % 4 == 2 and i is not None else lang, s) for i, t, lang, s in rows]
    assert sorted(map(str, masks.identify_held_out(table(spark, other)).collect())) == sorted(map(str, out.collect()))
    model = masks.learn(table(spark, rows))
    told = masks.identify(table(spark, EDGES), model).collect()
    assert len(told) == len(EDGES) and len({str(r) for r in told if r["doc_id"] == 4}) == 1
    assert {r["doc_id"] for r in told if r["lang_pred"] == "und"} == {1, 2, 3, 9, 11} and all(r["score"] == 0 for r in told if r["lang_pred"] == "und")
    strange = masks.identify(table(spark, [(1, "ЖЖЖ ЩЩЩ", None, None)]), model).first()
    assert strange["lang_pred"] == model.languages[0] and strange["score"] == 0
    assert masks.identify_held_out(table(spark, [])).count() == 0
    unlabelled = masks.identify_held_out(table(spark, [(1, "the of", None, "s")])).first()
    assert unlabelled["lang_pred"] == "und" and unlabelled["score"] == 0


def test_long_texts_in_pieces(monkeypatch):
    """A text that is taken apart in pieces gives the n-grams it gives whole, when words end within a piece."""
    rnd = random.Random(7)
    text = " ".join("".join(rnd.choices("abcd", k=rnd.randrange(1, 9))) for _ in range(3000))
    whole = Counter(masks.grams([text], masks.SIZES)[0].tolist())
    monkeypatch.setattr(masks, "SLICE", 500)
    pieces = Counter()
    for found, _ in masks._parts([text], masks.SIZES):
        pieces.update(found.tolist())
    assert pieces == whole


def test_many_languages(spark):
    """More languages than one byte of a mask has bits."""
    rows = [(100 * i + j, f"w{chr(97 + i)}{chr(97 + (i * 7) % 26)}x {chr(0x4E00 + i)}", f"l{i:02}", "s") for i in range(20) for j in range(3)]
    model = masks.learn(table(spark, rows))
    assert model.masks.shape[1] == 3
    got = masks.identify(table(spark, rows), model).collect()
    assert all(r["lang_pred"] == f"l{r['doc_id'] // 100:02}" for r in got)
