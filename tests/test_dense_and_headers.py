"""Image headers, crowded images, masks of thresholds and running sums against plain Python."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from detdata.functions.image_headers import header
from detdata.operators import matching as M
from detdata.operators import metrics as X
from detdata.operators import running as U
from detdata.sources import files as IO

# ---- headers


def png(w, h, extra=b""):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(b"pixels")) + chunk(b"IEND", b"")


def jpeg(w, h, frame=0xC0, before=b""):
    seg = lambda m, data: bytes([0xFF, m]) + struct.pack(">H", len(data) + 2) + data
    sof = struct.pack(">BHHB", 8, h, w, 3) + b"\1\x22\0\2\x11\1\3\x11\1"
    return b"\xff\xd8" + seg(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + before + seg(0xC4, b"\0" * 20) + b"\xff\xff" + seg(frame, sof)[1:] + seg(0xDA, b"\3\1\0\2\x11\3\x11\0\x3f\0") + b"scan"


def thumbnail(n):
    """A segment with a whole small JPEG in it."""
    data = (b"Exif\0\0" + jpeg(7, 9) * n)[:65000]
    return b"\xff\xe1" + struct.pack(">H", len(data) + 2) + data


def gif(w, h, frame=None):
    fw, fh = frame or (w, h)
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0x91, 0, 0) + b"\0" * 12 + b"\x21\xfe\x03abc\x02de\0" + b"\x2c" + struct.pack("<HHHHB", 0, 0, fw, fh, 0) + b"\2\1\0\0;"


def bmp(w, h, core=False):
    head = struct.pack("<IHHHH", 12, w, h, 1, 24) if core else struct.pack("<IiiHH", 40, w, h, 1, 24) + b"\0" * 24
    return b"BM" + struct.pack("<IHHI", 100, 0, 0, 14 + len(head)) + head + b"\0" * 20


def tiff(w, h, order="<", wide=False, kind=3):
    mark = b"II" if order == "<" else b"MM"
    entry = lambda tag, v: struct.pack(order + ("HHQ" if wide else "HHI"), tag, kind, 1) + struct.pack(order + {3: "H", 4: "I", 16: "Q"}[kind], v).ljust(8 if wide else 4, b"\0")
    body = b"".join(entry(t, v) for t, v in ((254, 0), (256, w), (257, h), (258, 8)))
    pixels = b"\0" * 5000  # the directory stands at the end
    if wide:
        return mark + struct.pack(order + "HHHQ", 43, 8, 0, 16 + len(pixels)) + pixels + struct.pack(order + "Q", 4) + body + b"\0" * 8
    return mark + struct.pack(order + "HI", 42, 8 + len(pixels)) + pixels + struct.pack(order + "H", 4) + body + b"\0" * 4


def webp(w, h, kind="VP8X"):
    data = {"VP8X": b"\0\0\0\0" + struct.pack("<I", w - 1)[:3] + struct.pack("<I", h - 1)[:3], "VP8L": b"\x2f" + struct.pack("<I", w - 1 | h - 1 << 14), "VP8 ": b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", w, h)}[kind]
    return b"RIFF" + struct.pack("<I", 12 + len(data)) + b"WEBP" + kind.encode() + struct.pack("<I", len(data)) + data


WHOLE = {
    "a.png": (png(640, 480), "png", 640, 480), "b.jpg": (jpeg(1920, 1080), "jpeg", 1920, 1080), "c.JPEG": (jpeg(31, 17, 0xC2, thumbnail(40) + thumbnail(700)), "jpeg", 31, 17), "d.gif": (gif(33, 44), "gif", 33, 44), "e.gif": (gif(33, 44, (50, 40)), "gif", 50, 44),
    "f.bmp": (bmp(12, 13), "bmp", 12, 13), "g.bmp": (bmp(12, -13), "bmp", 12, 13), "h.bmp": (bmp(5, 6, True), "bmp", 5, 6), "i.tif": (tiff(300, 200), "tiff", 300, 200), "j.tiff": (tiff(70000, 200, ">", kind=4), "tiff", 70000, 200), "k.tif": (tiff(70000, 9, "<", True, 16), "tiff", 70000, 9),
    "l.webp": (webp(16384, 3), "webp", 16384, 3), "m.webp": (webp(401, 301, "VP8L"), "webp", 401, 301), "n.webp": (webp(401, 301, "VP8 "), "webp", 401, 301), "o.png": (jpeg(8, 9), "jpeg", 8, 9),
}
BROKEN = {"p.png": png(9, 9)[:-9], "q.png": png(9, 9).replace(b"IDAT", b"IDAU"), "r.jpg": b"", "s.jpg": b"not an image", "t.jpg": jpeg(0, 5), "u.webp": b"RIFF\0\0\0\0WEBPXXXX" + b"\0" * 30, "v.jpg": b"\xff\xd8\xff\xda\0\2", "w.tif": b"II*\0\xff\xff\xff\x7f" + b"\0" * 40}


def test_headers():
    for name, (content, *expected) in WHOLE.items():
        assert header(content) == tuple(expected), name
        # broken off anywhere, it gives the same or nothing, and never fails
        for n in [*range(0, min(len(content), 120)), len(content) - 1, len(content) // 2]:
            assert header(content[:n]) in (None, tuple(expected)), (name, n)
    for name, content in BROKEN.items():
        assert header(content) is None, name
    rnd = random.Random(1)
    for _ in range(3000):  # any bytes behind any beginning
        begin = rnd.choice([c[: rnd.randrange(2, 30)] for c, *_ in WHOLE.values()])
        header(begin + rnd.randbytes(rnd.randrange(0, 60)))


def test_image_facts(spark, tmp_path):
    import hashlib

    for name, content in [*((n, c) for n, (c, *_) in WHOLE.items()), *BROKEN.items(), ("x.txt", b"no image"), ("y é +%20z.png", b""), ("z a.jpg", png(2, 3)), ("u.txt", b"")]:
        (tmp_path / name).write_bytes(content)
    got = {r["path"].split("/")[-1]: r for r in IO.image_facts(spark, str(tmp_path)).collect()}
    assert set(got) == {*WHOLE, *BROKEN, "y é +%20z.png", "z a.jpg"} and not got["y é +%20z.png"]["readable"]
    for name, (content, *expected) in WHOLE.items():
        assert [got[name][c] for c in ("format", "width", "height", "readable", "sha256")] == [*expected, True, hashlib.sha256(content).hexdigest()]
    assert all(got[n]["readable"] is False and got[n]["width"] is None for n in BROKEN)
    content = spark.read.format("binaryFile").load(str(tmp_path))
    assert "Exchange" not in IO.header_facts(content)._jdf.queryExecution().executedPlan().toString()
    rows = spark.createDataFrame([("a", bytearray(png(3, 4))), ("b", None)], "path string, content binary")
    assert [tuple(r)[2:] for r in IO.header_facts(rows).orderBy("path").collect()] == [("png", 3, 4, True), (None, None, None, False)]
    assert IO.header_facts(rows.limit(0)).count() == 0


# ---- crowded images

BOX = "image_id string, object_index int, xmin double, ymin double, xmax double, ymax double"


def boxes(rnd, images, n, odd=True):
    out = []
    for i in images:
        for k in range(n):
            side = 4 * 10 ** rnd.uniform(0, 4)
            x, y = rnd.uniform(-5000, 60000), rnd.uniform(-5000, 60000)
            out.append((i, k, x, y, x + side, y + side * rnd.uniform(0.2, 1.5)))
    inf = float("inf")
    if odd:
        out += [("a", 1000, 64.0, 64.0, 128.0, 128.0), ("a", 1001, 0.0, 0.0, 64.0, 64.0), ("a", 1002, 5.0, 5.0, 5.0, 9.0), ("a", 1003, None, 1.0, 2.0, 3.0), ("a", 1004, -1e18, -1e18, 1e18, 1e18), ("a", 1005, -inf, 0.0, inf, 10.0), ("a", 1006, 64.0, 64.0, 128.0, 128.0)]
    return out


def plain_pairs(s, d):
    out = {}
    for i, a, x0, y0, x1, y1 in s:
        for j, b, u0, v0, u1, v1 in d:
            if i == j and None not in (x0, u0):
                w, h = min(x1, u1) - max(x0, u0), min(y1, v1) - max(y0, v0)
                if w > 0 and h > 0:
                    union = (x1 - x0) * (y1 - y0) + (u1 - u0) * (v1 - v0) - w * h
                    if union > 0 and w * h / union > 0:
                        out[i, a, b] = w * h / union
    return out


def plain_greedy(pairs):
    used, out = set(), set()
    for (i, a, b), v in sorted(pairs.items(), key=lambda e: (e[1], e[0][1], e[0][2]), reverse=True):
        if (i, "s", a) not in used and (i, "d", b) not in used:
            used |= {(i, "s", a), (i, "d", b)}
            out.add((i, a, b))
    return out


@pytest.mark.parametrize("dense", [0, 2000, 10**9])
def test_pairs_and_matches_of_any_size(spark, dense):
    """The grid, the direct way and their mixture give the pairs that plain loops give, and the same greedy matches."""
    rnd = random.Random(3)
    s, d = boxes(rnd, ["a", "b"], 60), boxes(rnd, ["a", "b"], 70) + [("only", 1, 0.0, 0.0, 1.0, 1.0)]
    s += boxes(rnd, ["small"], 4, odd=False)
    d += boxes(rnd, ["small"], 4, odd=False)
    source, converted = spark.createDataFrame(s, BOX), spark.createDataFrame(d, BOX)
    expected = plain_pairs(s, d)
    rows = M.pair_boxes(source, converted, dense=dense).collect()
    got = {(r["image_id"], r["s_index"], r["d_index"]): r["iou"] for r in rows}
    assert len(rows) == len(got) and set(got) == set(expected) and all(abs(got[k] - v) < 1e-9 for k, v in expected.items())
    matched = {(r["image_id"], r["s_index"], r["d_index"]) for r in M.match_image_boxes(source, converted, dense=dense).collect()}
    assert matched == plain_greedy(got)
    none = source.limit(0)
    assert M.match_image_boxes(none, converted, dense=dense).count() == 0 and M.match_boxes(M.pair_boxes(none, converted, dense=dense)).count() == 0


def test_rounds_equal_the_greedy_order(spark):
    """Ties, a star, and a chain in which every pair waits for the next: the last is walked in order."""
    rnd = random.Random(9)
    pairs = {("tie", a, b): rnd.choice([0.25, 0.5, 0.75]) for a in range(25) for b in range(25) if rnd.random() < 0.5}
    pairs |= {("star", 0, b): 0.5 for b in range(300)}
    pairs |= {("chain", k // 2, (k + 1) // 2): 1 - (k + 1) / 500 for k in range(400)}
    rows = spark.createDataFrame([(*k, v, 0.0) for k, v in pairs.items()], "image_id string, s_index int, d_index int, iou double, delta double")
    for way in (M.match_in_rounds(rows), M.match_in_order(rows), M._walk(rows), M.match_boxes(rows, dense=100)):
        assert {(r["image_id"], r["s_index"], r["d_index"]) for r in way.collect()} == plain_greedy(pairs)


def test_rounds_alone_equal_the_greedy_order(spark):
    rnd = random.Random(19)
    pairs = {("tie", a, b): rnd.choice([0.25, 0.5, 0.75]) for a in range(25) for b in range(25) if rnd.random() < 0.5}
    pairs |= {("chain", k // 2, (k + 1) // 2): 1 - (k + 1) / 500 for k in range(400)}
    rows = spark.createDataFrame([(*k, v, 0.0) for k, v in pairs.items()], "image_id string, s_index int, d_index int, iou double, delta double")
    assert {(r["image_id"], r["s_index"], r["d_index"]) for r in M.match_in_rounds(rows, 0).collect()} == plain_greedy(pairs)


def crowd(rnd, images, n):
    """Small boxes, each with a shifted copy on the other side, and a tenth of page-wide ones; some without a copy."""
    s, d = [], []
    for i in images:
        for k in range(n):
            side = 900.0 if k % 10 == 0 else 8.0
            x, y = float(rnd.randrange(1000)), float(rnd.randrange(1000))
            s.append((i, k, x, y, x + side, y + side))
            if k % 7:
                d.append((i, k, x + side / rnd.choice([4, 8, 16]), y, x + side * 1.1, y + side))
    return s, d


def test_matches_of_a_crowd_dont_need_all_its_pairs(spark, monkeypatch):
    """Most pairs are of a small box in a page-wide one; those are made only of boxes that nothing nearer has taken."""
    s, d = crowd(random.Random(5), ["a", "b"], 300)
    made, rounds = [], M.match_in_rounds

    def counted(pairs, *args):
        made.append(pairs.count())
        return rounds(pairs, *args)

    monkeypatch.setattr(M, "match_in_rounds", counted)
    source, converted = spark.createDataFrame(s, BOX), spark.createDataFrame(d, BOX)
    matched = {(r["image_id"], r["s_index"], r["d_index"]) for r in M.match_image_boxes(source, converted, dense=100).collect()}
    expected = plain_pairs(s, d)
    assert matched == plain_greedy(expected)
    assert sum(made) < len(expected) / 3


def test_boxes_of_a_crowd_are_dealt_out_few_times(spark):
    """The even grid, the grid of levels and plain loops agree; on the even grid, and with a least IoU, no box is copied for
    each level above it."""
    s, d = crowd(random.Random(6), ["a", "b"], 400)
    source, converted = spark.createDataFrame(s, BOX), spark.createDataFrame(d, BOX)
    expected = plain_pairs(s, d)
    read = lambda df: {(r["image_id"], r["s_index"], r["d_index"]) for r in df.collect()}
    assert all(r["is_flat"] for r in M._grids(M._side(source, "s_"), M._side(converted, "d_"), M.CELL, True).collect())
    assert read(M.pair_on_grid(source, converted)) == read(M.pair_on_grid(source, converted, flat=False)) == set(expected)
    for least in (0.25, 1 / 256):
        assert read(M.pair_on_grid(source, converted, least=least)) == read(M.pair_on_grid(source, converted, least=least, flat=False)) == {k for k, v in expected.items() if v >= least}
    # boxes far too unevenly placed for one size of cell: all but one in a corner
    tight = [("c", k, k % 60 * 3.0, k // 60 * 3.0, k % 60 * 3.0 + 4, k // 60 * 3.0 + 4) for k in range(3000)] + [("c", 9999, 1e9, 1e9, 1e9 + 5, 1e9 + 5)]
    rows = spark.createDataFrame(tight, BOX)
    assert not M._grids(M._side(rows, "s_"), M._side(rows, "d_"), M.CELL, True).first()["is_flat"]
    assert M.pair_on_grid(rows, rows).count() == len(plain_pairs(tight, tight))


def test_a_crowded_image_takes_linear_time(spark):
    """10^5 pairs of one image; a page-wide box isn't spread over the small cells it covers."""
    import time

    side = spark.range(0, 50_000).select(F.lit("a").alias("image_id"), F.col("id").cast("int").alias("object_index"), (F.col("id") % 250 * 10).cast("double").alias("xmin"), F.floor(F.col("id") / 250).cast("double").alias("_y"))
    side = side.select("image_id", "object_index", "xmin", (F.col("_y") * 10).alias("ymin"), (F.col("xmin") + 9).alias("xmax"), (F.col("_y") * 10 + 9).alias("ymax"))
    wide = spark.createDataFrame([("a", 99_999, 0.0, 0.0, 1e6, 1e6)], BOX)
    began = time.time()
    got = M.match_image_boxes(side.unionByName(wide), side.unionByName(wide))
    assert got.where("s_index = d_index").count() == 50_001 and got.count() == 50_001
    assert time.time() - began < 120


# ---- masks of thresholds


def plain_masks(preds, truth, thresholds):
    out = {}
    for key in {(p[0], p[1]) for p in preds}:
        own = sorted([p for p in preds if (p[0], p[1]) == key], key=lambda p: (-p[3], p[2]))
        for at, th in enumerate(sorted(thresholds)):
            used = set()
            for p in own:
                best = None
                for t in truth:
                    if (t[0], t[1]) == key and t[2] not in used:
                        v = plain_pairs([("i", 0, *p[4:])], [("i", 0, *t[3:])]).get(("i", 0, 0), 0)
                        if v >= th and (best is None or (v, t[2]) > best):
                            best = (v, t[2])
                if best:
                    used.add(best[1])
                k = (key[0], key[1], p[2])
                out[k] = out.get(k, 0) | bool(best) << at
    return out


def test_masks_serve_all_thresholds(spark):
    rnd = random.Random(11)
    preds, truth = [], []
    for i in range(12):
        for c in (0, 1):
            for k in range(rnd.randrange(0, 9)):
                x, y = rnd.randrange(0, 12), rnd.randrange(0, 12)
                truth.append((f"i{i}", c, k, float(x), float(y), float(x + 20), float(y + 20)))
            for k in range(rnd.randrange(0, 14)):
                x, y = rnd.randrange(0, 12), rnd.randrange(0, 12)
                preds.append((f"i{i}", c, k, rnd.choice([0.1, 0.5, 0.5, 0.9]), float(x), float(y), float(x + 20), float(y + 20)))
    corners = "xmin double, ymin double, xmax double, ymax double"
    p = spark.createDataFrame(preds, f"image_id string, class_id int, pred_id int, confidence double, {corners}")
    t = spark.createDataFrame(truth, f"image_id string, class_id int, truth_id int, {corners}")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # predictions that go on in the next batch
    try:
        rows = X.match_masks(p, t).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows) == len(preds)
    assert {(r["image_id"], r["class_id"], r["pred_id"]): r["hits"] for r in rows} == plain_masks(preds, truth, X.THRESHOLDS)
    assert X.match_masks(p.limit(0), t).count() == 0 and all(r["hits"] == 0 for r in X.match_masks(p, t.limit(0)).collect())
    one, other = X.precision_recall(X.match_predictions(p, t), t), X.precision_recall_of_masks(X.match_masks(p, t), t)
    assert sorted(map(str, one.collect())) == sorted(map(str, other.select(one.columns).collect()))


# ---- running sums


def test_running_sums_and_ranks(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), i, rnd.randrange(-5, 9)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, i int, v long").repartition(5)
    got = sorted(map(tuple, U.running_sums(df, ["k"], [F.desc("i")], {"total": F.col("v"), "n": F.lit(1).cast("long")}).collect()), key=lambda r: -r[1])
    totals, expected = {}, []
    for k, i, v in sorted(rows, key=lambda r: -r[1]):
        t, n = totals.get(k, (0, 0))
        totals[k] = (t + v, n + 1)
        expected.append((k, i, v, *totals[k]))
    assert got == expected
    assert U.ranked(df.limit(0), ["k"], [F.col("i")]).count() == 0


def test_bands_are_even_on_skewed_scores(spark):
    """Most scores lie near 0, as those of detectors do; yet no band holds more than twice the mean."""
    scores = spark.range(0, 200_000, 1, 8).select(F.lit(0).alias("class_id"), F.pow(F.rand(5), F.lit(12.0)).alias("confidence"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in U.banded(scores, ["class_id"], [F.desc("confidence")]).groupBy("_band").count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) >= 12 and max(sizes) <= 2 * 200_000 / len(sizes)
