"""Unit cases of the reference's behaviour and hand-made edges."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from detdata.functions import scalars as S
from detdata.functions.geometry import box, conversion_error, voc_to_yolo
from detdata.operators import audit as A
from detdata.operators import matching as M
from detdata.operators import metrics as X
from detdata.operators import quality as Q
from detdata.operators import review as R
from detdata.operators import sampling as P
from detdata.operators import split as G
from detdata.sources import files as IO
from detdata.sources import sinks as K

BOX = "image_id string, object_index int, xmin double, ymin double, xmax double, ymax double"
LABEL = "image_id string, line_no int, n_values int, class_id long, xc double, yc double, w double, h double, width int, height int"


def labels(spark, *rows):
    return spark.createDataFrame([("a", i + 1, 5, *r, 100, 100) for i, r in enumerate(rows)], LABEL)


def test_normalise_and_out_of_image(spark):
    df = spark.createDataFrame([("a", 1, 10.0, 20.0, 30.0, 60.0), ("b", 1, 0.0, 0.0, 101.0, 10.0)], BOX).withColumns({"width": F.lit(100), "height": F.when(F.col("image_id") == "a", 200).otherwise(100)})
    a, b = df.select(*[v.alias(k) for k, v in voc_to_yolo(box(), F.col("width"), F.col("height")).items()], conversion_error(box(), F.col("width"), F.col("height")).alias("e")).collect()
    assert [round(a[c], 12) for c in ("xc", "yc", "w", "h")] == [0.2] * 4 and a["e"] is None
    assert b["xc"] is None and "exceeds" in b["e"]


def test_round_trip_and_label_errors(spark):
    good = Q.label_row_errors(labels(spark, (0, 0.2, 0.4, 0.2, 0.4))).first()
    assert good["errors"] == [] and good["is_box"]
    bad = Q.label_row_errors(labels(spark, (0, 1.1, 0.5, 0.2, 0.2), (1, 0.15, 0.15, 0.1, 0.1), (0, float("nan"), 0.5, 0.1, 0.1))).collect()
    assert bad[0]["errors"][0] == "invalid_normalized_coordinate_line_1" and bad[0]["is_box"]
    assert bad[1]["errors"] == ["invalid_class_id_line_2"]
    assert "invalid_normalized_coordinate_line_3" in bad[2]["errors"]


def test_match_tolerance_and_ties(spark):
    s = spark.createDataFrame([("a", 0, 100.0, 100.0, 1100.0, 1100.0), ("b", 0, 0.0, 0.0, 10.0, 10.0), ("b", 1, 0.0, 0.0, 10.0, 10.0)], BOX)
    d = spark.createDataFrame([("a", 0, 101.0, 100.0, 1101.0, 1100.0), ("b", 0, 0.0, 0.0, 10.0, 10.0)], BOX)
    m = {(r["image_id"], r["s_index"]): r for r in M.match_boxes(M.pair_boxes(s, d)).collect()}
    assert m["a", 0]["iou"] >= 0.99 and m["a", 0]["delta"] == 1.0
    assert ("b", 1) in m and ("b", 0) not in m  # ties prefer the higher index


def facts(spark, **change):
    row = {"image_id": "a", "split": "train", "small_box_count": 0, "has_xml": True, "has_source": True, "has_converted": True, "has_label": True, "src_readable": True, "conv_readable": True} | {f"{p}{d}": 100 for p in ("src_", "xml_", "conv_") for d in ("width", "height")} | {"duplicate_count_differs": False, "duplicate_crosses_split": False, "in_several_splits": False} | change
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'int' if isinstance(v, int) else 'string'}" for k, v in row.items()))


def source(spark, *boxes):
    return spark.createDataFrame([("a", i + 1, *map(float, b)) for i, b in enumerate(boxes)], BOX)


def test_review_verdicts(spark):
    one = source(spark, (10, 10, 20, 20))
    run = lambda f, s, rows: R.review_records(f, s, rows, 5.0).first()
    r = run(facts(spark), one, labels(spark, (0, 0.15, 0.15, 0.1, 0.1)))
    assert r["status"] == "PASS" and r["reasons"] == []
    r = run(facts(spark), one, labels(spark, (0, 0.15, 0.15, 0.1, 0.1)).limit(0))
    assert r["status"] == "REJECT" and r["reasons"] == ["source_and_converted_object_counts_differ", "unmatched_source_or_converted_boxes"]
    r = run(facts(spark), one, labels(spark, (0, 0.85, 0.85, 0.1, 0.1)))
    assert r["reasons"] == ["unmatched_source_or_converted_boxes"]
    r = run(facts(spark), one, labels(spark, (1, 0.15, 0.15, 0.1, 0.1)))
    assert r["status"] == "REJECT" and r["reasons"] == ["invalid_class_id_line_1"]
    r = run(facts(spark, conv_width=99), one, labels(spark, (0, 0.15, 0.15, 0.1, 0.1)))
    assert "source_xml_and_converted_dimensions_conflict" in r["reasons"]
    r = run(facts(spark, duplicate_crosses_split=True, duplicate_count_differs=True), one, labels(spark, (0, 0.15, 0.15, 0.1, 0.1)))
    assert r["reasons"] == ["duplicate_group_crosses_splits", "duplicate_group_annotation_counts_differ"]


def test_split_trace(spark):
    rows = [("a", 10, 1, "hash-a"), ("b", 5, 0, "hash-a"), ("c", 8, 2, ""), ("d", 3, 0, ""), ("e", 4, 1, ""), ("f", 2, 0, ""), ("g", 1, 0, "")]
    items = spark.createDataFrame(rows, "image_id string, object_count long, small_box_count long, duplicate_group_id string")
    want = {"a": "test", "b": "test", "c": "train", "d": "train", "e": "val", "f": "train", "g": "train"}
    for df in (items, items.orderBy(F.desc("image_id"))):
        got = G.assign_splits(df, {"train": 0.7, "val": 0.15, "test": 0.15})
        assert {r["image_id"]: r["split"] for r in got.collect()} == want
        G.check_split_invariants(df, got)
    with pytest.raises(ValueError):
        G.validate_ratios({"train": 0.7, "val": 0.2, "test": 0.2})
    with pytest.raises(ValueError):
        G.require_items(items.unionByName(items))


def test_split_exact_against_plain_fold(spark):
    rnd = random.Random(5)
    rows = [(f"i{k}", rnd.randrange(6), rnd.randrange(3), f"g{rnd.randrange(60)}" if k % 3 == 0 else "") for k in range(400)]
    ratios, names = {"train": 0.7, "val": 0.15, "test": 0.15}, ("test", "train", "val")
    groups = {}
    for i, o, s, g in rows:
        v = groups.setdefault(g or f"single:{i}", [0, 0, 0])
        v[0] += 1
        v[1] += o
        v[2] += s
    total = [sum(v[j] for v in groups.values()) for j in range(3)]
    held, want = {n: [0, 0, 0] for n in names}, {}
    for key, v in sorted(groups.items(), key=lambda kv: (-kv[1][1], -kv[1][0], -kv[1][2], kv[0])):
        best = min(names, key=lambda n: (sum(w * h / max(t * ratios[n], 1.0) for w, h, t in zip((4, 1, 1), held[n], total, strict=True)), n))
        held[best] = [h + x for h, x in zip(held[best], v, strict=True)]
        want[key] = best
    items = spark.createDataFrame(rows, "image_id string, object_count long, small_box_count long, duplicate_group_id string")
    for chunk in (G.CHUNK, 7):  # all groups of a profile at once, or in several chunks
        got = {r["image_id"]: r["split"] for r in G.assign_splits(items, ratios, chunk).collect()}
        assert got == {i: want[g or f"single:{i}"] for i, _, _, g in rows}
    with pytest.raises(ValueError):
        G.assign_splits(items.unionByName(items), ratios)


def test_filling_against_picks_one_by_one():
    rnd = random.Random(6)
    for _ in range(30):
        held = {s: tuple(rnd.randrange(2000) for _ in range(3)) for s in G.SPLITS}
        target, step = G._at_least_one({s: tuple(rnd.choice((0.0, 700.0, 1e4, 1e9)) for _ in range(3)) for s in G.SPLITS}), (rnd.randrange(1, 4), rnd.randrange(9), rnd.randrange(2))
        f, count = G._Filling(target, held, step), dict.fromkeys(G.SPLITS, 0)
        for n in range(150):
            assert f.after(n) == count
            count[min(G.SPLITS, key=lambda s: (f.used(s, count[s]), s))] += 1  # noqa: B023
    big = G._Filling(G._at_least_one(dict.fromkeys(G.SPLITS, (1e9, 1e9, 1e9))), dict.fromkeys(G.SPLITS, (0, 0, 0)), (1, 3, 1))
    assert sum(big.after(10**9).values()) == 10**9  # without walking there


def test_pass_sample(spark):
    rows = [(f"{s}{i}", s) for s, n in (("train", 5), ("val", 4), ("test", 4)) for i in range(n)]
    df = spark.createDataFrame(rows, "image_id string, split string")
    take = lambda: sorted((r["split"], r["image_id"]) for r in P.seeded_sample_per_split(df, {"train": 4, "val": 3, "test": 3}, 1, strict=True).collect())
    assert take() == take() and len(take()) == 10
    with pytest.raises(ValueError):
        P.seeded_sample_per_split(df, {"train": 9}, 1, strict=True)


def test_duplicate_listing_is_whole(spark):
    rows = [("g", f"i{k:05d}", "train", k, "f", 640, 480, 640, 480 + k % 2) for k in range(2500)] + [("h", "a", "val", 1, "f", 640, 480, 640, 480)]
    members = spark.createDataFrame(rows, "group string, image_id string, split string, object_count long, fingerprint string, width int, height int, xml_width int, xml_height int")
    got = {r["group"]: r for r in R.compare_duplicate_annotations(members).collect()}
    assert got["g"]["object_counts"] == {r[1]: r[3] for r in rows if r[0] == "g"} and got["g"]["image_ids"] == [r[1] for r in rows[:-1]]
    assert got["g"]["xml_dimensions"]["i00003"] == [640, 481] and got["g"]["image_dimensions_consistent"] and not got["g"]["xml_dimensions_consistent"] and got["h"]["xml_dimensions_consistent"]
    assert got["h"]["object_counts"] == {"a": 1}


def test_list_representatives(spark):
    lists = {f"l{k:04d}": [f"i{(k * 7 + j * j) % 1300:04d}" for j in range(3)] for k in range(1200)}  # more than 1000 lists
    lists |= {f"m{k}": [f"j{j}" for j in range(5)] for k in range(7)}  # all taken in the end
    df = spark.createDataFrame([(n, i) for n, ids in lists.items() for i in ids], "list_name string, image_id string")

    def want(names):
        taken, out = set(), {}
        for n in sorted(names):
            out[n] = min([i for i in lists[n] if i not in taken] or lists[n])
            taken.add(out[n])
        return out

    assert dict(P.split_list_representatives(df).collect()) == want(lists)
    few = df.where("list_name like 'm%'")
    assert dict(P.split_list_representatives(few).collect()) == want([n for n in lists if n[0] == "m"])


def test_audit_references(spark):
    images = spark.createDataFrame([("x/lesion.png",), ("x/orphan.jpg",)], "path string")
    refs = spark.createDataFrame([("Annotations/sample.xml", "lesion.jpg", "/unused/lesion.jpg"), ("b.xml", "", None)], "xml_path string, filename string, path string")
    r = A.resolve_images(refs, images)
    assert A.find_extension_mismatches(r).first()["path"] == "Annotations/sample.xml"
    assert [x["path"] for x in A.find_missing_annotations(images, r).collect()] == ["x/orphan.jpg"]
    assert [x["path"] for x in A.find_missing_images(r).collect()] == ["b.xml"]


def test_numbers(spark):
    texts = ["nan", "inf", "1_0", "1.0d", "20.0", " 20 ", "", None, "-5", "1e400"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(S.parse_number(F.col("t")).alias("n"), S.parse_positive_integer(F.col("t")).alias("p"), S.parse_strict_int(F.col("t")).alias("s")).collect()
    assert [r["n"] for r in rows] == [None, None, 10.0, None, 20.0, 20.0, None, None, -5.0, None]
    assert [r["p"] for r in rows] == [None, None, 10, None, 20, 20, None, None, None, None]
    assert [r["s"] for r in rows] == [None, None, 10, None, None, 20, None, None, -5, None]


def png(width, height):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + b"\0" * (3 * width) for _ in range(height)))) + chunk(b"IEND", b"")


def test_files(spark, tmp_path):
    (tmp_path / "img").mkdir()
    (tmp_path / "img/a.PNG").write_bytes(png(20, 10))
    (tmp_path / "img/bad.png").write_bytes(b"not an image")
    (tmp_path / "img/note.md").write_text("x")
    facts = {r["path"].split("/")[-1]: r for r in IO.image_facts(spark, str(tmp_path / "img")).collect()}
    assert (facts["a.PNG"]["width"], facts["a.PNG"]["height"], facts["a.PNG"]["readable"]) == (20, 10, True)
    assert facts["bad.png"]["readable"] is False and len(facts["bad.png"]["sha256"]) == 64 and "note.md" not in facts
    assert IO.scan_images(spark, str(tmp_path / "img")).count() == 2

    (tmp_path / "xml").mkdir()
    (tmp_path / "xml/a.xml").write_text("<annotation><filename>a.png</filename><size><width>20</width><height>10</height></size><object><name>fore</name><bndbox><xmin>1</xmin><ymin>1</ymin><xmax>12</xmax><ymax>9</ymax></bndbox></object></annotation>")
    (tmp_path / "xml/b.xml").write_text("<annotation><oops>")
    ann = IO.read_voc_annotations(spark, str(tmp_path / "xml"))
    assert {r["image_id"]: r["_corrupt_record"] is not None for r in ann.collect()} == {"a": False, "b": True}
    b = IO.explode_boxes(ann).first()
    assert (b["object_index"], b["class_name"], b["xmax"]) == (1, "fore", "12")

    (tmp_path / "lab").mkdir()
    (tmp_path / "lab/a.txt").write_text("0 0.5 0.5 0.1 0.1\n\n1 2 3\n")
    (tmp_path / "lab/empty.txt").write_text("")
    rows = IO.label_boxes(IO.read_label_rows(spark, str(tmp_path / "lab"))).orderBy("line_no").collect()
    assert [(r["line_no"], r["n_values"]) for r in rows] == [(1, 5), (2, 0), (3, 3)]

    (tmp_path / "m.csv").write_text("image_id,split\na,train\n")
    assert IO.read_manifest(spark, str(tmp_path / "m.csv"), ("image_id",)).count() == 1
    with pytest.raises(ValueError):
        IO.read_manifest(spark, str(tmp_path / "m.csv"), ("label_path",))
    (tmp_path / "lists").mkdir()
    (tmp_path / "lists/NNEW_test_0.txt").write_text("a.jpg 1 2\n\nb.jpg 0\n")
    assert sorted(r["image_id"] for r in IO.read_split_lists(spark, str(tmp_path / "lists")).collect()) == ["a", "b"]
    found = spark.createDataFrame([("a", "img/a.png")], "image_id string, path string")
    (tmp_path / "audit.json").write_text('{"summary": {}, "findings": {"duplicate_images": [{"path": "x/a.png", "detail": "Duplicate SHA-256 group: ' + "ab" * 32 + '."}]}}')
    r = IO.read_audit_duplicates(spark, str(tmp_path / "audit.json"), found).first()
    assert (r["image_id"], r["duplicate_group_id"]) == ("a", "ab" * 32)
    for wrong, what in (("x/b.png", "Duplicate SHA-256 group: " + "ab" * 32 + "."), ("x/a.png", "group " + "ab" * 32)):
        (tmp_path / "audit.json").write_text('{"findings": {"duplicate_images": [{"path": "' + wrong + '", "detail": "' + what + '"}]}}')
        with pytest.raises(ValueError):
            IO.read_audit_duplicates(spark, str(tmp_path / "audit.json"), found)
    (tmp_path / "e.csv").write_text("epoch, metrics/mAP50(B)\n1,0.5\n2,x\n")
    e = IO.read_epoch_results(spark, str(tmp_path / "e.csv"), {"map50": ("mAP50", "metrics/mAP50(B)")}).collect()
    assert [r["map50"] for r in e] == [0.5, None]
    (tmp_path / "prev.csv").write_text("image_id,review_status,reviewer_notes\na,x,\na,y,n\n,z,\n")
    assert [tuple(r) for r in IO.read_previous_review(spark, str(tmp_path / "prev.csv")).collect()] == [("a", "y", "n")]
    assert IO.provenance(spark, [str(tmp_path / "m.csv")]).count() == 1

    found = A.finding(spark.createDataFrame([("p",)], "path string"), "corrupt_images", F.col("path"), F.lit("d"))
    K.write_findings(found, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out/corrupt_images"), header=True).count() == 1
    with pytest.raises(Exception, match="(?i)exists"):
        K.write_findings(found, str(tmp_path / "out"))
    lab = spark.createDataFrame([("a", 2, 0, 0.5, 0.5, 0.1, 0.1), ("a", 1, 0, 0.25, 0.5, 0.1, 0.1)], "image_id string, line_no int, class_id int, xc double, yc double, w double, h double")
    im = spark.createDataFrame([("a", "train"), ("b", "val")], "image_id string, split string")
    assert {r["image_id"]: r["label_text"] for r in K.label_texts(lab, im).collect()} == {"a": "0 0.25 0.5 0.10000000000000001 0.10000000000000001\n0 0.5 0.5 0.10000000000000001 0.10000000000000001\n", "b": ""}
    K.write_labels(lab, im, str(tmp_path / "labels"))
    bad = spark.createDataFrame([("f", b"ok\nsee /home/me/x"), ("g", b"\xff\xfe")], "path string, content binary")
    assert sorted((r["path"], r["line_no"]) for r in Q.scan_absolute_paths(bad).collect()) == [("f", 2), ("g", 0)]


def test_pairs_and_metrics(spark):
    stems = lambda n: spark.createDataFrame([(f"s{i}",) for i in range(n)], "stem string")
    Q.require_pairs(stems(216), stems(216).withColumn("n_lines", F.lit(1)), 216)
    with pytest.raises(ValueError):
        Q.require_pairs(stems(216), stems(215).withColumn("n_lines", F.lit(1)), 216)
    e = spark.createDataFrame([("r", 1, 0.0), ("r", 2, None), ("r", 3, 0.3), ("r", 4, 0.3)], "run string, epoch int, m double")
    assert X.best_epoch(e, "m").first()["epoch"] == 3
    gap = X.generalisation_gap(spark.createDataFrame([("P", 0.30448)], "metric string, value double"), spark.createDataFrame([("P", 0.3051066360)], "metric string, value double")).first()
    assert round(gap["change_percent"], 2) == 0.21
    t = spark.createDataFrame([("a", 0, 1, 0.0, 0.0, 10.0, 10.0), ("a", 0, 2, 50.0, 50.0, 60.0, 60.0)], "image_id string, class_id int, truth_id int, xmin double, ymin double, xmax double, ymax double")
    p = spark.createDataFrame([("a", 0, 1, 0.9, 0.0, 0.0, 10.0, 10.0), ("a", 0, 2, 0.8, 200.0, 0.0, 210.0, 10.0)], "image_id string, class_id int, pred_id int, confidence double, xmin double, ymin double, xmax double, ymax double")
    d = X.detection_metrics(p, t).first()
    assert d["precision"] == 1.0 and d["recall"] == 0.5 and round(d["map50"], 6) == round(51 / 101, 6)


def test_incoming_labels(spark, tmp_path):
    from detdata.streaming.labels import write_label_errors

    images = spark.createDataFrame([("a", 100, 100), ("b", 100, 100)], "image_id string, width int, height int")
    (tmp_path / "in").mkdir()
    for name, text in (("a", "1 0.5 0.5 0.1 0.1\n"), ("b", "0 0.5 0.5 0.1 0.1\n")):
        (tmp_path / f"in/{name}.txt").write_text(text)
        write_label_errors(spark, str(tmp_path / "in"), images, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a", 1, "invalid_class_id_line_1")]


def test_entry_without_llm(tmp_path):
    """The driver entry still imports and lists the core queries when the subpackage llm is gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "detdata", tmp_path / "detdata", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'review_records' in q and not any(k.startswith('op') for k in q); print(len(q))"
    assert int(subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout) > 60
