"""The whole job over real files: audit, conversion, split, check, publishing."""

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from detdata.jobs import dataset as D
from detdata.operators import split as G
from detdata.sources import files as IO
from detdata.sources import sinks as K

RATIOS = {"train": 0.5, "val": 0.25, "test": 0.25}


def png(w, h, note=b""):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"tEXt", b"n\0" + note) + chunk(b"IDAT", b"x") + chunk(b"IEND", b"")


def xml(name, w, h, boxes, kind="fore"):
    objects = "".join(f"<object><name>{kind}</name><bndbox><xmin>{a}</xmin><ymin>{b}</ymin><xmax>{c}</xmax><ymax>{d}</ymax></bndbox></object>" for a, b, c, d in boxes)
    return f"<annotation><filename>{name}</filename><size><width>{w}</width><height>{h}</height></size>{objects}</annotation>"


def write(root, n=12):
    """n images, of which 0 and 1 are copies; boxes of which every fifth is small."""
    (root / "img").mkdir(parents=True)
    (root / "xml").mkdir()
    for i in range(n):
        w, h = 100 + 10 * max(i, 1), 80
        (root / f"img/p{i}.png").write_bytes(png(w, h, b"copy" if i < 2 else str(i).encode()))
        boxes = [(k + 1, 3, k + (5 if k % 5 == 0 else 40), 60) for k in range(i % 4)]
        (root / f"xml/p{i}.xml").write_text(xml(f"p{i}.png", w, h, boxes))


def test_whole_job(spark, tmp_path):
    write(tmp_path)
    out = str(tmp_path / "runs/one")
    D.prepare(spark, str(tmp_path / "img"), str(tmp_path / "xml"), out, RATIOS)
    assert K.is_complete(spark, out)
    manifest = {r["image_id"]: r for r in IO.read_manifest(spark, f"{out}/manifest", K.MANIFEST_COLUMNS).collect()}
    assert len(manifest) == 12 and {r["split"] for r in manifest.values()} == {"train", "val", "test"}
    assert manifest["p0"]["split"] == manifest["p1"]["split"] and len(manifest["p0"]["duplicate_group_id"]) == 64 and manifest["p2"]["duplicate_group_id"] == ""
    assert {i: int(r["object_count"]) for i, r in manifest.items()} == {f"p{i}": i % 4 for i in range(12)}
    labels = {r["image_id"]: r["label_text"] for r in spark.read.parquet(f"{out}/labels").collect()}
    x = [(k + 1, 3, k + (5 if k % 5 == 0 else 40), 60) for k in range(3)]
    assert labels["p3"] == "".join(f"0 {(a + c) / 2 / 130:.17g} {(b + d) / 2 / 80:.17g} {(c - a) / 130:.17g} {(d - b) / 80:.17g}\n" for a, b, c, d in x) and labels["p4"] == ""
    report = spark.read.text(f"{out}/audit/report").collect()
    summary = next(json.loads(r["value"])["summary"] for r in report if "summary" in json.loads(r["value"]))
    assert summary["total_images"] == 12 and summary["total_annotated_objects"] == 18 and summary["object_class_counts"] == {"fore": 18} and summary["duplicate_images"] == 2 and summary["very_small_bounding_boxes"] == 9
    duplicates = IO.read_audit_duplicates(spark, f"{out}/audit/report", spark.createDataFrame([(f"p{i}", f"p{i}.png") for i in range(12)], "image_id string, path string"), lines=True).collect()
    assert sorted(r["image_id"] for r in duplicates) == ["p0", "p1"]
    readiness = {(r["metric"], r["key"]): r["value"] for r in spark.read.json(f"{out}/readiness").collect()}
    assert readiness["images_checked", ""] == 12 and readiness["objects_checked", ""] == readiness["source_objects_checked", ""] == 18 and readiness["status", "REJECT"] == 0
    # p0 has no box, but a copy with another count
    assert readiness["status", "NEEDS_REVIEW"] == 10 and readiness["reason", "contains_very_small_box"] == 9
    assert all(readiness[m, ""] == 0 for m in ("label_errors", "split_leaks", "absolute_paths", "count_mismatches", "invalid_splits"))
    reviews = {r["image_id"]: r for r in spark.read.csv(f"{out}/reviews/all", header=True).collect()}
    assert "duplicate_group_annotation_counts_differ" in reviews["p1"]["automated_reasons"] and reviews["p1"]["source_xml_path"] == "source/p1.xml" and reviews["p4"]["automated_status"] == "PASS"
    plain = G.assign_splits(spark.createDataFrame([(f"p{i}", i % 4, int(i % 4 > 0), manifest[f"p{i}"]["duplicate_group_id"]) for i in range(12)], "image_id string, object_count long, small_box_count long, duplicate_group_id string"), RATIOS)
    assert {r["image_id"]: r["split"] for r in plain.collect()} == {i: r["split"] for i, r in manifest.items()}
    with pytest.raises(FileExistsError):
        D.prepare(spark, str(tmp_path / "img"), str(tmp_path / "xml"), out, RATIOS, overwrite=True)


def test_a_failure_stops_the_job(spark, tmp_path):
    """An image that can't be converted, of whatever kind, leaves no run; the audit names each fault."""
    write(tmp_path, 4)
    (tmp_path / "img/bad.png").write_bytes(b"no image")
    (tmp_path / "xml/bad.xml").write_text(xml("bad.png", 10, 10, []))
    (tmp_path / "xml/gone.xml").write_text(xml("gone.png", 10, 10, []))
    (tmp_path / "xml/out.xml").write_text(xml("p2.jpg", 120, 80, [(1, 1, 500, 9)]))
    (tmp_path / "xml/broken.xml").write_text("<annotation><oops>")
    (tmp_path / "img/alone.png").write_bytes(png(5, 5, b"alone"))
    source = D.read_source(spark, str(tmp_path / "img"), str(tmp_path / "xml"))
    D.audit(source, str(tmp_path / "audit"))
    found = spark.read.json(str(tmp_path / "audit/summary"))
    counts = {r["metric"]: r["value"] for r in found.where(F.col("key") == "").collect()}
    assert [counts[c] for c in ("missing_images", "missing_xml", "extension_mismatches", "invalid_annotations", "invalid_boxes", "corrupt_images", "duplicate_images")] == [1, 1, 1, 1, 1, 1, 2]
    with pytest.raises(ValueError, match="images fail"):
        D.prepare(spark, str(tmp_path / "img"), str(tmp_path / "xml"), str(tmp_path / "run"), RATIOS)
    assert not (tmp_path / "run").exists()
