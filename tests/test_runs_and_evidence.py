"""Scans of split files, exact label texts, publishing of runs, top rows and group texts against plain Python."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from detdata.operators import quality as Q
from detdata.operators import review as R
from detdata.operators import sampling as P
from detdata.sources import files as IO
from detdata.sources import sinks as K


def test_lines_of_split_files_keep_their_numbers(spark, tmp_path):
    """Files that are read in many blocks, with all line ends, beside files that share a task, and ones that aren't UTF-8."""
    rnd = random.Random(5)
    expected = set()
    for name, lines in (("big.txt", 4000), ("b/other.csv", 700), ("small.txt", 3), ("one.txt", 1), ("bad.txt", 500)):
        parts, ends = [], b""
        for no in range(1, lines + 1):
            line = rnd.choice(["", "x" * rnd.randrange(0, 90), "é" * rnd.randrange(0, 30)])
            if rnd.random() < 0.05 or lines < 4:
                line = f"see /home/u{no}/y.png and /tmp/z"
                expected.add((name, no, f"/home/u{no}/y.png"))
            # a carriage return before an empty line's line feed would be one line end
            parts.append((b"\n" if ends == b"\r" and not line else ends) + line.encode())
            ends = rnd.choice([b"\n", b"\r\n", b"\r"])
        parts.append(b"\n")
        data = b"".join(parts)
        if name == "bad.txt":
            data = data[:3000] + b"\n\xff\xfe\n" + data[3000:]
            expected = {e for e in expected if e[0] != name} | {(name, 0, "not UTF-8")}
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    # the plain way: universal line ends
    for name in ("big.txt", "b/other.csv"):
        plain = re.split(r"\r\n|\n|\r", (tmp_path / name).read_bytes().decode())
        assert {(n, no) for n, no, _ in expected if n == name} == {(name, i + 1) for i, line in enumerate(plain) if "/home/" in line}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        rows = Q.scan_path_lines(IO.read_text_blocks(spark, str(tmp_path)))
        blocks = IO.read_text_blocks(spark, str(tmp_path)).select("path", "block").distinct().count()
        got = {(r["path"].split(str(tmp_path) + "/")[1], r["line_no"], r["detail"]) for r in rows.collect()}
        count = rows.count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert blocks > 50 and got == expected and count == len(expected)
    assert Q.scan_path_lines(IO.read_text_blocks(spark, str(tmp_path), "small*")).count() == 3


def test_label_texts_are_exact(spark, tmp_path):
    rnd = random.Random(3)
    values = [0.1, 1 / 3, 1e-5, 1e-300, 1.0, 0.0, -0.0, 123456789.123456789, 1e22, *[rnd.random() for _ in range(200)]]
    rows = [(f"i{k % 9}", k, 0, v, values[-k - 1], v / 3, v * 7) for k, v in enumerate(values)]
    labels = spark.createDataFrame([*rows, ("i0", 999, None, 0.5, 0.5, 0.5, 0.5), ("i0", 1000, 0, None, 0.5, 0.5, 0.5)], "image_id string, line_no int, class_id long, xc double, yc double, w double, h double")
    images = spark.createDataFrame([(f"i{k}", "val" if k % 2 else "train") for k in range(10)], "image_id string, split string")
    K.write_labels(labels, images, str(tmp_path / "out"))
    got = {r["image_id"]: r["label_text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    expected = {f"i{k}": "" for k in range(10)}
    for image, _, c, *numbers in rows:
        expected[image] += f"{c} " + " ".join(f"{x:.17g}" for x in numbers) + "\n"
    assert got == expected
    for image, text in got.items():
        (tmp_path / "txt").mkdir(exist_ok=True)
        (tmp_path / "txt" / f"{image}.txt").write_text(text)
    back = {(r["path"].split("/")[-1][:-4], r["line_no"]): (r["xc"], r["yc"], r["w"], r["h"]) for r in IO.label_boxes(IO.read_label_rows(spark, str(tmp_path / "txt"))).collect()}
    places = {}
    for image, _, _, *numbers in rows:
        places[image] = places.get(image, 0) + 1
        assert back[image, places[image]] == tuple(numbers)
    assert len(back) == len(rows)


def test_published_runs(spark, tmp_path):
    """A half-written run may be replaced, a complete one never, and a failed one leaves nothing."""
    path, table = str(tmp_path / "runs" / "first"), spark.range(5)
    with pytest.raises(RuntimeError), K.published_run(spark, path) as stage:
        table.write.parquet(f"{stage}/part")
        raise RuntimeError("stopped")
    assert not (tmp_path / "runs" / "first").exists() and not list((tmp_path / "runs").glob(".first-*"))
    with K.published_run(spark, path, seed=42, split="test") as stage:
        table.write.parquet(f"{stage}/part")
        assert not (tmp_path / "runs" / "first").exists()
    assert K.is_complete(spark, path) and spark.read.parquet(f"{path}/part").count() == 5
    assert json.loads((tmp_path / "runs" / "first" / K.COMPLETE).read_text()) == {"seed": 42, "split": "test"}
    for overwrite in (False, True):
        with pytest.raises(FileExistsError, match="complete"), K.published_run(spark, path, overwrite=overwrite) as stage:
            raise AssertionError("the block must not run")
    half = tmp_path / "runs" / "half"
    half.mkdir()
    (half / "old.txt").write_text("left over")
    with pytest.raises(FileExistsError, match="unfinished"), K.published_run(spark, str(half)):
        pass
    assert (half / "old.txt").exists()
    with pytest.raises(RuntimeError), K.published_run(spark, str(half), overwrite=True):
        raise RuntimeError("stopped again")
    assert (half / "old.txt").exists() and not K.is_complete(spark, str(half))
    with K.published_run(spark, str(half), overwrite=True) as stage:
        table.write.parquet(f"{stage}/part")
    assert K.is_complete(spark, str(half)) and not (half / "old.txt").exists() and spark.read.parquet(f"{half}/part").count() == 5
    # of two writers of one name the second gives way
    race = str(tmp_path / "runs" / "race")
    with pytest.raises(FileExistsError), K.published_run(spark, race) as stage:
        with K.published_run(spark, race) as other:
            table.write.parquet(f"{other}/part")
        spark.range(9).write.parquet(f"{stage}/part")
    assert spark.read.parquet(f"{race}/part").count() == 5 and not list((tmp_path / "runs").glob(".race-*"))


def test_top_rows_of_all_rules_in_one_scan(spark):
    rnd = random.Random(4)
    rows = [(f"i{k:04}", rnd.choice([None, 0, 1, 2, 3]), rnd.choice([0, 0, 0, 1]) if k % 400 == 0 else 0, rnd.choice([None, 1.5, 2.5, float("nan")]), rnd.random()) for k in range(1500)]
    df = spark.createDataFrame(rows, "image_id string, object_count long, small_box_count long, largest_area double, largest_aspect double").repartition(6)
    got = sorted(map(tuple, P.top_by_risk(df).collect()))
    expected = []
    for no, (reason, column, k, positive) in enumerate(P.RISK_RULES):
        at = df.columns.index(column)
        known = lambda v: v is not None and v == v
        order = sorted(rows, key=lambda r: (not known(r[at]), -(r[at] if known(r[at]) else 0), r[0]))[:k]
        expected += [(no, r[0], reason, i + 1) for i, r in enumerate(order) if not positive or (known(r[at]) and r[at] > 0)]
    assert got == sorted(expected)
    plan = P.top_by_risk(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan
    assert P.top_by_risk(df.limit(0)).count() == 0


def test_group_texts(spark):
    """Texts of a group in chunks, whatever its size; joined they are the text of the report."""
    rows = [("big", f"i{k:06}", "train", k % 5, "f", 10, 20, 10, 20) for k in range(50_000)] + [("two", "x", "val", 1, "f", 1, 2, 3, 4), ("two", "w", "train", 2, "g", 1, 2, 3, 4), ("twice", "s", "val", 2, "f", 1, 1, 1, 1), ("twice", "s", "val", 1, "f", 1, 1, 1, 1)]
    members = spark.createDataFrame(rows, "group string, image_id string, split string, object_count long, fingerprint string, xml_width int, xml_height int, width int, height int").repartition(8)
    out = R.duplicate_group_texts(members, 1000)
    got = {(r["group"], r["chunk_no"]): r for r in out.collect()}
    assert sorted(n for g, n in got if g == "big") == list(range(50)) and all(r["members"] == 1000 for (g, _), r in got.items() if g == "big")
    whole = ";".join(got["big", n]["object_counts"] for n in range(50))
    assert whole == ";".join(f"i{k:06}:{k % 5}" for k in range(50_000))
    assert got["two", 0]["image_ids"] == "w;x" and got["two", 0]["object_counts"] == "w:2;x:1" and got["two", 0]["first_id"] == "w" and got["two", 0]["last_id"] == "x"
    assert got["twice", 0]["object_counts"] == "s:1;s:2"
    agreed = {r["group"]: r for r in R.group_agreement(members).collect()}
    assert agreed["big"]["members"] == 50_000 and agreed["big"]["identical_annotations"] and not agreed["two"]["one_split"] and agreed["two"]["splits"] == ["train", "val"]
    report = {r["group"]: r for r in R.compare_duplicate_annotations(members.where("`group` != 'twice'")).collect()}
    assert report["big"]["image_ids"] == ";".join(got["big", n]["image_ids"] for n in range(50)).split(";")
    compared = members.select("group", "image_id", F.col("object_count").alias("source_count"))
    texts = {(r["group"], r["chunk_no"]): r["group_object_counts"] for r in R.group_object_count_texts(compared, 7).collect()}
    assert texts["two", 0] == R.with_group_object_counts(compared.where("`group` = 'two'")).first()["group_object_counts"]
    assert R.duplicate_group_texts(members.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["apart", "alike", "mixed"])
def test_split_list_representatives(spark, kind):
    """Lists that share few ids, lists that are all the same (walked in order), and anything between."""
    rnd = random.Random(kind)
    if kind == "alike":
        lists = {f"l{k:02}": [f"i{i:03}" for i in range(25)] for k in range(40)}
    else:
        lists = {f"l{k:02}": [f"i{rnd.randrange(400 if kind == 'apart' else 30):03}" for _ in range(rnd.randrange(1, 12))] for k in range(25)}
    lists["none"] = [None]
    lists["z"] = [None, "i000", "i001"]
    rows = [(n, i) for n, ids in lists.items() for i in ids]
    taken, expected = set(), {}
    for name in sorted(lists):
        own = sorted({i for i in lists[name] if i is not None})
        pick = next((i for i in own if i not in taken), own[0] if own else None)
        expected[name] = pick
        taken.add(pick)
    df = spark.createDataFrame([*rows, *rows[:5]], "list_name string, image_id string")
    assert {r["list_name"]: r["image_id"] for r in P.split_list_representatives(df).collect()} == expected
    assert P.split_list_representatives(df.limit(0)).count() == 0
