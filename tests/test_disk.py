"""What stays on the disk when a step has ended."""

import gc
import os
import time

from pyspark.sql import functions as F

from detdata.operators import matching as M
from detdata.operators import review as R
from detdata.sources import sinks as K
from detdata.storage import freed, new_path, passing, scratch, written


def shuffles(spark):
    return {f for _, _, names in os.walk(spark.conf.get("spark.local.dir")) for f in names if f.startswith("shuffle_") and f.endswith(".data")}


def gone(spark, before):
    """Does nothing hold on to shuffle files that are new since `before`."""
    end = time.time() + 20
    while shuffles(spark) - before and time.time() < end:
        gc.collect()
        freed(spark)
        time.sleep(0.2)
    return not shuffles(spark) - before


def tables(spark):
    return set(os.listdir(os.path.dirname(new_path(spark, "x")).removeprefix("file:")))


def test_a_step_that_has_ended_leaves_its_result_only(spark):
    before, had = shuffles(spark), tables(spark)
    with passing(spark) as lasting:
        a = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "a")
        b = lasting(a.groupBy().agg(F.sum("count").alias("n")), "b")
    assert b.first()["n"] == 1000 and gone(spark, before) and len(tables(spark) - had) == 1
    with scratch(spark):
        with passing(spark) as lasting:
            b = lasting(written(spark.range(5), "a"), "b")
        assert b.count() == 5
    assert len(tables(spark) - had) == 1
    t = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "t")
    freed(spark)
    assert t.count() == 7


def some(spark):
    images = spark.createDataFrame([("a",), ("b",), ("c",)], "image_id string")
    source = spark.createDataFrame([("a", 1, 0.0, 0.0, 10.0, 10.0), ("a", 2, 20.0, 20.0, 50.0, 50.0), ("b", 1, 0.0, 0.0, 30.0, 30.0)], "image_id string, object_index int, xmin double, ymin double, xmax double, ymax double")
    labels = [("a", 1, 5, 0, 0.05, 0.05, 0.1, 0.1, 100, 100), ("a", 2, 5, 0, 0.35, 0.35, 0.3, 0.3, 100, 100), ("b", 1, 4, 0, 0.1, 0.1, 0.1, None, 100, 100)]
    return images, source, spark.createDataFrame(labels, "image_id string, line_no int, n_values int, class_id long, xc double, yc double, w double, h double, width int, height int")


def test_evidence_of_boxes_leaves_one_table(spark):
    images, source, labels = some(spark)
    before, had = shuffles(spark), tables(spark)
    got = R.box_evidence(images, source, labels, 10.0)
    assert len(tables(spark) - had) == 1 and gone(spark, before)
    rows = {r["image_id"]: r for r in got.collect()}
    assert [(rows[i]["source_count"], rows[i]["converted_count"], rows[i]["unmatched_source"], rows[i]["small"], rows[i]["label_errors"]) for i in "abc"] == [(2, 2, 0, 1, []), (1, 0, 1, 0, ["label_line_1_does_not_have_five_values"]), (0, 0, 0, 0, [])]


def test_small_images_are_one_cell_of_the_grid(spark):
    """No box is copied for the cells that it lies in, and the sides are read from tables, not worked out again."""
    rows = [(f"i{k % 50}", k, 60.0 + k % 7, 60.0, 70.0 + k % 7, 70.0) for k in range(200)]
    boxes = spark.createDataFrame(rows, "image_id string, object_index int, xmin double, ymin double, xmax double, ymax double")
    pairs = M.pair_boxes_dense(boxes, boxes.repartition(3, "image_id"))
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "RepartitionByExpression" not in plan
    key = ["image_id", "s_index", "d_index", "iou", "delta"]
    assert sorted(map(tuple, pairs.select(key).collect())) == sorted(map(tuple, M.pair_boxes(boxes, boxes, dense=0).select(key).collect()))
    more = boxes.unionByName(spark.createDataFrame([("big", k, k % 10 * 9.0, k // 10 * 9.0, k % 10 * 9.0 + 12, k // 10 * 9.0 + 12) for k in range(100)], boxes.schema))
    assert sorted(map(tuple, M.pair_boxes_dense(more, more).select(key).collect())) == sorted(map(tuple, M.pair_boxes(more, more).select(key).collect()))


def test_readiness_counts_tables_one_by_one(spark):
    """The plan of the report doesn't hold the shuffles of the tables that it counts."""
    reviews = written(spark.createDataFrame([("PASS", [], "train", 1, 1)], "status string, reasons array<string>, split string, source_count long, converted_count long"), "reviews")
    counted = {f"t{i}": spark.range(100).groupBy(F.col("id") % (i + 2)).count() for i in range(4)} | {"none": spark.range(0)}
    out = R.readiness_report(reviews, counted)
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    assert exchanges(out) == exchanges(R.readiness_report(reviews, {}))
    assert {r["metric"]: r["value"] for r in out.collect() if r["metric"] in counted} == {"t0": 2, "t1": 3, "t2": 4, "t3": 5, "none": 0}


def test_reviews_written_compressed(spark, tmp_path):
    rows = [(f"i{k}", ("PASS", "NEEDS_REVIEW", "REJECT")[k % 3], ["a", "b"][: k % 3], 0.5) for k in range(30)]
    reviews = spark.createDataFrame(rows, "image_id string, status string, reasons array<string>, min_iou double").withColumns({"max_delta": F.lit(None).cast("double"), "mean_iou": F.col("min_iou")})
    before = shuffles(spark)
    K.write_reviews(reviews, str(tmp_path / "gz"), compression="gzip")
    assert gone(spark, before)
    K.write_reviews(reviews, str(tmp_path / "plain"))
    for part, n in (("all", 30), ("needs_review", 10), ("rejected", 10)):
        assert all(f.name.endswith(".csv.gz") for f in (tmp_path / "gz" / part).glob("part-*")) and all(f.name.endswith(".csv") for f in (tmp_path / "plain" / part).glob("part-*"))
        one, other = (spark.read.csv(str(tmp_path / kind / part), header=True).orderBy("image_id").collect() for kind in ("gz", "plain"))
        assert one == other and len(one) == n
