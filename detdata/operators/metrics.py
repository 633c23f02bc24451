"""Metrics of runs, splits and stored predictions."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.geometry import iou
from ..storage import written
from .running import running_sums

THRESHOLDS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))


def _zero_is_missing(metric: str) -> Column:
    return F.when(F.col(metric) != 0, F.col(metric))


def best_epoch(epochs: DataFrame, metric: str) -> DataFrame:
    """The row of each run with the largest metric, the first epoch of equals; null and 0.0 come last."""
    w = Window.partitionBy("run").orderBy(_zero_is_missing(metric).desc_nulls_last(), "epoch")
    return epochs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def last_epoch(epochs: DataFrame, losses: list[str]) -> DataFrame:
    """Per run: last epoch, and first, last and change of each loss."""
    aggs = [x for c in losses for x in (F.min_by(c, "epoch").alias(f"{c}_first"), F.max_by(c, "epoch").alias(f"{c}_last"))]
    out = epochs.groupBy("run").agg(F.max("epoch").alias("last_epoch"), *aggs)
    return out.withColumns({f"{c}_change": F.col(f"{c}_last") - F.col(f"{c}_first") for c in losses})


def finite_metrics_check(epochs: DataFrame, metrics: list[str], expected: int | None = None) -> DataFrame:
    """Per run: epochs, last epoch, rows with a metric that is NaN or infinite, complete (as many epochs as expected)."""
    bad = F.lit(False)
    for m in metrics:
        bad = bad | F.coalesce(F.isnan(m) | (F.abs(m) == float("inf")), F.lit(False))
    complete = F.lit(True) if expected is None else (F.count("*") == expected) & (F.max("epoch") == expected)
    return epochs.groupBy("run").agg(F.count("*").alias("epochs"), F.max("epoch").alias("last_epoch"), F.count_if(bad).alias("not_finite"), complete.alias("complete"))


def run_comparison(best: DataFrame, base: str, other: str, metrics: list[str]) -> DataFrame:
    """(metric, base, other, change, change_percent) of two runs."""
    rows = lambda run, name: best.where(F.col("run") == run).select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x")).select("x.metric", F.col("x.v").alias(name))
    return generalisation_gap(rows(base, "a"), rows(other, "b"), "a", "b").withColumnsRenamed({"first": "base", "second": "other"})


def generalisation_gap(first: DataFrame, second: DataFrame, a: str = "value", b: str = "value") -> DataFrame:
    """(metric, first, second, change, change_percent) joined on the metric."""
    out = first.select("metric", F.col(a).alias("first")).join(second.select("metric", F.col(b).alias("second")), "metric")
    change = F.col("second") - F.col("first")
    return out.withColumn("change", change).withColumn("change_percent", F.when(F.col("first") != 0, change / F.col("first") * 100))


def seconds_per_epoch(runs: DataFrame) -> DataFrame:
    """runs(run, seconds, epochs) with seconds_per_epoch and percent_slower than the fastest run."""
    out = runs.withColumn("seconds_per_epoch", F.when(F.col("epochs") > 0, F.col("seconds") / F.col("epochs")))
    fastest = out.agg(F.min("seconds_per_epoch").alias("_f"))
    return out.crossJoin(fastest).withColumn("percent_slower", (F.col("seconds_per_epoch") / F.col("_f") - 1) * 100).drop("_f")  # by one row


def match_masks(predictions: DataFrame, truth: DataFrame, thresholds: tuple = THRESHOLDS) -> DataFrame:
    """(image_id, class_id, pred_id, confidence, hits): at each threshold the predictions of an image and class, by
    descending confidence and then pred_id, take the free true box of greatest IoU that reaches it (of equal ones that of
    the greatest truth_id). Bit i of hits: did the prediction get a box at the i-th threshold, in ascending order.

    One walk serves all thresholds. Spark sorts the candidate pairs of an image and class into the order of the matching,
    and a task reads them once; of a true box it holds one number, whose bits are the thresholds at which it is taken. A
    prediction asks its candidates in order for the bits that it still lacks. An image's true boxes are all that a task
    holds, and the time is linear in the pairs.
    """
    if len(thresholds) > 62:
        raise ValueError("62 thresholds at most")
    key = ["image_id", "class_id"]
    p = predictions.select(*key, "pred_id", "confidence", *[F.col(c).alias("p_" + c) for c in ("xmin", "ymin", "xmax", "ymax")])
    t = truth.select(*[F.col(c).alias("t_" + c) for c in key], "truth_id", *[F.col(c).alias("t_" + c) for c in ("xmin", "ymin", "xmax", "ymax")])
    corners = lambda x: tuple(F.col(x + c) for c in ("xmin", "ymin", "xmax", "ymax"))
    overlap = (F.col("p_xmin") < F.col("t_xmax")) & (F.col("t_xmin") < F.col("p_xmax")) & (F.col("p_ymin") < F.col("t_ymax")) & (F.col("t_ymin") < F.col("p_ymax"))
    reach = iou(corners("p_"), corners("t_"))
    pairs = p.join(t, (F.col("image_id") == F.col("t_image_id")) & (F.col("class_id") == F.col("t_class_id")) & overlap & (reach >= min(thresholds)), "left")
    bits = sum((F.when(F.col("iou") >= x, F.lit(1 << i)).otherwise(F.lit(0)) for i, x in enumerate(sorted(thresholds))), F.lit(0).cast("long"))
    rows = pairs.select(*key, "pred_id", "confidence", "truth_id", reach.alias("iou")).repartition(*key)
    rows = rows.sortWithinPartitions(*key, F.desc_nulls_last("confidence"), "pred_id", F.desc_nulls_last("iou"), F.desc("truth_id"))
    rows = rows.select(*key, "pred_id", "confidence", "truth_id", bits.cast("long").alias("bits"))
    every = (1 << len(thresholds)) - 1
    schema = StructType([*rows.schema.fields[:4], StructField("hits", LongType())])
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def batch(found: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=schema.names)

    def run(batches):
        group, pred, taken, lacks, found = None, None, {}, 0, []
        for b in batches:
            for image, class_, of, confidence, true, reached in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (image, class_) != group:
                    group, pred, taken = (image, class_), None, {}
                if (of, confidence) != pred:
                    pred, lacks = (of, confidence), every
                    found.append([image, class_, of, confidence, 0])
                if got := lacks & reached & ~taken.get(true, 0):
                    taken[true] = taken.get(true, 0) | got
                    lacks &= ~got
                    found[-1][4] |= got
            if len(found) > 1:  # the last one may go on in the next batch
                yield batch(found[:-1])
                del found[:-1]
        if found:
            yield batch(found)

    return rows.mapInArrow(run, schema)


def match_predictions(predictions: DataFrame, truth: DataFrame, thresholds: tuple = THRESHOLDS) -> DataFrame:
    """(threshold, image_id, class_id, pred_id, confidence, hit): match_masks with a row for each threshold."""
    masks = match_masks(predictions, truth, thresholds)
    each = F.array(*[F.struct(F.lit(float(x)).alias("threshold"), _bit(i).alias("hit")) for i, x in enumerate(sorted(thresholds))])
    return masks.select("image_id", "class_id", "pred_id", "confidence", F.explode(each).alias("x")).select("image_id", "class_id", "pred_id", "confidence", "x.threshold", "x.hit")


def _bit(i: int) -> Column:
    return F.col("hits").bitwiseAND(F.lit(1 << i)) != 0


def precision_recall(matched: DataFrame, truth: DataFrame) -> DataFrame:
    """(class_id, threshold, confidence, tp, fp, precision, recall), a point per distinct confidence of
    matched(class_id, threshold, confidence, hit)."""
    points = matched.groupBy("class_id", "threshold", "confidence").agg(F.count_if("hit").alias("t"), F.count_if(~F.col("hit")).alias("f"))
    return _curve(points, truth)


def precision_recall_of_masks(masks: DataFrame, truth: DataFrame, thresholds: tuple = THRESHOLDS) -> DataFrame:
    """precision_recall of match_masks: the hits of all thresholds are counted per distinct confidence before they become
    rows."""
    counts = masks.groupBy("class_id", "confidence").agg(F.count("*").alias("n"), *[F.count_if(_bit(i)).alias(f"t{i}") for i in range(len(thresholds))])
    each = F.array(*[F.struct(F.lit(float(x)).alias("threshold"), F.col(f"t{i}").alias("t"), (F.col("n") - F.col(f"t{i}")).alias("f")) for i, x in enumerate(sorted(thresholds))])
    return _curve(counts.select("class_id", "confidence", F.explode(each).alias("x")).select("class_id", "x.threshold", "confidence", "x.t", "x.f"), truth)


def _curve(points: DataFrame, truth: DataFrame) -> DataFrame:
    """Points (class_id, threshold, confidence, t, f) with their running sums by descending confidence."""
    key = ["class_id", "threshold"]
    out = running_sums(points, key, [F.desc("confidence")], {"tp": F.col("t"), "fp": F.col("f")})
    out = out.join(truth.groupBy("class_id").agg(F.count("*").alias("n")), "class_id")
    tp, fp = F.col("tp"), F.col("fp")
    return out.select(*key, "confidence", "tp", "fp", (tp / (tp + fp)).alias("precision"), (tp / F.col("n")).alias("recall"))


def average_precision(curve: DataFrame) -> DataFrame:
    """(class_id, threshold, ap): mean over recall 0, .01, …, 1 of the largest precision at that recall or more."""
    key = ["class_id", "threshold"]
    at = curve.groupBy(*key, F.floor(F.col("recall") * 100 + 1e-9).alias("r")).agg(F.max("precision").alias("p"))
    grid = curve.select(*key).distinct().withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(100))))
    w = Window.partitionBy(*key).orderBy(F.desc("r"))  # 101 rows
    best = grid.join(at, [*key, "r"], "left").withColumn("p", F.coalesce(F.max("p").over(w), F.lit(0.0)))
    return best.groupBy(*key).agg((F.sum("p") / 101).alias("ap"))


def detection_metrics(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """(class_id, precision, recall, map50, map50_95): precision and recall where F1 at IoU .5 is best."""
    curve = written(precision_recall_of_masks(match_masks(predictions, truth), truth), "curve")
    ap = average_precision(curve).groupBy("class_id").agg(F.max(F.when(F.col("threshold") == 0.5, F.col("ap"))).alias("map50"), F.avg("ap").alias("map50_95"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    at = curve.where("threshold = 0.5").groupBy("class_id").agg(F.max_by(F.struct("precision", "recall"), F.struct(f1, "confidence")).alias("x"))
    return at.join(ap, "class_id").select("class_id", "x.precision", "x.recall", "map50", "map50_95")


def confusion_counts(predictions: DataFrame, truth: DataFrame, confidence: float, threshold: float = 0.5) -> DataFrame:
    """One row: matched, background (predictions without a true box), missed (true boxes without a prediction)."""
    m = match_predictions(predictions.where(F.col("confidence") >= confidence), truth, (threshold,)).agg(F.count_if("hit").alias("matched"), F.count_if(~F.col("hit")).alias("background"))
    return m.crossJoin(truth.agg(F.count("*").alias("_n"))).select("matched", "background", (F.col("_n") - F.col("matched")).alias("missed"))  # one row each
