"""Writers. The default mode refuses to overwrite; sorting and text formats happen only here."""

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import reasons_text, six_decimals
from ..operators.running import ranked
from ..schemas import FINDING_CATEGORIES, MANIFEST_COLUMNS, NEEDS_REVIEW, REJECT, REPORT_CATEGORIES, REPORT_TOTALS, REVIEW_COLUMNS
from ..storage import freed, scratch, written

SAFE, REPLACE = "errorifexists", "overwrite"


def write_findings(findings: DataFrame, path: str, mode: str = SAFE) -> None:
    """A CSV folder per category with columns path, detail; written also for categories without a finding. The findings
    are worked out once and dealt into a table by category, from which each folder is written."""
    with scratch(findings.sparkSession):
        dealt = written(findings.select("category", "path", "detail"), "findings", by="category")
        for category in FINDING_CATEGORIES:
            dealt.where(F.col("category") == category).select("path", "detail").orderBy("path", "detail").write.mode(mode).csv(f"{path}/{category}", header=True)


def report_summary(summary: DataFrame, side: float) -> DataFrame:
    """One row (value): the JSON object {"summary": {...}} of audit_summary's rows, with the classes and their counts."""
    of = lambda metric: F.coalesce(F.max(F.when(F.col("metric") == metric, F.col("value"))), F.lit(0))
    classes = F.array_sort(F.collect_list(F.when(F.col("metric") == "object_class", F.struct("key", "value"))))
    totals = [of(m).alias(name) for m, name in {**REPORT_TOTALS, **REPORT_CATEGORIES}.items()]
    one = summary.agg(classes.alias("_c"), *totals)  # a row for each class is all it gathers
    parts = [F.transform("_c", lambda c: c["key"]).alias("unique_object_classes"), F.map_from_entries("_c").alias("object_class_counts"), *REPORT_TOTALS.values(), *REPORT_CATEGORIES.values(), F.lit(f"width or height <= {side:g} pixels").alias("very_small_box_definition")]
    return one.select(F.to_json(F.struct(F.struct(*parts).alias("summary"))).alias("value"))


def report_findings(findings: DataFrame, chunk: int = 1000) -> DataFrame:
    """(value): JSON objects {"findings": {category: [{"path": ..., "detail": ...}, ...]}} of one category and `chunk`
    findings each, in the order of path and detail; a category of any size is as many objects. A duplicate's detail is
    worded as reports word it."""
    digest = F.regexp_extract("detail", "([0-9a-f]{64})", 1)
    detail = F.when((F.col("category") == "duplicate_images") & (digest != ""), F.concat(F.lit("Duplicate SHA-256 group: "), digest, F.lit("."))).otherwise(F.col("detail"))
    names = F.create_map(*[F.lit(x) for pair in REPORT_CATEGORIES.items() for x in pair])
    rows = findings.select(names[F.col("category")].alias("name"), "path", detail.alias("detail"), "object_index")
    rows = ranked(rows, ["name"], [F.col("path"), F.col("detail"), F.col("object_index")], "_place").withColumn("_chunk", F.floor((F.col("_place") - 1) / chunk))
    held = rows.groupBy("name", "_chunk").agg(F.array_sort(F.collect_list(F.struct("_place", "path", "detail"))).alias("_f"))
    listed = F.transform("_f", lambda f: F.struct(f["path"].alias("path"), f["detail"].alias("detail")))
    return held.select(F.to_json(F.struct(F.create_map("name", listed).alias("findings"))).alias("value"))


def write_audit_report(findings: DataFrame, summary: DataFrame, path: str, mode: str = SAFE, side: float = 10.0, chunk: int = 1000) -> None:
    """The audit's nested report as JSON lines: one object with the summary, and objects with findings per category.
    read_audit_duplicates(..., lines=True) reads it."""
    with scratch(findings.sparkSession):
        report_summary(summary, side).unionByName(report_findings(findings, chunk)).write.mode(mode).text(path)


def _label_line(class_id: pd.Series, xc: pd.Series, yc: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
    """Lines with 17 significant digits a number, which read back as the very same number. Spark has no such format: its
    own text of a double is the shortest that does so."""
    return pd.Series(["%d %.17g %.17g %.17g %.17g" % t for t in zip(*(c.tolist() for c in (class_id, xc, yc, w, h)), strict=True)], dtype=object)


def label_texts(labels: DataFrame, images: DataFrame) -> DataFrame:
    """(image_id, split, label_text): a line `0 xc yc w h` per box in order, numbers as %.17g writes them; images without
    boxes get empty text, and a box with a null no line."""
    line = F.pandas_udf(_label_line, "string")("class_id", "xc", "yc", "w", "h")
    lines = labels.dropna(subset=["class_id", "xc", "yc", "w", "h"]).select("image_id", "line_no", line.alias("t"))
    per = lines.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "t"))).alias("ls"))
    text = F.array_join(F.transform("ls", lambda x: F.concat(x["t"], F.lit("\n"))), "")
    return images.select("image_id", "split").join(per, "image_id", "left").select("image_id", "split", F.coalesce(text, F.lit("")).alias("label_text"))


def write_labels(labels: DataFrame, images: DataFrame, path: str, mode: str = SAFE) -> None:
    label_texts(labels, images).write.partitionBy("split").mode(mode).parquet(path)


def write_manifest(manifest: DataFrame, path: str, mode: str = SAFE) -> None:
    manifest.select(*MANIFEST_COLUMNS).orderBy("image_id").write.mode(mode).csv(path, header=True)


def review_texts(reviews: DataFrame) -> DataFrame:
    """The columns of a review report, in their order, with report text for numbers, booleans and reasons. Paths and group
    are empty where the reviews have none."""
    text = {c: six_decimals(F.col(c)) for c in ("max_delta", "min_iou", "mean_iou")} | {"reasons": reasons_text(F.col("reasons"))}
    of = lambda c: text[c] if c in text else F.coalesce(F.col(c).cast("string"), F.lit("")) if c in reviews.columns else F.lit("")
    return reviews.select(*[of(c).alias(name) for name, c in REVIEW_COLUMNS.items()])


def write_reviews(reviews: DataFrame, path: str, mode: str = SAFE, compression: str = "none") -> None:
    """All reviews, those that need review, and the rejected ones; as plain CSV or compressed, as Spark's CSV writer names it."""
    with scratch(reviews.sparkSession):
        rows = written(review_texts(reviews), "reviews")
        freed(reviews.sparkSession)
        status = F.col("automated_status")
        for name, part in (("all", rows), ("needs_review", rows.where(status == NEEDS_REVIEW)), ("rejected", rows.where(status == REJECT))):
            part.orderBy("image_id").write.mode(mode).csv(f"{path}/{name}", header=True, compression=compression)
            freed(reviews.sparkSession)


def write_summary(summary: DataFrame, path: str, mode: str = SAFE) -> None:
    summary.coalesce(1).write.mode(mode).json(path)  # one row


#: The record that a run is complete, beside its results.
COMPLETE = "RUN_COMPLETE.json"


@contextmanager
def published_run(spark: SparkSession, path: str, overwrite: bool = False, **facts) -> Iterator[str]:
    """A folder to write a run's results to. It stands beside `path` and takes its name when the block ends well; then the
    record COMPLETE, with the given facts, is put into it. If the block fails, the folder goes and `path` stays as it was.

    A run at `path` with that record is complete and is never replaced, with overwrite neither: FileExistsError. One
    without it was left half-written, and gives way if overwrite is set, else FileExistsError. Of two writers that end at
    the same time one gets FileExistsError, as renaming and creating the record fail if the name is there.
    """
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    record = jvm.org.apache.hadoop.fs.Path(at, COMPLETE)
    stage = jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}-{uuid.uuid4().hex}")

    def refuse() -> None:
        if fs.exists(record):
            raise FileExistsError(f"{path} holds a complete run, which is not replaced")
        if fs.exists(at) and not overwrite:
            raise FileExistsError(f"{path} holds an unfinished run; move it, choose another name or set overwrite")

    refuse()
    try:
        yield stage.toString()
        refuse()
        fs.mkdirs(stage)
        if fs.exists(at):
            fs.delete(at, True)
        # a plain rename would move the folder into one of that name
        none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(stage), fs.makeQualified(at), none)
        except Exception as e:
            if fs.exists(at):
                raise FileExistsError(f"{path} was written by another run meanwhile") from e
            raise
        out = fs.create(record, False)
        out.write(bytearray(json.dumps(facts, sort_keys=True).encode()))
        out.close()
    finally:
        fs.delete(stage, True)


def is_complete(spark: SparkSession, path: str) -> bool:
    record = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"), COMPLETE)
    return record.getFileSystem(spark._jsc.hadoopConfiguration()).exists(record)
