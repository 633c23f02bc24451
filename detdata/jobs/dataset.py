"""A whole data set prepared from its files: audit, conversion, split, and a check of what was written. Each step writes its
results below one run's folder, which is published as a whole when all steps have ended well."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import parse_positive_integer, path_name, path_suffix, xml_text
from ..operators import audit as A
from ..operators import convert as C
from ..operators import quality as Q
from ..operators import review as R
from ..operators import split as G
from ..schemas import CONVERT_SUFFIXES, SMALL_SIDE
from ..sources import files as IO
from ..sources import sinks as K
from ..storage import scratch, written


@dataclass(frozen=True)
class Source:
    """annotations as read; boxes with numbers for corners; images with size and digest; resolved names of both."""

    annotations: DataFrame
    boxes: DataFrame
    images: DataFrame
    resolved: DataFrame


def read_source(spark: SparkSession, images: str, annotations: str) -> Source:
    """A folder of images and one of annotation files. Files are read once; what later steps share is written."""
    ann = IO.read_voc_annotations(spark, annotations)
    known = written(ann.withColumns({"width": parse_positive_integer(F.col("size.width")), "height": parse_positive_integer(F.col("size.height"))}), "annotations")
    boxes = A.typed_boxes(IO.explode_boxes(known)).withColumns({"width": parse_positive_integer(F.col("xml_width")), "height": parse_positive_integer(F.col("xml_height"))})
    facts = written(IO.image_facts(spark, images), "image_facts")
    good = known.where("_corrupt_record is null").select("xml_path", xml_text(F.col("filename")).alias("filename"), xml_text(F.col("path")).alias("path"))
    return Source(known, written(boxes, "boxes"), facts, written(A.resolve_images(good, facts.select("path")), "resolved"))


def audit(source: Source, out: str, side: float = SMALL_SIDE) -> DataFrame:
    """Findings per category, the nested report, and the summary rows, which are returned."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    reference = F.when(~blank("filename"), F.col("filename")).otherwise(F.col("path"))
    ann = source.annotations.select(F.col("xml_path"), F.col("_corrupt_record").alias("parse_error"), reference.alias("reference"), "width", "height").withColumnRenamed("xml_path", "path")
    named = source.boxes.withColumn("path", F.col("xml_path"))
    readable = source.images.where("readable")
    findings = written(A.union([
        A.find_missing_images(source.resolved), A.find_missing_annotations(source.images, source.resolved), A.find_extension_mismatches(source.resolved), A.find_invalid_annotations(ann, named),
        A.find_invalid_boxes(source.boxes), A.find_small_boxes(source.boxes, side), A.find_corrupt_images(source.images), A.find_duplicate_images(readable),
    ]), "findings")
    summary = written(A.audit_summary(findings, source.images, ann, source.boxes, side), "audit_summary")
    K.write_findings(findings, f"{out}/findings")
    K.write_audit_report(findings, summary, f"{out}/report", side=side)
    K.write_summary(summary, f"{out}/summary")
    return summary


def convert(source: Source, out: str, ratios: dict[str, float], side: float = SMALL_SIDE, source_class: str = "fore") -> DataFrame:
    """Labels and manifest of all annotated images, which is returned. One image that can't be converted stops the job; the
    first failure of each is written before that."""
    usable = source.images.where(path_suffix(F.col("path")).isin(*CONVERT_SUFFIXES)).select(F.col("path").alias("image_path"), F.col("width").alias("image_width"), F.col("height").alias("image_height"), "readable", "sha256")
    items = source.annotations.select("xml_path", "image_id").join(source.resolved.select("xml_path", "image_path"), "xml_path", "left").join(usable, "image_path", "left")
    items = written(items.withColumn("readable", F.coalesce("readable", F.lit(False))), "items")
    boxes = written(source.boxes.drop("width", "height").join(items.select("image_id", F.col("image_width").alias("width"), F.col("image_height").alias("height"), "readable"), "image_id").where("readable").drop("readable"), "source_boxes")
    failures = written(C.conversion_preflight(items, boxes, source_class), "failures")
    failures.write.csv(f"{out}/failures", header=True)
    C.require_convertible(failures)
    shared = A.duplicate_groups(items).select("sha256", F.col("sha256").alias("duplicate_group_id"))
    counted = items.join(shared, "sha256", "left").fillna("", ["duplicate_group_id"]).join(A.box_counts_per_image(items, boxes, side), "image_id")
    counted = written(counted, "split_items")
    split = G.assign_splits(counted.select("image_id", "object_count", "small_box_count", "duplicate_group_id"), ratios)
    manifest = counted.join(split, "image_id").withColumnsRenamed({"image_path": "_image", "xml_path": "_xml"})
    of = lambda *parts: F.concat_ws("/", *parts)
    manifest = manifest.withColumns({
        "image_path": of(F.lit("images"), "split", path_name(F.col("_image"))), "label_path": of(F.lit("labels"), "split", F.concat("image_id", F.lit(".txt"))),
        "source_image_path": of(F.lit("source"), path_name(F.col("_image"))), "source_xml_path": of(F.lit("source"), path_name(F.col("_xml"))),
    })
    manifest = written(manifest, "manifest")
    G.check_split_invariants(counted, manifest)
    K.write_labels(C.convert_boxes(boxes), manifest, f"{out}/labels")
    K.write_manifest(manifest, f"{out}/manifest")
    return manifest


def check(source: Source, out: str, side: float = SMALL_SIDE) -> tuple[DataFrame, DataFrame]:
    """(reviews, readiness) of what a run holds: labels and manifest are read back and held against the source."""
    spark = source.images.sparkSession
    manifest = IO.read_manifest(spark, f"{out}/manifest", K.MANIFEST_COLUMNS)
    typed = manifest.withColumns({c: parse_positive_integer(F.col(c)) for c in ("image_width", "image_height")}).withColumns({c: F.col(c).try_cast("long") for c in ("object_count", "small_box_count")})
    texts = spark.read.parquet(f"{out}/labels")
    sizes = typed.select("image_id", F.col("image_width").alias("width"), F.col("image_height").alias("height"))
    rows = IO.label_boxes(IO.label_rows(texts, "image_id", "label_text").where("line != ''")).withColumnRenamed("path", "image_id").join(sizes, "image_id")
    rows = written(rows, "label_rows")
    actual = source.resolved.join(source.images.select(F.col("path").alias("image_path"), F.col("width").alias("src_width"), F.col("height").alias("src_height"), F.col("readable").alias("src_readable")), "image_path").select("xml_path", "src_width", "src_height", "src_readable")
    xml = source.annotations.select("image_id", "xml_path", F.col("width").alias("xml_width"), F.col("height").alias("xml_height")).join(actual, "xml_path", "left").drop("xml_path")
    differs = Q.duplicate_count_differs(typed).select("duplicate_group_id", F.lit(True).alias("_differs"))
    leaks = written(Q.split_leaks(typed, {"group": "duplicate_group_id", "image": "image_id"}), "leaks")
    torn = lambda kind, key, name: leaks.where(F.col("kind") == kind).select(F.col("key").alias(key), F.lit(True).alias(name))
    facts = typed.join(xml.withColumn("has_xml", F.lit(True)), "image_id", "left").join(texts.select("image_id", F.lit(True).alias("has_label")), "image_id", "left")
    facts = facts.join(differs, "duplicate_group_id", "left").join(torn("group", "duplicate_group_id", "_crosses"), "duplicate_group_id", "left").join(torn("image", "image_id", "_several"), "image_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    # images are not copied: the converted image is the source image
    facts = facts.withColumns({
        "has_xml": yes("has_xml"), "has_label": yes("has_label"), "has_source": F.col("src_width").isNotNull(), "has_converted": F.col("src_width").isNotNull(), "src_readable": yes("src_readable"), "conv_readable": yes("src_readable"),
        "conv_width": F.col("image_width"), "conv_height": F.col("image_height"), "duplicate_count_differs": yes("_differs"), "duplicate_crosses_split": yes("_crosses"), "in_several_splits": yes("_several"), "group": F.col("duplicate_group_id"),
    }).drop("small_box_count", "_differs", "_crosses", "_several")
    valid = source.boxes.select("image_id", "object_index", "xmin", "ymin", "xmax", "ymax")
    reviews = written(R.review_records(facts, valid, rows, side), "reviews")
    paths = Q.absolute_manifest_paths(manifest)
    boxes = Q.label_row_errors(rows).where("is_box")
    counted = {"label_errors": Q.label_errors(rows), "split_leaks": leaks, "absolute_paths": paths, "count_mismatches": Q.count_mismatch(typed, boxes), "invalid_splits": Q.invalid_split_values(manifest)}
    readiness = written(R.readiness_report(reviews, counted), "readiness")
    K.write_reviews(reviews, f"{out}/reviews")
    K.write_summary(readiness, f"{out}/readiness")
    return reviews, readiness


def prepare(spark: SparkSession, images: str, annotations: str, out: str, ratios: dict[str, float], side: float = SMALL_SIDE, source_class: str = "fore", overwrite: bool = False) -> None:
    """Audit, conversion with split, and check of a data set; the run at `out` is complete or isn't there."""
    with scratch(spark), K.published_run(spark, out, overwrite, ratios=ratios, side=side, source_class=source_class) as stage:
        source = read_source(spark, images, annotations)
        audit(source, f"{stage}/audit", side)
        convert(source, stage, ratios, side, source_class)
        check(source, stage, side)
