"""Verdicts on images: the full review, the preview review and what is derived from them."""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import box, is_small_box
from ..schemas import NEEDS_REVIEW, PASS, PREVIEW_WORDS, REJECT, SPLITS
from ..storage import freed, passing, written
from .matching import match_image_boxes, match_stats
from .quality import LABEL_ROW_COLUMNS, label_row_errors
from .running import ranked

#: A coordinate may differ by this many pixels, and a match's IoU must reach this.
MAX_DELTA, MIN_IOU = 1.0, 0.99
COORDINATE_REASONS = ("maximum_coordinate_difference_exceeds_1px", "minimum_matched_iou_below_0.99")
SMALL, COUNTS_DIFFER = "contains_very_small_box", "duplicate_group_annotation_counts_differ"
MISMATCH_REASONS = ("source_and_converted_object_counts_differ", "unmatched_source_or_converted_boxes", *COORDINATE_REASONS)


def _differ(a: str, b: str) -> Column:
    return (F.col(a + "width") != F.col(b + "width")) | (F.col(a + "height") != F.col(b + "height"))


def box_evidence(images: DataFrame, source: DataFrame, label_rows: DataFrame, side: float) -> DataFrame:
    """Per image: match statistics, small source boxes and label errors in line order.

    source(image_id, object_index, corners); label_rows as in label_row_errors. Everything is keyed by image_id. The result
    is written. Boxes and label rows are worked out one after the other, each once, and go when it ends, so that their
    shuffles don't lie on the disk together.
    """
    spark = images.sparkSession
    with passing(spark) as lasting:
        ids = written(images.select("image_id"), "ids")
        freed(spark)
        label_rows = written(label_rows.select(*LABEL_ROW_COLUMNS), "label_rows")
        freed(spark)
        source = written(source.select("image_id", "object_index", "xmin", "ymin", "xmax", "ymax"), "source")
        freed(spark)
        return lasting(_box_evidence(ids, source, label_rows, side), "evidence")


def _box_evidence(images: DataFrame, source: DataFrame, label_rows: DataFrame, side: float) -> DataFrame:
    judged = label_row_errors(label_rows)
    converted = judged.where("is_box").select("image_id", F.col("line_no").alias("object_index"), ((F.col("xc") - F.col("w") / 2) * F.col("width")).alias("xmin"), ((F.col("yc") - F.col("h") / 2) * F.col("height")).alias("ymin"), ((F.col("xc") + F.col("w") / 2) * F.col("width")).alias("xmax"), ((F.col("yc") + F.col("h") / 2) * F.col("height")).alias("ymax"))
    stats = match_stats(images, source, converted, match_image_boxes(source, converted))
    small = source.groupBy("image_id").agg(F.count_if(is_small_box(box(), side)).alias("small"))
    errors = judged.where(F.size("errors") > 0).groupBy("image_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "errors"))), lambda x: x["errors"])).alias("label_errors"))
    out = stats.join(small, "image_id", "left").join(errors, "image_id", "left")
    return out.withColumn("small", F.coalesce("small", F.lit(0))).withColumn("label_errors", F.coalesce("label_errors", F.array().cast("array<string>")))


def _verdict(rows: DataFrame, reject: list[Column], errors_at: int, review: list[Column]) -> DataFrame:
    """status and reasons from reject reasons (label errors stand before the errors_at-th) and review reasons."""
    lost = F.concat(F.array_compact(F.array(*reject[:errors_at])), F.col("label_errors"), F.array_compact(F.array(*reject[errors_at:])))
    rows = rows.withColumn("_reject", lost).withColumn("_review", F.array_compact(F.array(*review)))
    status = F.when(F.size("_reject") > 0, REJECT).when(F.size("_review") > 0, NEEDS_REVIEW).otherwise(PASS)
    return rows.withColumn("status", status).withColumn("reasons", F.concat("_reject", "_review")).drop("_reject", "_review", "label_errors")


def _common(rows: DataFrame) -> tuple[dict, dict]:
    reject = {
        "xml": F.when(~F.col("has_xml"), "missing_source_xml"),
        "source": F.when(F.col("has_xml") & ~F.col("has_source"), "missing_source_image"),
        "src_xml": F.when(F.col("has_xml") & F.col("has_source") & F.col("src_readable") & _differ("src_", "xml_"), "source_image_and_xml_dimensions_conflict"),
        "src_bad": F.when(F.col("has_xml") & F.col("has_source") & ~F.col("src_readable"), "unreadable_source_image"),
        "conv": F.when(~F.col("has_converted"), "missing_converted_image"),
        "conv_bad": F.when(F.col("has_converted") & ~F.col("conv_readable"), "unreadable_converted_image"),
        "xml_conv": F.when(F.col("has_xml") & F.col("has_converted") & _differ("xml_", "conv_"), "source_xml_and_converted_dimensions_conflict"),
        "src_conv": F.when(F.col("has_source") & F.col("has_converted") & _differ("src_", "conv_"), "source_and_converted_dimensions_conflict"),
        "label": F.when(~F.col("has_label"), "missing_converted_label"),
        "counts": F.when(F.col("source_count") != F.col("converted_count"), "source_and_converted_object_counts_differ"),
        "unmatched": F.when((F.col("unmatched_source") > 0) | (F.col("unmatched_converted") > 0), "unmatched_source_or_converted_boxes"),
        "crosses": F.when(F.col("duplicate_crosses_split"), "duplicate_group_crosses_splits"),
        "several": F.when(F.col("in_several_splits"), "filename_occurs_in_multiple_splits"),
    }
    review = {
        "delta": F.when(F.col("max_delta") > MAX_DELTA, COORDINATE_REASONS[0]),
        "iou": F.when(F.col("min_iou") < MIN_IOU, COORDINATE_REASONS[1]),
        "small": F.when(F.col("small") > 0, SMALL),
        "differs": F.when(F.col("duplicate_count_differs"), COUNTS_DIFFER),
    }
    return reject, review


def review_records(facts: DataFrame, source: DataFrame, label_rows: DataFrame, side: float) -> DataFrame:
    """The full review: facts with match statistics, status (PASS, NEEDS_REVIEW, REJECT) and reasons in order.

    facts(image_id, has_xml, has_source, has_converted, has_label, src_readable, conv_readable, width and height with
    prefixes src_, xml_, conv_, duplicate_crosses_split, duplicate_count_differs, in_several_splits, ...).
    """
    rows = facts.join(box_evidence(facts, source, label_rows, side), "image_id")
    r, v = _common(rows)
    order = [r[k] for k in ("xml", "source", "src_xml", "src_bad", "conv", "conv_bad", "xml_conv", "label")] + [r[k] for k in ("counts", "unmatched", "crosses", "several")]
    return _verdict(rows, order, 8, [v[k] for k in ("delta", "iou", "small", "differs")])


def review_previews(facts: DataFrame, source: DataFrame, label_rows: DataFrame, side: float) -> DataFrame:
    """The preview review: as review_records, with a source/converted size check, the manifest's small_box_count,
    another order of reasons and the words of previews (Pass, Needs review, Reject)."""
    rows = facts.join(box_evidence(facts, source, label_rows, side), "image_id").withColumn("small", F.col("small_box_count"))
    r, v = _common(rows)
    order = [r[k] for k in ("xml", "label", "conv", "source", "conv_bad", "src_conv", "src_xml", "src_bad", "xml_conv")] + [r[k] for k in ("counts", "unmatched", "several", "crosses")]
    out = _verdict(rows, order, 9, [v[k] for k in ("delta", "iou", "differs", "small")])
    words = F.create_map(*[F.lit(x) for pair in PREVIEW_WORDS.items() for x in pair])
    return out.withColumn("status", words[F.col("status")])


def status_counts(reviews: DataFrame) -> DataFrame:
    """(status, n) of all three, zeros kept."""
    base = reviews.sparkSession.createDataFrame([(s,) for s in (PASS, NEEDS_REVIEW, REJECT)], "status string")
    return base.join(reviews.groupBy("status").agg(F.count("*").alias("n")), "status", "left").fillna(0, ["n"])


def reason_breakdown(reviews: DataFrame) -> DataFrame:
    """(reason, n) over the rows that need review."""
    return reviews.where(F.col("status") == NEEDS_REVIEW).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def _coordinate_concern() -> Column:
    return F.arrays_overlap("reasons", F.array(*[F.lit(x) for x in COORDINATE_REASONS]))


def _category() -> Column:
    differs, small = F.array_contains("reasons", COUNTS_DIFFER), F.array_contains("reasons", SMALL)
    return F.when(_coordinate_concern(), "coordinate_or_iou_concern").when(differs, "duplicate_annotation_count_difference").when(small & (F.size(F.array_distinct("reasons")) == 1), "very_small_box_only").otherwise("other_reason")


def _both_reasons() -> Column:
    return F.array_contains("reasons", COUNTS_DIFFER) & F.array_contains("reasons", SMALL)


def review_categories(reviews: DataFrame) -> DataFrame:
    """(category, n): exclusive categories of the rows that need review, and both_reasons, which overlaps."""
    rows = reviews.where(F.col("status") == NEEDS_REVIEW)
    names = F.array_compact(F.array(_category(), F.when(_both_reasons(), "both_reasons")))
    return rows.select(F.explode(names).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


def conversion_mismatches(reviews: DataFrame) -> DataFrame:
    return reviews.where(_mismatch()).select("image_id", "status")


def _mismatch() -> Column:
    return F.arrays_overlap("reasons", F.array(*[F.lit(x) for x in MISMATCH_REASONS]))


def attach_duplicate_group(manifest: DataFrame, images: DataFrame, groups: DataFrame) -> DataFrame:
    """manifest with group: the shared digest of its image, else the manifest's own group."""
    by_image = images.join(groups.select("sha256"), "sha256").select("image_id", "sha256")
    return manifest.join(by_image, "image_id", "left").withColumn("group", F.coalesce("sha256", "duplicate_group_id")).drop("sha256")


def join_previews(previews: DataFrame, reviews: DataFrame, manifest: DataFrame) -> DataFrame:
    """Previews with their verdicts: one that the manifest lacks is rejected with its own reason, one whose split
    differs is rejected too."""
    known = manifest.select("image_id", F.col("split").alias("_split"))
    out = previews.join(known, "image_id", "left").join(reviews.select("image_id", "status", "reasons"), "image_id", "left")
    gone, moved = F.col("_split").isNull(), F.col("_split") != F.col("split")
    reasons = F.when(gone, F.array(F.lit("missing_manifest_record"))).when(moved, F.concat(F.coalesce("reasons", F.array().cast("array<string>")), F.array(F.lit("preview_and_manifest_split_differ")))).otherwise(F.col("reasons"))
    return out.withColumn("reasons", reasons).withColumn("status", F.when(gone | moved, PREVIEW_WORDS[REJECT]).otherwise(F.col("status"))).drop("_split")


def preserve_human_fields(reviews: DataFrame, previous: DataFrame, fields: tuple = ("review_status", "reviewer_notes")) -> DataFrame:
    """reviews with the fields that people filled in before; they win for every id that was there."""
    old = previous.select("image_id", *[F.col(f).alias("_" + f) for f in fields], F.lit(True).alias("_was"))
    out = reviews.join(old, "image_id", "left")
    return out.withColumns({f: F.when(F.col("_was"), F.col("_" + f)).otherwise(F.col(f) if f in reviews.columns else F.lit("")) for f in fields}).drop("_was", *["_" + f for f in fields])


def _corner_text(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
    """Four numbers with six significant digits each, as %g writes them; Spark has no such format."""
    return pd.Series(["%g,%g,%g,%g" % t for t in zip(x0, y0, x1, y1, strict=True)], dtype=object)


def annotation_fingerprint(boxes: DataFrame) -> DataFrame:
    """(image_id, fingerprint): SHA-256 of class:xmin,ymin,xmax,ymax of the boxes in document order, joined by |, numbers
    as %g writes them."""
    text = F.concat(F.col("class_name"), F.lit(":"), F.pandas_udf(_corner_text, "string")("xmin", "ymin", "xmax", "ymax"))
    per = boxes.select("image_id", "object_index", text.alias("t")).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("object_index", "t"))).alias("ts"))
    return per.select("image_id", F.sha2(F.array_join(F.transform("ts", lambda x: x["t"]), "|"), 256).alias("fingerprint"))


def fingerprint_groups(members: DataFrame) -> DataFrame:
    """members(group, image_id, fingerprint) with identical: do all of the group have one fingerprint."""
    per = members.groupBy("group").agg((F.count_distinct("fingerprint") == 1).alias("identical"))
    return members.join(per, "group")


def group_agreement(members: DataFrame) -> DataFrame:
    """members(group, image_id, split, object_count, fingerprint, xml_width, xml_height, width, height) → per group its
    number of members and splits, and whether annotations, XML sizes, image sizes and splits agree. A group of any size is
    one row of fixed size, added up where its members lie."""
    one = lambda c: F.min(c) == F.max(c)
    return members.groupBy("group").agg(F.count("*").alias("members"), F.array_sort(F.collect_set("split")).alias("splits"), one("fingerprint").alias("identical_annotations"), one(F.struct("xml_width", "xml_height")).alias("xml_dimensions_consistent"), one(F.struct("width", "height")).alias("image_dimensions_consistent"), one("split").alias("one_split"))


def group_texts(members: DataFrame, items: dict[str, Column], chunk: int = 1000) -> DataFrame:
    """(group, chunk_no from 0, first_id, last_id, members, a text for each item): the running texts of a group, its
    members' items in the order of image_id joined by `;`, cut into numbered chunks of `chunk` members. The texts of a
    group's chunks, joined in order, are what one text of the whole group would be.

    Members get their place by range (running sums), not by gathering a group, so a group of any size passes; no value
    holds more than `chunk` members. Equal image_ids in a group are in the order of their items.
    """
    rows = members.select("group", "image_id", *[c.alias(n) for n, c in items.items()])
    rows = ranked(rows, ["group"], [F.col("image_id"), *[F.col(n) for n in items]], "_place").withColumn("chunk_no", F.floor((F.col("_place") - 1) / chunk))
    held = rows.groupBy("group", "chunk_no").agg(F.array_sort(F.collect_list(F.struct("_place", "image_id", *items))).alias("_m"))
    text = lambda n: F.array_join(F.transform("_m", lambda x: x[n]), ";").alias(n)
    return held.select("group", "chunk_no", F.get("_m", F.lit(0))["image_id"].alias("first_id"), F.element_at("_m", -1)["image_id"].alias("last_id"), F.size("_m").alias("members"), *[text(n) for n in items])


def duplicate_group_texts(members: DataFrame, chunk: int = 1000) -> DataFrame:
    """group_texts of what compare_duplicate_annotations holds: ids, object counts, XML sizes and image sizes."""
    of = lambda *parts: F.concat(F.col("image_id"), F.lit(":"), F.concat_ws(",", *[F.col(p).cast("string") for p in parts]))
    return group_texts(members, {"image_ids": F.col("image_id"), "object_counts": of("object_count"), "xml_dimensions": of("xml_width", "xml_height"), "image_dimensions": of("width", "height")}, chunk)


def compare_duplicate_annotations(members: DataFrame) -> DataFrame:
    """group_agreement with, per group, the ids and maps from id to object count, XML size and image size: the form of a
    report. A group's maps are values of some 50 bytes a member, so they hold groups of millions at most; for groups of any
    size there are group_agreement and duplicate_group_texts.
    """
    rows = F.array_sort(F.collect_list(F.struct("image_id", "object_count", F.array("xml_width", "xml_height").alias("xml"), F.array("width", "height").alias("image"))))
    per = members.groupBy("group").agg(rows.alias("_m")).join(group_agreement(members).drop("members"), "group")
    map_of = lambda field: F.map_from_entries(F.transform("_m", lambda x: F.struct(x["image_id"], x[field])))
    return per.select("group", F.transform("_m", lambda x: x["image_id"]).alias("image_ids"), "splits", map_of("object_count").alias("object_counts"), map_of("xml").alias("xml_dimensions"), map_of("image").alias("image_dimensions"), "identical_annotations", "xml_dimensions_consistent", "image_dimensions_consistent", "one_split")


#: What a reviewed duplicate says of itself.
EXPLAIN_VALID = "Identical SHA-256 image files have different source XML annotation counts and coordinates; the converted YOLO boxes exactly preserve this image's own source XML annotations."
EXPLAIN_FAILED = "Conversion or split integrity check failed; inspect this record."


def group_baseline_compare(members: DataFrame) -> DataFrame:
    """members(group, image_id, split, fingerprint, label_errors, source_count, converted_count, unmatched_source,
    unmatched_converted, max_delta, min_iou) with same_as_first (the member of the least image_id), conversion_valid,
    blocking, explanation."""
    per = members.groupBy("group").agg(F.min_by("fingerprint", "image_id").alias("_first"), (F.min("split") == F.max("split")).alias("_one"))
    valid = (F.col("label_errors") == 0) & (F.col("source_count") == F.col("converted_count")) & (F.col("unmatched_source") == 0) & (F.col("unmatched_converted") == 0) & F.coalesce(F.col("max_delta") <= MAX_DELTA, F.lit(True)) & F.coalesce(F.col("min_iou") >= MIN_IOU, F.lit(True))
    out = members.join(per, "group").withColumn("conversion_valid", valid).withColumn("blocking", ~F.col("conversion_valid") | ~F.col("_one"))
    return out.select("group", "image_id", "split", "source_count", "converted_count", (F.col("fingerprint") == F.col("_first")).alias("same_as_first"), "conversion_valid", "blocking", F.when(F.col("blocking"), EXPLAIN_FAILED).otherwise(EXPLAIN_VALID).alias("explanation"))


def with_group_object_counts(compared: DataFrame) -> DataFrame:
    """compared with group_object_counts, `id:count` of all members of its group in order. Each member carries its whole
    group, as the report does that people read, so a group costs the square of its size; group_object_count_texts has it once."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("image_id", "source_count"))), lambda x: F.concat(x["image_id"], F.lit(":"), x["source_count"].cast("string"))), ";")
    return compared.join(compared.groupBy("group").agg(text.alias("group_object_counts")), "group")


def group_object_count_texts(compared: DataFrame, chunk: int = 1000) -> DataFrame:
    """The group_object_counts of with_group_object_counts once per group, in numbered chunks; groups of any size."""
    return group_texts(compared, {"group_object_counts": F.concat("image_id", F.lit(":"), F.col("source_count").cast("string"))}, chunk)


def duplicate_review_summary(compared: DataFrame) -> DataFrame:
    return compared.agg(F.count_distinct("group").alias("groups"), F.count("*").alias("images"), F.coalesce(F.bool_and("conversion_valid"), F.lit(True)).alias("all_valid"), F.coalesce(F.bool_and(~F.col("blocking")), F.lit(True)).alias("none_blocking"))


def readiness_report(reviews: DataFrame, counted: dict[str, DataFrame]) -> DataFrame:
    """(metric, key, value): totals, status counts, per-split images and objects, reasons, categories, both reasons and
    mismatches of reviews(status, reasons, split, source_count, converted_count), zeros kept; and the number of rows of
    each counted table.

    Each review is worked out once: it gives its (metric, key, amount) entries, which one aggregation sums. The tables are
    counted one after the other, so that the shuffles of one at a time lie on the disk.
    """
    spark = reviews.sparkSession
    needs = F.col("status") == NEEDS_REVIEW
    entry = lambda metric, key, n: F.struct(F.lit(metric).alias("metric"), key.alias("key"), n.cast("long").alias("value"))
    none, one = F.lit(""), F.lit(1)
    own = F.col("split").isin(*SPLITS)
    entries = F.array_compact(F.array(
        entry("images_checked", none, one), entry("source_objects_checked", none, F.col("source_count")), entry("objects_checked", none, F.col("converted_count")), entry("status", F.col("status"), one),
        F.when(own, entry("split_images", F.col("split"), one)), F.when(own, entry("split_objects", F.col("split"), F.col("converted_count"))), F.when(own, entry("split_source_objects", F.col("split"), F.col("source_count"))),
        F.when(needs, entry("category", _category(), one)), F.when(needs & _both_reasons(), entry("both_reasons", none, one)), F.when(_mismatch(), entry("conversion_mismatches", none, one)),
    ))
    reasons = F.when(needs, F.transform("reasons", lambda r: entry("reason", r, one))).otherwise(F.array().cast("array<struct<metric: string, key: string, value: bigint>>"))
    summed = reviews.select(F.explode(F.concat(entries, reasons)).alias("e")).groupBy("e.metric", "e.key").agg(F.sum("e.value").alias("value"))
    always = [("images_checked", ""), ("source_objects_checked", ""), ("objects_checked", ""), ("both_reasons", ""), ("conversion_mismatches", "")]
    always += [("status", s) for s in (PASS, NEEDS_REVIEW, REJECT)] + [(m, s) for m in ("split_images", "split_objects", "split_source_objects") for s in SPLITS]
    rows = [(*m, 0) for m in always]
    zeros = spark.createDataFrame(rows, "metric string, key string, value long")
    out = summed.unionByName(zeros).groupBy("metric", "key").agg(F.sum("value").alias("value"))
    counts = []
    for name, df in counted.items():
        counts.append((name, "", df.count()))
        freed(spark)
    return out.unionByName(spark.createDataFrame(counts, zeros.schema)) if counts else out
