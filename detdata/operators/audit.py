"""Audit of annotations, boxes, image files and references. Findings are rows (category, path, object_index, detail)."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import box, is_small_box
from ..functions.scalars import parse_number, path_name, path_stem, path_suffix
from ..schemas import FINDING_CATEGORIES

#: Suffixes between which a reference may differ from its file.
SWAPPED = ("jpeg", "jpg", "png")


def finding(df: DataFrame, category: str, path: Column, detail: Column, index: Column | None = None) -> DataFrame:
    return df.select(F.lit(category).alias("category"), path.alias("path"), (F.lit(None) if index is None else index).cast("int").alias("object_index"), detail.alias("detail"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def typed_boxes(boxes: DataFrame) -> DataFrame:
    """Boxes with text corners as numbers: null where the text is no finite number."""
    return boxes.withColumns({c: parse_number(F.col(c)) for c in ("xmin", "ymin", "xmax", "ymax")})


def box_problems(width: Column, height: Column) -> Column:
    """Joined problems of a typed box; null if it is valid. Bounds are checked where the size is known."""
    x0, y0, x1, y1 = box()
    missing = x0.isNull() | y0.isNull() | x1.isNull() | y1.isNull()
    problems = F.array_join(
        F.array_compact(
            F.array(
                F.when((x0 < 0) | (y0 < 0), "minimum coordinate is negative"),
                F.when((x1 <= x0) | (y1 <= y0), "box has non-positive width or height"),
                F.when(x1 > width, "xmax exceeds width"),
                F.when(y1 > height, "ymax exceeds height"),
            )
        ),
        "; ",
    )
    return F.when(missing, "missing, non-numeric, or non-finite coordinates").when(problems != "", problems)


def find_invalid_boxes(boxes: DataFrame) -> DataFrame:
    """boxes(image_id, object_index, corners, width, height) typed."""
    rows = boxes.withColumn("_p", box_problems(F.col("width"), F.col("height"))).where("_p is not null")
    return finding(rows, "invalid_boxes", F.col("image_id"), F.col("_p"), F.col("object_index"))


def find_small_boxes(boxes: DataFrame, side: float) -> DataFrame:
    """Valid boxes with a side of `side` pixels or less."""
    rows = boxes.where(box_problems(F.col("width"), F.col("height")).isNull() & is_small_box(box(), side))
    return finding(rows, "small_boxes", F.col("image_id"), F.lit("side at or below the threshold"), F.col("object_index"))


def find_invalid_annotations(annotations: DataFrame, boxes: DataFrame) -> DataFrame:
    """Unparseable files, files without any image reference, bad sizes, objects without a name; an annotation can
    have several. annotations(path, parse_error, reference, width, height), boxes(path, object_index, class_name)."""
    good = annotations.where("parse_error is null")
    return union([
        finding(annotations.where("parse_error is not null"), "invalid_annotations", F.col("path"), F.lit("XML cannot be parsed")),
        finding(good.where("coalesce(reference, '') = ''"), "invalid_annotations", F.col("path"), F.lit("no image reference")),
        finding(good.where("width is null or height is null"), "invalid_annotations", F.col("path"), F.lit("missing or invalid size")),
        finding(boxes.where("coalesce(class_name, '') = ''"), "invalid_annotations", F.col("path"), F.lit("object without name"), F.col("object_index")),
    ])


def find_corrupt_images(images: DataFrame) -> DataFrame:
    return finding(images.where("not readable"), "corrupt_images", F.col("path"), F.lit("image cannot be read"))


def resolve_images(references: DataFrame, images: DataFrame, keep: str = "first", any_suffix: bool = False) -> DataFrame:
    """references(xml_path, filename, path) → the image each annotation names, by the name in filename, the name in
    path, then the stems of both; mismatch marks a stem match.

    Several images of one name or stem give the first or last path (keep), found before the join, so every join is
    many-to-one. Stems are only used between the usual suffixes unless any_suffix.
    """
    best = F.min if keep == "first" else F.max
    names = images.groupBy(path_name(F.col("path")).alias("_key")).agg(best("path").alias("_image"))
    swapped = images if any_suffix else images.where(path_suffix(F.col("path")).isin(*SWAPPED))
    stems = swapped.groupBy(path_stem(F.col("path")).alias("_key")).agg(best("path").alias("_image"))
    name = lambda c: F.when(F.coalesce(F.trim(c), F.lit("")) != "", path_name(F.trim(c)))
    asked = references.select("xml_path", F.explode(F.array_compact(F.array(*[F.when(name(c).isNotNull(), F.struct(F.lit(i).alias("rank"), name(c).alias("name"))) for i, c in enumerate(("filename", "path"))]))).alias("r")).select("xml_path", "r.rank", "r.name")
    exact = asked.join(names, F.col("name") == F.col("_key")).select("xml_path", "rank", "_image", "name")
    loose = asked if any_suffix else asked.where(path_suffix(F.col("name")).isin(*SWAPPED))
    near = loose.join(stems, path_stem(F.col("name")) == F.col("_key")).select("xml_path", (F.col("rank") + 2).alias("rank"), "_image", "name")
    found = exact.unionByName(near).groupBy("xml_path").agg(F.min_by(F.struct(F.col("_image").alias("image"), F.col("rank"), "name"), "rank").alias("f"))
    out = references.join(found, "xml_path", "left")
    return out.select(*references.columns, F.col("f.image").alias("image_path"), F.coalesce(F.col("f.rank") >= 2, F.lit(False)).alias("mismatch"), F.coalesce(name("filename"), name("path")).alias("reference"))


def find_source_image(images_wanted: DataFrame, images: DataFrame, suffixes: tuple = ("jpg", "jpeg", "png")) -> DataFrame:
    """images_wanted(image_id, filename) → image_path: by filename, then image_id with each suffix in turn."""
    names = images.groupBy(path_name(F.col("path")).alias("_key")).agg(F.min("path").alias("_image"))
    wish = F.array(F.struct(F.lit(0).alias("rank"), path_name(F.trim("filename")).alias("name")), *[F.struct(F.lit(i + 1).alias("rank"), F.concat("image_id", F.lit("." + s)).alias("name")) for i, s in enumerate(suffixes)])
    got = images_wanted.select("image_id", F.explode(wish).alias("w")).join(names, F.col("w.name") == F.col("_key")).groupBy("image_id").agg(F.min_by("_image", "w.rank").alias("image_path"))
    return images_wanted.join(got, "image_id", "left")


def find_missing_images(resolved: DataFrame) -> DataFrame:
    rows = resolved.where("image_path is null")
    return finding(rows, "missing_images", F.col("xml_path"), F.coalesce(F.concat(F.lit("referenced image is missing: "), "reference"), F.lit("no image reference")))


def find_extension_mismatches(resolved: DataFrame) -> DataFrame:
    return finding(resolved.where("mismatch"), "extension_mismatches", F.col("xml_path"), F.concat("reference", F.lit(" resolved to "), path_name(F.col("image_path"))))


def find_missing_annotations(images: DataFrame, resolved: DataFrame) -> DataFrame:
    """Images that no annotation names."""
    rest = images.join(resolved.where("image_path is not null").select(F.col("image_path").alias("path")).distinct(), "path", "left_anti")
    return finding(rest, "missing_xml", F.col("path"), F.lit("no annotation references this image"))


def duplicate_groups(images: DataFrame) -> DataFrame:
    """(sha256, n): digests that several readable images share. A group is a count, never a list of members, so one
    of millions of copies costs no more than a pair."""
    return images.where("readable").groupBy("sha256").agg(F.count("*").alias("n")).where("n > 1")


def find_duplicate_images(images: DataFrame) -> DataFrame:
    rows = images.where("readable").join(duplicate_groups(images), "sha256")
    return finding(rows, "duplicate_images", F.col("path"), F.concat(F.lit("SHA-256 group "), "sha256"))


def class_counts(boxes: DataFrame) -> DataFrame:
    """(class_name, n) of named objects."""
    return boxes.where("coalesce(class_name, '') != ''").groupBy("class_name").agg(F.count("*").alias("n"))


def box_counts_per_image(images: DataFrame, boxes: DataFrame, side: float) -> DataFrame:
    """(image_id, object_count, small_box_count) with zero rows kept."""
    per = boxes.groupBy("image_id").agg(F.count("*").alias("object_count"), F.count_if(is_small_box(box(), side)).alias("small_box_count"))
    return images.select("image_id").join(per, "image_id", "left").fillna(0, ["object_count", "small_box_count"])


def audit_summary(findings: DataFrame, images: DataFrame, annotations: DataFrame, boxes: DataFrame, side: float) -> DataFrame:
    """(metric, key, value): counts per category with zeros; totals of images, annotations, objects and classes; a row
    for each class with its count; and the definition of a small box as a row without a value."""
    spark = findings.sparkSession
    base = spark.createDataFrame([(c,) for c in FINDING_CATEGORIES], "metric string")
    per = findings.groupBy(F.col("category").alias("metric")).agg(F.count("*").alias("n"))
    counts = base.join(per, "metric", "left").select("metric", F.lit("").alias("key"), F.coalesce("n", F.lit(0)).alias("value"))
    one = lambda df, name: df.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), F.lit("").alias("key"), "value")
    # one pass over the boxes; a row per class is left of it
    classes = boxes.groupBy(F.coalesce("class_name", F.lit("")).alias("key")).agg(F.count("*").alias("value"))
    rows = classes.select(F.explode(F.array(F.struct(F.lit("objects").alias("metric"), F.lit("").alias("key"), F.col("value").alias("value")), F.struct(F.lit("classes").alias("metric"), F.lit("").alias("key"), (F.col("key") != "").cast("long").alias("value")), F.struct(F.lit("object_class").alias("metric"), F.col("key").alias("key"), F.col("value").alias("value")))).alias("r")).select("r.*")
    rows = rows.where("metric != 'object_class' or key != ''").groupBy("metric", "key").agg(F.sum("value").alias("value"))
    totals = spark.createDataFrame([("objects", ""), ("classes", "")], "metric string, key string").join(rows.where("metric != 'object_class'"), ["metric", "key"], "left").fillna(0, ["value"])
    small = spark.createDataFrame([("very_small_box_definition", f"width or height <= {side:g} pixels", None)], "metric string, key string, value long")
    return union([counts, one(images, "images"), one(annotations, "annotations"), totals, rows.where("metric = 'object_class'"), small])
